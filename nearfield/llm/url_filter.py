"""URL filters: pattern rules indexed by their rarest literal token.

A rule can fit only if all its literal tokens are tokens of the URL, so it is filed under the one
that the fewest URLs of the table have. A URL's tokens fetch the rules filed under them, and only
those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """text names the rule and its length ranks it; pattern is searched in `host + path`, with A-Z of
    the host lower-cased; tokens are [a-z0-9]+ runs (lower case) that any URL it fits has whole."""

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()


def site_rule(text: str, verdict: str) -> Rule:
    """A rule like `example.com/en/`: that host and its subdomains, paths that start with /en/."""
    host, slash, rest = text.partition("/")
    host = host.translate(_LOWER)
    # the path's last token may go on in the URL; the path's case counts, tokens are looked up without
    closed = re.match(r"(.*[^A-Za-z0-9])?", rest, re.S).group()
    tokens = (*_TOKEN.findall(host), *_TOKEN.findall(closed.translate(_LOWER)))
    end = re.escape(slash + rest) or r"(?=/|\Z)"
    return Rule(text, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{end}", tuple(dict.fromkeys(tokens)))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return rest[:end].translate(_LOWER), path[:stop]


def token_frequencies(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many of all URLs each of the given tokens occurs; bounded by the rules' tokens."""
    lower = F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.array_intersect(F.split(lower, "[^a-z0-9]+"), F.lit(tokens))
    rows = urls.select(F.explode(parts).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each URL; of the rules that fit the longest decides.

    Among rules of equal length one that blocks goes first, then the smaller text. Where none fits,
    rule is null and verdict is `otherwise`. Null urls and such without :// have empty host and
    path, which no site rule fits. Repeated rows give repeated rows; null ids stay null.
    """
    source = only(pages, page_id=(id_col, "bigint"), url=(url_col, "string"))
    rules = sorted(set(rules), key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    tokens = sorted({t for r in rules for t in r.tokens})
    seen = token_frequencies(source, tokens) if tokens else {}
    filed: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            filed.setdefault(min(rule.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(i)
        else:
            always.append(i)

    def run(batches):
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            hosts, paths, found, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                at = host + path
                candidates = set(always)
                if at:
                    for token in set(_TOKEN.findall(at.translate(_LOWER))):
                        candidates.update(filed.get(token, ()))
                rule = None
                for i in sorted(candidates):
                    if i not in compiled:
                        compiled[i] = re.compile(rules[i].pattern, re.S)
                    if compiled[i].search(at):
                        rule = rules[i]
                        break
                hosts.append(host)
                paths.append(path)
                found.append(rule.text if rule else None)
                verdicts.append(rule.verdict if rule else otherwise)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts))], ["page_id", "host", "path", "rule", "verdict"])

    return source.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")
