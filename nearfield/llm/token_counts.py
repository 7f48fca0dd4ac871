"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Byte-level BPE tokens tile the text's bytes, so token lengths
give each token's span of characters. An interval join then meets token spans with section spans,
both sorted, and each token goes to sections by a stated rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import SLICE_BYTES, only, slices
from .tokens import Encoder

#: How a token that lies in more than one section is allocated.
RULES = ("start", "majority", "split")


def line_sections(text: str) -> list[tuple[int, int]]:
    """The default sections: lines, each with its line break, as (first character, end)."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out


def character_spans(text: str, ids: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token; a token that holds part of a character covers it."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    end = np.cumsum(n_bytes[ids])
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before a byte
    start = end - n_bytes[ids]
    inside = (data[np.minimum(start, len(data) - 1)] & 0xC0) == 0x80
    return begun[start] - inside, begun[end]


def attribute(start: np.ndarray, end: np.ndarray, first: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section as (whole-token counts, tokens allocated to it).

    Sections are sorted and don't overlap. The first result counts tokens wholly inside; the second
    is by rule. start: the section of the token's first character. majority: the section with most
    of its characters, the earlier at a tie. split: each section its share of the characters.
    Characters outside all sections allocate nothing.
    """
    n, m = len(first), len(start)
    whole, share = np.zeros(n), np.zeros(n)
    if not n or not m:
        return whole, share
    low = np.searchsorted(stop, start, "right")  # the first section that ends after the token starts
    high = np.searchsorted(first, end, "left")  # sections that begin before the token ends
    size = np.maximum(high - low, 0)
    one = np.flatnonzero(size == 1)
    inside = one[(first[low[one]] <= start[one]) & (end[one] <= stop[low[one]])]
    whole += np.bincount(low[inside], minlength=n)
    share += whole
    rest = np.setdiff1d(np.flatnonzero(size), inside)
    if len(rest):
        token = np.repeat(rest, size[rest])
        section = np.repeat(low[rest], size[rest]) + np.arange(len(token)) - np.repeat(np.cumsum(size[rest]) - size[rest], size[rest])
        overlap = np.minimum(end[token], stop[section]) - np.maximum(start[token], first[section])
        real = overlap > 0
        token, section, overlap = token[real], section[real], overlap[real]
        if rule == "split":
            share += np.bincount(section, overlap / (end - start)[token], minlength=n)
        else:
            pick = first[section] <= start[token] if rule == "start" else None
            if pick is None:
                order = np.lexsort((section, -overlap, token))
                section, token = section[order], token[order]
                pick = np.concatenate([[True], token[1:] != token[:-1]])[: len(token)]
            share += np.bincount(section[pick], minlength=n)
    return whole, share


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", sections=line_sections
) -> DataFrame:
    """(doc_id, section, first, end, n_tokens, n_whole, doc_tokens) of each section of each text.

    sections: text -> sorted, disjoint (first character, end) spans; by default lines with their
    line break. n_tokens is by rule (see attribute), n_whole the tokens wholly inside. Under
    "start", sections that tile a text have n_tokens that add up to doc_tokens.

    A null or empty text without sections gives one row with section null, first and end 0 and 0
    tokens, so that every document is there. Repeated rows give repeated rows; null ids stay null.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {', '.join(RULES)}")

    def run(batches):
        encoder = Encoder(vocabulary)
        names = ["doc_id", "section", "first", "end", "n_tokens", "n_whole", "doc_tokens"]

        def made(ids, rows, columns):
            columns = [np.concatenate(c) if c else np.zeros(0) for c in zip(*columns, strict=True)]
            section = pa.array(columns[0].astype(np.int64), mask=columns[0] < 0)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), section, *(pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns[1:], kinds, strict=True))], names
            )

        for batch in batches:
            for first, last, data, ends in slices(batch.column(1), SLICE_BYTES):
                data, at, rows, columns = data.tobytes(), 0, [], []
                for row, end in zip(range(first, last), ends.tolist(), strict=True):
                    text, at = data[at:end].decode("utf-8", "replace"), end
                    ids = encoder.encode(text)
                    spans = np.array(sections(text) or [(0, 0)], np.int64)
                    n = len(spans)
                    none = n == 1 and not spans[0].any()
                    start, stop = character_spans(text, ids, encoder.n_bytes) if len(ids) else (ids, ids)
                    whole, share = attribute(start, stop, spans[:, 0], spans[:, 1], rule)
                    rows += [row] * n
                    columns.append((np.full(n, -1) if none else np.arange(n), spans[:, 0], spans[:, 1], share, whole, np.full(n, len(ids))))
                yield made(batch.column(0), rows, columns)

    return only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string")).mapInArrow(
        run, "doc_id bigint, section bigint, first bigint, end bigint, n_tokens double, n_whole bigint, doc_tokens bigint"
    )
