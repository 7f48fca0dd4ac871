"""The operators against plain versions, and on awkward rows."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearfield.llm import embedding_dedup, html_text, packing, queries, shared, simhash, substring_dedup, toxicity
from nearfield.llm.components import connected_components
from nearfield.llm.decontaminate import contaminated_words
from nearfield.llm.embedding_dedup import near_duplicate_vectors
from nearfield.llm.html_text import extract_pages, page_lines, shared_lines
from nearfield.llm.line_dedup import remove_boilerplate_lines
from nearfield.llm.packing import cutting_stock, pack
from nearfield.llm.simhash import simhash_groups, trie_self_join
from nearfield.llm.substring_dedup import remove_repeated_substrings
from nearfield.llm.token_counts import attribute, token_counts
from nearfield.llm.tokens import Encoder
from nearfield.llm.toxicity import fit_toxicity, score_toxicity
from nearfield.llm.url_filter import Rule, judge_urls, site_rule, split_url

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, seq string, hash string, pos string, site string"


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def frame(spark, rows):
    """Documents from (id, text) or (id, text, source), with columns whose names could clash."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else None, None, "x", None, "y", "z") for r in rows], DOCS)


def words(rng, n, many=40):
    return " ".join(rng.choice([f"w{i}" for i in range(many)]) for _ in range(n))


def awkward(seed=0):
    """Nulls, empties, blanks, ties, copies, a very long text, repeats inside and across texts."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 90)) for _ in range(12)]
    out = [None, "", " \t\n", "one", "One", *base, *base[:4], base[0] + " tail", "head " + base[1] + "\n" + base[2]]
    out += ["Aié " * 300, "Aié " * 280 + "end", words(rng, 4000, 500), "x" * 5000, "naïve Ünïcode ñ 漢字 🙂 " * 6]
    return dict(enumerate(out))


# --- shared pieces ---


def test_word_hashes_agree_over_slices(monkeypatch):
    import pyarrow as pa

    texts = [None, "", "a b", "ab cd " * 400, "é " * 50, "x" * 900, " lead", "trail "]
    w = shared.Words(substring_dedup.SPACES, fold=False)
    seen = []
    for limit in (1 << 20, 64):
        monkeypatch.setattr(shared, "SLICE_BYTES", limit)
        rows = {}
        for first, _, data, h, a, b, counts in shared.word_slices(pa.array(texts), w):
            at = 0
            for i, n in enumerate(counts.tolist()):
                rows[first + i] = [(int(x), bytes(data[p:q])) for x, p, q in zip(h[at : at + n], a[at : at + n], b[at : at + n], strict=True)]
                at += n
        assert [[x[1] for x in rows[i]] for i in range(len(texts))] == [(t or "").encode().split() for t in texts]
        seen.append(rows)
    assert seen[0] == seen[1]
    by_word = {}
    for h, word in (x for r in seen[0].values() for x in r):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_shared_folder_is_the_sessions(spark):
    found = spark.conf.get("spark.checkpoint.dir", None)
    assert shared.shared_dir(spark) == found.rstrip("/") if found else shared.shared_dir(spark).startswith("file:")


def test_stage_tables_are_deleted(spark):
    table = shared.staged(spark.range(3), "some")
    path = table._nearfield_path
    assert path in shared._stage_paths and table.count() == 3
    shared.dropped(table)
    assert path not in shared._stage_paths
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(5, 5), (None, 3), (4, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == brute.roots({x for link in real for x in link}, real)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- op1 ---


def test_encoder_equals_the_library():
    e = Encoder(queries.vocabulary())
    rng = random.Random(1)
    parts = [" ", "\n", "\t", "a", "b", "é", "'s", "1", ".", "<|endoftext|>", " ", "　", "ab", "  ", "漢", "🙂", "don't"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        ids = e.encode(text)
        assert ids.tolist() == e.whole.encode(text, add_special_tokens=False).ids
        assert e.n_bytes[ids].sum() == len(text.encode())


def test_attribution_rules():
    start, end = np.array([0, 3, 5, 9]), np.array([3, 5, 9, 10])
    first, stop = np.array([0, 6]), np.array([6, 10])
    for rule, want in (("start", [3, 1]), ("majority", [2, 2]), ("split", [2.25, 1.75])):
        whole, share = attribute(start, end, first, stop, rule)
        assert whole.tolist() == [2, 1] and share.tolist() == want
    assert attribute(start, end, np.array([4]), np.array([4]), "start")[1].tolist() == [0]


def test_token_counts_by_hand(spark, documents):
    e = Encoder(queries.vocabulary())
    texts = {**awkward(), 100: "a\nb\n\nlast", 101: "🙂🙂\n漢", **{1000 + i: t for i, t in documents.items()}}
    rows = token_counts(frame(spark, [*texts.items(), (7, "x"), (None, "y z")]).where("doc_id IS NULL OR doc_id <> 7 OR text = 'x'"), queries.vocabulary()).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {*texts, None}
    for d, t in {**texts, 7: "x", None: "y z"}.items():
        own = sorted(by[d], key=lambda r: r["first"])
        text = t or ""
        assert [text[r["first"] : r["end"]] for r in own] == (re.findall(r"[^\n]*\n|[^\n]+", text) or [""])
        offsets = e.whole.encode(text, add_special_tokens=False).offsets
        for r in own:
            assert r["n_tokens"] == sum(r["first"] <= a < r["end"] for a, b in offsets)
            assert r["n_whole"] == sum(r["first"] <= a and b <= r["end"] for a, b in offsets)
            assert r["doc_tokens"] == len(offsets)
    with pytest.raises(ValueError):
        token_counts(frame(spark, []), queries.vocabulary(), rule="last")
    assert token_counts(frame(spark, []), queries.vocabulary()).count() == 0


# --- op2 ---


def test_boilerplate_lines(spark):
    notice = "All rights are reserved by us."
    rows = [(i, f"own text of document {i}\n{notice}\nshort", f"s{i % 7}") for i in range(14)]
    rows += [(20, None, "s1"), (21, "", None), (22, f" {notice}\t\n{notice}", "s1"), (23, "a line that only five sites have", "s0")]
    rows += [(30 + i, "a line that only five sites have", f"s{i}") for i in range(1, 5)]
    rows += [(5, "own text of document 5\n" + notice + "\nshort", "s5"), (None, notice, None)]
    got = {}
    for r in remove_boilerplate_lines(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r[1:])
    assert got[None] == [(1, 0, notice)]  # a null id comes first
    assert got[0] == [(3, 1, "own text of document 0\nshort")]
    assert got[5] == [(3, 1, "own text of document 5\nshort")] * 2
    assert got[20] == [(0, 0, "")] and got[21] == [(0, 0, "")] and got[22] == [(2, 2, "")]
    assert got[23] == [(1, 0, "a line that only five sites have")]
    assert remove_boilerplate_lines(frame(spark, [])).count() == 0


def test_boilerplate_by_estimate_alone_and_extreme_ids(spark):
    """Lines far from the threshold are decided by their sketch; the smallest and largest ids are ids like others."""
    line = "a line that forty sites have in common"
    rows = [(i, line, f"s{i}") for i in range(40)] + [(-(2**63), line, "s0"), (2**63 - 1, line + "\nown", "s1")]
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in remove_boilerplate_lines(frame(spark, rows)).collect()}
    assert got.pop(-(2**63)) == (0, line) and got.pop(2**63 - 1) == (1, "own") and set(got.values()) == {(1, "")}
    rows.append((None, line, "s9"))
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in remove_boilerplate_lines(frame(spark, rows)).collect()}
    assert got[None] == (0, line) and got[-(2**63)] == (1, "")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    canon = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert canon(df.select(*columns).collect()) == canon(want.select(*columns).fetchall())


# --- op3 ---


def test_cutting_stock_meets_demand():
    rng = np.random.default_rng(0)
    for n, capacity, most in ((1, 10, 5), (7, 20, 30), (60, 128, 9), (100, 512, 400)):
        sizes = np.sort(rng.choice(np.arange(1, capacity), min(n, capacity - 1), replace=False))
        demand = rng.integers(1, most, len(sizes))
        plan = cutting_stock(sizes, demand, capacity).patterns
        assert sum(p * t for p, t in plan).tolist() == demand.tolist()
        assert all(p @ sizes <= capacity and t > 0 for p, t in plan)
    assert cutting_stock(np.zeros(0, np.int64), np.zeros(0, np.int64), 8).patterns == []
    # thirds: first fit decreasing would pair the halves badly, the program finds the whole patterns
    plan = cutting_stock(np.array([3, 5, 7]), np.array([900, 900, 900]), 15).patterns
    assert sum(t for _, t in plan) == 900
    demand = rng.integers(500, 900, 60)
    sizes = np.arange(20, 80)
    plan = cutting_stock(sizes, demand, 128)
    assert sum(t for _, t in plan.patterns) <= plan.bound * (1 + plan.gap) + 60


@pytest.mark.parametrize("n", [100, 400])
def test_the_first_basis_beside_a_running_spark(spark, n):
    """Wide bases, where a threaded inversion hung once Spark had started."""
    assert spark.range(3).count() == 3
    rng = np.random.default_rng(n)
    sizes, demand = np.sort(rng.choice(np.arange(1, 512), n, replace=False)), rng.integers(1, 10**6, n)
    columns, used, inverse = packing._greedy_basis(sizes, demand, 512)
    assert np.allclose(np.einsum("ij,jk->ik", columns, inverse), np.eye(n))
    assert np.allclose(columns @ used, demand) and (sizes @ columns <= 512).all()
    plan = cutting_stock(sizes, demand, 512)
    assert plan.gap <= 2e-4 and sum(p * t for p, t in plan.patterns).tolist() == demand.tolist()


def test_columns_enter_where_the_start_is_poor(monkeypatch):
    calls = []
    real = packing.best_pattern
    monkeypatch.setattr(packing, "best_pattern", lambda *a: calls.append(1) or real(*a))
    sizes, demand = np.array([34, 35, 51, 66]), np.array([400, 300, 500, 200])
    plan = cutting_stock(sizes, demand, 100).patterns
    assert calls and sum(p * t for p, t in plan).tolist() == demand.tolist()


@pytest.mark.parametrize("length,unit", [(2048, 4), (64, 4), (50, 7)])
def test_packing(spark, documents, length, unit):
    e = Encoder(queries.vocabulary())
    docs = {**awkward(), **{1000 + i: t for i, t in documents.items()}}
    rows = pack(frame(spark, docs.items()), queries.vocabulary(), length=length, unit=unit).collect()
    waste = brute.packed_well(rows, docs, lambda t: e.whole.encode(t, add_special_tokens=False).ids, length)
    assert waste < (0.03 if length == 2048 else 0.2)
    if length == 2048:
        assert all(r["doc_tokens"] > length or r["length"] == r["doc_tokens"] for r in rows)


def test_packing_keeps_ids_and_empty_tables(spark):
    rows = pack(frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), queries.vocabulary(), keep_ids=True).collect()
    assert len(rows) == 3 and len({r["sequence_id"] for r in rows}) == 1
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist()[-1] for r in rows) == [1, 1, 1]
    rows = pack(frame(spark, [(None, f"a {i % 7}") for i in range(60)] + [(1, "b b")] * 60), queries.vocabulary(), length=64, unit=1).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == 120
    assert pack(frame(spark, []), queries.vocabulary()).count() == 0
    assert pack(frame(spark, [(1, "")]), queries.vocabulary(), end_id=None).count() == 0


# --- op4 ---


def toxic_rows(n=400, seed=0):
    rng = random.Random(seed)
    bad = ["idiot", "lowei" + "xyz", "loweiqq", "veju"]
    rows, labels = [], []
    for i in range(n):
        text = words(rng, rng.randrange(3, 80), 300).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(bad) + rng.choice(["", ".", ","]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    extra = [(1000, None), (1001, ""), (1002, "w1 " * 3000 + "IDIOT! " + "w2 " * 3000), (None, "idiot"), (1003, "loweinew w1")]
    docs = frame(spark, rows + extra)
    field = fit_toxicity(docs, spark.createDataFrame([*labels, (1000, 1), (None, 1), (5, None)], "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r for r in score_toxicity(docs, field).collect()}
    assert len(got) == len(rows) + len(extra)
    import zlib

    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(got[i]["score"] >= 0.5) == bool(dict(labels)[i]) for i in held]
    assert len(held) > 40 and np.mean(right) > 0.95
    assert got[1000]["score"] == got[1001]["score"] < 0.5 <= got[1003]["score"]
    assert got[1002]["score"] >= 0.5
    text = dict(extra)[1002]
    assert [text[s["first"] : s["end"]] for s in got[1002]["spans"]] == ["IDIOT!"]


def field_case(rng, texts=7, most=9, share=0.4, features=3):
    """Labelled chains and, token by token, what brute.field wants."""
    length = rng.integers(0, most + 1, texts)
    at = [np.flatnonzero(rng.random(n) < share) for n in length]
    counts = np.array([len(x) for x in at], np.int64)
    chains = toxicity.Chains(np.concatenate(at).astype(np.int64), counts, length.astype(np.int64))
    n = int(counts.sum())
    owned = rng.random((n, features)) < 0.5
    owned[np.arange(n), rng.integers(0, features, n)] = True
    token, feature = np.nonzero(owned)
    return toxicity.Labelled(chains, token, feature, (rng.random(n) < 0.5).astype(float), features), owned


def test_chain_sums_equal_all_labellings():
    rng = np.random.default_rng(2)
    for transitions in ([[0.3, -0.5], [-0.2, 0.9]], [[-0.5, 1.0], [0.8, -1.0]]):
        data, owned = field_case(rng)
        c, weights, bias, transitions = data.chains, rng.normal(0, 2, 3), -1.0, np.array(transitions)
        p, log_z, ones, steps = toxicity.chain_sums(bias, transitions, owned @ weights, c)
        want = [brute.labellings(n, dict(zip(at.tolist(), (owned[b : b + len(at)] @ weights).tolist(), strict=True)), bias, transitions)
                for n, b, at in zip(c.length.tolist(), c.base.tolist(), np.split(c.at, np.cumsum(c.counts)[:-1]), strict=True)]
        assert np.isclose(log_z, sum(w[0] for w in want))
        assert np.isclose(ones, sum(sum(w[1]) for w in want)) and np.allclose(steps, sum(w[2] for w in want))
        assert np.allclose(p, [want[t][1][i] for t, i in zip(c.text.tolist(), c.at.tolist(), strict=True)])


def test_the_fit_is_the_maximum_of_the_plain_likelihood():
    rng = np.random.default_rng(4)
    data, owned = field_case(rng, texts=12, most=7)
    found = toxicity.maximum(lambda v: toxicity.likelihood(v, data), np.zeros(8), small=1e-6)
    c = data.chains
    plain = lambda v: brute.field_likelihood(v, c.length.tolist(), np.split(c.at, np.cumsum(c.counts)[:-1]), owned, data.gold, c.base.tolist())
    best = plain(found)
    assert np.isclose(best, toxicity.likelihood(found, data)[0])
    for i in range(8):  # a concave function with a flat slope has its maximum there
        e = np.eye(8)[i] * 1e-4
        assert abs(plain(found + e) - plain(found - e)) / 2e-4 < 1e-4
        assert plain(found + 100 * e) < best > plain(found - 100 * e)


def test_a_long_chain_beside_short_ones():
    """A text of known tokens alone, a hundred thousand of them, among ten thousand short texts."""
    n = 100_000
    counts = np.array([n, *[1] * 10_000, 0], np.int64)
    chains = toxicity.Chains(np.concatenate([np.arange(n), np.full(10_000, 2)]), counts, np.array([n, *[5] * 10_000, 9]))
    field = toxicity.Field({}, -2.0, np.array([[0.3, -0.5], [-0.2, 0.9]]), np.array([-3.0, 4.0, 1.0]))
    p = field.marginals(np.full(n + 10_000, 0.5), chains)
    assert np.isfinite(p).all() and p.std() < 0.2 and np.allclose(p[n:], p[n]) and np.allclose(p[100 : n - 100], p[n // 2])
    assert len(field.score(p, chains)) == 10_002


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    for labels in ([], [(1, 1)], [(1, 0)]):
        field = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert all(0 <= r["score"] <= 1 for r in score_toxicity(docs, field).collect())
    assert score_toxicity(frame(spark, []), field).count() == 0


# --- op5 ---

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><div>Site name</div></header><nav><ul><li><a href="/a">Menu</a><li>More</ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">Accept</div><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp;part <i>goes</i>
 on.<br>here<p>Second &lt;b&gt; &#233;<form><input>Sign up</form><div class="related">See</div><ul><li>one<li>two</ul>
<table><tr><td>x<td>y</table><aside>Side</aside></article><section id="comments"><article><p>Reader</p></article></section><footer>&copy; us</footer>"""


def test_page_text_by_markup():
    lines = page_lines(PAGE)
    kept, _ = html_text.main_text(lines, [])
    assert kept == "Title & more\nFirst part goes on. here\nSecond <b> é\none\ntwo\nx\ny"
    assert page_lines("") == [] and [x.text for x in page_lines("plain <b>text")] == ["plain text"]
    assert [x.text for x in page_lines("<p>a<script>x</p>")] == ["a"]
    assert [x.text for x in page_lines("1 < 2 <p title='>'>b</p>")] == ["1 < 2", "b"]


def test_broken_markup_neither_leaks_nor_costs_more_than_its_length():
    import time

    text = lambda source: [x.text for x in page_lines(source)]
    assert text('<p>one</p><a title="x>two</a>') == ["one", "two"] and text("<p>a<a title='it' b=\"x'>y\">z</a>") == ["az"]
    assert text("<p>a</p><b") == ["a"] and text("<p>a<!-- b") == ["a"] and text("x</script y><p>b") == ["x", "b"] and text("<script>a</script") == []
    for part in ('<a "x \'', "<a '", '<p "x>', "<div>", "</p <", "<!-- ", "<script>", "</script ", "<td>", "<div><option></option></p>"):
        began = time.perf_counter()
        page_lines(part * (400_000 // len(part)))
        assert time.perf_counter() - began < 8


def test_a_long_page_is_aligned_in_bounded_memory(monkeypatch):
    import tracemalloc

    rng = random.Random(3)
    a = [f"line {rng.randrange(4000)}" for _ in range(12_000)]
    b = [x for x in a if rng.random() < 0.9] + ["end"]
    whole = shared_lines(a, b)
    monkeypatch.setattr(html_text, "ALIGNED", 1 << 20)
    tracemalloc.start()
    found = shared_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(whole) == len(b) - 1 and peak < 20 << 20
    it = iter(b)
    assert all(a[i] in it for i in found)
    source = "".join(f"<div>line {i} of a page of ten megabytes, and so on</div>" for i in range(180_000))
    assert len(source) > 10 << 20 and len(page_lines(source)) == 180_000


@pytest.mark.parametrize("aligned", [1 << 26, 1, 20])
def test_shared_lines_is_a_longest_common_subsequence(monkeypatch, aligned):
    monkeypatch.setattr(html_text, "ALIGNED", aligned)
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = shared_lines(a, b)
        assert len(found) == table[-1][-1] and found == sorted(set(found))
        it = iter(b)
        assert all(a[i] in it for i in found)


def plain_pages(rows):
    """Pages sorted by host, path, id and source, differenced with the nearer of both neighbours on the host."""
    order = []
    for i, url, source in rows:
        host, path = split_url(url)
        order.append(((host, host + path, i is not None, i or 0), i, url, page_lines(source or ""), host, host + path))
    order.sort(key=lambda x: x[0])
    out = []
    for n, (_, i, url, lines, host, path) in enumerate(order):
        near = [order[m] for m in (n - 1, n + 1) if 0 <= m < len(order) and order[m][4] == host]
        same = lambda x, path=path: next((k for k, (a, b) in enumerate(zip(x[5], path, strict=False)) if a != b), min(len(x[5]), len(path)))
        near.sort(key=lambda x: -same(x))
        shared = set()
        for other in near:
            found = shared_lines([x.text for x in lines], [x.text for x in other[3]])
            full = max(sum(len(x.text) for x in p if not x.never) for p in (lines, other[3]))
            if sum(len(lines[k].text) for k in found if not lines[k].never) < 0.9 * full:
                shared = set(found)
                break
        main = [x.text for x in lines if x.main and not x.never]
        out.append((i, url, "\n".join(main or [x.text for k, x in enumerate(lines) if not x.never and k not in shared])))
    return sorted(out, key=str)


def test_pages_are_differenced_within_their_host(spark):
    """Whole pages against a plain version, at several numbers of partitions."""
    rng = random.Random(7)
    pages = []
    for i in range(90):
        own = "".join(f"<div>{words(rng, rng.randrange(4, 30), 3000)}</div>" for _ in range(rng.randrange(1, 5)))
        pages.append((i, f"http://h{i % 3}.org/{'ab'[i % 2]}/{i:02}?q=1", f"<div>Template top of site {i % 3}, longer than the text of some of its pages, much longer indeed</div><nav>Menu {i}</nav>{own}<div>Template end</div>"))
    pages += [(200 + i, f"http://h0.org/a/{i:02}x", pages[4][2]) for i in range(3)] + [(50, None, None), (51, "no host", ""), (52, "http://lone.org/", pages[9][2]), (None, "http://n.org/x", PAGE)]
    pages += [(300, "http://far.org/a", "<div>one</div><div>two of them</div>"), (301, "http://far.org/b", "<div>one</div><div>another thing</div>")]
    df = spark.createDataFrame([(*r, "x", "y") for r in pages], "page_id bigint, url string, html string, host string, path string")
    want = plain_pages(pages)
    assert ("two of them" in [t for _, _, t in want]) and sum("Template" in t for _, _, t in want) < 8
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = extract_pages(df.repartition(3)).collect()
            assert sorted(((r["page_id"], r["url"], r["text"]) for r in got), key=str) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(extract_pages(df.union(df)).collect()) == 2 * len(pages)
    assert extract_pages(df.where("page_id = -1")).count() == 0


def test_pages_of_the_fixture(spark):
    """The fixture's pages have all their text in one <article> of h1 and p."""
    import html

    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in queries.op5_html_text(spark, SF).collect()}
    for i, source in rows:
        body = source.split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


# --- op6 ---


@pytest.mark.parametrize("window,base", [(20, 10), (20, 5), (8, 2), (7, 3)])
def test_substrings(spark, window, base):
    docs = awkward()
    rows = remove_repeated_substrings(frame(spark, docs.items()), window=window, base=base).collect()
    want = brute.substrings(docs, window)
    assert {r[0]: tuple(r[1:]) for r in rows} == want


def test_substrings_of_documents_and_odd_ids(spark, documents):
    rows = remove_repeated_substrings(frame(spark, documents.items())).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == brute.substrings(documents)
    long = words(random.Random(1), 60)
    rows = remove_repeated_substrings(frame(spark, [(3, long), (3, long), (None, long), (None, "a"), (2, "b " + long)])).collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in rows) == [(0, 1, 0), (0, 60, 60), (2, 61, 0), (3, 60, 60), (3, 60, 60)]
    assert remove_repeated_substrings(frame(spark, [])).count() == 0
    rows = [(2**63 - 1, long), (None, long), (None, "z " + long), (None, long + " " + long), (2**63 - 1, "other")]
    got = sorted(((r[0] or 0, r[1], r[2]) for r in remove_repeated_substrings(frame(spark, rows)).collect()))
    assert got == [(0, 60, 60), (0, 61, 60), (0, 120, 120), (2**63 - 1, 1, 0), (2**63 - 1, 60, 0)]
    rows = [(None, "head " + long)] * 50 + [(None, long + " tail")] * 50 + [(None, "head " + long + f" {i}") for i in range(3)]
    got = remove_repeated_substrings(frame(spark, rows)).collect()  # one document: only second starts in a text go
    assert len(got) == 103 and all(r["n_removed"] == 0 for r in got)


# --- op7 ---


def test_vectors(spark):
    rng = np.random.default_rng(0)
    center = rng.standard_normal((6, 24))
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(150)]
    rows += [(200 + i, (center[i % 6] + rng.standard_normal(24) * (0.08 if i % 6 else 0.3)).tolist()) for i in range(240)]
    rows += [(500 + i, rows[160][1]) for i in range(5)] + [(600, (np.array(rows[160][1]) * 3).tolist())]
    odd = [(700, None), (701, []), (702, [0.0] * 24), (703, [float("nan")] * 24), (704, [1.0, None]), (705, [1.0, 0.0]), (706, [2.0, 0.0]), (707, [math.inf] * 24)]
    want = brute.vectors(rows + odd)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd + [rows[0], (None, rows[1][1])]], "vec_id bigint, embedding array<double>, dim int, bytes string")
    got = {}
    for r in near_duplicate_vectors(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert got.pop(None) == [(0, None)] and got.pop(0) == [want[0]] * 2
    want.pop(0)
    assert {k: v[0] for k, v in got.items()} == want
    assert near_duplicate_vectors(df.where("vec_id = -1")).count() == 0


@pytest.mark.parametrize("cosine", [0.9, 0.92])
@pytest.mark.parametrize("n,window", [(4_000, 128), (20_000, 128), (80_000, 512)])
def test_recall_of_planted_vectors(spark, n, window, cosine):
    """Pairs planted among random vectors and inside a cone that holds a third of the rows; windows are of 1/30 to 1/160 of the table."""
    rng = np.random.default_rng(n)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, axis = unit(rng.standard_normal((n, 64))), unit(rng.standard_normal((1, 64)))
    x[: n // 3] = unit(math.sqrt(0.7) * axis + math.sqrt(0.3) * x[: n // 3])
    at = np.concatenate([np.arange(300), np.arange(n - 300, n)])
    side = rng.standard_normal((600, 64))
    side = unit(side - np.einsum("ij,ij->i", side, x[at])[:, None] * x[at])
    cosine += 1e-6
    rows = [(i, v) for i, v in enumerate(np.concatenate([x, cosine * x[at] + math.sqrt(1 - cosine**2) * side]).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in near_duplicate_vectors(df, window=window).where("n_links > 0").collect()}
    met = np.array([got.get(n + i, -1) == got.get(int(a), -2) for i, a in enumerate(at)])
    print("recall in the cone, elsewhere:", n, cosine, met[:300].mean(), met[300:].mean())
    assert met[:300].mean() >= 0.9 and met[300:].mean() >= 0.9


@pytest.mark.parametrize("block,chunk,window", [(16, 64, 2048), (16, 4096, 40), (512, 4096, 40)])
def test_vectors_in_large_clusters(spark, monkeypatch, block, chunk, window):
    """A chain, a dense group and loose ones, larger than the blocks and windows, against all pairs."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    turn = np.linspace(0, 2.5, 300)
    chain = np.stack([np.cos(turn), np.sin(turn), *np.zeros((6, 300))], axis=1) + 0.01 * rng.standard_normal((300, 8))
    dense = rng.standard_normal(8) + 0.02 * rng.standard_normal((400, 8))
    rows = list(enumerate(np.concatenate([chain, dense, rng.standard_normal((300, 8))])[rng.permutation(1000)].tolist()))
    want = brute.vectors(rows)
    assert max(n for n, _ in want.values()) >= 399
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df, window=window).collect()}
    if window > 1000:
        assert got == want
    else:
        assert all(got[i][0] <= want[i][0] for i in want) and sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_vectors_of_one_dimension_and_mixed_precision(spark):
    rows = [(i, [float(i - 40)]) for i in range(80)] + [(100, [0.1, 0.2]), (101, [np.float32(0.1).item(), np.float32(0.2).item()]), (102, [1e100, 2e100]), (103, [-0.0, 1.0]), (104, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df, window=8).collect()}
    assert got == brute.vectors(rows)


def test_links_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3000, 6))
    df = spark.createDataFrame(list(enumerate(base.tolist())), "vec_id bigint, embedding array<double>")
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.append(sorted(map(tuple, near_duplicate_vectors(df.repartition(int(parts)), window=64).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_recall_of_the_fixtures_vectors(spark):
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    want = brute.vectors(rows)
    got = {r["vec_id"]: r["n_links"] for r in queries.op7_embedding_dedup(spark, "/root/testdata/sf0.1").collect()}
    links = sum(n for n, _ in want.values())
    assert all(got[i] <= want[i][0] for i in got) and sum(got.values()) >= 0.9 * links


# --- op8 ---


def test_urls(spark):
    urls = ["http://A.Example.com/en/71#x", "http://example.com/en/8", "ftp://com/en/", "http://xcom/en/", "http://net/de/8", "http://q.example.net/de/8?a", "x", "", None]
    urls += ["http://org", "http://org?/es/", "http://a.org/es/", "http://a.org/ES/", "http://example.com:80/en/7", "://b.com/en/", "http://u.net/de/7://c", "http:///en/", "http://org/es/" + "y" * 9000]
    rules = [site_rule(*r) for r in queries.URL_RULES]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(0, urls[0], "h", "p")], "page_id bigint, url string, host string, path string")
    rows = judge_urls(df, rules).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path = split_url(urls[r["page_id"]])
        fits = [(len(t), t, v) for t, v in queries.URL_RULES if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        best = max(fits, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *best[1:])
    assert judge_urls(df.where("page_id = -1"), rules).count() == 0
    only = judge_urls(df, [Rule("any", "block", r"\d{2,}")]).collect()
    assert {r["page_id"] for r in only if r["verdict"] == "block"} == {0, 13}
    assert judge_urls(df, [site_rule("org", "block")]).where("verdict = 'block'").count() == 5


# --- op9 ---


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(0)
    for width, errors in ((10, 2), (43, 4), (20, 0)):
        group = np.sort(rng.integers(0, 6, 300))
        value = rng.integers(0, 1 << min(width, 12), 300).astype(np.uint64)
        order = np.lexsort((value, group))
        group, value = group[order], value[order]
        i, j = trie_self_join(group, value, width, errors)
        want = {(a, b) for a in range(300) for b in range(a + 1, 300) if group[a] == group[b] and bin(int(value[a] ^ value[b])).count("1") <= errors}
        found = set(zip(i.tolist(), j.tolist(), strict=True))
        assert found <= want or errors == 0
        assert brute.roots(range(300), found) == brute.roots(range(300), want)
        distinct = {p for p in want if value[p[0]] != value[p[1]]}
        unique = np.unique(np.stack([group.astype(np.uint64), value]), axis=1).shape[1]
        assert unique < 300 or found == distinct


@pytest.mark.parametrize("leaves,blocks", [(1024, 6), (8, 6), (1024, 8)])
def test_simhash(spark, monkeypatch, leaves, blocks):
    monkeypatch.setattr(simhash, "NODE_LEAVES", leaves)
    docs = awkward()
    rng = random.Random(5)
    long = words(rng, 400, 3000).split()
    for i in range(40):
        near = long.copy()
        near[rng.randrange(400)] = f"new{i}"
        docs[100 + i] = " ".join(near)
    rows = simhash_groups(frame(spark, docs.items()), shingle=4, blocks=blocks).collect()
    assert {r[0]: (r[1] % (1 << 64), r[2]) for r in rows} == brute.simhash(docs)
    assert all(r["kept"] == (r[0] == r[2]) for r in rows)


def test_blocks_grow_with_the_fingerprints():
    sizes = [0, 10**6, 10**8, 10**9, 10**10, 10**12, 10**14]
    blocks = [simhash.blocks_for(n, 4) for n in sizes]
    assert blocks == sorted(blocks) and blocks[2] == 6 < blocks[-1]
    for n, k in zip(sizes, blocks, strict=True):
        assert n >> sum(sorted(w for _, w in simhash._fields(k))[: k - 4]) <= 256


def test_simhash_of_documents_and_odd_ids(spark, documents):
    rows = queries.op9_simhash(spark, SF).collect()
    assert {r[0]: (int(r[1], 16), r[2]) for r in rows} == brute.simhash(documents)
    rows = simhash_groups(frame(spark, [(4, "a b"), (4, "a b"), (None, "a b"), (None, "c"), (9, None), (8, "")])).collect()
    assert sorted((r[0] or 0, r[2] or 0, r[3]) for r in rows) == [(0, 0, False), (0, 4, False), (4, 4, True), (4, 4, True), (8, 8, True), (9, 8, False)]
    assert simhash_groups(frame(spark, [])).count() == 0


def test_spark_hashes_as_xxhash(spark):
    got = spark.createDataFrame([("abc",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"abc", 42)


# --- op10 ---


def items_for(docs, seed=2):
    rng = random.Random(seed)
    out = [(1, "one"), (2, None), (3, "..."), (4, "W1 w2, w3"), (None, "w1 w2"), (5, "naïve ünïcode ñ 漢字 naïve")]
    for i in range(10, 40):
        own = (docs[rng.choice(sorted(docs))] or "").split()
        at = rng.randrange(len(own) + 1)
        out.append((i, " ".join(own[at : at + rng.randrange(3, 30)]) + rng.choice(["", " more", "!"])))
    return [*out, out[-1], (39, "another text of item thirty nine with more than ten words in it")]


@pytest.mark.parametrize("block,window,shingle", [(1 << 20, 10, 5), (200, 10, 5), (1 << 20, 4, 5), (1 << 20, 6, 2)])
def test_contamination(spark, monkeypatch, block, window, shingle):
    from nearfield.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = awkward()
    items = items_for(docs)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, doc_id int")
    rows = contaminated_words(frame(spark, docs.items()), bench, window=window, shingle=shingle).collect()
    want = brute.contamination(docs, items, window)
    assert {r[0]: (r[1], r[2], r[3]) for r in rows} == want
    assert all(r["n_hit"] == sum(s["end"] - s["first"] for s in r["spans"]) for r in rows)


def test_contamination_of_documents_and_empty_tables(spark, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = brute.contamination(documents, items)
    rows = queries.op10_decontamination(spark, SF).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows} == {
        d: (n, h, len(i), brute.sha(",".join(i)), h > 0) for d, (n, h, i) in want.items()
    }
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = contaminated_words(frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), none).collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in rows) == [(0, 0, 0), (1, 2, 0), (1, 2, 0)]
    assert contaminated_words(frame(spark, []), none).count() == 0
