"""The corpus pipeline, stage by stage, against plain versions."""

import random
from collections import defaultdict

import corpus_pipeline
from nearfield.llm import queries
from nearfield.llm.tokens import Encoder

from . import brute
from .test_jaccard import edited, similarity
from .test_operators import toxic_rows, words

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def kept_of_groups(texts):
    """The smallest id of each group that similarities of 0.8 or more over five-word shingles link."""
    ids = sorted(texts)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similarity(texts[a], texts[b]) >= 0.8]
    return {i for i, root in brute.roots(ids, pairs).items() if i == root}


def lines_kept(rows, sites=6, least=20):
    """rows: [(id, text, site)] -> {id: text without shared lines, but for each one's first}"""
    seen, first = defaultdict(set), {}
    for d, text, site in sorted(rows):
        for i, line in enumerate((text or "").split("\n") if text else []):
            line = line.strip(" \t\r")
            if len(line) >= least:
                seen[line].add(site or "")
                first.setdefault(line, (d, i))
    gone = lambda d, i, line: len(seen[line]) >= sites and first[line] != (d, i)
    return {d: text and "\n".join(x for i, x in enumerate(text.split("\n")) if not gone(d, i, x.strip(" \t\r"))) for d, text, _ in rows}


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = toxic_rows(160, seed=3)
    toxic = {i for i, y in labels if y}
    rows = [(i, t, f"s{i % 8}") for i, t in rows]
    long = {300 + i: words(rng, 150, 2000) for i in range(12)}
    rows += [(i, t + "\nAll rights are reserved by all of us.", f"s{i % 8}") for i, t in long.items()]
    rows += [(400 + i, t, "s1") for i, t in enumerate(list(long.values())[:4])]  # copies but for a line
    rows += [(410 + i, edited(rng, t, 1 + i % 5), "s4") for i, t in enumerate(long.values())]  # 0.7 to 0.95 alike
    item = words(rng, 14, 2000)
    rows += [(500, words(rng, 40, 2000) + " " + item, "s2"), (501, "", "s3"), (502, None, None), (503, " ".join(item.split()[:9]), "s2")]
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), 0
    states = []
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{at}")
        now, at = spark.read.parquet(f"{tmp_path}/{at}"), at + 1
        states.append(now)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    clean, lined, single, decontaminated = map(texts, states[:4])
    assert all(df.columns == docs.columns for df in states[:4])
    before = {i: t for i, t, _ in rows}
    assert len(toxic - set(clean)) >= 0.9 * len(toxic)
    assert set(before) - set(clean) <= toxic
    assert lined == lines_kept([r for r in rows if r[0] in clean]) and lined != {i: before[i] for i in lined}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in states[1].collect())
    assert set(single) == kept_of_groups(lined) and len(single) < len(lined)
    hits = brute.contamination(single, [(1, item)])
    assert set(decontaminated) == {i for i in single if not hits[i][1]} and 500 not in decontaminated and 503 in decontaminated
    encoder = Encoder(queries.vocabulary())
    rows = [tuple(r) for r in states[4].collect()]
    assert brute.packed_well(rows, decontaminated, lambda t: encoder.whole.encode(t, add_special_tokens=False).ids) < 0.2
    assert sorted(r[:5] for r in map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(r[:5] for r in rows)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, ids with several texts, a column of a clashing name, and no rows at all."""
    rng = random.Random(9)
    rows, labels = toxic_rows(160, seed=3)
    bad = next(t for (i, t), (_, y) in zip(rows, labels, strict=True) if y and t.count(" ") > 20)
    item, own = words(rng, 14, 2000), words(rng, 60, 2000)
    leak = words(rng, 30, 2000) + " " + item
    odd = [(None, bad), (900, bad), (900, "nice words about it"), (None, leak), (901, leak), (901, "more nice words"), (None, own), (950, own), (950, own),
           (None, None), (903, None), (None, None), (904, ""), (None, "a lone text without an id"), (None, "another text without an id")]
    docs = [(i, t, "en", f"s{n % 3}", None if t is None else len(t), "x", 0.5, 7) for n, (i, t) in enumerate([*rows, *odd])]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame(docs, KIND + ", row string, score double, id int")
    stages = dict(corpus_pipeline.STAGES)
    got = lambda name, df=df: [(r["doc_id"], r["text"]) for r in stages[name](spark, df, str(tmp_path)).collect()]
    clean = got("toxicity")
    assert (None, bad) not in clean and (900, bad) not in clean and (900, "nice words about it") in clean
    assert [r for r in odd if r[1] != bad] == [r for r in clean if r in odd]
    left = got("decontamination")
    assert (None, leak) not in left and (901, leak) not in left and (901, "more nice words") in left
    assert sorted(map(str, left)) == sorted(str(r) for r in [*rows, *odd] if r[1] != leak)
    assert sorted(map(str, got("line_dedup"))) == sorted(map(str, [*rows, *odd]))
    single = got("simhash_dedup", df.where("doc_id >= 900 OR doc_id IS NULL"))
    assert sorted(single, key=str) == sorted([(900, bad), (900, "nice words about it"), (901, leak), (901, "more nice words"), (950, own), (903, None),
        (None, "a lone text without an id"), (None, "another text without an id")], key=str)
    assert len(got_packed := stages["packing"](spark, df, str(tmp_path)).collect()) == len(docs) and {r["offset"] for r in got_packed} != {0}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df.where("doc_id = -1"), str(tmp_path))
        assert out.count() == 0 and (name == "packing" or tuple(out.columns) == corpus_pipeline.COLUMNS)
