"""Near-duplicates by exact Jaccard similarity against comparing all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from nearfield.llm import jaccard

from . import brute
from .test_operators import words

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingled(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def near_copies(rng):
    """Texts with copies of 0.7 to 1, short texts, a family of near copies and a common passage."""
    texts = [words(rng, 120, 2000) for _ in range(60)]
    texts += [edited(rng, t, n) for t in texts for n in rng.sample(range(1, 6), 2)]
    one, passage = words(rng, 80, 2000), words(rng, 60, 2000)
    texts += [edited(rng, one, rng.randrange(1, 4)) for _ in range(60)]
    texts += [passage + " " + words(rng, 15 + i, 2000) for i in range(30)]
    texts += ["a b c", "A  b c", "a b d", "a b c d e", "a b c d e f", "", " ", None]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small,common", [(0, 0), (0, 5), (24, 24), (10**6, 24)])
def test_group_links_are_those_of_all_pairs(monkeypatch, small, common):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "COMMON", common)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 90).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(60, 91), replace=False), rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(70)]
    label = rng.integers(0, 50, 70)
    links = [(i, j) for i in range(70) for j in range(i + 1, 70) if label[i] != label[j] and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]
    assert 20 < len(links) < 2000
    found = list(zip(*(x.tolist() for x in jaccard.group_links(sets, label, 0.8)), strict=True))
    assert brute.roots(range(70), found) == brute.roots(range(70), links)


def test_pairs_of_0_8_meet_in_a_band():
    rng = np.random.default_rng(2)
    minima, met = jaccard._Minima(), {0.8: [], 0.3: []}
    for s in met:
        for _ in range(400):
            both, n = rng.integers(0, 2**63, 160).astype(np.uint64), round(160 / s) - 160
            a, b = (np.concatenate([both, rng.integers(0, 2**63, k).astype(np.uint64)]) for k in (n // 2, n - n // 2))
            met[s].append((minima.bands(a) == minima.bands(b)).any())
    assert np.mean(met[0.8]) > 0.98 and np.mean(met[0.3]) < 0.2


@pytest.mark.parametrize("slice", [8, 512])
def test_near_duplicates_from_0_8_on(spark, monkeypatch, slice):
    monkeypatch.setattr(jaccard, "SLICE", slice)
    texts = near_copies(random.Random(6))
    n = len(texts)
    alike = {(i, j): similarity(texts[i], texts[j]) for i in range(n) for j in range(i + 1, n)}
    assert sum(0.8 <= s < 0.95 for s in alike.values()) > 50 and sum(0.7 < s < 0.8 for s in alike.values()) > 20
    want = brute.roots(range(n), [p for p, s in alike.items() if s >= 0.8])
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], KIND)
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    assert kept == {i for i, root in want.items() if i == root}
    assert corpus_pipeline.simhash_dedup(spark, docs.where("doc_id < 0"), "").count() == 0
