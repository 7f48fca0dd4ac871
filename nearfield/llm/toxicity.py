"""Toxic spans by a linear-chain conditional random field over tokens.

Labels are of documents, so tokens are labelled by distant supervision: a token of a toxic
document is toxic if one of its features (its word, its beginnings) occurs in far more toxic than
other documents, beyond chance. The field has two states, feature weights, a bias and transitions.

Tokens without known features all have the same potential, so the chain over a run of them is a
power of one 2x2 matrix. Chains therefore consist of the known tokens alone, whatever a text's
length, and forward-backward runs over them as prefix and suffix products by doubling. Executors
count features and cut the labelled texts into such chains; the driver maximises the conditional
likelihood of the chains' labels by L-BFGS until the gradient is small.

A document's score is a logistic function of its tokens' marginals (the largest, and their sum);
its offending spans are the tokens of marginal 0.5 or more.
"""

from __future__ import annotations

import re
import string
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SLICE_BYTES, carrying, dropped, only, received, sent, slices, staged

#: Tokens whose weight a worker keeps.
CACHED_TOKENS = 200_000
_STRIP = string.punctuation + "¡¿«»“”„’‘…–—"
_BEGINNINGS = (3, 4, 5, 6)


def features(token: str) -> list[str]:
    """The word and its beginnings, without outer punctuation, in lower case."""
    word = token.strip(_STRIP).lower()
    return [f"={word}", *(word[:k] for k in _BEGINNINGS if len(word) > k)] if word else []


@dataclass
class Chains:
    """Known tokens of texts, one text after the other: their places; known tokens and tokens of each text."""

    at: np.ndarray
    counts: np.ndarray
    length: np.ndarray

    def __post_init__(self):
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.base = np.cumsum(self.counts) - self.counts
        self.nth = np.arange(len(self.at)) - self.base[self.text]
        self.first, self.last = self.nth == 0, self.nth == self.counts[self.text] - 1
        self.some = self.counts > 0
        #: Unknown tokens before each known one, but for the text's first token; after each text's last.
        self.gap = self.at - np.where(self.first, 1, np.concatenate([[0], self.at[:-1] + 1]))
        self.tail = self.length - 1
        self.tail[self.some] -= self.at[self.last]


def _products(m: np.ndarray, nth: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of 2x2 matrices from their text's first up to each, by doubling; and their log scales."""
    m, scale, step = m.copy(), np.zeros(len(m)), 1
    while step < least:
        on = np.flatnonzero(nth >= step)
        both = m[on - step] @ m[on]
        size = both.max((1, 2))
        scale[on] = scale[on - step] + scale[on] + np.log(size)
        m[on] = both / size[:, None, None]
        step *= 2
    return m, scale


def chain_sums(bias: float, transitions: np.ndarray, lift: np.ndarray, chains: Chains) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Marginals of state 1 at the known tokens; log partition; expected tokens in state 1; expected transitions.

    lift: what a known token's features add to the bias. The sums are over all texts and all their tokens.
    """
    a = np.exp(transitions)
    own = np.array([1.0, np.exp(bias)])
    g = a * own
    trace, root = g[0, 0] + g[1, 1], np.sqrt((g[0, 0] - g[1, 1]) ** 2 + 4 * g[0, 1] * g[1, 0])
    high, low = (trace + root) / 2, (trace - root) / 2
    p1, p2, q = (g - low * np.eye(2)) / root, (high * np.eye(2) - g) / root, low / high

    def power(k):  # of g, over that of its larger eigenvalue
        return p1 + np.power(q, np.maximum(k, 0))[:, None, None] * p2

    c = chains
    factor = np.stack([np.ones_like(lift), np.exp(np.clip(bias + lift, -50, 50))], axis=1)
    start = np.where(c.first & (c.at == 0), True, False)
    into = power(c.gap) @ a
    into[c.first] = (own @ into[c.first])[:, None, :]  # both rows: what the first known token meets
    into[start] = 1.0
    most = int(c.counts.max(initial=0))
    forward, log_forward = _products(into * factor[:, None, :], c.nth, most)
    forward = forward[:, 0]
    # suffix products: the same over reversed and transposed matrices
    back, _ = _products((into * factor[:, None, :])[::-1].transpose(0, 2, 1), (c.counts[c.text] - 1 - c.nth)[::-1], most)
    ends = power(c.tail) @ np.ones(2)
    backward = np.empty((len(lift), 2))
    inner = np.flatnonzero(~c.last)
    suffix = back[::-1].transpose(0, 2, 1)
    backward[inner] = np.einsum("nij,nj->ni", suffix[inner + 1], ends[c.text[inner]])
    backward[c.last] = ends[c.some]
    backward /= np.maximum(backward.sum(1, keepdims=True), 1e-300)
    both = forward * backward
    p = both[:, 1] / np.maximum(both.sum(1), 1e-300)

    alone = ~c.some & (c.length > 0)
    z = np.einsum("ni,ni->n", forward[c.last], ends[c.some])
    log_z = float(np.log(z).sum() + log_forward[c.last].sum() + np.log(ends[alone] @ own).sum())
    log_z += np.log(high) * float(np.maximum(c.gap, 0).sum() + np.maximum(c.tail[c.some | alone], 0).sum())

    # a run of unknown tokens: what comes from its left, its number of steps, what comes from its right
    begin = np.empty((len(lift), 2))
    begin[~c.first] = forward[np.flatnonzero(~c.first) - 1]
    begin[c.first] = own
    ahead = factor * backward
    after = ahead @ a.T
    left = np.concatenate([begin[~start], forward[c.last], np.broadcast_to(own, (int(alone.sum()), 2))])
    right = np.concatenate([after[~start], np.ones((int(c.some.sum() + alone.sum()), 2))])
    k = np.concatenate([c.gap[~start], c.tail[c.some], c.tail[alone]]).astype(float)
    qk = np.power(q, k)
    l1, l2, r1, r2 = left @ p1, left @ p2, right @ p1.T, right @ p2.T
    total = np.einsum("ni,ni->n", l1 + qk[:, None] * l2, right)
    mixed = (1 - qk) / (1 - q)
    same2 = np.where(k > 0, k * np.power(q, np.maximum(k - 1, 0)), 0.0)
    inside = sum(np.einsum("n,ns,nr->sr", w / total, x, y) for w, x, y in ((k, l1, r1), (same2, l2, r2), (mixed, l1, r2), (mixed, l2, r1)))
    steps = g / high * inside
    ones = float(p.sum()) + steps[:, 1].sum()
    first = np.concatenate([c.first[~start], np.zeros(int(c.some.sum()), bool), np.ones(int(alone.sum()), bool)])  # runs that hold token 0
    reached = own * (r1[first] + qk[first, None] * r2[first])
    ones += float((reached[:, 1] / reached.sum(1)).sum())
    meet = ~start
    come = l1[: int(meet.sum())] + qk[: int(meet.sum()), None] * l2[: int(meet.sum())]
    pair = come[:, :, None] * a * ahead[meet][:, None, :]
    steps = steps + (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    return p, log_z, ones, steps


@dataclass
class Field:
    """weights of features; bias of state 1; log transitions; logistic weights (constant, max, log1p sum)."""

    weights: dict[str, float]
    bias: float
    transitions: np.ndarray
    logistic: np.ndarray

    def weight(self, token: str) -> float:
        """0 if no feature is known."""
        return sum(self.weights.get(f, 0.0) for f in features(token))

    def marginals(self, lift: np.ndarray, chains: Chains) -> np.ndarray:
        """Probability of state 1 at the known tokens."""
        return chain_sums(self.bias, self.transitions, lift, chains)[0]

    def score(self, marginals: np.ndarray, chains: Chains) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(aggregated(marginals, chains) @ self.logistic, -30, 30)))


def aggregated(marginals: np.ndarray, chains: Chains) -> np.ndarray:
    most = np.zeros(len(chains.counts))
    np.maximum.at(most, chains.text, marginals)
    return np.stack([np.ones(len(most)), most, np.log1p(np.bincount(chains.text, marginals, minlength=len(most)))], axis=1)


@dataclass
class Labelled:
    """Chains with each known token's features (row: known token, feature) and label."""

    chains: Chains
    token: np.ndarray
    feature: np.ndarray
    gold: np.ndarray
    n_features: int

    def gold_transitions(self) -> np.ndarray:
        c, on = self.chains, self.gold == 1
        after = np.zeros(len(on), bool)  # the token before is known and of state 1
        after[1:] = on[:-1] & ~c.first[1:] & (c.at[1:] == c.at[:-1] + 1)
        n11 = int((on & after).sum())
        n01 = int((on & ~after & (c.at > 0)).sum())
        n10 = int((on & (c.at < c.length[c.text] - 1)).sum()) - n11
        return np.array([[np.maximum(c.length - 1, 0).sum() - n11 - n01 - n10, n01], [n10, n11]], float)


def likelihood(parameters: np.ndarray, data: Labelled, ridge: float = 0.1) -> tuple[float, np.ndarray]:
    """Penalised conditional log likelihood of the labels, and its gradient.

    parameters: feature weights, bias, the four transitions (from 0 to 0, 0 to 1, 1 to 0, 1 to 1).
    """
    k = data.n_features
    weights, bias, transitions = parameters[:k], parameters[k], parameters[k + 1 :].reshape(2, 2)
    lift = np.bincount(data.token, weights[data.feature], minlength=len(data.gold))
    p, log_z, ones, steps = chain_sums(bias, transitions, lift, data.chains)
    real = data.gold_transitions()
    value = float(data.gold @ (lift + bias) + (real * transitions).sum() - log_z)
    gradient = np.concatenate([
        np.bincount(data.feature, (data.gold - p)[data.token], minlength=k), [data.gold.sum() - ones], (real - steps).ravel()
    ])
    return value - ridge / 2 * float(parameters @ parameters), gradient - ridge * parameters


def maximum(value_and_gradient, x: np.ndarray, small: float, most_steps: int = 500, memory: int = 10) -> np.ndarray:
    """A maximum of a smooth concave function by L-BFGS: no component of the gradient is over `small`."""
    value, gradient = value_and_gradient(x)
    past: deque = deque(maxlen=memory)
    for _ in range(most_steps):
        if np.abs(gradient).max() <= small:
            return x
        way, used = gradient.copy(), []
        for s, y, r in reversed(past):
            used.append(r * (s @ way))
            way -= used[-1] * y
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / np.abs(gradient).max()
        for (s, y, r), u in zip(past, reversed(used), strict=True):
            way += s * (u - r * (y @ way))
        rise, size = float(gradient @ way), 1.0
        while True:
            new, new_gradient = value_and_gradient(x + size * way)
            if np.isfinite(new) and new >= value + 1e-4 * size * rise:
                break
            size /= 2
            if size < 1e-12:  # no rise that numbers can tell
                return x
        s, y = size * way, gradient - new_gradient
        if s @ y > 1e-12 * (y @ y):
            past.append((s, y, 1 / (s @ y)))
        x, value, gradient = x + s, new, new_gradient
    raise RuntimeError(f"the field's fit did not settle in {most_steps} steps")


def fit_field(names: list[str], data: Labelled, toxic: np.ndarray, prior: float) -> Field:
    """Fits weights of the named features; toxic: labels of the texts; prior: share of toxic ones where they come from."""
    field = Field({}, -6.0, np.log(np.array([[0.95, 0.05], [0.5, 0.5]])), _constant(prior))
    k, tokens = len(names), int(data.chains.length.sum())
    if not k or not tokens:
        return field
    x = np.concatenate([np.full(k, 2.0), [np.log((data.gold.sum() + 1) / (tokens + 1))], np.zeros(4)])
    x = maximum(lambda v: likelihood(v, data), x, small=max(0.01, 1e-6 * tokens))
    field.weights, field.bias, field.transitions = dict(zip(names, x[:k].tolist(), strict=True)), float(x[k]), x[k + 1 :].reshape(2, 2)
    p = field.marginals(np.bincount(data.token, x[data.feature], minlength=len(data.gold)), data.chains)
    field.logistic = _logistic(aggregated(p, data.chains), toxic, prior, field.logistic)
    return field


def _constant(prior: float) -> np.ndarray:
    return np.array([np.log((prior + 1e-6) / (1 - prior + 1e-6)), 0.0, 0.0])


def _logistic(x: np.ndarray, toxic: np.ndarray, prior: float, w: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; classes weighted to the prior."""
    share = toxic.mean()
    importance = np.where(toxic, prior / share, (1 - prior) / (1 - share))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (importance * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.02, 0.02])
        step = np.linalg.solve(hessian, x.T @ (importance * (toxic - p)) - np.array([0, 0.02, 0.02]) * w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def telling_features(texts: DataFrame, n: dict[int, int], least_odds: float, least_z: float, least_texts: int) -> dict[str, float]:
    """Log odds of features found in at least least_texts toxic texts, with log odds of at least
    least_odds and rates in the two classes at least least_z standard errors apart.

    texts: text, toxic; n: texts of each class.
    """

    def run(batches):
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update({f for w in set(text.split()) for f in features(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in seen)], ["feature", "k0", "k1"])

    counted = texts.select("text", "toxic").mapInArrow(run, "feature string, k0 bigint, k1 bigint").groupBy("feature").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
    k0, k1 = F.col("k0"), F.col("k1")
    pooled = (k0 + k1) / (n[0] + n[1])
    z = (k1 / n[1] - k0 / n[0]) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n[0] + 1 / n[1]))
    odds = F.log((k1 + 0.5) / (n[1] + 1)) - F.log((k0 + 0.5) / (n[0] + 1))
    found = counted.where(k1 >= least_texts).select("feature", odds.alias("odds"), z.alias("z")).where((F.col("odds") >= least_odds) & (F.col("z") >= least_z))
    return {r["feature"]: r["odds"] for r in found.collect()}


def labelled_chains(texts: DataFrame, odds: dict[str, float], strong: float) -> tuple[list[str], Labelled, np.ndarray]:
    """(features, chains of the texts with labelled tokens, labels of the texts).

    texts: text, toxic, place (their order here, so that a fit can be repeated). A token of a toxic
    text is labelled toxic if a feature's log odds are at least `strong`.
    """
    names = sorted(odds)
    known = sent(texts.sparkSession, ({f: i for i, f in enumerate(names)}, [odds[f] >= strong for f in names]))

    def run(batches):
        number, is_strong = received(known)
        for batch in batches:
            rows = []
            for text, toxic, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, at, own, gold = text.split(), [], [], []
                met = {w: fs for w in set(tokens) if (fs := [number[f] for f in features(w) if f in number])}
                for i, w in enumerate(tokens):
                    if w in met:
                        at.append(i)
                        own.append(met[w])
                        gold.append(int(toxic == 1 and any(is_strong[f] for f in met[w])))
                rows.append((place, toxic, len(tokens), at, gold, list(map(len, own)), [f for fs in own for f in fs]))
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["place", "toxic", "length", "at", "gold", "n", "features"])

    kind = "place bigint, toxic int, length bigint, at array<bigint>, gold array<bigint>, n array<bigint>, features array<bigint>"
    table = texts.select("text", "toxic", "place").mapInArrow(run, kind).toArrow().combine_chunks()
    order = np.argsort(table["place"].to_numpy(), kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    flat = {c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "gold", "n", "features")}
    counts = np.array([len(x) for x in table["at"].to_pylist()], np.int64)
    chains = Chains(flat["at"], counts, table["length"].to_numpy().astype(np.int64))
    data = Labelled(chains, np.repeat(np.arange(len(flat["at"])), flat["n"]), flat["features"], flat["gold"].astype(float), len(names))
    return names, data, table["toxic"].to_numpy() == 1


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id's text, mod 5; rows of fold 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    label_id_col: str = "doc_id",
    most_rows: int = 2000,
    least_odds: float = 1.5,
    least_z: float = 3.5,
    least_texts: int = 4,
) -> Field:
    """Fits a field on at most most_rows labelled documents of each class, none of fold 0.

    They are those of smallest id hash, whatever the input's size, and are read whole, however long:
    executors count their features and cut them into chains, so that the driver gets the features
    that tell the classes apart and the tokens that have one. Rows with null ids, labels or texts
    are not used; rows equal in id and text count once. Without both classes every score is the
    share of toxic labels (a half where there are none).
    """
    marks = only(labels, doc_id=(label_id_col, "bigint"), toxic=(label_col, "int")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marks = marks.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [marks.where(F.col("toxic") == c).orderBy(*order).limit(most_rows) for c in (0, 1)]
    source = only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string")).where("text IS NOT NULL")
    texts = staged(source.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").dropDuplicates(["doc_id", "text"]).select("text", "toxic", F.xxhash64("doc_id", "text").alias("place")), "labelled")
    n = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not all(n.values()):
        return Field({}, -6.0, np.log(np.array([[0.95, 0.05], [0.5, 0.5]])), _constant(prior))
    odds = telling_features(texts, n, least_odds, least_z, least_texts)
    names, data, toxic = labelled_chains(texts, odds, least_odds + 0.5)
    dropped(texts)
    return fit_field(names, data, toxic, prior)


def score_toxicity(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, spans, and carried columns of docs) of each whole text; nothing but the text is looked at.

    spans: structs of first character, end and probability of tokens more likely toxic than not.
    Null and empty texts get the score of a text without known tokens. Repeated rows give repeated
    rows, null ids stay null.
    """
    known_field = sent(docs.sparkSession, field)
    span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
    spaced = re.compile(r"\S+")

    def run(batches):
        field = received(known_field)
        known: dict[str, float] = {}

        def weight(token):
            w = known.get(token)
            if w is None:
                w = field.weight(token)
                if len(known) < CACHED_TOKENS:
                    known[token] = w
            return w

        for batch in batches:
            scores, spans = [], []
            for _, _, data, ends in slices(batch.column(1), SLICE_BYTES):
                data, begin, texts, at, lift, length = data.tobytes(), 0, [], [], [], []
                for end in ends.tolist():
                    text = data[begin:end].decode("utf-8", "replace")
                    begin = end
                    tokens = text.split()
                    w = np.fromiter(map(weight, tokens), np.float64, len(tokens))
                    at.append(np.flatnonzero(w))
                    lift.append(w[at[-1]])
                    length.append(len(tokens))
                    texts.append(text if len(at[-1]) else "")
                counts = np.array(list(map(len, at)), np.int64)
                chains = Chains(np.concatenate(at), counts, np.array(length, np.int64))
                p = field.marginals(np.concatenate(lift), chains)
                scores.append(field.score(p, chains))
                for text, own, q in zip(texts, at, np.split(p, np.cumsum(counts)[:-1]), strict=True):
                    bad = q >= 0.5
                    if not bad.any():
                        spans.append([])
                        continue
                    wanted = dict(zip(own[bad].tolist(), q[bad].tolist(), strict=True))
                    spans.append([{"first": m.start(), "end": m.end(), "p": wanted[i]} for i, m in enumerate(spaced.finditer(text)) if i in wanted])
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, pa.list_(span)), *batch.columns[2:]], names)

    made = T.StructType.fromDDL("doc_id bigint, score double, spans array<struct<first:bigint,end:bigint,p:double>>")
    kind = T.StructType([*made, *carrying(docs, carried, tuple(made.names))])
    names = kind.names
    source = {"doc_id": F.col(f"`{id_col}`").cast("bigint"), "text": F.col(f"`{text_col}`").cast("string")}
    source |= {f"carried_{i}": F.col(f"`{c}`") for i, c in enumerate(carried)}
    return docs.select(*(c.alias(n) for n, c in source.items())).mapInArrow(run, kind)
