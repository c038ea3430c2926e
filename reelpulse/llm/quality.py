"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  A line's features are its own statistics and those of its neighbours; a
transition table couples the labels of adjacent lines.  Training takes the document's label for each of its
lines and climbs the exact conditional likelihood.  A document's quality is the mean of its lines' forward-
backward marginals of "good", weighted by line length.  Only the text enters the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text

#: Labelled documents that training takes at most (those with the smallest hashed ids).
MOST_LABELLED = 4000
STEPS, RATE, PENALTY = 240, 0.15, 1e-4
THRESHOLD = 0.5

_KINDS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)),
    "space": b" \t\r\x0b\x0c", "stop": b".,;:'\"()-?", "bang": b"!", "bar": b"|", "mark": b"#$%&*+/<=>@[\\]^_`{}~",
}
OWN = len(_KINDS) + 9
N_FEATURES = 3 * OWN + 1


def line_features(line: str) -> list[float]:
    """Statistics of one line, each about 0 to 1."""
    raw = line.encode("utf-8", "surrogatepass")
    n = len(raw)
    if n == 0:
        return [0.0] * (OWN - 1) + [1.0]
    words = line.split()
    k = max(1, len(words))
    shares = [(n - len(raw.translate(None, chars))) / n for chars in _KINDS.values()]
    letters = shares[0] + shares[1]
    distinct = len(set(words)) / k
    return [*shares, shares[0] / letters if letters else 0.0, max(0.0, 1.0 - sum(shares)), np.log1p(n) / 10,
            min(1.0, n / k / 20), distinct, sum(map(str.__eq__, words, words[1:])) / k,
            1.0 if raw[-1:] in b".!?" else 0.0, (1.0 - distinct) / np.log(k + 2), 0.0]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with those of its neighbours, line weights); a null text is one empty line."""
    lines = (text or "").split("\n")
    own = np.array([line_features(x) for x in lines], np.float32)
    none = np.zeros((1, OWN), np.float32)
    x = np.concatenate([own, np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none]),
                        np.ones((len(own), 1), np.float32)], 1)
    return x, np.array([len(line) + 1 for line in lines], np.float64)


@dataclass(frozen=True)
class LineField:
    """Weights of the features for "good" against "bad", and log weights of label pairs [before, after]."""

    weights: np.ndarray
    pairs: np.ndarray


class Chains:
    """Documents as chains of lines, laid out so that one step handles one position of all of them."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        starts = np.concatenate([[0], np.cumsum(sizes[np.argsort(self.order)])[:-1]])[self.order]
        self.starts, self.longest = starts, int(sizes[0]) if len(sizes) else 0
        self.alive = np.searchsorted(-sizes, -np.arange(1, self.longest + 1), "right")    # chains at least so long

    def marginals(self, score: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of "good" by line, expected counts of label pairs) for scores of "good" by line."""
        good = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        node = np.stack([1 - good, good], 1)
        move = np.exp(pairs - pairs.max())
        forward = np.empty_like(node)
        for t in range(self.longest):
            at = self.starts[:self.alive[t]] + t
            a = node[at] if t == 0 else (forward[at - 1] @ move) * node[at]
            forward[at] = a / a.sum(1, keepdims=True)
        backward, expected = np.ones_like(node), np.zeros((2, 2))
        for t in range(self.longest - 1, 0, -1):
            at = self.starts[:self.alive[t]] + t
            right = node[at] * backward[at]
            joint = forward[at - 1][:, :, None] * move[None] * right[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = right @ move.T
            backward[at - 1] = b / b.sum(1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(1), expected


def fit_lines(documents: list[tuple[np.ndarray, int]]) -> LineField:
    """Train on (features, label) of documents, by Adam on the mean log likelihood per document.

    Without both labels there is nothing to tell apart: no document at all gives even odds, otherwise the
    weights lean towards the only label seen.
    """
    weights, pairs = np.zeros(N_FEATURES), np.zeros((2, 2))
    if not documents:
        return LineField(weights, pairs)
    x = np.concatenate([d for d, _ in documents]).astype(np.float64)
    sizes = np.array([len(d) for d, _ in documents])
    label = np.repeat([y for _, y in documents], sizes)
    share = np.repeat(1 / sizes, sizes) / len(documents)      # every document counts alike
    seen = np.zeros((2, 2))
    for d, y in documents:
        seen[y, y] += len(d) - 1
    chains, per = Chains(sizes), max(1, len(label))
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights, pairs = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        p, expected = chains.marginals(x @ weights, pairs)
        slope = np.concatenate([x.T @ ((label - p) * share), ((seen - expected) / per).ravel()]) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return LineField(theta[:N_FEATURES].copy(), theta[N_FEATURES:].reshape(2, 2).copy())


def score_texts(model: LineField, texts: list[str | None]) -> list[float]:
    """Quality of each text, 0 to 1."""
    if not texts:
        return []
    found = [document_features(t) for t in texts]
    sizes = np.array([len(w) for _, w in found])
    score = np.concatenate([x @ model.weights for x, _ in found])
    p, _ = Chains(sizes).marginals(score, model.pairs)
    weight = np.concatenate([w for _, w in found])
    ends = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Rounded, so that a text's score does not depend on the texts it shares a batch with.
    return np.round(np.add.reduceat(p * weight, ends) / np.add.reduceat(weight, ends), 9).clip(0, 1).tolist()


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text is 1 modulo 3; rows without an id, too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> LineField:
    """Learn from at most ``most`` labelled documents outside the held-out fold.

    Null labels are skipped; a document with several labels counts as bad if any is 0; of several texts with
    one id the smallest by features is taken.
    """
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("_label"))
             .filter(F.col("_label").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("_label").alias("_label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")     # at most ``most`` rows

    def work():
        return lambda texts: [[document_features(t)[0].tobytes() for t in texts]]

    found = (map_text(rows, "text", work, [("features", "binary", pa.binary())])
             .groupBy("doc_id").agg(F.min(F.struct("features", "_label")).alias("one"))
             .select("doc_id", "one.*").orderBy("doc_id").collect())
    return fit_lines([(np.frombuffer(r["features"], np.float32).reshape(-1, N_FEATURES), min(1, max(0, r["_label"])))
                      for r in found])


def score(docs: DataFrame, model: LineField) -> DataFrame:
    """``docs`` with ``score``: the quality of every whole text; null and empty texts are one empty line."""
    weights, pairs = model.weights, model.pairs

    def work():
        own = LineField(weights, pairs)
        return lambda texts: [score_texts(own, texts)]

    return map_text(docs, "text", work, [("score", "double", pa.float64())])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is THRESHOLD or more, unchanged."""
    names = {c: "text" if c == "text" else f"_llm_{i}" for i, c in enumerate(docs.columns)}   # any name may be theirs
    held = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in names.items()))
    kept = score(held, fit(docs, labels)).filter(F.col("score") >= THRESHOLD)
    return kept.select(*(F.col(name).alias(c) for c, name in names.items()))
