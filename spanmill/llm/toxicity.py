"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic texts are the positives; any texts are the unlabelled ones. With the class prior p, the risk
p E+[loss(+)] + max(0, E_u[loss(-)] - p E+[loss(-)]) is minimised; where the second part falls
below zero on a mini-batch, the step goes against it, as in Kiryo et al. (2017). The model is linear
over the words of a text: each distinct word (runs of letters, lower case) counts once, as itself and as its
prefixes of 4, 5 and 6 letters. Features are 32-bit hashes; those take part whose share among positives exceeds
their share among unlabelled texts by ``LIFT`` and by more than chance allows for the number of features. As
all of these speak for toxicity, weights stay at 0 or above; the bias is free.

Training looks at no more than ``POSITIVES`` and ``UNLABELLED`` texts, chosen by a hash of the doc_id, all from
outside the held-out fold; features are made on the executors, so the driver gets hashes, not texts. The
prior is the toxic share of the labels outside the held-out fold. Scoring reads every whole text.

Defined results: null, empty and wordless texts score as the bias alone; without any positive label all
scores are 0; a null doc_id counts as held out; label rows without a document and repeated rows are
harmless; of rows that share a doc_id, the one with the smallest features is learned from, all are scored; very long texts
are read whole; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, table

POSITIVES = 4_000
UNLABELLED = 8_000
LEAST_DOCS = 3
LEAST_SHARE = 0.005
SKETCH = 4
SIGNIFICANCE = 2.0
LIFT = 2.0
PREFIXES = (4, 5, 6)
EPOCHS = 60
BATCHES = 8
RATE = 0.05
DECAY = 1e-5
SEED = 6
LEAST_WEIGHT = 0.02
LEAST_EVIDENCE = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def fold() -> F.Column:
    """0 for held-out documents."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5


def features(word: str) -> list[int]:
    raw = word.encode("utf-8", "surrogatepass")
    return [zlib.crc32(b"w" + raw), *(zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "surrogatepass")) for n in PREFIXES if len(word) >= n)]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def __post_init__(self):
        self.known = Memo()

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state, known=Memo())

    def word(self, word: str) -> float:
        s = self.known.again(word)
        if s is None:
            s = sum(self.weights.get(f, 0.0) for f in features(word))
            self.known.keep(word, s)
        return s

    def score(self, text: str | None) -> float:
        get = self.known.get
        own = words(text)
        total = self.bias
        for w in own:
            s = get(w)
            total += self.word(w) if s is None else s
        return float(1 / (1 + np.exp(-np.clip(round(total, 9), -50, 50))))


class _Rows:
    """Documents as rows of feature positions, all in one array."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1])) if len(rows) else np.empty(0, np.int64)
        self.flat = np.concatenate(rows) if rows else np.empty(0, np.int64)

    def take(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, and the document (0, 1, ..) of each."""
        size = self.size[docs]
        at = np.repeat(self.start[docs] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return self.flat[at], np.repeat(np.arange(len(docs)), size)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """A model from feature hashes (uint32, with repeats) of positive and unlabelled texts."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model({}, -50.0)
    # near copies have the same smallest hashes: one of them stays, or their common words would look like evidence
    positive = list({tuple(np.unique(x)[:SKETCH].tolist()): x for x in positive}.values())
    names, docs = np.unique(np.concatenate([np.unique(x) for x in positive]), return_counts=True)
    often = docs >= max(LEAST_DOCS, LEAST_SHARE * len(positive))
    names, docs = names[often], docs[often]
    base, seen = np.unique(np.concatenate([np.unique(x) for x in unlabelled]), return_counts=True)
    at = np.minimum(np.searchsorted(base, names), max(0, len(base) - 1))
    known = np.where(base[at] == names, seen[at], 0) if len(base) else np.zeros(len(names), np.int64)
    expected = len(positive) * (known + 0.5) / len(unlabelled)
    excess = (docs - expected) / np.sqrt(expected * (1 + len(positive) / len(unlabelled)))
    strong = (excess >= np.sqrt(SIGNIFICANCE * np.log(len(base) + 2))) & (docs >= LIFT * expected)
    names, lift = names[strong], docs[strong] / expected[strong]

    def places(x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(names, x)
        at[at == len(names)] = 0
        return at[names[at] == x] if len(names) else at[:0]

    p, u = _Rows([places(x) for x in positive]), _Rows([places(x) for x in unlabelled])
    n = len(names)
    w, mean, var, step = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0
    w[:n], w[n] = np.log(lift) / 2, np.log(prior / (1 - prior))  # a word's own feature and its prefixes share what they say
    rng = np.random.default_rng(SEED)
    batches = min(BATCHES, len(positive), len(unlabelled))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    loss = lambda z: np.logaddexp(0, z)
    for _ in range(EPOCHS):
        for pd, ud in zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches), strict=True):
            (pf, pr), (uf, ur) = p.take(pd), u.take(ud)
            zp = np.bincount(pr, w[pf], len(pd)) + w[n]
            zu = np.bincount(ur, w[uf], len(ud)) + w[n]
            below = loss(zu).mean() - prior * loss(zp).mean()
            gu = sigmoid(zu) / len(ud)  # of E_u[loss(-)]
            gp = prior * sigmoid(zp) / len(pd)  # of p E+[loss(-)]
            if below >= 0:
                dp, du = -prior * sigmoid(-zp) / len(pd) - gp, gu
            else:
                dp, du = gp, -gu
            g = np.bincount(pf, dp[pr], n + 1).astype(float) + np.bincount(uf, du[ur], n + 1)
            g[n] = dp.sum() + du.sum()
            g[:n] += DECAY * w[:n]
            step += 1
            mean = 0.9 * mean + 0.1 * g
            var = 0.999 * var + 0.001 * g * g
            w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
            w[:n] = np.maximum(w[:n], 0)
    # 0.5 goes where the prior's share of unlabelled texts lies above, but stays above texts without evidence
    everyone, row = u.take(np.arange(len(unlabelled)))
    cut = np.quantile(np.bincount(row, w[everyone], len(unlabelled)) + w[n], 1 - prior)
    w[n] -= min(0.0, max(float(cut) - 1e-6, w[n] + LEAST_EVIDENCE))
    keep = np.abs(w[:n]) >= LEAST_WEIGHT
    return Model(dict(zip(names[keep].tolist(), w[:n][keep].tolist(), strict=True)), float(w[n]))


def train(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from ``docs`` and ``labels`` (doc_id, toxic), without the held-out fold."""
    order = F.xxhash64("doc_id", F.lit(SEED))
    known = labels.where(fold() != 0).where("toxic is not null")
    prior = known.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0]
    if not prior:
        return Model({}, -50.0)
    pick = lambda x, n, name: x.select("doc_id").distinct().orderBy(order, "doc_id").limit(n).withColumn("kind", F.lit(name))
    ids = pick(known.where("toxic = 1").join(docs.select("doc_id"), "doc_id", "left_semi"), positives, 1).unionByName(pick(docs.where("doc_id is not null").where(fold() != 0), unlabelled, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.array([f for w in sorted(words(t.as_py())) for f in features(w)], "<u4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["doc_id", "kind", "found"])

    # ids: at most positives + unlabelled rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "kind", "text")
    # one row for each of these ids, however many rows share it
    found = rows.mapInArrow(run, "doc_id long, kind int, found binary").groupBy("doc_id", "kind").agg(F.min("found").alias("found"))
    got = found.toArrow().sort_by([("doc_id", "ascending"), ("kind", "ascending")])
    kinds, found = got["kind"].to_pylist(), [np.frombuffer(x.as_py(), "<u4") for x in got["found"]]
    return fit([x for k, x in zip(kinds, found, strict=True) if k], [x for k, x in zip(kinds, found, strict=True) if not k], prior)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted (replaced where present)."""
    scored = docs.withColumn("score", _score_udf(model)(F.col("text").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _score_udf(model: Model):
    import pandas as pd

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([model.score(x) for x in t], dtype="float64")

    of.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(of, "double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the model predicts to be toxic."""
    return docs.where(_score_udf(train(docs, labels))(F.col("text").cast("string")) < 0.5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")
