"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. A byte is embedded by its value
and by whether it ends four bytes that also stand up to 24 bytes before it, since sums over a window
can't tell that two places are equal. In each chunk learned filters over windows of 8 bytes (every 4
bytes) are max-pooled; a document's chunks are combined by their mean and their maximum, and a small
dense layer makes one probability of that.

It is trained on the driver on at most SAMPLE labelled rows of each class with at most SAMPLE_BYTES of
text each, so on 75 MiB at most (whole texts, those with the smallest hashes of their ids), weighted back
to the classes' shares of all labelled rows. Rows with crc32(doc_id) mod 5 = 0 are never learned from. Labels, lang, source
and doc_id are no inputs of a score.

Defined cases: null and empty texts are scored as one blank chunk; several labels of one id count as
the smallest; without labels of both classes every score is the share of label 1 (0.5 without any);
texts of any length are scored whole; a score equal to the threshold is label 1; repeated rows give
repeated rows; an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE, SAMPLE_BYTES = 1200, 1 << 15
FOLDS, THRESHOLD = 5, 0.3
CHUNK, OVERLAP = 256, 32
BLOCK, DIM, FILTERS, HIDDEN = 4, 8, 24, 16
RUN, LAGS = 4, range(2, 25)
EPOCHS, BATCH, RATE = 8, 32, 4e-3
_AT_ONCE = 1024  # chunks


def chunks(text: bytes) -> np.ndarray:
    """Overlapping chunks over the whole text; the last one ends where the text ends."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= CHUNK:
        out = np.zeros((1, CHUNK), np.uint8)
        out[0, : len(data)] = data
        return out
    starts = np.append(np.arange(0, len(data) - CHUNK, CHUNK - OVERLAP), len(data) - CHUNK)
    return data[starts[:, None] + np.arange(CHUNK)]


def coded(x: np.ndarray) -> np.ndarray:
    """The bytes of chunks, 256 more where RUN bytes end that stand one of LAGS earlier too; 0 pads."""
    again = np.zeros(x.shape, bool)
    for lag in LAGS:
        same = x[:, lag:] == x[:, :-lag]
        run = same[:, RUN - 1 :].copy()
        for k in range(RUN - 1):
            run &= same[:, k : k - RUN + 1]
        again[:, lag + RUN - 1 :] |= run
    return np.where(again & (x > 0), x + np.uint16(256), x)


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        init = lambda *shape: (r.standard_normal(shape) * (2 / shape[0]) ** 0.5).astype(np.float32)
        self.p = {"emb": init(512, DIM) * 4, "conv": init(BLOCK * DIM, 2 * FILTERS), "cb": np.zeros(FILTERS, np.float32), "w1": init(2 * FILTERS, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": init(HIDDEN, 1), "b2": np.zeros(1, np.float32)}
        self.p["emb"][0] = 0  # byte 0 pads

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each filter's largest activation in each chunk, its window, and the embedded blocks."""
        n, blocks = len(x), CHUNK // BLOCK
        e = self.p["emb"][x].reshape(n * blocks, BLOCK * DIM)
        a = (e @ self.p["conv"]).reshape(n, blocks, 2 * FILTERS)
        act = a[:, :-1, :FILTERS] + a[:, 1:, FILTERS:]
        win = act.argmax(1)
        top = np.take_along_axis(act, win[:, None], 1)[:, 0] + self.p["cb"]
        return np.maximum(top, 0), win, e

    def head(self, pooled: np.ndarray, bounds: np.ndarray):
        """Logits of documents whose chunks stand between ``bounds``."""
        mean = np.add.reduceat(pooled, bounds[:-1]) / np.diff(bounds)[:, None]
        v = np.concatenate([mean, np.maximum.reduceat(pooled, bounds[:-1])], 1)
        h = np.maximum(v @ self.p["w1"] + self.p["b1"], 0)
        return (h @ self.p["w2"] + self.p["b2"])[:, 0], v, h

    def scores(self, texts: list[bytes]) -> np.ndarray:
        parts = [chunks(t) for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(c) for c in parts])))
        x = np.concatenate(parts)
        pooled = np.concatenate([self.pooled(coded(x[k : k + _AT_ONCE]))[0] for k in range(0, len(x), _AT_ONCE)])
        return 1 / (1 + np.exp(-np.clip(self.head(pooled, bounds)[0].astype(float), -30, 30)))

    def gradients(self, parts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        bounds = np.concatenate(([0], np.cumsum([len(c) for c in parts])))
        x, blocks = np.concatenate(parts), CHUNK // BLOCK
        pooled, win, e = self.pooled(x)
        logit, v, h = self.head(pooled, bounds)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / weight.sum()).astype(np.float32)[:, None]
        g = {"w2": h.T @ d, "b2": d.sum(0)}
        dh = (d @ self.p["w2"].T) * (h > 0)
        g |= {"w1": v.T @ dh, "b1": dh.sum(0)}
        dv, size = dh @ self.p["w1"].T, np.diff(bounds)
        of = np.repeat(np.arange(len(parts)), size)
        top = v[:, FILTERS:]
        dp = (dv[:, :FILTERS] / size[:, None])[of] + dv[:, FILTERS:][of] * (pooled == top[of])
        dp *= pooled > 0
        g["cb"] = dp.sum(0)
        rows = np.arange(len(x))[:, None] * blocks + win
        g["conv"], de = np.zeros_like(self.p["conv"]), np.zeros_like(e)
        for f in range(FILTERS):
            for side, at in ((f, rows[:, f]), (f + FILTERS, rows[:, f] + 1)):
                g["conv"][:, side] = dp[:, f] @ e[at]
                de[at] += dp[:, f, None] * self.p["conv"][:, side]
        used = np.unique(np.concatenate([rows.ravel(), rows.ravel() + 1]))
        ids, de = x.reshape(-1, BLOCK)[used].ravel(), de[used].reshape(-1, DIM)
        g["emb"] = np.stack([np.bincount(ids, de[:, k], 512) for k in range(DIM)], 1).astype(np.float32)
        g["emb"][0] = 0
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, seed: int = 5) -> Network:
        """Adam over small batches, its rate falling to zero."""
        parts, r = [coded(chunks(t)) for t in texts], np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s, step, steps = {k: np.zeros_like(v) for k, v in self.p.items()}, 0, EPOCHS * -(-len(parts) // BATCH)
        for _ in range(EPOCHS):
            order = r.permutation(len(parts))
            for at in range(0, len(order), BATCH):
                own, step = order[at : at + BATCH], step + 1
                for k, g in self.gradients([parts[i] for i in own], y[own], weight[own]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.p[k] -= RATE * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Network | float:
    """A network, or the share of label 1 where there is nothing to tell apart."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = C.materialize(known, "labels")
    shares = {r["quality"]: r["count"] for r in known.filter("quality in (0, 1)").groupBy("quality").count().collect()}
    if len(shares) < 2:
        return float(next(iter(shares), 0.5))
    texts = docs.select("doc_id", C.text_of().cast("binary").alias("text")).filter(F.length("text") <= SAMPLE_BYTES)
    picked = known.filter("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).unionByName(known.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    rows = texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(2 * SAMPLE).collect()
    y = np.array([r["quality"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return shares[1] / sum(shares.values())
    weight = np.array([shares[int(q)] / max(1, (y == q).sum()) for q in y], np.float32)
    return Network().fit([bytes(r["text"]) for r in rows], y, weight)


def score(docs: DataFrame, network: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    if isinstance(network, Network):

        @F.pandas_udf("double")
        def of(texts: pd.Series) -> pd.Series:
            return pd.Series(np.concatenate([network.scores([bytes(t) for t in texts.iloc[k : k + 64]]) for k in range(0, len(texts), 64)] or [np.empty(0)]))

        value = of(C.text_of().cast("binary"))
    else:
        value = F.lit(float(network))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score(docs, train(docs, C.table(spark, sf_dir, "labels")))
