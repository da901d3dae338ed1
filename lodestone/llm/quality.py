"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its words hashed into HASH_DIMS slots (weight 1 + ln tf, scaled to length 1), STATS structure
statistics of its text and its length as metadata. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

that is, all pairwise interactions of rank RANK in time linear in the words. It is fitted on a bounded sample of labelled rows
(MAX_EXAMPLES, by hash of the id) by AdaGrad on the driver: what the driver gets is at most MAX_EXAMPLES vectors of at most
HASH_DIMS + STATS entries. Scoring reads every whole text.

Null and empty texts: the score of the empty vector. Repeated label rows of a document: the largest label. No labelled rows,
or labels of one kind only: the smoothed share of label 1 for every document. Repeated documents get equal scores. Empty
table: empty result. Extra columns are kept by `score_quality`, but for any named score or predicted, which give way.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import id_remainder, kept_columns, read_table

HASH_DIMS, RANK, MAX_EXAMPLES, EPOCHS, THRESHOLD = 1 << 14, 6, 4000, 4, 0.3
STATS = 16
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@"
_MULTIPLIER = 0x9E3779B97F4A7C15


class WordSlots(dict):
    """Slot of a word by FNV-1a, remembered; forgotten as a whole when too many words have been seen."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = int.from_bytes(word[:8], "little") ^ (len(word) << 56)
        for i in range(8, len(word), 8):
            h = ((h * _MULTIPLIER) ^ int.from_bytes(word[i : i + 8], "little")) & 0xFFFFFFFFFFFFFFFF
        h = (h * _MULTIPLIER) & 0xFFFFFFFFFFFFFFFF
        slot = self[word] = (h >> 40) % HASH_DIMS
        return slot


_slots = WordSlots()


def structure(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """STATS numbers of about 0..1 that describe how the text is laid out."""
    n, k = max(1, len(text)), max(1, len(words))
    letters = len(text.translate(None, _NOT_LETTERS))
    lower = len(re.sub(rb"[^a-z]+", b"", text))
    upper = len(re.sub(rb"[^A-Z]+", b"", text))
    lines = text.split(b"\n")
    ends = sum(w[-1:] in b".!?," for w in words)
    return [
        1.0,
        upper / max(1, upper + lower),
        1 - len(text.translate(None, _SYMBOLS)) / n,
        min(1.0, text.count(b"!") / k),
        min(1.0, text.count(b"|") / k),
        min(1.0, sum(text.count(bytes([c])) for c in b"#*$%&") / k),
        letters / n,
        min(1.0, sum(map(text.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / n * 5),
        min(1.0, n / k / 20),
        distinct / k,
        1 - len(set(lines)) / len(lines),
        ends / k,
        min(1.0, text.count(b"http") / k * 10),
        min(1.0, math.log1p(len(words)) / 10),
        min(1.0, math.log1p(n / len(lines)) / 10),
        min(1.0, math.log1p(len(text)) / 12),
    ]


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    counts = Counter(raw.lower().split())
    slots = np.fromiter((_slots[w] for w in counts), np.int64, len(counts))
    values = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    slots, at = np.unique(slots, return_inverse=True)
    values = np.bincount(at, values, len(slots)) if len(slots) else np.zeros(0)
    norm = math.sqrt(float(values @ values)) or 1.0
    return np.concatenate([slots, np.arange(HASH_DIMS, HASH_DIMS + STATS)]), np.concatenate([values / norm, structure(raw, words, len(counts))])


class FactorisationMachine:
    """Weights of a second-order factorisation machine with a logistic link."""

    def __init__(self, dims: int = HASH_DIMS + STATS, rank: int = RANK, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(dims)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (dims, rank))

    def margin(self, idx: np.ndarray, x: np.ndarray) -> float:
        v = self.v[idx]
        return self.w0 + float(self.w[idx] @ x) + 0.5 * float(np.sum((x @ v) ** 2) - np.sum((x * x) @ (v * v)))

    def probability(self, idx: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(idx, x)))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
        """AdaGrad on the log loss."""
        mean = (sum(y for *_, y in rows) + 1) / (len(rows) + 2)
        self.w0 = math.log(mean / (1 - mean))
        if len({y for *_, y in rows}) < 2:
            self.v[:] = 0
            return self
        g0, gw, gv = 1e-6, np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                idx, x, y = rows[i]
                v, g = self.v[idx], self.probability(idx, x) - y
                dw = g * x + decay * self.w[idx]
                dv = g * (x[:, None] * (x @ v)[None, :] - v * (x * x)[:, None]) + decay * v
                g0 += g * g
                gw[idx] += dw * dw
                gv[idx] += dv * dv
                self.w0 -= rate * g / math.sqrt(g0)
                self.w[idx] -= rate * dw / np.sqrt(gw[idx])
                self.v[idx] -= rate * 0.3 * dv / np.sqrt(gv[idx])
        return self


def bounded_sample(labels: DataFrame, label_col: str, limit: int, *, id_col: str = "doc_id") -> DataFrame:
    """At most limit labelled ids, by hash: id and label."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    return known.orderBy(F.xxhash64("_id"), "_id").limit(limit)


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", limit: int = MAX_EXAMPLES) -> FactorisationMachine:
    """labels: doc_id and label_col, the rows to learn from."""
    sample = F.broadcast(bounded_sample(labels, label_col, limit))  # at most `limit` pairs

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [vector(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["_id"], "y": b["_label"], "i": [i.astype("<i4").tobytes() for i, _ in both], "x": [x.astype("<f4").tobytes() for _, x in both]})

    rows = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id")).select("_id", "_label", "text").mapInPandas(vectors, "id long, y int, i binary, x binary").toPandas()
    rows = rows.drop_duplicates(["id", "x"]).sort_values(["id", "x"])
    return FactorisationMachine().fit([(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), int(y)) for i, x, y in zip(rows["i"], rows["x"], rows["y"], strict=True)])


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([m.probability(*vector(t)) for t in texts], dtype="float64")

    scored = docs.select(*kept_columns(docs, "score", "predicted"), probability("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the folds 1 to 4."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 5) != 0)
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
