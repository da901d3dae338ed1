"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of labelled rows (MAX_EXAMPLES ids by hash). The terms of a text are its lower-cased words
without the punctuation around them and the first PREFIXES letters of longer words, which find inflected forms. The vocabulary
is made of the terms that tell the labels apart among the examples: those in at least LEAST_DOCS of them whose share of label 1
differs from the base rate by LEAST_Z standard errors and by LEAST_LIFT in log odds, at most MAX_TERMS. Terms are counted and
chosen by a distributed aggregation; what the driver gets is the vocabulary and the examples' counts of it.

A term's weight is (1 + ln tf) * ln(N / df) with N and df from the examples. The index keeps, for each term, its postings in the
order of the examples, and for each term and block of BLOCK examples its largest weight. The nearest examples of a document come
in two steps, without loss:

1. the rare terms' postings are added up in full, which gives every example a sum so far;
2. a block whose largest sum so far plus largest possible rest stays below the k-th best sum so far is left out; the weights of
   the frequent terms are added in the other blocks only.

The score is the share of label 1 among the K nearest, each weighed by its cosine to the power POWER, drawn to the examples'
base rate by PRIOR, and set right by a logistic curve fitted on the examples themselves, each scored without itself.

Null and empty texts and texts without any term of the vocabulary have no neighbours: the base rate, set right by the curve. No
examples: 0. Labels of one kind only: no term tells them apart, so the base rate. Texts of any length are read whole, as examples and when scored. Repeated label rows:
the largest label. Ties at the k-th place: the earlier example, in the order of (label, id, text). Repeated documents: equal
scores. Empty table: empty result. Extra columns are kept by `score_toxicity`, but for any named score, predicted or nearest,
which give way.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import RESULT, id_remainder, kept_columns, read_table, stored
from lodestone.llm.quality import bounded_sample

MAX_EXAMPLES, K, POWER, PRIOR, BLOCK, THRESHOLD = 6000, 15, 2.0, 0.05, 64, 0.3
MAX_TERMS, LEAST_DOCS, LEAST_Z, LEAST_LIFT, PREFIXES = 4000, 3, 4.0, 2.0, (4, 5)
REMEMBERED = 400_000
_PUNCTUATION = b".,;:!?\"'()[]{}*#$%&|<>-_"


def terms_of(token: bytes) -> tuple[bytes, ...]:
    """The terms of a token: the word and its first letters, marked by a leading byte for their number."""
    word = token.strip(_PUNCTUATION)
    if not word:
        return ()
    letters = word.decode("utf-8", "replace")
    return (word, *(bytes([n]) + letters[:n].encode("utf-8", "replace") for n in PREFIXES if len(letters) > n))


class Terms(dict):
    """The terms of a token that are in the vocabulary, remembered."""

    def __init__(self, vocabulary: frozenset[bytes] | None = None):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: bytes) -> tuple[bytes, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[token] = tuple(t for t in terms_of(token) if self.vocabulary is None or t in self.vocabulary)
        return found

    def count(self, text: str | None) -> dict[bytes, int]:
        """How often each term occurs in a whole text."""
        out: dict[bytes, int] = {}
        for token, n in Counter((text or "").encode("utf-8", "replace").lower().split()).items():
            for t in self[token]:
                out[t] = out.get(t, 0) + n
        return out


class BlockMaxIndex:
    """Examples by word."""

    def __init__(self, examples: list[dict[bytes, int]]):
        n = self.n = len(examples)
        self.blocks = max(1, -(-n // BLOCK))
        df = Counter(w for e in examples for w in e)
        self.idf = {w: math.log(n / c) for w, c in df.items() if c < n}
        self.none = math.log(2 * n) if n else 0.0
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for i, e in enumerate(examples):
            weights = {w: (1 + math.log(c)) * self.idf[w] for w, c in e.items() if w in self.idf}
            norm = math.sqrt(sum(x * x for x in weights.values())) or 1.0
            for w, x in weights.items():
                postings[w].append((i, x / norm))
        self.everywhere = {w for w, c in df.items() if c >= n}
        common = sorted(w for w, p in postings.items() if len(p) > max(BLOCK, n // 12))
        self.common = {w: j for j, w in enumerate(common)}
        self.dense = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        for w, j in self.common.items():
            for i, x in postings[w]:
                self.dense[j, i] = x
        self.most = self.dense.reshape(len(common), self.blocks, BLOCK).max(axis=2) if common else np.zeros((0, self.blocks), np.float32)
        self.rare = {w: (np.array([i for i, _ in p], np.int32), np.array([x for _, x in p], np.float32)) for w, p in postings.items() if w not in self.common}

    def nearest(self, words: dict[bytes, int], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine (those above 0), and the cosines."""
        ids, sums, freq, freq_w, norm = [], [], [], [], 0.0
        idf, rare, common, none = self.idf, self.rare, self.common, self.none
        for w, c in words.items():
            if (g := idf.get(w)) is None:
                if w not in self.everywhere:
                    norm += ((1 + math.log(c)) * none) ** 2
                continue
            q = (1 + math.log(c)) * g
            norm += q * q
            if (p := rare.get(w)) is not None:
                ids.append(p[0])
                sums.append(p[1] * q)
            else:
                freq.append(common[w])
                freq_w.append(q)
        if not ids and not freq:
            return np.zeros(0, np.int64), np.zeros(0)
        size = self.blocks * BLOCK
        acc = np.bincount(np.concatenate(ids), np.concatenate(sums), size).astype(np.float64) if ids else np.zeros(size)
        if freq:
            q = np.array(freq_w)
            reach = acc.reshape(self.blocks, BLOCK).max(axis=1) + q @ self.most[freq]
            if without >= 0:
                acc[without] = -1.0
            floor = np.partition(acc, size - k)[size - k] if size > k else 0.0
            open_blocks = np.flatnonzero(reach >= floor - 1e-5)
            at = (open_blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            if len(open_blocks) == self.blocks:
                acc += q @ self.dense[freq]
            else:
                acc[at] += q @ self.dense[np.array(freq)[:, None], at]
        if without >= 0:
            acc[without] = -1.0
        top = np.argpartition(-acc, k - 1)[:k] if size > k else np.arange(size)
        if size > k and (acc == (edge := acc[top].min())).sum() > (acc[top] == edge).sum():  # ties at the edge: the earlier ones
            over = np.flatnonzero(acc > edge)
            top = np.concatenate([over, np.flatnonzero(acc == edge)[: k - len(over)]])
        top = top[acc[top] > 1e-12]
        top = top[np.lexsort((top, -acc[top]))]
        return top, acc[top] / math.sqrt(norm)


class NearestExamples:
    """Votes of the nearest labelled examples, set right by a logistic curve."""

    def __init__(self, examples: list[tuple[int, dict[bytes, int], int]]):
        self.ids = [i for i, _, _ in examples]
        self.labels = np.array([y for *_, y in examples], float)
        self.base = float(self.labels.mean()) if examples else 0.0
        self.index = BlockMaxIndex([w for _, w, _ in examples])
        self.terms = Terms(frozenset(self.index.idf))
        self.slope, self.offset = 1.0, 0.0
        if 0 < self.labels.sum() < len(examples):
            self._calibrate([self.votes(*self.index.nearest(w, K, i)) for i, (_, w, _) in enumerate(examples)])

    def votes(self, near: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine**POWER
        return float((w @ self.labels[near] + PRIOR * self.base) / (w.sum() + PRIOR))

    def _logit(self, p: float) -> float:
        return math.log((p + 1e-3) / (1 - p + 1e-3))

    def _calibrate(self, votes: list[float]) -> None:
        """Newton steps for the two numbers of the curve."""
        x, y, t = np.array([self._logit(v) for v in votes]), self.labels, np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(t[0] * x + t[1], -30, 30)))
            g = np.array([((p - y) * x).sum() + 0.01 * (t[0] - 1), (p - y).sum()])
            h = p * (1 - p)
            t = t - np.linalg.solve(np.array([[(h * x * x).sum() + 0.01, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]]), g)
        if np.isfinite(t).all() and t[0] > 0:
            self.slope, self.offset = float(t[0]), float(t[1])

    def score(self, text: str | None, evidence: int = 0) -> tuple[float, list[int]]:
        if not self.index.n:
            return 0.0, []
        near, cosine = self.index.nearest(self.terms.count(text), K)
        z = self.slope * self._logit(self.votes(near, cosine)) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), [self.ids[i] for i in near[:evidence]]


def telling_terms(sample: DataFrame) -> frozenset[bytes]:
    """sample: _label, text. The terms that tell the labels apart."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for b in batches:
            docs = {y: Counter(t for text in b["text"][b["_label"] == y] for t in terms.count(text)) for y in (0, 1)}
            both = list(docs[0].keys() | docs[1].keys())
            yield pd.DataFrame({"term": both, "n0": [docs[0][t] for t in both], "n1": [docs[1][t] for t in both]})

    size = sample.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    n, ones = int(size[0]), int(size[1])
    if not 0 < ones < n:
        return frozenset()
    counts = sample.select("_label", "text").mapInPandas(counted, "term binary, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / n
    z = F.abs(F.col("n1") / ones - F.col("n0") / (n - ones)) / F.sqrt(share * (1 - share) * (1 / ones + 1 / (n - ones)))
    lift = F.abs(F.log((F.col("n1") + 0.5) / (F.col("n0") + 0.5)) - math.log(ones / (n - ones)))
    telling = counts.where((F.col("n0") + F.col("n1") >= LEAST_DOCS) & (share < 1)).withColumn("z", z).where((F.col("z") >= LEAST_Z) & (lift >= LEAST_LIFT))
    return frozenset(bytes(r.term) for r in telling.orderBy(F.desc(F.round("z", 6)), "term").limit(MAX_TERMS).select("term").collect())


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", limit: int = MAX_EXAMPLES) -> list[tuple[int, dict[bytes, int], int]]:
    """The labelled examples: id, counts of the terms that tell labels apart, and label."""
    ids = F.broadcast(bounded_sample(labels, label_col, limit))  # at most `limit` pairs
    sample = stored(docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).select("_id", "_label", "text").distinct(), "toxicity-sample")
    vocabulary = telling_terms(sample)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(vocabulary)
        for b in batches:
            some = [sorted(terms.count(t).items()) for t in b["text"]]
            yield pd.DataFrame({"id": b["_id"], "y": b["_label"], "h": [xxhash.xxh3_64_intdigest(t or "") >> 1 for t in b["text"]], "w": [[w for w, _ in x] for x in some], "n": [[c for _, c in x] for x in some]})

    rows = sample.mapInPandas(counted, "id long, y int, h long, w array<binary>, n array<int>").toPandas().sort_values(["y", "id", "h"])
    return [(int(i), dict(zip(map(bytes, w), map(int, n), strict=True)), int(y)) for i, y, w, n in zip(rows["id"], rows["y"], rows["w"], rows["n"], strict=True)]


def score_toxicity(docs: DataFrame, examples: list, threshold: float = THRESHOLD, evidence: int = 3) -> DataFrame:
    """docs with score, predicted and nearest (ids of the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(NearestExamples(examples))  # at most MAX_EXAMPLES * MAX_TERMS postings

    @F.pandas_udf("score double, nearest array<long>")
    def votes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            both = [model.score(t, evidence) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in both], "nearest": [n for _, n in both]})

    kept, r = kept_columns(docs, "score", "predicted", "nearest"), F.col(RESULT)
    return docs.select(*kept, votes("text").alias(RESULT)).select(*kept, r["score"].alias("score"), (r["score"] >= threshold).cast("int").alias("predicted"), r["nearest"].alias("nearest"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the folds 0, 1 and 3."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 4) != 2)
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
