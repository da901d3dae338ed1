"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document is the set of its word shingles (hashed to 64 bits). Its signature has PLACES symbols of 8 bits, each from the
smallest value of the set under another hash function; two signatures differ in about (1 - similarity) of the places. To find
all pairs that differ in at most reach places, the places are split into chunks. By the pigeonhole principle at least one chunk
of such a pair has one error at most, since two errors in each would be more than reach; each chunk's one-error neighbourhood is
enumerated by leaving out one place after the other, which gives PLACES keys for a document. Pairs that share a key are
compared on their full sets: a link needs 100 * intersection >= percent * union.

What the most central member of a bucket doesn't settle (see linking.py), as documents with a passage in common, is split by the
prefix filter: the members' shingles are put in one order, rare ones first (by counts of hashed slots over all such members);
a link of sets of n and m shingles has at least o = percent (n + m) / (100 + percent) in common, so that its first common
shingle is at most the n - o + 1st of the one and the m - o + 1st of the other. Only pairs that share such a shingle are
compared. Pairs whose signatures differ in more than checked places aren't compared on their sets.

Chunks, reach and checked follow from percent (see layout): of pairs at the least similarity at most UNMET lie beyond reach, where
they meet by chance only, and at most LOST beyond checked, where they are never compared. Percents that would need chunks of
fewer than four places are refused.

Documents with equal sets are one node, named by a hash of two sums over the set; they are found without pairs.

Fewer words than a shingle: the whole sequence is one shingle. No words, null or empty text: an empty set, linked with nothing.
Texts of any length are read whole. Repeated rows are copies; rows of one id with different texts are documents of their own
with that id. Ids may be of any type that has an order; a group of rows without ids has a null component. Empty table: empty
result. Extra columns: `near_duplicates` gives the id, n_shingles, component_id and kept alone; `without_copies` keeps the
input's columns.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import marked, read_table, stored
from lodestone.llm.linking import Buckets, meet

PLACES, SLOT_BITS = 64, 16
FEWEST, MOST, UNMET, LOST = 12, 16, 1e-4, 1e-8
REMEMBERED, BATCH = 100_000, 1000
_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(1, 2**63, PLACES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Layout(NamedTuple):
    """bounds: first and last place of each chunk; reach: places in which a pair may differ and surely meets; checked: places in
    which a pair may differ and is compared."""

    bounds: tuple[tuple[int, int], ...]
    reach: int
    checked: int


def beyond(percent: int, most: int) -> float:
    """The share of pairs at the least similarity that differ in more than so many places."""
    p = max(0.0, 1 - percent / 100) * 255 / 256
    return sum(math.comb(PLACES, i) * p**i * (1 - p) ** (PLACES - i) for i in range(most + 1, PLACES + 1))


def layout(percent: int) -> Layout:
    """The fewest chunks, from FEWEST on, whose reach leaves at most UNMET of the pairs at the least similarity."""
    for chunks in range(FEWEST, MOST + 1):
        reach = 2 * chunks - 1
        if beyond(percent, reach) <= UNMET:
            bounds = tuple((PLACES * i // chunks, PLACES * (i + 1) // chunks) for i in range(chunks))
            return Layout(bounds, reach, next(k for k in range(reach, PLACES + 1) if beyond(percent, k) <= LOST))
    raise ValueError(f"percent = {percent}: {PLACES} places find links of at least 76 %")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of a text's shingles: distinct 64-bit hashes, ascending."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for j in range(min(width, len(h))):
        out = _mixed(out * _STEP + h[j : j + n])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """PLACES symbols of a set that isn't empty."""
    low = np.full(PLACES, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (s[None, i : i + 2048] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    return (_mixed(low) & np.uint64(255)).astype(np.uint8)


def chunk_keys(signatures: np.ndarray, bounds: tuple[tuple[int, int], ...]) -> np.ndarray:
    """PLACES keys for each row of signatures: chunk, place left out, and the symbols of the chunk's other places."""
    out = []
    for c, (a, b) in enumerate(bounds):
        for j in range(a, b):
            key = np.full(len(signatures), c * 8 + j - a, np.int64)
            for i in range(a, b):
                if i != j:
                    key = (key << 8) | signatures[:, i]
            out.append(key)
    return np.stack(out, axis=1)


def _symbols(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, PLACES)


def _keys(sig: str, bounds: tuple[tuple[int, int], ...]) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(sig: pd.Series) -> pd.Series:
        return pd.Series(list(chunk_keys(_symbols(sig), bounds)))

    return keys(sig)


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series((_symbols(a) != _symbols(b)).sum(axis=1).astype(np.int32))


def sketches(docs: DataFrame, width: int, *, id_col: str = "doc_id") -> DataFrame:
    """id, th (hash of the text), n_shingles, node (equal sets have equal ones; null for the empty set) and sig."""

    @F.pandas_udf("n_shingles long, sum1 long, sum2 long, sig binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            s = shingles(text, width)
            rows.append((len(s), *_sums(s), signature(s).tobytes() if len(s) else None))
        return pd.DataFrame(rows, columns=["n_shingles", "sum1", "sum2", "sig"])

    out = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), sketch("text").alias("s"))
    return out.select("id", "th", "s.n_shingles", _node("s.n_shingles", "s.sum1", "s.sum2").alias("node"), "s.sig")


def _sums(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype=np.uint64).astype(np.int64)), int(_mixed(s + _STEP).sum(dtype=np.uint64).astype(np.int64))


def _node(n: str, sum1: str, sum2: str) -> Column:
    return F.when(F.col(n) > 0, F.xxhash64(n, sum1, sum2))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """texts: text. Returns node and s, its set."""

    @F.pandas_udf("s array<long>, sum1 long, sum2 long")
    def sets(texts: pd.Series) -> pd.DataFrame:
        rows = [shingles(t, width) for t in texts]
        return pd.DataFrame([(s.astype(np.int64), *_sums(s)) for s in rows], columns=["s", "sum1", "sum2"])

    out = texts.select(sets("text").alias("x")).select("x.*").withColumn("n", F.size("s").cast("long"))
    return out.select(_node("n", "sum1", "sum2").alias("node"), "s")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """sets: id, c, s. A row (bucket, id, c, n, rank) for each of the first shingles of a set in the common order."""
    slot = lambda x: F.shiftrightunsigned(x, 64 - SLOT_BITS)
    rows = sets.select(F.explode(F.transform("s", slot)).alias("slot")).groupBy("slot").count().collect()  # at most 2^SLOT_BITS
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for r in rows:
        counts[r["slot"]] = r["count"]
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def first(sets: pd.Series) -> pd.Series:
        out = []
        for s in sets:
            x = np.asarray(s, np.int64)
            order = np.lexsort((x, shared.value[x.view(np.uint64) >> np.uint64(64 - SLOT_BITS)]))
            out.append(x[order[: len(x) + 1 + -percent * len(x) // 100]])  # all but ceil(percent of them), and one
        return pd.Series(out)

    ranked = sets.select("id", "c", F.size("s").cast("long").alias("n"), first("s").alias("first"))
    return ranked.select("id", "c", "n", F.posexplode("first").alias("rank", "bucket"))


def _groups(docs: DataFrame, width: int, percent: int, id_col: str) -> DataFrame:
    """id, th, n_shingles and node of each row, and least, the smallest id of its component (null for the empty set)."""
    plan = layout(percent)
    thin = stored(sketches(docs, width, id_col=id_col), "near-sketches", rows_a_batch=BATCH)
    nodes = thin.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min("th").alias("th"), F.first("sig").alias("sig"))
    nodes = stored(nodes, "near-nodes")
    buckets = Buckets(nodes.select(F.explode(_keys("sig", plan.bounds)).alias("key"), F.col("node").alias("id")), "near", central=True)
    members = stored(nodes.join(buckets.ids().withColumnRenamed("id", "node"), "node").select(F.col("node").alias("id"), "th", "sig"), "near-members")
    wanted = members.select("th")
    whole = marked(docs.select("text", F.xxhash64("text").alias("th")), F.col("th"), wanted, "th").where("_hit").drop("_hit")
    texts = whole.join(wanted.distinct(), "th", "left_semi").dropDuplicates(["th"])
    sets = stored(shingle_sets(texts, width).withColumnRenamed("node", "id").dropDuplicates(["id"]), "near-sets", rows_a_batch=BATCH)

    def check(pairs: DataFrame) -> DataFrame:
        near = pairs.join(members.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(members.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
        near = near.where(_distance("x", "y") <= plan.checked).select("a", "b")
        both = near.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
        common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("total"))
        return common.where(100 * F.col("n") >= percent * (F.col("total") - F.col("n"))).select("a", "b")

    def rest(mixed: DataFrame) -> DataFrame:
        some = stored(sets.join(mixed.select("id", "c").distinct(), "id"), "near-mixed-sets")
        in_common = lambda x: (100 + percent) * (F.col(f"{x}.n") - F.col(f"{x}.rank")) >= percent * (F.col("x.n") + F.col("y.n"))
        return meet(stored(_prefixes(some, percent), "near-prefixes", rows_a_batch=BATCH), lambda x, y: in_common(x) & in_common(y))

    _, found = buckets.linked(check, rest)
    named = nodes.join(found, nodes.node == found.id, "left").select("node", "least", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("least").alias("least"))
    named = named.select("node", "c").join(least, "c").select("node", "c", "least")
    return stored(thin.drop("sig").join(named, "node", "left"), "near-groups")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id (the smallest id that links lead to) and kept (whether that is the row's own id)."""
    rows = _groups(docs, width, percent, id_col).withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least")))
    return rows.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def without_copies(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that of the smallest id, and of the smallest hash of the text among rows of that id;
    of repeated rows one. Rows without words all stay. Only rows of texts that something happens to are shuffled."""
    rows = _groups(docs, width, percent, id_col).where("node is not null")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    stays = rows.groupBy("c").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    touched = stored(rows.join(stays, "c").select(F.xxhash64("id", "th").alias("k"), (place == F.col("first")).alias("stays")).groupBy("k").agg(F.max("stays").alias("stays")), "near-touched")
    kept = docs.columns
    all_ = marked(docs.select(F.struct(*kept).alias("_row"), F.xxhash64(id_col, F.xxhash64("text")).alias("_k")), F.col("_k"), touched, "k")
    some = all_.where("_hit").join(touched, F.col("_k") == F.col("k"), "left")
    one = some.where("stays").dropDuplicates(["_k"])
    out = some.where("stays is null").select("_row").unionByName(one.select("_row")).unionByName(all_.where("not _hit").select("_row"))
    return out.select("_row.*")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are at least 85 % alike."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=3, percent=85)
