"""Score normalisers, rank fusion, top-k and deduplication by windows. Ties are broken by id, so that runs agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

by = lambda cols: W.partitionBy(*cols) if cols else W.partitionBy()


def min_max(df: DataFrame, score: str, out: str, *, group: Sequence[str] = (), constant: float = 0.0) -> DataFrame:
    """(x - min) / (max - min) within each group; `constant` where all scores are equal."""
    lo, hi = F.min(score).over(by(group)), F.max(score).over(by(group))
    return df.withColumn(out, F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(F.lit(constant)))


def rank_share(df: DataFrame, score: str, out: str, *, group: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """(n - rank) / n with rank 0 for the best."""
    rank = F.row_number().over(by(group).orderBy(F.col(score).desc(), tie)) - 1
    n = F.count("*").over(by(group))
    return df.withColumn(out, (n - rank) / n)


def hybrid_normalise(df: DataFrame, score: str, out: str, *, group: Sequence[str] = (), tie: str = "id", raw: float = 0.6, rank: float = 0.4) -> DataFrame:
    """raw * min-max (scaled by the best score if that is below 1) + rank * rank share; a group of one keeps its positive score."""
    lo, hi, n = F.min(score).over(by(group)), F.max(score).over(by(group)), F.count("*").over(by(group))
    positive = F.greatest(F.col(score), F.lit(0.0))
    scaled = F.when(hi > lo, (F.col(score) - lo) / (hi - lo) * F.least(hi, F.lit(1.0))).otherwise(positive)
    ranked = rank_share(df.withColumn("_scaled", scaled).withColumn("_n", n), score, "_rank", group=group, tie=tie)
    return ranked.withColumn(out, F.when(F.col("_n") == 1, positive).otherwise(raw * F.col("_scaled") + rank * F.col("_rank"))).drop("_scaled", "_rank", "_n")


def reciprocal_rank(df: DataFrame, score: str, out: str, *, group: Sequence[str] = (), tie: str = "id", k: int = 60) -> DataFrame:
    return df.withColumn(out, 1.0 / (k + F.row_number().over(by(group).orderBy(F.col(score).desc(), tie))))


def top_k(df: DataFrame, k: int, score: str, *, group: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """The k best rows; of every group, if there are groups (Spark limits each group's rows before it shuffles them)."""
    if not group:
        return df.orderBy(F.col(score).desc(), tie).limit(k)
    return df.withColumn("_r", F.row_number().over(by(group).orderBy(F.col(score).desc(), tie))).where(F.col("_r") <= k).drop("_r")


def first_k(df: DataFrame, k: int, order: Sequence[str | Column], *, group: Sequence[str]) -> DataFrame:
    """The first k rows of each group in a given order."""
    return df.withColumn("_r", F.row_number().over(by(group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def best_of(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first in the order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def best_by_name(df: DataFrame, name: str = "name", score: str = "confidence", *, group: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """One row for each name, whatever its case and blanks around it: the best."""
    return best_of(df, [*group, F.lower(F.trim(name))], [F.col(score).desc(), tie])


def renumbered(df: DataFrame, out: str, order: Sequence[Column | str]) -> DataFrame:
    """Rows numbered from 1 in an order: range partitions number their rows, offsets come from a small table of their sizes. The
    partitions are stored: drawn again for the sizes, they would have other bounds."""
    from lodestone.operators.graph import written

    parts = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    within = parts.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    sizes = within.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return within.join(before, "_p").withColumn(out, F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def capped_slice(df: DataFrame, score: str, second: str, *, group: Sequence[str] = (), tie: str = "id", least: int = 50, most: int = 200, share: float = 0.1) -> DataFrame:
    """The best min(most, max(least, share of the rows)) rows of each group."""
    n = F.count("*").over(by(group))
    cap = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(n * share)))
    rank = F.row_number().over(by(group).orderBy(F.col(score).desc(), F.col(second).desc(), tie))
    return df.withColumn("_cap", cap).withColumn("_r", rank).where("_r <= _cap").drop("_cap", "_r")


def relevance_floor(df: DataFrame, score: str, fallback: Column, *, group: Sequence[str] = (), least: float = 0.2) -> DataFrame:
    """Rows of at least that score; a group without any keeps all rows with the fallback as score."""
    any_good = F.max(F.when(F.col(score) >= least, 1).otherwise(0)).over(by(group))
    marked = df.withColumn("_any", any_good)
    return marked.where((F.col("_any") == 0) | (F.col(score) >= least)).withColumn(score, F.when(F.col("_any") == 1, F.col(score)).otherwise(fallback)).drop("_any")


def ranked_out(df: DataFrame, k: int, score: str, reasons: dict[str, Column], *, group: Sequence[str] = (), tie: str = "id", window: int = 10) -> DataFrame:
    """The rows just behind the k best, with their rank and the reasons that hold for them."""
    ranked = df.withColumn("rank", F.row_number().over(by(group).orderBy(F.col(score).desc(), tie))).where(F.col("rank").between(k + 1, k + window))
    texts = [F.concat(F.lit("ranked "), F.col("rank").cast("string"), F.lit(f" (top_k={k})")), *(F.when(c, F.lit(t)) for t, c in reasons.items())]
    return ranked.withColumn("reasons", F.filter(F.array(*texts), lambda x: x.isNotNull()))


def preferred_first(df: DataFrame, preferred: Column, k: int, score: str, *, group: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """Preferred rows before the others; only preferred ones where there are at least k of them. Adds position."""
    marked = df.withColumn("_p", F.coalesce(preferred, F.lit(False))).withColumn("_n", F.sum(F.col("_p").cast("int")).over(by(group)))
    kept = marked.where((F.col("_n") < k) | F.col("_p"))
    return kept.withColumn("position", F.row_number().over(by(group).orderBy(F.col("_p").desc(), F.col(score).desc(), tie))).drop("_p", "_n")


def padded(df: DataFrame, k: int, score: str, *, group: str) -> DataFrame:
    """Exactly k rows (rank 1 to k) for each group, 0 where results are missing."""
    ranks = df.select(group).distinct().select(group, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return ranks.join(df.select(group, "rank", score), [group, "rank"], "left").withColumn(score, F.coalesce(score, F.lit(0.0)))


def histogram(df: DataFrame, score: str, digits: int = 1) -> DataFrame:
    return df.groupBy(F.round(score, digits).alias("bucket")).agg(F.count("*").alias("n"))


# --- fusion --------------------------------------------------------------------------------------------------------------
def fuse_channels(channels: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of scored lists: keys and one column for each channel, null where a channel lacks the row."""
    out: DataFrame | None = None
    for name, df in channels.items():
        one = df.select(*keys, F.col("score").alias(name))
        out = one if out is None else out.join(one, list(keys), "full_outer")
    if out is None:
        raise ValueError("no channels")
    return out


def adaptive_weights(constraints: int | Column, semantic: float | Column = 0.5, graph: float | Column = 0.5) -> tuple[Column, Column]:
    """Each constraint moves 0.04 of weight, 0.25 at most, from the semantic to the graph channel; none falls below 0.05."""
    boost = F.least(F.lit(0.25), F.lit(0.04) * constraints)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    s, g = F.greatest(F.lit(0.05), lit(semantic) - boost), F.greatest(F.lit(0.05), lit(graph) + boost)
    return s / (s + g), g / (s + g)


def weighted(vector: Column, graph: Column, vector_weight: float, graph_weight: float) -> Column:
    return vector_weight * F.coalesce(vector, F.lit(0.0)) + graph_weight * F.coalesce(graph, F.lit(0.0))


def city_fusion(vector: Column, direct: Column, uniqueness: Column, vector_weight: float = 0.40, graph_weight: float = 0.60) -> Column:
    """City generation: vector and direct matches, and a nudge for unusual places."""
    return weighted(vector, direct, vector_weight, graph_weight) + 0.02 * (F.coalesce(uniqueness, F.lit(0.5)) - 0.5)


def evidence_confidence(direct: Column, total: Column, node_confidence: Column, coverage: Column, final: Column, safety: Column) -> Column:
    """Multi-layer generation: how far evidence, data and score carry a result."""
    strength = F.when(total > 0, direct / total).otherwise(0.0)
    return 0.30 * strength + 0.25 * node_confidence + 0.20 * coverage / 100 + 0.15 * final + 0.10 * F.when(safety.isNull() | (safety == 0), 5.0).otherwise(safety) / 10


def ranking_score(final: Column, confidence: Column) -> Column:
    return 0.70 * final + 0.30 * confidence
