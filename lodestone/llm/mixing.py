"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule: piecewise-linear weight over training time 0..1. Its integral gives the source's share
of the budget, and the inverse of its cumulative demand gives the training time at which each of its words is due. The
documents of a source stand in the order of the md5 of their id, one epoch after the other, and their place among the
source's words, turned into time, is their position; the mix is sorted by it.

Null source: a source of its own, last. Null or empty text: size 0, nothing taken. Repeated rows: documents of their own.
Empty table: empty result. Columns of the input are kept, but for any that has the name of an added one (ADDED, or copy and
position), which gives way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import RESULT, kept_columns, read_table, stored, word_count

ADDED = ("size", "source_size", "target", "start", "taken", "copies")
#: Rows of a source that one task orders.
BUCKET_ROWS = 4096
#: Weights of the sources in code point order, repeating, and how each one's weight moves over time (-1..1; mean unchanged).
WEIGHTS, TILTS = (3.0, 1.0, 2.0), (0.5, -0.5, 0.0)


def schedule(weight: Column, tilt: Column) -> Column:
    """A straight-line schedule: knots (t, w) at 0 and 1 whose mean is weight."""
    knot = lambda t, w: F.struct(F.lit(t).alias("t"), w.alias("w"))
    return F.array(knot(0.0, weight * (1 - tilt)), knot(1.0, weight * (1 + tilt)))


def integral(knots: Column) -> Column:
    """Area under the schedule."""
    pairs = F.sequence(F.lit(0), F.size(knots) - 2)
    return F.aggregate(pairs, F.lit(0.0), lambda a, i: a + (knots[i + 1].t - knots[i].t) * (knots[i].w + knots[i + 1].w) / 2)


def time_of(knots: Column, share: Column) -> Column:
    """The time at which the schedule has used up that share (0..1) of its area."""
    segment = lambda i: F.struct(knots[i].t.alias("t"), (knots[i + 1].t - knots[i].t).alias("dt"), knots[i].w.alias("a"), knots[i + 1].w.alias("b"))
    step = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.size(knots) - 2), segment),
        F.struct((share * integral(knots)).alias("left"), F.lit(None).cast("double").alias("at")),
        lambda acc, s: F.struct(
            (acc["left"] - s.dt * (s.a + s.b) / 2).alias("left"),
            F.coalesce(acc["at"], F.when(acc["left"] <= s.dt * (s.a + s.b) / 2, s.t + s.dt * _root(s.a, s.b - s.a, acc["left"] / s.dt))).alias("at"),
        ),
    )
    return F.least(F.lit(1.0), F.coalesce(step["at"], F.lit(1.0)))


def _root(a: Column, slope: Column, area: Column) -> Column:
    """x in 0..1 with a x + slope x^2 / 2 = area."""
    root = F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * area))
    return F.when(area <= 0, 0.0).otherwise(2 * area / (a + root))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: source, source_size, rows. Adds rank, knots and target: the budget shared by weight, none above cap times its
    size. The level at which the shares settle is found in the order in which sources fill up."""
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("rank") % len(xs) + 1).cast("int"))
    ranked = sizes.select("*", rank).withColumn("knots", schedule(pick(weights), pick(tilts))).withColumn("weight", integral(F.col("knots")))
    full = (F.col("source_size") * cap).alias("full")
    fills = W.orderBy("fill", "rank")
    level = (
        ranked.select("*", full, (F.col("source_size") * cap / F.col("weight")).alias("fill"))
        .withColumn("before", F.coalesce(F.sum("full").over(fills.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fills.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(W.partitionBy()) * budget - F.col("before")) / F.col("open"))
        .withColumn("settled", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(W.partitionBy())["level"])
    )
    return level.withColumn("target", F.least("full", F.coalesce(F.col("settled") * F.col("weight"), F.col("full")))).select("source", "source_size", "rows", "knots", "target")


def mixing_plan(docs: DataFrame, *, id_col: str = "doc_id", size: Column | None = None, **how) -> DataFrame:
    """docs with size, source_size, target, start (the words of its source before it), taken (words taken, repeats counted) and
    copies (array of copy, words, position). The target is met to the word: the last document taken gives its first words only."""
    cap = how.get("cap", 2.0)
    kept = kept_columns(docs, *ADDED)
    sized = docs.select(F.struct(*kept).alias("_row"), F.col("source"), (size if size is not None else word_count(F.col("text"))).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_key"))
    thin = stored(sized.select("source", "size", "_key"), "mixing")
    targets = source_targets(thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), **how)
    targets = stored(targets.withColumnRenamed("source", "_source"), "mixing-targets")

    def bucketed(df: DataFrame) -> DataFrame:
        """Each source's rows fall into runs of about BUCKET_ROWS by the leading digits of their key: a large source fills many tasks."""
        share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(2**32)
        return df.join(targets, df.source.eqNullSafe(targets._source)).withColumn("_bucket", F.floor(share * F.ceil(F.col("rows") / BUCKET_ROWS)))

    runs = bucketed(thin).groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    rows = bucketed(sized)
    rows = rows.join(runs, rows._source.eqNullSafe(runs._s) & (rows._bucket == runs._b))
    within = W.partitionBy("_source", "_bucket").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    goal = F.round("target").cast("long")

    def copy(e: Column) -> Column:
        at = F.col("start") + e.cast("long") * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - at)).cast("long")
        return F.struct(e.alias("copy"), words.alias("words"), time_of(F.col("knots"), F.least(F.lit(1.0), (at + words / 2) / F.col("target"))).alias("position"))

    copies = F.when(goal > 0, F.filter(F.transform(F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1)), copy), lambda c: c.words > 0))
    rows = rows.withColumn("copies", F.coalesce(copies, F.expr("cast(array() as array<struct<copy:int,words:bigint,position:double>>)")))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c.words)
    return rows.withColumn("taken", taken).select("_row.*", *ADDED)


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row for each copy that is taken, with copy and position, sorted by position. Where the plan takes only
    the first words of a document, text ends with them (not if a size other than the number of words is given)."""
    kept = kept_columns(docs, *ADDED, "copy", "position")
    plan = mixing_plan(docs.select(*kept), **how).select(*kept, F.explode("copies").alias(RESULT))
    if "text" in kept and how.get("size") is None:
        cut = F.when(F.col(RESULT)["words"] < word_count(F.col("text")), first_words(F.col("text"), F.col(RESULT)["words"])).otherwise(F.col("text"))
        plan = plan.select(*(cut.alias(c) if c == "text" else F.col(c) for c in kept), RESULT)
    return plan.select(*kept, F.col(RESULT)["copy"].alias("copy"), F.col(RESULT)["position"].alias("position")).repartitionByRange("position").sortWithinPartitions("position")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it, in training order; those that it takes nothing of stand last."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n_words"))
    plan = mixing_plan(docs, size=F.col("n_words"))
    out = plan.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", F.round(F.get("copies", F.lit(0)).position, 6).alias("position"))
    order = [F.col("position").asc_nulls_last(), F.xxhash64("doc_id")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r FROM sized GROUP BY source
), w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1 ELSE 2 END AS weight, CASE r % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5 ELSE 0 END AS tilt FROM s
), f AS (
  SELECT *, 2.0::DOUBLE * source_size AS full_size, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, r) AS o FROM w
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM f) * 1.5::DOUBLE - coalesce(sum(full_size) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM f
), t AS (
  SELECT *, least(full_size, coalesce((SELECT arg_min(lev, o) FROM l WHERE lev <= full_size / weight) * weight, full_size)) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt, round(t.target)::BIGINT AS goal,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, goal - a)) AS w0, greatest(0, least(size, goal - a - source_size)) AS w1 FROM p
), u AS (
  SELECT *, CASE WHEN w0 > 0 THEN least(1.0::DOUBLE, (a + w0 / 2.0::DOUBLE) / target) END AS x FROM q
)
SELECT doc_id, size, source_size, round(target, 4) AS target, (w0 + w1)::BIGINT AS taken,
  round(2 * x / ((1 - tilt) + sqrt(greatest(0.0::DOUBLE, (1 - tilt) * (1 - tilt) + 4 * tilt * x))), 6) AS position
FROM u
"""
