"""Linking rows that share a bucket: candidate pairs without all pairs of a bucket, and connected components.

Rows that share a key are candidates. A bucket first links each member to one member only, its pivot, so that a group of n near
copies costs n checks: the smallest one, or the one whose keys the most others have, which is near the middle of such a group. What that can't settle, members of one bucket that ended in different components, goes to a second step,
which the operator gives: finer buckets such that any two linked rows still share one (for instance their rarest features, by
the prefix filter). There the rows outside a bucket's main component meet the others. A pair within one component needs no
check: its link would join nothing. So the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import marked, stored

#: Pairs (a, b) with a < b -> those of them that are links.
Check = Callable[[DataFrame], DataFrame]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b. Returns id, component (the smallest id that is reachable) for every id of a link. Alternates the two star
    steps of Kiveris et al. (2014): each turns paths into stars around smaller ids, in a number of rounds that grows with the
    logarithm of the longest path. Every round is written to the shared folder."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = stored(small, "components")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def meet(rows: DataFrame, may: Callable[[str, str], Column]) -> DataFrame:
    """rows: bucket, id, c (component) and more. The pairs (a, b), a < b, of one bucket and different components for which
    may(x, y) holds, a condition on the columns x.* and y.* that every link meets. Of each bucket the rows outside its main
    component (that of the most rows overall) are held against all rows, so that a group of linked rows doesn't meet itself."""
    sizes = rows.groupBy("c").agg(F.count("*").alias("_size"))
    heads = rows.select("bucket", "c").join(sizes, "c").groupBy("bucket").agg(F.max(F.struct("_size", "c"))["c"].alias("main"), F.min("c").alias("_c"), F.max("c").alias("_d"))
    rows = rows.join(heads.where("_c <> _d").select("bucket", "main"), "bucket")
    x, y = rows.where("c <> main").alias("x"), rows.alias("y")
    once = (F.col("y.c") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    both = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.c") != F.col("y.c")) & once & may("x", "y"))
    return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


class Buckets:
    """keys: key, id. Only rows of buckets that several ids share are kept, with the bucket's pivot: its smallest id, or if
    central that whose buckets have the most rows in all."""

    def __init__(self, keys: DataFrame, name: str, *, central: bool = False):
        self.name = name
        shared = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_last")).where("pivot <> _last").drop("_last")
        shared = stored(shared, f"{name}-shared")
        some = marked(keys, F.col("key"), shared, "key").where("_hit")
        self.rows = stored(some.join(shared, "key").select("key", "id", "pivot").distinct(), f"{name}-buckets")
        if central:
            sizes = self.rows.groupBy("key").agg(F.count("*").alias("_n"))
            weights = self.rows.select("key", "id").join(sizes, "key").groupBy("id").agg(F.sum("_n").alias("_n"))
            pivots = self.rows.select("key", "id").join(weights, "id").groupBy("key").agg(F.max(F.struct("_n", "id"))["id"].alias("pivot"))
            self.rows = stored(self.rows.drop("pivot").join(pivots, "key").select("key", "id", "pivot"), f"{name}-central")

    def ids(self) -> DataFrame:
        """All ids that share a bucket with another one."""
        return self.rows.select("id").distinct()

    def linked(self, check: Check, rest: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(links found, id and component of every linked id).

        rest: gets key, id and c, the rows of buckets that hold several components besides the pivot, which has been held
        against all others, and gives the pairs that are still to be checked: all links between different components of
        these must be among them."""
        pairs = self.rows.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).where("a <> b").distinct()
        links = stored(check(pairs), f"{self.name}-links")
        found = stored(components(links), f"{self.name}-found")
        rows = stored(self.rows.where("id <> pivot").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")), f"{self.name}-rows")
        several = rows.groupBy("key").agg(F.min("c").alias("_c"), F.max("c").alias("_d")).where("_c <> _d").select("key")
        mixed = stored(rows.join(several, "key"), f"{self.name}-mixed")
        more = stored(check(rest(mixed).distinct()), f"{self.name}-more")
        if more.isEmpty():
            return links, found
        links = links.unionByName(more)
        return links, stored(components(links), f"{self.name}-found")
