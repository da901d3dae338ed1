"""Catalogue building: tagged map nodes and record maps to one clean table of places, balanced over states, kinds and regions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lookups as L
from lodestone.functions import scalars as S
from lodestone.operators.ranking import best_of, renumbered

#: Rows that balanced selection takes at most: its counters are sequential, so that one task walks over all of them.
MOST_ROWS = 2_000_000


def places_from_tags(nodes: DataFrame) -> DataFrame:
    """nodes: osm_id, lat, lon, tags (map). Named places of allowed kinds, whose name isn't a filler or that of their state or
    city, with derived columns."""
    tag = lambda *keys: F.coalesce(*(F.when(S.squash(F.element_at("tags", k)) != "", S.squash(F.element_at("tags", k))) for k in keys))
    named = nodes.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("tags").isNotNull()).select(
        "osm_id", "lat", "lon", "tags", tag("name:en", "name").alias("name"), S.tag_kind(F.col("tags")).alias("poi_type"),
        S.or_unknown(tag("addr:state", "is_in:state")).alias("state"), S.or_unknown(tag("addr:district", "addr:city", "is_in:city")).alias("district"),
    )
    lowered = F.lower("name")
    kept = named.where(F.col("poi_type").isNotNull() & F.col("name").isNotNull() & ~lowered.isin(*L.BAD_NAMES) & (lowered != F.lower("state")) & (lowered != F.lower("district")))
    blob = F.concat_ws(" ", F.map_keys("tags"), F.map_values("tags"), "name")
    return kept.select(
        "osm_id", "name", lowered.alias("name_norm"), "state", "district", "lat", "lon", S.region_of(F.col("lat"), F.col("lon")).alias("region"), "poi_type",
        S.labels_by_words(blob, L.TAG_TRIPS, "Cultural").alias("trip_types"), S.tag_access(F.col("tags")).alias("accessibility"), S.tag_popularity(F.col("tags")).alias("popularity"),
        F.element_at("tags", "wikidata").alias("wikidata"), F.element_at("tags", "wikipedia").alias("wikipedia"),
    )


def distinct_places(places: DataFrame, order: str = "osm_id") -> DataFrame:
    """One row for each lower-case name and position (to five decimals), the first; ids anew from 1."""
    one = best_of(places, [F.lower("name"), F.round("lat", 5), F.round("lon", 5)], [order])
    return renumbered(one.drop("id"), "id", [order])


def with_seeds(places: DataFrame, seeds: DataFrame) -> DataFrame:
    """The places and those seeds whose name isn't among them."""
    have = places.select(F.lower(F.trim("name")).alias("_k")).distinct()
    missing = seeds.join(have, F.lower(F.trim(seeds["name"])) == F.col("_k"), "left_anti")
    return places.unionByName(missing, allowMissingColumns=True)


def places_from_records(pois: DataFrame, queries_col: str = "query") -> DataFrame:
    """pois: seq, query and name, city, description, address, duration, lat, lon of each mention. One place for each name and city:
    mentions counted, kinds and seasons united, the first description, address and position that isn't empty, the first
    duration; popularity from the mentions; ids by popularity."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = pois.select(
        "seq", clean(F.col("name")).alias("name"), F.when(clean(F.col("city")) == "", "Unknown").otherwise(clean(F.col("city"))).alias("city"), clean(F.col("description")).alias("description"),
        clean(F.col("address")).alias("address"), S.visit_length(F.col("duration"))[1].alias("ideal"), F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"), S.seasons_in(F.col(queries_col)).alias("seasons"),
    ).where("name <> ''")
    rows = rows.withColumn("trips", S.labels_by_words(F.concat_ws(" ", "name", "description", "address"), L.TEXT_TRIPS, "Cultural"))
    first = lambda c, empty: F.coalesce(F.min_by(F.when(F.col(c) != empty, F.col(c)), F.when(F.col(c) != empty, F.col("seq"))), F.lit(empty)).alias(c)
    one = rows.groupBy("name", "city").agg(
        F.count("*").alias("mentions"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("trips")))).alias("trip_types"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("seasons")))).alias("best_seasons"),
        first("description", ""), first("address", ""), first("lat", 0.0), first("lon", 0.0), F.min_by("ideal", "seq").alias("ideal_days"), F.min("seq").alias("seq"),
    )
    most = one.agg(F.max("mentions").alias("_most"))
    least_days, most_days = S.stay_range(F.col("ideal_days"))
    all_seasons = F.array(*(F.lit(s) for s in ("Spring", "Summer", "Autumn", "Winter")))
    out = one.crossJoin(most).select(
        "name", F.col("city").alias("state"), F.col("city").alias("district"), "lat", "lon", "trip_types", F.when(F.size("best_seasons") > 0, F.col("best_seasons")).otherwise(all_seasons).alias("best_seasons"),
        F.round(S.log_popularity(F.col("mentions"), F.col("_most")), 2).alias("popularity"), "ideal_days", least_days.alias("minimum_days"), most_days.alias("maximum_days"), "description", "address", "mentions", "seq",
    )
    return renumbered(out, "id", [F.col("mentions").desc(), "seq"]).drop("seq")


class _Selection:
    """Rows taken so far, with the counters that bound what may still be taken."""

    def __init__(self, rows: list[dict], target: int, per_state: int, caps: Mapping[str, int]):
        self.rows, self.target, self.per_state, self.caps = rows, target, per_state, caps
        self.taken: list[dict] = []
        self.known: set[tuple] = set()
        self.states, self.kinds, self.categories = Counter(), Counter(), Counter()

    @property
    def full(self) -> bool:
        return len(self.taken) >= self.target

    @staticmethod
    def identity(row: dict) -> tuple:
        return row["name"], row["lat"], row["lon"]

    def add(self, row: dict, *, capped: bool = True) -> bool:
        """Take a row unless it is there already or its kind is used up."""
        if self.identity(row) in self.known or capped and self.kinds[row["kind"]] >= self.caps.get(row["kind"], self.target + 1):
            return False
        self.taken.append(row)
        self.known.add(self.identity(row))
        self.states[row["state"]] += 1
        self.kinds[row["kind"]] += 1
        self.categories[row["category"]] += 1
        return True


def _by_size(rows: Iterable[dict], key: str) -> list[tuple[str, list[dict]]]:
    groups: dict[str, list[dict]] = {}
    for r in rows:
        groups.setdefault(r[key], []).append(r)
    return sorted(groups.items(), key=lambda g: -len(g[1]))


def _choose(rows: list[dict], target: int, per_state: int | None) -> list[dict]:
    if len(rows) <= target:
        return rows
    share = lambda least, part: max(least, target // part)
    caps = {"restaurant": share(90, 18), "fast_food": share(45, 35), "cafe": share(60, 30), "hotel": share(170, 12), "guest_house": share(90, 20)}
    wanted = {"heritage": share(120, 10), "nature": share(120, 10), "beach": share(80, 14), "wildlife": share(60, 20), "spiritual": share(80, 14), "stay": share(200, 8), "food": share(200, 8), "entertainment": share(60, 20)}
    s = _Selection(rows, target, per_state or share(70, 25), caps)
    best = lambda some: sorted(some, key=lambda r: -r["score"])
    states = [(name, best(some)) for name, some in _by_size(rows, "state")]

    for row in rows:  # must-haves, whatever the caps
        if row["iconic"] and not s.full:
            s.add(row, capped=False)
    for _, some in states:  # the best of each state
        if not s.full:
            s.add(some[0])
    for _, some in _by_size(rows, "region"):  # up to 15 of each region, in the order of the input
        if s.full:
            break
        added = 0
        for row in some:
            added += s.add(row)
            if added >= 15:
                break
    for category, least in wanted.items():  # the least of each category
        for row in best(r for r in rows if r["category"] == category):
            if s.full or s.categories[category] >= least:
                break
            s.add(row)
    at = {name: 1 for name, _ in states}
    moved = True
    while moved and not s.full:  # round robin over the states; a round that adds nothing ends it
        moved = False
        for name, some in states:
            if s.full:
                break
            if s.states[name] < s.per_state and at[name] < len(some):
                at[name] += 1
                moved = s.add(some[at[name] - 1]) or moved
    if not s.full:  # the best of the rest, without caps
        s.taken += [r for r in best(rows) if s.identity(r) not in s.known][: target - len(s.taken)]
    return s.taken[:target]


def balanced_selection(places: DataFrame, target: int, *, per_state: int | None = None, iconic: Sequence[str] = (), order: str = "id") -> DataFrame:
    """`target` places over all states, regions and categories; iconic: lower-case names that must be in. Adds pick. The counters
    of the selection depend on each other row by row, so that one task walks over the catalogue, whose size is checked."""
    if (n := places.count()) > MOST_ROWS:
        raise ValueError(f"{n} rows: balanced selection takes up to {MOST_ROWS}; cut the scan first")
    names = [x.lower() for x in iconic]
    ready = places.withColumn("_iconic", F.lower("name").isin(*names) if names else F.lit(False)).withColumn("_category", S.kind_category(F.col("poi_type")))
    ready = ready.withColumn("_score", S.selection_score(F.col("popularity"), F.col("wikidata") if "wikidata" in places.columns else F.lit(None), F.col("wikipedia") if "wikipedia" in places.columns else F.lit(None), F.col("poi_type"), F.col("_iconic")))
    thin = ready.select(F.col(order).alias("order"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("state", F.lit("Unknown")).alias("state"), F.coalesce("region", F.lit("Central")).alias("region"), F.lower(F.coalesce("poi_type", F.lit("poi"))).alias("kind"), "lat", "lon", F.col("_iconic").alias("iconic"), F.col("_category").alias("category"), F.col("_score").alias("score"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        picked = _choose(rows.sort_values("order").to_dict("records"), target, per_state)
        return pd.DataFrame({"order": [r["order"] for r in picked], "pick": range(1, len(picked) + 1)})

    kind = places.schema[order].dataType.simpleString()
    picks = thin.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(choose, f"order {kind}, pick int")
    return places.join(picks, places[order] == picks.order).drop("order")


def query_set(records: DataFrame) -> DataFrame:
    """records: seq, query. Numbered requests, personal if they speak of the one who asks."""
    personal = F.exists(F.array(*map(F.lit, L.PERSONAL_SIGNS)), lambda s: F.contains("query", s))
    return records.where(F.trim("query") != "").select(F.col("seq").alias("qid"), F.when(personal, "personal").otherwise("generic").alias("category"), F.trim("query").alias("query"))


def coverage(df: DataFrame) -> DataFrame:
    """field, filled, share: how many rows have a value in each column."""
    counts = df.agg(F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    return counts.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("filled")) for c in df.columns))).alias("f")).select("f.field", "f.filled", (F.col("f.filled") / F.col("n")).alias("share"))
