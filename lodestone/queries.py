"""The engine's operators on the test tables, each beside the SQL it is held against.

The tables have no travel data: `part` stands in for a catalogue of places, `documents` and `benchmark` for texts and requests,
`embeddings` for dense vectors, `lineitem` for the edges of a graph, `events` for measurements. Every query reads its tables
whole. Sums of floating-point numbers are rounded, so that the order of summation doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import EngineConfig, Setting
from lodestone.functions import lookups as L
from lodestone.functions import scalars as S
from lodestone.functions import vectors as V
from lodestone.operators import catalog as K
from lodestone.operators import constraints as C
from lodestone.operators import graph as G
from lodestone.operators import metrics as M
from lodestone.operators import ranking as R
from lodestone.operators import refine as Z
from lodestone.operators import requests as Q
from lodestone.operators import retrieval as T
from lodestone.plans.evaluation import evaluate
from lodestone.plans.graphs import hybrid_graph, layered_graph
from lodestone.plans.recommend import HybridIndex, recommend

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Kinds of places that stand in for the types of parts.
KINDS = {"STANDARD": "hotel", "MEDIUM": "museum", "PROMO": "restaurant", "LARGE": "fort", "SMALL": "cafe", "ECONOMY": "beach"}


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as places."""
    p = table(spark, sf_dir, "part")
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    key = F.col("p_partkey")
    return p.select(
        key.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("state"), F.col("p_type").alias("district"), F.concat(F.lit("R"), (F.col("p_size") % 5).cast("string")).alias("region"),
        F.element_at(kinds, F.col("p_type")).alias("poi_type"), F.split("p_name", " ").alias("labels"), (F.col("p_size") / 5.0).alias("popularity"), F.col("p_retailprice").alias("price"),
        F.when(F.col("p_retailprice") < 930, "Budget").when(F.col("p_retailprice") < 970, "MidRange").otherwise("Luxury").alias("budget_tier"), _pick(("Easy", "Moderate", "Difficult"), F.col("p_size")).alias("accessibility"),
        (key % 7 == 0).alias("permits_required"), F.array(_pick(L.SEASONS, key)).alias("best_seasons"), F.array(_pick(L.SEASONS, key + 1)).alias("avoid_seasons"),
        F.array_distinct(F.array(_pick(L.REQUEST_TRIPS, key), _pick(L.REQUEST_TRIPS, F.col("p_size")))).alias("trip_types"),
        ((key * 37 % 290) / 10.0 + 8).alias("lat"), ((key * 53 % 290) / 10.0 + 68).alias("lon"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text_blob"),
    )


PLACES_SQL = """
places AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS state, p_type AS district, 'R' || (p_size % 5) AS region,
    CASE p_type WHEN 'STANDARD' THEN 'hotel' WHEN 'MEDIUM' THEN 'museum' WHEN 'PROMO' THEN 'restaurant' WHEN 'LARGE' THEN 'fort' WHEN 'SMALL' THEN 'cafe' ELSE 'beach' END AS poi_type,
    string_split(p_name, ' ') AS labels, p_size / 5::DOUBLE AS popularity, p_retailprice AS price,
    CASE WHEN p_retailprice < 930 THEN 'Budget' WHEN p_retailprice < 970 THEN 'MidRange' ELSE 'Luxury' END AS budget_tier,
    ['Easy', 'Moderate', 'Difficult'][(p_size % 3 + 1)::INT] AS accessibility, p_partkey % 7 = 0 AS permits_required,
    [['Winter', 'Summer', 'Monsoon', 'Post-Monsoon'][(p_partkey % 4 + 1)::INT]] AS best_seasons, [['Winter', 'Summer', 'Monsoon', 'Post-Monsoon'][((p_partkey + 1) % 4 + 1)::INT]] AS avoid_seasons,
    list_distinct([['Adventure', 'Beach', 'Cultural', 'Spiritual', 'Family', 'Wildlife', 'Food', 'Nature', 'Wellness', 'Photography'][(p_partkey % 10 + 1)::INT],
      ['Adventure', 'Beach', 'Cultural', 'Spiritual', 'Family', 'Wildlife', 'Food', 'Nature', 'Wellness', 'Photography'][(p_size % 10 + 1)::INT]]) AS trip_types,
    (p_partkey * 37 % 290) / 10::DOUBLE + 8 AS lat, (p_partkey * 53 % 290) / 10::DOUBLE + 68 AS lon
  FROM part
)"""

#: Requests with known words, for the operators on requests.
REQUESTS = (
    (1, "Best cultural places in Karnataka"), (2, "cheap beach trip near goa, india in winter"), (3, "luxury wellness resort for my family in north india"), (4, "Moderate trek without permit"),
    (5, "places to visit in TN"), (6, "food and dining in bombay"), (7, "a quiet hotel to stay"), (8, "冬 海滩 便宜"), (9, ""), (10, "heritage fort, museum and temple in up with family"),
    (11, "easy wildlife safari district coorg"), (12, "sightseeing destinations northeast in summer"),
)


def requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REQUESTS), "qid int, query string")


REQUESTS_SQL = "requests(qid, query) AS (VALUES " + ", ".join(f"({q}::INT, '{t}')" for q, t in REQUESTS) + ")"


# --- text retrieval ------------------------------------------------------------------------------------------------------
def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


BM25_SQL = """
toks AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM documents),
tot AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM toks),
post AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(ts) AS len, unnest(ts) AS term FROM toks) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post, tot GROUP BY term, n),
bag AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL)"""
_SCORE = "round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6)"


@register(f"""WITH {BM25_SQL},
s AS (SELECT qid, id, {_SCORE} AS score FROM post JOIN bag USING (term) JOIN terms USING (term), tot GROUP BY ALL)
SELECT qid, id, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 10""")
def bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = T.index_words(_documents(spark, sf_dir))
    scores = T.bm25_scores(index, T.query_terms(_benchmark(spark, sf_dir))).withColumn("score", F.round("score", 6))
    return R.top_k(scores, 10, "score", group=["qid"])


@register(f"""WITH {BM25_SQL},
s AS (SELECT qid, id, {_SCORE} AS score FROM post JOIN bag USING (term) JOIN terms USING (term), tot GROUP BY ALL),
best AS (SELECT qid, id FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5),
w AS (SELECT qid, term, round(sum(tf * idf), 6) AS weight FROM best JOIN post USING (id) JOIN terms USING (term) WHERE length(term) >= 3 GROUP BY ALL)
SELECT qid, term FROM w QUALIFY row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) <= 6""")
def bm25_feedback_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.feedback_terms(T.index_words(_documents(spark, sf_dir)), T.query_terms(_benchmark(spark, sf_dir)))


@register(f"""WITH {BM25_SQL},
s AS (SELECT qid, id, {_SCORE} AS score FROM post JOIN bag USING (term) JOIN terms USING (term), tot GROUP BY ALL),
best AS (SELECT qid, id FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5),
w AS (SELECT qid, term, round(sum(tf * idf), 6) AS weight FROM best JOIN post USING (id) JOIN terms USING (term) WHERE length(term) >= 3 GROUP BY ALL),
more AS (SELECT qid, term FROM w QUALIFY row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) <= 6),
grown AS (SELECT qid, term, sum(times) AS times FROM (SELECT * FROM bag UNION ALL SELECT qid, term, 1 FROM more) GROUP BY ALL),
s2 AS (SELECT qid, id, {_SCORE} AS score FROM post JOIN grown USING (term) JOIN terms USING (term), tot GROUP BY ALL)
SELECT qid, id, score FROM s2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 10""")
def bm25_with_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bm25_with_feedback(T.index_words(_documents(spark, sf_dir)), _benchmark(spark, sf_dir), 10)


@register(f"WITH {BM25_SQL} SELECT term, df, sum(tf)::BIGINT AS cf, round(idf, 6) AS idf FROM terms JOIN post USING (term) GROUP BY term, df, idf")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.index_words(_documents(spark, sf_dir)).terms.select("term", "df", "cf", F.round("idf", 6).alias("idf"))


@register(f"WITH {BM25_SQL} SELECT n, round(avg_len, 6) AS avg_len FROM tot")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.index_words(_documents(spark, sf_dir)).totals.select("n", F.round("avg_len", 6).alias("avg_len"))


_STOPS = "(" + ", ".join(f"'{w}'" for w in T.ENGLISH_STOPS) + ")"
TFIDF_SQL = """
c AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM t) GROUP BY ALL),
i AS (SELECT term, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM c, (SELECT count(*) AS n FROM t) GROUP BY term, n),
x AS (SELECT id, term, tf * idf AS x FROM c JOIN i USING (term)),
w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x),
qc AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM q) GROUP BY ALL),
qx AS (SELECT id, term, tf * idf AS x FROM qc JOIN i USING (term)),
qw AS (SELECT id AS qid, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS v FROM qx),
s AS (SELECT qid, id, round(sum(w * v), 6) AS score FROM w JOIN qw USING (term) GROUP BY ALL)
SELECT qid, id, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5"""


def _word_sql(column: str) -> str:
    ws = f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN {_STOPS})"
    return f"list_concat({ws}, list_transform(range(1, greatest(len({ws}), 1)), lambda i: ({ws})[i] || ' ' || ({ws})[i + 1]))"


@register(f"WITH t AS (SELECT doc_id AS id, {_word_sql('text')} AS ts FROM documents), q AS (SELECT item_id AS id, {_word_sql('text')} AS ts FROM benchmark), {TFIDF_SQL}")
def tfidf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = T.fit_tfidf(_documents(spark, sf_dir), "word")
    return R.top_k(T.tfidf_cosine(model, _benchmark(spark, sf_dir)).withColumn("score", F.round("score", 6)), 5, "score", group=["qid"])


def _char_sql(column: str) -> str:
    t = f"regexp_replace(lower(coalesce({column}, '')), '\\s+', ' ', 'g')"
    return "list_concat(" + ", ".join(f"list_transform(range(1, greatest(length({t}) - {n} + 2, 1)), lambda i: substr({t}, i, {n}))" for n in (2, 3, 4)) + ")"


@register(f"WITH t AS (SELECT item_id AS id, {_char_sql('text')} AS ts FROM benchmark), q AS (SELECT * FROM t), {TFIDF_SQL}")
def tfidf_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _benchmark(spark, sf_dir)
    model = T.fit_tfidf(b.select(F.col("qid").alias("id"), F.col("query").alias("text")), "char")
    return R.top_k(T.tfidf_cosine(model, b).withColumn("score", F.round("score", 6)), 5, "score", group=["qid"])


# --- vectors -------------------------------------------------------------------------------------------------------------
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_UNIT = "unit AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@register(f"""WITH {_UNIT}, s AS (SELECT a.id AS qid, b.id AS id, round(list_inner_product(a.v, b.v), 6) AS score FROM unit a, unit b WHERE a.id % 50 = 0)
SELECT qid, id, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 10""")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, ids divisible by 50, against all rows."""
    v = _vectors(spark, sf_dir)
    return T.vector_top_k(v, v.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query_vector")), 10, digits=6)


@register(f"WITH {_UNIT} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 5) AS similarity FROM unit a JOIN unit b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.8::DOUBLE")
def similar_vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.similar_pairs(_vectors(spark, sf_dir), 0.8).withColumn("similarity", F.round("similarity", 5))


@register(f"WITH {_UNIT} SELECT id, round(list_inner_product(v, v), 5) AS square, round(list_sum(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 5) AS unit_sum FROM unit")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("u", V.l2_normalise(F.col("vector")))
    return v.select("id", F.round(V.dot(F.col("vector"), F.col("vector")), 5).alias("square"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("unit_sum"))


# --- joins over places -----------------------------------------------------------------------------------------------------
@register(f"""WITH {PLACES_SQL}, d AS (SELECT a.id AS a, b.id AS b,
  pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM places a JOIN places b ON a.id < b.id)
SELECT a, b, distance_km FROM (SELECT a, b, round(6371 * 2 * atan2(sqrt(h), sqrt(1 - h)), 1) AS distance_km FROM d) WHERE distance_km <= 60""")
def near_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.near_pairs(catalog(spark, sf_dir), 60.0)


@register(f"""WITH {PLACES_SQL}, l AS (SELECT a.id, count(*) AS links FROM places a JOIN places b ON a.id <> b.id WHERE a.state = b.state OR len(list_intersect(a.labels, b.labels)) >= 2 GROUP BY a.id)
SELECT id, min(id) OVER (PARTITION BY state, list_sort(list_distinct(labels))) AS class_id, coalesce(links, 0) AS links FROM places LEFT JOIN l USING (id)""")
def kindred_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With how many others each place is of one brand or has two words in common, whatever their types, and its class."""
    return G.kindred_classes(catalog(spark, sf_dir))


# --- ranking ---------------------------------------------------------------------------------------------------------------
@register(f"""WITH {PLACES_SQL} SELECT id, round(CASE WHEN max(price) OVER w > min(price) OVER w THEN (price - min(price) OVER w) / (max(price) OVER w - min(price) OVER w) ELSE 0 END, 6) AS low,
  round(CASE WHEN max(popularity) OVER w > min(popularity) OVER w THEN (popularity - min(popularity) OVER w) / (max(popularity) OVER w - min(popularity) OVER w) ELSE 1 END, 6) AS high
FROM places WINDOW w AS (PARTITION BY state, district, region)""")
def min_max_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = ["state", "district", "region"]
    out = R.min_max(R.min_max(catalog(spark, sf_dir), "price", "low", group=group), "popularity", "high", group=group, constant=1.0)
    return out.select("id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register(f"""WITH {PLACES_SQL}, r AS (SELECT *, popularity / 10 AS s, count(*) OVER w AS n, min(popularity / 10) OVER w AS lo, max(popularity / 10) OVER w AS hi,
  row_number() OVER (PARTITION BY state, district ORDER BY popularity DESC, id) - 1 AS rk FROM places WINDOW w AS (PARTITION BY state, district))
SELECT id, round(CASE WHEN n = 1 THEN greatest(s, 0) ELSE 0.6::DOUBLE * CASE WHEN hi > lo THEN (s - lo) / (hi - lo) * least(hi, 1) ELSE greatest(s, 0) END + 0.4::DOUBLE * (n - rk) / n END, 6) AS score FROM r""")
def hybrid_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).withColumn("s", F.col("popularity") / 10)
    return R.hybrid_normalise(c, "s", "score", group=["state", "district"]).select("id", F.round("score", 6).alias("score"))


_CHANNELS = """
a AS (SELECT state AS qid, id, popularity AS score FROM places QUALIFY row_number() OVER (PARTITION BY state ORDER BY popularity DESC, id) <= 40),
b AS (SELECT state AS qid, id, -price AS score FROM places QUALIFY row_number() OVER (PARTITION BY state ORDER BY price, id) <= 40)"""


def _channels(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = c.select(F.col("state").alias("qid"), "id", F.col("popularity").alias("score"))
    b = c.select(F.col("state").alias("qid"), "id", (-F.col("price")).alias("score"))
    return R.top_k(a, 40, "score", group=["qid"]), R.top_k(b, 40, "score", group=["qid"])


@register(f"""WITH {PLACES_SQL}, {_CHANNELS}, ra AS (SELECT qid, id, 1 / (60::DOUBLE + row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)) AS x FROM a),
rb AS (SELECT qid, id, 1 / (60::DOUBLE + row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)) AS x FROM b)
SELECT qid, id, round((coalesce(ra.x, 0) + coalesce(rb.x, 0)) / 2, 8) AS rrf FROM ra FULL JOIN rb USING (qid, id)""")
def reciprocal_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = {n: R.reciprocal_rank(df, "score", "rr", group=["qid"]).select("qid", "id", F.col("rr").alias("score")) for n, df in zip("ab", _channels(catalog(spark, sf_dir)), strict=True)}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return R.fuse_channels(ready, ["qid", "id"]).select("qid", "id", F.round((zero("a") + zero("b")) / 2, 8).alias("rrf"))


@register(f"WITH {PLACES_SQL}, {_CHANNELS} SELECT qid, id, a.score AS a, b.score AS b FROM a FULL JOIN b USING (qid, id)")
def fused_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _channels(catalog(spark, sf_dir))
    return R.fuse_channels({"a": a, "b": b}, ["qid", "id"])


@register(f"WITH {PLACES_SQL} SELECT id, name, popularity FROM places QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY popularity DESC, id) = 1")
def best_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_by_name(catalog(spark, sf_dir), score="popularity").select("id", "name", "popularity")


@register(f"""WITH {PLACES_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY region) AS n, row_number() OVER (PARTITION BY region ORDER BY popularity DESC, price DESC, id) AS r FROM places)
SELECT region, id FROM r WHERE r <= least(200, greatest(50, floor(n * 0.1::DOUBLE)))""")
def capped_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.capped_slice(catalog(spark, sf_dir), "popularity", "price", group=["region"]).select("region", "id")


@register(f"""WITH {PLACES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY popularity DESC, id)::INT AS rank FROM places)
SELECT region, id, rank, array_to_string(list_filter(['ranked ' || rank || ' (top_k=5)', CASE WHEN popularity < 9.5 THEN 'unpopular' END, CASE WHEN price > 950 THEN 'expensive' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM r WHERE rank BETWEEN 6 AND 15""")
def just_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.ranked_out(catalog(spark, sf_dir), 5, "popularity", {"unpopular": F.col("popularity") < 9.5, "expensive": F.col("price") > 950}, group=["region"])
    return out.select("region", "id", "rank", F.array_join("reasons", "; ").alias("reasons"))


@register(f"""WITH {PLACES_SQL}, m AS (SELECT *, poi_type IN ('hotel', 'guest_house') AS p FROM places), n AS (SELECT *, sum(p::INT) OVER (PARTITION BY state) AS n FROM m)
SELECT state, id, row_number() OVER (PARTITION BY state ORDER BY p DESC, popularity DESC, id)::INT AS position FROM n WHERE n < 15 OR p""")
def preferred_kinds_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.preferred_first(catalog(spark, sf_dir), F.col("poi_type").isin(*L.STAY_KINDS), 15, "popularity", group=["state"]).select("state", "id", "position")


@register(f"WITH {PLACES_SQL} SELECT round(popularity / 10, 1) AS bucket, count(*) AS n FROM places GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(catalog(spark, sf_dir).select((F.col("popularity") / 10).alias("s")), "s")


# --- graph -----------------------------------------------------------------------------------------------------------------
def _supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and the brands of the parts they supply, weighted by quantity; brands lead back to suppliers of their own number. The edges are
    stored: the iterations on them read them often, and lineitem once."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    out = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.col("p_brand").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    back = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 1).cast("string")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dst"), F.lit(20.0).alias("weight"))
    edges = G.written(out.withColumn("relation", F.lit("SUPPLIES")).unionByName(back.withColumn("relation", F.lit("BACK"))), "supply")
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes, edges


SUPPLY_SQL = """
e AS (SELECT 's' || l_suppkey AS src, p_brand AS dst, sum(l_quantity) AS weight, 'SUPPLIES' AS relation FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 3 <> 0 GROUP BY ALL
  UNION ALL SELECT 'Brand#' || (s_nationkey + 1), 's' || s_suppkey, 20::DOUBLE, 'BACK' FROM supplier),
nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst),
both_ways AS (SELECT a AS u, b AS v FROM und UNION ALL SELECT b, a FROM und)"""


@register(f"WITH {SUPPLY_SQL} SELECT id, round(count(u) / greatest((SELECT count(*) FROM nodes) - 1, 1)::DOUBLE, 8) AS degree FROM nodes LEFT JOIN both_ways ON u = id GROUP BY id")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_centrality(*_supply(spark, sf_dir)).select("id", F.round("degree", 8).alias("degree"))


def _rank_sql(seeds: str, weight: str, rounds: int, alpha: float) -> str:
    """Fixed rounds; pr(i, id, r)."""
    return f"""WITH RECURSIVE {SUPPLY_SQL},
n AS (SELECT count(*)::DOUBLE AS n FROM nodes),
sd AS ({seeds}),
j AS (SELECT nodes.id, coalesce(sd.w / (SELECT sum(w) FROM sd), 0) AS jump, nodes.id NOT IN (SELECT src FROM e) AS sink FROM nodes LEFT JOIN sd USING (id)),
m AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, {weight} AS w FROM e)),
pr AS (
  SELECT 0 AS i, j.id, 1 / n AS r FROM j, n
  UNION ALL
  SELECT x.i + 1, j.id, {alpha}::DOUBLE * (coalesce(x.inflow, 0) + x.lost * j.jump) + (1 - {alpha}::DOUBLE) * j.jump
  FROM j JOIN (SELECT t.i, t.id, t.lost, f.inflow FROM (SELECT pr.i, pr.id, sum(CASE WHEN j.sink THEN pr.r ELSE 0 END) OVER (PARTITION BY pr.i) AS lost FROM pr JOIN j USING (id) WHERE pr.i < {rounds}) t
    LEFT JOIN (SELECT pr.i, m.dst AS id, sum(pr.r * m.p) AS inflow FROM pr JOIN m ON m.src = pr.id WHERE pr.i < {rounds} GROUP BY ALL) f ON f.i = t.i AND f.id = t.id) x ON x.id = j.id
)
SELECT id, round(r, 8) AS rank FROM pr WHERE i = {rounds}"""


@register(_rank_sql("SELECT id, 1::DOUBLE AS w FROM nodes", "weight", 12, 0.85))
def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _supply(spark, sf_dir)
    return G.page_rank(nodes, edges, rounds=12, tolerance=None, every=6).select("id", F.round("rank", 8).alias("rank"))


_SEEDS = "SELECT id, w FROM (VALUES ('Brand#1', 0.9::DOUBLE), ('s1', 0.5::DOUBLE), ('s2', 0.3::DOUBLE)) v(id, w)"


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Brand#1", 0.9), ("s1", 0.5), ("s2", 0.3)], "id string, score double")


def _variant(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, edges = _supply(spark, sf_dir)
        return G.page_rank_variant(name, nodes, edges, _seeds(spark), alpha=0.88, rounds=8, tolerance=None, every=4).select("id", F.round("rank", 8).alias("rank"))

    run.__name__ = f"page_rank_{name}"
    return run


register(_rank_sql(_SEEDS, "weight", 8, 0.88))(_variant("vanilla"))
register(_rank_sql(f"SELECT id, w * w AS w FROM ({_SEEDS})", "weight", 8, 0.88))(_variant("decay"))
register(_rank_sql(f"SELECT id, w FROM ({_SEEDS}) WHERE w >= 0.4", "weight", 8, 0.88))(_variant("truncated"))
register(_rank_sql(_SEEDS, "1::DOUBLE", 8, 0.88))(_variant("relation_weighted"))
register(None)(_variant("layer_aware"))


@register(f"""WITH RECURSIVE {SUPPLY_SQL}, k AS (SELECT 's1' AS id, 0 AS hops UNION SELECT v, hops + 1 FROM k JOIN both_ways ON u = id WHERE hops < 2)
SELECT id, min(hops)::INT AS hops FROM k GROUP BY id""")
def within_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _supply(spark, sf_dir)
    return G.reachable(edges, spark.createDataFrame([("s1",)], "id string"), 2)


@register(f"""WITH {SUPPLY_SQL}, t AS (SELECT 'Brand#1' AS target), p1 AS (SELECT src, target, 1 AS hops, [src, dst] AS path FROM e JOIN t ON dst = target),
p2 AS (SELECT e.src, target, 2 AS hops, list_prepend(e.src, path) AS path FROM e JOIN p1 ON e.dst = p1.src), p3 AS (SELECT e.src, target, 3 AS hops, list_prepend(e.src, path) AS path FROM e JOIN p2 ON e.dst = p2.src),
a AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
SELECT src, target, hops::INT AS hops, array_to_string(path, '>') AS path FROM a WHERE src <> target QUALIFY row_number() OVER (PARTITION BY src, target ORDER BY hops, path) = 1""")
def short_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _supply(spark, sf_dir)
    found = G.short_paths(edges, spark.createDataFrame([("Brand#1",)], "id string"))
    return found.select("src", "target", "hops", F.array_join("path", ">").alias("path"))


@register(f"""WITH {SUPPLY_SQL}, i AS (SELECT row_number() OVER (ORDER BY id) AS seq, id, state AS src, district AS dst, poi_type AS relation, price AS weight FROM (SELECT * FROM places)), {PLACES_SQL}
SELECT src, dst, arg_max(relation, seq) AS relation, min(seq) AS first_seq, arg_max(weight, seq) AS weight FROM i GROUP BY src, dst""".replace(f"WITH {SUPPLY_SQL}, i AS", f"WITH {PLACES_SQL}, i AS").replace(f", {PLACES_SQL}\nSELECT src", "\nSELECT src"))
def upserted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.renumbered(catalog(spark, sf_dir), "seq", ["id"])
    return G.upsert_edges(c.select("seq", F.col("state").alias("src"), F.col("district").alias("dst"), F.col("poi_type").alias("relation"), F.col("price").alias("weight")), ["weight"])


@register(f"""WITH {PLACES_SQL}, s AS (SELECT DISTINCT p.id FROM places p) SELECT 'node' AS what, t AS name, count(*) AS n FROM (
  SELECT 'destination' AS t, 'd' || id AS id FROM s UNION SELECT 'state', state FROM places UNION SELECT 'region', region FROM places UNION SELECT 'budget_tier', budget_tier FROM places
  UNION SELECT 'accessibility', accessibility FROM places UNION SELECT 'season', unnest(best_seasons) FROM places UNION SELECT 'trip_type', unnest(trip_types) FROM places) GROUP BY t""")
def hybrid_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = hybrid_graph(catalog(spark, sf_dir))
    return graph.nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "name", "n")


@register()
def layered_graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    p = c.select(F.col("id").alias("pos"), F.concat("name", F.lit(" "), F.col("id").cast("string")).alias("name"), "state", "district", "lat", "lon", "budget_tier", "accessibility", "best_seasons", "avoid_seasons", "trip_types", F.col("labels").alias("activities"), "popularity")
    return G.graph_statistics(*(lambda g: (g.nodes, g.edges))(layered_graph(p, radius_km=40.0, threshold=0.97, cap=4)))


@register()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.betweenness(*_supply(spark, sf_dir))


@register()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.communities(*_supply(spark, sf_dir))


@register()
def greedy_capped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.capped_pairs(T.similar_pairs(_vectors(spark, sf_dir), 0.8), 3)


# --- constraints -------------------------------------------------------------------------------------------------------------
@register(f"""WITH {PLACES_SQL}, f AS (SELECT *, poi_type IN ('fort') AND popularity >= 9.9 AND contains(lower(region), 'r1') AS a, poi_type IN ('fort') AND contains(lower(region), 'r1') AS b, contains(lower(region), 'r1') AS c FROM places),
n AS (SELECT *, sum(a::INT) OVER w AS na, sum(b::INT) OVER w AS nb, sum(c::INT) OVER w AS nc FROM f WINDOW w AS (PARTITION BY state))
SELECT state, id, CASE WHEN na > 0 THEN 'all' WHEN nb > 0 THEN 'kind and region' WHEN nc > 0 THEN 'region' ELSE 'unfiltered' END AS level, na = 0 AND nb = 0 AND nc = 0 AS fallback
FROM n WHERE CASE WHEN na > 0 THEN a WHEN nb > 0 THEN b WHEN nc > 0 THEN c ELSE true END""")
def relaxed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, region = F.col("poi_type") == "fort", F.contains(F.lower("region"), F.lit("r1"))
    out = C.relaxation_ladder(catalog(spark, sf_dir), [("all", kind & region & (F.col("popularity") >= 9.9)), ("kind and region", kind & region), ("region", region)], group=["state"])
    return out.select("state", "id", "level", "fallback")


@register(f"""WITH {PLACES_SQL}, r AS (SELECT *, list_filter([CASE WHEN budget_tier <> 'Budget' THEN 'budget_tier' END, CASE WHEN accessibility <> 'Easy' THEN 'accessibility' END,
  CASE WHEN NOT contains(lower(state), 'brand#1') THEN 'state' END, CASE WHEN NOT list_contains(best_seasons, 'Winter') THEN 'seasons' END], lambda x: x IS NOT NULL) AS reasons FROM places), n AS (SELECT *, count(*) FILTER (len(reasons) = 0) OVER (PARTITION BY region) AS n FROM r)
SELECT region, id, array_to_string(reasons, ',') AS reasons, n = 0 AS fallback FROM n WHERE n = 0 OR len(reasons) = 0""")
def filtered_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.layered_filter(catalog(spark, sf_dir).withColumn("climate", F.lit(None).cast("string")), {"budget_tier": ["Budget"], "accessibility": ["Easy"], "state": ["Brand#1"], "seasons": ["Winter"]}, group=["region"])
    return out.select("region", "id", F.array_join("reasons", ",").alias("reasons"), "fallback")


_ASKED = "asked(qid, c_season, c_trip_type, c_budget_tier, c_accessibility) AS (VALUES (1, 'Winter', 'Cultural', 'Budget', NULL), (2, NULL, 'Food', NULL, 'Easy'), (3, 'Monsoon', NULL, 'Luxury', 'Moderate'))"


def _asked(spark: SparkSession) -> DataFrame:
    rows = [(1, "Winter", "Cultural", "Budget", None), (2, None, "Food", None, "Easy"), (3, "Monsoon", None, "Luxury", "Moderate")]
    q = spark.createDataFrame(rows, "qid int, c_season string, c_trip_type string, c_budget_tier string, c_accessibility string")
    none = {"c_region": "string", "c_permit": "boolean", "c_location_terms": "array<string>", "c_intent_mode": "string", "c_trip_types": "array<string>"}
    return q.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})


@register(f"""WITH {PLACES_SQL}, {_ASKED}, s AS (SELECT qid, id, popularity,
  (CASE WHEN c_season IS NULL THEN 0 WHEN list_contains(best_seasons, c_season) THEN 1 WHEN NOT list_contains(avoid_seasons, c_season) THEN 0.2::DOUBLE ELSE 0 END + coalesce((c_trip_type IS NOT NULL AND list_contains(trip_types, c_trip_type))::INT, 0)
   + coalesce((c_budget_tier = budget_tier)::INT, 0) + coalesce((c_accessibility = accessibility)::INT, 0))
  / ((c_season IS NOT NULL)::INT + (c_trip_type IS NOT NULL)::INT + (c_budget_tier IS NOT NULL)::INT + (c_accessibility IS NOT NULL)::INT) AS share FROM places, asked)
SELECT qid::INT AS qid, id, round(0.72::DOUBLE * share + 0.2::DOUBLE * least(1, popularity / 10) + 0.05::DOUBLE * 0.3::DOUBLE, 6) AS score FROM s""")
def graph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    meets = catalog(spark, sf_dir).crossJoin(F.broadcast(_asked(spark)))  # three requests
    return meets.select("qid", "id", F.round(C.graph_score(F.lit(0.003)), 6).alias("score"))


@register(f"""WITH {PLACES_SQL}, {_ASKED}, m AS (SELECT qid, id, popularity, coalesce((c_season IS NOT NULL AND list_contains(best_seasons, c_season))::INT, 0) AS season, coalesce((c_trip_type IS NOT NULL AND list_contains(trip_types, c_trip_type))::INT, 0)
  + coalesce((c_budget_tier = budget_tier)::INT, 0) + coalesce((c_accessibility = accessibility)::INT, 0) AS matched, (c_season IS NOT NULL)::INT + (c_trip_type IS NOT NULL)::INT + (c_budget_tier IS NOT NULL)::INT + (c_accessibility IS NOT NULL)::INT AS total FROM places, asked)
SELECT qid::INT AS qid, id, round(CASE WHEN total >= 3 AND matched < 2 THEN 0 ELSE (matched + season) / total::DOUBLE END, 6) AS grade FROM m""")
def relevance_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).crossJoin(F.broadcast(_asked(spark))).select("qid", "id", F.round(C.relevance(), 6).alias("grade"))


@register(f"""WITH {PLACES_SQL}, {_ASKED}, e AS (SELECT qid, id, unnest([CASE WHEN c_season IS NOT NULL THEN {{'k': 'season', 'm': list_contains(best_seasons, c_season)}} END, CASE WHEN c_trip_type IS NOT NULL THEN {{'k': 'trip_type', 'm': list_contains(trip_types, c_trip_type)}} END,
  CASE WHEN c_budget_tier IS NOT NULL THEN {{'k': 'budget_tier', 'm': c_budget_tier = budget_tier}} END, CASE WHEN c_accessibility IS NOT NULL THEN {{'k': 'accessibility', 'm': c_accessibility = accessibility}} END]) AS s FROM places, asked)
SELECT qid::INT AS qid, id, s.k AS "constraint", s.m AS matched FROM e WHERE s IS NOT NULL""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).crossJoin(F.broadcast(_asked(spark))).select("qid", "id", F.explode(C.evidence_rows()).alias("e"))
    return rows.select("qid", "id", F.col("e.constraint").alias("constraint"), F.col("e.matched").alias("matched"))


@register(f"""WITH {PLACES_SQL}, c AS (SELECT state, poi_type, popularity >= 5 AS ok, CASE WHEN popularity >= 5 THEN 1 ELSE popularity / 10 END AS score, CASE WHEN id % 2 = 0 THEN 'hard' ELSE 'soft' END AS t FROM places)
SELECT state, poi_type, round(avg(ok::INT), 2) AS pass_rate, count(*) FILTER (ok) AS passed, count(*) AS total, round(coalesce(avg(ok::INT) FILTER (t = 'hard'), 1), 2) AS hard_pass_rate, round(coalesce(avg(ok::INT) FILTER (t = 'soft'), 1), 2) AS soft_pass_rate, round(avg(score), 3) AS avg_satisfaction
FROM c GROUP BY ALL""")
def validation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("popularity") >= 5
    checks = catalog(spark, sf_dir).select("state", "poi_type", ok.alias("satisfied"), F.when(ok, 1.0).otherwise(F.col("popularity") / 10).alias("score"), F.when(F.col("id") % 2 == 0, "hard").otherwise("soft").alias("constraint_type"))
    return C.validation(checks, "state", "poi_type")


# --- requests ----------------------------------------------------------------------------------------------------------------
def _like_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@register(f"""WITH {REQUESTS_SQL}, l AS (SELECT qid, query, lower(query) AS q FROM requests)
SELECT qid, CASE {" ".join(f"WHEN contains(q, '{s.lower()}') THEN '{s}'" for s in L.SEASONS)} {" ".join(f"WHEN contains(query, '{k}') THEN '{v}'" for k, v in L.SEASON_SIGNS.items())} END AS season,
  CASE {" ".join(f"WHEN regexp_matches(q, '\\b{k}\\b') THEN '{v}'" for k, v in L.BUDGET_WORDS.items())} {" ".join(f"WHEN contains(query, '{k}') THEN '{v}'" for k, v in L.BUDGET_SIGNS.items())} END AS budget_tier,
  CASE {" ".join(f"WHEN regexp_matches(q, '\\b{k}\\b') THEN '{v}'" for k, v in L.ACCESS_WORDS.items())} {" ".join(f"WHEN contains(query, '{k}') THEN '{v}'" for k, v in L.ACCESS_SIGNS.items())} END AS accessibility,
  CASE WHEN contains(q, 'without permit') OR contains(q, 'no permit') THEN false END AS permit, CASE {" ".join(f"WHEN contains(q, '{k}') THEN '{v}'" for k, v in L.REGION_PHRASES)} END AS region,
  CASE WHEN {_like_any("q", L.SIGHT_INTENT)} AND NOT {_like_any("q", L.FOOD_INTENT)} AND NOT {_like_any("q", L.STAY_INTENT)} THEN 'attraction_only' WHEN {_like_any("q", L.FOOD_INTENT)} AND NOT {_like_any("q", L.SIGHT_INTENT)} THEN 'food_only'
    WHEN {_like_any("q", L.STAY_INTENT)} AND NOT {_like_any("q", L.SIGHT_INTENT)} THEN 'stay_only' END AS intent_mode
FROM l""")
def parsed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_constraints(requests(spark)).select("qid", "season", "budget_tier", "accessibility", "permit", "region", "intent_mode")


@register()
def parsed_places_and_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.with_constraints(requests(spark))
    return out.select("qid", "trip_type", F.array_join("trip_types", ",").alias("trip_types"), F.array_join("location_terms", ",").alias("location_terms"), Q.constraint_count().alias("asked"))


@register(f"""WITH {REQUESTS_SQL}, l AS (SELECT qid, lower(query) AS q FROM requests), p(pref, word) AS (VALUES {", ".join(f"('{p}', '{w}')" for p, ws in L.ASKED_PREFERENCE.items() for w in ws)})
SELECT qid, coalesce(string_agg(DISTINCT pref, ',' ORDER BY pref), '') AS preferences FROM l LEFT JOIN p ON contains(q, word) GROUP BY qid""")
def asked_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark).select("qid", F.array_join(Q.asked_preferences(F.col("query")), ",").alias("preferences"))


@register(f"""WITH {REQUESTS_SQL}, l AS (SELECT qid, lower(query) AS q FROM requests), w(word, climate, pos) AS (VALUES {", ".join(f"('{w}', '{c}', {i})" for i, (w, c) in enumerate(L.ASKED_CLIMATE.items()))})
SELECT qid, arg_max(climate, length(word) * 1000 - pos) AS climate FROM l LEFT JOIN w ON contains(q, word) GROUP BY qid""")
def asked_climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark).select("qid", Q.asked_climate(F.col("query")).alias("climate"))


_NODE_ROWS = [(prefix + v, score, kind, w) for kind, (score, prefix, words) in L.NODE_WORDS.items() for w, v in words.items()] + [(f"State_{n}", L.STATE_SCORE, "State", w) for w, names in L.STATE_WORDS.items() for n in names]


@register(f"""WITH {REQUESTS_SQL}, d(id, score, kind, word) AS (VALUES {", ".join(f"('{i}', {s}::DOUBLE, '{k}', '{w}')" for i, s, k, w in _NODE_ROWS)})
SELECT qid, id, max(score) AS score, min(kind) AS node_type FROM requests JOIN d ON contains(lower(query), word) GROUP BY ALL""")
def matched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.createDataFrame([(i,) for i in sorted({r[0] for r in _NODE_ROWS})], "id string")
    return Q.node_matches(requests(spark), nodes)


@register(f"""WITH {REQUESTS_SQL}, t AS (SELECT qid, list_filter(regexp_split_to_array(lower(query), '[^a-z]+'), lambda x: x <> '') AS ts FROM requests),
s(word, others) AS (VALUES {", ".join(f"('{w}', {list(o[:3])})" for w, o in L.SYNONYMS.items())}),
a AS (SELECT qid, ts, unnest(range(1, len(ts) + 1)) AS i FROM t), m AS (SELECT qid, i, others FROM a JOIN s ON ts[i] = word WHERE ts[i] NOT IN {L.EXPANSION_STOPS}),
f AS (SELECT qid, flatten(list(others ORDER BY i)) AS more FROM m GROUP BY qid),
u AS (SELECT qid, list_concat(ts, coalesce(more, [])) AS terms FROM t LEFT JOIN f USING (qid)), p AS (SELECT qid, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM u), o AS (SELECT qid, term, min(pos) AS pos FROM p GROUP BY ALL)
SELECT u.qid, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS expanded FROM u LEFT JOIN o USING (qid) GROUP BY u.qid""")
def expanded_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark).select("qid", F.array_join(Q.expanded(F.col("query")), " ").alias("expanded"))


@register(f"""WITH {REQUESTS_SQL} SELECT qid, len(list_intersect(regexp_extract_all(lower(query), '[a-z'']+'), {list(L.PERSONAL_WORDS)})) > 0 OR {_like_any("query", L.PERSONAL_SIGNS)} AS personal,
  CASE WHEN list_contains(regexp_extract_all(lower(query), '[a-z'']+'), 'my') THEN 'my' WHEN contains(lower(query), 'with family') THEN 'with family' END AS marker FROM requests""")
def personal_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.taxonomy(requests(spark), ["my", "with family"])
    return out.select("qid", Q.is_personal(F.col("query")).alias("personal"), F.when(F.col("query_type") == "personal", F.regexp_replace("reason", "^marker: ", "")).alias("marker"))


@register("""WITH q AS (SELECT conv_id * 1000 + turn AS pos, trim(regexp_replace(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\s+,', ',', 'g'), ',\\s*', ', ', 'g')) AS query FROM conversations WHERE role = 'user' AND text IS NOT NULL),
v AS (SELECT *, instr(lower(query), ' in ') AS found, trim(substr(query, instr(lower(query), ' in ') + 4)) AS tail FROM q WHERE length(query) > 0),
k AS (SELECT * FROM v WHERE NOT (found > 0 AND (tail = '' OR starts_with(tail, ',') OR length(regexp_replace(lower(tail), '[^a-z]', '', 'g')) < 2))),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lower(query) ORDER BY pos) = 1)
SELECT row_number() OVER (ORDER BY pos) AS qid, query FROM o""")
def clean_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("text").alias("query"))
    return Q.clean_query_set(c).select("qid", "query")


# --- scalar functions ----------------------------------------------------------------------------------------------------------
@register("""SELECT event_id, CASE WHEN value < 10 THEN 'Cold' WHEN value <= 25 THEN 'Moderate' ELSE 'Hot' END AS climate, CASE WHEN value % 6 >= 4 THEN 'High' WHEN value % 6 >= 2 THEN 'Medium' ELSE 'Low' END AS level,
  CASE WHEN value / 100 >= 0.6 THEN 'high' WHEN value / 100 >= 0.4 THEN 'medium' ELSE 'low' END AS confidence, (props::JSON->>'k')::INT AS k, ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][((props::JSON->>'k')::INT % 12 + 1)::INT] AS month FROM events""")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", S.climate_band(F.col("value")).alias("climate"), S.preference_level(F.col("value") % 6).alias("level"), S.confidence_band(F.col("value") / 100).alias("confidence"), k.alias("k"), S.month_name(k % 12 + 1).alias("month"))


@register("""WITH m AS (SELECT user_id, hour(ts) // 2 + 1 AS month, avg(value) AS a FROM events GROUP BY ALL) SELECT user_id, round(sum(a) / 12, 6) AS yearly_mean, count(*) AS months FROM m GROUP BY user_id""")
def monthly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by two-hour slot as a JSON map of months, read back."""
    month = (F.floor(F.hour("ts") / 2) + 1).cast("string")
    e = table(spark, sf_dir, "events").groupBy("user_id", month.alias("m")).agg(F.avg("value").alias("a"))
    j = e.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("m", F.struct(F.col("a").alias("avg")))))).alias("json"))
    return j.select("user_id", F.round(S.yearly_mean(F.col("json")), 6).alias("yearly_mean"), F.size(S.monthly(F.col("json"))).cast("long").alias("months"))


@register(f"""WITH {PLACES_SQL} SELECT id, CASE WHEN (price + price * 2) / 2 < 1400 THEN 'Budget' WHEN (price + price * 2) / 2 < 1450 THEN 'Mid-Range' ELSE 'Luxury' END AS tier,
  CASE WHEN lon > 88 THEN 'East/Northeast' WHEN lat > 26 THEN 'North' WHEN lat < 15 AND lon > 72 THEN 'South' WHEN lon < 75 THEN 'West' ELSE 'Central' END AS zone,
  CASE poi_type WHEN 'hotel' THEN 'stay' WHEN 'museum' THEN 'heritage' WHEN 'fort' THEN 'heritage' WHEN 'beach' THEN 'beach' ELSE 'food' END AS category,
  round(1 + 9 * ln(1 + popularity) / ln(1 + max(popularity) OVER ()), 6) AS log_popularity,
  round(popularity + CASE WHEN poi_type = 'museum' THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN name = 'red widget' THEN 5 ELSE 0 END, 6) AS selection FROM places""")
def place_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    most = c.agg(F.max("popularity").alias("most"))
    middle = (F.col("price") + F.col("price") * 2) / 2
    return c.crossJoin(most).select(
        "id", F.when(middle < 1400, "Budget").when(middle < 1450, "Mid-Range").otherwise("Luxury").alias("tier"), S.region_of(F.col("lat"), F.col("lon")).alias("zone"), S.kind_category(F.col("poi_type")).alias("category"),
        F.round(S.log_popularity(F.col("popularity"), F.col("most")), 6).alias("log_popularity"), F.round(S.selection_score(F.col("popularity"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("poi_type"), F.col("name") == "red widget"), 6).alias("selection"),
    )


@register(f"""WITH {PLACES_SQL}, v AS (SELECT id, list_concat([{", ".join(f"list_contains(trip_types, '{t}')::INT::DOUBLE" for t in L.TRIP_TYPES)}], [{", ".join(f"list_contains(best_seasons, '{s}')::INT::DOUBLE" for s in L.SEASONS)}],
  [CASE accessibility WHEN 'Easy' THEN 3 WHEN 'Moderate' THEN 2 ELSE 1 END / 3::DOUBLE, least((lat * 100) / 5000, 1), popularity / 10, 0.5::DOUBLE]) AS v FROM places)
SELECT id, len(v)::INT AS dims, round(list_sum(v), 6) AS total, round(sqrt(list_inner_product(v, v)), 6) AS length FROM v""")
def profile_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.profile_vector(F.col("trip_types"), F.col("best_seasons"), F.col("accessibility"), F.col("lat") * 100, F.col("popularity"), F.lit(None).cast("double"))
    c = catalog(spark, sf_dir).select("id", v.alias("v"))
    return c.select("id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(V.norm(F.col("v")), 6).alias("length"))


@register(f"WITH {PLACES_SQL} SELECT id, least(1, (id % 5) / 3::DOUBLE) AS images, round(0.85::DOUBLE * popularity / 10 + 0.15::DOUBLE * least(1, (id % 5) / 3::DOUBLE), 3) AS blended FROM places WHERE id % 5 > 0")
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id") % 5
    return catalog(spark, sf_dir).where(n > 0).select("id", S.image_score(n).alias("images"), S.blended_score(F.col("popularity") / 10, n).alias("blended"))


# --- aggregations ------------------------------------------------------------------------------------------------------------------
@register(f"""WITH {PLACES_SQL}, b AS (SELECT *, id AS seq FROM places) SELECT name, state, count(*) AS mentions, array_to_string(list_sort(list_distinct(flatten(list(trip_types)))), ',') AS trip_types, arg_min(lat, seq) FILTER (lat <> 8) AS lat, arg_min(price, seq) AS price FROM b GROUP BY name, state""")
def merged_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return c.groupBy("name", "state").agg(F.count("*").alias("mentions"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("trip_types")))), ",").alias("trip_types"), F.min_by(F.when(F.col("lat") != 8, F.col("lat")), F.when(F.col("lat") != 8, F.col("id"))).alias("lat"), F.min_by("price", "id").alias("price"))


@register()
def balanced_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return K.balanced_selection(c, 800, iconic=["red widget"]).select("id", "pick")


@register(f"WITH {PLACES_SQL} SELECT field, filled, round(filled / n::DOUBLE, 6) AS share FROM (SELECT count(*) AS n, count(name) AS name, count(CASE WHEN id % 3 > 0 THEN price END) AS price FROM places) UNPIVOT (filled FOR field IN (name, price))")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).select("name", F.when(F.col("id") % 3 > 0, F.col("price")).alias("price"))
    return K.coverage(c).withColumn("share", F.round("share", 6))


# --- metrics -------------------------------------------------------------------------------------------------------------------------
_TRUTH = f"""{_UNIT}, lab AS (SELECT vec_id AS id, label FROM embeddings), s AS (SELECT a.id AS qid, b.id AS id, round(list_inner_product(a.v, b.v), 6) AS score FROM unit a, unit b WHERE a.id % 50 = 0 AND a.id <> b.id),
rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20),
rel AS (SELECT q.id AS qid, d.id AS id, CASE WHEN q.label = d.label THEN CASE WHEN d.id % 3 = 0 THEN 1.0::DOUBLE WHEN d.id % 3 = 1 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END ELSE 0 END AS grade FROM lab q, lab d WHERE q.id % 50 = 0 AND q.id <> d.id AND q.label = d.label)"""


@register(f"""WITH {_TRUTH}, j AS (SELECT rk.qid, rk.id, rank, coalesce(grade, 0) AS g, (coalesce(grade, 0) >= 0.5)::INT AS r FROM rk LEFT JOIN rel USING (qid, id)), c AS (SELECT *, sum(r) OVER (PARTITION BY qid ORDER BY rank) AS cum FROM j),
h AS (SELECT qid, sum(r) FILTER (rank <= 5) AS hits, count(*) FILTER (rank <= 5) AS got, sum(g / log2(rank + 1)) FILTER (rank <= 5) AS dcg, min(rank) FILTER (r = 1) AS first, sum(cum / rank::DOUBLE) FILTER (rank <= 5 AND r = 1) AS ps FROM c GROUP BY qid),
i AS (SELECT qid, count(*) FILTER (grade >= 0.5) AS relevant, sum(grade / log2(r + 1)) FILTER (r <= 5) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS r FROM rel) GROUP BY qid)
SELECT qid, round(hits / least(5, got)::DOUBLE, 6) AS "precision", round(CASE WHEN relevant > 0 THEN hits / relevant::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg, round(coalesce(1 / first::DOUBLE, 0), 6) AS mrr, (hits > 0)::INT::DOUBLE AS hit_rate,
  round(CASE WHEN relevant > 0 THEN coalesce(ps, 0) / least(relevant, 5) ELSE 0 END, 6) AS average_precision FROM i JOIN h USING (qid)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search held against equal labels with graded relevance."""
    v = _vectors(spark, sf_dir)
    q = v.where("id % 50 = 0")
    best = T.vector_top_k(v, q.select(F.col("id").alias("qid"), F.col("vector").alias("query_vector")), 21, digits=6).where("qid <> id")
    best = R.top_k(best, 20, "score", group=["qid"])
    from pyspark.sql import Window as W

    ranked = best.select("qid", "id", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "id")).alias("rank"))
    grade = F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, 0.6).otherwise(0.3)
    truth = q.select(F.col("id").alias("qid"), "label").join(v.select("id", "label"), "label").where("qid <> id").select("qid", "id", grade.alias("grade"))
    out = M.ranked_metrics(ranked, truth, 5)
    return out.select("qid", *(F.round(c, 6).alias(c) for c in out.columns if c != "qid"))


@register(f"""WITH {PLACES_SQL}, r AS (SELECT 'S' || (id % 4) AS setting, CASE WHEN p.id % 2 = 0 THEN 'city' ELSE 'broad' END AS query_type, popularity / 10 AS precision_at_5, price / 1000 AS recall_at_20, popularity / 12 AS ndcg_at_5, price / 1100 AS coverage_at_5, popularity / 11 AS diversity_at_5, (id % 3)::INT AS discarded FROM places p)
SELECT setting, query_type, round(avg(precision_at_5), 6) AS precision_at_5, round(avg(recall_at_20), 6) AS recall_at_20, round(avg(ndcg_at_5), 6) AS ndcg_at_5, round(avg(coverage_at_5), 6) AS coverage_at_5, round(avg(diversity_at_5), 6) AS diversity_at_5, round(avg(discarded), 6) AS discarded_avg,
  round(0.35::DOUBLE * avg(recall_at_20) + 0.25::DOUBLE * avg(ndcg_at_5) + 0.20::DOUBLE * avg(precision_at_5) + 0.10::DOUBLE * avg(coverage_at_5) + 0.10::DOUBLE * avg(diversity_at_5), 6) AS weighted_score
FROM r GROUP BY GROUPING SETS ((setting), (setting, query_type))""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).select(F.concat(F.lit("S"), (F.col("id") % 4).cast("string")).alias("setting"), F.when(F.col("id") % 2 == 0, "city").otherwise("broad").alias("query_type"), (F.col("popularity") / 10).alias("precision_at_5"), (F.col("price") / 1000).alias("recall_at_20"), (F.col("popularity") / 12).alias("ndcg_at_5"), (F.col("price") / 1100).alias("coverage_at_5"), (F.col("popularity") / 11).alias("diversity_at_5"), (F.col("id") % 3).cast("int").alias("discarded"))
    out = M.summary(rows)
    return out.select("setting", "query_type", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("setting", "query_type")))


@register(f"""WITH {PLACES_SQL} SELECT state, round(count(DISTINCT region) / count(*)::DOUBLE, 9) AS coverage, round(len(list_distinct(flatten(list(trip_types)))) / (count(*) * 2)::DOUBLE, 9) AS diversity, round(avg(greatest(0, 1 - popularity / 10)), 9) AS novelty,
  round(avg((poi_type = 'hotel')::INT), 9) AS intent_consistency, round(avg(price / 1000), 9) AS grounding, round(avg((price / 1000 < 0.5)::INT), 9) AS violation_rate, round(avg(popularity / 10), 9) AS confidence_mean, round(stddev_pop(popularity / 10), 9) AS confidence_std FROM places GROUP BY state""")
def list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).select("state", "region", "trip_types", "popularity", (F.col("price") / 1000).alias("share"), (F.col("poi_type") == "hotel").alias("suits"), (F.col("popularity") / 10).alias("confidence"))
    out = M.list_quality(c, group=["state"])
    return out.select("state", *(F.round(c, 9).alias(c) for c in out.columns if c != "state"))


# --- refinement and whole plans ------------------------------------------------------------------------------------------------------
_REFINE_IN = "c AS (SELECT id, popularity / 10 AS confidence, (id % 10) / 10::DOUBLE AS s_sem, (id % 7) / 7::DOUBLE AS s_graph, (id % 4)::INT AS evidence_total, (id % 5) / 4::DOUBLE AS share, CASE WHEN id % 3 > 0 THEN (id % 11) / 10::DOUBLE END AS np FROM places)"


@register(f"""WITH {PLACES_SQL}, {_REFINE_IN}, s1 AS (SELECT *, CASE WHEN evidence_total > 0 THEN least(1, greatest(0, least(1, confidence + 0.12::DOUBLE * (share - 0.5::DOUBLE))) + CASE WHEN share >= 0.6 THEN 0.06::DOUBLE ELSE 0 END) ELSE confidence END AS c1 FROM c),
s2 AS (SELECT *, CASE WHEN s_sem >= 0.62 AND c1 < 0.55 THEN least(1, c1 + 0.06::DOUBLE) ELSE c1 END AS c2, least(0.12::DOUBLE, coalesce(np, 0) * 0.12::DOUBLE) AS g FROM s1),
s3 AS (SELECT *, CASE WHEN c2 >= 0.55 THEN 'a' WHEN c2 < 0.2 AND s_sem < 0.2 AND s_graph < 0.2 AND share < 0.25 THEN 'd' ELSE 'o' END AS st, least(1, c2 + g) AS l1 FROM s2),
s4 AS (SELECT *, CASE WHEN st <> 'o' THEN c2 WHEN l1 >= 0.55 THEN l1 ELSE least(1, l1 + g) END AS refined, CASE WHEN st <> 'o' THEN 0 WHEN l1 >= 0.55 THEN 1 ELSE 2 END AS iterations FROM s3)
SELECT id, round(refined, 6) AS refined, iterations::INT AS iterations, CASE st WHEN 'a' THEN true WHEN 'd' THEN false ELSE refined >= 0.55 OR NOT (refined < 0.2 AND share < 0.35 AND s_sem < 0.3) END AS accepted FROM s4""")
def refined_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    c = catalog(spark, sf_dir).select("id", (F.col("popularity") / 10).alias("confidence"), (key % 10 / 10).alias("s_sem"), (key % 7 / 7).alias("s_graph"), (key % 4).cast("int").alias("evidence_total"), (key % 5 / 4).alias("share"), F.when(key % 3 > 0, key % 11 / 10).alias("neighbour_popularity"))
    return Z.refine(c).select("id", F.round("refined", 6).alias("refined"), "iterations", "accepted")


@register(f"""WITH {PLACES_SQL}, r AS (SELECT state, id, popularity / 10 AS confidence, row_number() OVER (PARTITION BY state ORDER BY popularity DESC, id) AS pos FROM places), t AS (SELECT * FROM r WHERE pos <= 30),
nb AS (SELECT id AS src, unnest([id + 25, id + 50, id - 25]) AS dst FROM places), s AS (SELECT t.state, t.id, count(DISTINCT dst) AS n FROM t JOIN nb ON src = t.id JOIN t u ON u.state = t.state AND u.id = dst GROUP BY ALL)
SELECT state, r.id, round(CASE WHEN pos <= 30 THEN least(1, confidence + least(0.08::DOUBLE, 0.01::DOUBLE * coalesce(n, 0))) ELSE confidence END, 6) AS confidence FROM r LEFT JOIN s USING (state, id)""")
def coherent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir).select("state", "id", (F.col("popularity") / 10).alias("confidence"))
    near = c.select(F.col("id").alias("src"), F.explode(F.array(F.col("id") + 25, F.col("id") + 50, F.col("id") - 25)).alias("dst"))
    return Z.coherence_boost(c, near, 30, group=["state"]).select("state", "id", F.round("confidence", 6).alias("confidence"))


@register()
def diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    c = catalog(spark, sf_dir).withColumn("confidence", F.col("popularity") / 10).withColumn("qid", F.col("region"))
    pool = c.select("qid", F.row_number().over(W.partitionBy("qid").orderBy(F.col("confidence").desc(), "id")).alias("position"), "id", "confidence", "popularity", "state", "district", "region", "trip_types")
    return Z.diversify(pool.where("position <= 90"), 15).select("qid", "id", "pick")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir)


@register()
def recommended_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole hybrid plan for all requests."""
    index = HybridIndex.build(_places(spark, sf_dir))
    return recommend(index, requests(spark)).select("qid", "id", "pick", "final_rank", F.round("refined", 6).alias("refined"), "accepted")


@register()
def evaluated_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ablation over the request set, summed up."""
    index = HybridIndex.build(_places(spark, sf_dir))
    rows = evaluate(index, requests(spark).withColumn("category", F.lit("test")), ("full", "no_graph"), EngineConfig())
    return M.summary(rows).drop("runtime_sec")


SETTINGS = tuple(Setting.named(n) for n in ("full", "no_graph", "no_semantic", "no_refinement", "no_personalization"))
