"""Operators on literals, against values worked out by hand or by plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.config import EngineConfig, Setting
from lodestone.functions import scalars as S
from lodestone.operators import catalog as K
from lodestone.operators import constraints as C
from lodestone.operators import graph as G
from lodestone.operators import metrics as M
from lodestone.operators import ranking as R
from lodestone.operators import refine as Z
from lodestone.operators import requests as Q
from lodestone.operators import retrieval as T


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


# --- settings ------------------------------------------------------------------------------------------------------------
def test_settings():
    assert EngineConfig().pool_k == 90 and EngineConfig().raw_k == 15
    assert EngineConfig.from_mapping({"retrieval": {"semantic_weight": 0.4, "graph_weight": 0.6}, "other": 1}).graph_weight == 0.6
    with pytest.raises(ValueError):
        EngineConfig(semantic_weight=0.9)
    assert Setting.named("no_graph").weights(EngineConfig()) == (1.0, 0.0) and Setting.named("no_semantic").weights(EngineConfig()) == (0.0, 1.0)


# --- scalars -------------------------------------------------------------------------------------------------------------
def test_scalars(spark):
    assert one(spark, F.array(*(S.climate_band(F.lit(x)) for x in (9.9, 10, 25, 25.1)))) == ["Cold", "Moderate", "Moderate", "Hot"]
    assert one(spark, F.array(*(S.preference_level(F.lit(x)) for x in (4, 3, 2, 1)))) == ["High", "Medium", "Medium", "Low"]
    winter = lambda text: one(spark, S.winter_climate(F.create_map(F.lit("winter"), F.lit(text))))
    assert [winter(t) for t in ("2-9°C", "10-20°C", "15-25°C", "26-30C", "-5-10°C", "warm")] == ["Cold", "Cool", "Moderate", "Tropical", "Moderate", "Moderate"]
    assert one(spark, S.yearly_mean(F.lit('{"1": {"avg": 12.0}, "2": {"avg": 24.0}}'))) == 3.0
    assert one(spark, F.array(*S.visit_length(F.lit("2-5 days")))) == [2, 5] and one(spark, F.array(*S.visit_length(F.lit(None).cast("string")))) == [1, 3] and one(spark, F.array(*S.visit_length(F.lit("9")))) == [9, 7]
    assert one(spark, S.normal_state(F.lit(" Pune Division "))) == "Maharashtra" and one(spark, S.normal_state(F.lit(""))) == "Unknown"
    assert one(spark, S.normal_query(F.lit("  food  in Goa ,India "))) == "food in Goa, India"
    assert one(spark, S.invalid_place(F.lit("food in , 123"))) and one(spark, S.invalid_place(F.lit("food in x1"))) and not one(spark, S.invalid_place(F.lit("food in Goa")))
    tags = F.create_map(*(F.lit(x) for x in ("tourism", "museum", "wikidata", "Q1", "website", "w", "wheelchair", "yes")))
    assert one(spark, S.tag_popularity(tags)) == 7.4 and one(spark, S.tag_access(tags)) == "Easy" and one(spark, S.tag_kind(tags)) == "museum"
    assert one(spark, S.haversine_km(F.lit(28.6), F.lit(77.2), F.lit(19.07), F.lit(72.87))) == pytest.approx(1150, abs=15)
    assert one(spark, S.budget_tier_of(F.array(F.lit(500.0)), F.array(F.lit(1.0), F.lit(2000.0)))) == "Budget" and one(spark, S.budget_tier_of(F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>"))) == "Mid-Range"
    vector = one(spark, S.profile_vector(F.array(F.lit("Beach")), F.array(F.lit("Winter")), F.lit("Easy"), F.lit(2500.0), F.lit(0.0), F.lit(None).cast("double")))
    assert len(vector) == 21 and sum(vector[:17]) == 2 and vector[17:] == [1.0, 0.5, 0.5, 0.5]


# --- requests ------------------------------------------------------------------------------------------------------------
def test_requests(spark):
    texts = ["Best cultural places in Karnataka", "moderate trek without permit", "stay in cochin, kerala", "冬 美食", "food in TN with family", ""]
    rows = {r.qid: r for r in Q.with_constraints(spark.createDataFrame(list(enumerate(texts)), "qid int, query string")).collect()}
    assert (rows[0].trip_type, rows[0].trip_types, rows[0].location_terms) == ("Cultural", ["Cultural"], ["karnataka"])
    assert (rows[1].budget_tier, rows[1].accessibility, rows[1].permit, rows[1].trip_type) == ("MidRange", "Moderate", False, "Adventure")
    assert rows[2].location_terms == ["cochin", "cochin, kerala", "kerala", "kochi"] and rows[2].intent_mode == "stay_only"
    assert (rows[3].season, rows[3].trip_types) == ("Winter", ["Food"])
    assert "tamil nadu" in rows[4].location_terms and rows[4].intent_mode == "food_only"
    assert rows[5].location_terms is None and rows[5].trip_types is None
    assert one(spark, Q.expanded(F.lit("beaches in city")))[:3] == ["beaches", "in", "city"]
    assert one(spark, Q.longest_region(F.lit("a trip to southeast asia"))[0]) == "southeast asia"
    matches = spark.createDataFrame([(1, "Hot", 0.9), (1, "Cold", 0.8), (1, "Urban_High", 0.7), (1, "Seclusion_High", 0.6), (1, "Culture_Low", 0.5)], "qid int, id string, score double")
    assert [r.id for r in Q.resolve_conflicts(matches).orderBy("position").collect()] == ["Hot", "Urban_High", "Culture_Low"]


def test_query_set(spark):
    rows = [(0, "Food in Goa"), (1, "food  in goa"), (2, "food in 123"), (3, "Temples")]
    out = Q.clean_query_set(spark.createDataFrame(rows, "pos int, query string")).orderBy("qid").collect()
    assert [(r.qid, r.query) for r in out] == [(1, "Food in Goa"), (2, "Temples")]


# --- retrieval -----------------------------------------------------------------------------------------------------------
def test_bm25(spark):
    docs = {1: "red fox red", 2: "blue fox", 3: "green", 4: ""}
    index = T.index_words(spark.createDataFrame(list(docs.items()), "id int, text string"))
    got = {r.id: r.score for r in T.bm25(index, spark.createDataFrame([(7, "red red fox")], "qid int, query string")).collect()}
    n, avg = 4, 6 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, ln, df, times: times * idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * ln / avg))
    assert got == {1: pytest.approx(part(2, 3, 1, 2) + part(1, 3, 2, 1), abs=1e-6), 2: pytest.approx(part(1, 2, 2, 1), abs=1e-6)}


def test_bm25_moves_texts_only(spark):
    """Texts are dealt once by id: neither postings nor scores are shuffled, and a repeated id is still one document."""
    docs = [(1, "red fox red"), (1, "red owl owl"), (1, "blue"), (2, "blue fox"), (3, "green"), (4, None)]
    index = T.index_words(spark.createDataFrame(docs, "id int, text string"))
    scores = T.bm25_scores(index, T.query_terms(spark.createDataFrame([(7, "red fox"), (8, "blue")], "qid int, query string")))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    keys = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert not any("len#" in k or "qid#" in k and " id#" in k for k in keys)
    n, avg = 6, 10 / 6
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, ln, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * ln / avg))
    want = {(7, 1): part(3, 3, 1) + part(1, 3, 2), (7, 2): part(1, 2, 2), (8, 1): part(1, 1, 2), (8, 2): part(1, 2, 2)}
    assert {(r.qid, r.id): r.score for r in scores.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_tfidf_is_a_cosine(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, "")], "id int, text string")
    for kind in ("word", "char"):
        scores = T.tfidf_cosine(T.fit_tfidf(docs, kind), docs.select(F.col("id").alias("qid"), F.col("text").alias("query")))
        got = {(r.qid, r.id): r.score for r in scores.collect()}
        assert got[1, 1] == pytest.approx(1) and got[2, 2] == pytest.approx(1) and 0 < got[1, 2] < 1 and (3, 3) not in got


def test_similar_pairs_find_all(spark):
    rnd = random.Random(1)
    vs = [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(vs)), "id int, vector array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if cos(vs[i], vs[j]) >= 0.7}
    assert {(r.a, r.b) for r in T.similar_pairs(df, 0.7, block=16).collect()} == want


def test_similar_pairs_hold_two_blocks_of_numbers_only(spark):
    """No pair of blocks is unfolded to rows; copies, other lengths, null and zero vectors as before."""
    vs = [[1.0, 2.0, 3.0]] * 40 + [[2.0, 4.0, 6.0], [0.0, 0.0, 0.0], [1.0, 2.0], None]
    got = T.similar_pairs(spark.createDataFrame([(f"v{i:02d}", v) for i, v in enumerate(vs)], "id string, vector array<float>"), 0.9, block=8)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.a, r.b) for r in got.collect()) == [(f"v{i:02d}", f"v{j:02d}") for i, j in itertools.combinations(range(41), 2)]


def test_vector_top_k_breaks_ties_after_rounding(spark):
    rnd = random.Random(2)
    vs = [[rnd.gauss(0, 1) for _ in range(3)] for _ in range(50)] + [[0.5, 0.5, 0.5 + i * 1e-9] for i in range(40, 0, -1)]
    df = spark.createDataFrame(list(enumerate(vs)), "id int, vector array<double>")
    q = df.where("id % 7 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query_vector"))
    got = T.vector_top_k(df, q, 12, digits=6, block=16)
    want = {(i, j) for i in range(0, 90, 7) for j in sorted(range(90), key=lambda j: (-round(sum(a * b for a, b in zip(vs[i], vs[j])), 6), j))[:12]}
    assert {(r.qid, r.id) for r in got.collect()} == want and got.count() == len(want)


def test_ranked_metrics_do_not_sort_all_relevance(spark):
    truth = spark.createDataFrame([(1, i, 1.0 if i % 2 else 0.3) for i in range(1, 9)] + [(2, 1, 0.2)], "qid int, id int, grade double")
    out = M.ranked_metrics(spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 99, 3)], "qid int, id int, rank int"), truth, 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1  # over the lists alone
    got = {r.qid: r for r in out.collect()}
    gain = [1 / math.log2(r + 1) for r in range(1, 6)]
    assert got[1].ndcg == pytest.approx((0.3 * gain[0] + gain[1]) / (sum(gain[:4]) + 0.3 * gain[4])) and got[1].recall == 0.25
    assert got[2].recall == 0 and got[2].ndcg == 0


# --- ranking -------------------------------------------------------------------------------------------------------------
def test_normalisers(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 3.0), ("b", 2, 3.0), ("c", 1, -1.0)], "g string, id int, s double")
    zero = {(r.g, r.id): r.x for r in R.min_max(rows, "s", "x", group=["g"]).collect()}
    ones = {(r.g, r.id): r.x for r in R.min_max(rows, "s", "x", group=["g"], constant=1.0).collect()}
    assert zero["a", 2] == 1 and zero["b", 1] == 0 and ones["b", 1] == 1
    hybrid = {(r.g, r.id): r.x for r in R.hybrid_normalise(rows, "s", "x", group=["g"]).collect()}
    assert hybrid["a", 2] == pytest.approx(1.0) and hybrid["a", 1] == pytest.approx(0.2) and hybrid["c", 1] == 0
    assert R.min_max(rows.limit(0), "s", "x").count() == 0


def test_windows(spark):
    rows = spark.createDataFrame([(1, "Fort", 0.5), (2, " fort", 0.9), (3, "Lake", 0.9)], "id int, name string, confidence double")
    assert sorted(r.id for r in R.best_by_name(rows).collect()) == [2, 3]
    assert [(r.n, r.id) for r in R.renumbered(rows, "n", [F.col("confidence").desc(), "id"]).orderBy("n").collect()] == [(1, 2), (2, 3), (3, 1)]
    low = R.relevance_floor(rows.withColumn("confidence", F.lit(0.1)), "confidence", F.lit(0.7))
    assert {r.confidence for r in low.collect()} == {0.7}
    wa, wb = R.adaptive_weights(10)
    assert one(spark, wa) == pytest.approx(0.25) and one(spark, wb) == pytest.approx(0.75)


def test_renumbered_counts_without_gaps(spark):
    rows = spark.range(0, 60_000, 1, 8).select((F.col("id") * 7919 % 60_013).alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        got = [(r.key, r.n) for r in R.renumbered(rows, "n", ["key"]).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    keys = sorted(i * 7919 % 60_013 for i in range(60_000))
    assert sorted(got) == [(k, i) for i, k in enumerate(keys, 1)]



# --- graph ---------------------------------------------------------------------------------------------------------------
EDGES = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 2.0), ("c", "e", 1.0), ("a", "f", 0.0)]


def _graph(spark):
    edges = spark.createDataFrame([(s, d, "R", w) for s, d, w in EDGES], "src string, dst string, relation string, weight double")
    return spark.createDataFrame([(x,) for x in "abcdef"], "id string"), edges


def _plain_rank(seeds, alpha, rounds):
    ids, out = "abcdef", {}
    for s, d, w in EDGES:
        if w > 0:
            out.setdefault(s, []).append((d, w))
    total = sum(seeds.values())
    jump = {i: seeds.get(i, 0) / total for i in ids}
    r = dict.fromkeys(ids, 1 / 6)
    for _ in range(rounds):
        lost = sum(r[i] for i in ids if i not in out)
        new = {i: (1 - alpha) * jump[i] + alpha * lost * jump[i] for i in ids}
        for s, ds in out.items():
            z = sum(w for _, w in ds)
            for d, w in ds:
                new[d] += alpha * r[s] * w / z
        r = new
    return r


def test_page_rank(spark):
    nodes, edges = _graph(spark)
    got = {r.id: r["rank"] for r in G.page_rank(nodes, edges, rounds=6, tolerance=None, every=3).collect()}
    assert got == pytest.approx(_plain_rank(dict.fromkeys("abcdef", 1), 0.85, 6)) and sum(got.values()) == pytest.approx(1)
    seeds = spark.createDataFrame([("a", 0.9), ("d", 0.3)], "id string, score double")
    got = {r.id: r["rank"] for r in G.page_rank_variant("decay", nodes, edges, seeds, alpha=0.9, rounds=5, tolerance=None).collect()}
    assert got == pytest.approx(_plain_rank({"a": 0.81, "d": 0.09}, 0.9, 5))


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "SIMILAR_PROFILE"), ("c", "d", "X"), ("d", "e", "X")], "src string, dst string, relation string")
    ids = spark.createDataFrame([(x,) for x in "abcdez"], "id string")
    rows = {r.src: r for r in G.paths_or_unreachable(edges, ids, spark.createDataFrame([("e",)], "id string")).collect()}
    assert rows["b"].hops == 3 and rows["b"].path == ["b", "c", "d", "e"] and rows["z"].hops == -1 and "a" not in rows
    ev = {r.src: r for r in C.path_evidence(spark.createDataFrame([r for r in rows.values()])).collect()}
    assert (ev["b"].evidence_type, ev["b"].decay) == ("indirect_1hop", 0.3) and ev["d"].evidence_type == "direct"
    assert {r.id: r.hops for r in G.reachable(edges, spark.createDataFrame([("a",)], "id string"), 2).collect()} == {"a": 0, "b": 1, "c": 2}


def test_betweenness_and_communities(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    edges = spark.createDataFrame([(a, b, "R") for a, b in pairs], "src string, dst string, relation string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    got = {r.id: r.betweenness for r in G.betweenness(nodes, edges).collect()}
    assert got["c"] == pytest.approx(6 / 15) and got["a"] == 0 and got["g"] == 0  # 6 pairs of 15 run over c
    groups = {r.id: r.community for r in G.communities(nodes, edges).collect()}
    assert groups["a"] == groups["b"] and groups["e"] == groups["f"] and groups["a"] != groups["f"] and groups["g"] == "g"


def test_betweenness_walks_classes_of_twins(spark):
    """Against paths counted node by node; twins stand for each other, also those of the pivot."""
    pairs = [(a, b) for a in range(3) for b in range(3, 23)] + [(22, 23), (23, 24), (23, 25), (5, 24)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(27)], "id string")
    assert G.twins(edges).select("rep").distinct().count() == 7
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(27)}
    want = dict.fromkeys(range(27), 0.0)
    for s in near:
        dist, paths, queue = {s: 0}, {s: 1}, [s]
        for v in queue:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(queue, 0.0)
        for w in reversed(queue):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            want[w] += share[w] if w != s else 0
    got = {r.id: r.betweenness for r in G.betweenness(nodes, edges).collect()}
    assert got == {f"n{i}": pytest.approx(v / (26 * 25)) for i, v in want.items()}


def test_near_pairs_meet_by_position(spark):
    """Many places at one position: the distance is taken once for them, and no side is broadcast."""
    at = [(i, 10.0 + i % 3 * 0.1, 20.0) for i in range(30)] + [(30, 50.0, 20.0), (31, None, 20.0), (32, 0.0, 20.0)]
    got = G.near_pairs(spark.createDataFrame(at, "id int, lat double, lon double"), 15.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "keys=[lat#" in plan and "BroadcastHashJoin" not in plan
    want = {(i, j) for i, j in itertools.combinations(range(30), 2) if abs(i % 3 - j % 3) < 2}
    rows = got.collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)


def test_capped_pairs_are_greedy(spark):
    rnd = random.Random(4)
    pairs = [(i, j, round(rnd.random(), 2)) for i, j in itertools.combinations(range(14), 2)]
    used, want = dict.fromkeys(range(14), 0), set()
    for i, j, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if used[i] < 3 and used[j] < 3:
            want.add((i, j))
            used[i], used[j] = used[i] + 1, used[j] + 1
    got = G.capped_pairs(spark.createDataFrame(pairs, "a int, b int, similarity double"), 3)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_upsert_keeps_the_last_relation_and_the_first_place(spark):
    rows = [(1, "a", "b", "NEAR", 3.0), (2, "a", "c", "X", None), (5, "a", "b", "SIMILAR", None)]
    got = {(r.src, r.dst): r for r in G.upsert_edges(spark.createDataFrame(rows, "seq int, src string, dst string, relation string, distance_km double"), ["distance_km"]).collect()}
    assert (got["a", "b"].relation, got["a", "b"].first_seq, got["a", "b"].distance_km) == ("SIMILAR", 1, 3.0)


def test_near_pairs_miss_none(spark):
    rnd = random.Random(2)
    at = [(i, rnd.uniform(60, 70), rnd.uniform(-5, 5)) for i in range(80)] + [(99, 0.0, 3.0)]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return round(6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), 1)

    want = {(a[0], b[0]) for a, b in itertools.combinations(at[:-1], 2) if km(a, b) <= 150}
    assert {(r.a, r.b) for r in G.near_pairs(spark.createDataFrame(at, "id int, lat double, lon double")).collect()} == want


def test_kindred_pairs_miss_none(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["x", "y", None, "z"]), rnd.choice([None, [rnd.choice("abcdef") for _ in range(rnd.randint(0, 5))]])) for i in range(60)] + [(60, "v", ["a", None, "b", None]), (61, "w", [None, "b", "a", "a"])]
    df = spark.createDataFrame(rows, "id int, state string, labels array<string>")
    common = lambda p, q: len({x for x in p or () if x} & {x for x in q or () if x})
    for least in (1, 2, 3):
        want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] is not None and a[1] == b[1] or common(a[2], b[2]) >= least}
        got = [(r.a, r.b) for r in G.kindred_pairs(df, least=least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_kindred_classes_lose_no_link(spark):
    rnd = random.Random(9)
    some = [(rnd.choice(["x", "y", None]), rnd.choice([None, [], ["a"], ["b", "a", "a"], ["a", "b", None], ["c", "a", "b"], ["c", "d"]])) for _ in range(80)]
    rows = [(i, *r) for i, r in enumerate(some)] + [(80, None, None), (81, None, ["q", "r"]), (82, "lone", ["z"])]
    labels = lambda r: frozenset(x for x in r[2] or () if x)
    df = spark.createDataFrame(rows, "id int, state string, labels array<string>")
    for least in (1, 2, 3):
        got = {r.id: (r.class_id, r.links) for r in G.kindred_classes(df, least=least).collect()}
        kin = lambda p, q: p[0] != q[0] and (p[1] is not None and p[1] == q[1] or len(labels(p) & labels(q)) >= least)
        assert got == {p[0]: (min(q[0] for q in rows if (q[1], labels(q)) == (p[1], labels(p))), sum(kin(p, q) for q in rows)) for p in rows}
    assert G.kindred_classes(df.limit(0)).count() == 0


# --- constraints, metrics, refinement -------------------------------------------------------------------------------------
def test_relaxation(spark):
    rows = spark.createDataFrame([(1, "all", True, True), (1, "x", False, True), (2, "y", False, True), (3, "z", False, False)], "q int, id string, a boolean, b boolean")
    got = {(r.q, r.id): (r.level, r.fallback) for r in C.relaxation_ladder(rows, [("a", F.col("a")), ("b", F.col("b"))], group=["q"]).collect()}
    assert got == {(1, "all"): ("a", False), (2, "y"): ("b", False), (3, "z"): ("unfiltered", True)}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "qid int, id int, rank int")
    truth = spark.createDataFrame([(1, 10, 1.0), (1, 12, 0.6), (1, 13, 0.6), (1, 14, 0.3), (2, 9, 1.0)], "qid int, id int, grade double")
    got = {r.qid: r for r in M.ranked_metrics(ranked, truth, 5).collect()}
    r = got[1]
    ideal = 1 + 0.6 / math.log2(3) + 0.6 / 2 + 0.3 / math.log2(5)
    assert (r.precision, r.recall, r.mrr, r.hit_rate) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 1, 1)
    assert r.ndcg == pytest.approx((1 + 0.6 / 2) / ideal) and r.average_precision == pytest.approx((1 + 2 / 3) / 3)
    assert (got[2].precision, got[2].mrr, got[2].ndcg) == (0, 0, 0)


def test_published_weighted_score(spark):
    row = spark.range(1).select(F.lit(0.1680).alias("recall_at_20"), F.lit(0.9394).alias("ndcg_at_5"), F.lit(0.9630).alias("precision_at_5"), F.lit(0.6120).alias("coverage_at_5"), F.lit(0.8175).alias("diversity_at_5"))
    assert row.select(M.weighted_score().alias("x")).first()["x"] == pytest.approx(0.6292, abs=1e-3)


def test_refinement_branches(spark):
    rows = [
        ("accept at once", 0.60, 0.0, 0.0, 0, 0.0, None), ("hard discard", 0.05, 0.1, 0.1, 2, 0.0, 1.0), ("accept in the loop", 0.45, 0.0, 0.5, 0, 0.0, 1.0),
        ("discard after the loop", 0.10, 0.1, 0.5, 2, 0.0, None), ("keep after the loop", 0.10, 0.4, 0.5, 2, 0.5, None),
    ]
    df = spark.createDataFrame(rows, "id string, confidence double, s_sem double, s_graph double, evidence_total int, share double, neighbour_popularity double")
    got = {r.id: r for r in Z.refine(df).collect()}
    assert [got[r[0]].accepted for r in rows] == [True, False, True, False, True]
    assert got["accept in the loop"].iterations == 1 and got["accept in the loop"].refined == pytest.approx(0.57) and got["discard after the loop"].iterations == 2


def test_diversify(spark):
    rows = [(1, i, i, 0.9 - i * 0.01, 9.0 if i < 6 else 1.0, "s" if i < 4 else f"s{i}", f"d{i}", "r" if i < 4 else f"r{i}", ["Food"] if i < 4 else [f"t{i}"]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "qid int, position int, id int, confidence double, popularity double, state string, district string, region string, trip_types array<string>")
    picks = [r.id for r in Z.diversify(df, 3).orderBy("pick").collect()]
    assert picks[0] == 1 and picks[1] == 4 and picks[2] == 6  # 5 gives way to the first little-known place behind it
    assert Z.diversify(df, 8).count() == 8


def test_balanced_selection(spark):
    rows = [(i, f"n{i}", f"s{i % 7}", ("North", "South")[i % 2], ("hotel", "fort", "beach", "cafe")[i % 4], 10.0 + i, 70.0, float(i % 10)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, name string, state string, region string, poi_type string, lat double, lon double, popularity double")
    got = K.balanced_selection(df, 120, iconic=["n1"]).collect()
    assert len(got) == 120 and len({r.id for r in got}) == 120 and {r.state for r in got} == {f"s{i}" for i in range(7)}
    assert next(r for r in got if r.pick == 1).name == "n1"
    assert K.balanced_selection(df.limit(5), 120).count() == 5


def test_records_to_places(spark):
    rows = [(1, "冬天 去 寺", "寺A", "X", "", "", "2", 0.0, None), (2, "summer", "寺A", "X", "old temple", "street", "5", 1.5, 2.5), (3, "q", "", "Y", "", "", "", 1.0, 1.0)]
    got = K.places_from_records(spark.createDataFrame(rows, "seq int, query string, name string, city string, description string, address string, duration string, lat double, lon double")).collect()
    assert len(got) == 1 and (got[0].mentions, got[0].description, got[0].lat, got[0].ideal_days, got[0].popularity) == (2, "old temple", 1.5, 3, 10.0)
    assert got[0].best_seasons == ["Summer", "Winter"] and "Spiritual" in got[0].trip_types
