"""Wall seconds of the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR, as one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodestone import queries as engine

HEADLINE = (
    "bm25_top_k", "bm25_with_feedback", "tfidf_words", "vector_top_k", "similar_vector_pairs", "near_places", "reciprocal_rank_fusion", "hybrid_normalised", "degree_centrality", "page_rank", "short_paths",
    "upserted_edges", "relaxed_filter", "graph_scores", "evidence", "parsed_requests", "retrieval_metrics", "evaluation_summary", "refined_candidates", "recommended_places",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    engine.QUERIES["corpus_totals"](spark, sf_dir).collect()  # start-up isn't measured
    took = {}
    for name in HEADLINE:
        began = time.time()
        engine.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
