"""Outputs: result tables, documents, graphs as tables and as GraphML text, append-only logs."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.graphs import Graph


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else f.name for f in df.schema))


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    _flat(df).write.csv(path, header=True, mode=mode, quote='"', escape='"')


def write_quoted_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Every text in quotes, quotes within a text as two single ones."""
    text = df.select(*(F.replace(F.col(f.name), F.lit('"'), F.lit("''")).alias(f.name) if isinstance(f.dataType, T.StringType) else f.name for f in df.schema))
    text.write.csv(path, header=True, mode=mode, quoteAll=True)


def write_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """JSON lines."""
    df.write.json(path, mode=mode)


def append_json(df: DataFrame, path: str) -> None:
    """A log that grows: nothing that is there is read or written again."""
    df.write.json(path, mode="append")


def as_document(df: DataFrame, most: int = 100_000) -> str:
    """A small result as one JSON array; a larger one is refused."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write a table instead")
    return "[" + ",\n".join(rows) + "]"


def write_graph(graph: Graph, folder: str, *, mode: str = "overwrite") -> None:
    graph.nodes.write.parquet(f"{folder}/nodes", mode=mode)
    graph.edges.write.parquet(f"{folder}/edges", mode=mode)


def write_graphml(graph: Graph, path: str, *, mode: str = "overwrite") -> None:
    """GraphML elements as lines of text, nulls as empty texts, nested values as JSON; head and tail are files of their own in
    the order of names, so that the files in order are one document."""
    xml = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")
    data = lambda df, skip: F.concat_ws("", *(F.concat(F.lit(f'<data key="{escape(c)}">'), xml(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</data>")) for c in df.columns if c not in skip))
    nodes, edges = _flat(graph.nodes), _flat(graph.edges)
    a = nodes.select(F.concat(F.lit('<node id="'), xml(F.col("id").cast("string")), F.lit('">'), data(nodes, {"id"}), F.lit("</node>")).alias("value"))
    b = edges.select(F.concat(F.lit('<edge source="'), xml(F.col("src").cast("string")), F.lit('" target="'), xml(F.col("dst").cast("string")), F.lit('">'), data(edges, {"src", "dst"}), F.lit("</edge>")).alias("value"))
    spark = graph.nodes.sparkSession
    keys = "".join(f'<key id="{escape(c)}" for="{kind}" attr.name="{escape(c)}" attr.type="string"/>' for kind, df in (("node", nodes), ("edge", edges)) for c in df.columns)
    line = lambda text: spark.createDataFrame([(text,)], "value string")
    for part, df in (("0-head", line(f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">')), ("1-nodes", a), ("2-edges", b), ("3-tail", line("</graph></graphml>"))):
        df.write.mode(mode).text(f"{path}/{part}")


def write_metadata(graph: Graph, path: str, communities: DataFrame | None = None) -> None:
    """Counts by node type and relation, the members of communities: a table of JSON lines."""
    from lodestone.operators.graph import graph_statistics

    stats = graph_statistics(graph.nodes, graph.edges)
    rows = stats.select("what", "name", "n", F.expr("cast(array() as array<string>)").alias("members"))
    if communities is not None:
        rows = rows.unionByName(communities.groupBy(F.col("community").cast("string").alias("name")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col("id").cast("string"))).alias("members")).withColumn("what", F.lit("community")))
    rows.write.json(path, mode="overwrite")


def console_summary(graph: Graph, top: int = 12) -> DataFrame:
    """The most frequent node types and relations."""
    from lodestone.operators.graph import graph_statistics
    from lodestone.operators.ranking import top_k

    return top_k(graph_statistics(graph.nodes, graph.edges), top, "n", group=["what"], tie="name")


def ensure_template(spark: SparkSession, path: str, columns: dict[str, str], rows: list[tuple]) -> DataFrame:
    """A table to fill in, written only where none is."""
    schema = ", ".join(f"{c} {t}" for c, t in columns.items())
    spark.createDataFrame(rows, schema).write.csv(path, header=True, mode="ignore")
    return spark.read.csv(path, header=True, schema=schema)


def config_document(settings: dict) -> str:
    return json.dumps(settings, ensure_ascii=False, indent=2, sort_keys=True)
