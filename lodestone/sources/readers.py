"""Inputs: catalogues, record maps, map nodes, query sets, image folders and stored graphs, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.lookups import PREFERENCES
from lodestone.plans.graphs import Graph

CITY_SCHEMA = "city string, country string, region string, avg_temp_monthly string, " + ", ".join(f"{p} int" for p in PREFERENCES)
_NEAR = "struct<name:string,distance_km:double>"
_RANGE = "struct<accommodation_range:array<double>>"
PLACE_SCHEMA = (
    "id bigint, destination_name string, state string, district string, region string, coordinates struct<latitude:double,longitude:double>, altitude_m double, "
    f"nearest_major_city {_NEAR}, nearest_airport {_NEAR}, nearest_railway_station {_NEAR}, primary_attractions array<string>, activities_available array<string>, "
    "local_cuisine_must_try array<string>, festivals_events array<string>, language_spoken array<string>, trip_types array<string>, best_seasons array<string>, avoid_seasons array<string>, "
    "local_customs string, unique_experiences string, rainfall_pattern string, peak_tourist_season string, off_season string, road_connectivity string, permits_details string, "
    f"internet_connectivity string, accessibility string, average_temperature map<string,string>, budget_category {_RANGE}, mid_range_category {_RANGE}, luxury_category {_RANGE}, "
    "permits_required boolean, minimum_days int, ideal_days int, maximum_days int, popularity_score double, safety_rating double, _sources map<string,string>, _wikipedia_url string, "
    "_wikidata_qid string, _coverage_pct double, name_norm string, poi_type string, osm_id bigint, wikidata string, wikipedia string, _source string"
)
_RECORD = "map<string,struct<query:string,poi_list:array<struct<`名称`:string,`城市`:string,`描述`:string,`地址`:string,`预计游玩时长`:string,`纬度`:double,`经度`:double>>>>"


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=CITY_SCHEMA, header=True, quote='"', escape='"')


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of places."""
    return spark.read.schema(PLACE_SCHEMA).json(path, multiLine=True)


def read_record_map(spark: SparkSession, path: str) -> DataFrame:
    """{key: {query, poi_list}}: one row for each mention, in the order of the file: seq, query, name, city, ..."""
    records = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", _RECORD))).alias("record", "e"))
    rows = records.select((F.col("record") + 1).alias("record"), F.col("e.value.query").alias("query"), F.posexplode_outer("e.value.poi_list").alias("i", "p"))
    return rows.select(
        (F.col("record").cast("long") * 100_000 + F.coalesce("i", F.lit(0))).alias("seq"), F.col("record").alias("record"), "query", F.col("p.`名称`").alias("name"), F.col("p.`城市`").alias("city"), F.col("p.`描述`").alias("description"),
        F.col("p.`地址`").alias("address"), F.col("p.`预计游玩时长`").alias("duration"), F.col("p.`纬度`").alias("lat"), F.col("p.`经度`").alias("lon"),
    )


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of texts or of {qid, category, query}: pos, query, category. Any other entry fails the job."""
    entries = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a"))
    rows = entries.select(F.posexplode(F.coalesce("a", F.array(F.raise_error(F.lit("a query set is a JSON array"))))).alias("pos", "raw"))
    parsed = rows.withColumn("o", F.when(F.startswith("raw", F.lit("{")), F.from_json("raw", "qid int, category string, query string")))
    bad = F.startswith("raw", F.lit("{")) & F.col("o.query").isNull()
    text = F.when(bad, F.raise_error(F.concat(F.lit("no query in "), "raw"))).otherwise(F.coalesce("o.query", "raw"))
    return parsed.select("pos", text.cast("string").alias("query"), F.coalesce("o.category", F.lit("generic")).alias("category"))


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of texts."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "value"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of metrics that was written by the sinks or by hand."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_graph(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


def list_images(spark: SparkSession, folder: str, most: int = 5, extensions: str = "jpg|jpeg|png|webp") -> DataFrame:
    """id (the folder an image lies in), path, file, category (the name up to its number), the first few of each id by name."""
    from pyspark.sql import Window as W

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").where(F.lower("path").rlike(rf"\.({extensions})$"))
    parts = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("id"), "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    ranked = parts.withColumn("category", F.regexp_extract("file", r"^([^_.]+)", 1)).withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("file")))
    return ranked.where(F.col("_r") <= most).drop("_r")


def table_schema(columns: list[dict]) -> T.StructType:
    """A schema from column descriptions: name, type (INTEGER, TEXT, REAL), nullable, primary_key."""
    kinds = {"INTEGER": T.IntegerType(), "TEXT": T.StringType(), "REAL": T.DoubleType()}
    return T.StructType([T.StructField(c["name"], kinds[c["type"].upper()], c.get("nullable", True), {"primary_key": bool(c.get("primary_key"))}) for c in columns])


def register_map_nodes(spark: SparkSession) -> None:
    """Makes spark.read.format("map_nodes") read nodes of an OSM PBF extract: osm_id, lat, lon, tags. Option max_nodes ends the
    scan early. Needs the osmium package where it runs; tables of the same columns can be read instead."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Reader(DataSourceReader):
        def __init__(self, path: str, most: int):
            self.path, self.most = path, most

        def read(self, partition):
            import osmium

            for n, node in enumerate(osmium.FileProcessor(self.path, osmium.osm.NODE)):
                if self.most and n >= self.most:
                    return
                if node.location.valid() and len(node.tags):
                    yield node.id, node.location.lat, node.location.lon, {t.k: t.v for t in node.tags}

    class MapNodes(DataSource):
        @classmethod
        def name(cls) -> str:
            return "map_nodes"

        def schema(self) -> str:
            return "osm_id bigint, lat double, lon double, tags map<string,string>"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["path"], int(self.options.get("max_nodes", 0)))

    spark.dataSource.register(MapNodes)
