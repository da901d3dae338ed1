"""What the training-data operators share: the word pattern, stored tables and row hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (blank, tab, line feed, vertical tab, form feed, return).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root) if _settable(spark) else None
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _settable(spark: SparkSession) -> bool:
    return spark.conf.isModifiable("spark.checkpoint.dir")


def stored(df: DataFrame, name: str, *, rows_a_batch: int | None = None, rows_a_group: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs don't run its lineage again, and a lost executor loses no rows.
    rows_a_batch: of the Arrow batches that Python workers hold at once while it is written; rows_a_group: of Parquet's row groups,
    which bound what a reader of long arrays unpacks at once (4096 rows otherwise)."""
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(setting)
    try:
        if rows_a_batch:
            spark.conf.set(setting, str(rows_a_batch))
        df.write.options(**{"parquet.block.row.count.limit": rows_a_group} if rows_a_group else {}).parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def let(value: Column, body) -> Column:
    """Evaluate value once and use it many times within one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kept_columns(df: DataFrame, *added: str) -> list[str]:
    """The columns of df that an operator keeps: all but those that have the name of one it adds, which gives way to it."""
    return [c for c in df.columns if c.lower() not in {a.lower() for a in added}]


#: Where operators put what they compute before they lay it out; no input should have a column of this name.
RESULT = "_lodestone_result"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of the bitmap that `marked` sends to every task: 2^25, at most 2^19 words.
BITMAP = 1 << 25


def marked(df: DataFrame, key: Column, wanted: DataFrame, column: str) -> DataFrame:
    """df with `_hit`: false where key (a number) is surely not among the column of wanted, true where it may be. Keys are hashed
    into a bitmap of bounded size, so that rows that join nothing needn't be shuffled; a join decides about the others."""
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(BITMAP))
    words = wanted.select(F.shiftright(place, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`), 64) as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    own = df.withColumn("_h", F.xxhash64(key)).withColumn("_word", F.shiftright(F.pmod(F.col("_h"), F.lit(BITMAP)), 6))
    hit = F.coalesce(F.getbit("_bits", F.pmod(F.col("_h"), F.lit(64)).cast("int")) == 1, F.lit(False))
    return own.join(F.broadcast(words), "_word", "left").withColumn("_hit", hit).select(*df.columns, "_hit")  # at most 2^19 rows
