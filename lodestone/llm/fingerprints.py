"""Document fingerprints from closed syncmers.

A text is cut into symbols: pieces of up to three code points of a word, single characters of scripts that don't put blanks
between words. A run of K symbols is a closed syncmer if the smallest hash of its inner runs of S symbols is at its first or
last place (or at both: equal smallest hashes count wherever they are). Whether a run is one depends on the run alone, so an
edit elsewhere leaves it an anchor. `anchors` gives all of them with their places.

The fingerprint is the SIZE anchors with the smallest distinct hashes, in the order of the hashes, each with the place where it
occurs first: one number of 31 bits of hash and 32 bits of place, 16 hexadecimal digits. The likeness of two fingerprints is
the share of the SIZE smallest hashes of both that are common and stand in the same order: common anchors are put in the order
of their places in one text, and those whose place in the other text is after that of the anchor before them count. It
estimates the share of common anchors in order by a sample, whose standard error is 1/2 / sqrt(SIZE) at most, 7 %.

A text of fewer than K symbols has one anchor, the run of all its symbols; null, empty and blank texts have none and the empty
fingerprint. Two empty fingerprints have likeness 1, an empty and another one 0. Texts of any length are read whole. Columns
of the input other than id and text aren't kept by `against_edits`. Repeated rows (same id and text): each has its result, and
the next document of each is the next one with another id or text; rows of one id with different texts follow each other in
the order of their texts' hashes. Null ids come first. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import let, read_table, stored

K, S, SIZE = 5, 2, 48
_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
SYMBOL = rf"[{_SINGLE}]|[^\x20\x09-\x0D{_SINGLE}]{{1,3}}"


def _hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOL), F.lit(0)), lambda x: F.xxhash64(x))


def _inner(h: Column) -> Column:
    """Hashes of the runs of S symbols."""
    return F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(S))))


def _is_closed(inner: Column, i: Column) -> Column:
    last = K - S
    middle = [F.get(inner, i + j) for j in range(1, last)]
    return F.least(F.get(inner, i), F.get(inner, i + last)) <= (F.least(*middle) if len(middle) > 1 else middle[0])


def _anchor(inner: Column, i: Column) -> Column:
    """The hash of the run of K symbols that starts there, 31 bits, and its place, 32 bits."""
    return _placed(F.xxhash64(*(F.get(inner, i + j) for j in range(0, K - S + 1))), i.cast("long"))


def _placed(h: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 33), 32).bitwiseOR(place)


def anchors(text: Column) -> Column:
    """A text's closed syncmers in the order of their places (symbol numbers, from 0), as numbers of hash and place; a text of
    fewer than K symbols has one, the run of all."""
    none = F.expr("cast(array() as array<bigint>)")
    runs = lambda inner: F.transform(F.filter(F.sequence(F.lit(0), F.size(inner) - (K - S + 1)), lambda i: _is_closed(inner, i)), lambda i: _anchor(inner, i))
    whole = lambda h: F.array(_placed(F.xxhash64(h), F.lit(0).cast("long")))
    return let(_hashes(text), lambda h: F.when(F.size(h) == 0, none).when(F.size(h) < K, whole(h)).otherwise(let(_inner(h), runs)))


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, 32)


def _place(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(0xFFFFFFFF))


def sketch(text: Column) -> Column:
    """The fingerprint as ascending numbers."""
    firsts = lambda a: F.filter(a, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(a, i - 1))))
    return F.slice(let(F.sort_array(anchors(text)), firsts), 1, SIZE)


def fingerprint(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of anchors that are common and in the same order, estimated from the smallest hashes of both."""

    def in_order(sample: Column, ha: Column, hb: Column) -> Column:
        both = F.array_intersect(F.array_intersect(sample, ha), hb)
        places = lambda one: F.transform(F.filter(one, lambda x: F.array_contains(both, _hash(x))), _place)
        pairs = F.sort_array(F.zip_with(places(a), places(b), lambda x, y: F.shiftleft(x, 32).bitwiseOR(y)))
        follow = lambda p: F.filter(p, lambda x, i: (i == 0) | (_place(x) > _place(F.get(p, i - 1))))
        return F.size(let(pairs, follow)) / F.size(sample)

    smallest = lambda ha, hb: F.slice(F.sort_array(F.array_union(ha, hb)), 1, SIZE)
    shared = let(F.transform(a, _hash), lambda ha: let(F.transform(b, _hash), lambda hb: let(smallest(ha, hb), lambda sample: in_order(sample, ha, hb))))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared)


def with_next(docs: DataFrame, *keys: str) -> DataFrame:
    """docs: distinct rows. Each with `next`, a struct of all columns of the row after it in the order of keys; after the last
    comes the first. Rows are range-partitioned; a small table of the partitions' first rows closes the gaps between them."""
    ranged = stored(docs.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    row = F.struct(*docs.columns)
    inside = W.partitionBy("_part").orderBy(*keys)
    firsts = ranged.groupBy("_part").agg(F.min(F.struct(*keys, F.struct(*docs.columns).alias("_row")))["_row"].alias("_first"))
    order = W.orderBy("_part")  # one row for each partition
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = firsts.select("_part", F.coalesce(F.lead("_first").over(order), F.first("_first").over(whole)).alias("_after"))
    return ranged.withColumn("_lead", F.lead(row).over(inside)).join(after, "_part").select(*docs.columns, F.coalesce("_lead", "_after").alias("next"))


def against_edits(docs: DataFrame, *, id_col: str = "doc_id", share: int = 4) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last 1/share of code points gave way to the first as
    many (or all) of the next document's. Texts move once, by the hash of id and text, with their fingerprints: there a document
    meets the thin row that says who follows it and whom it follows, sends the head of its text and its fingerprint to the one
    before it, and waits for the same from the next one, which comes to the same partition."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    key = lambda id_, th: F.xxhash64(id_.isNull(), id_, th)
    thin = docs.select("id", "th", F.length("text").cast("long").alias("n_chars")).dropDuplicates(["id", "th"])
    order = stored(with_next(thin, "id", "th").select("id", "th", "n_chars", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th")), "next")
    cut = F.floor(F.col("n_chars") / share).cast("int")
    mine = order.select(key(F.col("id"), F.col("th")).alias("k"), "n_chars", cut.alias("cut"))
    before = order.select(key(F.col("next_id"), F.col("next_th")).alias("k"), key(F.col("id"), F.col("th")).alias("to"), cut.alias("to_cut"))
    plan = stored(mine.join(before, "k"), "edits")
    texts = docs.select(key(F.col("id"), F.col("th")).alias("k"), "id", "text", sketch(F.col("text")).alias("print"))
    rows = texts.join(plan, "k").select("k", "id", "text", "print", "n_chars", "cut", "to", "to_cut")
    heads = rows.select(F.col("to").alias("k"), F.struct(F.substring("text", F.lit(1), F.col("to_cut")).alias("head"), F.col("print").alias("next_print"), F.col("id").alias("_from")).alias("next"))
    heads = heads.repartition("k").groupBy("k").agg(F.first("next").alias("next"))  # repeated rows all send the same
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.col("next.head"))
    done = rows.join(heads, "k").select("id", "n_chars", "print", F.col("next.next_print").alias("next_print"), edited.alias("edited")).select(
        "id", "n_chars", "print", "next_print", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_print")
    )
    return done.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("print")).alias("fingerprint"), fingerprint(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return against_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
