"""Line dedup by a segment-partition edit join.

Lines are what line feeds part. Equal lines are found by two hashes; lines of at least LEAST code points that are within
EDITS = 2 edits of one another by this join. Lengths fall into classes of 4 (from 64 code points on, of 16). For the class that
starts at b, a line of b code points or more has three segments: the first b/3, the last b/3, and most of the middle. Of a line
within two edits either the first segment is unchanged at the start, or the last one at the end, or there is one edit in each and
the middle stands unchanged, at most one place to a side. So a line has four keys for its class: the two outer segments, and
the middle one at its place and one place on (of two lines shifted by one place, one is found so in the other). A line that may
have a partner in the class below, one or two code points shorter, has the keys of that class as well.

Lines that share a key are candidates. What the smallest line of a bucket doesn't settle (see linking.py), as lines with a
passage in common, is split by the prefix filter: two edits destroy at most four of a line's pairs of neighbouring characters
(equal pairs of a line are told apart by number), so that linked lines share one of the five first pairs of each in any common
order; rare ones come first (by counts of hashed slots over all such lines). Of the CHUNKS even chunks of a line two edits
leave all but two standing, at most two places away; pairs for which more are gone are no candidates. Candidates are checked by an edit distance on bits, on what is left of them without their common
start and end: one word for each number of errors, whose bits are the 2 EDITS + 1 diagonals around the middle, shifted along
the lines character by character.

Linked lines form groups, also over several links; the first line of a group by (id, hash of the text, line number) stays, with
all blank lines (no word); lines without an id come first. Of a document the other lines remain in their order.

Null text: stays null, 0 lines. Empty text: one blank line. Lines and texts of any length are compared whole. Repeated rows
(same id and text) are treated alike: no copy of the row goes on account of the other, since both are the same document. Rows
of one id with different texts are different documents. Ties: none, places differ. Empty table: empty result. Extra columns are
kept by `dedup_lines`, but for any named n_lines, n_equal, n_near or dropped, which give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import kept_columns, let, marked, read_table, stored
from lodestone.llm.linking import Buckets, meet

EDITS, LEAST = 2, 20
GRAM, SLOTS, WORDS = 2, 1 << 16, 4


def segment_keys(line: str, n: str) -> Column:
    """The keys of a line of n code points, at least LEAST; both are names of columns."""
    start = lambda n: f"({n} - {n} % if({n} < 64, 4, 16))"

    def keys(b: str) -> str:
        outer, middle = f"cast({b} div 3 as int)", f"cast({b} - 2 * ({b} div 3) - 1 as int)"
        parts = [f"0, substring({line}, 1, {outer})", f"2, substring({line}, {n} - {outer} + 1, {outer})", f"1, substring({line}, {outer} + 1, {middle})", f"1, substring({line}, {outer} + 2, {middle})"]
        return f"array({', '.join(f'xxhash64({b}, {p})' for p in parts)})"

    below = start(f"({n} - {EDITS})")
    return F.expr(f"if({below} = {start(n)} or {n} - {EDITS} < {LEAST}, {keys(start(n))}, concat({keys(start(n))}, {keys(below)}))")


def _common(a: Column, b: Column, part) -> Column:
    """The number of code points that a and b have in common at one end: part(x, done, n) are the n code points next to done."""
    most = F.least(F.length(a), F.length(b))
    powers = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    return F.aggregate(powers, F.lit(0), lambda done, n: F.when((done <= most - n) & (part(a, done, n) == part(b, done, n)), done + n).otherwise(done))


def _may_be_near(p: Column, t: Column) -> Column:
    """Whether two lines without common start and end may be two edits apart: both their first and their last characters differ,
    so that one edit is at the very start and one at the very end, and what is between is equal."""
    edits = ((1, 1), (1, 0), (0, 1))  # characters of p and of t that an edit takes

    def between(first: tuple[int, int], last: tuple[int, int]) -> Column:
        n, m = F.length(p) - first[0] - last[0], F.length(t) - first[1] - last[1]
        return (n == m) & (F.substring(p, F.lit(first[0] + 1), n) == F.substring(t, F.lit(first[1] + 1), m))

    any_ = F.least(F.length(p), F.length(t)) <= EDITS
    for first in edits:
        for last in edits:
            any_ = any_ | between(first, last)
    return any_


def within_edits(a: Column, b: Column) -> Column:
    """Whether two lines are at most EDITS insertions, deletions and substitutions apart. Bit d of word e after j characters
    of b says: the first j - edits + d characters of a become the first j of b by at most e edits."""
    edits, width = EDITS, 2 * EDITS + 1
    mask = (1 << width) - 1

    def walk(p: Column, t: Column) -> Column:
        start = F.struct(*(F.lit((((1 << (e + 1)) - 1) << edits) & mask).alias(f"r{e}") for e in range(edits + 1)))

        def step(acc: Column, x: Column) -> Column:
            match = F.lit(0)
            for d in range(width):
                at = x["i"] - edits + d  # of a's characters, from 1
                match = match.bitwiseOR(F.when((at >= 1) & (F.get(p, at - 1) == x["c"]), F.lit(1 << d)).otherwise(F.lit(0)))

            def grow(e: int, done: tuple[Column, ...], m: Column) -> Column:
                if e > edits:
                    return F.struct(*(w.alias(f"r{i}") for i, w in enumerate(done)))
                word = acc[f"r{e}"].bitwiseAND(m)
                if e:
                    less = acc[f"r{e - 1}"]
                    word = word.bitwiseOR(F.shiftright(less, 1)).bitwiseOR(less).bitwiseOR(F.shiftleft(done[-1], 1)).bitwiseAND(F.lit(mask))
                return let(word, lambda w: grow(e + 1, (*done, w), m))

            return let(match, lambda m: grow(0, (), m))

        numbered = F.transform(t, lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i")))
        end = F.aggregate(numbered, start, lambda acc, x: F.when(acc[f"r{edits}"] == 0, acc).otherwise(step(acc, x)))
        place = F.size(p) - F.size(t) + edits
        return F.getbit(end[f"r{edits}"], place) == 1

    def cores(a: Column, b: Column) -> Column:
        end = _common(a, b, lambda x, done, n: F.substring(x, F.length(x) - done - n + 1, n))
        without = lambda x, e: F.substring(x, F.lit(1), F.length(x) - e)
        bits = lambda p, t: let(F.split(p, ""), lambda p: let(F.split(t, ""), lambda t: walk(p, t)))
        return let(end, lambda e: let(without(a, e), lambda p: let(without(b, e), lambda t: F.when(_may_be_near(p, t), bits(p, t)).otherwise(F.lit(False)))))

    near = F.abs(F.length(a) - F.length(b)) <= edits
    rest = lambda x, done: F.substring(x, done + 1, F.length(x))
    start = _common(a, b, lambda x, done, n: F.substring(x, done + 1, n))
    return F.when(near, let(start, lambda d: let(rest(a, d), lambda x: let(rest(b, d), lambda y: cores(x, y))))).otherwise(F.lit(False))


def line_rows(docs: DataFrame, id_col: str) -> DataFrame:
    """id, th (hash of the text), no, h1, h2 (hashes), n (code points) and keys (null for short lines) of every line that has a word."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    lines = lines.where(F.expr(r"btrim(line, ' \t\n\u000b\u000c\r') <> ''")).withColumn("n", F.length("line"))
    return lines.select("id", "th", "no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "n", F.when(F.col("n") >= LEAST, segment_keys("line", "n")).alias("keys"))


def _numbered(pairs: Column) -> Column:
    """pairs: ascending numbers. Each with how many equal ones stand before it (31 at most, found by halving), as one number."""
    before = lambda x, j: F.aggregate(F.array(*map(F.lit, (16, 8, 4, 2, 1))), F.lit(0), lambda n, p: F.when(F.get(pairs, j - n - p) == x, n + p).otherwise(n))
    return F.transform(pairs, lambda x, j: F.xxhash64(x, before(x, j)))


def _rare_pairs(lines: DataFrame) -> DataFrame:
    """lines: id, line. Returns id, n, bits and first, the first GRAM * EDITS + 1 pairs of neighbouring characters in the
    common order; the second, third, ... of equal pairs in a line are features of their own."""
    pairs = let(F.split("line", ""), lambda c: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.xxhash64(*(F.get(c, i + j) for j in range(GRAM))))))
    characters = F.transform(F.split("line", ""), lambda c: F.xxhash64(c))
    own = lines.select("id", F.length("line").alias("n"), _bits(characters, 1).alias("bits"), F.array_distinct(let(pairs, _numbered)).alias("pairs"))
    own = stored(own.withColumn("bits", F.concat("bits", _bits(F.col("pairs"), WORDS))), "line-pairs")
    slot = lambda x: F.pmod(x, F.lit(SLOTS))
    counts = own.select(F.explode(F.transform("pairs", slot)).alias("slot")).groupBy("slot").count()
    counts = lines.sparkSession.range(SLOTS).withColumnRenamed("id", "slot").join(counts, "slot", "left").agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("count", F.lit(0)).alias("count")))).alias("counts"))
    counts = stored(counts.select(F.lit(1).alias("one"), F.transform("counts", lambda x: x["count"]).alias("counts")), "line-counts")  # one row of SLOTS numbers
    ranked = F.sort_array(F.transform("pairs", lambda x: F.struct(F.get("counts", slot(x).cast("int")).alias("count"), x.alias("pair"))))
    both = own.withColumn("one", F.lit(1)).join(F.broadcast(counts), "one")
    first = F.transform(F.slice(ranked, 1, GRAM * EDITS + 1), lambda x: x["pair"])
    return both.select("id", "n", "bits", first.alias("first"))


def _bits(hashes: Column, words: int) -> Column:
    """hashes as places of bits in so many words, added up without carry. A hash that one of two lists has more than the other
    changes one bit at most."""
    place = lambda h: F.pmod(h, F.lit(64 * words))
    bit = lambda h, w: F.when(F.shiftright(place(h), 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(h), F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(bit(h, w)))
    return F.array(*map(word, range(words)))


def _bits_agree(x: str, y: str) -> Column:
    """Whether the bits of characters and of pairs differ in no more places than EDITS edits change."""
    differ = lambda w: F.bit_count(F.get(f"{x}.bits", F.lit(w)).bitwiseXOR(F.get(f"{y}.bits", F.lit(w))))
    return (differ(0) <= 2 * EDITS) & (sum((differ(w) for w in range(2, WORDS + 1)), differ(1)) <= 2 * GRAM * EDITS)


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """k (of document_key) and dropped (array of no, near, n_chars of each line that goes) of the documents that lose lines."""
    rows = stored(line_rows(docs, id_col), "line-rows")
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "th", "no")
    buckets = Buckets(rows.where("keys is not null").select(F.col("h1").alias("id"), F.explode("keys").alias("key")), "lines")
    members = stored(buckets.ids().withColumnRenamed("id", "h1"), "line-members")
    repeated = rows.groupBy("h1", "h2").agg(F.count("*").alias("_n")).where("_n > 1").select("h1")
    told = stored(repeated.unionByName(members), "line-told")  # all lines that may go, or make others go
    rows = stored(marked(rows.drop("keys"), F.col("h1"), told, "h1").where("_hit").drop("_hit"), "line-some")
    first = stored(rows.groupBy("h1", "h2").agg(F.min(place).alias("first")), "line-firsts")

    at = first.join(members, "h1", "left_semi").select("h1", document_key("first.id", "first.th").alias("k"), F.col("first.no").alias("no"))
    at = stored(at.groupBy("k").agg(F.collect_list(F.struct("no", "h1")).alias("want")), "line-places")
    some = marked(docs.select(document_key(id_col, F.xxhash64("text")).alias("k"), "text"), F.col("k"), at, "k").where("_hit").drop("_hit")
    texts = some.join(at, "k").select(F.split("text", "\n").alias("ls"), F.explode("want").alias("w")).select(F.col("w.h1").alias("id"), F.get("ls", F.col("w.no")).alias("line"))
    texts = stored(texts.dropDuplicates(["id"]), "line-texts")

    def check(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        return both.where(within_edits(F.col("x"), F.col("y"))).select("a", "b")

    def rest(mixed: DataFrame) -> DataFrame:
        rare = stored(_rare_pairs(texts.join(mixed.select("id").distinct(), "id", "left_semi")), "line-rare")
        finer = mixed.join(rare, "id").select("key", "id", "c", "n", "bits", "first", F.explode("first").alias("pair"))
        finer = stored(finer.select(F.xxhash64("key", "pair").alias("bucket"), "id", "c", "n", "bits", "first", "pair"), "line-finer")
        once = lambda x, y: F.get(F.array_intersect(f"{x}.first", f"{y}.first"), F.lit(0)) == F.col(f"{x}.pair")  # noqa: E731  the first that they share
        return meet(finer, lambda x, y: once(x, y) & (F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) <= EDITS) & _bits_agree(x, y))

    _, found = buckets.linked(check, rest)
    named = first.join(found, first.h1 == found.id, "left").select("h1", "h2", "first", F.coalesce("component", "h1").alias("group"), F.when(F.col("component").isNull(), F.col("h2")).alias("apart"))
    heads = named.groupBy("group", "apart").agg(F.min("first").alias("head"), F.count("*").alias("_n"))
    named = named.join(heads, (named.group == heads.group) & named.apart.eqNullSafe(heads.apart)).select("h1", "h2", "first", "head")
    gone = rows.join(named, ["h1", "h2"]).where(place != F.col("head"))
    return gone.groupBy(document_key("id", "th").alias("k")).agg(F.sort_array(F.collect_set(F.struct("no", (place == F.col("first")).alias("near"), F.col("n").alias("n_chars")))).alias("dropped"))


def document_key(id_: str, th: str | Column) -> Column:
    """One number for the id and the hash of the text."""
    return F.xxhash64(F.col(id_).isNull(), id_, th)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """docs with their remaining lines as text, and n_lines (before), n_equal, n_near (lines that went as copies of a line, as near
    copies) and dropped (their numbers)."""
    kept = kept_columns(docs, "n_lines", "n_equal", "n_near", "dropped")
    gone = stored(dropped_lines(docs, id_col=id_col).withColumnRenamed("dropped", "_gone"), "line-dropped")
    all_ = marked(docs.select(F.struct(*kept).alias("_row"), document_key(id_col, F.xxhash64("text")).alias("_doc"), "text"), F.col("_doc"), gone, "k")
    touched = all_.where("_hit").join(gone, F.col("_doc") == F.col("k"), "left").drop("_hit", "k")
    rows = touched.unionByName(all_.where("not _hit").drop("_hit").withColumn("_gone", F.lit(None).cast(gone.schema["_gone"].dataType)))
    numbers = F.coalesce(F.transform("_gone", lambda g: g["no"]), F.expr("cast(array() as array<int>)"))
    keep = let(F.split("text", "\n"), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("dropped")), lambda i: F.get(ls, i)), "\n"))
    rows = rows.withColumn("dropped", numbers)
    counts = [
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("_gone", lambda g: ~g["near"])), F.lit(0)).cast("long").alias("n_equal"),
        F.coalesce(F.size(F.filter("_gone", lambda g: g["near"])), F.lit(0)).cast("long").alias("n_near"),
    ]
    text = F.when(F.size("dropped") == 0, F.col("text")).otherwise(keep).alias("text")
    return rows.select(*(text if c == "text" else F.col("_row")[c].alias(c) for c in kept), F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(counts[0]).alias("n_lines"), *counts[1:], "dropped")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines after dedup: how many went and why, and the hash of the text that remains."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_equal", "n_near", "dropped", F.sha2("text", 256).alias("text_sha256"))
