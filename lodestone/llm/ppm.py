"""Language-model scoring by prediction by partial matching (PPM).

A text is scored as the bytes of its tokens: its words with A-Z lower-cased, one blank between two of them, and an end byte.
The model is a trie of the byte contexts of up to ORDER bytes of all training texts. A byte is predicted by the longest context
it was seen in; each longer one pays an escape (method D: half a count of every distinct successor goes to the escape), and what
the longer one had already offered is excluded from the counts of the shorter one. Below the empty context all bytes not yet excluded are
equally likely. The score is the sum of the log10 probabilities.

The trie is never gathered in one place. Documents fall into blocks of about BLOCK_BYTES by the hash of their id. Each block
counts its own grams (context plus byte) and words; the counts meet by the hash of the gram or word; the log probability of
every gram that occurs anywhere is worked out once, side by side with the grams that share the last three bytes of context;
and each block gets back the values of its own grams and words, to score its documents. What moves between these steps are
sorted, compressed runs of grams and words, not rows. Only the counts of contexts of up to two bytes, at most 2^24 numbers,
go to every task.

Null text: as the empty text, which has the end alone. Documents of any length are scored whole. Repeated rows: scored each;
all training rows count. No training rows: every byte has probability 1/256 and the base score is 0 for each token. Empty
table: empty result. Of extra columns only the id is kept.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import id_remainder, read_table, stored

ORDER, BLOCK_BYTES, CHUNK = 5, 24 << 20, 3 << 20
END = b"\n"
LOW = 2  # contexts of up to so many bytes go to every task
PAD = END * ORDER


def stream_of(text: str | None) -> bytes:
    """The bytes of a text that are scored, without the end."""
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


def slices(streams: list[bytes]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Runs of about CHUNK bytes of (stream number, bytes before, bytes), the end included; long streams go in several slices."""
    run, n = [], 0
    for i, s in enumerate(streams):
        s = PAD + s + END
        for at in range(ORDER, len(s), CHUNK):
            run.append((i, s[at - ORDER : at], s[at : at + CHUNK]))
            n += len(run[-1][2])
            if n >= CHUNK or len(run) >= 60_000:
                yield run
                run, n = [], 0
    if run:
        yield run


def grams(run: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a run as numbers, and the sizes of its slices."""
    raw = np.frombuffer(b"".join(x for _, before, s in run for x in (before, s)), np.uint8)
    sizes = np.array([len(s) for *_, s in run])
    two = raw[:-1].astype(np.uint16) << np.uint16(8)
    two |= raw[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16)
    four |= two[2:]
    key = four[:-2].astype(np.uint64) << np.uint64(16)
    key |= two[4:]
    keep = np.ones(len(key), bool)
    starts = np.cumsum(sizes + ORDER)[:-1]  # where the later slices' bytes before begin
    for j in range(ORDER):
        keep[starts - ORDER + j] = False
    return key[keep], sizes


def _zip(x: np.ndarray) -> bytes:
    """Numbers, byte planes one after the other."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 3)


def _unzip(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending numbers with values."""
    return pickle.dumps((_zip(np.diff(keys, prepend=np.uint64(0))), values.dtype.str, _zip(values)))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, kind, values = pickle.loads(blob)
    return np.cumsum(_unzip(keys, np.uint64), dtype=np.uint64), _unzip(values, kind)


def pack_words(words: list[bytes], values: np.ndarray) -> bytes:
    return pickle.dumps((zstandard.compress(b" ".join(words), 3), values.dtype.str, _zip(values)))


def unpack_words(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    words, kind, values = pickle.loads(blob)
    return zstandard.decompress(words).split(b" "), _unzip(values, kind)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its keys in ascending order)."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    found, starts = np.unique(part[order], return_index=True)
    for p, a, b in zip(found, starts, [*starts[1:], len(order)], strict=True):
        yield int(p), order[a:b]


def summed(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


class Level:
    """The contexts of one order: grams u with counts c; contexts cu with totals, distinct successors and, for each context,
    what the next shorter one has counted of the same successors."""

    def __init__(self, u: np.ndarray, c: np.ndarray, lower: Level | None, order: int):
        self.u, self.c = u, c
        self.cu, at, self.q = np.unique(u >> np.uint64(8), return_index=True, return_counts=True)
        self.tot = np.add.reduceat(c, at) if len(u) else np.zeros(0, np.int64)
        self.excluded = None
        if lower is not None:
            below = lower.c[np.searchsorted(lower.u, u & np.uint64((1 << (8 * order)) - 1))] if len(u) else np.zeros(0, np.int64)
            self.excluded = np.add.reduceat(below, at) if len(u) else np.zeros(0, np.int64)

    @staticmethod
    def cut(u: np.ndarray, c: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The grams of a lower order that these contain, with their counts."""
        keys, at = np.unique(u & np.uint64((1 << (8 * (order + 1))) - 1), return_inverse=True)
        return keys, np.bincount(at, c, len(keys)).astype(np.int64)


def low_levels(u: np.ndarray, c: np.ndarray) -> list[Level]:
    """Orders 0 to LOW from the counts of order LOW."""
    levels: list[Level] = []
    for order in range(LOW + 1):
        levels.append(Level(*Level.cut(u, c, order), levels[-1] if levels else None, order))
    return levels


def log_probabilities(u: np.ndarray, c: np.ndarray, low: list[Level]) -> np.ndarray:
    """log10 probability of the last byte of each gram. u: distinct, with all grams that share three bytes of context with any of
    them; c: their training counts, 0 where seen elsewhere only."""
    seen = c > 0
    levels = list(low)
    for order in range(LOW + 1, ORDER + 1):
        levels.append(Level(*Level.cut(u[seen], c[seen], order), levels[-1], order))
    out, open_ = np.zeros(len(u)), np.ones(len(u), bool)
    gone, gone_q = np.zeros(len(u)), np.zeros(len(u))
    for order in range(ORDER, -1, -1):
        at, key = levels[order], u & np.uint64((1 << (8 * (order + 1))) - 1)
        if not len(at.u):
            continue
        ci = np.searchsorted(at.cu, key >> np.uint64(8)).clip(0, len(at.cu) - 1)
        known = at.cu[ci] == key >> np.uint64(8)
        gi = np.searchsorted(at.u, key).clip(0, len(at.u) - 1)
        hit = open_ & (at.u[gi] == key)
        total, distinct = np.where(known, at.tot[ci] - gone, 0), np.where(known, at.q[ci] - gone_q, 0)
        out[hit] += np.log10((2 * at.c[gi[hit]] - 1) / (2 * total[hit]))
        escape = open_ & ~hit & (distinct > 0)
        out[escape] += np.log10(distinct[escape] / (2 * total[escape]))
        open_ &= ~hit
        if order:
            gone, gone_q = np.where(known, at.excluded[ci], 0), np.where(known, at.q[ci], 0)
    out[open_] += -np.log10(256 - len(low[0].u))
    return out


# --- the steps between shuffles -----------------------------------------------------------------------------------------
def _batches(batches: Iterator[pa.RecordBatch], size: int = 24 << 20) -> Iterator[pa.Table]:
    waiting, n = [], 0
    for b in batches:
        waiting.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.Table.from_batches(waiting)
            waiting, n = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _blocks(docs: DataFrame, id_col: str, held_out: Column, n_blocks: int) -> DataFrame:
    """block, meta (ids and folds) and body (streams) of runs of documents."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batches(batches):
            table = table.sort_by("block")
            blocks, starts = np.unique(table["block"].to_numpy(), return_index=True)
            for block, a, b in zip(blocks, starts, [*starts[1:], len(table)], strict=True):
                part = table.slice(a, b - a)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, (meta := part.select(["id", "held_out"])).schema) as w:
                    w.write_table(meta)
                body = zstandard.compress(END.join(map(stream_of, part["text"].to_pylist())), 5)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "meta": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "body": pa.array([body], pa.binary())})

    rows = docs.select(F.col(id_col).alias("id"), F.col("text"), held_out.alias("held_out"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)).cast("int").alias("block"))
    return rows.mapInArrow(packed, "block int, meta binary, body binary")


def _runs(docs: pa.Table) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """ids and folds with streams."""
    for meta, body in zip(docs["meta"], docs["body"], strict=True):
        yield pa.ipc.open_stream(meta.as_buffer()).read_all(), zstandard.decompress(body.as_py()).split(END)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


_COUNTS = pa.schema([("word", pa.bool_()), ("part", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
_COUNTS_SQL = "word boolean, part int, block int, blob binary"
_VALUES = pa.schema([("block", pa.int32()), ("word", pa.bool_()), ("blob", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
_VALUES_SQL = "block int, word boolean, blob binary, n long, v long"


def _counter(parts: int):
    """A block's distinct grams and words with their counts in its training documents, by part."""

    def count(group: pa.Table) -> pa.Table:
        words, other, pieces, waiting = Counter(), set(), [], 0
        for meta, streams in _runs(group):
            held = np.array(meta["held_out"].to_pylist(), bool)
            for h in (False, True):
                some = [s for s, x in zip(streams, held, strict=True) if x == h]
                for s in some:
                    if h:
                        other.update(s.split())
                    else:
                        words.update(s.split())
                words[END] += 0 if h else len(some)
                for run in slices(some):
                    keys, n = np.unique(grams(run)[0], return_counts=True)
                    pieces.append((keys, (n * (not h)).astype(np.int64)))
                    waiting += len(keys)
                    if waiting > 3_000_000:
                        pieces, waiting = [summed(pieces)], 0
        block, rows = group["block"][0].as_py(), []
        keys, n = summed(pieces)
        for p, at in by_part(keys, parts):
            rows.append((False, p, block, pack(keys[at], n[at].astype(np.int32 if n.max() < 2**31 else np.int64))))
        split: dict[int, list[bytes]] = {}
        for w in words.keys() | other:
            split.setdefault(zlib.crc32(w) % parts, []).append(w)
        for p, ws in split.items():
            rows.append((True, p, block, pack_words(ws, np.array([words[w] for w in ws], np.int64))))
        return _rows(rows, _COUNTS)

    return count


def _gram_totals(group: pa.Table) -> pa.Table:
    keys, n = summed([unpack(b.as_py()) for b in group["blob"]])
    return pa.table({"gram": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})


def _word_values(group: pa.Table) -> pa.Table:
    """For each block log10(c + 0.1) of its words; and a row without block: the part's training tokens and known words."""
    total: Counter = Counter()
    unpacked = []
    for block, blob in zip(group["block"].to_pylist(), group["blob"], strict=True):
        ws, n = unpack_words(blob.as_py())
        unpacked.append((block, ws))
        for w, k in zip(ws, n.tolist(), strict=True):
            total[w] += k
    rows = [(block, True, pack_words(ws, np.log10(np.array([total[w] for w in ws]) + 0.1)), None, None) for block, ws in unpacked]
    return _rows([*rows, (None, True, None, total.total(), sum(c > 0 for c in total.values()))], _VALUES)


def _gram_values(counts: pa.Table, model: pa.Table) -> pa.Table:
    """For each block the values of its grams."""
    if not len(counts):
        return _VALUES.empty_table()
    keys, values = (np.concatenate(x) for x in zip(*(unpack(b.as_py()) for b in model["blob"]), strict=True))
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    rows = []
    for block, blob in zip(counts["block"].to_pylist(), counts["blob"], strict=True):
        own, _ = unpack(blob.as_py())
        rows.append((block, False, pack(own, values[np.searchsorted(keys, own)]), None, None))
    return _rows(rows, _VALUES)


def _scored(docs: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of a block: id, held_out, n_tokens, n_known, base (sum of log10(c + 0.1)) and score."""
    word: dict[bytes, float] = {}
    pieces = []
    for is_word, blob in zip(values["word"].to_pylist(), values["blob"], strict=True):
        if is_word:
            word.update(zip(*(x if isinstance(x, list) else x.tolist() for x in unpack_words(blob.as_py())), strict=True))
        else:
            pieces.append(unpack(blob.as_py()))
    keys, lp = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(keys)
    keys, lp = keys[order], lp[order].astype(np.float64)
    end, out = word[END], []
    for meta, streams in _runs(docs):
        base, known, count = np.zeros(len(streams)), np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
        for i, s in enumerate(streams):
            v = np.array([*map(word.__getitem__, s.split()), end])
            base[i], known[i], count[i] = v.sum(), (v > 0).sum(), len(v)
        score = np.zeros(len(streams))
        for run in slices(streams):
            key, sizes = grams(run)
            at = (key << np.uint64(16)) | np.repeat(np.arange(len(run), dtype=np.uint64), sizes)
            at.sort()
            key = at >> np.uint64(16)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            place = np.searchsorted(keys, key[first])
            if (place >= len(keys)).any() or (keys[place] != key[first]).any():
                raise RuntimeError("a block lacks values for its own grams")
            each = np.repeat(lp[place], np.diff(np.append(first, len(key))))
            sums = np.bincount((at & np.uint64(0xFFFF)).astype(np.int64), each, len(run))
            np.add.at(score, [i for i, *_ in run], sums)
        out.append(pa.table({"id": meta["id"], "held_out": meta["held_out"], "n_tokens": pa.array(count), "n_known": pa.array(known), "base": pa.array(base), "score": pa.array(score)}))
    return pa.concat_tables(out)


def score_language_model(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows that are not held out train."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    packed = _blocks(docs, id_col, F.coalesce(held_out, F.lit(False)), parts)
    counts = stored(packed.groupBy("block").applyInArrow(_counter(parts), _COUNTS_SQL), "ppm-counts")
    gram_counts = counts.where("not word").select("part", "block", "blob").repartition("part")
    totals = gram_counts.groupBy("part").applyInArrow(_gram_totals, "gram long, n long")

    low = stored(totals, "ppm-grams")
    few = low.where("n > 0").groupBy(F.col("gram").bitwiseAND((1 << (8 * (LOW + 1))) - 1).alias("g")).agg(F.sum("n").alias("n")).toPandas().sort_values("g")
    shared = spark.sparkContext.broadcast(low_levels(few["g"].to_numpy(np.uint64), few["n"].to_numpy(np.int64)))  # at most 2^24 rows

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of the last three bytes of context; those that share them are worked out together."""
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush(u: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(u)
            u, c = u[order], c[order]
            value = log_probabilities(u, c, shared.value).astype(np.float32)
            for p, at in by_part(u, parts):
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "blob": pa.array([pack(u[at], value[at])], pa.binary())})

        for b in batches:
            waiting.append((b["gram"].to_numpy().view(np.uint64), b["n"].to_numpy()))
            held += len(b)
            if held >= 400_000:
                u, c = (np.concatenate(x) for x in zip(*waiting, strict=True))
                tail = (u >> np.uint64(8)) & np.uint64(0xFFFFFF)
                cut = int(np.searchsorted(tail, tail[-1]))
                if cut:
                    yield from flush(u[:cut], c[:cut])
                waiting, held = [(u[cut:], c[cut:])], len(u) - cut
        if held:
            yield from flush(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    tail = F.shiftright("gram", 8).bitwiseAND(0xFFFFFF)
    model = low.select("gram", "n").repartition(tail).sortWithinPartitions(tail).mapInArrow(probabilities, "part int, blob binary")
    gram_values = gram_counts.groupBy("part").cogroup(model.groupBy("part")).applyInArrow(_gram_values, _VALUES_SQL)
    word_values = stored(counts.where("word").select("part", "block", "blob").groupBy("part").applyInArrow(_word_values, _VALUES_SQL), "ppm-words")
    sums = word_values.where("block is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("v"), F.lit(0)).alias("_v"))

    values = gram_values.unionByName(word_values.where("block is not null")).select("block", "word", "blob")
    kind = docs.schema[id_col].dataType.simpleString()
    scored = packed.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_scored, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    per_token = F.log10(F.col("train_tokens") + 0.1 * (F.col("_v") + 1))
    return scored.crossJoin(F.broadcast(sums)).select(  # sums: one row
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), "score"
    )


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from the folds 1 to 9."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_language_model(docs, id_remainder(F.col("doc_id"), 10) == 0)
