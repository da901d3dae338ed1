"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

A text becomes pieces like this: a blank is put before it and every blank becomes the white-space mark; among all ways to cut
the result into pieces of the vocabulary the one with the largest sum of log scores wins; a character that no piece covers is
spelled in byte pieces at a score below all others. Decoding puts the pieces together, bytes as bytes, and turns marks into
blanks again, without the first.

The vocabulary and its scores come from a public sentencepiece file. Its scores are taken as they stand, as the log scores of
a unigram model. Where no piece has a mark after another character, no piece reaches over the start of a word, so that each
word with its marks is cut by itself (`Encoder.apart`): the new words of many texts together, as arrays, once each. A bounded
number of words stays remembered. Otherwise a text is cut as a whole.

Null text: null ids and text. Empty text: no ids, decodes to the empty text. A mark that stands in the text itself decodes to
a blank, as in any tokenizer of this kind. Ties: the longer last piece wins. Texts of any length take time in proportion.
Repeated rows: equal results. Empty table: empty result. Extra columns are kept; those that
have the name of an added column give way to it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import RESULT, kept_columns, read_table, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that a worker remembers, characters and words it cuts at once, the length of words that it remembers, rows of a batch.
REMEMBERED, SHARE, AT_ONCE, SHORT, BATCH = 100_000, 1_000_000, 8_000, 64, 1000


@dataclass(frozen=True)
class Vocabulary:
    """pieces by id; scores; kinds: 0 text, 1 byte, 2 neither (control, unknown, unused)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.vocab_size())
    kind = lambda i: 1 if m.is_byte(i) else 2 * (m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
    return Vocabulary(tuple(map(m.id_to_piece, ids)), tuple(map(m.get_score, ids)), tuple(map(kind, ids)))


class DoubleArray:
    """A trie over bytes in two arrays: the child of state s by byte b is base[s] + b + 1 if check[] of that is s. Strings end in
    a child by code 0, whose base is -1 - value."""

    def __init__(self, values: dict[bytes, int]):
        self.base, self.check = [0] * 1024, [-1] * 1024
        self.check[0] = 0
        tree: dict = {}
        for key, value in values.items():
            node = tree
            for b in key:
                node = node.setdefault(b + 1, {})
            node[0] = value
        todo, lowest = [(0, tree)], 1
        while todo:
            state, node = todo.pop()
            codes = sorted(node)
            start = lowest
            while True:
                self._reach(start + 257)
                if all(self.check[start + c] < 0 for c in codes):
                    break
                start += 1
            while lowest < len(self.check) and self.check[lowest] >= 0:
                lowest += 1
            self.base[state] = start
            for c in codes:
                self.check[start + c] = state
            for c in codes:
                if c:
                    todo.append((start + c, node[c]))
                else:
                    self.base[start] = -1 - node[0]

    def _reach(self, n: int) -> None:
        if n >= len(self.check):
            self.base.extend([0] * n)
            self.check.extend([-1] * n)

    def matches(self, text: bytes, at: int) -> list[tuple[int, int]]:
        """(end, value) of every string that starts there."""
        base, check, state, found = self.base, self.check, 0, []
        for i in range(at, len(text)):
            to = base[state] + text[i] + 1
            if check[to] != state:
                break
            state = to
            if check[end := base[state]] == state and base[end] < 0:
                found.append((i + 1, -1 - base[end]))
        return found


class Encoder:
    """Encodes and decodes texts by a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        texts = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == 0}
        self.trie = DoubleArray({p.encode(): i for p, i in texts.items()})
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == 1}
        self.fallback = min((v.scores[i] for i in texts.values()), default=0.0) - 10
        self.raw = [bytes([int(p[3:5], 16)]) if k == 1 else p.encode() if k == 0 else b"" for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.arrays = np.array(self.trie.base, np.int32), np.array(self.trie.check, np.int32), np.array(v.scores)
        self.byte_ids = np.array([self.bytes.get(b, -1) for b in range(256)], np.int32)
        self.apart = not any(MARK in p.lstrip(MARK) for p in texts)
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str) -> tuple[int, ...]:
        """Ids of the best cut of one stretch of text."""
        raw, scores, matches = text.encode("utf-8", "replace"), self.vocabulary.scores, self.trie.matches
        n = len(raw)
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if (so_far := best[i]) is None:
                continue
            width = 1 if (b := raw[i]) < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            single = False
            for end, piece in matches(raw, i):
                single = single or end == i + width
                if (old := best[end]) is None or so_far + scores[piece] > old:
                    best[end], back[end] = so_far + scores[piece], (i, piece)
            if not single and ((old := best[i + width]) is None or so_far + self.fallback > old):
                best[i + width], back[i + width] = so_far + self.fallback, (i, -1)
        ids: list[int] = []
        while n:
            at, piece = back[n]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.bytes[b] for b in reversed(raw[at:n]))
            n = at
        return tuple(reversed(ids))

    def cut(self, words: list[bytes]) -> list[bytes]:
        """The ids of the best cut of many words at once, as little-endian 32-bit numbers: the steps of `viterbi`, each taken for
        all words together."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max(initial=0))
        codes = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).T.astype(np.int32)
        best, back, last = np.full((width + 1, n), -np.inf), np.zeros((width + 1, n), np.int32), np.zeros((width + 1, n), np.int32)
        best[0] = 0.0
        base, check, scores = self.arrays
        for i in range(width):
            rows = np.flatnonzero((sizes > i) & (best[i] > -np.inf))
            so_far, state = best[i, rows], np.zeros(len(rows), np.int32)
            starts, lead, alone = rows, codes[i, rows], np.zeros(n, bool)
            upto = i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)  # where the character ends
            char_end = np.zeros(n, np.int64)
            char_end[rows] = upto
            for j in range(i, width):
                to = base[state] + codes[j, rows] + 1
                on = (check[to] == state) & (sizes[rows] > j)
                rows, so_far, state = rows[on], so_far[on], to[on]
                if not len(rows):
                    break
                end = base[state]
                hit = (check[end] == state) & (base[end] < 0)
                at, piece = rows[hit], -1 - base[end[hit]]
                alone[at[char_end[at] == j + 1]] = True
                total = so_far[hit] + scores[piece]
                more = total > best[j + 1, at]
                at = at[more]
                best[j + 1, at], back[j + 1, at], last[j + 1, at] = total[more], i, piece[more]
            spelled = ~alone[starts] & (best[i, starts] + self.fallback > best[upto, starts])
            rows, upto = starts[spelled], upto[spelled]
            best[upto, rows] = best[i, rows] + self.fallback
            for j in range(i, int(upto.max(initial=i))):
                at = rows[upto > j]
                back[j + 1, at], last[j + 1, at] = j, self.byte_ids[codes[j, at]]
        ids, counts, place = [], np.zeros(n, np.int64), sizes.copy()
        while len(rows := np.flatnonzero(place)):  # from the end
            ids.append((rows, last[place[rows], rows]))
            counts[rows] += 1
            place[rows] = back[place[rows], rows]
        out, ends = np.zeros(int(counts.sum()), "<i4"), np.cumsum(counts)
        for k, (rows, piece) in enumerate(ids):
            out[ends[rows] - 1 - k] = piece
        if out.min(initial=0) < 0:
            raise KeyError("the vocabulary has no piece for a byte")
        raw = out.tobytes()
        return [raw[4 * (e - c) : 4 * e] for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]

    _stretch = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Pieces of many texts: what they have in common is cut once."""
        if not self.apart:
            return [None if t is None else np.array(self.encode(t), "<i4") for t in texts]
        known, find = self.known, self._stretch.findall
        out: list[np.ndarray | None] = []
        at = 0
        while at < len(texts):  # as many texts at a time as have about SHARE characters
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= SHARE):
                size += len(texts[upto] or "")
                upto += 1
            parts = [None if t is None else find(MARK + t.replace(" ", MARK)) if t else [] for t in texts[at:upto]]
            if len(known) > REMEMBERED:  # the half that was met last stays
                for w in list(islice(known, len(known) // 2)):
                    del known[w]
            words = set(chain.from_iterable(p for p in parts if p))
            fresh = {w: known.pop(w, None) for w in words}
            new = sorted((w for w, ids in fresh.items() if ids is None), key=len)
            short = bisect_right(new, SHORT, key=len)
            for a in range(0, short, AT_ONCE):
                some = new[a : min(a + AT_ONCE, short)]
                fresh.update(zip(some, self.cut([w.encode("utf-8", "replace") for w in some]), strict=True))
            fresh.update((w, np.array(self.viterbi(w), "<i4").tobytes()) for w in new[short:])
            out.extend(None if p is None else np.frombuffer(b"".join(map(fresh.__getitem__, p)), "<i4") for p in parts)
            known.update((w, ids) for w, ids in fresh.items() if len(w) <= SHORT)
            at = upto
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.apart:
            return list(self.viterbi(MARK + text.replace(" ", MARK)))
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each worker and vocabulary."""
    v = shared.value
    if id(v) not in _encoders:
        _encoders.clear()
        _encoders[id(v)] = Encoder(v)
    return _encoders[id(v)]


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """docs with ids, the pieces of text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())  # as large as the vocabulary

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(shared)
        for texts in batches:
            yield pd.Series(e.encode_all(texts.tolist()), dtype=object)

    return docs.select(*kept_columns(docs, "ids"), ids("text").alias("ids"))


def decode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """docs with decoded, the text of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(shared)
        for rows in batches:
            yield pd.Series([None if ids is None else e.decode(ids) for ids in rows], dtype=object)

    return docs.select(*kept_columns(docs, "decoded"), texts("ids").alias("decoded"))


def round_trip(docs: DataFrame, vocabulary: Vocabulary | None = None, *, texts: bool = True) -> DataFrame:
    """docs with ids (the pieces of text), decoded (the text of ids; only if texts), and of these n_pieces, n_bytes (pieces that are
    bytes), ids_sha256 (of the ids as little-endian 32-bit numbers) and same (decoded is the text); all null for a null text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())
    kinds = {"ids": "array<int>", **({"decoded": "string"} if texts else {}), "n_pieces": "long", "n_bytes": "long", "ids_sha256": "string", "same": "boolean"}

    def rows(e: Encoder, byte: np.ndarray, batch: list[str | None]) -> pa.Array:
        ids = e.encode_all(batch)
        each = lambda f: (None if x is None else f(x) for x in ids)
        decoded = each(lambda x: e.decode(x.tolist()))  # one at a time, unless they are asked for
        decoded = list(decoded) if texts else decoded
        out = {
            "ids": pa.array(ids, pa.list_(pa.int32())),  # from arrays as they are; a pandas UDF makes a list of numbers of each
            "n_pieces": pa.array(each(len), pa.int64()),
            "n_bytes": pa.array(each(lambda x: int(byte[x].sum())), pa.int64()),
            "ids_sha256": pa.array(each(lambda x: sha256(x.tobytes()).hexdigest()), pa.string()),
            "same": pa.array([None if d is None else d == t for d, t in zip(decoded, batch, strict=True)], pa.bool_()),
        }
        if texts:
            out["decoded"] = pa.array(decoded, pa.string())
        return pa.StructArray.from_arrays([out[n] for n in kinds], list(kinds))

    @F.arrow_udf(", ".join(f"{n} {kind}" for n, kind in kinds.items()))
    def both_ways(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = _encoder(shared)
        byte = np.array([k == 1 for k in e.vocabulary.kinds])
        for batch in batches:
            yield rows(e, byte, batch.to_pylist())

    kept = kept_columns(docs, *kinds)
    return docs.select(*kept, both_ways("text").alias(RESULT)).select(*kept, *(F.col(RESULT)[n].alias(n) for n in kinds))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether they decode to its text."""
    out = round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return stored(out.select("doc_id", "n_pieces", "n_bytes", "ids_sha256", "same", "ids"), "pieces", rows_a_batch=BATCH, rows_a_group=BATCH)
