"""Token counts by a linear longest-match automaton.

The vocabulary of a word-piece tokenizer is a trie with two roots: pieces that begin a word and pieces that go on with one.
Every node has a failure link, the node at which the rest of what was matched goes on once its longest pieces are cut off, and
the number of pieces cut off on that link. Greedy longest-match token counts then come from one walk over a word, adding up
these numbers; no piece is ever built.

The vocabulary is read from a public sentencepiece file: a piece that starts with the white-space mark begins a word, any
other one goes on with a word. Words are runs of anything but ASCII white space; a word that the vocabulary can't spell out
counts as one unknown token, as word-piece tokenizers have it. Null and empty texts: no words and no tokens. Words of any
length take time in proportion to it. Repeated rows: equal counts. Empty table: empty result. Extra columns are kept by
`with_token_counts`, but for any named n_words, n_tokens or n_unknown, which give way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import RESULT, kept_columns, read_table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose counts a worker remembers before it forgets them all.
REMEMBERED = 400_000


def read_pieces(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """Pieces that begin a word, and pieces that go on with one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [p[1:] for p in pieces if p[0] == MARK and p.strip(MARK)], [p for p in pieces if p[0] != MARK]


class LongestMatch:
    """The automaton. Nodes are numbers: 0 the root of words, 1 the root of what follows. cut[n]: pieces cut off on n's
    failure link, fail[n]: where the link leads, -1 if the vocabulary can't go on."""

    def __init__(self, first: Iterable[str], more: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, more)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.next[node].setdefault(c, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                        ends.append(False)
                ends[node] = node > 1
        self.fail, self.cut = [-1] * len(self.next), [0] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, child in self.next[node].items():
                    below.append(child)
                    if ends[child]:
                        self.fail[child], self.cut[child] = 1, 1
                        continue
                    at, cut = self.fail[node], self.cut[node]
                    while at >= 0 and c not in self.next[at]:
                        cut, at = cut + self.cut[at], self.fail[at]
                    if at >= 0:
                        self.fail[child], self.cut[child] = self.next[at][c], cut
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word, 0 if it can't be spelled out."""
        node, n, follow, fail, cut = 0, 0, self.next, self.fail, self.cut
        for c in word:
            while (to := follow[node].get(c)) is None:
                n += cut[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = to
        while node != 1:
            n += cut[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


def with_token_counts(docs: DataFrame, pieces: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """docs with n_words, n_tokens (unknown words count as one) and n_unknown."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces or read_pieces())  # as large as the vocabulary

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, known = LongestMatch(*shared.value), {}
        for texts in batches:
            out = []
            for text in texts:
                words = Counter((text or "").encode("utf-8", "replace").split())
                tokens = unknown = 0
                for word, times in words.items():
                    n = known.get(word)
                    if n is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = known[word] = automaton.count(word.decode("utf-8"))
                    tokens += (n or 1) * times
                    unknown += 0 if n else times
                out.append((words.total(), tokens, unknown))
            yield pd.DataFrame(out, columns=["n_words", "n_tokens", "n_unknown"])

    names = ("n_words", "n_tokens", "n_unknown")
    kept = kept_columns(docs, *names)
    return docs.select(*kept, counts("text").alias(RESULT)).select(*kept, *(F.col(RESULT)[n].alias(n) for n in names))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece token counts of every document."""
    return with_token_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
