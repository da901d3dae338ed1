"""Training-data operators against brute force, exact round trips and held-out accuracy, with the awkward inputs of each."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import fingerprints, line_dedup, linking, mixing, near_duplicates, pieces, ppm, quality, rules, toxicity, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "two words", "a b c", "ä ö\x0bü — 語語", "x" * 5000, "word " * 300]


def docs(spark, texts, sources=None):
    rows = [(i, t, None, sources[i] if sources else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(n=120, seed=5):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    out = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 80))) + ("\nshared line of text, the same" if i % 4 == 0 else "") for i in range(n)]
    for i in range(0, min(40, n - 1), 2):
        words = out[i].split(" ")
        if len(words) > 30:
            words[3] = "changed"
        out[i + 1] = " ".join(words)
    return out + ODD + out[:5]


# --- mixing --------------------------------------------------------------------------------------------------------------
def test_mixing_meets_targets(spark):
    texts, sources = corpus(), None
    sources = [None if i % 11 == 0 else ("big" if i % 3 else f"s{i % 5}") for i in range(len(texts))]
    df = docs(spark, texts, sources)
    rows = mixing.mixing_plan(df).collect()
    assert len(rows) == len(texts)
    total = sum(r.size for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(c.words for c in r.copies)
    for some in by.values():
        assert abs(sum(r.taken for r in some) - some[0].target) <= 0.5 and some[0].target <= 2 * some[0].source_size + 1e-6
    assert sum(some[0].target for some in by.values()) == pytest.approx(min(1.5, 2) * total)
    again = {r.doc_id: r.taken for r in mixing.mixing_plan(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    mixed = [r.position for r in mixing.mix(df).collect()]
    assert mixed == sorted(mixed) and all(0 <= p <= 1 for p in mixed)
    assert mixing.mixing_plan(df.limit(0)).count() == 0
    odd = df.withColumn("taken", F.lit("mine")).withColumn("rows", F.lit(1)).withColumn("_key", F.lit(2))
    assert {r.doc_id: r.taken for r in mixing.mixing_plan(odd).collect()} == again and "_key" in mixing.mix(odd).columns


def test_mix_emits_the_words_of_the_plan(spark):
    texts = [" ".join(f"w{i}_{k}" for k in range(97)) + "\n" for i in range(9)] + ["  a\n\nb \x0b c\t"] * 3 + [None, ""]
    df = docs(spark, texts, [f"s{i % 2}" for i in range(len(texts))])
    plan = {r.doc_id: r for r in mixing.mixing_plan(df).collect()}
    rows = mixing.mix(df).collect()
    words = Counter()
    for r in rows:
        assert texts[r.doc_id].startswith(r.text)
        words[r.doc_id] += len(r.text.split())
    assert {i: p.taken for i, p in plan.items() if p.taken} == words
    assert any(r.text != texts[r.doc_id] for r in rows) and all(r.text == texts[r.doc_id] for r in rows if len(r.text.split()) == plan[r.doc_id].size)
    for i in range(5):
        assert spark.range(1).select(mixing.first_words(F.lit("  a\n\nb \x0b c\t"), F.lit(i)).alias("x")).first().x == ["", "  a", "  a\n\nb", "  a\n\nb \x0b c", "  a\n\nb \x0b c\t"][i]


def test_schedule_inverts(spark):
    knots = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 1.0), (0.25, 3.0), (1.0, 0.5))))
    area = lambda t: (t * (1 + (1 + 8 * t)) / 2) if t <= 0.25 else 0.5 + (t - 0.25) * (3 + (3 - (t - 0.25) * 2.5 / 0.75)) / 2
    for t in (0.0, 0.1, 0.25, 0.6, 1.0):
        got = spark.range(1).select(mixing.time_of(knots, F.lit(area(t) / area(1.0))).alias("t")).first().t
        assert got == pytest.approx(t, abs=1e-9)


# --- classifiers ---------------------------------------------------------------------------------------------------------
def _labelled(spark, bad_word=None):
    rnd = random.Random(9)
    good = lambda: " ".join(rnd.choice(["the", "river", "stone", "lamp", "house", "green", "walk", "paper"]) for _ in range(40))
    texts, labels = [], []
    for i in range(160):
        t = good()
        if i % 4 == 0:
            t = t.replace(" ", f" {bad_word} ", 6) if bad_word else " ".join(w.upper() + "%%%" for w in t.split())
        texts.append(t)
        labels.append((i, int((i % 4 == 0) == bool(bad_word))))
    return docs(spark, texts + ODD), spark.createDataFrame(labels[:120], "doc_id long, y int"), dict(labels)


def test_quality_learns(spark):
    df, labels, truth = _labelled(spark)
    model = quality.fit_quality(df, labels, label_col="y")
    got = {r.doc_id: r for r in quality.score_quality(df, model).collect()}
    assert all(got[i].predicted == y for i, y in truth.items()) and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 160 + len(ODD)
    assert got[160].score == got[161].score
    empty = quality.fit_quality(df, labels.limit(0), label_col="y")
    assert {round(r.score, 3) for r in quality.score_quality(df, empty).collect()} == {0.5}


def test_factorisation_identity():
    m = quality.FactorisationMachine(dims=12, rank=3)
    m.w = np.arange(12) / 10
    idx, x = np.array([1, 4, 7, 11]), np.array([0.5, 1.0, -2.0, 0.3])
    pairs = sum(float(m.v[idx[a]] @ m.v[idx[b]]) * x[a] * x[b] for a, b in itertools.combinations(range(4), 2))
    assert m.margin(idx, x) == pytest.approx(float(m.w[idx] @ x) + pairs)


def test_toxicity_finds_the_exact_nearest(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}".encode() for i in range(60)]
    examples = [dict(Counter(rnd.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=20))) for _ in range(300)]
    index = toxicity.BlockMaxIndex(examples)
    df = Counter(w for e in examples for w in e)
    vec = lambda e: {w: (1 + math.log(c)) * (math.log(300 / df[w]) if w in df else math.log(600)) for w, c in e.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    vs = [vec(e) for e in examples]
    for _ in range(20):
        q = dict(Counter(rnd.choices([*vocabulary, b"new"], k=15)))
        v = vec(q)
        want = sorted((sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u) for u in vs), reverse=True)[:7]
        _, got = index.nearest(q, 7)
        assert got.tolist() == pytest.approx(want, abs=1e-5)


def test_toxicity_learns(spark):
    df, labels, truth = _labelled(spark, "idiot")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels, label_col="y")).collect()}
    held = [i for i in truth if i >= 120]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in got.values()) and len(got) == 160 + len(ODD)
    assert {r.score for r in toxicity.score_toxicity(df, []).collect()} == {0.0}


# --- tokens --------------------------------------------------------------------------------------------------------------
def test_wordpiece_counts(spark):
    rnd = random.Random(8)
    first = ["a", "b", "ab", "abc", "ca", "c"]
    more = ["a", "b", "bc", "cab", "c"]
    automaton = wordpiece.LongestMatch(first, more)

    def greedy(word):
        n, at = 0, 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (more if at else first)), None)
            if end is None:
                return 0
            n, at = n + 1, end
        return n

    for _ in range(3000):
        word = "".join(rnd.choice("abcd" if rnd.random() < 0.05 else "abc") for _ in range(rnd.randint(1, 12)))
        assert automaton.count(word) == greedy(word), word
    df = docs(spark, ["ab cab", "abd zz", *ODD])
    got = {r.doc_id: r for r in wordpiece.with_token_counts(df, (first, more)).collect()}
    assert (got[0].n_words, got[0].n_tokens, got[1].n_unknown, got[1].n_tokens) == (2, 1 + greedy("cab"), 2, 2) and got[2].n_tokens == 0


def test_wordpiece_against_a_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    first, more = wordpiece.read_pieces()
    vocabulary = {p: i for i, p in enumerate(dict.fromkeys(["[UNK]", *first, *("##" + m for m in more)]))}
    t = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    automaton = wordpiece.LongestMatch(first, more)
    for text in corpus(20):
        if text and text.strip():
            assert sum(automaton.count(w) or 1 for w in text.split()) == len(t.encode(text).ids)


def test_pieces_round_trip_and_viterbi(spark):
    e = pieces.Encoder(pieces.read_vocabulary())
    v = e.vocabulary
    table = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == 0}

    def best(text):
        score = [0.0] + [-math.inf] * len(text)
        for i in range(len(text)):
            single = False
            for j in range(i + 1, min(len(text), i + 16) + 1):
                if text[i:j] in table:
                    single = single or j == i + 1
                    score[j] = max(score[j], score[i] + v.scores[table[text[i:j]]])
            if not single:
                score[i + 1] = max(score[i + 1], score[i] + e.fallback)
        return score[-1]

    for text in ["hello world", "  two  blanks ", "语言 ünï\n\tx\x00", *[t for t in corpus(12) if t]]:
        ids = e.encode(text)
        assert e.decode(ids) == text
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        got, i = 0.0, 0
        while i < len(ids):
            if v.kinds[ids[i]] == 1:
                width = len(bytes([int(v.pieces[ids[i]][3:5], 16)]).decode("latin1").encode("utf-8")) and (1 if (b := int(v.pieces[ids[i]][3:5], 16)) < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
                got, i = got + e.fallback, i + width
            else:
                got, i = got + v.scores[ids[i]], i + 1
        if len(marked) < 400:
            assert got == pytest.approx(best(marked))
    df = docs(spark, ODD)
    got = {r.doc_id: r for r in pieces.round_trip(df).collect()}
    assert got[0].n_pieces is None and got[1].n_pieces == 0 and all(r.same for i, r in got.items() if i)
    both = pieces.decode(pieces.encode(df)).collect()
    assert all(r.decoded == r.text for r in both)


def test_pieces_own_up_to_a_lost_mark(spark):
    rows = {r.doc_id: r for r in pieces.round_trip(docs(spark, ["a b", "a\u2581b", "\u2581"])).collect()}
    both = {r.doc_id: r.decoded == r.text for r in pieces.decode(pieces.encode(docs(spark, ["a b", "a\u2581b", "\u2581"]))).collect()}
    assert {i: r.same for i, r in rows.items()} == both == {0: True, 1: False, 2: False}


def test_pieces_come_out_themselves(spark):
    import corpus_pipeline as p

    texts = [*ODD, "a\u2581b", "nul \x00 end", *corpus(20)]
    e = pieces.Encoder(pieces.read_vocabulary())
    for r in pieces.round_trip(docs(spark, texts)).collect():
        ids = None if r.text is None else e.encode(r.text)
        assert r.ids == ids and r.decoded == (None if ids is None else e.decode(ids))
        assert ids is None or (r.n_pieces, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
    rows = pieces.op10_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(text) and all(r.ids == e.encode(text[r.doc_id]) for r in rows if text[r.doc_id] is not None)
    last = p.pieces(spark, docs(spark, texts), "").collect()
    assert [e.decode(r.ids) == texts[r.doc_id] for r in last if r.ids is not None] == [r.same for r in last if r.ids is not None]


def test_pieces_are_stored_in_small_row_groups(spark):
    import corpus_pipeline as p
    import pyarrow.parquet as pq

    texts = [None if i % 50 == 0 else f"text {i} of many" for i in range(2500)]
    for out in (p.pieces(spark, docs(spark, texts).coalesce(1), ""), pieces.op10_sentencepiece(spark, "/root/testdata/sf0.1")):
        sizes = [meta.row_group(i).num_rows for f in out.inputFiles() for meta in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(meta.num_row_groups)]
        assert sum(sizes) == out.count() and max(sizes) == pieces.BATCH
    assert "decoded" not in pieces.round_trip(docs(spark, texts), texts=False).columns


# --- language model --------------------------------------------------------------------------------------------------------
def _plain_ppm(train, texts):
    """Counts of every context, one symbol at a time."""
    counts: dict = {}
    stream = lambda t: ppm.PAD + ppm.stream_of(t) + ppm.END
    for t in train:
        s = stream(t)
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1
    out = []
    for t in texts:
        s, total = stream(t), 0.0
        for i in range(ppm.ORDER, len(s)):
            gone: set = set()
            for k in range(ppm.ORDER, -1, -1):
                c = {b: n for b, n in counts.get(s[i - k : i], {}).items() if b not in gone}
                if not c:
                    continue
                n = sum(c.values())
                if s[i] in c:
                    total += math.log10((2 * c[s[i]] - 1) / (2 * n))
                    break
                total += math.log10(len(c) / (2 * n))
                gone |= c.keys()
            else:
                total -= math.log10(256 - len(counts.get(b"", {})))
        out.append(total)
    return out


def test_ppm_against_plain_counts(spark):
    texts = corpus(40)
    df = docs(spark, texts)
    held = F.col("doc_id") % 5 == 0
    rows = {r.doc_id: r for r in ppm.score_language_model(df, held, block_bytes=2000).collect()}
    train = [t for i, t in enumerate(texts) if i % 5]
    assert [rows[i].score for i in range(len(texts))] == pytest.approx(_plain_ppm(train, texts), rel=1e-5, abs=1e-3)
    c = Counter(w for t in train for w in [*ppm.stream_of(t).split(), b"\n"])
    n, v = c.total(), len(c)
    for i, t in enumerate(texts):
        ws = [*ppm.stream_of(t).split(), b"\n"]
        assert rows[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(ws), sum(w in c for w in ws), n)
    alone = ppm.score_language_model(df.where("doc_id % 5 = 0"), F.lit(True)).collect()
    assert {r.train_tokens for r in alone} == {0} and alone[0].score == pytest.approx(-(len(ppm.stream_of(texts[alone[0].doc_id])) + 1) * math.log10(256))
    assert ppm.score_language_model(df.limit(0), held).count() == 0


# --- rules -----------------------------------------------------------------------------------------------------------------
def test_rules_measures(spark):
    texts = ["a b c d e f g h a b c d e f g h i", "x y\nx y\n\n \nx y", "!! ## $$ the of", *corpus(20)]
    got = {r.doc_id: r for r in rules.apply_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        ws = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)]
        wins = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
        covered = {k + j for k in range(len(ws) - 7) if wins[tuple(ws[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines, r.n_symbols) == (len(ws), sum(map(len, ws)), len(covered), len(lines) - len(set(lines)), sum(t.count(c) for c in "#*$%&|<>"))
        assert r.base_failed == (len(ws) < 20 or 100 * len(covered) > 30 * len(ws))
    assert rules.apply_rules(docs(spark, ODD).limit(0)).count() == 0


# --- fingerprints ------------------------------------------------------------------------------------------------------------
def _h(*values):
    """Spark's xxhash64 of numbers, arrays of numbers and texts."""
    seed = 42
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else (x & (2**64 - 1)).to_bytes(8, "little"), seed)
    return seed


def _brute_fingerprint(text):
    """Hash -> first place of the smallest anchors, by the definition of closed syncmers."""
    single = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
    h = [_h(x) for x in regex.findall(rf"[{single}]|[^\x20\x09-\x0D{single}]{{1,3}}", text or "")]
    if not h:
        return {}
    if len(h) < fingerprints.K:
        return {_h(h) >> 33: 0}
    inner, found, signed = [_h(*h[i : i + fingerprints.S]) for i in range(len(h) - fingerprints.S + 1)], {}, lambda x: x - 2**64 if x >= 2**63 else x
    width = fingerprints.K - fingerprints.S + 1
    for i in range(len(h) - fingerprints.K + 1):
        part = [signed(x) for x in inner[i : i + width]]
        if min(part) in (part[0], part[-1]):
            found.setdefault(_h(*inner[i : i + width]) >> 33, i)
    return dict(sorted(found.items())[: fingerprints.SIZE])


def _brute_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    sample = sorted(a.keys() | b.keys())[: fingerprints.SIZE]
    places = sorted((a[x], b[x]) for x in sample if x in a and x in b)
    return sum(i == 0 or y > places[i - 1][1] for i, (_, y) in enumerate(places)) / len(sample)


def test_fingerprints_match_brute_force(spark):
    texts = [*corpus(60), "語語語かな漢字 and more words of it", "abc " * 40, " ".join(f"w{i * 7919 % 1000}" for i in range(3000))]
    rows = {r.doc_id: r for r in fingerprints.against_edits(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    show = lambda print_: "".join(f"{x:08x}{p:08x}" for x, p in print_.items())
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        own, other, following = map(_brute_fingerprint, (t, edited, nxt))
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (show(own), show(other))
        assert r.near_edited == pytest.approx(_brute_likeness(own, other)) and r.near_next == pytest.approx(_brute_likeness(own, following))
    assert rows[0].fingerprint == rows[69].fingerprint and rows[60].fingerprint == rows[61].fingerprint == "" and rows[60].near_next == 1.0
    long = [r for i, r in rows.items() if 40 <= i < 60 and len(texts[i]) > 150]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.9 * len(long)
    assert fingerprints.against_edits(docs(spark, ODD).limit(0)).count() == 0


def test_likeness_counts_anchors_in_order(spark):
    halves = [" ".join(f"{c}{i * 7919 % 1000}" for i in range(400)) for c in "ab"]
    one, other = halves[0] + " " + halves[1], halves[1] + " " + halves[0]
    r = spark.range(1).select(*(fingerprints.likeness(fingerprints.sketch(F.lit(x)), fingerprints.sketch(F.lit(y))).alias(n) for n, x, y in (("same", one, one), ("moved", one, other), ("other", halves[0], halves[1])))).first()
    assert r.same == 1 and 0.8 < r.moved < 1 and r.other == 0


def test_repeated_rows_each_have_their_fingerprint(spark):
    df = docs(spark, ["aa bb cc", "dd ee ff"])
    rows = fingerprints.against_edits(df.unionByName(df).unionByName(df.limit(1).withColumn("text", F.lit("of the same id")))).collect()
    assert sorted(r.doc_id for r in rows) == [0, 0, 0, 1, 1] and len({r for r in rows}) == 3


# --- duplicates --------------------------------------------------------------------------------------------------------------
def _groups(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return {i: top(i) for i in ids}


def test_components(spark):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 180), rnd.randint(100, 180)) for _ in range(60)]
    links = [p for p in links if p[0] != p[1]] + [(300, i) for i in range(301, 400)]
    got = {r.id: r.component for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for p in links for x in p}
    assert got == {k: v for k, v in _groups(ids, links).items()}


def test_near_duplicates_lose_no_link(spark):
    rnd = random.Random(2)
    texts = corpus(80)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(120)]
    for i in range(40):  # a group of near copies, each edited elsewhere
        words = list(base)
        words[(i * 3) % 118] = f"edit{i}"
        texts.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{i}_{k}" for k in range(60)) for i in range(60)]  # a passage in common is no copy
    sets = []
    for t in texts:
        ws = [w for w in (t or "").encode().lower().split()]
        sets.append({tuple(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))} if ws else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    rows = {r.doc_id: r for r in near_duplicates.near_duplicates(docs(spark, texts), width=3, percent=85).collect()}
    want = _groups(range(len(texts)), links)
    assert {i: r.component_id for i, r in rows.items()} == want and {i: r.n_shingles for i, r in rows.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert all(r.kept == (r.component_id == i) for i, r in rows.items())


def test_near_duplicates_repeated_and_missing_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b + " end"), (3, b + " end"), (None, b), (None, "else where"), (None, "else where"), (9, None), (9, None)]
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.n_shingles, r.kept) for r in near_duplicates.near_duplicates(df, width=3, percent=85).collect()), key=str)
    assert got == sorted([(1, 1, 58, True), (1, 1, 58, True), (2, 1, 58, False), (3, 1, 59, False), (3, 1, 59, False), (None, 1, 58, False), (None, None, 1, True), (None, None, 1, True), (9, 9, 0, True), (9, 9, 0, True)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in near_duplicates.without_copies(df, width=3, percent=85).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, "else where"), (9, None), (9, None)], key=str)
    names = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert {(r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(names, width=3, percent=85).collect()} >= {("d2", "d1"), ("d3", "d1"), ("d9", "d9")}


def test_near_duplicates_split_large_buckets(spark):
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(200)]
    texts = [" ".join(passage + [f"q{i}_{k}" for k in range(rnd.randint(25, 45))]) for i in range(150)]  # about 0.75 alike, not linked
    base = [f"b{i}" for i in range(200)]
    for i in range(80):  # some linked to one another, some to none
        words = list(base)
        for k in range(rnd.randint(1, 9)):
            words[rnd.randint(0, 199)] = f"e{i}_{k}"
        texts.append(" ".join(words))
    sets = [set(zip(*(t.split()[k:] for k in range(3)))) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    compared, check = [], linking.Buckets.linked

    def counting(self, check_, rest):
        return check(self, check_, lambda mixed: (pairs := rest(mixed).cache(), compared.append(pairs.distinct().count()))[0])

    linking.Buckets.linked = counting
    try:
        rows = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs(spark, texts), width=3, percent=85).collect()}
    finally:
        linking.Buckets.linked = check
    assert rows == _groups(range(len(texts)), links) and len(set(rows.values())) > 150
    assert compared[0] < 800  # of 11175 pairs that have the passage in common, and 3160 of the others


def test_near_duplicates_at_the_least_similarity(spark):
    rnd, texts = random.Random(9), []
    for k in itertools.count():  # pairs of 0.8 whose signatures differ more than usual, but within reach
        words = [f"w{k}_{i}_{rnd.random()}" for i in range(50)]
        pair = [" ".join(words[:45]), " ".join(words[:40] + words[45:])]
        x, y = (near_duplicates.signature(near_duplicates.shingles(t, 1)) for t in pair)
        if 24 < (x != y).sum() <= 27:
            texts += pair
        if len(texts) == 6:
            break
    rows = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs(spark, texts), width=1, percent=80).collect()}
    assert rows == {i: i - i % 2 for i in range(6)}


def test_near_duplicates_layout_follows_percent(spark):
    for percent in range(76, 101):
        bounds, reach, checked = near_duplicates.layout(percent)
        assert near_duplicates.beyond(percent, reach) <= 1e-4 and near_duplicates.beyond(percent, checked) <= 1e-8 and reach <= checked
        assert 2 * len(bounds) > reach and bounds[0][0] == 0 and bounds[-1][1] == near_duplicates.PLACES
    with pytest.raises(ValueError):
        near_duplicates.near_duplicates(docs(spark, ODD), percent=70)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _edited(rnd, line, edits, letters="abcdé"):
    b = list(line)
    for _ in range(edits):
        i = rnd.randint(0, len(b))
        b[i : i + rnd.randint(0, 1)] = [rnd.choice(letters)] * rnd.randint(0, 1)
    return "".join(b)


def test_edit_distance_and_segment_keys(spark):
    rnd = random.Random(3)
    pairs = []
    for _ in range(700):
        a = "".join(rnd.choice("abcdé" if rnd.random() < 0.9 else "a") for _ in range(rnd.choice([rnd.randint(0, 45), rnd.randint(58, 100)])))
        pairs.append((a, _edited(rnd, a, rnd.randint(0, 4))))
    pairs += [("a" * n, "a" * (n + d)) for n in (20, 24, 62, 63, 64, 80) for d in (0, 1, 2, 3)] + [("", ""), ("", "a"), ("ab", ""), ("abc", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("n", F.length("a")).withColumn("m", F.length("b"))
    rows = rows.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b")).alias("near"), F.arrays_overlap(line_dedup.segment_keys("a", "n"), line_dedup.segment_keys("b", "m")).alias("meet")).collect()
    some = 0
    for r in rows:
        close = _distance(r.a, r.b) <= 2
        assert r.near == close, (r.a, r.b)
        if close and min(len(r.a), len(r.b)) >= line_dedup.LEAST:
            assert r.meet, (r.a, r.b)
            some += r.a != r.b
    assert some > 150


def _brute_lines(rows):
    """{(id, text): dropped numbers with near} by all pairs."""
    have = sorted({(i is not None, i, t or "", no, line) for i, t in rows if t is not None for no, line in enumerate(t.split("\n")) if line.strip(" \t\n\x0b\x0c\r")}, key=lambda x: (x[0], x[1] or 0, _h(x[2]) - 2**64 if _h(x[2]) >= 2**63 else _h(x[2]), x[3]))
    lines = list(dict.fromkeys(x[4] for x in have))
    links = [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if abs(len(lines[i]) - len(lines[j])) <= 2 and min(len(lines[i]), len(lines[j])) >= line_dedup.LEAST and _distance(lines[i], lines[j]) <= 2]
    group, seen, first, out = _groups(range(len(lines)), links), set(), set(), {}
    for _, i, t, no, line in have:
        g = group[lines.index(line)]
        if g in seen:
            out.setdefault((i, t), []).append((no, line not in first))
        seen.add(g)
        first.add(line)
    return out


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(12)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(18, 70))) for _ in range(25)]
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(60))
    pool = base + [_edited(rnd, x, rnd.randint(1, 3), "xyz") for x in base * 3] + ["short", " \t", ""]
    pool += [passage[:k] + "".join(rnd.choice("uvwxyz") for _ in range(6)) + passage[k:] for k in [rnd.randint(0, 60) for _ in range(60)]]  # share segments, aren't near copies
    rows = [(rnd.choice([None, *range(40)]), "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 8)))) for _ in range(60)]
    rows += [rows[3], rows[3], (5, None), (6, ""), (rows[4][0], rows[5][1])]
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)
    got, want = line_dedup.dedup_lines(df.withColumn("key", F.col("text"))).collect(), _brute_lines(rows)
    assert len(got) == len(rows) and sum(map(len, want.values())) > 100
    for r in got:
        gone = want.get((r.doc_id, r.key), [])
        assert r.dropped == [no for no, _ in gone] and r.n_near == sum(near for _, near in gone) and r.n_equal == len(gone) - r.n_near
        lines = None if r.key is None else r.key.split("\n")
        assert r.text == (None if lines is None else "\n".join(x for no, x in enumerate(lines) if no not in r.dropped)) and r.n_lines == len(lines or ())


def test_line_dedup_splits_lines_with_a_passage_in_common(spark):
    rnd = random.Random(21)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    lines = [passage[:k] + "".join(rnd.choice("ijklmnopqrstuvwxyz") for _ in range(8)) + passage[k + 8 :] for k in range(0, 292)]
    compared, linked = [], linking.Buckets.linked

    def counting(self, check_, rest):
        return linked(self, check_, lambda mixed: (pairs := rest(mixed).cache(), compared.append(pairs.distinct().count()))[0])

    linking.Buckets.linked = counting
    try:
        rows = line_dedup.dedup_lines(docs(spark, lines)).collect()
    finally:
        linking.Buckets.linked = linked
    assert all(r.dropped == [] for r in rows) and compared[0] < 6000  # of 42486


def test_line_dedup(spark):
    line = "a long enough line of words number one"
    texts = [f"{line}\nother\n\nother", f"{line.replace('one', 'two')}\nkept line that is different", None, f"{line}\nother", "", line.replace("long", "lang")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].text == f"{line}\nother\n" and got[0].dropped == [3]
    assert (got[1].n_near, got[1].n_equal, got[1].text) == (0, 0, texts[1])  # three edits
    assert got[2].text is None and got[2].n_lines == 0 and got[3].text == "" and got[3].n_equal == 2 and got[4].text == ""
    assert got[5].text == "" and got[5].n_near == 1
    assert line_dedup.dedup_lines(docs(spark, ODD).limit(0)).count() == 0 and line_dedup.dedup_lines(docs(spark, ODD)).count() == len(ODD)


def test_line_bits_keep_every_link_and_little_else(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))

    def edited(line, n):
        for _ in range(n):
            at, kind = rnd.randrange(len(line)), rnd.randrange(3)
            line = line[:at] + ("" if kind == 2 else rnd.choice("abcxyzü語😀 ")) + line[at + (kind != 1) :]
        return line

    bases = [" ".join(word() for _ in range(rnd.randint(4, 30))) for _ in range(150)] + ["aaaa " * k for k in (5, 9, 40)] * 10
    near = [(x, edited(x, rnd.randint(0, 2))) for x in bases]
    other = [(x, " ".join([*x.split(" ")[:2], word(), *x.split(" ")[3:]])) for x in bases[:150]]  # one word of five letters changed
    lines = [line for both in near + other for line in both]
    rows = line_dedup._rare_pairs(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    x, y = (rows.select((F.floor(F.col("id") / 2)).alias("k"), "id", "bits").where(F.col("id") % 2 == i).alias(n) for i, n in enumerate("xy"))
    got = {r.k: r.ok for r in x.join(y, F.col("x.k") == F.col("y.k")).select("x.k", line_dedup._bits_agree("x", "y").alias("ok")).collect()}
    assert len(got) == len(near) + len(other) and all(got[k] for k in range(len(near)))
    assert sum(got[k] for k in range(len(near), len(got))) <= 15


# --- pipeline ----------------------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from lodestone.llm.common import stored

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    df, names = table, [n for n, _ in p.STAGES]
    assert len(names) == 5
    for _, stage in p.STAGES[:-1]:
        out = stored(stage(spark, df, sf), "test")  # as the stages are run: written and read again
        assert out.columns == table.columns and 0 < out.count()
        df = out
    last = p.STAGES[-1][1](spark, df, sf)
    assert last.where("same").count() == last.count() == df.count()


def test_pipeline_scores_in_small_batches(spark, monkeypatch):
    import corpus_pipeline as p

    sf, calls, write = "/root/testdata/sf0.001", [], p.stored
    monkeypatch.setattr(p, "stored", lambda df, name, **more: calls.append(more) or write(df, name, **more))
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert p.quality(spark, table, sf).columns == table.columns and calls == [{"rows_a_batch": p.BATCH}]


@pytest.mark.parametrize("run", [
    lambda d: quality.score_quality(d, quality.FactorisationMachine()), lambda d: toxicity.score_toxicity(d, []), lambda d: wordpiece.with_token_counts(d, (["a"], ["a"])), lambda d: pieces.round_trip(d), lambda d: rules.apply_rules(d), lambda d: line_dedup.dedup_lines(d),
    lambda d: near_duplicates.without_copies(d), lambda d: fingerprints.against_edits(d), lambda d: ppm.score_language_model(d, F.lit(False)),
])
def test_clashing_columns_nulls_and_empty_tables(spark, run):
    df = docs(spark, ODD).withColumns({c: F.lit("x") for c in ("score", "predicted", "nearest", "n_words", "same", "kept", "dropped", "n_lines", "_hit", "_v", "id", "size")})
    df = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    out = run(df)
    assert len(set(out.columns)) == len(out.columns) and out.count() <= df.count()
    assert run(df.limit(0)).count() == 0
