"""Online packing, source divergence and filter interactions against brute force, with the awkward cases."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.llm import components, divergence, filter_audit, ngram_join, online_packing, tokens

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
WORDS, BYTES = (public.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    """More columns, with names that operators use for themselves."""
    names = ("mask", "digest", "part", "good", "toxic", "n", "p", "term", "value", "rank", "ids", "start", "length", "sequence_id")
    return df.withColumns({c: F.lit(1) for c in names})


def random_text(r):
    kind = r.random()
    if kind < 0.1:
        return r.choice([None, "", " \n\t", "#", "ABC DEF", "é ü\U0001f600 ñ", "one two"])
    words = [r.choice(["alpha", "Beta", "GAMMA", "x", "über", "it's", "50%", "#tag", "a|b", "end."]) if r.random() < 0.3 else f"w{chr(97 + r.randint(0, 25))}{r.randint(0, 3)}" for _ in range(r.randint(1, 160))]
    return r.choice([" ", "  ", "\n"]).join(words)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    texts = [random_text(r) for _ in range(60)] + ["long text of words " * 6000]
    out = [(i, r.choice(texts), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", None]), 1) for i in range(150)]
    copy = texts[-2]
    out += [(1000 + i, copy, "en", "a", 1) for i in range(60)] + [(None, copy, "en", "b", 1), (None, copy, "en", "b", 1), (5, out[5][1], "de", "c", 1), (7, "x", "fr", "only", 1), (7, "x", "fr", "only", 1)]
    return out


# ---- filter interactions

def failures(text):
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    n, different = len(words), len(set(words))
    return [n < 100, 100 * different < 80 * n, 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def interactions_by_force(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = [(lang or "", failures(t or "") + [i is not None and first[t or ""] < i], i in good, i in toxic) for i, t, lang, *_ in rows]
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            for step, letter in enumerate(order, 1):
                k, before = "ABCDE".index(letter), ["ABCDE".index(x) for x in order[: step - 1]]
                own = [d for d in docs if d[0] == part]
                alive = [d for d in own if not any(d[1][b] for b in before)]
                gone = [d for d in alive if d[1][k]]
                fails = [d for d in own if d[1][k]]
                shapley = sum(120 // sum(d[1]) for d in fails)
                out[part, order, step] = (len(alive) - len(gone), len(gone), len(fails) - len(gone), sum(sum(d[1]) == 1 for d in fails), sum(d[2] for d in gone), sum(d[3] for d in gone), shapley)
    return out


def test_filter_interactions(spark, rows):
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 170, 2)] + [(5, 0, 1), (5, 1, 0), (None, 1, 1), (9, None, None), (99999, 1, 1)]
    labels = [(i, q, int(t) if t is not None else None) for i, q, t in labels]
    df = clashing(spark.createDataFrame(rows, FIELDS).repartition(5))
    got = filter_audit.filter_interactions(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(2))).collect()
    expected = interactions_by_force(rows, labels)
    assert len(got) == len(expected) == 600 * len({r[2] or "" for r in rows})
    for r in got:
        assert tuple(r)[3:] == expected[r.part, r.filter_order, r.step]


def test_shapley_values_are_the_removals_of_all_orders(spark, rows):
    got = filter_audit.filter_interactions(spark.createDataFrame(rows, FIELDS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = got.withColumn("letter", F.substr("filter_order", F.col("step"), F.lit(1)))
    sums = got.groupBy("part", "letter").agg(F.sum("removed").alias("all"), F.min("shapley").alias("lo"), F.max("shapley").alias("hi"), F.sum("good_lost").alias("good"))
    assert all(r["all"] == r.lo == r.hi and r.good == 0 for r in sums.collect())


def test_parities_give_back_cells(spark):
    r = random.Random(8)
    rows = [(r.choice("ab"), r.randint(0, 31), r.random() < 0.5, r.random() < 0.2) for _ in range(700)]
    cells = filter_audit.mask_cells(filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"), 5), 5).collect()
    for c in cells:
        own = Counter(m for p, m, g, t in rows if p == c.part and {"all": True, "good": g, "toxic": t}[c.label])
        assert c.cells == [own[m] for m in range(32)]


def test_filters_of_no_documents(spark):
    none = spark.createDataFrame([], FIELDS)
    assert filter_audit.filter_interactions(none, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).count() == 0


# ---- source divergence

def divergence_by_force(rows, least, top):
    docs = [((lang or ""), (source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for _, t, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w in held if held[w] >= least)
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if w in set(kept))
        share = lambda c, v=len(kept), kept=kept: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * v) for w in kept}
        p = {s: share(counts[s]) for s in {d[1] for d in own}}
        q = share(sum(counts.values(), Counter()))
        for s in p:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in p if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(1, 50), (8, 3), (10_000, 50)])
def test_source_divergence(spark, rows, monkeypatch, least, top):
    monkeypatch.setattr(divergence, "PAIRS", 4)  # groups go through in several turns
    monkeypatch.setattr(divergence, "PARTIAL_ROWS", 50)
    df = clashing(spark.createDataFrame(rows, FIELDS).repartition(5))
    assert sorted(map(tuple, divergence.source_divergence(df, least, top).collect())) == divergence_by_force(rows, least, top)


def test_divergence_of_no_documents_and_of_texts_without_terms(spark):
    assert divergence.source_divergence(spark.createDataFrame([], FIELDS)).count() == 0
    bare = [(1, "1 2 !", "en", "a", 1), (2, None, "en", "b", 1), (3, "", "de", "a", 1)]
    got = sorted(map(tuple, divergence.source_divergence(spark.createDataFrame(bare, FIELDS)).collect()))
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_very_large_counts_stay_exact(spark):
    counts = spark.createDataFrame([(10**12 + 7, 3 * 10**12 + 1, 10**6)], "n long, total long, terms long")
    got = counts.select(divergence._share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).first().p
    assert got == 1 + 10**9 * (10**12 + 12) // (3 * 10**12 + 1 + 5 * 10**6)


# ---- online packing

def ids_of(text):
    return np.array([*tokenizers.Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.mark.parametrize(("capacity", "windows"), [(2048, 64), (32, 3), (8, 1)])
def test_online_packing(spark, rows, monkeypatch, capacity, windows):
    monkeypatch.setattr(online_packing, "FAN", 2)  # several rounds of merging
    small = [r for r in rows if capacity > 32 or len(r[1] or "") < 5000]
    df = clashing(spark.createDataFrame(small, FIELDS).repartition(7))
    sequences = online_packing.online_pack(df, WORDS, 1, capacity, windows).collect()
    ids = {t: ids_of(t) for t in {r[1] for r in small}}
    lengths = sorted((s.n_tokens for s in sequences if s.n_tokens < capacity), reverse=True)
    total = sum(len(ids[r[1]]) for r in small)
    # Without padding: all sequences are full but for the rest, in powers of two.
    assert sum(s.n_tokens for s in sequences) == total and lengths == online_packing.powers(total % capacity)
    assert len({s.sequence_id for s in sequences}) == len(sequences)
    pieces = defaultdict(list)
    for s in sequences:
        data, at = np.frombuffer(s.ids, "<u4"), 0
        assert len(data) == s.n_tokens
        for p in s.pieces:
            own = data[at : at + p.length]
            assert p.offset == at and zlib.crc32(own.tobytes()) == p.ids_crc32
            pieces[p.doc_id].append((p.start, p.doc_tokens, own.tobytes()))
            at += p.length
        assert at == s.n_tokens
    for doc, texts in itertools.groupby(sorted(small, key=lambda r: (r[0] is None, r[0])), key=lambda r: r[0]):
        own = [ids[r[1]] for r in texts]
        if len(own) == 1:
            whole = sorted(pieces[doc])
            assert b"".join(x for *_, x in whole) == own[0].tobytes() and {n for _, n, _ in whole} == {len(own[0])}
            assert [s for s, *_ in whole] == [0, *np.cumsum([len(x) // 4 for *_, x in whole])[:-1].tolist()]
        else:
            assert sum(len(x) for *_, x in pieces[doc]) == 4 * sum(map(len, own))
    got = online_packing.padding(spark.createDataFrame(sequences), capacity).first()
    assert (got.tokens, got.padding) == (total, 0)


def test_windows_are_bounded_and_take_the_best_fit():
    r = random.Random(4)
    own, free, number = online_packing.Windows(50, 4), {}, 0
    for doc in range(400):
        ids = np.zeros(r.randint(1, 70), np.uint32)
        left = len(ids) % 50
        list(own.put((doc, 0, ids, len(ids))))
        while left:  # the rule, told again
            fits = [(room, k) for k, room in free.items() if room >= left]
            if not fits and len(free) < 4:
                number += 1
                free[number] = 50
                fits = [(50, number)]
            room, k = min(fits) if fits else min((room, k) for k, room in free.items())
            n = min(left, room)
            free[k], left = room - n, left - n
            if not free[k]:
                del free[k]
        assert sorted(room for room, _ in own.free) == sorted(free.values()) and len(own.free) <= 4


def test_online_packing_of_no_documents(spark):
    none = online_packing.online_pack(spark.createDataFrame([], FIELDS), WORDS, 1)
    assert none.count() == 0 and online_packing.placed(none).count() == 0


# ---- what others share

@pytest.mark.parametrize("file", [WORDS, BYTES], ids=["words", "bytes"])
def test_ids_of_20000_awkward_strings(file):
    r = random.Random(5)
    pool = [*"abcXYZ  \n\n.,!?'#-_<|>0129\t\r", "İ", "K", "ſ", "é", "é", "́", "ß", "Ǆ", "ﬁ", "Σ", "ς", "中", "क़", "क़", "\U0001f600", "\xa0", "　", "ª", "²", "ẞ", "ǰ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startOFtext|>", "<|endof", "text|>", " the ", " don't", "WE'LL", "​", "\x00", "\x85", "≠"]
    encoder, plain = tokens.Encoder(file, 400), tokenizers.Tokenizer.from_file(file)
    for _ in range(20_000):
        text = "".join(r.choices(pool, k=r.randint(0, 14)))
        assert encoder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_components_without_the_last_task(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.id: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_bitmaps_never_part_sets_that_share_enough(spark):
    r = np.random.default_rng(6)
    ranks = np.zeros(1 << 20, np.uint8)
    pairs = []
    for _ in range(300):
        n = int(r.integers(1, 400))
        x = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        share = r.choice([0.0, 0.2, 0.5, 0.85, 0.9, 1.0])
        keep = x[r.random(len(x)) < share]
        more = int((1 - share) * n + r.integers(0, 1 + n // 9))
        y = np.unique(np.concatenate([keep, r.integers(0, 1 << 62, more).astype(np.uint64)]))
        if len(y):
            least = min(ngram_join.margin(len(x)), ngram_join.margin(len(y)))
            common = [len(np.intersect1d(ngram_join.prefix(x, ranks, k), ngram_join.prefix(y, ranks, k))) for k in range(3)]
            linked = ngram_join.links(len(x), len(y), len(np.intersect1d(x, y)))
            pairs.append((ngram_join.sketches(x, ranks).view(np.int64).tolist(), ngram_join.sketches(y, ranks).view(np.int64).tolist(), len(x), len(y), bool(all(c >= least for c in common)), bool(linked)))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>, n int, m int, enough boolean, linked boolean")
    got = df.select("enough", "linked", ngram_join.may_share(F.col("a"), F.col("b"), F.col("n"), F.col("m")).alias("may")).collect()
    assert all(g.may for g in got if g.enough or g.linked) and sum(g.linked for g in got) > 50
    assert sum(not g.may for g in got) > 20
