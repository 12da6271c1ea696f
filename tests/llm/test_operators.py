"""Operators against brute force on small fixtures with the awkward cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.llm import components, decontam, html_extract, jpeg_media, labelled, langid, line_dedup, ngram_join, packing, quality, token_records, tokens, toxicity

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
WORDS, BYTES = (public.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefgh", k=random.randint(2, 6))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(VOCABULARY, k=n))


def edited(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = "edit" + str(r.random())
    return " ".join(w)


BASE = prose(120, 1)
TEXTS = [
    (0, BASE), (1, edited(BASE, 1, 1)), (2, edited(BASE, 2, 2)), (3, edited(BASE, 12, 3)), (4, None), (5, ""), (6, "   \n "), (7, "one two"), (8, "One  two"), (9, "two one"), (10, prose(3000, 2)), (11, prose(3000, 2) + " tail"),
    (12, BASE.upper()), (13, "ÄÖ ß \U0001f600 ñ"), (14, BASE), (14, BASE), (15, "a b\n\n c\t d "), (16, "x" * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    # More columns, with names that operators use for themselves.
    return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n", F.lit(1)).withColumn("token", F.lit("t")).withColumn("score", F.lit(0.5)).withColumn("id", F.lit(3)).withColumn("y", F.lit(9)).withColumn("gone_lines", F.lit("g"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_by_force(texts):
    sets = [(d, shingle_set(t)) for d, t in texts]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((d, len(s), find(d)) for d, s in sets)


def test_ngram_join(docs):
    assert sorted(map(tuple, ngram_join.ngram_join(docs).collect())) == components_by_force(TEXTS)


def test_ngram_join_of_a_group_around_the_threshold(spark):
    base = prose(60, 9)
    texts = [(i, edited(base, i % 5, i)) for i in range(60)] + [(100 + i, base + " " + prose(40, 50 + i)) for i in range(20)] + [(200 + i, prose(6, 60 + i % 3)) for i in range(9)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_join(df).collect())) == components_by_force(texts)


def test_ngram_join_of_copies_that_a_longer_text_quotes(spark):
    # The longest text is the pivot of all that the others share with it, and fits none of them in size.
    passage, other = prose(300, 70), prose(300, 71)
    texts = [(0, edited(passage, 3, 72)), (1, edited(passage, 3, 73)), (2, passage + " " + other), (3, other)]
    expected = components_by_force(texts)
    assert expected[1][2] == 0
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_join(df).collect())) == expected


def test_ngram_join_lists_few_pairs_beside_a_group_of_near_copies(spark, monkeypatch):
    # Each outlier shares most of a base with 60 near copies, but too little of it to link with any.
    base = prose(400, 90)
    w = base.split()
    texts = [(i, edited(base, 1, i)) for i in range(60)]
    texts += [(100 + i, " ".join(["own" + str(k * 99 + i) if k % 37 == i % 37 else x for k, x in enumerate(w)])) for i in range(30)]
    listed, plain = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: listed.append(pairs.count()) or plain(pairs, *rest))
    got = sorted(map(tuple, ngram_join.ngram_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()))
    assert got == components_by_force(texts) and len({c for _, _, c in got}) == 31
    assert sum(listed) < 6 * len(texts)


def test_sets_that_link_share_what_they_need_of_prefixes():
    r = np.random.default_rng(8)
    ranks = r.integers(0, 3, 1 << 20).astype(np.uint8)
    linked = 0
    for _ in range(3000):
        n = int(r.integers(1, 80))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < r.choice([0.85, 0.9, 0.95, 1.0])], r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 6))).astype(np.uint64)]))
        if len(y) and ngram_join.links(len(x), len(y), len(np.intersect1d(x, y))):
            linked += 1
            for k in range(ngram_join.ORDERS):
                assert len(np.intersect1d(ngram_join.prefix(x, ranks, k), ngram_join.prefix(y, ranks, k))) >= ngram_join.need(len(x), len(y))
    assert linked > 1000


def test_training_gives_the_memory_of_its_sample_back(spark, monkeypatch):
    given, plain = [], toxicity.scratch.give_back
    monkeypatch.setattr(toxicity.scratch, "give_back", lambda: given.append(plain()))
    texts = spark.createDataFrame([(i, "you awful fool" if i % 2 else "a fine day") for i in range(40)], "doc_id long, text string")
    model = toxicity.train(texts, texts.selectExpr("doc_id", "int(doc_id % 2) AS toxic"))
    assert given and model.trees is not None


def test_training_leaves_texts_to_the_tasks(spark, monkeypatch):
    """The driver gets no text of the sample; the model is that of the rows at hand, also with repeated ids."""
    rows, docs, labels = labelled_data(spark, "toxic")
    docs, labels = docs.union(docs.where("doc_id < 9")), labels.union(labels.where("doc_id = 7").selectExpr("doc_id", "quality", "1 - toxic"))
    plain = toxicity.fit([(t, y) for _, t, y in labelled.sample(docs, labels, "toxic", toxicity.BY, toxicity.HELD_OUT)])
    sent, collect = [], type(docs).collect

    def watched(self):
        out = collect(self)
        sent.extend(out)
        return out

    keys, dealt = [], type(docs).repartitionByRange  # Spark sends a sample of the keys of ranges to the driver
    monkeypatch.setattr(type(docs), "collect", watched)
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda self, n, *by: keys.append(self.select(*by).columns) or dealt(self, n, *by))
    model = toxicity.train(docs, labels)
    assert keys == [["id"]]
    assert sent and max(len(v) for r in sent for v in r if isinstance(v, str)) < 30
    assert model.lexicon == plain.lexicon and model.lexicon and model.share == plain.share
    texts = [t or "" for _, t, _ in rows]
    assert model.scores(texts).tolist() == plain.scores(texts).tolist()
    one = toxicity.train(docs, labels.where("toxic = 1"))
    assert one.trees is None and one.share == 1


def test_one_of_each(docs, empty):
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect())
    assert kept == sorted({c for _, n, c in components_by_force(TEXTS)})
    assert ngram_join.one_of_each(docs).columns == docs.columns and ngram_join.one_of_each(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.id: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def hits_by_force(text, items):
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        iw = split(t)
        k = min(10, len(iw))
        grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(item))
    joined = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, empty):
    w = BASE.split()
    items = [(1, " ".join(w[20:45])), (2, "no " + " ".join(w[50:60]) + " yes"), (3, " ".join(w[70:79]) + " other"), (4, "ONE two!"), (10, " ".join(w[100:110])), (5, None), (6, "..."), (7, "edit"), (8, " ".join(["rep"] * 14))]
    more = [(30, " ".join(["rep"] * 12)), (31, " ".join(["rep"] * 30) + " q"), (32, " ".join(w[20:29])), (33, "x-" + "-".join(w[20:31]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    all_docs = docs.select("doc_id", "text", "n").union(spark.createDataFrame([(*m, 1) for m in more], "doc_id long, text string, n int"))
    got = sorted(map(tuple, decontam.decontaminate(all_docs, bench).collect()))
    assert got == sorted((d, *hits_by_force(t, items)) for d, t in TEXTS + more)
    long_only = bench.where("item_id in (1, 2, 3, 10, 8)")
    got = sorted(map(tuple, decontam.decontaminate(all_docs, long_only).collect()))
    assert got == sorted((d, *hits_by_force(t, [x for x in items if x[0] in (1, 2, 3, 10, 8)])) for d, t in TEXTS + more)
    assert not decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count()
    assert decontam.decontaminate(empty, bench).count() == 0
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == sorted(d for d, t in TEXTS if not hits_by_force(t, items)[-1])


def ids_of(file, text):
    t = tokenizers.Tokenizer.from_file(file)
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", [WORDS, BYTES])
def test_cached_ids_equal_plain_ones(file, monkeypatch):
    texts = ["a  b\n\n c\t d ", "It's  don't 'S we'LL ÉCOLE İx ΣΣ σ \xa0x", "", "\n", " ", "x\x1cy z w", "<|endoftext|> a", "é ́a", "\U0001f600 12345 ²½", "Word. word, a. b, A. ,. don't. ć. é, É.", BASE, BASE.upper()]
    texts += ["see <|endoftext|> there", "<|startoftext|>x", "end<|endoftext|>", "<|endoftext", "word!! (word)... 'a' a's!' x_y z%%% ***, é!\u0301 a-b- a\u0301. A!\nB?\n\nC;", "½. x². ǅ! ª. ʰ,"]
    monkeypatch.setattr(tokens, "CACHE_PARTS", 16)
    e = tokens.Encoder(file)
    for _ in range(2):
        assert [e.encode(t).tolist() for t in texts] == [ids_of(file, t) for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records(spark, docs, empty, tmp_path):
    folder = f"file://{tmp_path}/r"
    got = [tuple(r) for r in token_records.token_records(docs, WORDS, 2, folder).orderBy("start").collect()]
    expected, start = [], 0
    for d, t in sorted(TEXTS, key=lambda x: (x[0], x[1] or "")):
        ids = [*ids_of(WORDS, t), 2]
        expected.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == expected
    assert token_records.token_records(empty, WORDS, 2).count() == 0
    shard = max(tmp_path.glob("r/*.records"), key=lambda p: p.stat().st_size)
    path = f"file://{shard}".removesuffix(".records")
    rows = list(token_records.read_shard(path, 2))
    order = np.arange(len(rows))[::-1]
    assert [d for d, _ in token_records.read_shard(path, 2, order)] == [d for d, _ in rows][::-1]
    blob = bytearray(shard.read_bytes())
    blob[14] ^= 1
    shard.write_bytes(blob)
    with pytest.raises(ValueError, match="broken"):
        list(token_records.read_shard(path, 2))


def test_packing(docs, empty):
    rows = packing.best_fit_pack(docs, BYTES, 2, 64).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t in dict(TEXTS).items():
        ids, own = [*ids_of(BYTES, t), 2], sorted(by_doc[d], key=lambda r: (r.piece, r.start))
        own = own[:: sum(x == d for x, _ in TEXTS)]
        assert [r.length for r in own] == [len(ids) % 64 or 64] + [64] * (-(-len(ids) // 64) - 1)
        assert all(crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for r in own)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) >= -(-sum(r.length for r in rows) // 64)
    assert packing.best_fit_pack(empty, BYTES, 2).count() == 0


def test_packing_search():
    rng = np.random.default_rng(2)
    for lengths in ([6, 4, 5, 5, 3, 7], rng.integers(1, 65, 300), rng.integers(15, 65, 900), np.clip(rng.lognormal(2.5, 0.8, 700).astype(int), 1, 64), [64] * 9, []):
        counts = np.bincount(np.array(lengths, int), minlength=65)
        runs = packing.pack(counts)
        used = np.zeros(65, int)
        for filling, n in runs:
            assert sum(filling) <= 64
            for x in filling:
                used[x] += n
        assert all(f == tuple(sorted(f, reverse=True)) for f, _ in runs)
        assert (used == counts).all() and packing.lower_bound(counts) <= packing.n_bins(runs) <= packing.n_bins(packing.best_fit(counts))
    assert packing.n_bins(packing.pack(np.bincount([6, 5, 5, 4, 4, 3, 3], minlength=11))) == 3


def fewest_bins(lengths, cap):
    """By dynamic programming over subsets: bins, and what is used of the last one."""
    best = [(1, 0)] + [(99, 0)] * ((1 << len(lengths)) - 1)
    for done, (bins, used) in enumerate(best):
        for i, x in enumerate(lengths):
            if not done >> i & 1:
                best[done | 1 << i] = min(best[done | 1 << i], (bins, used + x) if used + x <= cap else (bins + 1, x))
    return best[-1][0]


def test_packing_search_finds_the_optimum():
    gained = 0
    for i in range(200):
        r = random.Random(i)
        cap = r.choice([20, 50, 100, 1024])
        low, high = r.choice([(1, cap), (cap // 5, cap // 2), (cap // 8, 2 * cap // 3)])
        lengths = [r.randint(max(1, low), high) for _ in range(r.randint(5, 11))]
        search = packing.Search(np.bincount(lengths, minlength=cap + 1))
        assert packing.n_bins(search.run()) == fewest_bins(lengths, cap) and search.proven
        gained += packing.n_bins(packing.best_fit(np.bincount(lengths, minlength=cap + 1))) > packing.n_bins(search.best)
    assert gained  # best fit alone does not find them all


def test_fillings_are_those_that_no_other_dominates():
    for i in range(60):
        r = random.Random(i)
        counts, free = np.bincount([r.randint(1, 9) for _ in range(7)], minlength=13), r.randint(3, 12)
        found = {()}
        for x in range(1, 13):
            found |= {tuple(sorted((*f, *[x] * n), reverse=True)) for f in found for n in range(1, int(counts[x]) + 1)}
        fit = {f for f in found if sum(f) <= free}
        best = {f for f in fit if not any(g != f and packing.dominates(g, f) for g in fit)}
        for price in packing.PRICES:
            got = [f for f in packing.fillings(counts, free, free, price) if f is not None]
            assert best <= set(got) <= fit and len(got) == len(set(got)) and len(got) <= 2 * len(best)


def test_media(docs, empty):
    media = jpeg_media.media_columns(docs)
    got = {(r.doc_id, r.payload_sha256): r for r in jpeg_media.media_features(media).collect()}
    for d, t in TEXTS:
        own = (t or "").encode()
        full = own.ljust(max(192, -(-len(own) // 192) * 192), b" ")
        r = got[d, hashlib.sha256(full).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(own), len(full), zlib.crc32(full[-16:])) and r.feature
    stored = {r.media for r in media.where("doc_id = 14").collect()}
    assert len(stored) == 1 and next(iter(stored)).startswith(b"\xff\xd8")
    assert sorted(map(tuple, jpeg_media.stored_features(docs).collect())) == sorted(map(tuple, jpeg_media.media_features(media).collect()))
    assert jpeg_media.media_features(jpeg_media.media_columns(empty)).count() == 0
    big = bytes(random.Random(1).randbytes(192 * 9000))
    (images,) = jpeg_media.decode(jpeg_media.encode([big]))
    assert len(images) == -(-9000 // jpeg_media.MAX_ROWS) and b"".join(t.tobytes() for _, t in images) == big
    with pytest.raises(ValueError):
        jpeg_media.decode([b"\xff\xd8\xff\xd9"])


def test_media_of_many_small_and_some_long_rows(spark):
    texts = [(i, prose(i % 7, i)) for i in range(3000)] + [(5000 + i, prose(90_000, i)) for i in range(2)] + [(None, "z"), (5000, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.payload_sha256, r.feature.count(":")) for r in jpeg_media.stored_features(df).collect())
    full = [(-1 if d is None else d, jpeg_media.payload(t)[0]) for d, t in texts]
    most = jpeg_media.MAX_ROWS * jpeg_media.ROW
    assert got == sorted((d, hashlib.sha256(p).hexdigest(), -(-len(p) // most)) for d, p in full)


def test_every_payload_byte_enters_the_thumbnail_hash():
    rows = np.full((64, 192), 100, np.uint8)
    assert len({jpeg_media.thumbnail_hash(rows + (np.arange(64) == k)[:, None] * np.linspace(0, 50, 192).astype(np.uint8)) for k in (0, 1, 63)} - {jpeg_media.thumbnail_hash(rows)}) == 2


def test_media_reads_other_baseline_files():
    """Three components, 2x2 sampling, AC coefficients, no restarts; written bit by bit."""
    dc, ac = ((0, 3) + (0,) * 14, (0, 3, 6)), ((0, 2, 2) + (0,) * 13, (0x00, 0x11, 0xF0, 0x02))
    dcs, acs = jpeg_media.codes(*dc), jpeg_media.codes(*ac)
    bits, pred = [], [0, 0, 0]

    def put(code, n):
        bits.extend(code >> (n - 1 - i) & 1 for i in range(n))

    def block(part, value):
        diff = value - pred[part]
        pred[part] = value
        size = {0: 0, 5: 3, -5: 3, 40: 6, -40: 6, 35: 6, -35: 6, 45: 6, -45: 6}[diff]
        put(*dcs[size])
        put(diff if diff > 0 else diff + (1 << size) - 1, size)
        put(*acs[0x11])
        put(1, 1)
        put(*acs[0x00])

    luma = [5, 45, 45, 5, 0, 40, 0, 40]
    for m in range(2):
        for v in luma[4 * m : 4 * m + 4]:
            block(0, v)
        block(1, 0)
        block(2, 0)
    bits += [1] * (-len(bits) % 8)
    scan = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    seg = jpeg_media._segment
    frame = seg(0xC0, bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    tables = seg(0xC4, bytes([0, *dc[0], *dc[1]])) + seg(0xC4, bytes([0x10, *ac[0], *ac[1]]))
    data = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0] + [16] * 64)) + frame + tables + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (((image, thumb),),) = jpeg_media.decode([data])
    assert (image.width, image.height) == (32, 16)
    assert (thumb.astype(int) - 128).tolist() == [[10, 90, 0, 80], [90, 10, 0, 80]]


def dedup_by_force(texts, least):
    first, gone, rows = {}, {}, sorted((d, t) for d, t in texts if t is not None)
    for d, t in rows:
        lines = t.split("\n")
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if sum(len(x.split()) for x in run) >= least:
                    first.setdefault(run, (d, i))
                    first[run] = min(first[run], (d, i))
                    gone.setdefault(run, []).append((d, i, j))
    out = {}
    for run, places in gone.items():
        for d, i, j in places:
            if (d, i) > first[run]:
                out.setdefault(d, set()).update(range(i, j))
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out.get(d, ())) for d, t in rows}


def test_line_dedup(spark, empty):
    p, q, r = prose(25, 20), prose(20, 21), prose(60, 22)
    texts = [(1, f"{p}\n{q}\nown words"), (2, f"other\n{p}\n{q}"), (3, f"{p}\nbetween\n{q}"), (4, r), (5, f"{r}\n\nend"), (6, None), (7, ""), (8, "short\nshort\nshort"), (9, f"{q}\n{q}\n{q}"), (10, f"a\n{p}\n{q}\nb"), (11, f"\n\n{r}\n")]
    texts += [(20 + i, "\n".join(random.Random(i).choices([p, q, "x y", "", prose(12, 30), prose(15, 31)], k=9))) for i in range(12)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("first", F.lit(1)).withColumn("gone_lines", F.lit(2))
    for least in (40, 25):
        out = line_dedup.dedup_lines(df, least)
        assert {x.doc_id: x.text for x in out.collect() if x.text is not None} == dedup_by_force(texts, least)
    assert out.columns == [*df.columns, "n_lines", "n_deleted"] and out.count() == len(texts)
    assert line_dedup.dedup_lines(empty).count() == 0


def shared_lines(x, y):
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def test_suffix_array_by_force(spark, monkeypatch):
    r = random.Random(8)
    texts = [(i, "\n".join(r.choices("abcd", k=r.randint(0, 12)))) for i in range(25)] + [(40, "a\nb\n" * 9), (41, "a\nb\n" * 9), (42, "z\na\nb\na\nb")]
    texts += [(43, "\n".join(["c"] * 17)), (44, "only\nhere"), (45, None), (None, "a\nb\nc\nd")]
    lines = {(line_dedup.NOWHERE if d is None else d): t.split("\n") for d, t in texts if t is not None}
    df = spark.createDataFrame(texts, "doc_id long, text string")
    array = line_dedup.suffix_array(line_dedup.islands(df)).orderBy("number").collect()
    everything = [x for own in lines.values() for x in own]
    repeated = {(d, i) for d, own in lines.items() for i, x in enumerate(own) if everything.count(x) > 1}
    assert [x.number for x in array] == list(range(len(array))) and {(x.doc, x.line) for x in array} == repeated
    suffixes = [lines[x.doc][x.line :] for x in array]
    assert [x.common for x in array][1:] == [shared_lines(a, b) for a, b in zip(suffixes, suffixes[1:])]
    # The order is that of a suffix array: two suffixes share as much as the neighbours between them.
    for a in range(0, len(array), 7):
        for b in range(a + 1, len(array)):
            assert shared_lines(suffixes[a], suffixes[b]) == min(x.common for x in array[a + 1 : b + 1])
    monkeypatch.setattr(line_dedup, "PART_ROWS", 9)  # many parts, so that what they show is carried far
    got = {(x.doc, x.line): x.longest for x in line_dedup.earlier_runs(df).collect()}
    for d, i in repeated:
        earlier = [shared_lines(lines[d][i:], lines[e][j:]) for e, j in repeated if (e, j) < (d, i)]
        assert got[d, i] == max(earlier, default=0)


def test_line_dedup_awkward_rows(spark):
    p, q = prose(45, 61), prose(50, 62)
    rows = [(None, p), (1, f"{p}\nx"), (2, f"y\n{p}"), (3, q), (3, q), (3, f"{q}\nz"), (4, f"{q}\n" * 4000 + "tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("a")).withColumn("n_deleted", F.lit("b")).withColumn("mark", F.lit("c"))
    got = sorted(((-1 if x.doc_id is None else x.doc_id), x.text, x.n_deleted) for x in line_dedup.dedup_lines(df).collect())
    assert got == [(-1, "", 1), (1, f"{p}\nx", 0), (2, "y", 1), (3, q, 0), (3, q, 0), (3, f"{q}\nz", 0), (4, "tail", 4000)]
    assert line_dedup.dedup_lines(df, counts=False).columns == df.columns


def labelled_data(spark, kind):
    rows = []
    for i in range(240):
        r, bad = random.Random(i), i % 4 == 0
        w = prose(r.randint(20, 60), i).split()
        if bad and kind == "toxic":
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scum"]))
        if bad and kind == "quality":
            w = [x + r.choice(["###", "$$$"]) for x in w]
        rows.append((i, " ".join(w), int(bad) if kind == "toxic" else int(not bad)))
    rows += [(900, None, 0), (901, "", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("y", F.lit(5)).withColumn("quality", F.lit(2)).withColumn("id", F.lit(1))
    labels = spark.createDataFrame([(i, y, y) for i, t, y in rows if t] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers(spark, kind, empty):
    rows, docs, labels = labelled_data(spark, kind)
    run = toxicity.toxicity if kind == "toxic" else quality.quality
    truth = {i: y for i, t, y in rows if t}
    got = run(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    flipped = labels.withColumn(kind, F.when(labelled.remainder("doc_id", 4) == 2, 1 - F.col(kind)).otherwise(F.col(kind)))
    assert sorted(map(tuple, run(docs, flipped).collect())) == sorted(map(tuple, got))
    assert {r.score for r in run(docs, labels.limit(0)).collect()} == {0.0} and run(empty, labels).count() == 0


def test_toxic_documents_go(spark):
    rows, docs, labels = labelled_data(spark, "toxic")
    kept = toxicity.kept(docs, labels)
    bad = {i for i, t, y in rows if t and y}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and len(ids & bad) <= 3 and len(ids) >= len(rows) - len(bad) - 3


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]


def test_language(spark, empty):
    r = random.Random(3)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "äöüxyz"}
    rows = [(i, " ".join("".join(r.choices(letters[k], k=4)) for _ in range(30)), k) for i, k in enumerate(list(letters) * 30)]
    rows += [(500, None, "aa"), (501, "123 !", "aa"), (502, "abc abd", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("rows", F.lit(1))
    got = {x.doc_id: x for x in langid.identify(df).collect()}
    assert all(got[i].lang_pred == k and 0 < got[i].score <= 1 for i, _, k in rows[:90])
    assert (got[500].lang_pred, got[501].lang_pred, got[502].lang_pred) == ("und", "und", "aa")
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    assert langid.identify(empty).count() == 0


def test_language_by_dense_vectors(spark):
    """Vectors by their definition: a term for each trigram, none shared or counted together."""
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choices(x, k=r.randint(1, 7))) for _ in range(20)), k) for i, (k, x) in enumerate([("aa", "abcdeÉ"), ("bb", "cdefghß"), ("cc", "äöüxyz")] * 25)]
    rows += [(90, "Abc ef-ab!  xyz\n" * 4000, "bb"), (91, "𝐀 x", "cc"), (92, "7", "aa"), (None, "abc", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit(1)).withColumn("size", F.lit(2))
    letters = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), (langid.CLASSES, langid.DIMENSIONS)).astype(int)

    def dense(text):
        codes = [0]
        for c in text:
            k = 0 if not c.isalpha() else (lambda low: low - 96 if 97 <= low <= 122 else 27 + low % (langid.CLASSES - 27))(ord(c.lower()[0]))
            if k or codes[-1]:
                codes.append(k)
        codes += [0] if codes[-1] else []
        out = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out if len(codes) > 1 else None

    sums = {k: 0 for k in ("aa", "bb", "cc")}
    for d, t, k in rows:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 3 != 1 and dense(t) is not None:
            sums[k] = sums[k] + dense(t) / np.linalg.norm(dense(t))
    unit = np.array([sums[k] / np.linalg.norm(sums[k]) for k in sorted(sums)])
    unit = unit - unit.mean(0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = {x.doc_id: x for x in langid.identify(df).collect()}
    for d, t, _ in rows:
        v = dense(t)
        if v is None:
            assert (got[d].lang_pred, got[d].score) == ("und", 0)
        else:
            cosines = unit @ v / np.linalg.norm(v)
            share = np.exp(langid.SHARPNESS * cosines)
            assert got[d].lang_pred == sorted(sums)[cosines.argmax()] and abs(got[d].score - share.max() / share.sum()) < 1e-4


def test_a_rare_language_is_learned(spark):
    rows = [(i, "abcde fgh ij", "aa") for i in range(3000)] + [(9000 + i, "zyx wvu tsr", "bb") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, 100, 20)
    assert model.languages == ["aa", "bb"] and model.predict("zyx tsr")[0] == "bb"


def test_preferences_by_force():
    r = np.random.default_rng(6)
    better, worse = r.normal(0.4, 1, (300, 4)), r.normal(0, 1, (300, 4))
    w = quality.bradley_terry(better, worse)
    loss = lambda v: np.log1p(np.exp(-(better - worse) @ v)).mean() + quality.PENALTY / 2 * v @ v
    for i in range(4):
        for step in (1e-3, -1e-3, 0.1, -0.1):
            moved = w.copy()
            moved[i] += step
            assert loss(moved) > loss(w)


def test_scores_by_force(spark):
    """The queries' scores are those of the sample's model on each text by itself; very long texts too."""
    for kind, run, module in (("toxic", toxicity.toxicity, toxicity), ("quality", quality.quality, quality)):
        rows, docs, labels = labelled_data(spark, kind)
        texts = {i: t or "" for i, t, _ in rows}
        sample = [(t, y) for i, t, y in rows if t and zlib.crc32(str(i).encode()) % 4 != 2]
        model = module.fit(sample)
        long = spark.createDataFrame([(7000, "word " * 200_000)], "doc_id long, text string")
        got = {r.doc_id: r.score for r in run(docs.select("doc_id", "text").union(long), labels).collect()}
        texts[7000] = "word " * 200_000
        for i, t in texts.items():
            assert abs(got[i] - float(model.scores([t])[0])) < 1e-9


def test_trees_by_exhaustive_splits():
    r = np.random.default_rng(3)
    x, y = r.integers(0, 6, (80, 3)).astype(float), r.integers(0, 2, 80).astype(float)
    y[x[:, 1] > 3] = 1
    trees = toxicity.Trees(depth=2, rounds=1, leaf=2.0).fit(x, y)
    b, p = trees._binned(x), np.full(80, y.mean())
    g, h = y - p, np.maximum(p * (1 - p), 1e-6)
    ((feature, cut, value),) = trees.trees

    def gain(rows, left):
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(rows & left) + part(rows & ~left) - part(rows)

    def check(k, rows, depth):
        assert abs(value[k] - trees.rate * g[rows].sum() / (h[rows].sum() + 1)) < 1e-12
        if depth == 2:
            return
        options = {(j, c): gain(rows, b[:, j] <= c) for j in range(3) for c in range(trees.bins)
                   if (rows & (b[:, j] <= c)).sum() >= 2 and (rows & (b[:, j] > c)).sum() >= 2}
        if feature[k] >= 0:
            assert abs(options[feature[k], cut[k]] - max(options.values())) < 1e-9
            left = b[:, feature[k]] <= cut[k]
            check(2 * k, rows & left, depth + 1)
            check(2 * k + 1, rows & ~left, depth + 1)
        else:
            assert max(options.values(), default=0) <= 1e-6

    check(1, np.ones(80, bool), 0)


def test_isotonic_by_force():
    for i in range(50):
        r = np.random.default_rng(i)
        raw, y = np.sort(r.normal(size=12)), r.integers(0, 2, 12).astype(float)
        # The best non-decreasing fit is the largest, over beginnings, of the least mean up to an end.
        best = [max(min(y[a : b + 1].mean() for b in range(k, 12)) for a in range(k + 1)) for k in range(12)]
        assert np.allclose(np.interp(raw, *toxicity.isotonic(raw, y)), best)


PAGE = """<html><head><title>T t</title></head><body><div id="cookie-notice">We use cookies accept</div><header class="site-header"><a href=/>Site name</a></header>
<div class="menu"><ul><li><a>Home</a><li><a>About us now</a></ul></div><div class="content"><h1>Big  title</h1><p>First para with words &amp; more words here to read.<p>Second one&nbsp;is here <b>bold</b> and <a href=x>a link</a>, fine.
<div class="ad-box">Buy now cheap</div><form><label>Name</label><input></form><ul><li>item one<li>item two</ul><p>End.</div>
<div class="sidebar"><p>Popular posts list of many words to read in the side bar which is long long long long long</div>
<section id="comments"><p>Great post I really like this blog keep on writing more and more of these things please</p></section><footer>&copy; x</footer><script>var a="<p>no</p>"</script></body></html>"""
ARTICLE = "<body><nav><a>x</a></nav><main><article><header><h1>Head</h1></header><p>Some text in here that is read by all.</p><!-- no --><aside>side note</aside><p>Bye.</p><section class='comments'><h2>Comments</h2><p>nice one</p></section></article></main><footer>f"


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "v", ARTICLE), (3, None, None), (4, "", ""), (5, "w", "plain words only"), (2, "v", ARTICLE), (6, "x", "<p>a<"), (7, "y", "<script>no")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("z"))
    got = [tuple(r) for r in html_extract.extract_pages(df).collect()]
    texts = {r[0]: r[2] for r in got}
    assert len(got) == len(rows) and all(r[3] == len(r[2]) for r in got)
    assert texts[1].split("\n") == ["Big title", "First para with words & more words here to read.", "Second one is here bold and a link, fine.", "item one", "item two", "End."]
    assert texts[2].split("\n") == ["Head", "Some text in here that is read by all.", "Bye."]
    assert (texts[3], texts[4], texts[5], texts[7]) == ("", "", "plain words only", "")
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_best_region_by_force():
    for i in range(300):
        r = random.Random(i)
        scores = [r.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(r.randint(0, 14))]
        sums = [(sum(scores[a:b]), -a, -b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max([x for x in sums if x[0] > 0], default=(0, 0, 0))
        a, b = html_extract.best_region(scores)
        assert sum(scores[a:b]) == best[0]


def test_html_weights_decide():
    learned = html_extract.learn(["<nav><p>a b c</p></nav><article><p>d e f g</p></article>"] * 20)
    flat = html_extract.Weights(words={})
    pages = [ARTICLE, PAGE, "<nav><p>Menu words that are many</p></nav><div><p>A text.</p></div>"]
    assert all(html_extract.extract(p, learned) != html_extract.extract(p, flat) for p in pages)
    # Prior weights hold where labelled pages say nothing; what these say often enough moves them.
    odd = "<div class='zork'>never text at all</div><article><p>words of the text</p></article>"
    moved = html_extract.learn([odd] * 200).words
    assert moved[".zork"] < -0.5 < 0 < moved["p"] and moved["aside"] == html_extract.prior()["aside"]


@pytest.mark.parametrize("page, text", [
    ('<p class="legal">This legal text is the article</p>', "This legal text is the article"),
    ("<div class='search results'><p>main text ...</p></div>", "main text ..."),
    ("<article><p>One two three.</p><div class='related-work'><p>Others did this.</p></div><p>End.</p></article>", "One two three.\nOthers did this.\nEnd."),
    ("<p title=don't>Hello .</p><p>more text</p>", "Hello .\nmore text"),
    ("<p title=\"a > b\">x<br>y</p><!-- <p>no</p> --><p hidden>no</p>", "x y"),
    ("<div>a</div>" * 3000, "\n".join("a" * 3000)),
    ("<div class='c'>" * 20000 + "deep text", "deep text"),
    ("<p>" + "long text " * 50000, ("long text " * 50000).strip()),
    ("</div>" * 20000 + "<p>x &lt; y &amp;&nbsp;z", "x < y & z"),
])
def test_html_cases(page, text):
    for weights in (html_extract.Weights(), html_extract.learn([ARTICLE])):
        assert html_extract.extract(page, weights) == text
