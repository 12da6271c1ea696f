"""Similarity join of documents on word 5-grams, by prefix filters under several token orders.

A document's set holds its distinct runs of SHINGLE words (the whole text as one run where it has
fewer words; nothing where it has none). Two sets link when their Jaccard similarity is 0.8 or more.

Two such sets of sizes n and m share, under any total order of tokens, one of the first
n - ceil(0.8 n) + 1 tokens of the one and of the other, and k of them if each prefix is k - 1 tokens
longer; here k is an eighth of the smaller set. Orders put tokens of many documents last and are
random otherwise. Candidates come from a join on the prefix tokens of the first order. A set that
shares too few of these with all others together is out. Each set also has three small bitmaps, of its
prefixes under the three orders; bits that one prefix has and the other lacks bound from above what
both share, so that a pair goes on only if it can share enough under every order. How much is enough
follows from both sizes (`need`): two sets of about one size must share two thirds of their prefixes, so that
a set with many tokens of its own meets none of a group of near copies. What is left after
all three filters is verified: its sets are fetched, their prefixes intersected, and compared. Equal
sets are one class from the start.

How common a token is comes from one count table of fixed size over all documents (each token counts
in one slot); any table gives a right order, a good one keeps common passages out of prefixes.

Pairs are not listed within a group of sets that share a token. First each set meets a few pivots of
its groups; what proves linked is merged, until a round merges few sets, and only pairs between
different components are listed then, so that large groups of near copies cost a few pairs for each
member. No link between
components can be missed: any two linked sets share a prefix token, and are compared unless they are
already connected.

Cases: null and empty texts have an empty set, size 0, and are their own component; repeated rows
each get a row, in one component if not empty (rows of one id but different texts count as one node
that has all their sets); rows without a doc_id have the component of equal sets with one, else null, and
link nothing; a very long text is one set; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm import scratch
from lexspan.llm.components import components

SHINGLE = 5
ORDERS = 3
#: A set must share one in so many of its tokens within prefixes, which are longer by as much.
MARGIN = 8
#: Slots of the count table, and rows that it is sent in.
SLOTS, BLOCKS = 1 << 20, 32
#: Most rounds of pivots before pairs between components are listed, and pivots that a group can have.
ROUNDS, PIVOTS = 3, 4
#: Rounds of pivots end when one with random pivots, after one with central ones, links less than this share of the sets.
FEW_LINKS = 0.0002
#: Bits of a prefix's bitmap for each of its tokens, at least.
BITS = 4
#: Parts of a common token's postings.
SALTS = 16
#: Classes to compare are broadcast up to this many rows (up to 100 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: Words whose hashes a worker keeps; only saves time.
WORDS = 20_000
#: Postings that a task sends at a time.
HELD = 1 << 18
#: Digests of sets that a task remembers, to pass over copies early.
SEEN = 200_000
#: Postings that a task may hold, bytes of sets in a part (as many as its pairs at most), and partners of a set in one part.
POSTINGS, SET_BYTES, PAIR_BYTES, PARTNERS = 400_000, 8 << 20, 64 << 20, 500

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_ASCII = bytes.maketrans(UPPER, LOWER)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers whose results look random."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Hashes(dict):
    """Hashes of words; those of the first WORDS words are kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS and len(word) <= 32:
            self[word] = h
        return h


_hashes = Hashes()


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct k-word runs."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for i in range(k):
        out = mix(out ^ h[i : len(h) - k + 1 + i], i)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def least_common(n):
    """How many tokens a set must share with another one to link, whatever that one's size: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def links(n: int, m: int, shared: int) -> bool:
    return 9 * shared >= 4 * (n + m)


def margin(n):
    """How many prefix tokens a set of this size must share, at least 1."""
    return np.maximum(1, n // MARGIN)


def prefix_size(n):
    return n - least_common(n) + margin(n)


def need(n, m):
    """How many prefix tokens two sets of these sizes must share to link, under each order.

    They share ceil(4 (n + m) / 9) tokens. Of the set whose prefix ends first, all tokens of its prefix that
    the other one has lie in the other one's prefix too, so at most the rest of that set is shared outside prefixes.
    """
    return np.maximum(1, (4 * (n + m) + 8) // 9 - np.maximum(n - prefix_size(n), m - prefix_size(m)))


def least_shared(n: Column) -> Column:
    """`least_common` of a column."""
    return F.floor((4 * n + 4) / 5)


def margins(n: Column) -> Column:
    """`margin` of a column."""
    return F.greatest(F.lit(1), F.floor(n / MARGIN))


def needed(n: Column, m: Column) -> Column:
    """`need` of columns."""
    rest = lambda x: least_shared(x) - margins(x)
    return F.greatest(F.lit(1), F.floor((4 * (n + m) + 8) / 9) - F.greatest(rest(n), rest(m)))


def prefix(tokens: np.ndarray, ranks: np.ndarray, order: int, in_order: bool = True) -> np.ndarray:
    """The first tokens under an order, by how common they are and at random within that; in any order if that doesn't matter."""
    p = int(prefix_size(len(tokens)))
    key = (ranks[(tokens >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(tokens, 11 + order) >> np.uint64(8))
    first = np.argpartition(key, p - 1)[:p] if p < len(tokens) else np.arange(len(tokens))
    return tokens[first[np.argsort(key[first])]] if in_order else tokens[first]


def levels(n: int, p: int) -> np.ndarray:
    """For each place in a prefix: 2 where one of two sets must share if it is the smaller, 1 where the
    larger one must, else 0. The smaller one shares 8/9 of its tokens, the larger one 4/5."""
    at = np.arange(p)
    return (at < n - (8 * n + 8) // 9 + 1).astype(np.int32) + (at < n - least_common(n) + 1)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit for each token of a prefix, in a power of two of 64-bit words; halves laid together give the shorter bitmap."""
    words = 1 << max(0, (len(tokens) * BITS - 1).bit_length() - 6)
    bits = np.zeros(words * 64, np.uint8)
    bits[(mix(tokens, 29) & np.uint64(words * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)


def sketches(tokens: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The bitmaps of a set's prefixes under all orders, one behind the other, of one length."""
    return np.concatenate([bitmap(prefix(tokens, ranks, k, in_order=False)) for k in range(ORDERS)])


def may_share(a: Column, b: Column, n: Column, m: Column, enough: Column | None = None) -> Column:
    """Whether sets of n and m tokens with these sketches can share enough prefix tokens under every order.

    Without a number that is enough, one that any two sets with one of these sizes must share.
    """
    size = lambda x: x - least_shared(x) + margins(x)
    words = F.least(F.size(a), F.size(b)) / ORDERS  # of each order, in the shorter sketch

    def folded(s: Column, k: int) -> Column:
        own = (F.size(s) / ORDERS).cast("int")
        cut = F.slice(s, own * k + 1, own)
        half = (own / 2).cast("int")
        both = F.zip_with(F.slice(cut, F.lit(1), half), F.slice(cut, half + 1, half), lambda x, y: x.bitwiseOR(y))
        return F.when(own <= words, cut).when(own == 2 * words, both)  # null where sizes differ more: no test

    def apart(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda s, c: s + c)

    enough = F.least(margins(n), margins(m)) if enough is None else enough
    tests = F.lit(True)
    for k in range(ORDERS):
        x, y = folded(a, k), folded(b, k)
        tests = tests & F.coalesce((size(n) - apart(x, y) >= enough) & (size(m) - apart(y, x) >= enough), F.lit(True))
    return tests


#: Documents that are hashed at a time.
SLICE = 1_000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


_WORDS = pa.list_(pa.int64())
SIGNED = "doc_id long, n int, digest long, block int, counts binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end BLOCKS rows with this task's counts of tokens."""
    counts, seen = np.zeros(SLOTS, np.uint32), set()
    for batch in _slices(batches):
        docs, sizes, digests, new = batch.column(0).to_pylist(), [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            digest = xxhash.xxh3_64_intdigest(s.tobytes())
            sizes.append(len(s))
            digests.append(digest - (1 << 63))
            if len(s) and digest not in seen:
                if len(seen) < SEEN:  # only saves counting copies twice
                    seen.add(digest)
                new.append(s)
        if new:
            counts += np.bincount((np.concatenate(new) >> np.uint64(44)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        nothing = [None] * len(docs)
        yield _batch({"doc_id": (docs, pa.int64()), "n": (sizes, pa.int32()), "digest": (digests, pa.int64()), "block": (nothing, pa.int32()), "counts": (nothing, pa.binary())})
    if counts.any():
        nothing = [None] * BLOCKS
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, BLOCKS)]
        yield _batch({"doc_id": (nothing, pa.int64()), "n": (nothing, pa.int32()), "digest": (nothing, pa.int64()), "block": (range(BLOCKS), pa.int32()), "counts": (parts, pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.uint64)
            sums[block] = sums[block] + x if block in sums else x
    yield _batch({"block": (list(sums), pa.int32()), "counts": ([x.tobytes() for x in sums.values()], pa.binary())})


def commonness(signed: DataFrame) -> np.ndarray:
    """For each slot 0 if its tokens are as common as most, else a rank by how much more common."""
    rows = signed.where(F.col("block").isNotNull()).select("block", "counts")
    total = np.zeros((BLOCKS, SLOTS // BLOCKS))
    for r in rows.repartition(BLOCKS, "block").mapInArrow(_summed, "block int, counts binary").collect():  # SLOTS numbers
        total[r.block] = np.frombuffer(r.counts, np.uint64)
    total = total.ravel()
    usual = np.median(total)
    excess = total - usual
    ranks = np.where(excess > 8 * np.sqrt(usual) + 8, 1 + np.log2(np.maximum(excess, 1)), 0)
    return ranks.astype(np.uint8)


#: A posting: size is eight times the size of the set, plus twice the level of the token's place, plus 1 if the token is common.
POSTING = np.dtype([("token", "<u8"), ("digest", "<u8"), ("size", "<u4")])


def _packed(tokens: list[np.ndarray], digests: list[int], sizes: list[np.ndarray], ranks: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part with its postings; those of a common token lie in SALTS parts by their sets."""
    out = np.empty(sum(map(len, tokens)), POSTING)
    token, digest = np.concatenate(tokens), np.repeat(np.array(digests, np.uint64), [len(t) for t in tokens])
    common = ranks[(token >> np.uint64(44)).astype(np.int64)] > 0
    part = (mix(token + np.where(common, digest % np.uint64(SALTS), np.uint64(0)), 31) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part)
    out["token"], out["digest"], out["size"] = token[order], digest[order], (np.concatenate(sizes) * 2 + common)[order]
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(ends))
    at = np.append(ends[some], len(out)) * POSTING.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), data], ["part", "postings"])


def _postings(ranks, parts: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, digests, sizes, held = [], [], [], 0
        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                digest = xxhash.xxh3_64_intdigest(s.tobytes())
                if not len(s) or digest in seen:
                    continue
                if len(seen) < SEEN:  # only saves sending copies
                    seen.add(digest)
                first = prefix(s, ranks.value, 0)
                tokens.append(first)
                digests.append(digest ^ (1 << 63))
                sizes.append(len(s) * 4 + levels(len(s), len(first)))
                held += len(first)
                if held >= HELD:
                    yield _packed(tokens, digests, sizes, ranks.value, parts)
                    tokens, digests, sizes, held = [], [], [], 0
        if held:
            yield _packed(tokens, digests, sizes, ranks.value, parts)

    return post


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of tokens that more than one set has; of common tokens all; each once."""
    parts = [np.frombuffer(x.as_buffer(), POSTING) for b in batches for x in b.column(0)]
    if not parts:
        return
    x = np.concatenate(parts)
    del parts
    x = x[np.argsort(x["token"])]
    same = x["token"][1:] == x["token"][:-1]
    x = x[np.append(same, False) | np.append([False], same) | (x["size"] % 2 == 1)]
    x = x[np.lexsort((x["digest"], x["token"]))]
    token, digest, size = x["token"], x["digest"], x["size"]
    new = np.ones(len(x), bool)  # tasks post copies of their own
    new[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])
    token, digest, size = token[new], digest[new], size[new]
    same = token[1:] == token[:-1]
    more = np.flatnonzero(np.append(same, False) | np.append([False], same) | (size % 2 == 1))
    for i in range(0, len(more), 1 << 17):
        part = more[i : i + (1 << 17)]
        yield _batch({"token": (token[part].view(np.int64), pa.int64()), "digest": (digest[part].view(np.int64), pa.int64()), "size": ((size[part] // 2).astype(np.int32), pa.int32())})


def _sets(ranks):
    """The set of each text, its size, digest and sketches."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def packed() -> pa.RecordBatch:
            rep, n, digest, tokens, sketch = zip(*rows, strict=True)
            return _batch({"rep": (rep, pa.int64()), "n": (n, pa.int32()), "digest": (digest, pa.int64()), "tokens": (tokens, pa.binary()), "sketch": (sketch, _WORDS)})

        for batch in batches:
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text)
                if not len(s):
                    continue
                tokens = s.tobytes()
                rows.append((rep, len(s), xxhash.xxh3_64_intdigest(tokens) - (1 << 63), tokens, sketches(s, ranks.value).view(np.int64)))
                held += len(tokens)
                if held >= SET_BYTES // 4:
                    yield packed()
                    rows, held = [], 0
        if rows:
            yield packed()

    return sets


def _compared(ranks):
    """Pairs that link, of rows (part, a, b, tokens): sets of a part (b null) come before its pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the same id but different texts are one node that has all their sets.
        sets: dict[int, list[np.ndarray]] = {}
        firsts: dict[tuple[int, int, int], np.ndarray] = {}
        part = None

        def first(x: int, i: int, order: int) -> np.ndarray:
            if (x, i, order) not in firsts:
                firsts[x, i, order] = np.sort(prefix(sets[x][i], ranks.value, order, in_order=False))
            return firsts[x, i, order]

        def common(x: np.ndarray, y: np.ndarray) -> int:
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            return int((x[at] == y).sum())

        def linked(a: int, i: int, b: int, j: int) -> bool:
            x, y = sets[a][i], sets[b][j]
            least = need(len(x), len(y))
            if any(common(first(a, i, k), first(b, j, k)) < least for k in range(ORDERS)):
                return False
            return links(len(x), len(y), common(x, y))

        for batch in batches:
            out = []
            for p, a, b, tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != part:
                    part = p
                    sets.clear()
                    firsts.clear()
                if b is None:
                    new, own = np.frombuffer(tokens, np.uint64), sets.setdefault(a, [])
                    if len(new) and not any(np.array_equal(new, x) for x in own):
                        own.append(new)
                elif any(linked(a, i, b, j) for i in range(len(sets[a])) for j in range(len(sets[b]))):
                    out.append((a, b))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield _batch({"a": (a, pa.int64()), "b": (b, pa.int64())})

    return compare


def dealt(pairs: DataFrame, parts: int) -> DataFrame:
    """(part, a, b): pairs dealt to parts by `a`, those of an `a` with very many partners to several by `b`."""
    many = scratch.written(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > PARTNERS), "hubs")
    many = many.select(F.col("a").alias("hub"), F.ceil(F.col("n") / PARTNERS).alias("salts"))
    many = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    out = pairs.join(many, F.col("a") == F.col("hub"), "left")
    salt = F.when(F.col("salts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("b"), F.col("salts")))
    return out.select(F.pmod(F.xxhash64("a", salt), F.lit(parts)).cast("int").alias("part"), "a", "b")


def verified(pairs: DataFrame, sizes: DataFrame, kept: DataFrame, ranks) -> DataFrame:
    """Those of the pairs (a, b, big) whose sets link. A part holds the sets of its pairs, each once, in bounded bytes."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    n_sets, tokens = ids.join(sizes, "rep").agg(F.count("*"), F.sum("n")).first()
    of_pairs = pairs.agg(F.sum("big")).first()[0] or 0
    parts = max(1, -(-8 * (tokens or 0) // SET_BYTES), -(-8 * of_pairs // PAIR_BYTES))
    pairs = scratch.written(dealt(pairs.select("a", "b"), parts), "dealt")
    ends = pairs.select("part", F.explode(F.array("a", "b")).alias("rep"))
    need = scratch.written(ends.groupBy("rep").agg(F.collect_set("part").alias("parts")), "needed")
    need = F.broadcast(need) if n_sets <= BROADCAST_ROWS else need
    sets = kept.select("rep", "tokens").join(need, "rep").select(F.explode("parts").alias("part"), F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), "tokens")
    rows = sets.union(pairs.select("part", "a", "b", F.lit(None).cast("binary")))
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", F.col("b").isNotNull())
    return rows.mapInArrow(_compared(ranks), "a long, b long")


def link_classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed documents, labels): doc_id, n, digest; and (id, comp) of classes that link to others."""
    spark = documents.sparkSession
    scratch.small_batches(spark)
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    both = scratch.written(texts.mapInArrow(_signatures, SIGNED), "signatures")
    signed = both.where(F.col("n").isNotNull()).select("doc_id", "n", "digest")
    ranks = spark.sparkContext.broadcast(commonness(both))
    scratch.give_back()  # counts of all slots go
    reps = signed.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"))

    n_posted = signed.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_posted) // 3 // POSTINGS + 1)
    posted = texts.select("text").mapInArrow(_postings(ranks, tasks), "part int, postings binary").repartitionById(tasks, F.col("part"))
    written = scratch.written(posted.select("postings").mapInArrow(_shared, "token long, digest long, size int"), "shared")
    shared = written.select("token", "digest", F.shiftright("size", 2).alias("n"), (F.col("size") % 4).alias("level"))
    # k: how many of its prefix tokens others have. A set with fewer than any partner would need has no partner.
    enough = shared.groupBy("digest", "n").agg(F.count("*").cast("int").alias("k")).where(F.col("k") >= margins(least_shared(F.col("n"))))
    enough = scratch.written(enough.join(reps, ["digest", "n"]).select("digest", "n", "rep", "k"), "enough")
    few = enough.count() <= BROADCAST_ROWS
    here = F.broadcast(enough) if few else enough
    active = scratch.written(shared.join(here, ["digest", "n"]).select("token", "rep", "n", "level", "k"), "active")
    scratch.release(written)
    # Sets that may have partners are made once more and kept, as each round compares some.
    ids = enough.select("rep").distinct()
    kept = texts.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("rep")).select("rep", "text")
    kept = scratch.written(kept.mapInArrow(_sets(ranks), "rep long, n int, digest long, tokens binary, sketch array<long>"), "sets")
    sizes = kept.groupBy("rep").agg(F.max("n").alias("n"), (F.min("digest") != F.max("digest")).alias("several"))
    sizes = scratch.written(sizes, "sizes")
    # A rep that stands for several sets, as ids repeat, is not tested by sketches.
    tested = kept.select("rep", "n", "sketch").join(sizes.where("not several").select("rep"), "rep").dropDuplicates(["rep"])
    tested = scratch.written(tested, "sketches")
    n_reps = sizes.count()

    linked, labels, enough_pivots = None, spark.createDataFrame([], "id long, comp long"), False
    for turn in range(ROUNDS + 1):
        if enough_pivots and turn < ROUNDS:
            continue
        posts = active.join(labels, F.col("rep") == F.col("id"), "left").select("token", "rep", "n", "level", "k", F.coalesce("comp", "rep").alias("comp"))
        # Pivots are the most central sets first, then any; many tokens of a group agree on them. The larger the
        # share of its tokens that others have, the likelier a set is amid its near copies.
        turn_order = F.struct((-F.col("k") / F.col("n") if turn % 2 == 0 else F.lit(0.0)).alias("c"), F.xxhash64(F.lit(turn), F.pmod("token", F.lit(PIVOTS)), "rep").alias("h"))
        mixed = posts.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("rep", "n", "k", "comp"), turn_order).alias("pivot")).where("lo < hi")
        # Sizes fit, and neither set has fewer tokens in common with others than this pair must share.
        fits = (5 * F.col("n") >= 4 * F.col("m")) & (5 * F.col("m") >= 4 * F.col("n")) & (F.least("k", "l") >= needed(F.col("n"), F.col("m")))
        if turn < ROUNDS:
            met = posts.join(mixed.select("token", F.col("pivot.rep").alias("r"), F.col("pivot.n").alias("m"), F.col("pivot.k").alias("l"), F.col("pivot.comp").alias("c")), "token")
            met = met.where((F.col("comp") != F.col("c")) & fits)
        else:
            # From here on k counts tokens that sets of other components have.
            open_posts = posts.drop("k").join(mixed.select("token"), "token")
            still = open_posts.groupBy("rep", "n").agg(F.count("*").cast("int").alias("k"))
            still = still.where(F.col("k") >= margins(least_shared(F.col("n"))))
            open_posts = scratch.written(open_posts.join(still, ["rep", "n"]), "open")
            # The smaller set comes with its shortest prefix, the larger one with a longer one.
            other = open_posts.where("level >= 1").select("token", F.col("rep").alias("r"), F.col("n").alias("m"), F.col("k").alias("l"), F.col("comp").alias("c"))
            smaller = (F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("rep") < F.col("r"))
            met = open_posts.where("level = 2").join(other, "token").where((F.col("comp") != F.col("c")) & smaller & fits)
        # Rounds of pivots only merge what is quick to find, so they ask for more than one common token;
        # the last round leaves nothing out.
        met = met.select(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b"), F.least("n", "m").alias("n"), F.greatest("n", "m").alias("big"))
        pairs = met.groupBy("a", "b").agg(F.count("*").alias("common"), F.min("n").alias("n"), F.max("big").alias("big"))
        pairs = pairs.where(F.col("common") >= F.greatest(F.lit(1), F.floor(F.col("n") / (4 * MARGIN)) if turn < ROUNDS else F.lit(1)))
        pairs = scratch.written(filtered(pairs.select("a", "b", "big"), tested), "pairs")
        if pairs.isEmpty():
            continue  # pivots that fit no other set leave pairs to later rounds
        new = scratch.written(verified(pairs, sizes, kept, ranks), "links")
        scratch.release(pairs)
        n_new = new.count()
        enough_pivots = turn > 0 and n_new <= FEW_LINKS * n_reps
        if n_new:
            linked = new if linked is None else linked.union(new)
            labels = components(linked)
            labels = F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels
    return signed, labels


def filtered(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs that can share enough prefix tokens under every order."""
    side = lambda c, n, s: tested.select(F.col("rep").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
    both = pairs.join(side("a", "n_a", "s_a"), "a", "left").join(side("b", "n_b", "s_b"), "b", "left")
    can = F.coalesce(may_share(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b"), needed(F.col("n_a"), F.col("n_b"))), F.lit(True))
    return both.where(can).select("a", "b", "big")


def ngram_join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id; a row for each document."""
    signed, labels = link_classes(documents)
    reps = signed.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"))
    classes = reps.join(labels, F.col("rep") == F.col("id"), "left").select("digest", "n", F.coalesce("comp", "rep").alias("component_id"))
    out = signed.where("n > 0").join(classes, ["digest", "n"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = signed.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(alone)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ids AS (SELECT g, list(doc_id) AS d FROM sh GROUP BY g HAVING count(*) > 1),
pair AS (SELECT a, b, count(*) AS c FROM (SELECT d, unnest(d) AS a FROM ids), unnest(d) AS t(b) WHERE a < b GROUP BY a, b),
link AS (SELECT a, b FROM pair JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT w.doc_id, cast(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) AS m USING (doc_id)
"""


def _without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't among ids; these are broadcast up to a bound, else the join shuffles."""
    key = scratch.fresh("gone")  # documents may have columns of any name
    ids = scratch.written(ids.select(F.col("doc_id").alias(key)).distinct(), "gone")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return documents.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_anti")


def one_of_each(documents: DataFrame) -> DataFrame:
    """`documents` with one row of each component: that of its smallest doc_id, and once where ids repeat.

    Rows without a doc_id stay.
    """
    joined = scratch.written(ngram_join(documents), "components")
    out = _without(documents, joined.where("component_id <> doc_id"))
    key, turn = scratch.fresh("repeated"), scratch.fresh("turn")
    repeated = joined.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key))
    repeated = scratch.written(repeated, "repeated")
    if repeated.isEmpty():
        return out
    same = F.col("doc_id").cast("long") == F.col(key)
    twice = out.join(repeated, same, "left_semi").withColumn(turn, F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return out.join(repeated, same, "left_anti").unionByName(twice.where(F.col(turn) == 1).drop(turn))
