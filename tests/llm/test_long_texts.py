"""Very long texts beside short ones: nothing of them is cut, and nothing else changes."""

import random
import zlib

import numpy as np
import pytest

from lexspan.llm import decontam, ngram_join, packing, token_records

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
WORDS, BYTES = (public.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    long = " ".join(f"w{r.randint(0, 9999)}" for _ in range(6_000))
    edited = long.replace("w7 ", "other ")
    return [(1, long), (2, edited), (3, "a short one of seven words here"), (4, long + " " + " ".join(f"v{k}" for k in range(3_000)))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_join_of_long_texts(docs, texts):
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}
    assert 100 * len(sets[1] & sets[2]) >= 80 * len(sets[1] | sets[2]) and 100 * len(sets[1] & sets[4]) < 80 * len(sets[1] | sets[4])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {i: (len(s), {1: 1, 2: 1}.get(i, i)) for i, s in sets.items()}


def test_records_and_packing_of_long_texts(docs, texts):
    ids = {i: np.array([*tokenizers.Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts}
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_records.token_records(docs, WORDS, 2).collect()}
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}
    ids = {i: np.array([*tokenizers.Tokenizer.from_file(BYTES).encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts}
    pieces = packing.best_fit_pack(docs, BYTES, 2).collect()
    for i, x in ids.items():
        own = sorted((p.piece, p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i)
        assert sum(p[2] for p in own) == len(x) and all(zlib.crc32(x[s : s + n].tobytes()) == c for _, s, n, c in own)
        assert [p[2] for p in own[1:]] == [1024] * (len(own) - 1)


def test_decontamination_of_long_texts(spark, docs, texts):
    words = texts[0][1].split()
    bench = spark.createDataFrame([(1, " ".join(words[-12:])), (2, " ".join(words[3_000:3_010])), (3, "never seen in any of these long documents at all here")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_items) for r in decontam.decontaminate(docs, bench).collect()}
    assert got[1] == (6_000, 2) and got[3] == (7, 0) and got[4] == (9_000, 2)
