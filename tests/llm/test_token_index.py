import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from starloom.llm import token_index as K
from starloom.llm.textops import buffers


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(K.tokenizer_path())
    return lambda s: [*t.encode(s or "", add_special_tokens=False).ids, 1]


TEXTS = ["Hello, world!", None, "", "  \n", "It's DON'T rock'n'roll's", "É é ß µm ªº ﬁ,", "<|endoftext|> a<|startoftext|>B", "a\x1cb \x85 c", "x́ é ,́y ≮ =", "12,345.67%%%", "漢字 кириллица ΑΣ Σ.", "word " * 3000]


def test_words_apart_give_the_ids_of_whole_texts(plain):
    e = K._Encoder(K.tokenizer_path())
    for some in (TEXTS, [t for t in TEXTS if "<|" not in (t or "")]):
        data, offsets = buffers(pa.array(some, pa.string()))
        parts, n = e(data, offsets, 1)
        ids = np.concatenate(parts).tolist()
        want = [plain(t) for t in some]
        assert n.tolist() == [len(w) for w in want] and ids == sum(want, [])


def test_an_encoder_that_forgets_is_as_right(plain, monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 4)
    e = K._Encoder(K.tokenizer_path())
    for t in ["the cat sat", "on the mat.", "the cat, the mat"] * 3:
        data, offsets = buffers(pa.array([t]))
        assert np.concatenate(e(data, offsets, 1)[0]).tolist() == plain(t)


def test_the_store_reads_back_whole_and_by_key(spark, make, plain, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 5)
    monkeypatch.setattr(K, "PART_KEYS", 4)
    monkeypatch.setattr(K, "SHARD_BYTES", 64)
    rows = [(i * 37 % 101 - 20, t) for i, t in enumerate(TEXTS * 3)]
    rows = list({r[0]: r for r in rows}.values())
    out, uri = K.token_index(make(rows))
    got = {r.doc_id: r for r in out.collect()}
    at = 0
    for i, t in sorted(rows):
        ids = np.array(plain(t), "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    store = K.Store(uri)
    assert len(store.manifest["shards"]) > 6 and store.manifest["parts"] > 1
    for i, t in rows:
        assert store[i].tolist() == plain(t)
    for absent in (-1000, 5000, 2**40):
        with pytest.raises(KeyError):
            store[absent]


def test_nulls_repeats_and_empty_tables(make, plain):
    out, uri = K.token_index(make([(2, "b"), (2, "b"), (None, "a"), (1, "c"), (2, "other")]))
    got = sorted((r.start, r.doc_id) for r in out.collect())
    assert [i for _, i in got] == [None, 1, 2, 2, 2]
    assert K.Store(uri)[1].tolist() == plain("c")
    out, uri = K.token_index(make([]))
    assert out.collect() == []
    with pytest.raises(KeyError):
        K.Store(uri)[1]


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 16384])
def test_the_hash_is_perfect_and_minimal(n):
    place = K._hashes(np.random.default_rng(n).choice(2**62, n, replace=False))[0]
    move = K.build_hash(place)
    bucket = ((place >> np.uint64(32)) % np.uint64(len(move))).astype(int)
    assert sorted(K._slots(place, move[bucket], n).tolist()) == list(range(n))
