"""Token archives and exact BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import ans, bpe
from tessella.llm.queries import vocabulary_path
from tests.llm.corpus import SCHEMA, documents


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_prefix_encoder_equals_the_merge_loop(library):
    enc, rng = bpe.PrefixEncoder(vocabulary_path()), random.Random(2)
    strings = bpe.token_strings(vocabulary_path())
    alphabet = [*"abcehinorstuABEÉİΣσςſK \n\t.,<|>'0123½\x1c\x85\xa0\u3000\u0301한中😀\x00_", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'re", "</w>", "aaaa", "ﬁ"]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        ids = ids_of(library, t)
        assert np.frombuffer(enc.encode(t.encode()), "<u4").tolist() == ids, t
        assert bpe.decode_ids(strings, ids) == library.decode(ids, skip_special_tokens=False)
    for token in list(library.get_vocab())[::37]:
        t = token.removesuffix("</w>")
        assert np.frombuffer(enc.encode(t.encode()), "<u4").tolist() == ids_of(library, t)


def test_long_word_and_full_tables(library, monkeypatch):
    monkeypatch.setattr(bpe, "_KEPT_PIECES", 3)
    monkeypatch.setattr(bpe, "_KEPT_WORDS", 3)
    monkeypatch.setattr(bpe, "_KEPT_PAIRS", 3)
    enc = bpe.PrefixEncoder(vocabulary_path())
    t = "internationalisation" * 2000 + " the end the end of it it it"
    assert np.frombuffer(enc.encode(t.encode()), "<u4").tolist() == ids_of(library, t)


def test_encode_decode_frames(spark, library):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    out = bpe.decode(bpe.encode(df, vocabulary_path(), keep=["doc_id", "n"]), vocabulary_path()).collect()
    want = sorted((ids_of(library, r[1]), library.decode(ids_of(library, r[1]), skip_special_tokens=False)) for r in rows)
    assert sorted((list(r["ids"]), r["decoded"]) for r in out) == want
    both = bpe.encode(df, vocabulary_path(), keep=["doc_id"], decoded="again").collect()
    assert sorted((list(r["ids"]), r["again"]) for r in both) == want
    assert bpe.encode(df.limit(0), vocabulary_path(), keep=["doc_id"]).count() == 0


def test_ids_digest(spark):
    df = spark.createDataFrame([([1, 22, 333],), ([],)], "ids array<int>")
    got = {r[0] for r in df.select(bpe.ids_digest()).collect()}
    assert got == {hashlib.sha256(b"1 22 333").hexdigest(), hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, ans.BLOCK_TOKENS, 3 * ans.BLOCK_TOKENS + 777])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    tokens = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
    coder = ans.Coder(ans.quantise(np.bincount(np.append(tokens, 7), minlength=1 << 16)))
    docs = [(5, n // 3), (ans.NO_ID, 0), (9, n - n // 3)]
    data = ans.encode_segment(coder, docs, tokens)
    got = list(ans.decode_segment(coder, data))
    assert [d for d, _ in got] == [5, ans.NO_ID, 9]
    assert np.array_equal(np.concatenate([t for _, t in got]), tokens)
    if n > 1000:
        assert len(data) < 2 * n


def test_damage_is_found():
    tokens = np.arange(5000, dtype=np.uint32) % 50
    coder = ans.Coder(ans.quantise(np.bincount(tokens, minlength=64)))
    data = bytearray(ans.encode_segment(coder, [(1, 5000)], tokens))
    data[-9] ^= 4
    with pytest.raises(ValueError, match="checksum|origin"):
        list(ans.decode_segment(coder, bytes(data)))


def test_quantise_keeps_every_symbol():
    counts = np.zeros(60_000, np.int64)
    counts[::2], counts[0] = 1, 10**12
    freq = ans.quantise(counts)
    assert freq.sum() == 1 << ans.BITS and (freq[::2] > 0).all() and (freq[1::2] == 0).all()


def test_archive_frames(spark, library):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    index, freq = ans.archive(df, vocabulary_path())
    out = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in ans.read_documents(index, freq).collect())
    at, ids = 0, [r[1] for r in out]
    assert [i is None for i in ids] == sorted([i is None for i in ids], reverse=True)
    assert [i for i in ids if i is not None] == sorted(i for i in ids if i is not None)
    left = [(r[0], tuple([*ids_of(library, r[1]), 2])) for r in rows]
    for start, doc, n, crc in out:
        assert start == at
        at += n
        hit = next(k for k in left if k[0] == doc and len(k[1]) == n and zlib.crc32(np.array(k[1], "<u4")) == crc)
        left.remove(hit)
    assert not left
    index, freq = ans.archive(df.limit(0), vocabulary_path())
    assert ans.read_documents(index, freq).count() == 0
