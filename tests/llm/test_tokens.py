"""Encoding and decoding, token counts, token files."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest

from docloom.llm import bpe_codec, token_count, token_store


def key(x):
    return tuple((v is not None, v) for v in x)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = bpe_codec.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(docs, **kw):
    return sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.digests(bpe_codec.decode(bpe_codec.encode(docs, **kw))).collect()], key=key)


def by_library(docs, encoding):
    out = []
    for r in docs.select("doc_id", "text").collect():
        ids = encoding.encode_ordinary(r.text or "")
        out.append((r.doc_id, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha((r.text or "").encode())))
    return sorted(out, key=key)


def test_encoding_equals_the_library(odd, empty, tiktoken_encoding):
    assert encoded(odd) == by_library(odd, tiktoken_encoding)
    assert encoded(empty) == []


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (40, 4), (128, 60)])
def test_stitching_equals_one_pass(spark, tiktoken_encoding, chunk, overlap):
    r = random.Random(chunk)
    texts = ["".join(r.choice(["the", " an", "  ", "\n", "'s", "1", "é", "漢", ".", "!!", " ", "\t", "\u2003", "\x1c", "😀"]) for _ in range(r.randint(0, 300))) for _ in range(60)]
    texts += ["a" * 1000, " " * 1000, "ab " * 400, "\n" * 500 + "x" * 500, "!" * 300 + " b" * 300]
    docs = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)] + [(3, texts[5]), (3, texts[5])], "doc_id long, text string").repartition(4)
    assert encoded(docs, chunk_chars=chunk, overlap_chars=overlap) == by_library(docs, tiktoken_encoding)


def test_chunks_must_be_longer_than_their_overlaps(odd):
    with pytest.raises(ValueError, match="overlap"):
        bpe_codec.encode(odd, chunk_chars=10, overlap_chars=5)


def test_counts_equal_the_library(odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted([tuple(r) for r in token_count.count_tokens(odd).collect()], key=key)
    want = sorted([(r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in odd.collect()], key=key)
    assert got == want and token_count.count_tokens(empty).count() == 0
    counter = token_count.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(5)
    for _ in range(1500):
        s = "".join(r.choice("aeth  \n\t▁é漢😀<s>0x\r.\u0301\x00") for _ in range(r.randint(0, 40)))
        assert counter.count(s) == len(sp.encode(s)), repr(s)


def test_elias_fano():
    r = np.random.default_rng(4)
    for n, top in ((1, 0), (1, 10**9), (5, 3), (1000, 50_000), (700, 10**12)):
        v = np.sort(r.integers(0, top + 1, n))
        x = token_store.EliasFano.of(v)
        assert (x.all() == v).all() and [x.select(i) for i in range(n)] == v.tolist()
        assert 8 * (len(x.low) + len(x.high)) <= n * (3 + max(0, int(v[-1] // n).bit_length())) + 64
        with pytest.raises(IndexError):
            x.select(n)
    assert len(token_store.EliasFano.of(np.zeros(0)).all()) == 0


def test_store_reads_back(spark, odd, empty, tmp_path):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(20, "a<|endoftext|> b"), (21, "x \u2003 y  z "), (-3, "minus")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    for n, block in enumerate((1, 200, 1 << 18)):
        token_store.write(docs, f"{tmp_path}/{n}", block_tokens=block, partitions=3)
        rows = sorted(token_store.digests(token_store.read(spark, f"{tmp_path}/{n}")).collect(), key=lambda r: r.start)
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
        ids = [r.doc_id for r in rows]
        assert ids[0] is None and ids[1:] == sorted(ids[1:])
        want = []
        for r in docs.collect():
            x = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
            want.append((r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
    token_store.write(empty, f"{tmp_path}/none")
    assert token_store.read(spark, f"{tmp_path}/none").count() == 0


def test_units_equal_the_library_on_every_character():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"a{chr(c)}b1 {chr(c)}{chr(c)} .{chr(c)}\n {chr(c)} \n\n{chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    own = token_store.LibraryIds(path)
    assert own.by_units and own.encode(texts) == token_store.LibraryIds(path, by_units=False).encode(texts)


def test_units_equal_the_library_on_random_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(8)
    texts = ["".join(r.choice([" ", "  ", "\n", "\t", "\r\n", "a", "word", "'s", "'", "1", "!", "é", "漢字", "<|endoftext|>", "<|endof", "😀", "\u2003", "\x1c", "\xa0"][: 16 if n % 3 else 19]) for _ in range(r.randint(0, 60))) for n in range(4000)]
    assert token_store.LibraryIds(path).encode(texts) == token_store.LibraryIds(path, by_units=False).encode(texts)
    assert not token_store.LibraryIds(public_tokenizers.path("word_bpe_49k.json")).by_units


def test_fetch_reads_single_documents(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(10**12, "far away"), (-9, "minus nine")], "doc_id long, text string"))
    token_store.write(docs, f"{tmp_path}/s", block_tokens=300, partitions=3)
    every = sorted((r.doc_id, bytes(r.ids)) for r in token_store.read(spark, f"{tmp_path}/s").collect() if r.doc_id is not None)
    wanted = spark.createDataFrame([(i,) for i in (5, 6, -9, 10**12, 77, None, 1)], "doc_id long")
    got = sorted((r.doc_id, bytes(r.ids)) for r in token_store.fetch(spark, f"{tmp_path}/s", wanted).collect())
    assert got == [x for x in every if x[0] in (5, 6, -9, 10**12, 1)] and len([x for x in got if x[0] == 5]) == 2
    assert token_store.fetch(spark, f"{tmp_path}/s", wanted.limit(0)).count() == 0


def test_rows_of_one_id_are_spread(spark, tmp_path):
    docs = spark.range(400).selectExpr("7L as doc_id", "concat('text ', id) as text")
    token_store.write(docs, f"{tmp_path}/s", partitions=4)
    assert spark.read.parquet(f"{tmp_path}/s").select("shard").distinct().count() > 1
    rows = sorted(token_store.digests(token_store.read(spark, f"{tmp_path}/s")).collect(), key=lambda r: r.start)
    assert len(rows) == 400 and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(400)]
