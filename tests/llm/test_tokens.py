"""Encoding, counting and storing against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.errors import PythonException

from stratalode.llm import byte_bpe, token_counts, token_store

MARKS = [chr(i) for i in [*range(32, 127), 9, 10, 13, 0x85, 0xA0, 0x2003, 0x3000, 0x1F600, 0x4E2D, 0x301, 0x308, 0xE9, 0xD7, 0xC9, 0x200D, 0x1C, 0xFEFF, 0x430, 0x5D0, 0x627, 0x130, 0x2581, 0xFB01]]


def texts(seed: int, n: int = 300) -> list[str | None]:
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(MARKS) if rnd.random() < 0.6 else rnd.choice("  a\n 's 't.,!Aer") for _ in range(rnd.randint(0, 80))) for _ in range(n)]
    return [*out, None, "", " ", "   ", "a" * 3000, " " * 700 + "x", "ab" * 2000, "<|endoftext|>x <|startoftext|>", "<s></s><unk>", "the. The, THE!", "T̈ ẗ"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "n", "s") for i, t in enumerate(rows)], "doc_id long, text string, n_tokens string, start string").repartition(3)


def test_byte_bpe_as_tiktoken(spark):
    rows = texts(1)
    ranks = byte_bpe.read_ranks(P.path(byte_bpe.RANKS))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode(table(spark, rows), with_offsets=True)
    got = {r["doc_id"]: r for r in byte_bpe.decode(coded.withColumn("also", coded["ids"])).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        ids = e.encode_ordinary(t or "")
        assert got[i]["also"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded"] == (t or "").encode() and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        for k, a, b in zip(ids, got[i]["starts"], got[i]["ends"], strict=True):
            assert e.decode_single_token_bytes(k) in t[a:b].encode()
        assert not ids or (got[i]["starts"][0] == 0 and got[i]["ends"][-1] == len(t))
    assert byte_bpe.encode(table(spark, rows).limit(0)).count() == 0


def test_token_counts_as_sentencepiece(spark):
    import sentencepiece

    rows = texts(2)
    model = sentencepiece.SentencePieceProcessor(model_file=P.path(token_counts.MODEL))
    got = {r["doc_id"]: r for r in token_counts.count_tokens(table(spark, rows)).collect()}
    assert {i: (r["n_bytes"], r["n_tokens"]) for i, r in got.items()} == {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(rows)}


def test_token_counts_of_long_words_and_empty_tables(spark):
    import sentencepiece

    m, rnd = token_counts.merges(P.path(token_counts.MODEL)), random.Random(4)
    model = sentencepiece.SentencePieceProcessor(model_file=P.path(token_counts.MODEL))
    rows = ["".join(rnd.choice("ertionst▁é中") for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    rows += ["a" * 20_000, "ab" * 9_000, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzAB01+/") for _ in range(50_000)), "中国人民" * 5000]
    import pyarrow as pa

    assert m.count(pa.array(rows)).tolist() == [len(model.encode(t)) for t in rows]
    assert token_counts.count_tokens(table(spark, rows).limit(0)).count() == 0


def test_round_trip_equals_encode_and_decode(spark):
    df = table(spark, texts(5))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, byte_bpe.round_trip(df).select(names).collect())) == sorted(map(tuple, byte_bpe.decode(byte_bpe.encode(df)).select(names).collect()))
    assert byte_bpe.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("make", [
    lambda: (c := byte_bpe.codec(P.path(byte_bpe.RANKS), P.PATTERN), lambda texts: c.encode(texts)),
    lambda: (c := token_counts.merges(P.path(token_counts.MODEL)), lambda texts: c.count(pa.array(texts))),
    lambda: (c := token_store.words_of(P.path(token_store.VOCABULARY)), lambda texts: c.encode(pa.array(texts), 2)),
], ids=["byte_bpe", "token_counts", "token_store"])
def test_kept_words_are_bounded_in_bytes(make):
    """Paragraphs without blanks pass through, short words stay."""
    coder, encode = make()
    coder.kept.clear()
    for i in range(40):
        encode([f"{i}_{j}".replace("_", "x") + "長" * 340 + " word" + chr(97 + j % 26) for j in range(50)])
    assert coder.kept and max(map(len, coder.kept)) <= 64
    coder.kept.clear()


def test_store_round_trip(spark):
    from tokenizers import Tokenizer

    rows = texts(3)
    rows += [rows[0]] * 5
    df = spark.createDataFrame([(i - 1 if i else None, t) for i, t in enumerate(rows)] + [(7, "again"), (7, "again")], "doc_id long, text string").repartition(4)
    library = Tokenizer.from_file(P.path(token_store.VOCABULARY))
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    store = token_store.write_store(df)
    got = token_store.read_store(spark, token_store.open_store(store.path), with_ids=True).collect()
    key = lambda x: (x[0] is not None, x[0] or 0)
    expected = sorted([(i - 1 if i else None, ids(t)) for i, t in enumerate(rows)] + [(7, ids("again"))] * 2, key=key)
    got = sorted(got, key=lambda r: r["start"])
    assert [key(r) for r in got] == [key(x) for x in expected]  # in order of id
    assert sorted((key(r), r["ids"]) for r in got) == sorted((key(x), x[1]) for x in expected)
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        start += r["n_tokens"]
    empty = token_store.write_store(df.limit(0))
    assert token_store.read_store(spark, empty).count() == 0


def test_store_notices_changed_chunks_and_stores_equal_ones_once(spark):
    text = " ".join(f"word{i}" for i in range(3000))
    store = token_store.write_store(spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string").repartition(3))
    from pathlib import Path

    packs = sorted(Path(store.path.removeprefix("file://")).glob("pack-*"))
    one = token_store.write_store(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    size = lambda s: sum(p.stat().st_size for p in Path(s.path.removeprefix("file://")).glob("pack-*"))
    assert size(store) == size(one)
    data = bytearray(packs[0].read_bytes())
    data[len(data) // 2] ^= 1
    packs[0].write_bytes(data)
    with pytest.raises(PythonException):
        token_store.read_store(spark, store).collect()
