"""Ranked search against brute force, and what its blocks save."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratalode.llm import lexical_search as S


def words(text):
    return re.findall(S.PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(documents, items, k=50):
    counted = [(i, Counter(words(t))) for i, t in documents]
    held = [c for _, c in counted if c]
    n, total, df = len(held), sum(c.total() for c in held), Counter(t for c in held for t in c)
    out = []
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(words(text)) if t in df}
        scored = [(-sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * c.total() * n // total))) for t, w in asked.items()), i is None, i) for i, c in counted if c]
        best = sorted((s, none, i or 0, i) for s, none, i in scored if s < 0)[:k]
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(best, 1)]
    return out


def found(spark, documents, items, k=50, **how):
    index = S.build_index(spark.createDataFrame(documents, "doc_id long, text string").repartition(3), **how)
    return sorted((tuple(r) for r in S.search(index, spark.createDataFrame(items, "item_id string, text string"), k).collect()), key=repr)


ODD = [(1, None), (2, ""), (3, " .,-"), (None, "alpha beta"), (None, "alpha beta"), (4, "Alpha BETA"), (4, "Alpha BETA"), (5, "É é ß ẞ 漢字 alpha9"), (6, "alpha " * 40_000), (-7, "beta gamma"), (9, "\x00alpha\x7fbeta")]


def test_odd_rows(spark):
    items = [("a", "alpha beta"), ("b", None), ("c", "!!"), ("d", "unknown"), ("e", "É 漢字 É alpha"), ("a", "alpha beta"), (None, "gamma Gamma")]
    assert found(spark, ODD, items) == sorted(brute(ODD, items), key=repr)
    assert found(spark, ODD, items, k=2, segment_docs=2) == sorted(brute(ODD, items, 2), key=repr)


def test_empty_tables(spark):
    assert found(spark, [], [("a", "b")]) == found(spark, [(1, "b")], []) == found(spark, [(1, None)], [("a", "b")]) == []


@pytest.mark.parametrize("how", [{}, {"segment_docs": 700}, {"segment_bytes": 20_000}])
def test_random_texts(spark, how, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: " ".join(vocabulary[min(399, int(rng.paretovariate(0.7)) - 1)] for _ in range(n))
    documents = [(i, draw(rng.choice([3, 20, 60, 300]))) for i in range(3000)]
    documents += [(5000 + i, documents[i % 7][1]) for i in range(900)]  # many ties
    items = [(f"i{i}", draw(rng.choice([1, 4, 30]))) for i in range(25)] + [("t", documents[3][1])]
    assert found(spark, documents, items, **how) == sorted(brute(documents, items), key=repr)
    monkeypatch.setattr(S, "ITEMS", 4)
    assert found(spark, documents, items, k=7, **how) == sorted(brute(documents, items, 7), key=repr)


def test_an_index_is_opened_again(spark, tmp_path):
    S.build_index(spark.createDataFrame(ODD, "doc_id long, text string"), path=f"{tmp_path}/index")
    items = [("a", "alpha beta")]
    again = S.search(S.open_index(spark, f"{tmp_path}/index"), spark.createDataFrame(items, "item_id string, text string"))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(brute(ODD, items), key=repr)


def test_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**34, 5])
    data, ends = S.packed(values)
    assert S.unpacked(data).tolist() == values.tolist() and ends[-1] == len(data) and S.unpacked(data[: ends[2]]).tolist() == [0, 1, 127]


def searched(texts):
    part = S._Segment()
    part.add(pa.array(range(len(texts)), pa.int64()), pa.array(texts))
    rows = pa.Table.from_batches([part.rows(1)])
    held = [len(words(t)) for t in texts]
    return S._Searched(rows, sum(n > 0 for n in held), sum(held))


def test_maxima_are_those_of_their_blocks():
    rng = random.Random(1)
    texts = ["x " * rng.choice([1, 1, 2, 9]) + "y " * rng.randrange(200) for _ in range(1000)]
    s = searched(texts)
    for term in ("x", "y"):
        one = s.list_of(term)
        assert len(one.last) == -(-sum(term in t for t in texts) // S.BLOCK)
        for i in range(len(one.last)):
            docs, impacts = one.block(i)
            assert one.peaks[i] == impacts.max() and one.last[i] == docs[-1] and len(docs) <= S.BLOCK
            assert [texts[d].split().count(term) for d in docs.tolist()] and docs.tolist() == sorted(set(docs.tolist()))


def test_blocks_below_the_threshold_stay_compressed():
    """A common word's best documents stand together; most other blocks can't reach them."""
    texts = ["common " * (9 if 5000 <= i < 5060 else 1) + "filler " * (1 if 5000 <= i < 5060 else 30) for i in range(20_000)]
    s = searched([*texts, *["other"] * 30_000])
    docs, _ = s.best([("common", 100), ("filler", 3)], 50)
    assert docs.tolist() == [*range(5000, 5050)]
    for term in ("common", "filler"):
        one = s.list_of(term)
        assert len(one.last) > 150 and len(one.open) < 0.2 * len(one.last)
