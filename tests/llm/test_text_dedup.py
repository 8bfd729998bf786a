"""Substring dedup and the n-gram Jaccard join against brute force."""

from __future__ import annotations

import random
import re

import pytest

from stratalode.llm import jaccard_join, substring_dedup
from stratalode.llm._components import components

SHAPE = "doc_id long, text string, n_words string, component_id string, lang string"


def corpus(seed: int, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5)))
    shared = [[word() for _ in range(rnd.randint(40, 90))] for _ in range(4)]
    rows = []
    for i in range(n):
        kind = rnd.random()
        ws = [word() for _ in range(rnd.randint(0, 120))]
        if kind < 0.4:
            at = rnd.randint(0, len(ws))
            ws[at:at] = rnd.choice(shared)
        elif kind < 0.7 and rows:
            ws = (rnd.choice(rows)[1] or "").split()
            for _ in range(rnd.randint(0, 3)):
                if ws:
                    ws[rnd.randrange(len(ws))] = word()
        elif kind < 0.75:
            ws = ["ab"] * rnd.randint(0, 160)
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(ws)))
    rows += [(None, rows[3][1]), (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "Ab cD"), (n + 4, "ab cd"), (5, rows[5][1])]
    rnd.shuffle(rows)
    return [(i, t, "x", "y", None) for i, t in rows]


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = corpus(seed)
    first: dict[tuple, int] = {}
    for i, t, *_ in rows:
        ws = words(t)
        for p in range(len(ws) - 49):
            if i is not None:
                first[tuple(ws[p : p + 50])] = min(i, first.get(tuple(ws[p : p + 50]), i))
    expected = []
    for i, t, *_ in rows:
        ws, gone = words(t), set()
        for p in range(len(ws) - 49):
            if i is not None and first[tuple(ws[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        expected.append((i, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, SHAPE), keep=True)
    assert {"text", "component_id", "lang"} <= set(out.columns)
    got = [tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(x[2] for x in expected)


def test_substring_dedup_spans_and_empty_table(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SHAPE)).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame([(1, text), (2, f"a b {text} c")], "doc_id long, text string")).collect()}
    assert out[1]["spans"] == [] and [(s["start"], s["end"]) for s in out[2]["spans"]] == [(2, 62)] and out[2]["kept"] == "a b c"


def test_a_copied_passage_is_one_factor_of_its_block(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage, other = [word() for _ in range(500)], [word() for _ in range(80)]
    rows = [(7, " ".join([word() for _ in range(30)] + passage)), (8, " ".join(other + [word()])), (9, " ".join([word() for _ in range(11)] + passage + [word() for _ in range(5)] + other))]
    out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [tuple(f) for f in out[9]["factors"]] == [(11, 500, 7, 30), (516, 80, 8, 0)] and out[7]["factors"] == out[8]["factors"] == []
    assert out[9]["n_removed"] == 580


def test_a_group_of_copies_has_phrases_once_a_task(spark):
    """Half the rows are copies of one text: no key has a row for each of them, and they go as a whole."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    text = " ".join(word() for _ in range(400))
    rows = [(i, text if i % 2 else " ".join(word() for _ in range(120))) for i in range(600)] + [(0, text)]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "1L AS crc").repartition(6)
    parsed = df.mapInArrow(lambda b: substring_dedup._parse(b, 50, 12), "anchor long, phrase long, id long, place long").filter("anchor IS NOT NULL").groupBy("anchor").count()
    assert parsed.agg({"count": "max"}).first()[0] <= 6 * 12  # a few smaller ids may come later in a task
    out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(df.select(df["id"].alias("doc_id"), "text")).filter("doc_id % 2 = 1").collect()}
    assert len(out) == 300 and all(r["n_removed"] == r["n_words"] == 400 and r["kept"] == "" for r in out.values())


def shingles(text: str | None) -> frozenset:
    ws = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def groups(rows: list[tuple]) -> list[tuple]:
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i != j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i) if s else i) for i, s in sets]


@pytest.mark.parametrize(("seed", "few", "block"), [(3, 16, 2048), (4, 1, 3)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, seed, few, block):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    rows = corpus(seed)
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, SHAPE))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(groups(rows), key=repr)


def test_jaccard_many_near_copies_and_empty_table(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(80):
        ws = list(base)
        for _ in range(rnd.randint(0, 4)):
            ws[rnd.randrange(80)] = f"x{rnd.randrange(1000)}"
        rows.append((i, " ".join(ws)))
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == sorted(groups(rows))
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(2, 1), (3, 2), (9, 8), (8, 7), (4, 4), (None, 3), *((i, i + 1) for i in range(100, 160))]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_copied_passage_of_repeated_rows_is_one_factor(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (2, " ".join(words)), (3, "own " + " ".join(words[20:280]) + " more")]
    for parts in (1, 4):
        found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        got = sorted((r["doc_id"], [(f["start"], f["length"], f["block"], f["block_start"]) for f in r["factors"]]) for r in found)
        assert got == [(1, []), (2, [(0, 300, 1, 0)]), (2, [(0, 300, 1, 0)]), (3, [(1, 260, 1, 20)])]


def test_blocks_of_a_hot_key_meet_by_size(spark, monkeypatch):
    """A key that all nodes have: every pair whose sizes may fit meets once, and rows are far fewer than nodes times blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    sizes = [int(5 * 1.01**i) + 1 for i in range(600)]
    rows = spark.createDataFrame([(7, i, n << 32, True) for i, n in enumerate(sizes)], "token long, id long, place long, large boolean")
    dealt = jaccard_join._dealt(rows, 80).select("low", "high", "block", "id").collect()
    tasks: dict[tuple, list[tuple]] = {}
    for r in dealt:
        tasks.setdefault((r["low"], r["high"]), []).append((r["block"], r["id"]))
    met = [frozenset((a, b)) for (low, high), xs in tasks.items() for block, a in xs for other, b in xs if a < b and (low == high or block != other)]
    assert len(met) == len(set(met))
    assert {frozenset((a, b)) for a in range(600) for b in range(a) if 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b])} <= set(met)
    assert len(dealt) < 0.4 * 600 * (600 // 16)
    assert max(len(x) for x in tasks.values()) < 80


def test_a_hot_shingle_in_blocks_equals_brute_force(spark, monkeypatch):
    for name, value in (("FEW", 2), ("HOT", 3), ("BLOCK", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(4)
    hot = [f"h{i}" for i in range(5)]
    base = [[f"b{k}w{i}" for i in range(rng.choice([6, 12, 40, 41]))] for k in range(8)]
    texts = []
    for i in range(60):
        words = list(base[i % 8])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"
        texts.append((i, " ".join(hot + words)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts for w in [t.split()]}
    least = {i: i for i in sets}
    while True:
        new = {a: min(least[b] for b in sets if a == b or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])) for a in sets}
        if new == least:
            break
        least = new
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == least and len(set(least.values())) < 50
