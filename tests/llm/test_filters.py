"""Decontamination, url rules, archives, vectors and toxicity."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.llm import decontaminate, embedding_dedup, toxicity, url_filter, warc

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def norm(t: str | None) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in t or ""))


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["ab", "Cd", "é9", "xyz", "ab1", "Ñu"])
    items = [(i, rnd.choice([" ", ", ", "-"]).join(word() for _ in range(rnd.choice([0, 1, 5, 13, 14, 20])))) for i in range(12)] + [(99, None), (98, "only"), (97, "only")]
    docs = []
    for i in range(40):
        ws = [word() for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.6:
            ws[10:10] = re.split("[ ,-]+", rnd.choice(items)[1] or "")
        docs.append((i, rnd.choice([" ", "\n", "; "]).join(ws), "keep", "h"))
    docs += [(50, None, "k", "h"), (51, "", "k", "h"), (52, "?!", "k", "h"), (53, "ONLY", "k", "h"), (53, "ONLY", "k", "h")]
    out = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string, lang string, n_hit string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, keep=True)
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["text"]) for r in out.collect())
    windows = {(i, tuple(w[k : k + 13])) for i, t in items for w in [norm(t)] for k in range(max(1, len(w) - 12)) if w}
    expected = []
    for i, t, *_ in docs:
        w, hit, held = norm(t), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    held.add(str(item))
        expected.append((i, len(w), len(hit), tuple(sorted(held)), t))
    assert got == sorted(expected, key=lambda x: (x[0], x[1]))
    for r in out.collect():
        for s in r["spans"]:
            assert norm(r["text"][s["start"] : s["end"]]) == norm(r["text"])[s["first_word"] : s["end_word"]]


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.find_contamination(none, some.withColumnRenamed("doc_id", "item_id")).count() == 0
    wordless = spark.createDataFrame([(1, None), (2, " ! "), (3, "")], "item_id long, text string")
    for items in (none.withColumnRenamed("doc_id", "item_id"), wordless):
        row = decontaminate.find_contamination(some, items).first()
        assert (row["n_words"], row["n_hit"], row["items"]) == (2, 0, [])


def test_url_rules(spark):
    rows = [
        (1, "https://a.example.org/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"), (2, "http://EXAMPLE.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), (4, "http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), (5, "http://x.com/es/1", "x.com", "/es/1", None, "allow"),
        (6, None, "", "", None, "allow"), (7, "no scheme", "", "", None, "allow"), (8, "http://x.net/casino/1", "x.net", "/casino/1", None, "block"), (9, "http://x.net/Casinos", "x.net", "/Casinos", None, "allow"),
        (10, "http://org", "org", "", None, "allow"), (11, "http://org/", "org", "/", "org/", "allow"), (11, "http://org/", "org", "/", "org/", "allow"), (12, "x://y.com/fr/a://z.org/", "y.com", "/fr/a://z.org/", "com/fr/", "allow"),
        (13, "https://ünï.org/É\n?x", "ünï.org", "/É\n", "org/", "allow"), (14, "", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(r[0], r[1], "v") for r in rows], "page_id long, url string, verdict string")
    out = url_filter.filter_urls(df)
    assert sorted(map(tuple, out.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr) == sorted([(r[0], *r[2:]) for r in rows], key=repr)
    assert out.filter("page_id = 5").first()["n_candidates"] < len(url_filter.HOST_RULES) + len(url_filter.BLOCK_PATTERNS)
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert url_filter.filter_urls(df, host_rules=[], patterns=["x.*y"], otherwise="block").filter("verdict = 'block'").count() == len(rows)


def test_url_patterns_with_alternatives_and_optional_parts(spark):
    patterns = [r"\bfoo\b|\bbar\b", r"(?:/ads/)?banner", r"/ad/*x", r"\bq(?:uick|uack)\b", r"[/-]zip[./]", r"(?i)\bFLIP\b", r"\p{Digit}{9}", r"(?:one|two)-(?:red|blue)\b"]
    urls = ["http://h.net/foo", "http://h.net/bar", "http://h.net/banner", "http://h.net/ads/banners", "http://h.net/adx", "http://h.net/ad//x", "http://h.net/quack", "http://h.net/quuick", "http://h.net/a-zip.b", "http://h.net/flip", "http://h.net/123456789", "http://h.net/two-blue", "http://h.net/two-green", "http://h.net/foobar", "http://h.net/_foo", None]
    import re as python

    read = [python.compile(p.replace(r"\p{Digit}", "[0-9]")) for p in patterns]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, host_rules=[], patterns=patterns).collect()}
    assert got == {i: "block" if any(p.search((u or "").lower()) for p in read) else "allow" for i, u in enumerate(urls)}
    tokens = {p: set(url_filter.pattern_rule(p).tokens) for p in patterns}
    assert tokens[patterns[0]] == {("foo",), ("bar",)} and tokens[patterns[1]] == {()} and tokens[patterns[3]] == {("quick",), ("quack",)} and tokens[patterns[4]] == {("zip",)} and tokens[patterns[5]] == {("flip",)} and tokens[patterns[6]] == {()}
    assert tokens[patterns[7]] == {("red",), ("blue",)}


def test_many_url_rules(spark):
    rules = [(f"h{i}.net", "/", "block") for i in range(10_000)]
    df = spark.range(500).selectExpr("id AS page_id", "concat('http://h', id * 40, '.net/x') AS url")
    out = url_filter.filter_urls(df, host_rules=rules)
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString().lower().replace("jsontostructs", "from_json")
    rows = out.collect()
    assert all((r["rule"] == f"h{r['page_id'] * 40}.net/") == (r["page_id"] < 250) and r["n_candidates"] < 12 for r in rows)


def test_archives_round_trip(spark):
    big, small = "ä<p>" * 900, "tiny"
    rows = [(3, "http://a", big), (1, "http://b", big), (2, None, small), (4, "http://c", small), (5, "bad\r\nurl", None), (6, "x", ""), (7, "y", "WARC/1.1\r\n\r\n" * 40), (8, "z", "q" * 100), (9, "z", "q" * 100), (10, "z", "q" * 99), (11, "z", "q" * 99)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(3)
    paths = warc.write_archives(df, size=64)
    got = {r["page_id"]: r for r in warc.read_archives(spark, paths, size=50).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(k for k, _, h in rows if (h or "") == (html or ""))
        revisit = len(data) >= 100 and first != i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
    parts = warc.read_payloads(spark, paths, size=50).filter("page_id = 1").orderBy("chunk_no").collect()
    assert b"".join(bytes(p["chunk"]) for p in parts) == big.encode() and max(len(p["chunk"]) for p in parts) <= 50
    chunked = warc.chunk_table(df, size=64).filter("page_id = 1").orderBy("chunk_no").collect()
    assert [c["chunk_no"] for c in chunked] == [*range(len(chunked))] and chunked[-1]["is_last"] and chunked[-1]["digest"] == hashlib.sha256(big.encode()).hexdigest()
    assert {r["date"] for r in got.values()} == {got[1]["date"]} and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", got[1]["date"])
    raw = b"".join(gzip.decompress(Path(p.removeprefix("file://")).read_bytes()) for p in warc.write_archives(df, date="2024-05-06T07:08:09Z"))
    assert raw.count(b"WARC-Date: 2024-05-06T07:08:09Z\r\n") == raw.count(b"WARC/1.1\r\nWARC-Type") == len(rows)
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).count() == 0


def test_archives_of_repeated_rows_and_null_ids(spark):
    text = "z" * 300
    rows = [(1, "u", text), (1, "u", text), (None, "u", text), (2, "u", text), (None, "v", "only" * 50), (3, "u", "a" * 1000), (3, "u", "b" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.read_archives(spark, warc.write_archives(df, size=7)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 300, "response", None)] * 2 + [(None, 300, "revisit", 1), (2, 300, "revisit", 1), (None, 200, "response", None)] + [(3, 1000, "response", None)] * 2, key=repr)


def test_no_payload_is_held_whole_by_python(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000), (2, None)], "page_id long, html string")
    sizes = [r[0] for r in warc.chunk_table(df).selectExpr("length(chunk)").collect()]
    assert sorted(sizes) == [0, 3_000_000 - 2 * warc.CHUNK, warc.CHUNK, warc.CHUNK]
    plan = warc._chunks(warc._records(df, "page_id", "html", F.lit(None).cast("string")), warc.CHUNK)._jdf.queryExecution().optimizedPlan().toString()
    assert "payload" not in plan.split("MapInArrow")[1].split("\n")[0]  # what goes to Python


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 8))
    rows: list[tuple] = []
    for i in range(150):
        v = (base[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.0, 0.08, 0.5])).astype(np.float32).tolist()
        rows.append((i, v, int(rng.integers(3))))
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0, None] + [0.0] * 6, 1), (203, [float("nan")] * 8, 1), (204, rows[0][1], None), (205, [], 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (None, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2]), (208, [3e38] * 8, 1), (209, [1e-30] * 8, 1), (210, [0.0, 1.0], 1), (211, [-0.0, 1.0], 1), (212, [0.0, 1.0], 1)]
    ok = [i is not None and k is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, k in rows]
    n, link = len(rows), {}
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(np.float32(rows[k][1]), np.float64) for k in (a, b))
                x, y = x / abs(x).max(), y / abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    link.setdefault(a, set()).add(b)
    seen = {}
    for a in range(n):
        todo, reach = [a], {a}
        while todo:
            for b in link.get(todo.pop(), ()):
                if b not in reach:
                    reach.add(b)
                    todo.append(b)
        seen[a] = min((rows[b][0] for b in reach if rows[b][0] is not None), default=None)
    expected = [(rows[a][0], len(link.get(a, ())), seen[a], rows[a][0] is not None and rows[a][0] == seen[a]) for a in range(n)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, kept int").repartition(3)
    for block, visitors in ((2048, 4096), (5, 4)):
        out = embedding_dedup.link_vectors(df, fill=8, block=block, visitors=visitors)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_vectors_are_dealt_over_cells(spark, sf):
    """The query's k-means runs on tables of every size: labels have vectors in more than one cell."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").filter("embedding IS NOT NULL AND label IS NOT NULL")
    classes = rows.groupBy("label", F.col("embedding").alias("vector")).agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("size", F.size("vector")).filter("size > 0")
    centres = embedding_dedup.fitted(classes, embedding_dedup.FILL)
    assert centres and all(len(c) > 1 for c in centres.values())
    batches = classes.select("label", "size", "first", "n", "vector").toArrow().to_batches()
    own = {(label, size): set() for b in batches for label, size in zip(b.column("label").to_pylist(), b.column("size").to_pylist(), strict=True)}
    for b in embedding_dedup._assigned(iter(batches), centres, math.acos(embedding_dedup.THRESHOLD)):
        for label, size, cells in zip(b.column("label").to_pylist(), b.column("size").to_pylist(), b.column("cells").to_pylist(), strict=True):
            own[label, size].add(cells[-1])
    assert any(len(cells) > 1 for cells in own.values())


def test_rows_sent_grow_like_the_vectors(spark):
    """Ten times the vectors of ten times the clusters; no rare length falls back to one cell."""
    sent = {}
    for n in (2_000, 20_000):
        rng = np.random.default_rng(3)
        base = rng.normal(size=(n // 20, 16))
        rows = [(i, (base[i % len(base)] + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(n)] + [(n + i, rng.normal(size=3).tolist(), 0) for i in range(100)]
        classes = spark.createDataFrame(rows, "first long, vector array<double>, label int").selectExpr("label", "int(size(vector)) AS size", "first", "1L AS n", "vector")
        centres = embedding_dedup.fitted(classes, 50)
        assert set(centres) == {16, 3} and len(centres[16]) == -(-n // 50)
        kinds = ", ".join(f"{c} {k}" for c, k in classes.dtypes)
        assigned = classes.mapInArrow(lambda b, c=centres: embedding_dedup._assigned(b, c, np.arccos(0.98)), f"{kinds}, cells array<int>")
        sent[n] = embedding_dedup.dealt(assigned, 1024, 4096).count()
    assert sent[20_000] < 25 * sent[2_000]


def test_toxicity_learns_and_covers_all_windows(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeiouwnstr") for _ in range(rnd.randint(2, 7)))

    def text(bad: bool) -> str:
        ws = [word() for _ in range(rnd.randint(5, 150))]
        if bad:
            for _ in range(3):
                ws.insert(rnd.randrange(len(ws)), "vile" + word())
        return " ".join(ws)

    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "vilex vileo vilet", "x"), (902, "fine words " * 700 + "vileq vilew vilee", "x")], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, k) for i, _, k in rows] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train_on(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(docs, model, keep=True).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [(out[i]["score"] >= 0.7, bool(k)) for i, _, k in rows if out[i]["held"]]
    assert 100 < len(held) < 300 and sum(a == b for a, b in held) / len(held) > 0.8
    assert out[900]["score"] == out[901]["score"] == 0 and out[902]["score"] >= 0.7 and out[None]["score"] >= 0.7
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train_on(docs, labels.limit(0)).share == 0
    for n in (1, 47, 48, 49, 84, 85, 500):
        covered = {w for s in toxicity.windows(n) for w in range(s, s + toxicity.WINDOW)}
        assert set(range(n)) <= covered and toxicity.windows(n)[-1] < max(1, n)


def test_gradients_are_right():
    rng = np.random.default_rng(9)
    model = toxicity.train(["bad word here", "good word there"] * 6, [1, 0] * 6, rounds=1, least_steps=1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x = rng.normal(size=(7, 2 * toxicity.WIDTH))
    ids = rng.integers(0, 7, (4, toxicity.WINDOW))
    mask = np.arange(toxicity.WINDOW) < np.array([[48], [20], [3], [1]])
    truth = np.array([1.0, 0, 1, 0])

    def loss() -> float:
        p = model.score(model.gates(x), ids, mask)
        return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

    grad, d_x = model.gradients(x, ids, mask, truth)
    for w, g in [*((model.weights[k], grad[k]) for k in ("xf", "ub", "bf", "attend", "out", "bias")), (x, d_x)]:
        at = tuple(rng.integers(0, s) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-2
        up = loss()
        w[at] = old - 1e-2
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-4
