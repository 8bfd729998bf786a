"""The corpus pipeline, stage by stage, against brute force."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from stratalode.llm import byte_bpe, toxicity
from tests.llm.test_filters import norm
from tests.llm.test_text_dedup import groups, words


def fixture(rnd: random.Random) -> tuple[list[tuple], list[tuple], list[tuple]]:
    word = lambda: "".join(rnd.choice("aeionrst") for _ in range(rnd.randint(2, 7)))
    shared = [word() for _ in range(70)]
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(240):
        ws = [word() for _ in range(rnd.randint(30, 120))]
        if i % 4 == 0:
            for _ in range(3):
                ws.insert(rnd.randrange(len(ws)), "vile")
        if i % 7 == 1:
            ws[5:5] = shared
        if i % 11 == 2:
            ws[9:9] = items[i % 5][1].split()
        if i % 13 == 3:
            ws = docs[-1][1].split() + ["more"]
        text = " ".join(ws)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 0, int("vile" in ws)))
    return [*docs, (500, None, "en", "s", None), (501, "", None, None, 0), (None, "no id", "en", "s", 5)], labels, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels, items = fixture(random.Random(11))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train_on(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = {(r[0], r[1]): r[2] for r in toxicity.score(table.select("doc_id", "text", table["doc_id"].alias("k")), model, keep=True).select("k", "text", "score").collect()}
    kept = [d for d in docs if score[d[0], d[1]] < toxicity.REJECT]
    assert 0 < len(docs) - len(kept) < 100
    component = {i: c for i, _, c in groups(kept)}
    kept = [d for d in kept if d[0] is None or component[d[0]] == d[0]]
    first: dict[tuple, int] = {}
    for i, t, *_ in kept:
        ws = words(t)
        for p in range(len(ws) - 49 if i is not None else 0):
            first[tuple(ws[p : p + 50])] = min(i, first.get(tuple(ws[p : p + 50]), i))
    cut = []
    for i, t, *_ in kept:
        ws, gone = words(t), set()
        for p in range(len(ws) - 49 if i is not None else 0):
            if first[tuple(ws[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        if len(gone) < len(ws) or not gone:
            cut.append((i, " ".join(w for p, w in enumerate(ws) if p not in gone) if gone else t))
    windows = {tuple(w[k : k + 13]) for _, t in items for w in [norm(t)] for k in range(len(w) - 12)}
    clean = []
    for i, t in cut:
        w = norm(t)
        hit = {x for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for x in range(k, k + 13)}
        if not hit or 20 * len(hit) < len(w):
            clean.append((i, t))
    assert len(clean) < len(cut) < len(docs)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path(byte_bpe.RANKS)), special_tokens={})
    expected = [(i, len(e.encode_ordinary(t or ""))) for i, t in clean]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == sorted(expected, key=repr)
    import hashlib

    digests = {(i, hashlib.sha256((t or "").encode()).hexdigest(), hashlib.sha256(np.array(e.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest()) for i, t in clean}
    assert {(r["doc_id"], r["decoded_sha256"], r["ids_sha256"]) for r in got} == digests
    before = table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == before, name
