"""N-gram Jaccard join: rare-first prefix filtering, each candidate pair verified once.

A text's set holds its different runs of ``n`` words. Two texts link when their sets'
Jaccard similarity is at least ``percent`` / 100.

1.  A sketch of fixed size counts n-grams over all texts. It orders n-grams from rare
    to frequent, ties by hash. Only the order rests on it, so its error costs time at most.
2.  Texts with one set are one node, whatever their number.
3.  Two similar sets share an n-gram of their prefixes, the rarest
    ``size - ceil(t * size) + 1`` n-grams of each. Prefix n-grams of two nodes or more
    are the join's keys.
4.  Candidates pass the length filter, the positional filter (what can follow the
    shared n-gram is not more than the shorter rest) and the suffix filter (n-grams
    counted by ranges of hashes differ by no more than the two sets may; eight ranges
    or 64 before pairs are gathered, 256 after). Each pair that is left is verified once, on
    the whole sets, which are made for such pairs' nodes only.
5.  Only what decides components is compared. Under each key, all nodes are first
    compared with two leaders, and linked ones joined to components; pairs inside a
    component need no more, so a group of copies costs rows in proportion to its size.
    Then every pair between components is a candidate: of keys with few nodes by a join,
    of the others in blocks of nodes, two blocks to a task, where a pair is filtered in
    arrays and, of frequent keys that it shares, handed on under the smallest. Blocks of a key with more than
    one hold nodes of like size, and only blocks whose sizes may fit are paired.

Rows are dealt by hashes and pre-aggregated; each intermediate table goes as soon as what
replaces it is written, but for two that the result is read from. Sets compare by 56-bit hashes of n-grams,
nodes by a 64-bit hash of the set; a second hash tells if two sets share the first one,
and the run starts anew with another seed.

Edge cases: texts without words, and null texts, have size 0 and link with nothing;
with fewer than ``n`` words the whole sequence is the one n-gram; rows without an id
link with nothing and have no component; repeated rows are copies; an empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalode.llm._components import components
from stratalode.llm._shared import bound_batches, dropped, lean, salted_left_join, steps, written
from stratalode.llm._words import Sums, Words, mix, words_of

#: Counters of the sketch; an n-gram is frequent if its counter is over the mean by this many deviations.
SKETCH_BITS, DEVIATIONS = 20, 6
BLOCKS = 256
#: Keys of up to FEW nodes are joined; others are compared in blocks of BLOCK nodes. Nodes know which
#: keys of over HOT nodes they have, so a pair is handed on under one of those at most.
FEW, HOT, BLOCK, CHUNK = 16, 32, 2048, 256
#: More blocks than a class of sizes has.
MANY_BLOCKS = 1 << 32
RANGES, FINE, FINEST = 8, 64, 256


def grams(w: Words, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """56-bit hashes of all runs of n words (of the whole text, if it has fewer), and each text's first run."""
    counts = w.counts()
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    begin = np.repeat(w.first[:-1] - first[:-1], runs) + np.arange(first[-1])
    end = np.minimum(begin + n, np.repeat(w.first[1:], runs))
    return mix(Sums(mix(w.hashes ^ np.uint64(seed * 2 + 1))).runs(begin, end)) >> np.uint64(8), first


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], n: int, seed: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in (s for b in batches for s in steps(b)):
        found, times = np.unique(bucket(grams(words_of(batch.column(1), lower=True), n, seed)[0]), return_counts=True)
        counts[found] += times.astype(np.uint32)
    parts = counts.reshape(BLOCKS, -1)
    used = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([zlib.compress(parts[i].astype("<u4").tobytes(), 1) for i in used], pa.binary())], ["block", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(zlib.decompress(counts), "<u4").astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([zlib.compress(x.astype("<u8").tobytes(), 1) for x in total.values()], pa.binary())], ["block", "counts"])


def levels(docs: DataFrame, n: int, seed: int) -> np.ndarray:
    """For each counter of the sketch 0, or more the more frequent its n-grams are: 1 MB, whatever the input."""
    shape = "block long, counts binary"
    rows = docs.mapInArrow(lean(lambda b: _counted(b, n, seed)), shape).repartition("block").mapInArrow(_added, shape).collect()
    counts = np.zeros((BLOCKS, (1 << SKETCH_BITS) // BLOCKS), np.float32)
    for r in rows:
        counts[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), "<u8")
    counts = counts.ravel()
    over = counts - counts.mean() - DEVIATIONS * np.sqrt(counts.mean() + 1)
    return np.where(over > 0, 1 + np.floor(np.log2(np.maximum(over, 1))), 0).astype(np.uint8)


class Sets:
    """The ordered sets of a slice of texts: level and hash in one number each, rarest first."""

    def __init__(self, batch: pa.RecordBatch, n: int, seed: int, level: np.ndarray) -> None:
        hashes, first = grams(words_of(batch.column(1), lower=True), n, seed)
        keys = level[bucket(hashes)].astype(np.uint64) << np.uint64(56) | hashes
        self.sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            s = np.sort(keys[a:b])
            self.sets.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)

    def nodes(self, second: bool = False) -> np.ndarray:
        salt = np.uint64(0xA5A5A5A5A5A5A5A5 if second else 0x3C3C3C3C3C3C3C3C)
        flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        first = np.concatenate([[0], np.cumsum([len(s) for s in self.sets])])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ salt), dtype=np.uint64)])
        return mix(sums[first[1:]] - sums[first[:-1]] + salt).view(np.int64)


def _described(batches: Iterator[pa.RecordBatch], n: int, seed: int, level: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id, node, second hash, size, counts by 8, 64 and 256 ranges of hashes, a byte each, and the prefix."""
    for batch in (s for b in batches for s in steps(b)):
        x = Sets(batch, n, seed, level)
        finest = [np.bincount((s >> np.uint64(48)).astype(np.int64) & (FINEST - 1), minlength=FINEST) for s in x.sets]
        byte = lambda counts, n: np.minimum(counts.reshape(n, -1).sum(1), 255).astype(np.uint8).tobytes()
        some = [int.from_bytes(byte(f, RANGES), "little", signed=True) for f in finest]
        size = np.array([len(s) for s in x.sets], np.int64)
        length = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
        rare = np.concatenate([s[:k] for s, k in zip(x.sets, length.tolist(), strict=True)])
        columns = [
            batch.column(0), pa.array(x.nodes()), pa.array(x.nodes(True)), pa.array(size), pa.array(some, pa.int64()),
            *(pa.array([byte(f, n) for f in finest], pa.binary()) for n in (FINE, FINEST)),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(rare.view(np.int64))),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["id", "node", "other", "size", "ranges", "fine", "finest", "prefix"])


def _whole(batches: Iterator[pa.RecordBatch], n: int, seed: int, level: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id and its set, once for repeated rows in one task."""
    sent: set[tuple[int, int]] = set()
    for batch in (s for b in batches for s in steps(b)):
        if len(sent) > 1 << 18:
            sent.clear()  # repeated rows only cost time
        x = Sets(batch, n, seed, level)
        rows = [*dict.fromkeys(zip(batch.column(0).to_pylist(), x.nodes().tolist(), strict=True))]
        at = {r: i for i, r in enumerate(zip(batch.column(0).to_pylist(), x.nodes().tolist(), strict=True))}
        fresh = [at[r] for r in rows if r not in sent]
        sent.update(rows)
        kept = [x.sets[i] for i in fresh]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
        flat = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fresh, pa.int64())), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64)))], ["id", "set"])


def candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, place_a, ranges_a, b, place_b, ranges_b) -> the different (a, b) with a < b that pass the filters."""
    size = lambda s: F.shiftright(F.col(f"place_{s}"), 32)
    at = lambda s: F.col(f"place_{s}").bitwiseAND(F.lit((1 << 32) - 1))
    least = F.ceil(percent * (size("a") + size("b")) / F.lit(100 + percent)).cast("long")  # of what both must share
    after = F.least(at("a"), at("b")) + 1 + F.least(size("a") - at("a") - 1, size("b") - at("b") - 1)

    def count(side: str, i: int) -> Column:
        return F.shiftright(F.col(f"ranges_{side}"), 8 * i).bitwiseAND(F.lit(255))

    apart = sum((F.abs(count("a", i) - count("b", i)) for i in range(RANGES)), F.lit(0))
    kept = pairs.filter((F.col("a") != F.col("b")) & (100 * F.least(size("a"), size("b")) >= percent * F.greatest(size("a"), size("b"))))
    kept = kept.filter((after >= least) & (apart <= size("a") + size("b") - 2 * least))
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, size_a, finest_a, b, size_b, finest_b) -> the pairs (a, b) whose counts may belong to similar sets."""
    for batch in batches:
        total = batch.column(1).to_numpy() + batch.column(4).to_numpy()
        counts = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, FINEST).astype(np.int64) for i in (2, 5)]
        least = -(-percent * total // (100 + percent))
        fits = np.flatnonzero(np.abs(counts[0] - counts[1]).sum(1) <= total - 2 * least)
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(fits)) for i in (0, 3)], ["a", "b"])


def near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    for s in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("id").alias(s), F.col("size").alias(f"size_{s}"), F.col("finest").alias(f"finest_{s}")), s)
    return pairs.select("a", "size_a", "finest_a", "b", "size_b", "finest_b").mapInArrow(lean(lambda b: _near(b, percent)), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


class Judge:
    """Verifies pairs of nodes, each once; makes the sets it has not yet had to look at."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, whole: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], percent: int) -> None:
        self.nodes, self.docs, self.whole, self.percent = nodes, docs, whole, percent
        self.done: DataFrame | None = None
        self.sets: DataFrame | None = None

    def links(self, pairs: DataFrame) -> DataFrame:
        fresh = written(pairs if self.done is None else pairs.join(self.done, ["a", "b"], "left_anti"), "pairs", narrow=True)
        self.done = fresh if self.done is None else self.done.unionByName(fresh)
        left = written(near(fresh, self.nodes, self.percent), "near", narrow=True)
        ids = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = ids if self.sets is None else ids.join(self.sets.select("id"), "id", "left_anti")
        made = written(self.docs.join(wanted, "id").mapInArrow(lean(self.whole), "id long, set array<long>"), "sets")
        self.sets = made if self.sets is None else self.sets.unionByName(made)
        links = written(verified(left, self.sets, self.percent).distinct(), "links", narrow=True)
        dropped(left)
        return links

    def close(self) -> None:
        """Removes the tables of sets and pairs."""
        dropped(*(t for t in (self.done, self.sets) if t is not None))


def _between(table: pa.Table, percent: int) -> pa.Table:
    """Rows (token, hot, low, high, block, id, component, place, fine, mine) of one or two blocks
    -> the pairs (a, b) between components that pass the filters; those that share a hot key
    only under the smallest of them."""
    table = table.combine_chunks()
    get = lambda c: table.column(c).to_numpy()
    ids, part, place, block = get("id"), get("component"), get("place"), get("block")
    token, two = table.column("token")[0].as_py(), table.column("low")[0].as_py() != table.column("high")[0].as_py()
    size, at = place >> 32, place & ((1 << 32) - 1)
    fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, FINE).astype(np.int16)
    lists = table.column("mine").to_pylist()
    hot = table.column("hot")[0].as_py()
    smaller = {t: i for i, t in enumerate(sorted({t for x in lists for t in x if not hot or t < token}))}
    held = np.zeros((len(ids), len(smaller)), np.float32)
    for i, x in enumerate(lists):
        held[i, [smaller[t] for t in x if t in smaller]] = 1
    found_a, found_b = [], []
    for k in range(0, len(ids), CHUNK):
        c = slice(k, k + CHUNK)
        n, m = size[c, None], size[None]
        least = -(-percent * (n + m) // (100 + percent))
        fits = (ids[c, None] < ids[None]) & (part[c, None] != part[None]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        fits &= np.minimum(at[c, None], at[None]) + 1 + np.minimum(n - at[c, None] - 1, m - at[None] - 1) >= least
        if two:
            fits &= block[c, None] != block[None]
        if smaller:
            fits &= held[c] @ held.T == 0
        x, y = np.nonzero(fits)
        for i in range(0, len(x), 100_000):
            p, q = x[i : i + 100_000], y[i : i + 100_000]
            near = np.abs(fine[p + k] - fine[q]).sum(1) <= (n[p, 0] + m[0, q]) - 2 * least[p, q]
            found_a.append(ids[p[near] + k])
            found_b.append(ids[q[near]])
    joined = [np.concatenate([*f, np.zeros(0, np.int64)]) for f in (found_a, found_b)]
    return pa.table({"a": joined[0], "b": joined[1]})


def _across(placed: DataFrame, counts: DataFrame, many: DataFrame, nodes: DataFrame, percent: int, side: Callable[[str], list[Column]]) -> DataFrame:
    """placed (token, id, place, ranges, component), counts (token, m) of keys with nodes of two components
    or more, many (placed of keys over FEW, large, hot) -> all candidates (a, b) between components."""
    few = placed.join(counts.filter(F.col("m") <= FEW).select("token"), "token")
    a = few.select("token", *side("a"), F.col("component").alias("part_a"))
    b = few.select("token", *side("b"), F.col("component").alias("part_b"))
    pairs = candidates(a.join(b, "token").filter("a < b AND part_a != part_b"), percent)
    mine = many.filter("hot").groupBy("id").agg(F.collect_set("token").alias("mine"))  # no more than its prefix
    rows = many.join(nodes.select("id", "fine"), "id").join(mine, "id", "left").withColumn("mine", F.coalesce("mine", F.array().cast("array<long>")))
    dealt = _dealt(rows, percent).select("token", "hot", "low", "high", "block", "id", "component", "place", "fine", "mine").groupBy("token", "low", "high")
    return pairs.unionByName(dealt.applyInArrow(lambda t: _between(t, percent), "a long, b long")).distinct()


def _dealt(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (token, id, place, large, ...) of keys -> one for each pair of blocks (low, high) that a node is in (block).
    Nodes of a ``large`` key, one of more than a block, are parted by the logarithm of their size, so that sizes that may
    belong to similar sets lie in one class or in neighbours; blocks of other classes never meet."""
    one = F.lit(0).cast("long")
    alone = rows.filter("NOT large").select("*", *(one.alias(c) for c in ("block", "low", "high")))
    step = math.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1e-6
    size = F.shiftright("place", 32).cast("double")
    rows = rows.filter("large").withColumn("class", F.floor(F.log(size) / step).cast("long"))
    counts = rows.groupBy("token", "class").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    met = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    others = counts.select("token", met.alias("class"), F.struct("class", "blocks").alias("met")).groupBy("token", "class").agg(F.collect_list("met").alias("met"))
    placed = salted_left_join(rows, counts.join(others, ["token", "class"]), ["token", "class"], "id")
    code = lambda c, block: (c * MANY_BLOCKS + block).cast("long")
    placed = placed.withColumn("block", code(F.col("class"), F.pmod(F.xxhash64("id"), F.col("blocks"))))
    every = F.flatten(F.transform("met", lambda m: F.transform(F.sequence(F.lit(0).cast("long"), m["blocks"] - 1), lambda j: code(m["class"], j))))
    placed = placed.withColumn("other", F.explode(every)).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return alone.unionByName(placed.select(alone.columns))


def _linked(keys: DataFrame, judge: Judge) -> DataFrame:
    """keys (token, id, place, ranges) -> (node, component) for all ids that have a link. Removes ``keys``."""
    row = F.struct("id", "place", "ranges")
    side = lambda s: [F.col(c).alias(f"{c}_{s}" if c != "id" else s) for c in ("id", "place", "ranges")]
    both = keys.groupBy("token").agg(F.min(row).alias("low"), F.max(row).alias("high")).select("token", F.explode(F.array("low", "high")).alias("row"))
    lead = both.select("token", "row.*").select("token", *side("b"))
    links = judge.links(candidates(keys.select("token", *side("a")).join(lead, "token"), judge.percent))
    parts = components(links)
    placed = written(keys.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    dropped(keys)
    counts = placed.groupBy("token").agg(F.count("*").alias("m"), (F.min("component") != F.max("component")).alias("open"))
    counts = written(counts.filter("open").select("token", "m"), "open", narrow=True)
    common = counts.filter(F.col("m") > FEW).select("token", (F.col("m") > BLOCK).alias("large"), (F.col("m") > HOT).alias("hot"))
    many = written(placed.join(common, "token"), "many")
    last = judge.links(_across(placed, counts, many, judge.nodes, judge.percent, side))
    dropped(placed, many, counts)
    judge.close()
    found = components(links.unionByName(last))
    dropped(links, last, parts)
    return found


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, seed: int = 0
) -> DataFrame:
    """One row per text: id, n_shingles (size of its set) and component_id (the smallest
    id reachable by links, its own included)."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = rows.filter("id IS NOT NULL AND text IS NOT NULL")
    cast = df.sparkSession.sparkContext.broadcast(levels(docs, n, seed))
    shape = "id long, node long, other long, size long, ranges long, fine binary, finest binary, prefix array<long>"
    described = written(rows.mapInArrow(lean(lambda b: _described(b, n, seed, cast.value, percent)), shape), "described")
    ids = written(described.select("id", "node", "size"), "ids", narrow=True)
    # one row for each set; its columns come from any of its texts
    first = [F.first(c).alias(c) for c in ("size", "ranges", "fine", "finest", "prefix")]
    nodes = described.filter("size > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"), *first, (F.min("other") != F.max("other")).alias("clash"))
    whole = written(nodes, "nodes")
    dropped(described)
    if whole.filter("clash").limit(1).count():  # two sets under one hash: once in very many runs
        dropped(ids, whole)
        return jaccard_components(df, id_col, text_col, n, percent, seed + 1)
    prefixes = whole.select("id", "size", F.posexplode("prefix").alias("at", "token"))
    shared = written(prefixes.groupBy("token").count().filter("count > 1").select("token"), "shared", narrow=True)
    place = (F.shiftleft(F.col("size"), 32) + F.col("at")).alias("place")
    found = prefixes.select("token", "id", place).join(shared, "token").join(whole.select("id", "ranges"), "id")
    keys = written(found.select("token", "id", "place", "ranges"), "keys")
    nodes = written(whole.select("node", "id", "n", "size", "fine", "finest"), "nodes")
    dropped(shared, whole)
    parts = _linked(keys, Judge(nodes, docs, lambda b: _whole(b, n, seed, cast.value), percent))
    known = written(nodes.select("node", "id", "n", "size").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component_id", F.coalesce("component", "id")), "known", narrow=True)
    dropped(nodes, parts)
    # a set of one text is that text's row; texts of larger groups, which may hold most rows, are dealt by id too
    one = known.filter("n = 1").select("id", "size", "component_id")
    many = salted_left_join(ids.filter("size > 0 AND id IS NOT NULL"), known.filter("n > 1").select("node", "component_id"), ["node"], "id")
    rest = ids.filter("size = 0 OR id IS NULL").select("id", "size", F.col("id").alias("component_id"))
    out = one.unionByName(many.filter("component_id IS NOT NULL").select("id", "size", "component_id")).unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")
