"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells.

Vectors with equal labels link when their cosine, in double precision, is at least
``threshold``; each group of links keeps its vector with the smallest id.

1.  Equal vectors of one label are one class, compared once, whatever their number.
2.  Centroids come from spherical k-means; they only steer the search. There are so many
    cells that the largest label has about ``fill`` classes in each, two at least, so cells don't
    grow with the input. They are fitted on a sample drawn by hash, ``PER_CELL`` classes for
    each cell, of at most ``SAMPLE_BYTES``; beyond that bound cells do grow. Every class
    goes to its nearest centroid's cell.
3.  Links over a border are not lost: a vector within the threshold's angle of the
    plane between its own cell and one with a smaller number also visits that cell.
    Two linked vectors are thus compared once, in the smaller of their cells' numbers.
4.  A cell's own vectors are cut into blocks of ``BLOCK``, its visitors into blocks of
    ``VISITORS``. A task multiplies one block of the cell's own with itself and with one
    other block; visitors are never multiplied with each other. It counts links and
    returns a row for each vector that has one (its links, the smallest id it is joined
    to there), never pairs.
5.  Those rows are edges of a graph whose components are the groups.

How many cells a vector visits depends on the data: few where vectors lie in clusters,
many where they are spread at random over all directions, as exact links ask for it.

Edge cases: a null, empty or zero vector, one with a null or non-finite component, and one
without label or id link with nothing; vectors of different lengths don't link; rows
with one id are vectors of their own; the smallest id of a group stays in all its rows;
without an id component_id is null and kept false; an empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalode.llm._components import components
from stratalode.llm._shared import bound_batches, dropped, lean, salted_left_join, written

THRESHOLD, FILL, BLOCK, VISITORS = 0.98, 128, 1024, 4096
PER_CELL, SAMPLE_BYTES = 32, 64 << 20
#: Rows of a product computed at a time.
CHUNK = 512
#: Far above what rounding in double precision can shift a product of unit vectors.
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no square overflows
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit rows; a cell that empties takes the row worst served."""
    chosen = np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)
    centre = x[np.sort(chosen)]
    for _ in range(rounds):
        near = x @ centre.T
        own, best = near.argmax(1), near.max(1)
        new = np.zeros_like(centre)
        np.add.at(new, own, x)
        size = np.sqrt((new * new).sum(1))
        for k in np.flatnonzero(size < 1e-12):
            new[k], best[worst], size[k] = x[worst := best.argmin()], np.inf, 1.0
        centre = new / size[:, None]
    return centre


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assigned(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray], angle: float) -> Iterator[pa.RecordBatch]:
    """(..., size, vector) -> the same with the cells that a class visits, its own last."""
    apart = {size: np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)) for size, c in centres.items()}
    for batch in batches:
        sizes, cells = batch.column("size").to_numpy(), np.empty(batch.num_rows, object)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if int(size) not in centres:
                cells[rows] = [[0]] * len(rows)
                continue
            c, between = centres[int(size)], apart[int(size)]
            for some in np.array_split(rows, -(-len(rows) * len(c) // (1 << 20))):
                x = unit(_matrix(batch.column("vector").take(pa.array(some))))
                near = x @ c.T
                own = near.argmax(1)
                across = near[np.arange(len(x)), own][:, None] - near
                goes = (across <= (math.sin(angle) + SLACK) * between[own] + SLACK) & (np.arange(len(c)) < own[:, None])
                for i, visits, home in zip(some.tolist(), goes, own.tolist(), strict=True):
                    cells[i] = [*np.flatnonzero(visits).tolist(), home]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])


def _products(table: pa.Table, threshold: float) -> pa.Table:
    """A task's rows -> for each vector with a link here: first, links, least."""
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    own = table.column("native").to_numpy(zero_copy_only=False) & (table.column("block").to_numpy() == low)
    table = table.take(pa.array(np.argsort(~own, kind="stable"))).combine_chunks()
    first, n, k = table.column("first").to_numpy(), table.column("n").to_numpy(), int(own.sum())
    x = unit(_matrix(table.column("vector").chunk(0))) if len(table) else np.zeros((0, 1))
    linked = np.zeros((len(x), len(x)), bool)
    for i in range(0, k, CHUNK):
        linked[i : min(i + CHUNK, k)] = x[i : min(i + CHUNK, k)] @ x.T >= threshold
    if low != high:  # pairs inside a block are another task's
        linked[:k, :k] = False
    linked[k:, :k] = linked[:k, k:].T
    np.fill_diagonal(linked, False)
    at = np.flatnonzero(linked.any(1))
    linked = linked[np.ix_(at, at)]
    links = np.array([n[at][row].sum() for row in linked], np.int64)
    least, before = first[at].copy(), None
    while before is None or (least != before).any():
        before = least
        least = np.array([min(m, before[row].min()) for m, row in zip(before, linked, strict=True)], np.int64)
    return pa.table({"first": pa.array(first[at], pa.int64()), "links": pa.array(links, pa.int64()), "least": pa.array(least, pa.int64())})


def fitted(classes: DataFrame, fill: int) -> dict[int, np.ndarray]:
    """Centroids by length of vectors, two at least."""
    most = classes.groupBy("label", "size").agg(F.count("*").alias("n")).groupBy("size").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()  # a row for each length
    wanted = {r["size"]: -(-r["most"] // fill) for r in most}
    total = sum(k * PER_CELL * size * 8 for size, k in wanted.items())
    cells = {size: max(2, int(k * min(1.0, SAMPLE_BYTES / total))) for size, k in wanted.items()}
    centres: dict[int, np.ndarray] = {}
    for r in most:
        k = cells[r["size"]]
        share = min(1.0, k * PER_CELL / r["n"])  # of all classes of this length
        drawn = classes.filter((F.col("size") == r["size"]) & (F.pmod(F.xxhash64("first", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))).select("first", "vector").toArrow()
        if drawn.num_rows:
            order = pa.array(np.argsort(drawn.column("first").to_numpy(), kind="stable"))
            centres[r["size"]] = spherical_kmeans(unit(_matrix(drawn.column("vector").combine_chunks().take(order))), k)
    return centres


def dealt(assigned: DataFrame, block: int, visitors: int) -> DataFrame:
    """A row for each task that a class has a part in."""
    cell = ["label", "size", "cell"]
    visits = assigned.select("label", "size", "first", "n", "vector", F.posexplode("cells").alias("at", "cell"), F.size("cells").alias("visits"))
    visits = visits.withColumn("native", F.col("at") == F.col("visits") - 1)
    blocks = lambda test, most: F.greatest(F.ceil(F.count_if(test) / most), F.lit(1)).cast("int")
    counted = assigned.select("label", "size", F.posexplode("cells").alias("at", "cell"), F.size("cells").alias("visits")).groupBy(cell).agg(
        blocks(F.col("at") == F.col("visits") - 1, block).alias("own"), blocks(F.col("at") < F.col("visits") - 1, visitors).alias("others"))
    placed = visits.join(counted, cell).withColumn("block", F.pmod(F.xxhash64("first"), F.when(F.col("native"), F.col("own")).otherwise(F.col("others"))).cast("int"))
    task = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    me, own = F.col("block"), F.col("own")
    count = lambda n: F.sequence(F.lit(0), n - 1)
    # the first block of visitors goes along where a block of the cell's own is multiplied with itself
    native = F.concat(F.transform(count(own), lambda j: task(F.least(j, me), F.greatest(j, me))), F.transform(F.filter(count(F.col("others")), lambda k: k > 0), lambda k: task(me, own + k)))
    guest = F.transform(count(own), lambda i: task(i, F.when(me == 0, i).otherwise(own + me)))
    rows = placed.withColumn("task", F.explode(F.when(F.col("native"), native).otherwise(guest)))
    return rows.select(*cell, "task.low", "task.high", "block", "native", "first", "n", "vector")


def link_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, fill: int = FILL, block: int = BLOCK, visitors: int = VISITORS,
) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id
    (the smallest id reachable by links) and kept (it is that one)."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & ~odd & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    hashes = [F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(1), "label", "vector").alias("h2")]
    classes = rows.filter("sound").groupBy("label", "vector").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = written(classes.select("*", F.size("vector").alias("size")), "classes")
    centres, angle = fitted(classes, fill), math.acos(threshold)
    narrow = classes.select("label", "size", "first", "n", "vector")
    kinds = ", ".join(f"{c} {k}" for c, k in narrow.dtypes)
    assigned = written(narrow.mapInArrow(lean(lambda b: _assigned(b, centres, angle)), f"{kinds}, cells array<int>"), "assigned")
    tasks = dealt(assigned, block, visitors).groupBy("label", "size", "cell", "low", "high")
    found = written(tasks.applyInArrow(lambda t: _products(t, threshold), "first long, links long, least long"), "links")
    dropped(assigned)
    links = found.groupBy("first").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("first").alias("a"), F.col("least").alias("b")))
    known = links.join(parts.withColumnRenamed("node", "first"), "first", "left")
    described = written(classes.select("first", "n", *hashes).join(known, "first", "left").select(
        "first", "n", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id")), "described", narrow=True)
    dropped(classes, found)
    # a class of one vector is that vector's row; vectors of larger classes, which may hold most rows, are dealt by id too
    one = described.filter("n = 1").select(F.col("first").alias("id"), "n_links", "component_id")
    many = salted_left_join(rows.filter("sound").select("id", *hashes), described.filter("n > 1").select("h1", "h2", "n_links", "component_id"), ["h1", "h2"], "id")
    rest = rows.filter("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = one.unionByName(many.filter("n_links IS NOT NULL").select("id", "n_links", "component_id")).unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
