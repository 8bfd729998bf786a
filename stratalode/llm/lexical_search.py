"""Ranked search by words with Block-Max WAND over compressed posting blocks.

The index is a table. A task turns the documents that it reads into segments of about
``SEGMENT_BYTES`` of text: the documents of a segment are numbered, and each of its terms
has one row with its postings (document, occurrences) in blocks of ``BLOCK``. A block is
compressed (gaps and counts as bytes of seven bits, decoded without its neighbours), and
kept beside it are its last document and its maximum impact. Impacts depend on the number
and the mean length of all documents, which a build by parts can't know; so the maximum is
kept as those (occurrences, length) pairs of the block that no other pair beats in both,
and becomes one exact number when a search brings the totals.

A search takes the totals and how many documents hold each term of the items from the
index, weighs the terms, and deals (segment, block of items) to the tasks. There a shallow
move looks at last documents and maxima only: between two block ends of its lists an
item's score is at most the sum of the blocks' maxima, and stretches whose sum is below the
item's fiftieth best score are passed over; only blocks of stretches that are left are
decompressed. First come the few stretches of the highest sums, so that the threshold is
high soon, then all others in order of documents. A segment sends an item's best ``k``;
the best of those are the result, which is exact. No list or segment is larger than
its bound, whatever a word's frequency; nothing is collected.

Edge cases: a null text has no terms and counts for nothing; a document that shares no
term of weight with an item isn't listed for it; an item without terms has no rows; of equal
scores the smaller id comes first, null ids last; repeated rows of either table are rows of their
own; empty tables give no rows. Other columns are not looked at. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalode.llm._shared import bound_batches, lean, salted_left_join, shared_path, steps, written
from stratalode.llm._words import bounds, bytes_of, different

BLOCK = 128
#: A segment ends at this many bytes of text or documents.
SEGMENT_BYTES, SEGMENT_DOCS = 12 << 20, 1 << 15
#: Items that a task has at a time; stretches that are scored first, and at most together.
ITEMS, FIRST, TOGETHER = 512, 8, 256
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: A row for each term of a segment (docs: its holders), and one with a null term for its documents' ids and lengths.
#: last and ends: of each block the last document and the end of its bytes; upto, count, length: its best pairs.
INDEX = (
    "segment long, term string, docs int, last array<int>, ends array<int>, upto array<int>, count array<int>, length array<int>, data binary, "
    "ids array<long>, lengths array<int>, held long, total long"
)
_ROW = pa.schema([
    ("segment", pa.int64()), ("term", pa.string()), ("docs", pa.int32()), *((c, pa.list_(pa.int32())) for c in ("last", "ends", "upto", "count", "length")),
    ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("held", pa.int64()), ("total", pa.int64()),
])


def terms(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(PATTERN), F.lit(0))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 as bytes of seven bits, low ones first, all but a number's last byte marked; and their ends."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for i in range(size.max(initial=0)):
        has = size > i
        out[(ends - size)[has] + i] = ((values[has] >> 7 * i) & 127) | (size[has] > i + 1).astype(np.int64) * 128
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    if len(ends) == len(data):
        return data.astype(np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)


class _Segment:
    """Documents and postings that gather for one segment."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # term, document, occurrences
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.docs = self.bytes = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        data, offsets = bytes_of(texts)
        inside = _IN_TERM[data]
        starts, ends = bounds(inside, offsets)
        length = np.diff(np.searchsorted(starts, offsets)) if len(starts) else np.zeros(len(texts), np.int64)
        if len(starts):
            words, which = different(_LOWER[data], inside, starts, ends)
            number = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64)
            doc = np.repeat(np.arange(len(texts)), length)
            pair, count = np.unique(which.astype(np.int64) * len(texts) + doc, return_counts=True)
            self.parts.append((number[pair // len(texts)], pair % len(texts) + self.docs, count))
        self.ids.append(ids)
        self.lengths.append(length)
        self.docs += len(texts)
        self.bytes += len(data)

    def rows(self, segment: int) -> pa.RecordBatch:
        length = np.concatenate(self.lengths)
        words = sorted(self.numbers)
        none = lambda kind, n: pa.nulls(n, kind)
        head = [pa.array([segment]), none(pa.string(), 1), *(none(f.type, 1) for f in [*_ROW][2:9])]
        ids = pa.ListArray.from_arrays([0, self.docs], pa.concat_arrays(self.ids))
        head += [ids, pa.array([length.astype(np.int32)], pa.list_(pa.int32())), pa.array([int((length > 0).sum())]), pa.array([int(length.sum())])]
        if not words:
            return pa.RecordBatch.from_arrays(head, schema=_ROW)
        rank = np.empty(len(words), np.int64)
        rank[[self.numbers[w] for w in words]] = np.arange(len(words))
        term, doc, count = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        term = rank[term]
        order = np.argsort(term << 32 | doc)
        term, doc, count = term[order], doc[order], count[order]
        list_at = np.searchsorted(term, np.arange(len(words) + 1))
        place = np.arange(len(term)) - list_at[term]
        new = place % BLOCK == 0
        block_at = np.append(np.flatnonzero(new), len(term))
        block = np.cumsum(new) - 1
        gap = np.diff(doc, prepend=0)
        gap[new] = doc[new]
        data, ends = packed(np.stack((gap, count), 1).ravel())
        byte_at = np.concatenate(([0], ends[1::2]))
        # a pair stays if no pair of its block with more occurrences, or as many, is as short: shorter than all before it in this order
        size = length[doc]
        best = np.lexsort((size, -count, block))
        worth = size[best] - block[best] * (1 << 32)  # below all of the blocks before
        stay = best[worth < np.concatenate(([1 << 62], np.minimum.accumulate(worth)[:-1]))]
        kept = np.searchsorted(block[stay], np.arange(len(block_at)))  # best pairs before each block
        blocks = np.searchsorted(block_at, list_at)  # blocks before each list
        lists = lambda values, at: pa.ListArray.from_arrays(at.astype(np.int32), pa.array(values.astype(np.int32)))
        first = np.repeat(blocks[:-1], np.diff(blocks))  # of each block, its list's first block
        body = [
            pa.array(np.full(len(words), segment)), pa.array([w.decode() for w in words], pa.string()), pa.array(np.diff(list_at).astype(np.int32)),
            lists(doc[block_at[1:] - 1], blocks), lists(byte_at[block_at[1:]] - byte_at[block_at[first]], blocks), lists(kept[1:] - kept[first], blocks),
            lists(count[stay], kept[blocks]), lists(size[stay], kept[blocks]),
            pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(byte_at[list_at].astype(np.int32)), pa.py_buffer(data)]),
            *(none(f.type, len(words)) for f in [*_ROW][9:]),
        ]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(head, body, strict=True)], schema=_ROW)


def _segments(batches: Iterator[pa.RecordBatch], most: int, docs: int) -> Iterator[pa.RecordBatch]:
    number, open_ = TaskContext.get().partitionId() << 24, _Segment()
    for batch in batches:
        for step in steps(batch, most=min(1 << 21, most)):
            open_.add(step.column(0), step.column(1))
            if open_.bytes >= most or open_.docs >= docs:
                yield open_.rows(number)
                number, open_ = number + 1, _Segment()
    if open_.docs:
        yield open_.rows(number)


@dataclass
class Index:
    rows: DataFrame
    path: str


def build_index(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, segment_docs: int = SEGMENT_DOCS) -> Index:
    """The index of all rows, written to ``path``, or to a new folder in the shared one."""
    spark = documents.sparkSession
    bound_batches(spark)
    made = documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(lambda b: _segments(b, segment_bytes, segment_docs)), INDEX)
    path = path or shared_path(spark, "lexical")
    made.write.parquet(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.schema(INDEX).parquet(path), path)


class _List:
    """A term's postings in a segment; blocks are decompressed when they are asked for, once."""

    def __init__(self, last: np.ndarray, ends: np.ndarray, peaks: np.ndarray, data: np.ndarray, spread: np.ndarray) -> None:
        self.last, self.ends, self.data, self.spread = last, ends, data, spread
        self.peaks = np.append(peaks, 0)  # none after the last block
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their impacts."""
        if i not in self.open:
            numbers = unpacked(self.data[self.ends[i - 1] if i else 0 : self.ends[i]])
            docs = np.cumsum(numbers[::2])
            self.open[i] = docs, impact(numbers[1::2], self.spread[docs])
        return self.open[i]


def impact(count: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * count // (1000 * count + spread)


class _Searched:
    """One segment's rows as lists by term."""

    def __init__(self, rows: pa.Table, documents: int, words: int) -> None:
        rows = rows.combine_chunks()
        self.at = {t: i for i, t in enumerate(rows.column("term").to_pylist()) if t is not None}
        own = rows.filter(pa.compute.is_null(rows.column("term")))
        self.ids = own.column("ids").combine_chunks().values
        spread = lambda n: 20 * (50 + 50 * n.astype(np.int64) * documents // words)
        self.spread = spread(own.column("lengths").combine_chunks().values.to_numpy())
        self.column = {c: (a.offsets.to_numpy(), a.values.to_numpy()) for c in ("last", "ends", "upto", "count", "length") for a in [rows.column(c).combine_chunks()]}
        self.impacts = impact(self.column["count"][1].astype(np.int64), spread(self.column["length"][1]))
        self.data = rows.column("data").combine_chunks()
        self.lists: dict[str, _List] = {}

    def list_of(self, term: str) -> _List | None:
        if term not in self.at:
            return None
        if term not in self.lists:
            i = self.at[term]
            part = lambda c: self.column[c][1][self.column[c][0][i] : self.column[c][0][i + 1]]
            pairs = self.impacts[self.column["count"][0][i] : self.column["count"][0][i + 1]]
            peaks = np.maximum.reduceat(pairs, np.concatenate(([0], part("upto")[:-1])))
            self.lists[term] = _List(part("last"), part("ends"), peaks, np.frombuffer(self.data[i].as_buffer(), np.uint8), self.spread)
        return self.lists[term]

    def best(self, weighed: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best of the segment, ties by id."""
        lists = [(found, w) for t, w in weighed if (found := self.list_of(t)) is not None]
        docs = scores = np.zeros(0, np.int64)
        if not lists:
            return docs, scores
        edges = np.unique(np.concatenate([x.last for x, _ in lists]))
        cover = [np.searchsorted(x.last, edges) for x, _ in lists]
        most = sum(w * x.peaks[c] for (x, w), c in zip(lists, cover, strict=True))
        threshold, todo = 1, np.arange(len(edges))
        first = np.argpartition(most, -FIRST)[-FIRST:] if len(edges) > FIRST else todo
        rest, size = np.setdiff1d(todo, first), FIRST
        batch = first
        while len(batch):
            docs, scores = self._kept(np.concatenate((docs, (new := self._scored(lists, cover, edges, batch, threshold))[0])), np.concatenate((scores, new[1])), k)
            if len(docs) == k:
                threshold = int(scores[-1])
            rest = rest[most[rest] >= threshold]
            size = min(2 * size, TOGETHER)
            batch, rest = rest[:size], rest[size:]
        return docs, scores

    def _scored(self, lists: list, cover: list[np.ndarray], edges: np.ndarray, batch: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents in these stretches that reach the threshold."""
        docs, parts = [], []
        for (x, w), c in zip(lists, cover, strict=True):
            for i in np.unique(c[batch]).tolist():
                if i < len(x.last):
                    d, s = x.block(i)
                    docs.append(d)
                    parts.append(s * w)
        doc, part = np.concatenate(docs), np.concatenate(parts)
        live = np.zeros(len(edges), bool)
        live[batch] = True
        inside = live[np.searchsorted(edges, doc)]
        doc, part = doc[inside], part[inside]
        low = doc.min(initial=1 << 62) if len(doc) else 0
        sums = np.zeros(doc.max(initial=low) - low + 1, np.int64)
        np.add.at(sums, doc - low, part)
        found = np.flatnonzero(sums >= threshold)
        return found + low, sums[found]

    def _kept(self, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids.take(pa.array(docs))
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), -scores))[:k]
        return docs[order], scores[order]


_FOUND = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search(documents: int, words: int, k: int):
    def run(segment: pa.Table, items: pa.Table) -> pa.Table:
        searched = _Searched(segment, documents, words)
        out = []
        for listed in items.column("items").to_pylist():
            for item in listed:
                docs, scores = searched.best([(t["term"], t["w"]) for t in item["terms"]], k)
                out.append(pa.table([pa.array(np.full(len(docs), item["q"])), searched.ids.take(pa.array(docs)), pa.array(scores)], schema=_FOUND))
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    return run


def search(index: Index, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each item its k highest-scoring documents."""
    spark = items.sparkSession
    rows = index.rows
    documents, words = rows.filter("term IS NULL").agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    asked = written(items.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item_id"), F.array_distinct(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("terms")), "items")
    wanted = asked.select("q", F.explode("terms").alias("term"))
    lists = rows.filter("term IS NOT NULL").join(wanted.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.ln((F.lit(2.0) * documents + 2) / (2 * F.sum("docs") + 1))).cast("long")
    weights = lists.groupBy("term").agg(weight.alias("w")).filter("w > 0")
    weighed = written(wanted.join(weights, "term").groupBy("q").agg(F.collect_list(F.struct("term", "w")).alias("terms")), "weighed")
    # blocks of items, each a row: numbered by hash, so about even
    blocks = max(1, -(-weighed.count() // ITEMS))
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    dealt = weighed.groupBy(block.alias("block")).agg(F.collect_list(F.struct("q", "terms")).alias("items"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = rows.filter("term IS NULL")
    pairs = salted_left_join(own.select("segment", every.alias("block")), dealt, ["block"], "segment").filter("items IS NOT NULL")
    right = pairs.select(F.col("segment").alias("at"), F.col("block").alias("no"), "items")
    left = lists.unionByName(own).select("segment", "term", "last", "ends", "upto", "count", "length", "data", "ids", "lengths", every.alias("block"))
    found = left.groupBy("segment", "block").cogroup(right.groupBy("at", "no")).applyInArrow(
        _search(documents, words, k), "q long, doc_id long, score long"
    )
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
