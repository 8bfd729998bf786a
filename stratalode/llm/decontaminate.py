"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts (questions, answers) are normalised to words: A-Z lower-cased,
ASCII marks, blanks and controls cut words, everything else stays. Every run of
``window`` words of an item, or the whole item if it is shorter, becomes one
pattern ``" w1 w2 ... "`` of the automaton, which then reads each normalised
document once. Hits are mapped back to word numbers and to character offsets of
the original text.

Patterns are made, and items with one pattern gathered, by Spark. They are dealt by hash
into blocks of about ``block_bytes`` (one for a benchmark of usual size) that are stored as
files in the shared folder; the driver sees the files' names only. A task reads documents
``AT_ONCE`` bytes at a time over one automaton after the other, of which it holds one.

Edge cases: a null or word-less text has no words, no hits and is not
contaminated; a null or word-less item gives no pattern, and without any pattern words are counted all the same; two items with one
window are both reported; repeated rows of either table are judged one by one;
empty tables give an empty result or no hits. Other columns are not looked at.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalode.llm._shared import bound_batches, dropped, lean, shared_path, written

#: Bytes of patterns in one automaton, which takes some thirty times that, and of documents that pass one at a time.
BLOCK_BYTES, AT_ONCE = 4 << 20, 16 << 20
WINDOW = 13
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_NORMAL = bytes(ord(chr(b).lower()) if b < 0x80 and b in _WORD_BYTES else b if b in _WORD_BYTES else 0x20 for b in range(256))

SCHEMA = (
    "n_words long, n_hit long, items array<string>, "
    "spans array<struct<start:long,end:long,first_word:long,end_word:long>>"
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORMAL).split() if text else []


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(item, text) -> (pattern, its number of words, item), each once for an item."""
    for batch in batches:
        rows: dict[tuple[str, int, str], None] = {}
        for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ws = words(text)
            n = min(window, len(ws))
            for i in range(len(ws) - n + 1 if n else 0):
                rows[f" {b' '.join(ws[i : i + n]).decode()} ", n, item] = None
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["pattern", "n", "item"])


def _stored(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """A task's patterns -> one file for each of its blocks."""
    files, base = fs.FileSystem.from_uri(folder)
    blocks: dict[int, list[tuple]] = {}
    for batch in batches:
        for no, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            blocks.setdefault(no, []).append(tuple(row))
    names = []
    for rows in blocks.values():
        names.append(f"block-{uuid.uuid4().hex}")
        with files.open_output_stream(f"{base}/{names[-1]}", compression=None) as out:
            out.write(pickle.dumps(rows))
    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names], pa.string())], ["file"])


def store_patterns(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list[str]:
    """Files of the benchmark's patterns; a file counts once its finished task has reported it."""
    spark = benchmark.sparkSession
    folder = shared_path(spark, "patterns")
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("None")), text_col)
    made = items.mapInArrow(lean(lambda b: _windows(b, window)), "pattern string, n int, item string")
    held = written(made.groupBy("pattern", "n").agg(F.collect_set("item").alias("items")), "patterns")
    size = held.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    dealt = held.select(F.pmod(F.xxhash64("pattern"), F.lit(blocks)).alias("no"), "pattern", "n", "items").repartition(blocks, "no")
    found = [r["file"] for r in dealt.mapInArrow(lean(lambda b: _stored(b, folder)), "file string").collect()]  # a row for each block
    dropped(held)
    return sorted(found)


_built: dict[str, ahocorasick.Automaton] = {}


def automaton(file: str) -> ahocorasick.Automaton:
    """Built in a Python worker from a block's file; only the latest is kept."""
    if file not in _built:
        _built.clear()
        files, path = fs.FileSystem.from_uri(file)
        with files.open_input_stream(path, compression=None) as f:
            rows = pickle.loads(f.read())
        a = ahocorasick.Automaton()
        for pattern, n, items in rows:
            a.add_word(pattern, (n, items))
        a.make_automaton()
        _built[file] = a
    return _built[file]


def occurrences(ws: list[bytes], machine: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """[first, end) word ranges of occurrences, and the items that hold them."""
    text = f" {b' '.join(ws).decode()} "
    found = [*machine.iter(text)]
    if not found:
        return [], set()
    gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 0x20)
    ends = np.searchsorted(gaps, [e for e, _ in found]).tolist()
    held: set[str] = set()
    for items in {id(items): items for _, (_, items) in found}.values():
        held.update(items)
    return [(e - n, e) for e, (_, (n, _)) in zip(ends, found, strict=True)], held


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    ranges: list[tuple[int, int]] = []
    for start, end in sorted(set(found)):
        if ranges and start <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(end, ranges[-1][1]))
        else:
            ranges.append((start, end))
    return ranges


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of about ``most`` bytes."""
    group: list[pa.RecordBatch] = []
    for batch in batches:
        group.append(batch)
        if sum(b.nbytes for b in group) >= most:
            yield group
            group = []
    if group:
        yield group


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: bool = False,
) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside occurrences), items
    (ids as sorted strings) and spans (character offsets into the original text and
    word numbers). With ``keep`` all other columns of documents stay, but for any of these names."""
    spark = documents.sparkSession
    bound_batches(spark)
    blocks = store_patterns(benchmark, item_col, item_text_col, window, block_bytes)
    shape = pa.schema([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in gathered(batches, AT_ONCE if len(blocks) > 1 else 0):
            # of each document: words, ranges of occurrences, items
            hits: list[list[list]] = [[[0, [], set()] for _ in range(b.num_rows)] for b in group]
            for machine in map(automaton, blocks) if blocks else [None]:
                for batch, found in zip(group, hits, strict=True):
                    for hit, text in zip(found, batch.column(1), strict=True):
                        ws = words(text.as_py())
                        hit[0] = len(ws)
                        if ws and machine is not None:
                            more, items = occurrences(ws, machine)
                            hit[1] += more
                            hit[2] |= items
            for batch, found in zip(group, hits, strict=True):
                rows = []
                for text, (n, some, held) in zip(batch.column(1), found, strict=True):
                    ranges = merged(some)
                    at = [m.span() for m in WORD.finditer(text.as_py())] if ranges else []
                    spans = [{"start": at[a][0], "end": at[b - 1][1], "first_word": a, "end_word": b} for a, b in ranges]
                    rows.append({"n_words": n, "n_hit": sum(b - a for a, b in ranges), "items": sorted(held), "spans": spans})
                out = pa.RecordBatch.from_pylist(rows, shape)
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *out.columns], [id_col, *others, *shape.names])

    others = [c for c in documents.columns if c != id_col and c not in shape.names] if keep else []
    whole = documents.select(id_col, F.col(text_col).alias("_text"), *others)
    kinds = dict(documents.dtypes)
    return whole.mapInArrow(lean(scan), ", ".join([*(f"`{c}` {kinds[c]}" for c in [id_col, *others]), SCHEMA]))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words, at least, stand in occurrences."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
