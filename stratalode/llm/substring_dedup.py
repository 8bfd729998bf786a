"""Substring dedup: documents parsed into factors of an index over all documents.

Every run of ``window`` words that also starts in a document with a smaller id is
duplicate text. In the manner of a relative Lempel-Ziv parse, a document is
factored against reference blocks that index the documents:

1.  A run of ``ANCHOR`` words is chosen in each window, the one with the smallest
    hash, so equal windows choose equal anchors wherever they stand. Neighbouring
    windows with one anchor form a phrase. Blocks of the index hold the phrases by
    anchor; an anchor that no second document has ends the matter for its phrases.
2.  Phrase by phrase the document is looked up in its block. A phrase whose whole
    text stands in an earlier document is a factor: all its windows are duplicates.
    Copies are thus settled by one row for each phrase, whatever their number.
3.  What is left are phrases at the boundaries of factors: their anchor is shared,
    their text as a whole is not. Their windows are looked up one by one.
4.  Every match points to its place in the reference block, the first document that
    holds it. A factor is extended greedily: it goes on over the next phrase or window
    as long as the same block goes on with it, so a copied passage is one factor,
    whatever its length. Factors that touch are joined into spans, and their words go.

A serial longest-match parse would have to see all earlier documents at once; the
anchors let blocks be searched apart from each other with the same result. All
steps deal rows by hashes. Copies of a whole text are settled in the task that meets
them, so a group of copies has phrases once a task and not once a copy; minima over
what is left are taken before rows travel. Joins on anchors of passages that very many
different texts share rest on Spark's skew join. Anchors, windows and whole texts compare
by two independent 64-bit hashes together.

Edge cases: a null text has no words; texts under ``window`` words lose nothing;
rows without an id neither lose words nor count as earlier; rows with equal ids
don't shorten each other; a text of 2^27 words or more is an error; an empty table
gives an empty result. Other columns are kept apart and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalode.llm._shared import bound_batches, dropped, lean, steps, written
from stratalode.llm._words import BASES, Sums, Words, mix, words_of

WINDOW, ANCHOR = 50, 12
#: A place is start << 36 | windows << 30 | part of the text's CRC-32.
PLACE, COUNT, CRC = 36, 30, (1 << 30) - 1
MOST_WINDOWS = 63
#: Texts that a task remembers.
MOST_SEEN = 1 << 18


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i that has so many."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def phrases(hashes: np.ndarray, starts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For the windows at ``starts``: first window, number of windows, anchor and text hash of each phrase."""
    sums = Sums(mix(hashes))
    at = np.arange(len(hashes) - anchor + 1)
    runs = sums.runs(at, at + anchor)
    order = (mix(runs) & ~np.uint64((1 << 28) - 1)) | at.astype(np.uint64)
    chosen = sliding_min(order, window - anchor + 1)[starts] & np.uint64((1 << 28) - 1)
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff([*first, len(starts)])
    begin = starts[first]
    other = Sums(mix(hashes ^ np.uint64(BASES[1])), BASES[1])
    return begin, n, runs[chosen[first].astype(np.int64)], other.runs(begin, begin + n + window - 1)


def _copies(w: Words, ids: list[int], window: int, seen: dict[tuple[int, int], int]) -> dict[int, int]:
    """Numbers of texts whose words a text of this task with a smaller id has too -> that id. ``seen`` has
    the smallest id of each text so far."""
    if len(seen) > MOST_SEEN:
        seen.clear()
    found = {}
    long = np.flatnonzero(w.counts() >= window)
    begin, end = w.first[:-1][long], w.first[1:][long]
    keys = (Sums(mix(w.hashes)).runs(begin, end), Sums(mix(w.hashes ^ np.uint64(BASES[1])), BASES[1]).runs(begin, end))
    for i, key in zip(long.tolist(), zip(*(k.tolist() for k in keys), strict=True), strict=True):
        if (first := seen.setdefault(key, ids[i])) < ids[i]:
            found[i] = first
        else:
            seen[key] = ids[i]
    return found


def _parse(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(id, text, crc) -> the phrases of each text. A copy of a text that the task has met under a smaller id
    has none: it gives its windows by the dozen, without an anchor, and that id for a phrase."""
    seen: dict[tuple[int, int], int] = {}
    for batch in (s for b in batches for s in steps(b)):
        w = words_of(batch.column(1))
        starts = w.starts(window)
        if not len(starts):
            continue
        if len(w.hashes) >= 1 << 27:
            raise ValueError("a text has 2^27 words or more")
        crcs = batch.column(2).to_numpy(zero_copy_only=False) & CRC
        copies = _copies(w, batch.column(0).to_pylist(), window, seen)
        own = np.ones(batch.num_rows, bool)
        own[[*copies]] = False
        starts = starts[own[np.searchsorted(w.first, starts, "right") - 1]]
        parts = []
        if len(starts):
            begin, n, anchors, texts = phrases(w.hashes, starts, window, anchor)
            doc = np.searchsorted(w.first, begin, "right") - 1
            parts.append((pa.array(anchors.view(np.int64)), texts.view(np.int64), doc, (begin - w.first[doc]) << PLACE | n << COUNT | crcs[doc]))
        if copies:
            doc = np.array([*copies])
            windows = w.counts()[doc] - window + 1
            rows = -(-windows // MOST_WINDOWS)
            at = (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)) * MOST_WINDOWS
            n, doc, first = np.minimum(np.repeat(windows, rows) - at, MOST_WINDOWS), np.repeat(doc, rows), np.repeat(np.array([*copies.values()]), rows)
            parts.append((pa.nulls(len(at), pa.int64()), first, doc, at << PLACE | n << COUNT | crcs[doc]))
        for anchors, texts, doc, place in parts:
            yield pa.RecordBatch.from_arrays([anchors, pa.array(texts), batch.column(0).take(pa.array(doc)), pa.array(place)], ["anchor", "phrase", "id", "place"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(id, text, crc, places of phrases) -> the windows of those phrases."""
    for batch in (s for b in batches for s in steps(b)):
        w = words_of(batch.column(1))
        lists = batch.column(3)
        places = lists.flatten().to_numpy()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        n = places >> COUNT & 63
        if not len(n):
            continue
        sums, other = Sums(mix(w.hashes)), Sums(mix(w.hashes ^ np.uint64(BASES[1])), BASES[1])
        at = np.repeat((places >> PLACE) - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc = np.repeat(doc, n)
        begin = at + w.first[doc]
        crc = batch.column(2).to_numpy(zero_copy_only=False)[doc] & CRC
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(sums.runs(begin, begin + window).view(np.int64)), pa.array(other.runs(begin, begin + window).view(np.int64)),
                batch.column(0).take(pa.array(doc)), pa.array(at << PLACE | 1 << COUNT | crc),
            ],
            ["anchor", "phrase", "id", "place"],
        )


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FACTORS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("block", pa.int64()), ("block_start", pa.int64())]))


def factors_of(found: list[dict[str, int]], window: int) -> list[dict[str, int]]:
    """Matches of a document -> its factors, each as long as its block goes on. Rows that are repeated bring
    a match more than once, and may cut a passage at other places; such matches lie inside a factor or go on from it."""
    out: list[dict[str, int]] = []
    for m in sorted(found, key=lambda m: m["place"]):
        start, n, block, at = m["place"] >> PLACE, m["place"] >> COUNT & 63, m["block"], m["block_place"] >> PLACE
        if out and (last := out[-1])["block"] == block and start + window - 1 <= last["start"] + last["length"] and start - last["start"] == at - last["block_start"]:
            last["length"] = max(last["length"], start - last["start"] + n + window - 1)
        else:
            out.append({"start": start, "length": n + window - 1, "block": block, "block_start": at})
    return out


def _cut(batches: Iterator[pa.RecordBatch], window: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(id, text, matches, rest) -> id, n_words, n_removed, kept, spans, factors, rest."""
    for batch in (s for b in batches for s in steps(b)):
        rows = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()
            factors = factors_of(found or [], window)
            ranges: list[tuple[int, int]] = []
            for f in factors:
                start, end = f["start"], f["start"] + f["length"]
                if ranges and start <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(end, ranges[-1][1]))
                else:
                    ranges.append((start, end))
            kept = b" ".join(x for a, b in zip([0, *(b for _, b in ranges)], [*(a for a, _ in ranges), len(words)], strict=True) for x in words[a:b])
            rows.append((len(words), sum(b - a for a, b in ranges), kept.decode(), [{"start": a, "end": b} for a, b in ranges], factors))
        kinds = (pa.int64(), pa.int64(), pa.string(), SPANS, FACTORS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), *batch.columns[3:]], names)


def duplicate_matches(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, text, crc) -> (id, place, block, block_place): phrases and windows that an earlier document
    has, and where the first that has them does."""
    shape = "anchor long, phrase long, id long, place long"
    whole = written(docs.filter("id IS NOT NULL AND text IS NOT NULL").mapInArrow(lean(lambda b: _parse(b, window, anchor)), shape), "parsed")
    parsed = whole.filter("anchor IS NOT NULL")
    # anchors that two documents have, and whether their phrases differ
    span = parsed.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), (F.min("phrase") != F.max("phrase")).alias("differ"))
    shared = written(span.filter("a < b").select("anchor", "differ"), "anchors")
    found = written(parsed.join(shared, "anchor"), "phrases")
    dropped(shared)
    least = F.min(F.struct("id", "place"))
    firsts = written(found.groupBy("anchor", "phrase").agg(least.alias("first")).select("anchor", "phrase", F.col("first.id").alias("block"), F.col("first.place").alias("block_place")), "firsts")
    looked_up = found.join(firsts, ["anchor", "phrase"])
    # boundaries: the first document with a phrase stands for all; only it is asked window by window
    asked = looked_up.filter("id = block AND differ").groupBy("id", crc_of(F.col("place")).alias("crc")).agg(F.collect_list("place").alias("places"))
    texts = docs.join(asked.hint("shuffle_hash"), ["id", "crc"]).select("id", "text", "crc", "places")
    windows = written(texts.mapInArrow(lean(lambda b: _windows(b, window)), shape), "windows")
    met = windows.groupBy("anchor", "phrase").agg(least.alias("first"), F.max("id").alias("last")).filter("first.id < last")
    first = written(met.select("anchor", "phrase", F.col("first.id").alias("block"), F.col("first.place").alias("block_place")), "first-windows")
    late = looked_up.filter("id > block").unionByName(windows.join(first, ["anchor", "phrase"]).filter("id > block"), allowMissingColumns=True)
    copies = whole.filter("anchor IS NULL").select("id", "place", F.col("phrase").alias("block"), F.col("place").alias("block_place"))
    matches = written(late.select("id", "place", "block", "block_place").unionByName(copies), "matches")
    dropped(whole, found, firsts, windows, first)
    return matches


def crc_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit(CRC))


def substring_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, keep: bool = False
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words that stay, joined by one
    space), spans (first and end word of what goes) and factors (start, length, the document
    that is the block, start in it). With ``keep`` all other columns stay, the text among them,
    but for any of these names."""
    if not anchor < window <= anchor + 51:
        raise ValueError("a window may have up to 51 words more than an anchor, and one more at least")
    bound_batches(df.sparkSession)
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).bitwiseAND(F.lit(CRC))
    made = [id_col, "n_words", "n_removed", "kept", "spans", "factors"]
    others = [c for c in df.columns if c not in made] if keep else []
    rest = F.struct(*others).alias("rest") if others else F.lit(0).alias("rest")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), crc.alias("crc"), rest)
    docs = rows.select("id", "text", "crc")
    matches = duplicate_matches(docs, window, anchor)
    lists = matches.groupBy("id", crc_of(F.col("place")).alias("crc")).agg(F.collect_list(F.struct("place", "block", "block_place")).alias("found"))
    ready = rows.join(lists.hint("shuffle_hash"), ["id", "crc"], "left").select("id", "text", "found", *(["rest"] if others else []))
    shape = f"`{id_col}` long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>, factors array<struct<start:long,length:long,block:long,block_start:long>>"
    if others:
        kind = dict(ready.dtypes)["rest"]
        return ready.mapInArrow(lean(lambda b: _cut(b, window, [*made, "rest"])), f"{shape}, rest {kind}").select(*made, "rest.*")
    return ready.mapInArrow(lean(lambda b: _cut(b, window, made)), shape)
