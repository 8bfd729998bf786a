"""Token ids in a content-addressed store.

Writing. Each text becomes ids (tokenizers library) and an end id. A rolling hash
over the last ``SPAN`` ids of a document cuts its stream where the hash has a given
pattern, so equal passages are cut alike wherever they stand. Chunks are named by
the SHA-256 of their ids and leave a task once. One shuffle by name brings equal
chunks together; each is stored once, in pack files, and its place goes back to the
tasks that sent it, where recipes (a document's chunks in order) get the places of
their chunks. No key has more rows than there are tasks, however many documents
share a chunk. Recipes are dealt by ranges of ids and written in ascending order of id. Every recipe file ends with the Merkle root of
its documents; the manifest lists the files with their roots and its own root.

Reading. A task takes a recipe file, fetches its chunks from the packs by place,
a few hundred documents at a time, and checks every chunk against its name and the
documents against the Merkle root. Ids of all documents before a file are the sum
over the manifest's earlier files, so offsets need no pass over the data.

Files are written under names of their own and count only once a finished task has
reported them, so repeated or lost tasks do no harm.

Edge cases: a null text counts as empty and holds the end id only; rows with equal
ids are all kept, next to each other; rows without an id come first; an empty table
gives an empty store. Other columns are not looked at.

Pack file: zstd frames end to end. Recipe file: MAGIC, then for each document
``id flag, id, ids, chunks`` and for each chunk ``pack, offset, size, name``; then a
JSON footer (packs, documents, ids, width, Merkle root), its length and MAGIC.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm._shared import bound_batches, lean, shared_path, steps, written
from stratalode.llm._words import IS_WORD, bounds, bytes_of, different, forget_long

MAGIC = b"IDSTORE1"
HEAD, ENTRY = "<?qQI", "<IQI32s"  # of a document, of a chunk
PLACE = "<16sQI32s"  # of a chunk: pack, offset, size, name
#: Bytes of text that are encoded at a time, unless one text alone is longer.
WIDE_STEP = 4 << 20
VOCABULARY = "word_bpe_49k.json"
KEPT_WORDS = 1_000_000
SPAN, LEAST, MOST, MASK = 16, 256, 16_384, np.uint64(1023 << 40)
_BYTES = np.arange(256, dtype=np.uint8)
_ASCII_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
_MARKS = np.isin(_BYTES, [b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27])
#: Second bytes of the letters from U+00C0 to U+00FF.
_LATIN = (_BYTES >= 0x80) & (_BYTES <= 0xBF) & (_BYTES != 0x97) & (_BYTES != 0xB7)
_words: dict[str, Words] = {}


class Words:
    """Ids of whole texts from the ids of their words.

    Holds for vocabularies that drop white space, lower-case, and split off runs of
    marks: no token then spans ASCII white space, or a Latin letter and the ASCII mark after it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        # the same model without the steps that leave runs of a-z as they are
        bare = json.loads(self.model.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}

    def learn_letters(self, words: list[bytes], model: object) -> list[bytes]:
        """Learns words that are one run of letters each: only its last token ends a word. Returns those left over."""
        over = []
        for i in range(0, len(words), 256):
            some = words[i : i + 256]
            ids = np.array(model.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, f"<u{self.width}")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some) and last[-1] == len(ids):
                data, cuts = ids.tobytes(), (last * self.width).tolist()
                self.kept.update(zip(some, map(data.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
            else:
                over += some
        return over

    def learn(self, new: list[bytes]) -> None:
        kinds: tuple[list[bytes], list[bytes], list[bytes]] = ([], [], [])
        for w in new:
            kinds[2 * (not w.isalpha() or not w.islower()) and (1 if not w.isascii() and w.decode().isalpha() else 2)].append(w)
        rest = [*kinds[2], *self.learn_letters(kinds[0], self.bare), *self.learn_letters(kinds[1], self.model)]
        for w, e in zip(rest, self.model.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            self.kept[w] = np.array(e.ids, f"<u{self.width}").tobytes()

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, each text's followed by ``end``, and the first id of each text (one more at the end)."""
        data, offsets = bytes_of(column)
        cased = self.cased(data, offsets)
        data = np.where(cased, data, _ASCII_LOWER[data]) if cased.any() else _ASCII_LOWER[data]
        inside = IS_WORD[data]
        starts, ends = bounds(inside, offsets, np.flatnonzero(apart(data) & ~cased))
        words, number = different(data, inside, starts, ends)
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        found = [*map(self.kept.get, words)]
        if new := [w for w, x in zip(words, found, strict=True) if x is None]:
            self.learn(new)
            found = [*map(self.kept.__getitem__, words)]
            forget_long(self.kept, new)
        flat = np.frombuffer(b"".join(found), f"<u{self.width}")
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        # each word's ids, and one place after each text's last word
        of_word = size[number]
        first = np.searchsorted(starts, offsets)
        begin = np.concatenate([[0], np.cumsum(of_word)])
        texts = np.arange(len(offsets))
        ids = np.empty(begin[-1] + len(column), f"<u{self.width}")
        own = np.ones(len(ids), bool)
        begins = begin[first] + texts
        own[begins[1:] - 1] = False
        ids[~own] = end
        ids[own] = flat[np.repeat((np.cumsum(size) - size)[number] - begin[:-1], of_word) + np.arange(begin[-1])]
        return ids, begins

    def cased(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bytes of texts that keep their case and are cut at blanks alone: special tokens' strings are matched, and
        letters composed with marks from U+0300 on, before the library lower-cases; a text may have them if it holds
        ``<|`` or a first byte of such marks."""
        odd = (data == 0xCC) | (data == 0xCD)
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        out = np.zeros(len(data), bool)
        for i in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1).tolist():
            out[offsets[i] : offsets[i + 1]] = True
        return out


def apart(data: np.ndarray) -> np.ndarray:
    """Marks other than an apostrophe after a letter: a-z, or one from U+00C0 to U+00FF."""
    letter = (data >= 0x61) & (data <= 0x7A)
    letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
    out = _MARKS[data]
    out[1:] &= letter[:-1]
    out[:1] = False
    return out


def words_of(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each document (ids[bounds[i]:bounds[i+1]]) the ends of its chunks."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    factor, k = 0x5851F42D4C957F2D, 1
    while k < SPAN:
        if len(h) > k:
            h[k:] += h[:-k].copy() * np.uint64(factor)
        factor, k = factor * factor % (1 << 64), k * 2
    marks = np.flatnonzero((h & MASK) == 0) + 1
    first = np.searchsorted(marks, bounds)
    out = []
    for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        ends, at = [], a
        for m in [*marks[first[d] : first[d + 1]].tolist(), b]:
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST and m < b:
                ends.append(m)
                at = m
        if b > at:
            ends.append(b)
        out.append(ends)
    return out


def merkle(digests: list[bytes]) -> bytes:
    while len(digests) > 1:
        digests = [hashlib.sha256(b"".join(digests[i : i + 2])).digest() for i in range(0, len(digests), 2)]
    return digests[0] if digests else hashlib.sha256(b"").digest()


@dataclass(frozen=True)
class Store:
    """What reading needs: the manifest's rows (file, documents, ids, Merkle root), in order of the ids."""

    path: str
    id_col: str
    files: list[tuple[str, int, int, str]]
    width: int
    root: str


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = 2) -> Store:
    """Writes the ids of every text, each followed by ``end``, under the shared folder."""
    spark = df.sparkSession
    bound_batches(spark)
    model = vocabulary or public_tokenizers.path(VOCABULARY)
    folder = shared_path(spark, "ids")

    none = None

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) -> a row for each different chunk of the task, numbered, and one for each document with
        the numbers of its chunks."""
        w, press, sent = words_of(model), zstandard.ZstdCompressor(level=1), {}
        task = TaskContext.get().partitionId()
        for step, batch in enumerate(s for b in batches for s in steps(b, most=WIDE_STEP)):
            ids, starts = w.encode(batch.column(1), end)
            data = ids.tobytes()
            rows: list[tuple] = []
            for doc, ends, a in zip(batch.column(0).to_pylist(), cuts(ids, starts), starts[:-1].tolist(), strict=True):
                names, begin = [], a
                for e in ends:
                    chunk = data[begin * w.width : e * w.width]
                    names.append(hashlib.sha256(chunk).digest())
                    if names[-1] not in sent:  # each name leaves a task once
                        sent[names[-1]] = len(sent)
                        rows.append((int.from_bytes(names[-1][:8], "little", signed=True), names[-1], press.compress(chunk), sent[names[-1]], none, none, none))
                    begin = e
                recipe = np.fromiter(map(sent.__getitem__, names), "<i4", len(names)).tobytes()
                # copies of one text have one recipe: recipes are dealt by their own place instead
                rows.append((len(rows) * 7919 + step, hashlib.sha256(b"".join(names)).digest(), none, none, doc, begin - a, recipe))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), task, np.int32)), *columns], ["task", "deal", "name", "data", "no", "id", "n_ids", "recipe"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stores the chunks of a partition, equal names side by side, and tells each task that sent one its
        place; recipes pass through."""
        files, base = _opened(folder)
        name, out, at, last, size = b"", None, 0, None, 0
        for batch in batches:
            rows = []
            for task, chunk, data, no, doc, n, recipe in zip(*(batch.column(c).to_pylist() for c in ("task", "name", "data", "no", "id", "n_ids", "recipe")), strict=True):
                if data is None:
                    rows.append((task, chunk, none, none, doc, n, recipe))
                    continue
                if chunk != last:
                    if out is None:
                        name = uuid.uuid4().bytes
                        out = files.open_output_stream(f"{base}/pack-{name.hex()}")
                    out.write(data)
                    at, last, size = at + size, chunk, len(data)
                rows.append((task, chunk, no, struct.pack(PLACE, name, at, size, chunk), none, none, none))
            if rows:
                kinds = (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["task", "name", "no", "place", "id", "n_ids", "recipe"])
        if out is not None:
            out.close()

    def looked_up(recipes: pa.Table, places: pa.Table) -> pa.Table:
        """One task's recipes with the places of their chunks."""
        place = dict(zip(places.column("no").to_pylist(), places.column("place").to_pylist(), strict=True))
        chunks = [b"".join(map(place.__getitem__, np.frombuffer(r, "<i4").tolist())) for r in recipes.column("recipe").to_pylist()]
        return pa.table({"id": recipes.column("id"), "doc_name": recipes.column("name"), "n_ids": recipes.column("n_ids"), "chunks": pa.array(chunks, pa.binary())})

    files, base = _opened(folder)
    files.create_dir(base, recursive=True)
    narrow = df.select(F.col(id_col).cast("long"), text_col)
    # by name: chunks meet their equals; the sort puts them side by side
    dealt = narrow.mapInArrow(lean(chunked), "task int, deal long, name binary, data binary, no int, id long, n_ids long, recipe binary").repartition("deal").sortWithinPartitions("name")
    placed = written(dealt.mapInArrow(lean(packed), "task int, name binary, no int, place binary, id long, n_ids long, recipe binary"), "placed")
    # back to the tasks that sent the chunks: a chunk that all documents share has a row for each task, not for each document
    places = placed.filter("place IS NOT NULL").select("task", "no", "place").groupBy("task")
    recipes = placed.filter("place IS NULL").select("task", "id", "name", "n_ids", "recipe").groupBy("task")
    found = recipes.cogroup(places).applyInArrow(looked_up, "id long, doc_name binary, n_ids long, chunks binary")
    ordered = found.repartitionByRange("id").sortWithinPartitions("id", "doc_name")
    width = words_of(model).width

    def recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _opened(folder)
        name, out, packs, digests, total = f"recipes-{uuid.uuid4().hex}", None, {}, [], 0
        for batch in batches:
            for doc, n_ids, chunks in zip(*(batch.column(c).to_pylist() for c in ("id", "n_ids", "chunks")), strict=True):
                if out is None:
                    out = files.open_output_stream(f"{base}/{name}")
                    out.write(MAGIC)
                entries = [*struct.iter_unpack(PLACE, chunks)]
                out.write(struct.pack(HEAD, doc is None, doc or 0, n_ids, len(entries)))
                out.write(b"".join(struct.pack(ENTRY, packs.setdefault(f"pack-{pack.hex()}", len(packs)), *rest) for pack, *rest in entries))
                digests.append(hashlib.sha256(b"".join(e[3] for e in entries)).digest())
                total += n_ids
        if out is not None:
            root = merkle(digests).hex()
            foot = json.dumps({"packs": [*packs], "documents": len(digests), "ids": total, "width": width, "root": root}).encode()
            out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
            out.close()
            yield pa.RecordBatch.from_pydict({"no": [TaskContext.get().partitionId()], "file": [name], "documents": [len(digests)], "ids": [total], "root": [root]})

    manifest = ordered.mapInArrow(lean(recorded), "no long, file string, documents long, ids long, root string").collect()  # a row for each file
    listed = [(r["file"], r["documents"], r["ids"], r["root"]) for r in sorted(manifest, key=lambda r: r["no"])]
    root = merkle([bytes.fromhex(r[3]) for r in listed]).hex()
    with files.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"id": id_col, "width": width, "files": listed, "root": root}).encode())
    return Store(folder, id_col, listed, width, root)


def open_store(path: str) -> Store:
    files, base = _opened(path)
    with files.open_input_stream(f"{base}/manifest.json") as f:
        m = json.loads(f.read())
    if merkle([bytes.fromhex(r[3]) for r in m["files"]]).hex() != m["root"]:
        raise ValueError(f"{path}: the manifest doesn't match its root")
    return Store(path, m["id"], [tuple(r) for r in m["files"]], m["width"], m["root"])


def read_store(spark: SparkSession, store: Store, with_ids: bool = False, group: int = 256) -> DataFrame:
    """One row per document, in the store's order within a file: id, start (ids of all
    documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers) and, if asked for, ids."""
    import zlib

    starts = np.cumsum([0, *(f[2] for f in store.files)]).tolist()
    folder, width, id_col = store.path, store.width, store.id_col
    todo = spark.createDataFrame([(f[0], s, f[3]) for f, s in zip(store.files, starts, strict=False)], "file string, start long, root string")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _opened(folder)
        unpress = zstandard.ZstdDecompressor()
        for file, start, root in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            with files.open_input_file(f"{base}/{file}") as f:
                size = f.size()
                f.seek(size - 16)
                n = int.from_bytes(f.read(8), "little")
                f.seek(size - 16 - n)
                foot = json.loads(f.read(n))
                f.seek(len(MAGIC))
                digests: list[bytes] = []
                for done in range(0, foot["documents"], group):
                    docs = []
                    for _ in range(min(group, foot["documents"] - done)):
                        none, doc, n_ids, n_chunks = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
                        docs.append((None if none else doc, n_ids, [*struct.iter_unpack(ENTRY, f.read(struct.calcsize(ENTRY) * n_chunks))]))
                    fetched: dict[bytes, bytes] = {}
                    wanted = sorted({c for _, _, cs in docs for c in cs})
                    pack, opened = None, None
                    for no, at, length, name in wanted:  # in order of place: each pack is opened once
                        if no != pack:
                            if opened is not None:
                                opened.close()
                            pack, opened = no, files.open_input_file(f"{base}/{foot['packs'][no]}")
                        opened.seek(at)
                        fetched[name] = unpress.decompress(opened.read(length))
                        if hashlib.sha256(fetched[name]).digest() != name:
                            raise ValueError(f"{file}: a chunk doesn't match its name")
                    if opened is not None:
                        opened.close()
                    rows = []
                    for doc, n_ids, cs in docs:
                        digests.append(hashlib.sha256(b"".join(c[3] for c in cs)).digest())
                        ids = np.frombuffer(b"".join(fetched[c[3]] for c in cs), f"<u{width}").astype("<u4")
                        if len(ids) != n_ids:
                            raise ValueError(f"{file}: a document's chunks hold {len(ids)} ids, not {n_ids}")
                        rows.append((doc, start, n_ids, zlib.crc32(ids), *([ids.astype(np.int32)] if with_ids else [])))
                        start += n_ids
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], [id_col, "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])
                if merkle(digests).hex() != root:
                    raise ValueError(f"{file}: its documents don't match the Merkle root")

    shape = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return todo.repartition(max(1, len(store.files))).mapInArrow(lean(rebuilt), shape)
