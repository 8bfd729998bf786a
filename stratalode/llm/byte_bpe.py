"""Byte-level BPE: text to ids and back, by a table of ranks.

The rank table becomes a model of the tokenizers library: its bytes are mapped to
printable characters, and each token gives one merge for every way to cut it into
two other tokens, in order of rank. A text is cut by the split pattern; each
different piece of a batch goes through the library once and is kept in a bounded
table of the Python worker, so frequent words cost one look-up.

Decoding turns the byte table round: ids give bytes; a character whose bytes are
split over several tokens comes out whole in ``decoded``, and in ``pieces`` of
single tokens as replacement characters.

Edge cases: a null text counts as empty and gives no ids; ids are exact for texts
of any length, repeated rows are encoded one by one, an empty table gives an empty
result. Ids outside the table are an error. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from stratalode.llm._shared import bound_batches, lean, steps
from stratalode.llm._words import forget_long

#: Pieces that a worker keeps; the table starts anew when it is full.
KEPT_PIECES = 300_000
RANKS = "byte_bpe_multi_50k.tiktoken"
_codecs: dict[tuple[str, str], Codec] = {}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one rank table; built once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        shown = byte_characters()
        write = lambda b: "".join(map(shown.__getitem__, b))
        ordered = sorted(ranks, key=ranks.__getitem__)
        merges = [(write(t[:i]), write(t[i:])) for t in ordered for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={write(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cut = regex.compile(pattern).findall
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size_of[[*self.bytes_of]] = [len(t) for t in self.bytes_of.values()]
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.cut(t) for t in texts]
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        new = list(set().union(*pieces).difference(self.kept))
        for p, e in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.kept[p] = np.array(e.ids, "<u4").tobytes()
        look_up = self.kept.__getitem__
        coded = [b"".join(map(look_up, p)) for p in pieces]
        forget_long(self.kept, new)
        return coded

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token; tokens that share a character overlap."""
        ends = np.cumsum(self.size_of[ids])
        heads = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # characters begun by each byte
        if not len(ids):
            return ends, ends
        return heads[ends - self.size_of[ids]] - 1, heads[ends - 1]


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    with_offsets: bool = False,
) -> DataFrame:
    """One row per text: id, n_tokens, ids (array of ints), ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and, if asked for, starts and ends: the
    tokens' character offsets. ``ranks`` is the table's path on every machine."""
    bound_batches(df.sparkSession)
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in (s for b in batches for s in steps(b)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            coded = c.encode(texts)
            bounds = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
            lists = lambda flat, bounds=bounds: pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32)))
            out = {
                batch.schema.names[0]: batch.column(0), "n_tokens": pa.array(np.diff(bounds).astype(np.int64)),
                "ids": lists(np.frombuffer(b"".join(coded), "<u4")), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
            }
            if with_offsets:
                spans = [c.offsets(t, np.frombuffer(x, "<u4")) for t, x in zip(texts, coded, strict=True)]
                out |= {k: lists(np.concatenate([s[i] for s in spans] or [np.zeros(0)])) for i, k in enumerate(("starts", "ends"))}
            yield pa.RecordBatch.from_pydict(out)
        c.kept.clear()  # the worker may serve another operator next

    narrow = df.select(id_col, text_col)
    spans = ", starts array<int>, ends array<int>" if with_offsets else ""
    return narrow.mapInArrow(lean(run), f"`{id_col}` {narrow.dtypes[0][1]}, n_tokens long, ids array<int>, ids_sha256 string{spans}")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row per text: id, n_tokens, ids_sha256 and decoded_sha256, as ``decode`` gives them for what
    ``encode`` makes. Both run in one Python worker, so no ids travel between two."""
    bound_batches(df.sparkSession)
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in (s for b in batches for s in steps(b)):
            coded = c.encode([t or "" for t in batch.column(1).to_pylist()])
            made = (hashlib.sha256(c.decode(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in coded)
            columns = [pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()), pa.array(made, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])
        c.kept.clear()  # the worker may serve another operator next

    narrow = df.select(id_col, text_col)
    return narrow.mapInArrow(lean(run), f"`{id_col}` {narrow.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(
    df: DataFrame, ids_col: str = "ids", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, with_bytes: bool = True
) -> DataFrame:
    """The columns of ``df`` but for the ids; decoded_sha256 and, if asked for, decoded
    (bytes, exact). A null list counts as empty."""
    path = ranks or public_tokenizers.path(RANKS)
    others = [c for c in df.columns if c not in (ids_col, "decoded", "decoded_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [c.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else ()) for x in part.column(0)]
                digests = pa.array([hashlib.sha256(x).hexdigest() for x in made])
                more = [pa.array(made, pa.binary())] if with_bytes else []
                yield pa.RecordBatch.from_arrays([*part.columns[1:], digests, *more], [*others, "decoded_sha256", "decoded"][: len(others) + 1 + with_bytes])

    kinds = dict(df.dtypes)
    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "decoded_sha256 string", *["decoded binary"] * with_bytes])
    return df.select(ids_col, *others).mapInArrow(lean(run), shape)
