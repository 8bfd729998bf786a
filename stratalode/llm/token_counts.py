"""Token counts of a sentence-piece BPE model, by rank-synchronous array merging.

A text is cut before its blanks into pre-tokens: no piece of the model has a blank
after another character, so no merge crosses such a cut. Where no piece holds two
neighbours side by side no merge can cross either, so pre-tokens are cut there too.
The different sequences of a batch are held on end in ragged arrays: symbols, their
neighbours, and the rank of the pair that each begins. In every round all sequences
find their lowest rank and apply it at once, at all its places from left to right;
when no pair is left, the surviving symbols are counted, a symbol outside the
vocabulary as its UTF-8 bytes. Minima are kept for blocks of ``BLOCK`` symbols, so a
round costs what it changes, however long a sequence is. Counts of pre-tokens are
kept in a bounded table of the worker.

Applying a pair at all its places is the same as one place after the other as long as
no merge makes a pair of the same or a lower rank. The few symbols that could are known
from the model; where one does, its sequence stops at that place until the next round.

Edge cases: a null or empty text has no tokens; strings of special tokens inside
texts are ordinary text, as the library has it; repeated rows are counted one by
one; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame

from stratalode.llm._shared import bound_batches, lean, steps
from stratalode.llm._words import bytes_of, different, forget_long

MODEL = "piece_bpe_32k.model"
KEPT_WORDS = 400_000
BLOCK = 64
#: Characters that are merged at a time, unless one pre-token alone is longer; bytes of text that are cut at a time.
MANY, WIDE_STEP = 1 << 18, 2 << 20
BLANK = "▁"
_models: dict[str, Merges] = {}
_NONE = np.iinfo(np.int32).max


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1, for all i on end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Merges:
    """The model's pairs as sorted arrays. Symbols are numbers: pieces and the single
    characters of pieces have one each, all other characters share number 0."""

    def __init__(self, pieces: list[str], scores: list[float]) -> None:
        symbols = {s: i for i, s in enumerate(dict.fromkeys(["", *pieces, *(c for p in pieces for c in p)]))}
        known = set(pieces)
        self.bytes_of = np.array([1 if s in known else max(1, len(s.encode())) for s in symbols], np.int64)
        self.of_char = np.zeros(0x110000, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        places = {x: i for i, x in enumerate(sorted(set(scores), reverse=True))}
        rank = dict(zip(pieces, map(places.__getitem__, scores), strict=True))
        pairs = {(p[:i], p[i:]): p for p in pieces for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols}
        #: Symbols that, once made, may form a pair that doesn't rank behind them.
        self.early = np.zeros(len(symbols), bool)
        self.early[[symbols[x] for pair, p in pairs.items() for x in pair if len(x) > 1 and rank[p] <= rank[x]]] = True
        found = sorted((symbols[a] << 32 | symbols[b], rank[p], symbols[p]) for (a, b), p in pairs.items())
        self.keys = np.array([*(k for k, _, _ in found), np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([*(r for _, r, _ in found), _NONE], np.int32)
        self.made = np.array([*(m for _, _, m in found), 0], np.int32)
        self.beside = np.array(sorted({symbols[a] << 32 | symbols[b] for p in pieces for a, b in zip(p, p[1:], strict=False)}), np.int64)
        self.kept: dict[bytes, int] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; rank _NONE where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        fits = self.keys[at] == key
        return np.where(fits, self.ranks[at], _NONE), self.made[at]

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> None:
        """Merges sequences, each from one of ``first`` up to the next, in place; 0 for what is swallowed."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        size = np.diff(np.append(first, n))
        after[first + size - 1] = -1
        before[first] = -1
        rank, made = np.full(n, _NONE, np.int32), np.zeros(n, np.int32)
        at = np.flatnonzero(after >= 0)
        rank[at], made[at] = self.look_up(symbols[at], symbols[at + 1])
        in_blocks = -(-size // BLOCK)
        begin = np.repeat(first, in_blocks) + spread(np.zeros(len(size), np.int64), in_blocks) * BLOCK
        length = np.diff(np.append(begin, n))
        of_place = np.repeat(np.arange(len(begin), dtype=np.int32), length)
        least, owner = np.minimum.reduceat(rank, begin), np.repeat(np.arange(len(size)), in_blocks)
        blocks = np.arange(len(begin))  # of sequences that still have a pair
        while True:
            own, low = owner[blocks], least[blocks]
            new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            lowest = np.repeat(np.minimum.reduceat(low, new), np.diff(np.append(new, len(own))))
            live = lowest < _NONE
            hot = blocks[live & (low == lowest)]
            blocks = blocks[live]
            if not len(blocks):
                return
            places = spread(begin[hot], length[hot])
            hits = places[rank[places] == np.repeat(least[hot], length[hot])]
            # of places that overlap every other one of a run, from its left
            alone, no = np.r_[True, after[hits[:-1]] != hits[1:]], np.arange(len(hits))
            hits = hits[(no - np.maximum.accumulate(np.where(alone, no, 0))) % 2 == 0]
            if (risky := np.flatnonzero(self.early[made[hits]])).size:
                hits = hits[self.undisturbed(symbols, after, before, made, hits, risky, rank, owner[of_place[hits]])]
            gone = after[hits]
            beyond = after[gone]
            symbols[hits], symbols[gone], rank[gone] = made[hits], 0, _NONE
            after[hits] = beyond
            more = beyond >= 0
            before[beyond[more]] = hits[more]
            rank[hits] = _NONE
            back = before[hits]
            changed = np.concatenate([hits[more], back[back >= 0]])
            rank[changed], made[changed] = self.look_up(symbols[changed], symbols[after[changed]])
            touched = np.unique(of_place[np.concatenate([hits, gone, changed])])
            sizes = length[touched]
            least[touched] = np.minimum.reduceat(rank[spread(begin[touched], sizes)], np.cumsum(sizes) - sizes)

    def undisturbed(self, symbols: np.ndarray, after: np.ndarray, before: np.ndarray, made: np.ndarray, hits: np.ndarray, risky: np.ndarray, rank: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which hits may be applied together: in each sequence those up to the first (one of ``risky``) that
        forms a pair of no higher rank with its neighbours as they stand by then."""
        at, own, low = hits[risky], made[hits[risky]], rank[hits[risky]]
        left, right = before[at], after[after[at]]
        last = np.where(risky > 0, hits[risky - 1], at)
        beside = np.where((risky > 0) & (after[last] == left), made[last], symbols[left])  # the hit before is applied
        worse = (right >= 0) & (self.look_up(own, symbols[right])[0] <= low) | (left >= 0) & (self.look_up(beside, own)[0] <= low)
        stops = risky[worse]
        mine, first = np.unique(owner[stops], return_index=True)
        if not len(mine):
            return np.ones(len(hits), bool)
        to = np.minimum(np.searchsorted(mine, owner), len(mine) - 1)
        return (mine[to] != owner) | (np.arange(len(hits)) <= stops[first[to]])

    def count_rows(self, words: list[str]) -> np.ndarray:
        """Tokens of pre-tokens, each without its first blank."""
        marked = [BLANK + w.replace(" ", BLANK) for w in words]
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        row = np.repeat(np.arange(len(marked)), size)
        symbols = self.of_char[chars]
        outside = np.where(symbols == 0, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), 0)
        pair = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        joins = self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] == pair
        self.merge(symbols, np.flatnonzero(np.r_[True, ~joins | (row[1:] != row[:-1])]))
        return np.bincount(row, np.where(symbols > 0, self.bytes_of[symbols], outside), len(marked)).astype(np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Counts pre-tokens and keeps the counts."""
        ends = np.cumsum([len(w) + 1 for w in words])
        start = 0
        while start < len(words):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MANY, "right")))
            self.kept.update(zip(words[start:end], self.count_rows([w.decode() for w in words[start:end]]).tolist(), strict=True))
            start = end

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. A pre-token goes up to the first of the blanks that end it, which is left out."""
        data, offsets = bytes_of(pc.replace_substring(texts, BLANK, " "))
        blank = data == 0x20
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        filled = np.diff(offsets) > 0
        cut[offsets[:-1][filled]] = False
        at = np.flatnonzero(cut)
        starts = np.sort(np.concatenate([offsets[:-1][filled], at + 1]))
        ends = np.sort(np.concatenate([at, offsets[1:][filled]]))
        words, number = different(data, ~cut, starts, ends)
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        found = [*map(self.kept.get, words)]
        if new := [w for w, x in zip(words, found, strict=True) if x is None]:
            self.learn(new)
            found = [*map(self.kept.__getitem__, words)]
            forget_long(self.kept, new)
        sums = np.concatenate([[0], np.cumsum(np.array(found, np.int64)[number])])
        own = np.cumsum([0, *(filled + np.diff(np.searchsorted(at, offsets)))])
        return sums[own[1:]] - sums[own[:-1]]


def merges(path: str) -> Merges:
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in own]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece of the model holds a blank after another character")
        _models[path] = Merges(pieces, [model.get_score(i) for i in own])
    return _models[path]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per text: id, n_bytes (UTF-8) and n_tokens. ``model`` is the model's path on every machine."""
    bound_batches(df.sparkSession)
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path)
        for batch in (s for b in batches for s in steps(b, most=WIDE_STEP)):
            texts = pc.fill_null(batch.column(1), "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(m.count(texts), pa.int64())], [batch.schema.names[0], "n_bytes", "n_tokens"])

    narrow = df.select(id_col, text_col)
    return narrow.mapInArrow(lean(run), f"`{id_col}` {narrow.dtypes[0][1]}, n_bytes long, n_tokens long")
