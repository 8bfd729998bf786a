"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters as a vector of its own (hashed) and the maximum over vectors of its
character n-grams, so words unseen in training are read by their letters. Windows of
``WINDOW`` words, one every ``STRIDE``, run through a gated recurrent unit in either
direction; attention pools the states of a window, and a text's score is that of its
worst window. All windows of the whole text are scored.

Training is plain numpy on the driver, on a bounded sample: at most ``clean_rows`` and
``toxic_rows`` labelled texts of at most ``most_bytes``, drawn by hash of the id.
A text's label holds for its worst window, chosen anew in every round. Nothing but the
words of a text is an input. The model is a few megabytes, whatever the corpus.

Edge cases: null texts and texts without words score 0; without rows of either label
the model is the share of toxic rows in the sample (0 for none); null labels are not
learnt from; rows without an id are scored; repeated rows are scored one by one; an
empty table gives an empty result; of texts that repeat a labelled id one is learnt from.
Other columns are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalode.llm._shared import bound_batches, lean, steps, trim
from stratalode.llm._words import bounds, bytes_of, different, mix

WINDOW, STRIDE = 48, 36
WORD_SLOTS, GRAM_SLOTS, GRAMS = 1 << 16, 1 << 17, (3, 4, 5, 6)
WIDTH, HIDDEN = 6, 8
KEPT_WORDS, KEPT_BYTES = 150_000, 16 << 20
#: Words whose grams are worked on at a time.
MANY_WORDS = 20_000
#: Bytes of text that are cut at a time, unless one text alone is longer.
WIDE_STEP = 2 << 20
CLEAN_ROWS, TOXIC_ROWS, MOST_BYTES = 2700, 900, 60_000
#: A toxic window counts as so many clean ones in training.
TOXIC_WEIGHT = 3.0
#: From this score on a text is rejected.
REJECT = 0.7
_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_readers: dict[str, Reader] = {}


def cut_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different lower-case words of all texts, the numbers of all words on end, and how many each text has.
    Words are runs of ASCII letters and digits and of everything beyond ASCII."""
    data, offsets = bytes_of(pc.utf8_lower(texts))
    inside = _WORD[data]
    starts, ends = bounds(inside, offsets)
    return *different(data, inside, starts, ends), np.diff(np.searchsorted(starts, offsets))


def slots(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slot of each word; gram slots of all words on end, and the first of each word."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in ws), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, ws), np.int64, len(ws)) + 2
    first = np.cumsum(size) - size
    end = np.repeat(first + size, size)
    value = mix(data + np.uint64(1))
    found, owner, whole = [], [], np.zeros(len(ws), np.uint64)
    place = np.arange(len(data))
    word = np.repeat(np.arange(len(ws)), size)
    run = np.zeros(len(data), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        if len(data) >= k:
            run[: len(data) - k + 1] = run[: len(data) - k + 1] * np.uint64(0x100000001B3) + value[k - 1 :]
        # a word of fewer letters than the shortest gram is one gram
        fits = (place + k <= end) if k in GRAMS else (place == first[word]) & (size[word] == k) & (k < GRAMS[0])
        found.append((mix(run[fits] + np.uint64(k)) & np.uint64(GRAM_SLOTS - 1)).astype(np.int64))
        owner.append(word[fits])
    grams, owners = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    power = np.uint64(0x9E3779B97F4A7C15) * (place - first[word] + 1).astype(np.uint64)
    np.add.at(whole, word, mix(value + power))
    return (mix(whole) & np.uint64(WORD_SLOTS - 1)).astype(np.int64), grams[order], np.searchsorted(owners[order], np.arange(len(ws)))


def all_slots(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``slots`` of many words, a part at a time."""
    parts = [slots(ws[i : i + MANY_WORDS]) for i in range(0, len(ws), MANY_WORDS)]
    starts = np.cumsum([0, *(len(p[1]) for p in parts)])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int32) for p in parts]), np.concatenate([p[2] + s for p, s in zip(parts, starts, strict=False)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """Weights by name: word, gram (tables); for each direction x, u, b; attend, out, bias."""

    share: float
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def inputs(self, word: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        table, out = self.weights["gram"], np.empty((len(word), 2 * WIDTH), np.float32)
        out[:, :WIDTH] = self.weights["word"][word]
        ends = np.append(first[1:], len(grams))
        for i in range(0, len(word), MANY_WORDS):
            part = slice(i, i + MANY_WORDS)
            out[part, WIDTH:] = np.maximum.reduceat(table[grams[first[i] : ends[part][-1]]], first[part] - first[i])
        return out

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """What inputs give to the gates of either direction; computed once for each word."""
        return [x @ self.weights[f"x{d}"] + self.weights[f"b{d}"] for d in "fb"]

    def states(self, gates: list[np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Both directions' states at each place of windows of word numbers (windows, places)."""
        n, places = ids.shape
        out = np.empty((places, n, 2 * HIDDEN), np.float32)
        for d, (name, order) in enumerate((("f", range(places)), ("b", range(places - 1, -1, -1)))):
            u, h = self.weights[f"u{name}"], np.zeros((n, HIDDEN), np.float32)
            for t in order:
                g = gates[d][ids[:, t]]
                r = h @ u
                zr = sigmoid(g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
                z, c = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN :] + c * r[:, 2 * HIDDEN :])
                on = mask[:, t, None]
                after = np.where(on, new + z * (h - new), h)
                if keep is not None:
                    keep.append((d, t, h, z, c, new, r[:, 2 * HIDDEN :], on))
                h = after
                out[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.where(mask.T, states @ self.weights["attend"], -1e9)
        e = np.exp(e - e.max(0))
        share = e / e.sum(0)
        pooled = (share[:, :, None] * states).sum(0)
        return share, pooled, sigmoid(pooled @ self.weights["out"] + self.weights["bias"][0])

    def score(self, gates: list[np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.pool(self.states(gates, ids, mask), mask)[2]

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, truth: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross entropy, windows weighed by ``weight``: by name, and for each row of inputs."""
        w, keep, n = self.weights, [], len(ids)
        gates = self.gates(x)
        states = self.states(gates, ids, mask, keep)
        share, pooled, p = self.pool(states, mask)
        grad: dict[str, np.ndarray] = {k: np.zeros_like(v) for k, v in w.items() if k not in ("word", "gram")}
        d_logit = ((p - truth) * weight / n).astype(np.float32)
        grad["out"] += pooled.T @ d_logit
        grad["bias"] += d_logit.sum()
        d_pooled = d_logit[:, None] * w["out"]
        d_share = (states * d_pooled).sum(2)
        d_e = share * (d_share - (share * d_share).sum(0))
        grad["attend"] += np.tensordot(d_e, states, ([0, 1], [0, 1]))
        d_states = share[:, :, None] * d_pooled + d_e[:, :, None] * w["attend"]
        d_gates = [np.zeros_like(g) for g in gates]
        carry = [np.zeros((n, HIDDEN), np.float32) for _ in "fb"]
        for d, t, h, z, c, new, r, on in reversed(keep):
            u = w[f"u{'fb'[d]}"]
            d_h = carry[d] + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            d_new = np.where(on, d_h * (1 - z) * (1 - new * new), 0)
            d_z = np.where(on, d_h * (h - new) * z * (1 - z), 0)
            d_c = d_new * r * c * (1 - c)
            d_g = np.concatenate([d_z, d_c, d_new], 1)
            d_r = np.concatenate([d_z, d_c, d_new * c], 1)
            grad[f"u{'fb'[d]}"] += h.T @ d_r
            carry[d] = np.where(on, d_h * z, d_h) + d_r @ u.T
            np.add.at(d_gates[d], ids[:, t], d_g)
        d_x = np.zeros_like(x)
        for d, name in enumerate("fb"):
            grad[f"x{name}"] += x.T @ d_gates[d]
            grad[f"b{name}"] += d_gates[d].sum(0)
            d_x += d_gates[d] @ w[f"x{name}"].T
        return grad, d_x


def windows(n: int, size: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """First words of the windows over n words: one every ``stride``, until the end is covered."""
    return np.arange(0, max(1, -(-(n - size) // stride) + 1)) * stride if n else np.zeros(0, np.int64)


def cut_windows(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts on end -> windows of them, masks, and each window's text."""
    starts = [windows(int(c)) for c in counts]
    text = np.repeat(np.arange(len(counts)), [len(s) for s in starts])
    offset = np.cumsum(counts) - counts
    at = np.concatenate(starts or [np.zeros(0, np.int64)])[:, None] + np.arange(WINDOW)
    mask = at < counts[text][:, None]
    return ids[np.where(mask, at + offset[text][:, None], 0)] if len(ids) else np.zeros(at.shape, np.int64), mask, text


def train(texts: list[str | None], labels: list[int], rounds: int = 5, least_steps: int = 200, batch: int = 64, rate: float = 0.01, table_rate: float = 0.004, toxic_weight: float = TOXIC_WEIGHT, seed: int = 0) -> Model:
    truth = np.array(labels, np.float32)
    model = Model(float(truth.mean()) if len(truth) else 0.0)
    if not 0 < model.share < 1:
        return model
    vocabulary, ids, counts = cut_words(pa.array(texts, pa.string()))
    word, grams, first = all_slots(vocabulary)
    at, mask, text = cut_windows(ids, counts)
    rng = np.random.default_rng(seed)
    weight = np.where(truth > 0, toxic_weight, 1.0)
    w = model.weights
    for name, size in (("word", WORD_SLOTS), ("gram", GRAM_SLOTS)):
        seen = np.zeros((2, size))  # texts of either label that have what is in a slot
        of_word = np.r_[first, len(grams)]
        for p, label in zip(np.split(ids, np.cumsum(counts)[:-1]), labels, strict=True):
            own = np.unique(p)
            own = word[own] if name == "word" else np.concatenate([grams[of_word[i] : of_word[i + 1]] for i in own] or [own])
            seen[label, np.unique(own)] += 1
        total = np.array([(truth == 0).sum(), (truth == 1).sum()])
        odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
        w[name] = rng.normal(0, 0.05, (size, WIDTH)).astype(np.float32)
        w[name][:, 0] = np.clip(odds, -4, 4) * seen.sum(0) / (seen.sum(0) + 5) / 2  # a start, trained on like the rest
    shape = {"attend": (2 * HIDDEN,), "out": (2 * HIDDEN,), "bias": (1,)} | {f"{k}{d}": s for d in "fb" for k, s in (("x", (2 * WIDTH, 3 * HIDDEN)), ("u", (HIDDEN, 3 * HIDDEN)), ("b", (3 * HIDDEN,)))}
    for k, s in shape.items():
        w[k] = (rng.normal(0, 0.2, s) if k != "bias" else np.full(s, -2.0)).astype(np.float32)
    for d in "fb":  # at first one unit of either direction follows the odds, is attended to and counts
        w[f"x{d}"][[0, WIDTH], 2 * HIDDEN] = 1.0
        w[f"x{d}"][[0, WIDTH], 0] = -0.5
    for k in ("attend", "out"):
        w[k][[0, HIDDEN]] = 2.0
    x = model.inputs(word, grams, first)
    heat = np.where(mask, (x[:, 0] + x[:, WIDTH])[at], -9.0).max(1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    of_word, turn = np.r_[first, len(grams)], 0
    in_round = max(1, len(texts) // batch)
    rounds = max(rounds, -(-least_steps // in_round))
    for r in range(rounds):
        worst = np.lexsort((heat, text))[np.flatnonzero(np.r_[np.diff(text) != 0, True])]  # each text's hottest window
        for some in np.array_split(rng.permutation(worst), max(1, len(worst) // batch)):
            own, inverse = np.unique(at[some], return_inverse=True)
            span = of_word[own + 1] - of_word[own]
            start = np.cumsum(span) - span
            g = grams[np.repeat(of_word[own] - start, span) + np.arange(span.sum())]
            x = model.inputs(word[own], g, start)
            grad, d_x = model.gradients(x, inverse.reshape(at[some].shape), mask[some], truth[text[some]], weight[text[some]])
            for name, rows, d in (("word", word[own], d_x[:, :WIDTH]), ("gram", g, np.repeat(d_x[:, WIDTH:], span, 0) * (w["gram"][g] == np.repeat(x[:, WIDTH:], span, 0)))):
                slot, back = np.unique(rows, return_inverse=True)
                grad[name] = np.zeros((len(slot), WIDTH), np.float32)
                np.add.at(grad[name], back, d)
                grad[f"{name} rows"] = slot
            slower = 1 - turn / (rounds * in_round + 1)
            turn += 1
            for k in w:
                where = grad.get(f"{k} rows", slice(None))
                a, b = moments[k]
                a[where] = 0.9 * a[where] + 0.1 * grad[k]
                b[where] = 0.99 * b[where] + 0.01 * grad[k] ** 2
                w[k][where] -= slower * (table_rate if k in ("word", "gram") else rate) * (a[where] / (1 - 0.9**turn)) / (np.sqrt(b[where] / (1 - 0.99**turn)) + 1e-6)
        if r + 1 < rounds:
            gates = model.gates(model.inputs(word, grams, first))
            heat = np.concatenate([model.score(gates, at[i : i + 4096], mask[i : i + 4096]) for i in range(0, len(at), 4096)])
    return model


class Reader:
    """Scores texts; keeps the gate inputs of the words it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes = 0
        self.gates = [np.zeros((0, 3 * HIDDEN), np.float32) for _ in "fb"]

    def learn(self, new: list[bytes]) -> None:
        """Gate inputs of new words, after those of the words known already."""
        at, end = len(self.number), len(self.number) + len(new)
        if end > len(self.gates[0]):  # room for twice as many, so rows are copied a few times at most
            self.gates = [np.concatenate([g[:at], np.empty((max(end, 2 * at) - at, 3 * HIDDEN), np.float32)]) for g in self.gates]
        for i in range(0, len(new), MANY_WORDS):
            more = self.model.gates(self.model.inputs(*slots(new[i : i + MANY_WORDS])))
            for g, m in zip(self.gates, more, strict=True):
                g[at + i : at + i + len(m)] = m
        self.number.update(zip(new, range(at, end), strict=True))
        self.bytes += sum(map(len, new))

    def score(self, texts: pa.Array) -> np.ndarray:
        ws, number, counts = cut_words(texts)
        if len(self.number) > KEPT_WORDS or self.bytes > KEPT_BYTES:
            self.clear()
        found = [*map(self.number.get, ws)]
        if new := [w for w, x in zip(ws, found, strict=True) if x is None]:
            self.learn(new)
            found = [*map(self.number.__getitem__, ws)]
        at, mask, text = cut_windows(np.array(found, np.int64)[number], counts)
        out = np.zeros(len(texts))
        for i in range(0, len(at), 4096):
            np.maximum.at(out, text[i : i + 4096], self.model.score(self.gates, at[i : i + 4096], mask[i : i + 4096]))
        return out


def held_out(key: Column) -> Column:
    """A third of the ids, by hash, from whose rows no label is learnt."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    clean_rows: int = CLEAN_ROWS, toxic_rows: int = TOXIC_ROWS, most_bytes: int = MOST_BYTES,
) -> Model:
    """A model from at most ``clean_rows`` and ``toxic_rows`` rows that are not held out, drawn by hash of
    the id from all labelled texts of at most ``most_bytes``. Of texts with one id the least is taken."""
    ids = F.col(id_col).cast("long").alias("id")
    texts = documents.select(ids, F.col(text_col).alias("text")).filter(F.octet_length("text") <= most_bytes)
    usable = labels.select(ids, F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND NOT coalesce(label NOT IN (0, 1), true)").filter(~held_out(F.col("id")))
    usable = usable.join(texts.select("id"), "id", "left_semi").distinct()
    drawn = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in ((0, clean_rows), (1, toxic_rows))]
    picked = F.broadcast(drawn[0].unionByName(drawn[1]))  # so many rows at most
    rows = texts.join(picked, "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()  # as many
    rows = sorted(rows, key=lambda r: (r["id"], r["label"]))
    model = train([r["text"] for r in rows], [r["label"] for r in rows])
    del rows
    trim()  # some 100 MB of the driver's
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per text: id (with ``keep`` all columns but one named score) and score, 0 to 1."""
    spark = df.sparkSession
    bound_batches(spark)
    cast = spark.sparkContext.broadcast(model)
    key = os.urandom(8).hex()
    others = [c for c in df.columns if c != "score"] if keep else [id_col]
    whole = df.select(F.col(text_col).alias("_text"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reader(key, cast.value)
        for batch in (s for b in batches for s in steps(b, 0, WIDE_STEP)):
            scores = r.score(batch.column(0)) if r.model.weights else np.full(batch.num_rows, r.model.share)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores.astype(np.float64))], [*others, "score"])
        r.clear()  # the worker may serve another operator next

    kinds = dict(df.dtypes)
    return whole.mapInArrow(lean(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "score double"]))


def reader(key: str, model: Model) -> Reader:
    """Made once in each Python worker; only the latest is kept."""
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(model)
    return _readers[key]
