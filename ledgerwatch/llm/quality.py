"""Quality classifier: a generalised additive model with pairwise interactions.

Text measures are cut into bins. Cyclic boosting goes over the features in turn, fits a tree of at most four leaves to the
residuals of one feature, and adds it to that feature's lookup table; then the same for the strongest pairs of features.
A score is the sum of one table entry per feature and pair, looked up by bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import LOWER, body, crc_mod5, joined, mix, prepare, word_hashes, words

#: Measures of a text, in order; an empty text has 0 in each.
FEATURES = (
    "log_bytes log_words word_bytes upper digit punct mark bar non_ascii distinct_words top_word repeated_next distinct_triples "
    "line_words distinct_lines full_stops short_words long_words"
).split()
#: Bound of the labelled rows that the model is fitted on; the driver holds one measured row for each.
FIT_ROWS = 20_000
FIT_KEYS = ["doc_id", "tie", "label"]


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, and the count of its most frequent one."""
    most = np.zeros(n)
    if not len(owner):
        return np.zeros(n), most
    key = mix(value + mix(owner.astype(np.uint64) + np.uint64(7)))
    _, at, counts = np.unique(key, return_index=True, return_counts=True)
    np.maximum.at(most, owner[at], counts)
    return np.bincount(owner[at], minlength=n).astype(float), most


def measure(texts: pa.Array) -> np.ndarray:
    """One row per text (UTF-8 bytes), one column per feature."""
    data, offsets = joined(texts)
    n, size = len(texts), np.diff(offsets).astype(float)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(of, 1)

    low = LOWER[data]
    letter = (low >= 97) & (low <= 122)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    high = data >= 128
    punct = (data > 32) & ~letter & ~digit & ~high & (data != 127)
    starts, ends, first = words(low, offsets)
    counts = np.diff(first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(first))
    hashes = word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    lengths = (ends - starts).astype(float)
    per_word = lambda x: np.bincount(owner, x, minlength=n) / np.maximum(counts, 1)
    distinct, top = _distinct(owner, hashes, n)
    same = owner[1:] == owner[:-1]
    nexts = np.bincount(owner[1:][same], hashes[1:][same] == hashes[:-1][same], minlength=n)
    three = owner[2:] == owner[:-2]
    triple = (mix(hashes[2:] * np.uint64(3)) + mix(hashes[1:-1] * np.uint64(5)) + hashes[:-2])[three] if len(owner) > 2 else np.zeros(0, np.uint64)
    triples, _ = _distinct(owner[2:][three] if len(owner) > 2 else owner[:0], triple, n)
    # lines: the hash of a line is that of its words
    line = np.concatenate([[0], np.cumsum(data == 10)])[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | ~same
    at = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts)))) if len(at) else at
    sums = np.add.reduceat(mix(hashes + place.astype(np.uint64)), at) if len(at) else np.zeros(0, np.uint64)
    lines = np.bincount(owner[at], minlength=n).astype(float)
    own_lines, _ = _distinct(owner[at], sums, n)
    full = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0)
    letters = share(letter, np.ones(n))
    return np.column_stack(
        [
            np.log1p(size), np.log1p(counts), per_word(lengths), share(upper, letters), share(digit, size), share(punct, size),
            share(data == 33, size), share(data == 124, size), share(high, size), distinct / np.maximum(counts, 1), top / np.maximum(counts, 1),
            nexts / np.maximum(counts - 1, 1), triples / np.maximum(counts - 2, 1), np.log1p(counts / np.maximum(lines, 1)),
            own_lines / np.maximum(lines, 1), per_word(full), per_word(lengths <= 3), per_word(lengths >= 12),
        ]
    )


@dataclass
class Model:
    """Borders of the bins, a lookup table per feature, and (a, b, table) per pair."""

    borders: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(b, x[:, k], side="right") for k, b in enumerate(self.borders)]) if len(x) else np.zeros(x.shape, np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for i, j, t in self.pairs:
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Best border between bins: what it gains, and the first bin on its right (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h, ridge) + _gain(g.sum() - left_g, h.sum() - left_h, ridge) - _gain(g.sum(), h.sum(), ridge)
    at = int(np.argmax(gains))
    return (float(gains[at]), at + 1) if gains[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of depth two over the bins of a feature: the Newton step of each bin's leaf."""
    _, middle = _cut(g, h, ridge)
    borders = [0, len(g)]
    if middle:
        borders.append(middle)
        for a, b in ((0, middle), (middle, len(g))):
            if at := _cut(g[a:b], h[a:b], ridge)[1]:
                borders.append(a + at)
    borders.sort()
    step = np.zeros(len(g))
    for a, b in zip(borders, borders[1:]):
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The better of two trees that cut one feature and then the other on each side: its gain and steps."""
    best = (0.0, np.zeros(g.shape))
    for turn in (False, True):
        gt, ht = (g.T, h.T) if turn else (g, h)
        for at in range(1, gt.shape[0]):
            gain, step = -_gain(g.sum(), h.sum(), ridge), np.zeros(gt.shape)
            for side in (slice(0, at), slice(at, None)):
                gs, hs = gt[side].sum(0), ht[side].sum(0)
                cut = _cut(gs, hs, ridge)[1]
                for part in ((slice(0, cut), slice(cut, None)) if cut else (slice(None),)):
                    gain += _gain(gs[part].sum(), hs[part].sum(), ridge)
                    step[side, part] = gs[part].sum() / (hs[part].sum() + ridge)
            if gain > best[0] + 1e-12:
                best = (float(gain), step.T if turn else step)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 24, rounds: int = 120, pairs: int = 6, pair_rounds: int = 20, rate: float = 0.15, ridge: float = 5.0) -> Model:
    """Fit the model; with one class or no rows every table is zero and the base is the smoothed share of ones."""
    count = x.shape[1]
    rest = 1e-9
    borders = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) + rest if len(x) else np.zeros(0) for k in range(count)]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(borders, float(np.log(share / (1 - share))), [np.zeros(len(b) + 1) for b in borders], [])
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return np.bincount(key, y - p, minlength=size), np.bincount(key, p * (1 - p), minlength=size)

    for _ in range(rounds):
        for k in range(count):
            step = rate * _tree(*slopes(b[:, k], len(model.tables[k])), ridge)
            model.tables[k] += step
            total += step[b[:, k]]
    ranked = []
    for i in range(count):
        for j in range(i + 1, count):
            # a coarse look at each pair: every third border
            a, c = b[:, i] // 3, b[:, j] // 3
            shape = (int(a.max()) + 1, int(c.max()) + 1)
            g, h = slopes(a * shape[1] + c, shape[0] * shape[1])
            ranked.append((-_pair_tree(g.reshape(shape), h.reshape(shape), ridge)[0], i, j))
    chosen = [(i, j) for gain, i, j in sorted(ranked)[:pairs] if gain < 0]
    model.pairs = [(i, j, np.zeros((len(borders[i]) + 1, len(borders[j]) + 1))) for i, j in chosen]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slopes(b[:, i] * t.shape[1] + b[:, j], t.size)
            step = rate * _pair_tree(g.reshape(t.shape), h.reshape(t.shape), ridge)[1]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def _measured(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        found = measure(batch["text"])
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in FIT_KEYS), *(pa.array(found[:, k]) for k in range(len(FEATURES)))], names=[*FIT_KEYS, *FEATURES])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled documents of folds 1 to 4 (those of the smallest hashed ids).

    Several labels of one document count as their rounded mean, null labels and labels without a document not at all. Of
    rows that share an id one counts, that of the smallest hash of the text. The bound keeps what the driver gathers (a row of numbers each) and the broadcast list of ids fixed at any input size.
    """
    prepare(docs.sparkSession)
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
        .where(crc_mod5("doc_id") != 0).groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("tie"), "label", "text")
    schema = "doc_id long, tie long, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    once = rows.mapInArrow(_measured, schema).groupBy("doc_id").agg(F.min(F.struct("tie", "label", *FEATURES)).alias("row"))
    found = once.select("row.*").orderBy(*FEATURES, "label").toPandas()
    return fit(found[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), found["label"].to_numpy(float))


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts are scored as empty ones.

    Only the id and the text are read; extra columns, repeated rows and ties change nothing.
    """
    prepare(docs.sparkSession)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(model.score(measure(batch[1])))], names=["doc_id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(crc_mod5("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
