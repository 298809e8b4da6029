"""Periodic runs of words, found online: catchers over power-of-two blocks detect squares, which merge into runs.

For each block size s the text has completed blocks [m s, m s + s). The catcher of a block looks for the block's words 2 s to
4 s - 1 words further on (1 to 3 for single words), in every window as it is completed. A hit at distance q is a square in
the making: each appended word advances the comparison of the suffix with the words q before it. Comparisons that reach the
asked exponent are extended to the left and become runs; several squares of one stretch merge into one run. Any stretch
with period q holds an aligned block of a size with 2 s <= q < 4 s in its first half, so none is missed.

Many words may be appended at once; the catchers then take all new windows as arrays. Hashes only preselect: a run counts
after its words have been compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import body, mix, powers, prepare

NAMES = "doc_id n_words n_runs start length period exponent_milli runs_sha256 collapsed_sha256 runs collapsed".split()
KINDS = ["long"] * 7 + ["string"] * 2 + ["array<struct<start:long,length:long,period:long>>", "string"]
ROWS = ", ".join(f"{n} {k}" for n, k in zip(NAMES, KINDS))


class Catchers:
    """Runs of a growing sequence of word numbers: append() words, then finish(); ``runs`` holds (start, end, period).

    A run has at least ``least`` words and ``exponent`` periods (three or more) and lies in one stretch of at most
    ``longest`` words; a number that occurs once only, such as a separator, is in no run.
    """

    def __init__(self, longest: int, exponent: int = 4, least: int = 6):
        if exponent < 3:
            raise ValueError("the exponent must be at least 3")
        self.exponent, self.least = exponent, least
        self.sizes = [1 << k for k in range(max(1, (longest // (2 * exponent)).bit_length()))]
        self.words, self.sums = np.zeros(0, np.int64), np.zeros(1, np.uint64)
        self.up, self.down = powers(1)
        self.open = np.zeros((0, 3), np.int64)
        self.found: set[tuple[int, int, int]] = set()

    @property
    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, smallest period), in order: of equal stretches the smallest period is the run's own."""
        least: dict[tuple[int, int], int] = {}
        for start, end, q in self.found:
            least[start, end] = min(q, least.get((start, end), q))
        return sorted((s, e, q) for (s, e), q in least.items())

    def append(self, words: np.ndarray) -> None:
        old, now = len(self.words), len(self.words) + len(words)
        if len(self.up) <= now:
            self.up, self.down = powers(now + 1)
        terms = mix(mix(words.astype(np.uint64) + np.uint64(1))) * self.up[old:now]
        self.sums = np.concatenate([self.sums, self.sums[-1] + np.cumsum(terms)])
        self.words = np.concatenate([self.words, words])
        if len(self.open):
            start, end, q = self.open.T
            self._keep(start, self._forward(end, q), q)
        for s in self.sizes:
            at, q = self._hits(s, old)
            if len(at):
                self._catch(at, q, s)

    def finish(self) -> None:
        start, end, q = self.open.T
        self._report(start, end, q)
        self.open = self.open[:0]

    def _same(self, at: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from ``at`` are those from ``at + q``, by their hashes."""
        return (self.sums[at + n] - self.sums[at]) * self.up[q] == self.sums[at + q + n] - self.sums[at + q]

    def _hits(self, s: int, old: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of size s and distances at which a window completed by the last append has the words of the block."""
        near, far, now = (1 if s == 1 else 2 * s), 4 * s, len(self.words)
        fresh, last = max(0, old - s + 1), now - s
        first, blocks = max(0, -(-(fresh - far + 1) // s)), (last - near) // s + 1
        if last < fresh or blocks <= first:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        base = first * s
        size = last - base + 1
        windows = np.zeros((blocks - first - 1) * s + far, np.uint64)
        windows[:size] = (self.sums[base + s: base + s + size] - self.sums[base: base + size]) * self.down[base: base + size]
        own = np.arange(0, (blocks - first) * s, s)
        later = sliding_window_view(windows[near:], far - near)[::s]
        live = np.flatnonzero(~self._inside(own + base, s))
        if len(live) < len(own):
            own, later = own[live], later[live]
        row, column = np.nonzero(later == windows[own][:, None])
        at, q = own[row] + base, column + near
        new = (at + q >= fresh) & (at + q <= last)
        return at[new], q[new]

    def _inside(self, at: np.ndarray, s: int) -> np.ndarray:
        """Blocks whose next 5 s words lie in a known run of period s or less: no other period up to 4 s begins there."""
        known = [(a, e) for a, e, q in self.found if q <= s] + [(a, e) for a, e, q in self.open.tolist() if q <= s]
        if not known:
            return np.zeros(len(at), bool)
        starts, ends = np.array(sorted(known)).T
        ends = np.maximum.accumulate(ends)
        k = np.searchsorted(starts, at, "right") - 1
        return (k >= 0) & (ends[k] >= at + 5 * s)

    def _catch(self, at: np.ndarray, q: np.ndarray, s: int) -> None:
        now = len(self.words)
        # the first block of a run begins less than s words behind the run's start
        need = np.minimum((self.exponent - 1) * q - s + 1, now - at - q)
        fits = self._same(at, q, need)
        at, q, need = at[fits], q[fits], need[fits]
        if len(at):
            end = self._forward(at + q + need, q)
            start = self._backward(at, q)
            rows = np.unique(np.stack([start, end, q], 1), axis=0)
            self._keep(*rows.T)

    def _forward(self, end: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Advance each end as far as the words equal those q before them."""
        now = len(self.words)
        for k in range(now.bit_length(), -1, -1):
            n = 1 << k
            ok = np.flatnonzero(end + n <= now)
            ok = ok[self._same(end[ok] - q[ok], q[ok], n)]
            end = end.copy()
            end[ok] += n
        return end

    def _backward(self, start: np.ndarray, q: np.ndarray) -> np.ndarray:
        for k in range(len(self.words).bit_length(), -1, -1):
            n = 1 << k
            ok = np.flatnonzero(start >= n)
            ok = ok[self._same(start[ok] - n, q[ok], n)]
            start = start.copy()
            start[ok] -= n
        return start

    def _keep(self, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> None:
        """What reaches the last word stays open, the rest is settled."""
        live = end == len(self.words)
        known = {(a, p) for a, _, p in self.open.tolist()}
        still = self.open[self.open[:, 1] == len(self.words)]
        more = np.stack([start[live], end[live], q[live]], 1)
        self.open = np.unique(np.concatenate([still, more]), axis=0) if len(more) or len(known) else self.open[:0]
        self._report(start[~live], end[~live], q[~live])

    def _report(self, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> None:
        long = end - start >= np.maximum(self.least, self.exponent * q)
        start, end, q = start[long], end[long], q[long]
        sizes = end - start - q
        total = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(total[-1]) - np.repeat(total[:-1] - start, sizes)
        differ = self.words[index] != self.words[index + np.repeat(q, sizes)]
        wrong = np.unique(np.searchsorted(total, np.flatnonzero(differ), "right") - 1)
        for k in wrong.tolist():  # equal hashes of different words: compare the words themselves
            self._compare(int(start[k]), int(end[k]), int(q[k]))
        right = np.setdiff1d(np.arange(len(start)), wrong)
        self.found.update(zip(start[right].tolist(), end[right].tolist(), q[right].tolist()))

    def _compare(self, start: int, end: int, q: int) -> None:
        """All stretches of period q among the words from start to end, extended to both sides."""
        first, now = start, len(self.words)
        equal = self.words[start: end - q] == self.words[start + q: end]
        for stop in [*(np.flatnonzero(~equal) + start).tolist(), end - q]:
            a, e = first, stop + q
            first = stop + 1
            while a and self.words[a - 1] == self.words[a - 1 + q]:
                a -= 1
            while e < now and self.words[e] == self.words[e - q]:
                e += 1
            if e - a >= max(self.least, self.exponent * q):
                self.found.add((a, e, q))


class _Numbers(dict):
    """Numbers words by their first appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def batch_runs(texts: list[list[bytes]], exponent: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words; lists of like length share one sequence."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    by_size: dict[int, list[int]] = {}
    for k, words in enumerate(texts):
        if len(words) >= max(least, exponent):
            by_size.setdefault(len(words).bit_length(), []).append(k)
    for members in by_size.values():
        numbers = _Numbers()
        sizes = np.array([len(texts[k]) for k in members])
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        ids = np.empty(first[-1], np.int64)
        for k, at in zip(members, first.tolist()):
            ids[at: at + len(texts[k])] = np.fromiter(map(numbers.__getitem__, texts[k]), np.int64, len(texts[k]))
        ids[first[1:] - 1] = np.arange(len(members)) + len(numbers)  # parts the texts
        catchers = Catchers(int(sizes.max()), exponent, least)
        catchers.append(ids)
        catchers.finish()
        for start, end, q in catchers.runs:
            k = int(np.searchsorted(first, start, "right")) - 1
            found[members[k]].append((start - int(first[k]), end - start, q))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that lie in a run behind its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    kept = np.cumsum(step[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist()) if k)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _find(exponent: int, least: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in stream:
            words = [t.split() for t in batch[1].to_pylist()]
            runs = batch_runs(words, exponent, least)
            best = [min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None,) * 3 for r in runs]
            said = [_sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(r, key=lambda x: (x[0], x[2]))).encode()) for r in runs]
            kept = [collapse(w, r) for w, r in zip(words, runs)]
            start, length, period = (pa.array(c, pa.int64()) for c in (zip(*best) if best else [[]] * 3))
            yield pa.RecordBatch.from_arrays(
                [
                    batch[0], pa.array([len(w) for w in words], pa.int64()), pa.array([len(r) for r in runs], pa.int64()), start, length, period,
                    pa.array([1000 * n // q if q else None for _, n, q in best], pa.int64()), pa.array(said, pa.string()),
                    pa.array([_sha(t) for t in kept], pa.string()),
                    pa.array([[dict(start=s, length=n, period=q) for s, n, q in r] for r in runs], kind),
                    pa.array([t.decode() for t in kept], pa.string()),
                ],
                names=NAMES,
            )

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """One row per row of ``docs``: the runs of its text and the text without their repeats.

    Words are maximal stretches without blank, tab, line feed, vertical tab, form feed and carriage return; numbers count
    words from 0. A run is a longest stretch of words with smallest period ``period`` that has at least ``least`` words and
    ``exponent`` periods (three or more). start, length, period and exponent_milli are those of the longest run (then the
    first, then the smallest period) and null without one. ``collapsed`` joins the words that no run has behind its first
    period. A null text is empty, null ids and repeated rows stay as they are, other columns are not read, and an empty
    table gives no rows. Rows are worked on in batches of bounded bytes, without a shuffle.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    return texts.mapInArrow(_find(exponent, least), ROWS)
