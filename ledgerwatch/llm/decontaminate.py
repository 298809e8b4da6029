"""Benchmark decontamination by spaced-seed hashing.

A document is contaminated by a benchmark item when WINDOW consecutive words of it (or the whole of a shorter item) stand
in the document with at most a fifth of them replaced. Seeds are masks over a window that ignore some positions; the masks
are chosen so that any allowed set of replacements leaves at least one seed of the window untouched, so hashing the seeds
of both sides and joining them loses nothing. Each hit is verified word by word along its diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import LOWER, body, joined, mix, prepare, word_hashes, words

#: Words of a window, and the share of them that must be equal.
WINDOW, SIMILARITY = 13, 0.8
#: Bytes of benchmark texts that are broadcast at once; a larger benchmark is searched for in blocks of this size.
BLOCK_BYTES = 8 << 20
ROW = "doc_id long, tie long, items array<long>, starts array<long>, lengths array<long>, equal array<long>"


@lru_cache(None)
def masks(size: int, most: int = 3) -> tuple[tuple[int, ...], ...]:
    """Positions of the seeds for windows of ``size`` words: at most ``most`` masks, of the greatest weight at which every
    choice of the allowed replacements leaves one placement of one mask untouched."""
    errors = size - allowed(size)
    holes = list(combinations(range(size), errors))
    for weight in range(size - errors, 0, -1):
        covers = {}
        for span in range(weight, size + 1):
            for inner in combinations(range(1, span - 1), max(weight - 2, 0)) if weight > 1 else [()]:
                mask = (0, *inner, span - 1) if weight > 1 else (0,)
                if len(set(mask)) != weight:
                    continue
                hit = 0
                for i, hole in enumerate(holes):
                    if any(not {o + p for p in mask} & set(hole) for o in range(size - span + 1)):
                        hit |= 1 << i
                if hit:
                    covers.setdefault(hit, mask)
            if weight == 1:
                break
        chosen, left = [], (1 << len(holes)) - 1
        while left and len(chosen) < most and covers:
            best = max(covers, key=lambda c: ((c & left).bit_count(), [-p for p in covers[c]]))
            if not best & left:
                break
            chosen.append(covers[best])
            left &= ~best
        if not left:
            return tuple(chosen)
    raise AssertionError("a mask of one word always covers")


def allowed(size: int) -> int:
    """Equal words that a window of ``size`` words needs."""
    return -(-int(round(size * SIMILARITY * 1000)) // 1000)


def _seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Seed hash at every position where the mask fits."""
    n = len(hashes) - mask[-1]
    total = np.zeros(max(n, 0), np.uint64)
    for k, p in enumerate(mask):
        if n > 0:
            total += hashes[p: p + n] * np.uint64(2 * (0x9E3779B97F4A7C15 >> (k + 1)) + 1)
    return mix(total)


class Items:
    """Seeds of benchmark items, by size of window and mask: sorted hashes with the item and position of each."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        data, offsets = joined(pa.array(texts, pa.binary()))
        low = LOWER[data]
        starts, ends, first = words(low, offsets)
        hashes = word_hashes(low, starts, ends)
        self.ids, self.words = ids, [hashes[a:b] for a, b in zip(first, first[1:])]
        found: dict[tuple[int, tuple], list[tuple]] = {}
        for item, own in enumerate(self.words):
            if len(own):
                size = min(WINDOW, len(own))
                for mask in masks(size):
                    seeds = _seeds(own, mask)
                    found.setdefault((size, mask), []).append((seeds, np.full(len(seeds), item), np.arange(len(seeds))))
        self.seeds = {}
        for key, parts in found.items():
            seeds, item, place = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(seeds, kind="stable")
            table = np.zeros(1 << 18, bool)
            table[(seeds >> np.uint64(46)).astype(np.int64)] = True
            self.seeds[key] = (seeds[order], item[order], place[order], table)

    def search(self, texts: pa.Array) -> list[list[tuple[int, int, int, int]]]:
        """For each text the (item, first word, words, equal words) of its best verified stretch, one for each item."""
        data, offsets = joined(texts)
        low = LOWER[data]
        starts, ends, first = words(low, offsets)
        hashes = word_hashes(low, starts, ends)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        diagonals: set[tuple[int, int, int, int]] = set()
        for (size, mask), (seeds, item, place, table) in self.seeds.items():
            here = _seeds(hashes, mask)
            at = np.flatnonzero(table[(here >> np.uint64(46)).astype(np.int64)])
            at = at[owner[at] == owner[at + mask[-1]]] if len(at) else at
            low_, high = np.searchsorted(seeds, here[at], "left"), np.searchsorted(seeds, here[at], "right")
            counts = high - low_
            at, low_, counts = at[counts > 0], low_[counts > 0], counts[counts > 0]
            rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            which = np.repeat(low_, counts) + rank
            at = np.repeat(at, counts)
            diagonals.update(zip(owner[at].tolist(), item[which].tolist(), (at - place[which]).tolist(), [size] * len(at)))
        found: list[dict[int, tuple]] = [{} for _ in range(len(texts))]
        for doc, item, shift, size in diagonals:
            own = self.words[item]
            a, b = max(shift, int(first[doc])), min(shift + len(own), int(first[doc + 1]))
            if b - a < size:
                continue
            equal = np.concatenate([[0], np.cumsum(hashes[a:b] == own[a - shift: b - shift])])
            sums = equal[size:] - equal[:-size]
            good = np.flatnonzero(sums >= allowed(size))
            if len(good):
                start, stop = int(good[0]), int(good[-1]) + size
                best = (stop - start, int(equal[stop] - equal[start]), -(a + start - int(first[doc])))
                if item not in found[doc] or best > found[doc][item]:
                    found[doc][item] = best
        return [sorted((item, -s, n, e) for item, (n, e, s) in f.items()) for f in found]


def _search(shared):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in stream:
            found = items.search(batch["text"])
            columns = [pa.array([[m[k] for m in f] for f in found], pa.list_(pa.int64())) for k in range(4)]
            columns[0] = pa.array([[items.ids[m[0]] for m in f] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], *columns], names=["doc_id", "tie", "items", "starts", "lengths", "equal"])

    return run


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_bytes``: what the driver holds and broadcasts is one block."""
    texts = benchmark.select(F.col(id_col).cast("long").alias("item_id"), body(text_col).alias("text")).where(F.length("text") > 0)
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).dropDuplicates(["item_id", "text"]).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in rows], [bytes(r["text"]) for r in rows])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, contaminated, items, starts, lengths, equal of every row of ``docs``.

    ``items`` are the ids of the items found; starts and lengths tell the stretch in words of the document, ``equal`` the
    words of it that agree. Words are separated by white space and compared with A-Z in lower case. Null and empty texts
    have no words and are clean, as are all documents when the benchmark is empty; items without words are never found.
    Only the named columns are read. A benchmark over ``block_bytes`` is searched for block by block.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text")).withColumn("tie", F.xxhash64("text")).select("doc_id", "tie", "text")
    passes = [texts.mapInArrow(_search(spark.sparkContext.broadcast(i)), ROW) for i in blocks(benchmark, item_col, item_text, block_bytes)]
    lists = ["items", "starts", "lengths", "equal"]
    found = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            found = found.unionByName(more)
        found = found.groupBy("doc_id", "tie").agg(
            *(F.flatten(F.collect_list(c)).alias(c) for c in lists), F.count(F.lit(1)).alias("n")
        )
        # rows that repeat a document are as many as in each pass, and have its matches as often
        times = (F.col("n") / len(passes)).cast("int")
        own = F.array_sort(F.array_distinct(F.arrays_zip(*lists)))
        found = found.select("doc_id", own.alias("own"), F.explode(F.sequence(F.lit(1), times)).alias("t")).select(
            "doc_id", *(F.col("own").getField(c).alias(c) for c in lists)
        )
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), *lists)
