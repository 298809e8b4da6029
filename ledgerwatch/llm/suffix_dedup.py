"""Suffix-array dedup: bytes covered by strings that also start in an earlier document.

1. Documents are written in chunks to the shared folder.
2. Every string of LENGTH bytes has an anchor, the least hash among its SEED-byte substrings, so equal strings have equal
   anchors wherever they stand. Chunks send their distinct anchors to buckets and hear which occur in other chunks too.
3. Strings whose anchor is shared go to the bucket of the anchor, those that follow each other in one record. Anchors of
   very many documents are split further: their strings go one by one to the buckets of their own hashes. Equal records of
   a chunk are sent once, with their smallest and largest document.
4. A bucket sorts the suffixes that begin at its strings (multikey quicksort, then blind tries), takes the smallest
   document of each group that agrees in LENGTH bytes, and tells each chunk that has a larger one.
5. Chunks mark the covered bytes.

What is sent grows with the distinct strings of chunks, not with their copies: a passage that stands in every document is
sent once by a chunk and heard of once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import (
    SENT, SharedFile, body, folder, joined, materialize, mix, open_shared, pack, partitions, prepare, sent_rows as _rows, unpack,
)
from ledgerwatch.llm.suffixes import classes

LENGTH, SEED = 50, 24
#: Bytes of a chunk (one longer document is a chunk of its own), and positions looked at at once.
CHUNK, PIECE = 4 << 20, 1 << 16
#: Strings of an anchor in more documents than this are dealt out one by one.
CROWDED = 1000
#: Strings in a record at most.
RECORD = 64
#: Strings that a task sorts at once.
STRINGS = 400_000
#: Order of a null id among ids: after all others.
NO_ID = (1 << 63) - 1
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _chunks(base: str, chunk_bytes: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = None, []
        for batch in stream:
            ids = np.array([NO_ID if i is None else i for i in batch[0].to_pylist()], np.int64)
            data, offsets = joined(batch[1])
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk_bytes, "right")) - 1)
                b = min(b, len(ids))
                if out is None:
                    out = SharedFile(base, "chunks")
                block = pack(ids[a:b], offsets[a: b + 1] - offsets[a], data[offsets[a]: offsets[b]])
                rows.append(("chunk", uuid.uuid4().int >> 66, 0, np.array([out.write(block), len(block)], np.int64)))
                a = b
        if out is not None:
            name = out.close().encode()
            yield _rows([(k, p, s, b.tobytes() + name) for k, p, s, b in rows])

    return run


def load(base: str, block: bytes) -> list[np.ndarray]:
    """ids, offsets and bytes of a chunk."""
    at, size = np.frombuffer(block, np.int64, 2)
    with open_shared(base, block[16:].decode()) as f:
        return unpack(f.read_at(int(size), int(at)))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` values in a row."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have:]) if have < width else values


def anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of the string at each place; as many as strings fit in."""
    h, have, factor = _SPREAD[data], 1, 0x9E3779B97F4A7C15
    powers = {1: h}
    while 2 * have <= SEED:  # hashes of 2, 4, 8 ... bytes
        h = h[:-have] * np.uint64(pow(factor, have, 1 << 64)) + h[have:]
        have *= 2
        powers[have] = h
    total, used = powers[have], have
    for size in sorted(powers, reverse=True)[1:]:
        if used + size <= SEED:
            n = len(total) - size
            total = total[:n] * np.uint64(pow(factor, size, 1 << 64)) + powers[size][used: used + n]
            used += size
    total = total ^ (total >> np.uint64(29))
    total = total * np.uint64(0xBF58476D1CE4E5B9)
    return _least(total ^ (total >> np.uint64(32)), LENGTH - SEED + 1)


def records(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first string, strings, anchor, and number of the document.

    A run ends where its document does, and after RECORD strings.
    """
    starts, counts, values, owners = [], [], [], []
    last = len(data) - LENGTH + 1
    for a in range(0, max(last, 0), PIECE):
        b = min(a + PIECE, last)
        found = anchors(data[a: b + LENGTH - 1])
        place = np.arange(a, b)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, a, b)))
        good = place + LENGTH <= offsets[owner + 1]
        new = np.ones(b - a, bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]) | (good[1:] != good[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, b - a))
        keep = good[at]
        at, size = at[keep], size[keep]
        parts = -(-size // RECORD)
        rank = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts.append(np.repeat(at, parts) + rank * RECORD + a)
        counts.append(np.minimum(np.repeat(size, parts) - rank * RECORD, RECORD))
        values.append(np.repeat(mix(found[at]), parts))  # least values are small ones: spread them over the buckets
        owners.append(np.repeat(owner[at], parts))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty.astype(t) for x, t in ((starts, np.int64), (counts, np.int64), (values, np.uint64), (owners, np.int64)))


def bucket_edges(count: int) -> np.ndarray:
    """First value of each of ``count`` equal ranges of 64-bit values, but that of the first."""
    return np.array([(k << 64) // count for k in range(1, count)], np.uint64)


def _anchor_counts(values: np.ndarray, owners: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors in order, and the number of distinct ids that have each."""
    _, number = np.unique(ids, return_inverse=True)
    own = number[owners]
    order = np.lexsort((own, values))
    values, own = values[order], own[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    other = new.copy()
    other[1:] |= own[1:] != own[:-1]
    at = np.flatnonzero(new)
    return values[at], np.add.reduceat(other.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)


def _send_anchors(base: str, count: int):
    edges = bucket_edges(count)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for chunk, block in zip(batch["place"].to_pylist(), batch["block"].to_pylist()):
                ids, offsets, data = load(base, block)
                _, _, values, owners = records(data, offsets)
                values, docs = _anchor_counts(values, owners, ids)
                cut = [0, *np.searchsorted(values, edges), len(values)]
                # forty bits are enough to look for partners; a chance agreement is sorted out with the strings
                short = values >> np.uint64(24)
                yield _rows([
                    ("anchors", b, chunk, pack(np.diff(short[cut[b]: cut[b + 1]], prepend=np.uint64(0)), np.minimum(docs[cut[b]: cut[b + 1]], 65535).astype(np.uint16)))
                    for b in range(count) if cut[b + 1] > cut[b]
                ])

    return run


def _reply_anchors(table: pa.Table, most: int) -> pa.Table:
    """For each chunk of a bucket: which of the anchors it sent are shared, and which of those are crowded."""
    sources, parts = table["source"].to_pylist(), [unpack(b) for b in table["block"].to_pylist()]
    values = [np.cumsum(v, dtype=np.uint64) for v, _ in parts]
    together, docs = np.concatenate(values), np.concatenate([d for _, d in parts]).astype(np.int64)
    some, back = np.unique(together, return_inverse=True)
    total = np.bincount(back, docs, minlength=len(some))
    bits = ((total > 1).astype(np.uint8) + (total > most))[back]
    ends = np.cumsum([len(v) for v in values])
    bucket = table["place"][0].as_py()
    return pa.Table.from_batches([_rows([("shared", s, bucket, pack(bits[e - len(v): e])) for s, v, e in zip(sources, values, ends) if bits[e - len(v): e].any()])])


class Candidates:
    """A chunk's records of strings whose anchors are shared, and the distinct ones that it sends to each bucket."""

    def __init__(self, base: str, count: int, block: bytes, replies: dict[int, bytes]):
        self.ids, self.offsets, self.data = load(base, block)
        starts, sizes, values, owners = records(self.data, self.offsets)
        own, _ = _anchor_counts(values, owners, self.ids)
        cut = [0, *np.searchsorted(own, bucket_edges(count)), len(own)]
        state = np.zeros(len(own), np.uint8)
        for b, reply in replies.items():
            state[cut[b]: cut[b + 1]] = unpack(reply)[0]
        mine = state[np.searchsorted(own, values)]
        plain, crowded = np.flatnonzero(mine == 1), np.flatnonzero(mine == 2)
        rank = np.arange(sizes[crowded].sum()) - np.repeat(np.cumsum(sizes[crowded]) - sizes[crowded], sizes[crowded])
        self.starts = np.concatenate([starts[plain], np.repeat(starts[crowded], sizes[crowded]) + rank])
        self.sizes = np.concatenate([sizes[plain], np.ones(len(rank), np.int64)])
        self.owners = np.concatenate([owners[plain], np.repeat(owners[crowded], sizes[crowded])])
        self.hashes = self._hashes()
        route = np.concatenate([values[plain], self.hashes[len(plain):]])
        # equal records: same route, bytes and length
        key = mix(self.hashes + mix(self.sizes.astype(np.uint64)))
        order = np.lexsort((key, route))
        route, key = route[order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (route[1:] != route[:-1]) | (key[1:] != key[:-1])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.first = order[at]
        docs = self.ids[self.owners][order]
        self.least = np.minimum.reduceat(docs, at) if len(at) else docs
        self.most = np.maximum.reduceat(docs, at) if len(at) else docs
        self.route = route[at]
        self.cut = [0, *np.searchsorted(self.route, bucket_edges(count)), len(self.route)]

    def _hashes(self) -> np.ndarray:
        """A hash of each record's bytes, by pieces of the chunk so that memory follows the piece."""
        found = np.zeros(len(self.starts), np.uint64)
        order = np.argsort(self.starts, kind="stable")
        places = self.starts[order]
        up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(PIECE + LENGTH + RECORD, 0x9E3779B97F4A7C15, np.uint64)]))
        down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)]))
        for a in range(0, len(self.data), PIECE):
            which = order[slice(*np.searchsorted(places, [a, a + PIECE]))]
            if len(which):
                data = self.data[a: a + PIECE + LENGTH + RECORD]
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(_SPREAD[data] * up[: len(data)], out=sums[1:])
                s = self.starts[which] - a
                found[which] = mix((sums[s + self.sizes[which] + LENGTH - 1] - sums[s]) * down[s])
        return found

    def sent(self, b: int) -> bytes | None:
        """Routes, lengths, smallest and largest documents, and bytes of the distinct records for a bucket."""
        a, e = self.cut[b], self.cut[b + 1]
        if a == e:
            return None
        rows = self.first[a:e]
        length = self.sizes[rows] + LENGTH - 1
        at = np.repeat(self.starts[rows] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        return pack(self.route[a:e], self.sizes[rows].astype(np.uint8), self.least[a:e], self.most[a:e], self.data[at])


def _by_kind(table: pa.Table) -> tuple[bytes | None, dict[str, dict[int, bytes]]]:
    block, found = None, {"shared": {}, "least": {}}
    for kind, source, raw in zip(table["kind"].to_pylist(), table["source"].to_pylist(), table["block"].to_pylist()):
        if kind == "chunk":
            block = raw
        else:
            found[kind][source] = raw
    return block, found


def _send_records(base: str, count: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, found = _by_kind(table)
        own = Candidates(base, count, block, found["shared"])
        return pa.Table.from_batches([_rows([("records", b, key[0].as_py(), raw) for b in range(count) if (raw := own.sent(b))])])

    return run


def _least_documents(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The smallest document of every string of the chunks' records, all of the same routes."""
    route, sizes, least, _, data = (np.concatenate(c) for c in zip(*parts))
    sizes = sizes.astype(np.int64)
    length = sizes + LENGTH - 1
    starts = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(starts, length)
    sums = np.add.reduceat(mix(_SPREAD[data] + place.astype(np.uint64)), starts)
    data = np.concatenate([data, np.zeros(LENGTH + 16, np.uint8)])
    # one record stands for all that are the same
    _, one, same = np.unique(mix(sums + mix(length.astype(np.uint64)) + route), return_index=True, return_inverse=True)
    lowest = np.full(len(one), NO_ID)
    np.minimum.at(lowest, same, least)
    # strings of a route with a single record agree with none but themselves
    _, group = np.unique(route[one], return_inverse=True)
    mixed = np.bincount(group)[group] > 1
    strings = sizes[one]
    begin = np.cumsum(strings) - strings
    answer = np.repeat(lowest, strings)
    chosen = np.flatnonzero(np.repeat(mixed, strings))
    if len(chosen):
        at = (np.repeat(starts[one] - begin, strings) + np.arange(strings.sum()))[chosen]
        number = classes(data, at, LENGTH)
        best = np.full(len(chosen), NO_ID)
        np.minimum.at(best, number, answer[chosen])
        answer[chosen] = best[number]
    told, end = [], 0
    for part in parts:
        mine = same[end: end + len(part[0])]
        end += len(part[0])
        many = strings[mine]
        told.append(answer[np.repeat(begin[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())])
    return told


def _sort_bucket(table: pa.Table) -> pa.Table:
    """The smallest document of every string of a bucket, told to the chunks that have a larger one.

    Routes are independent of each other, so a bucket is sorted range by range of them, STRINGS strings or so at a time.
    """
    sources, parts = table["source"].to_pylist(), [unpack(b) for b in table["block"].to_pylist()]
    bucket = table["place"][0].as_py()
    route = np.sort(np.concatenate([p[0] for p in parts]))
    total = sum(int(p[1].sum(dtype=np.int64)) for p in parts)
    step = max(1, len(route) * STRINGS // max(total, 1))
    cuts = np.unique(route[step::step])
    told: list[list[tuple]] = [[] for _ in parts]
    borders = []
    for p in parts:
        rows = np.concatenate([[0], np.searchsorted(p[0], cuts), [len(p[0])]])
        ends = np.concatenate([[0], np.cumsum(p[1].astype(np.int64) + LENGTH - 1)])
        borders.append((rows, ends[rows]))
    for k in range(len(cuts) + 1):
        some = [i for i, (rows, _) in enumerate(borders) if rows[k + 1] > rows[k]]
        if some:
            cut = [[*(c[borders[i][0][k]: borders[i][0][k + 1]] for c in parts[i][:4]), parts[i][4][borders[i][1][k]: borders[i][1][k + 1]]] for i in some]
            for i, c, answer in zip(some, cut, _least_documents(cut)):
                new = np.ones(len(answer), bool)
                new[1:] = answer[1:] != answer[:-1]
                where = np.flatnonzero(new)
                useful = bool((answer < np.repeat(c[3], c[1].astype(np.int64))).any())
                told[i].append((len(answer), where, answer[where], useful))
    rows = []
    for source, answers in zip(sources, told):
        if any(a[3] for a in answers):
            before = np.concatenate([[0], np.cumsum([a[0] for a in answers])])
            rows.append(("least", source, bucket, pack(np.concatenate([a[1] + b for a, b in zip(answers, before)]).astype(np.uint32), np.concatenate([a[2] for a in answers]), before[-1:])))
    return pa.Table.from_batches([_rows(rows)])


def _mark(base: str, count: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, found = _by_kind(table)
        own = Candidates(base, count, block, found["shared"])
        change = np.zeros(len(own.data) + 1, np.int32)
        strings = own.sizes[own.first]
        begin = np.cumsum(strings) - strings
        told = np.full(strings.sum(), NO_ID)
        for b, raw in found["least"].items():
            where, values, total = unpack(raw)
            a = begin[own.cut[b]]
            told[a: a + int(total[0])] = np.repeat(values, np.diff(np.append(where, total[0])))
        size = own.sizes
        for a in range(0, len(size), PIECE):
            part = slice(a, a + PIECE)
            rank = np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            earlier = told[np.repeat(begin[own.number[part]], size[part]) + rank] < np.repeat(own.ids[own.owners[part]], size[part])
            at = (np.repeat(own.starts[part], size[part]) + rank)[earlier]
            np.add.at(change, at, 1)
            np.add.at(change, at + LENGTH, -1)
        covered = np.cumsum(change[:-1]) > 0
        rows = []
        for i, doc in enumerate(own.ids):
            a, e = own.offsets[i], own.offsets[i + 1]
            mine = covered[a:e]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            kept = own.data[a:e][~mine] if len(edge) else own.data[a:e]
            rows.append((None if doc == NO_ID else int(doc), int(e - a), int(mine.sum()), len(edge) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), edge[::2].tolist(), edge[1::2].tolist()))
        types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends of every row of ``docs``.

    A byte of a text (UTF-8) is removed if a string of LENGTH bytes covers it that also starts in a row with a smaller id;
    all strings are judged on the input. Rows that share an id remove nothing from each other; a null id ranks after all
    others. Null texts are empty, texts of less than LENGTH bytes stay whole. ``starts`` and ``ends`` are the byte ranges
    of the maximal removed runs. ``chunk_bytes`` and ``crowded`` (the documents from which on an anchor's strings are dealt
    out one by one) change how the work is cut up, not the result. Only the two named columns are read. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    tasks = partitions(spark)
    base, count = folder(spark, "suffix-chunks"), 2 * tasks
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    chunks = materialize(texts.mapInArrow(_chunks(base, chunk_bytes), SENT), "suffix-manifest")

    def reply(bucket: pa.Table) -> pa.Table:
        return _reply_anchors(bucket, crowded)

    def by_place(rows: DataFrame):
        """Groups of a chunk or bucket; the rows are few and the work behind them large, so tasks aren't merged."""
        return rows.repartition(tasks, "place").groupBy("place")

    sent = by_place(chunks.repartition(tasks).mapInArrow(_send_anchors(base, count), SENT))
    told = chunks.unionByName(materialize(sent.applyInArrow(reply, SENT), "suffix-shared"))
    records_ = by_place(told).applyInArrow(_send_records(base, count), SENT)
    least = materialize(by_place(records_).applyInArrow(_sort_bucket, SENT), "suffix-least")
    return by_place(told.unionByName(least)).applyInArrow(_mark(base, count), REMOVED)
