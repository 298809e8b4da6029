"""Exact dedup by an extendible-hash index in shared files.

A text's key is a 64-bit hash of its bytes without white space. A directory maps the first bits of a key to a bucket;
while a bucket holds more texts than its capacity it is split and, where its depth reaches the directory's, the
directory doubles. Owner tasks get the buckets, chain the texts of one key, compare their bytes, and write each bucket to
a file in the shared folder. The decisions are read back from those files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import BATCH_BYTES, SharedFile, body, folder, materialize, open_shared, partitions, prepare

DELETED = b"\x20\x09\x0a\x0b\x0c\x0d"
MEMBER = "doc_id long, key long, digest binary, n_chars long"
ENTRY = "key long, bucket long, body binary, best_chars long, best_id long, size long"
FOUND = "bucket long, key long, chain int, digest binary, keep_id long, group_size long"
_FOUND = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("chain", pa.int32()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
#: Order of a null id among ids: after all others.
NO_ID = (1 << 63) - 1


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, int, bytes]]:
    for doc, text, n in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist()):
        bare = text.translate(None, DELETED)
        yield doc, n, xxhash.xxh64_intdigest(bare), bare


def _members(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        ids, keys, digests, chars = [], [], [], []
        for doc, n, key, bare in _rows(batch):
            ids.append(doc)
            keys.append(key)
            digests.append(hashlib.sha256(bare).digest())
            chars.append(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(chars, pa.int64())],
            names=["doc_id", "key", "digest", "n_chars"],
        )


class Directory:
    """The directory of an extendible hash: ``slots[first depth bits of a key]`` is a bucket."""

    def __init__(self):
        self.depth, self.slots, self.local = 0, np.zeros(1, np.int64), [0]

    def split(self, bucket: int) -> None:
        if self.local[bucket] == self.depth:
            self.slots = np.repeat(self.slots, 2)
            self.depth += 1
        mine = np.flatnonzero(self.slots == bucket)
        self.local[bucket] += 1
        self.local.append(self.local[bucket])
        self.slots[mine[len(mine) // 2:]] = len(self.local) - 1

    def buckets(self, keys: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(keys), np.int64)
        return self.slots[(keys >> np.uint64(64 - self.depth)).astype(np.int64)]


def build_directory(members: DataFrame, capacity: int, max_depth: int = 20) -> Directory:
    """Split overfull buckets level by level; each level is one count of distinct texts per bucket prefix.

    The counts that reach the driver are at most one per directory slot (2^max_depth at the very most). Keys are spread
    evenly by the hash, and copies of a text count once, so buckets of that depth hold capacity texts each.
    """
    spark, directory = members.sparkSession, Directory()
    keys = members.select("key").distinct()
    total = keys.count()
    depth = min(max_depth, max(0, int(total / capacity)).bit_length() + 3)
    counts = np.zeros(1 << depth, np.int64)
    if depth:
        for row in keys.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("slot")).count().collect():
            counts[row["slot"]] = row["count"]
    else:
        counts[0] = total
    todo = [0]
    while todo:
        bucket = todo.pop()
        mine = np.flatnonzero(directory.slots == bucket) << (depth - directory.depth)
        held = sum(int(counts[i: i + (1 << (depth - directory.depth))].sum()) for i in mine)
        if held > capacity and directory.local[bucket] < depth:
            directory.split(bucket)
            todo += [bucket, len(directory.local) - 1]
    return directory


def _entries(directory: Directory):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.array([k for k, chain in held.items() for _ in chain], np.uint64)
            rows = [e for chain in held.values() for e in chain]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.view(np.int64)), pa.array(directory.buckets(keys)), pa.array([e[0] for e in rows], pa.binary()),
                    pa.array([e[1] for e in rows], pa.int64()), pa.array([-e[2] for e in rows], pa.int64()), pa.array([e[3] for e in rows], pa.int64()),
                ],
                names=["key", "bucket", "body", "best_chars", "best_id", "size"],
            )

        for batch in stream:
            for doc, n, key, bare in _rows(batch):
                size += _add(held.setdefault(key, []), bare, n, NO_ID if doc is None else doc, 1)
            if size > BATCH_BYTES:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return run


def _add(chain: list[list], bare: bytes, chars: int, doc: int, rows: int) -> int:
    """Find the text in the chain of its key by its bytes, or append it; the bytes added."""
    for link in chain:
        if link[0] == bare:
            if (chars, -doc) > (link[1], link[2]):
                link[1:3] = chars, -doc
            link[3] += rows
            return 0
    chain.append([bare, chars, -doc, rows])
    return len(bare) + 200


def _owner(base: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by bucket and key; only the chain of one key is held."""
        out, sink, rows, last = None, None, [], None
        written = 0

        def write() -> None:
            nonlocal rows, written
            if rows:
                sink.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND))
                written += len(rows)
                rows = []

        chain: list[list] = []

        def close_key() -> None:
            for i, (bare, _, doc, n) in enumerate(chain):
                rows.append((last[0], last[1], i, hashlib.sha256(bare).digest(), None if -doc == NO_ID else -doc, n))

        for batch in stream:
            for key, bucket, bare, chars, doc, n in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = SharedFile(base, "buckets")
                    sink = pa.ipc.new_stream(out.out, _FOUND, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                if (bucket, key) != last:
                    close_key()
                    chain, last = [], (bucket, key)
                    if len(rows) >= 10_000:
                        write()
                _add(chain, bare, chars, doc, n)
        if out is not None:
            close_key()
            write()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([out.close()]), pa.array([written], pa.int64())], names=["file", "entries"])

    return run


def _read(base: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name in batch["file"].to_pylist():
                with open_shared(base, name) as file, pa.ipc.open_stream(file) as index:
                    for part in index:
                        yield part

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (blank, tab, line feed, vertical tab, form feed, carriage return).
    The row with the most code points stays, then the smallest id. Null and empty texts are equal to each other. A null id
    ranks after all others. Rows that repeat both id and text count in group_size and stay or go together. ``capacity``
    is the number of texts per bucket. Only the two named columns are read. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"))
    members = materialize(texts.mapInArrow(_members, MEMBER), "exact-members")
    directory = build_directory(members, capacity)
    base = folder(spark, "exact-index")
    manifest = materialize(
        texts.mapInArrow(_entries(directory), ENTRY)
        .repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "key")
        .mapInArrow(_owner(base), "file string, entries long"),
        "exact-manifest",
    )
    index = manifest.repartition(partitions(spark)).mapInArrow(_read(base), FOUND)
    copies = index.where("group_size > 1").select("key", "digest", "keep_id", "group_size")
    found = members.join(copies, ["key", "digest"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
