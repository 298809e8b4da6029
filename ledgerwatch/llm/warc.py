"""WARC archives with a two-level capture index.

Pages are ordered by their key (host labels reversed, then the path), so the records of a range of keys stand together in
one archive. An index file holds the sorted captures of an archive in compressed blocks; a sparse directory has the first
key, place and size of each block. A lookup finds the archive by its first key, the block by binary search in the
directory, the capture by binary search in the block, and then reads the record's range of bytes.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import SharedFile, folder, materialize, open_shared, partitions, prepare

#: Payloads of fewer bytes are always written whole.
REVISIT_BYTES = 100
#: Captures in an index block.
BLOCK = 256
DIRECTORY = "part int, first_key string, archive string, index string, at long, size long, captures long"
CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_CAPTURE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort key of a URL: lower-cased host with its labels reversed and joined by commas, ")" and the rest."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#:]*)", 1))
    rest = F.regexp_replace(bare, r"^[^/?#:]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, key, payload, payload_digest, record_type, refers_to of every page.

    Of equal payloads of REVISIT_BYTES and more, that with the smallest page_id is the response and the others revisit
    it; a null id is never referred to while another is there. Rows that repeat the response's id are responses too.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    full = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"),
    )
    firsts = materialize(
        full.where(F.length("payload") >= REVISIT_BYTES).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
        .select(F.col("payload_digest").alias("digest"), "first_id"),
        "warc-firsts",
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return full.join(firsts, F.col("payload_digest") == F.col("digest"), "left").select(
        "page_id", "url", url_key(F.col("url")).alias("key"), "payload_digest", F.length("payload").cast("long").alias("payload_bytes"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),  # a revisit stores none
    )


def record(page_id, url, digest, size, kind, refers_to, payload) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {json.dumps(url)[1:-1]}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = payload or b""
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises when a payload doesn't match its digest."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    found = dict(x.split(": ", 1) for x in lines[1:])
    size = int(found["Content-Length"])
    payload = rest[:size]
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is broken")
    if found["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != found["WARC-Payload-Digest"].removeprefix("sha256:"):
        raise ValueError("a payload does not match its digest")
    return found, payload


def _row(head: dict[str, str], payload: bytes) -> tuple:
    number = lambda x: int(x) if x else None
    url = head.get("WARC-Target-URI")
    response = head["WARC-Type"] == "response"
    return (
        number(head["WARC-Record-ID"][10:-1]), None if url is None else json.loads(f'"{url}"'), len(payload) if response else int(head["X-Payload-Length"]),
        hashlib.sha256(payload).hexdigest() if response else head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"],
        None if response else number(head["WARC-Refers-To"][10:-1]),
    )


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_CAPTURE)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CAPTURE.types)], schema=_CAPTURE)


def _write(base: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = index = None
        lines: list[str] = []
        found: list[tuple] = []

        def close_block() -> None:
            block = zlib.compress("\n".join(lines).encode())
            found.append((json.loads(lines[0])[0], index.write(block), len(block), len(lines)))
            lines.clear()

        for batch in stream:
            for page_id, url, key, digest, size, kind, refers, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    archive, index = SharedFile(base, "archive.warc.gz"), SharedFile(base, "captures")
                raw = record(page_id, url, digest, size, kind, refers, payload)
                lines.append(json.dumps([key, page_id, archive.write(raw), len(raw)]))
                if len(lines) == BLOCK:
                    close_block()
        if archive is not None:
            if lines:
                close_block()
            names, part = (archive.close(), index.close()), TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(found), pa.int32()), pa.array([x[0] for x in found]), pa.array([names[0]] * len(found)), pa.array([names[1]] * len(found)),
                    *(pa.array([x[i] for x in found], pa.int64()) for i in (1, 2, 3)),
                ],
                names=["part", "first_key", "archive", "index", "at", "size", "captures"],
            )

    return run


def write_archives(pages: DataFrame, base: str) -> DataFrame:
    """Write archives and index blocks below ``base``; the directory of the blocks.

    ``pages`` needs page_id, url and html; other columns are not read. Null html is an empty payload, a null or empty url
    has the key ")". Captures of one key are ordered by page_id, and may fill many archives.
    """
    spark = prepare(pages.sparkSession)
    order = ["key", "page_id"]
    marked = mark_revisits(pages).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = marked.select("page_id", "url", "key", "payload_digest", "payload_bytes", "record_type", "refers_to", "payload")
    return materialize(rows.mapInArrow(_write(base), DIRECTORY), "warc-directory")


def _block(file, at: int, size: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(file.read_at(size, at)).decode().split("\n")]


def _scan(base: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for archive, index, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                with open_shared(base, index) as f:
                    captures = _block(f, at, size)
                with open_shared(base, archive) as f:
                    yield _captures([_row(*parse(f.read_at(n, start))) for _, _, start, n in captures])

    return run


def read_archives(directory: DataFrame, base: str) -> DataFrame:
    """All captures, read block by block through the index."""
    blocks = directory.select("archive", "index", "at", "size").repartition(partitions(directory.sparkSession))
    return blocks.mapInArrow(_scan(base), CAPTURE)


def _find(base: str):
    def run(key: tuple, urls: pa.Table, blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by([("first_key", "ascending"), ("at", "ascending")]).to_pydict()
        found: list[tuple] = []
        if blocks["archive"] and urls.num_rows:
            with open_shared(base, blocks["index"][0]) as index, open_shared(base, blocks["archive"][0]) as archive:
                for wanted in sorted(set(urls["key"].to_pylist())):
                    # captures of one key may begin at the end of a block and go on through the next ones
                    first = max(0, bisect_left(blocks["first_key"], wanted) - 1)
                    for b in range(first, bisect_right(blocks["first_key"], wanted)):
                        captures = _block(index, blocks["at"][b], blocks["size"][b])
                        keys = [c[0] for c in captures]
                        for _, _, start, n in captures[bisect_left(keys, wanted): bisect_right(keys, wanted)]:
                            found.append(_row(*parse(archive.read_at(n, start))))
        return pa.Table.from_batches([_captures(found)])

    return run


def lookup(directory: DataFrame, base: str, urls: DataFrame) -> DataFrame:
    """The captures of the distinct urls of ``urls`` (column url).

    Archives whose range of keys holds a wanted key are found by a binary search among the archives' bounds (one row per
    archive); their directories and the wanted keys are then grouped by archive, where the binary searches and the range
    reads take place.
    """
    spark = directory.sparkSession
    starts = [(r["first"], r["part"]) for r in directory.groupBy("part").agg(F.min("first_key").alias("first")).collect()]
    starts.sort()
    firsts, parts = [x for x, _ in starts], [p for _, p in starts]

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [
                (k, parts[i]) for k in batch["key"].to_pylist() for i in range(max(0, bisect_left(firsts, k) - 1), bisect_right(firsts, k))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["key", "part"])

    prepare(spark)
    wanted = urls.select(url_key(F.col("url")).alias("key")).distinct().mapInArrow(place, "key string, part int")
    return wanted.groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(_find(base), CAPTURE)


def warc(pages: DataFrame) -> DataFrame:
    base = folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, base), base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
