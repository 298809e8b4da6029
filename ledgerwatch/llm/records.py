"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A record is framed as in TFRecord files: length (uint64), masked CRC-32C of the length bytes, payload, masked CRC-32C of
the payload; all little-endian. A payload is a header (id, whether there is one, bytes per token, tokens) and the ids in
two or four bytes each. The index has a row per record: id, offset of the record, tokens before it in the file.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.common import SharedFile, body, folder, materialize, open_shared, partitions, prepare

HEADER = np.dtype([("id", "<i8"), ("has_id", "u1"), ("width", "u1"), ("tokens", "<u4")])
FRAME = np.dtype([("length", "<u8"), ("check", "<u4")])
INDEX = np.dtype([("id", "<i8"), ("offset", "<u8"), ("before", "<u8")])
MANIFEST = "part int, file string, index string, records long, tokens long"
ROWS = "doc_id long, part int, before long, n_tokens long, ids_crc32 long"
#: Records per read task row.
BLOCK = 512
#: Words whose ids are remembered by a worker; the ids of others are looked up again in each batch.
REMEMBERED = 600_000

#: Fixed values of CRC-32C (reflected polynomial) and of the mask.
POLYNOMIAL, MASK = 0x82F63B78, np.uint32(0xA282EAD8)
STEP = 64


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table, and the tables that carry a checksum over STEP zero bytes (one for each of its bytes)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    over = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    for _ in range(STEP):
        over = table[over & 0xFF] ^ (over >> np.uint32(8))
    return table, over.reshape(4, 256)


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of ranges of at least four bytes: blocks of STEP bytes at once, then the blocks of each range in turn."""
    table, over = _tables()
    blocks = -(-lengths // STEP)
    first = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.zeros(int(first[-1]) * STEP, np.uint8)
    to = first[1:] * STEP - lengths
    for i in range(len(starts)):  # zero bytes in front leave a checksum that starts at 0 as it is
        padded[to[i]: to[i] + lengths[i]] = data[starts[i]: starts[i] + lengths[i]]
    for k in range(4):  # an all-ones start is the same as inverting the first four bytes
        padded[to + k] ^= 0xFF
    crc = np.zeros(int(first[-1]), np.uint32)
    for column in np.ascontiguousarray(padded.reshape(-1, STEP).T):
        crc = table[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    total, order = np.zeros(len(starts), np.uint32), np.argsort(-blocks, kind="stable")
    sizes = -blocks[order]
    for k in range(int(blocks.max(initial=0))):
        live = order[: np.searchsorted(sizes, -k)]
        x = total[live]
        x = over[0][x & 0xFF] ^ over[1][(x >> 8) & 0xFF] ^ over[2][(x >> 16) & 0xFF] ^ over[3][x >> 24]
        total[live] = x ^ crc[first[live] + k]
    return ~total


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + MASK


#: A blank before something else than white space always begins a new word of the byte-level splitter.
_CUT = regex.compile(r"(?= \S)", regex.V1)
#: Texts that need this cut and not one before each blank: a blank before white space of any kind or at the end, or a zero.
_ODD = r" (?:[\s\v\x{1C}-\x{1F}\x{85}\x{180E}\pZ]|\z)|\x00"


def pieces(text: str) -> list[str]:
    """Parts of a text that a byte-level BPE tokenizer encodes independently of each other."""
    return [x for x in _CUT.split(text) if x]


#: Borders of words inside a piece: of letters with a line feed or a mark, and behind a single line feed. An apostrophe may
#: belong to the letters behind it and is left alone; of a longer white space the splitter takes the last one off.
_LETTER, _MARK = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF", r"!-&(-/:-@\[-`{-~"
_BORDER = re.compile(rf"(?<=[{_LETTER}])(?=[{_MARK}\n])|(?<=[{_MARK}])(?=[{_LETTER}\n])|(?<=[{_LETTER}{_MARK}]\n)(?=[{_LETTER}])")
#: Pieces that the library encodes as the lines of one text, and texts or single pieces of a call.
LINES, CALL = 500, 50


class Encoder:
    """Encodes texts with the tokenizers library; each distinct piece is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}

    def batch(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text. Arrow cuts the texts and tells the distinct pieces, which alone are looked up."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _ODD)
        plain = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), " ", "\x00 "), "\x00")
        other = pa.array([pieces(t) for t in texts.filter(odd).to_pylist()], plain.type)
        split = pa.concat_arrays([plain, other])
        place = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, distinct))
        missing = [i for i, x in enumerate(ids) if x is None]
        new = [distinct[i] for i in missing]
        learnt = self._learn(new)
        for i in missing:
            ids[i] = self.known[distinct[i]]
        if len(self.known) > REMEMBERED:
            for piece in learnt.union(new):
                del self.known[piece]
        joined = pa.array(ids, pa.large_binary()).take(words.indices)
        at = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[split.offsets.to_numpy()]
        data = memoryview(joined.buffers()[2] or b"")
        return [bytes(data[at[k]: at[k + 1]]) for k in place.tolist()]

    def _learn(self, new: list[str]) -> set[str]:
        """Remember the ids of new pieces; returns the words of them that were new too."""
        parts = {p: _BORDER.split(p) for p in new if not p[p[0] == " ":].isalpha()}
        bare = set(new).difference(parts).union(*parts.values()).difference(self.known)
        self._encode_words(list(bare))
        for p, some in parts.items():
            self.known[p] = b"".join([self.known[x] for x in some])
        return bare

    def _encode_words(self, todo: list[str]) -> None:
        """The ids of pieces. Those of letters or printable ASCII are encoded as lines, for much less than a call each.

        A line feed between such pieces is a word of its own to the splitter, and its token is in no word without one.
        """
        lines, others = [], []
        for p in todo:
            word = p[p[0] == " ":]
            (lines if word.isalpha() or (word.isascii() and word.isprintable() and word and " " not in word) else others).append(p)
        feed = self._encode(["\n"])[0]
        if len(feed) != 1:
            lines, others = [], todo
        size = self.type.itemsize
        for at in range(0, len(lines), LINES * CALL):
            some = [lines[k: k + LINES] for k in range(at, min(at + LINES * CALL, len(lines)), LINES)]
            for found, ids in zip(some, self._encode(["\n".join(x) for x in some])):
                raw, ends = ids.tobytes(), np.append(np.flatnonzero(ids == feed[0]), len(ids)) * size
                begin = 0
                for piece, end in zip(found, ends.tolist(), strict=True):
                    self.known[piece] = raw[begin:end]
                    begin = end + size
        for at in range(0, len(others), LINES * CALL):
            some = others[at: at + LINES * CALL]
            self.known.update(zip(some, (ids.tobytes() for ids in self._encode(some))))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def frame(ids: list[int | None], tokens: list[bytes], kind: np.dtype) -> tuple[bytes, np.ndarray]:
    """Framed records, and the offset of each (one more than records)."""
    lengths = np.array([len(t) for t in tokens], np.int64)
    head = np.zeros(len(tokens), HEADER)
    head["id"] = [0 if i is None else i for i in ids]
    head["has_id"] = [i is not None for i in ids]
    head["width"], head["tokens"] = kind.itemsize, lengths // kind.itemsize
    front = np.zeros(len(tokens), FRAME)
    front["length"] = lengths + HEADER.itemsize
    front["check"] = masked(crc32c(front["length"].copy().view(np.uint8), np.arange(len(tokens)) * 8, np.full(len(tokens), 8)))
    payload = b"".join(x for pair in zip((h.tobytes() for h in head), tokens) for x in pair)
    ends = np.cumsum(lengths + HEADER.itemsize)
    starts = ends - lengths - HEADER.itemsize
    check = masked(crc32c(np.frombuffer(payload, np.uint8), starts, ends - starts))
    out = b"".join(
        x for i in range(len(tokens)) for x in (front[i].tobytes(), payload[starts[i]: ends[i]], check[i].tobytes())
    )
    return out, np.concatenate([[0], np.cumsum(lengths + HEADER.itemsize + FRAME.itemsize + 4)])


def unframe(raw: bytes, offsets: np.ndarray) -> list[tuple[int | None, np.ndarray]]:
    """Ids and tokens of the records at ``offsets`` (one more than records); raises when a checksum is wrong."""
    data, n = np.frombuffer(raw, np.uint8), len(offsets) - 1
    if not n:
        return []
    starts, lengths = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64) - FRAME.itemsize - 4
    front = np.array([raw[s: s + FRAME.itemsize] for s in starts]).view(FRAME)
    told = np.array([raw[s + FRAME.itemsize + k: s + FRAME.itemsize + k + 4] for s, k in zip(starts, lengths)]).view("<u4")
    size = masked(crc32c(front["length"].copy().view(np.uint8), np.arange(n) * 8, np.full(n, 8)))
    if (front["length"] != lengths).any() or (size != front["check"]).any() or (masked(crc32c(data, starts + FRAME.itemsize, lengths)) != told).any():
        raise ValueError("a record's length or checksum is wrong")
    found = []
    for s, k in zip(starts + FRAME.itemsize, lengths):
        head = np.frombuffer(raw, HEADER, 1, s)[0]
        tokens = np.frombuffer(raw, f"<u{head['width']}", int(head["tokens"]), s + HEADER.itemsize)
        found.append((int(head["id"]) if head["has_id"] else None, tokens))
    return found


def _write(base: str, path: str, end_id: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = _encoder(path), None
        end = np.array([end_id], encoder.type).tobytes()
        records = tokens = 0
        for batch in stream:
            if not batch.num_rows:
                continue
            if out is None:
                out, index = SharedFile(base, "records"), SharedFile(base, "index")
            ids = batch[0].to_pylist()
            encoded = [x + end for x in encoder.batch(batch[1].cast(pa.string()))]
            framed, at = frame(ids, encoded, encoder.type)
            rows = np.zeros(len(ids), INDEX)
            rows["id"] = [0 if i is None else i for i in ids]
            rows["offset"] = at[:-1] + out.size
            counts = np.array([len(x) // encoder.type.itemsize for x in encoded], np.int64)
            rows["before"] = np.cumsum(counts) - counts + tokens
            out.write(framed)
            index.write(rows.tobytes())
            records, tokens = records + len(ids), tokens + int(counts.sum())
        if out is not None:
            last = np.zeros(1, INDEX)
            last["offset"], last["before"] = out.size, tokens
            index.write(last.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.close()]), pa.array([index.close()]), pa.array([records], pa.int64()), pa.array([tokens], pa.int64())],
                names=["part", "file", "index", "records", "tokens"],
            )

    return run


def read_range(base: str, file: str, index: str, first: int, count: int) -> tuple[np.ndarray, list[tuple[int | None, np.ndarray]]]:
    """``count`` records from number ``first`` on: two range reads, one of the index and one of the records."""
    with open_shared(base, index) as f:
        rows = np.frombuffer(f.read_at((count + 1) * INDEX.itemsize, first * INDEX.itemsize), INDEX)
    start = int(rows["offset"][0])
    with open_shared(base, file) as f:
        raw = f.read_at(int(rows["offset"][-1]) - start, start)
    return rows, unframe(raw, rows["offset"] - np.uint64(start))


def _read(base: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part, file, index, first, count in zip(*(c.to_pylist() for c in batch.columns)):
                rows, found = read_range(base, file, index, first, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in found], pa.int64()), pa.array([part] * count, pa.int32()), pa.array(rows["before"][:-1].astype(np.int64)),
                        pa.array([len(t) for _, t in found], pa.int64()), pa.array([zlib.crc32(t.astype("<u4").tobytes()) for _, t in found], pa.int64()),
                    ],
                    names=["doc_id", "part", "before", "n_tokens", "ids_crc32"],
                )

    return run


def write_records(docs: DataFrame, base: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Write all texts (null: empty) in ascending order of id, each with ``end_id`` behind it; the manifest of the files.

    Null ids come first. Rows of one id are ordered by a hash of their text, so that one id may hold any share of the
    rows. ``path`` is a tokenizer file of the tokenizers library, byte-level BPE; strings of special tokens inside a text
    are ordinary text. Only the two named columns are read. An empty table gives no files.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    order = ["doc_id", "tie"]
    sorted_ = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(sorted_.select("doc_id", "text").mapInArrow(_write(base, path, end_id), MANIFEST), "records-manifest")


def read_records(manifest: DataFrame, base: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files; the manifest has one row per file."""
    spark = manifest.sparkSession
    blocks = manifest.select(
        "part", "file", "index", "records", F.explode(F.sequence(F.lit(0), ((F.col("records") - 1) / BLOCK).cast("int"))).alias("block")
    ).select("part", "file", "index", (F.col("block") * BLOCK).cast("long").alias("first"), F.least(F.lit(BLOCK), F.col("records") - F.col("block") * BLOCK).cast("long").alias("count"))
    rows = blocks.repartition(partitions(spark)).mapInArrow(_read(base), ROWS)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Write the records, then read them back."""
    base = folder(docs.sparkSession, "records")
    return read_records(write_records(docs, base, path, id_col, text_col, end_id), base)
