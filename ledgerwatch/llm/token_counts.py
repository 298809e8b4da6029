"""Token counts of whole texts: pieces are counted once per distinct pre-token, then summed by frequency.

No merge of the model crosses the border before a blank that follows something else, or before a line feed: the vocabulary
has no such piece, which is checked. Pre-tokens, cut at these borders, are therefore encoded independently.

1. Tasks cut texts into pre-tokens and close a chunk of texts when it is large enough: the chunk's distinct pre-tokens
   become rows, its per-document frequencies (numbers of pre-tokens and counts) a compressed block in a shared file.
2. All chunks' pre-tokens are brought together and sorted, so equal ones stand in a row; each distinct one is encoded once,
   only the number of its pieces is kept.
3. The numbers go back to their chunk, where they meet the frequencies and are summed per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import SharedFile, body, folder, materialize, open_shared, pack, partitions, prepare, unpack

#: A chunk is closed beyond so many bytes of text or distinct pre-tokens.
CHUNK_BYTES, CHUNK_WORDS = 64 << 20, 500_000
#: Counted pre-tokens that are sent back together.
SENT_BACK = 1 << 18
#: What the model writes for a blank.
BLANK = "▁"
#: A text that normalising, trimming or joining of blanks would change.
PROBE = "a  \ufb01 \u3000 e\u0301\u212b \n "
CHUNK_ROWS = "chunk long, file string, at long, size long, number int, word string"
COUNTED = "chunk long, block binary"
ROWS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

_PARTS = regex.compile(r"▁+[^▁\n]*|\n[^▁\n]*")


def pretokens(text: str) -> list[str]:
    """Independent parts of a text: the first blank of each is left out, other parts begin with a line feed.

    The model puts a blank before a text that is not empty, so every part begins with a blank or a line feed.
    """
    if not text:
        return []
    plain = text.replace(BLANK, " ")
    cut = plain.replace("\n", " \n")
    if "  " not in cut and cut[0] != " " and cut[-1] != " ":
        return cut.split(" ")
    return [p[1:] if p[0] == BLANK else p for p in _PARTS.findall(BLANK + plain.replace(" ", BLANK))]


class PieceCounter:
    """Numbers of pieces of pre-tokens, by the sentencepiece library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) or ("\n" in p and len(p) > 1) for p in pieces):
            raise ValueError("the vocabulary has pieces that cross the borders of pre-tokens")
        if self.model.decode(self.model.encode(PROBE)) != PROBE:
            raise ValueError("the model changes texts before it encodes them")

    def count(self, words: list[str]) -> list[int]:
        # the library puts a blank before what it encodes: a line feed keeps it apart, a lone blank is one piece
        return [
            1 if not w else len(ids) - (w[0] == "\n")
            for w, ids in zip(words, self.model.encode(words, add_bos=False, add_eos=False, num_threads=1))
        ]


@lru_cache(2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Chunk:
    """Distinct pre-tokens in order of appearance, and the frequencies of each text."""

    def __init__(self):
        self.numbers, self.bytes = _Numbers(), 0
        self.ids, self.null, self.sizes, self.distinct, self.steps, self.counts = [], [], [], [], [], []

    def add(self, ids: pa.Array, texts: list[bytes]) -> None:
        parts = [pretokens(t.decode()) for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        found = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        keys, counts = np.unique((np.repeat(np.arange(len(parts)), sizes) << 32) | found, return_counts=True)
        row, number = keys >> 32, keys & 0xFFFFFFFF
        steps = np.diff(number, prepend=0)
        steps[np.flatnonzero(np.diff(row, prepend=-1))] = number[np.flatnonzero(np.diff(row, prepend=-1))]
        self.ids.append(np.asarray(ids.fill_null(0)))
        self.null.append(np.asarray(ids.is_null()))
        self.sizes.append(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.distinct.append(np.bincount(row, minlength=len(parts)))
        self.steps.append(steps)
        self.counts.append(counts)
        self.bytes += int(self.sizes[-1].sum())

    def block(self) -> bytes:
        steps, counts = np.concatenate(self.steps).astype("<u4"), np.concatenate(self.counts).astype("<u4")
        planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T) for a in (steps, counts)]
        return pack(*(np.concatenate(a) for a in (self.ids, self.null, self.sizes, self.distinct)), *planes)


def sums(block: bytes, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, which of them are null, bytes and pieces of the texts of a chunk; ``pieces`` by number of pre-token."""
    ids, null, sizes, distinct, *planes = unpack(block)
    steps, counts = (np.ascontiguousarray(p.T).reshape(-1).view("<u4").astype(np.int64) for p in planes)
    first = np.concatenate([[0], np.cumsum(distinct)])
    running = np.cumsum(steps)
    before = np.concatenate([[0], running])[first[:-1]]
    numbers = running - np.repeat(before, distinct)
    total = np.concatenate([[0], np.cumsum(pieces[numbers] * counts)])
    return ids, null, sizes, total[first[1:]] - total[first[:-1]]


def _cut(base: str):
    def rows(chunk: int, words: list[str], file: str | None = None, at: int = 0, size: int = 0) -> pa.RecordBatch:
        n = len(words) or 1
        columns = [
            pa.array([chunk] * n, pa.int64()), pa.array([file] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array([size] * n, pa.int64()),
            pa.array(range(len(words)) if words else [None], pa.int32()), pa.array(words or [None], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "file", "at", "size", "number", "word"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, places, chunk, n = None, [], _Chunk(), 0

        def close() -> pa.RecordBatch:
            nonlocal out, chunk, n
            out = out or SharedFile(base, "frequencies")
            block, words, name = chunk.block(), list(chunk.numbers), (TaskContext.get().partitionId() << 32) | n
            places.append((name, out.write(block), len(block)))
            chunk, n = _Chunk(), n + 1
            return rows(name, words) if words else None

        for batch in stream:
            if not batch.num_rows:
                continue
            chunk.add(batch[0], batch[1].to_pylist())
            if chunk.bytes > CHUNK_BYTES or len(chunk.numbers) > CHUNK_WORDS:
                yield from filter(None, [close()])
        if chunk.ids:
            yield from filter(None, [close()])
        if out is not None:
            file = out.close()
            for name, at, size in places:
                yield rows(name, [], file, at, size)

    return run


def _send(chunks: np.ndarray, numbers: np.ndarray, pieces: np.ndarray) -> pa.RecordBatch:
    """A row for each chunk with the numbers of its pre-tokens and of their pieces."""
    order = np.lexsort((numbers, chunks))
    chunks, numbers, pieces = chunks[order], numbers[order], pieces[order]
    first = np.flatnonzero(np.diff(chunks, prepend=chunks[0] - 1)) if len(chunks) else np.zeros(0, np.int64)
    blocks = [pack(np.diff(n, prepend=0).astype(np.int32), p.astype(np.int32)) for n, p in zip(np.split(numbers, first[1:]), np.split(pieces, first[1:]))]
    return pa.RecordBatch.from_arrays([pa.array(chunks[first], pa.int64()), pa.array(blocks[: len(first)], pa.binary())], names=["chunk", "block"])


def _count(path: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, last, known, held, size = _counter(path), None, 0, [], 0
        for batch in stream:
            if not batch.num_rows:
                continue
            words = batch.column(2).to_pylist()
            new = [k for k in range(len(words)) if words[k] != (words[k - 1] if k else last)]
            found = np.array(counter.count([words[k] for k in new]), np.int64)
            runs = np.diff([0, *new, len(words)])  # those before the first new word are the last batch's
            pieces = np.repeat(np.concatenate([[known], found]), runs)
            last, known = words[-1], int(pieces[-1])
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), pieces))
            size += len(words)
            if size >= SENT_BACK:
                yield _send(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield _send(*map(np.concatenate, zip(*held)))

    return run


def _sum(base: str, limit: int):
    def run(counted: pa.Table, places: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in counted["block"].to_pylist()]
        pieces = np.zeros(sum(len(p) for p, _ in parts), np.int64)
        for steps, found in parts:
            pieces[np.cumsum(steps)] = found
        file, at, size = (places[c][0].as_py() for c in ("file", "at", "size"))
        with open_shared(base, file) as f:
            ids, null, sizes, tokens = sums(f.read_at(size, at), pieces)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null), "n_bytes": pa.array(sizes, pa.int64()),
            "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array(tokens > limit),
        })

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether they are more than ``limit``, of each row of ``docs``.

    ``path`` is a model file of the sentencepiece library; the numbers are those of its plain encoding of the whole text,
    without begin and end. A null text is empty and has no tokens; null ids and repeated rows stay as they are; other
    columns are not read; an empty table gives no rows. A task holds one chunk (``CHUNK_BYTES``, ``CHUNK_WORDS`` or one
    batch beyond) at a time; a pre-token that all chunks have is one row of each.
    """
    spark = prepare(docs.sparkSession)
    base = folder(spark, "token-counts")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    chunks = materialize(texts.mapInArrow(_cut(base), CHUNK_ROWS), "token-chunks", "zstd")
    words = chunks.where("number IS NOT NULL").select("chunk", "number", "word")
    counted = words.repartition(partitions(spark), "word").sortWithinPartitions("word").mapInArrow(_count(path), COUNTED)
    places = chunks.where("number IS NULL").select("chunk", "file", "at", "size")
    return counted.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(_sum(base, limit), ROWS)
