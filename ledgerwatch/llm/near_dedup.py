"""MinHash near-dedup by a multi-index Hamming join.

Documents with equal shingle sets are one class. A class has a signature of SYMBOLS b-bit minima. Two sets of the wanted
similarity differ in at most ``radius`` symbols but for a chance of MISS. The signature is split into chunks, so many that
two signatures within the radius agree in one of them but for a single symbol (pigeonhole); each chunk gives one key for
each symbol left out. Classes that share a key are candidates; links are confirmed on the full sets.

A set that has too many shingles of its own, which no other candidate has, is linked with nothing, whatever its signature
says: such classes leave first. The others form families, a family being the classes whose smallest class among all their
keys is the same. A family is cut into slices; a task holds a slice, compares its sets by an inverted index, and returns no
pairs but each set with the smallest one it is linked to. Classes that their family's first one is not linked with, directly or through others, are
then compared with all slices. What is left are keys that several families and components share; there, classes outside
the key's largest component are compared with those of other families, PIVOTS of them a round, until none is left.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.common import (
    LOWER, SENT, SharedFile, body, folder, joined, materialize, mix, open_shared, pack, partitions, prepare, sent_rows as _rows, unpack, word_hashes, words,
)
from ledgerwatch.llm.components import components

SHINGLE, SYMBOLS, MISS, PIVOTS = 5, 64, 1e-6, 16
#: Shingles of a family that one task compares.
SLICE = 100_000
SHINGLED = "doc_id long, n_shingles long, class binary, signature binary, file string, at long, size long, pos long"


@lru_cache(1)
def _multipliers() -> np.ndarray:
    return mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each text, and where each text's begin (one more than texts)."""
    data, offsets = joined(texts)
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    hashes = word_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = max(len(hashes) - SHINGLE + 1, 0)
    five = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        five = five * np.uint64(0x9E3779B97F4A7C15) + hashes[k: k + n]
    whole = owner[:n] == owner[SHINGLE - 1:] if n else np.zeros(0, bool)
    own, value = owner[:n][whole], mix(five[whole])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        ones = np.array([int.from_bytes(hashlib.blake2b(hashes[first[i]: first[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short], np.uint64)
        own, value = np.concatenate([own, short]), np.concatenate([value, ones])
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    own, value = own[new], value[new]
    return value, np.searchsorted(own, np.arange(len(texts) + 1))


def _class(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols per set (rows of empty sets are zero)."""
    out = np.zeros((len(first) - 1, SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        for k, m in enumerate(_multipliers()):
            least = np.minimum.reduceat(values * m, first[full])
            out[full, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def _shingled(base: str):
    """Class and signature of every text. The texts of a batch are kept as one block in the shared folder, where those that
    turn out to have partners are found again without sending all texts."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in stream:
            if out is None:
                out = SharedFile(base, "texts")
            data, offsets = joined(batch["text"])
            block = pack(offsets, data)
            at = out.write(block)
            values, first = shingle_sets(batch["text"])
            sig, n = signatures(values, first), batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array(np.diff(first).astype(np.int64)),
                    pa.array([_class(values[a:b]) for a, b in zip(first, first[1:])], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()),
                    pa.array([out.name] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array([len(block)] * n, pa.int64()), pa.array(np.arange(n)),
                ],
                names=["doc_id", "n_shingles", "class", "signature", "file", "at", "size", "pos"],
            )
        if out is not None:
            out.close()

    return run


def radius(percent: int) -> int:
    """Symbols that signatures of sets with this similarity may differ in, but for a chance of MISS."""
    p, tail, t = 1 - percent / 100, 1.0, -1
    while tail > MISS and t < SYMBOLS:
        t += 1
        tail -= comb(SYMBOLS, t) * p**t * (1 - p) ** (SYMBOLS - t)
    return t


def chunks(percent: int) -> list[np.ndarray]:
    """Positions of the chunks: one more than half the radius, so that one of them has at most one difference."""
    return np.array_split(np.arange(SYMBOLS), min(SYMBOLS // 2, radius(percent) // 2 + 1))


def _keys(percent: int):
    parts = chunks(percent)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
            for c, part in enumerate(parts):
                terms = mix((sig[:, part] << np.uint64(16)) + (part + 1).astype(np.uint64))
                total = terms.sum(1, dtype=np.uint64)
                for j in range(len(part)):
                    key = mix(total - terms[:, j] + np.uint64(c * SYMBOLS + j + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch["rep"]], names=["key", "rep"])

    return run


def _send_shingles(texts: str, base: str, count: int):
    """Stores the sets of a block's candidates in the shared folder and sends their distinct shingles, and which of them
    several of these sets have."""
    edges = np.array([(k << 64) // count for k in range(1, count)], np.uint64)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        name, at, size = (k.as_py() for k in key)
        with open_shared(texts, name) as f:
            offsets, data = unpack(f.read_at(size, at))
        own = [data[offsets[p]: offsets[p + 1]].tobytes() for p in table["pos"].to_pylist()]
        values, first = shingle_sets(pa.array(own, pa.binary()))
        out = SharedFile(base, "sets")
        block = pack(table["rep"].to_numpy(), np.diff(first), values)
        chunk = uuid.uuid4().int >> 66
        where = np.array([out.write(block), len(block)], np.int64).tobytes()
        some, counts = np.unique(values, return_counts=True)
        cut = [0, *np.searchsorted(some, edges), len(some)]
        rows = [("chunk", chunk, 0, where + out.close().encode())]
        rows += [
            ("shingles", b, chunk, pack(np.diff(some[cut[b]: cut[b + 1]] >> np.uint64(24), prepend=np.uint64(0)), counts[cut[b]: cut[b + 1]] > 1))
            for b in range(count) if cut[b + 1] > cut[b]
        ]
        return pa.Table.from_batches([_rows(rows)])

    return run


def _reply_shingles(table: pa.Table) -> pa.Table:
    """For each batch: which of its shingles no other set has. Forty bits of a shingle may make it seem shared, never
    unshared."""
    sources, parts = table["source"].to_pylist(), [unpack(b) for b in table["block"].to_pylist()]
    values = [np.cumsum(v, dtype=np.uint64) for v, _ in parts]
    some, back = np.unique(np.concatenate(values), return_inverse=True)
    seen = np.bincount(back, 1 + np.concatenate([m for _, m in parts]), minlength=len(some))
    alone, end, rows = (seen == 1)[back], 0, []
    for source, own in zip(sources, values):
        rows.append(("alone", source, table["place"][0].as_py(), pack(np.packbits(alone[end: end + len(own)]))))
        end += len(own)
    return pa.Table.from_batches([_rows(rows)])


def _survivors(base: str, count: int, percent: int):
    """Sets with enough shingles that others have: rep, n, shingles."""
    edges = np.array([(k << 64) // count for k in range(1, count)], np.uint64)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        reply, block = {}, None
        for kind, source, raw in zip(table["kind"].to_pylist(), table["source"].to_pylist(), table["block"].to_pylist()):
            if kind == "chunk":
                block = raw
            else:
                reply[source] = raw
        at, size = np.frombuffer(block, np.int64, 2)
        with open_shared(base, block[16:].decode()) as f:
            reps, sizes, values = unpack(f.read_at(int(size), int(at)))
        some = np.unique(values)
        cut = [0, *np.searchsorted(some, edges), len(some)]
        alone = np.zeros(len(some), bool)
        for b, raw in reply.items():
            alone[cut[b]: cut[b + 1]] = np.unpackbits(unpack(raw)[0], count=cut[b + 1] - cut[b])
        ends = np.cumsum(sizes)
        shared = np.concatenate([[0], np.cumsum(~alone[np.searchsorted(some, values)])])
        good = np.flatnonzero(100 * (shared[ends] - shared[ends - sizes]) >= percent * sizes)
        found = [values[ends[i] - sizes[i]: ends[i]].tobytes() for i in good]
        return pa.table([pa.array(reps[good]), pa.array(sizes[good]), pa.array(found, pa.binary())], names=["rep", "n", "shingles"])

    return run


def links(values: np.ndarray, sizes: np.ndarray, percent: int, rows: np.ndarray, label: np.ndarray) -> None:
    """Gives one label to sets that are linked, directly or through others, by pairs that have one of ``rows`` in them.

    The sets stand one after the other in ``values``; ``label`` holds what is known so far and is brought up to date. An
    inverted index over shingles of two sets or more counts what sets share.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, number, counts = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(number, kind="stable")
    postings, begin, ends = owner[order], np.cumsum(counts) - counts, np.cumsum(sizes)
    for x in rows:
        own = number[ends[x] - sizes[x]: ends[x]]
        own = own[counts[own] > 1]
        many = counts[own]
        at = np.arange(many.sum()) + np.repeat(begin[own] - (np.cumsum(many) - many), many)
        same = np.bincount(postings[at], minlength=len(sizes))
        near = np.flatnonzero((same > 0) & (100 * same >= percent * (sizes[x] + sizes - same)) & (label != label[x]))
        for other in np.unique(label[near]):
            label[label == other] = label[x]


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = table["shingles"].to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64), np.array([len(r) // 8 for r in raw], np.int64), table["rep"].to_numpy()


def _stars(label: np.ndarray, reps: np.ndarray) -> pa.Table:
    """Each set with the smallest one of its label, so that the components that follow take few rounds."""
    _, number = np.unique(label, return_inverse=True)
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, number, reps)
    other = least[number] != reps
    return pa.table([pa.array(reps[other]), pa.array(least[number][other])], names=["u", "v"])


def _slice_links(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """All links within a slice, to which the family's first class belongs too."""
        values, sizes, reps = _sets(table)
        label = np.arange(len(reps))
        links(values, sizes, percent, label.copy(), label)
        return _stars(label, reps)

    return run


def _guest_links(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Links between the undecided classes of other slices and the classes of this one."""
        values, sizes, reps = _sets(table)
        label = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        guests = np.flatnonzero(table["guest"].to_numpy(zero_copy_only=False))
        links(values, sizes, percent, guests, label)
        return _stars(label, reps)

    return run


def _confirm(percent: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            linked = []
            for a, b in zip(batch["xa"].to_pylist(), batch["xb"].to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * same >= percent * (len(x) + len(y) - same))
            kept = batch.filter(pa.array(linked, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept["a"], kept["b"]], names=["u", "v"])

    return run


def _without_isolated(texts: str, classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """rep, n, shingles of the candidates that may be linked with one."""
    spark = members.sparkSession
    count, base = partitions(spark), folder(spark, "near-sets")
    wanted = materialize(members.select(F.col("rep").alias("want")).distinct(), "near-wanted")
    looked = classes.join(wanted, F.col("rep") == F.col("want")).select("rep", "file", "at", "size", "pos")
    sent = materialize(looked.repartition(count, "file", "at", "size").groupBy("file", "at", "size").applyInArrow(_send_shingles(texts, base, count), SENT), "near-sent")
    told = sent.where("kind = 'shingles'").groupBy("place").applyInArrow(_reply_shingles, SENT)
    both = sent.where("kind = 'chunk'").unionByName(told)
    sets = both.repartition(count, "place").groupBy("place").applyInArrow(_survivors(base, count, percent), "rep long, n long, shingles binary")
    return materialize(sets, "near-survivors")


def _family_links(sets: DataFrame, families: DataFrame, percent: int, slice_shingles: int) -> DataFrame:
    """Edges (u, v) between classes of a family that are linked, directly or through others."""
    width = materialize(families.join(sets.select(F.col("rep").alias("r"), "n"), F.col("rep") == F.col("r")).groupBy("family").agg(F.ceil(F.sum("n") / slice_shingles).cast("int").alias("slices")), "near-widths")
    placed = families.join(width.withColumnRenamed("family", "f"), F.col("family") == F.col("f")).select("family", "rep", "slices")
    own = F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")
    home = materialize(placed.select("family", "rep", "slices", own.alias("slice")), "near-homes")
    # the family's first class stands in every slice
    every = F.explode(F.when(F.col("rep") == F.col("family"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array("slice")))
    held = sets.select(F.col("rep").alias("r"), "shingles")
    rows = materialize(home.select("family", "rep", every.alias("slice")), "near-slices").join(held, F.col("rep") == F.col("r")).select("family", "slice", "rep", "shingles")
    inner = materialize(rows.groupBy("family", "slice").applyInArrow(_slice_links(percent), "u long, v long"), "near-inner")
    wide = home.where("slices > 1")
    if wide.isEmpty():
        return inner
    places = materialize(components(inner), "near-places")
    known = wide.join(places, F.col("rep") == F.col("node"), "left").select("family", "rep", "slices", "slice", F.coalesce("component", "rep").alias("component"))
    known = materialize(known, "near-known")
    lead = known.where("rep = family").select(F.col("family").alias("f"), F.col("component").alias("lead"))
    undecided = known.join(lead, F.col("family") == F.col("f")).where("component <> lead")
    guests = undecided.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).where("at <> slice").select("family", F.col("at").alias("slice"), "rep", "component", F.lit(True).alias("guest"))
    rows = materialize(known.select("family", "slice", "rep", "component", F.lit(False).alias("guest")).unionByName(guests), "near-guests")
    outer = rows.join(held, F.col("rep") == F.col("r")).select("family", "slice", "rep", "component", "guest", "shingles")
    return inner.unionByName(materialize(outer.groupBy("family", "slice").applyInArrow(_guest_links(percent), "u long, v long"), "near-outer"))


def _shared_id_links(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) from each id that has texts of several classes to the first document of each of them."""
    several = usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("u"))
    held = materialize(usable.join(several, F.col("doc_id") == F.col("u"), "left_semi").select("doc_id", F.col("class").alias("of")).distinct(), "near-shared-ids")
    return held.join(classes.select("class", "rep"), F.col("of") == F.col("class")).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, slice_shingles: int = SLICE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; sets are linked from ``percent`` of Jaccard similarity on.

    A set holds the distinct shingles of five words (separated by white space, A-Z in lower case), or the whole sequence
    where there are fewer. Null, empty and blank texts have an empty set and link with nothing. Repeated rows are alike;
    rows that share an id are one node that has the links of all of them. Rows with a null id are neither linked nor
    dropped (component_id is null). ``slice_shingles`` cuts the work up and does not change the result. Only the two named columns are read. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("text"))
    base = folder(spark, "near-texts")
    rows = materialize(texts.mapInArrow(_shingled(base), SHINGLED), "near-shingled")
    usable = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = F.min(F.struct("doc_id", "file", "at", "size", "pos")).alias("least")
    classes = usable.groupBy("class").agg(least, F.first("signature").alias("signature"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes.select("class", F.col("least.doc_id").alias("rep"), "least.file", "least.at", "least.size", "least.pos", "signature", "rows"), "near-classes")
    members = classes.select("rep", "signature").mapInArrow(_keys(percent), "key long, rep long")

    def of_shared_keys(rows: DataFrame, name: str) -> DataFrame:
        """key, rep, first of the keys that two classes or more have; first is the smallest of them."""
        shared = materialize(
            rows.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select(F.col("key").alias("k"), "first"), f"{name}-keys"
        )
        return materialize(rows.join(shared, F.col("key") == F.col("k")).select("key", "rep", "first"), name)

    candidates = of_shared_keys(members, "near-candidates")
    sets = _without_isolated(base, classes, candidates, percent)
    alive = sets.select(F.col("rep").alias("r")).distinct()
    rest = of_shared_keys(candidates.join(alive, F.col("rep") == F.col("r"), "left_semi").select("key", "rep"), "near-members")
    families = materialize(rest.groupBy("rep").agg(F.min("first").alias("family")), "near-families")
    # a family's first class belongs to it, whatever family it would be counted to itself
    families = materialize(families.unionByName(families.select(F.col("family").alias("rep"), "family")).distinct(), "near-all-families")
    edges = _family_links(sets, families, percent, slice_shingles).unionByName(_shared_id_links(usable, classes))
    places = materialize(components(edges), "near-components")
    own = rest.join(families.groupBy("rep").agg(F.min("family").alias("family")).withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).select("key", "rep", "family")
    own = materialize(own, "near-own")
    held = sets.select("rep", "shingles")
    done = None
    while True:
        home = places.select("node", "component")
        placed = own.join(home, F.col("rep") == F.col("node"), "left").select("key", "rep", "family", F.coalesce("component", "rep").alias("component"))
        sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.min("family").alias("f0"), F.max("family").alias("f1"))
        open_keys = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("parts"), F.min("f0").alias("f0"), F.max("f1").alias("f1"))
        open_keys = materialize(open_keys.where("parts > 1 AND f0 < f1").select(F.col("key").alias("open_key"), F.col("most.component").alias("largest")), "near-open")
        open_rows = materialize(placed.join(open_keys, F.col("key") == F.col("open_key")).select("key", "rep", "family", "component", "largest"), "near-open-rows")
        left = open_rows.where("component <> largest")
        if done is not None:
            left = left.join(done, (F.col("key") == F.col("done_key")) & (F.col("rep") == F.col("done_rep")), "left_anti")
        # a few pivots from each of several slices of a key, so that no key's pivots are ranked in one place
        rank = F.row_number().over(Window.partitionBy("key", "salt").orderBy("rep"))
        ranked = left.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(4))).withColumn("r", rank).where(F.col("r") <= PIVOTS)
        pivots = materialize(ranked.select(F.col("key").alias("at"), F.col("rep").alias("pivot"), F.col("component").alias("pivot_part"), F.col("family").alias("pivot_family")), "near-pivots")
        if pivots.isEmpty():
            break
        pairs = open_rows.join(pivots, (F.col("key") == F.col("at")) & (F.col("component") != F.col("pivot_part")) & (F.col("family") != F.col("pivot_family")))
        pairs = materialize(pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct(), "near-cross")
        sides = pairs.join(held.select(F.col("rep").alias("ra"), F.col("shingles").alias("xa")), F.col("a") == F.col("ra")).join(held.select(F.col("rep").alias("rb"), F.col("shingles").alias("xb")), F.col("b") == F.col("rb"))
        new = materialize(sides.select("a", "b", "xa", "xb").mapInArrow(_confirm(percent), "u long, v long"), "near-new")
        was = pivots.select(F.col("at").alias("done_key"), F.col("pivot").alias("done_rep"))
        done = was if done is None else materialize(done.unionByName(was), "near-done")
        if not new.isEmpty():
            places = materialize(components(places.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(new)), "near-components")
    # the rows of an id follow their class; classes that share an id are linked by it
    homes = classes.join(places, F.col("rep") == F.col("node"), "left").where("rows > 1 OR component IS NOT NULL").select(F.col("class").alias("of"), F.coalesce("component", "rep").alias("home"))
    found = rows.join(materialize(homes, "near-homes"), F.col("class") == F.col("of"), "left")
    place = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("home", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", place.alias("component_id"), place.eqNullSafe(F.col("doc_id")).alias("kept"))
