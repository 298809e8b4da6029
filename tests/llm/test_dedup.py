import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from ledgerwatch.llm import near_dedup as near
from ledgerwatch.llm.components import components
from ledgerwatch.llm.exact_dedup import NO_ID, Directory, exact_dedup
from ledgerwatch.llm.suffix_dedup import CHUNK, suffix_dedup
from ledgerwatch.llm.suffixes import BlindTries, classes, multikey
from tests.llm.plain import SCHEMA, odd_docs, shingles


def order_id(i):
    return NO_ID if i is None else i


def test_exact_dedup_matches_plain_grouping(spark):
    rows = odd_docs()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), order_id(i)))
    want = Counter()
    for i, t, *_ in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[body])[1]
        want[(i, None if keep == NO_ID else keep, len(groups[body]), order_id(i) == keep, hashlib.sha256(body.encode()).hexdigest())] += 1
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA), capacity=3)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_exact_dedup_of_no_rows(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_directory_doubles_and_splits():
    d = Directory()
    d.split(0)
    d.split(1)
    assert d.depth == 2 and d.slots.tolist() == [0, 0, 1, 2]
    keys = np.array([0, 1 << 62, 1 << 63, 3 << 62], np.uint64)
    assert d.buckets(keys).tolist() == [0, 0, 1, 2]


def test_chain_compares_bytes():
    from ledgerwatch.llm import exact_dedup as module

    chain = []
    assert module._add(chain, b"a", 1, 5, 1) and module._add(chain, b"b", 1, 4, 1)
    assert module._add(chain, b"a", 2, 9, 2) == 0
    assert chain == [[b"a", 2, -9, 3], [b"b", 1, -4, 1]]


def plain_suffixes(rows, length=50):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p: p + length]
            first[s] = min(first.get(s, NO_ID), order_id(i))
    out = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        covered = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p: p + length]] < order_id(i):
                covered[p: p + length] = [True] * length
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out[(i, len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest())] += 1
    return out


def test_suffix_dedup_matches_plain_search(spark):
    rows = odd_docs()
    rows += [(100, "ab" * 200, *[None] * 5), (101, "ba" * 60, *[None] * 5), (102, "x" * 49, *[None] * 5), (103, "x" * 50, *[None] * 5), (104, "y" + "x" * 50 + "z", *[None] * 5)]
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(tuple(r)[:5] for r in got.collect()) == plain_suffixes(rows)


def test_suffix_dedup_with_crowded_anchors_and_tiny_chunks(spark):
    rows = [(k, f"{k} {'left ' * (k % 7)}this passage stands in every document of the table, more or less, and is long{k % 5}", *[None] * 5) for k in range(60)]
    want = plain_suffixes(rows)
    for crowded, chunk in ((1, 300), (5, 1000), (1000, CHUNK)):
        got = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), chunk_bytes=chunk, crowded=crowded)
        assert Counter(tuple(r)[:5] for r in got.collect()) == want, (crowded, chunk)


def test_suffix_dedup_of_no_rows(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_suffix_classes_are_those_of_the_strings(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(60, 300))).astype(np.uint8)
    if seed % 2:
        s = np.tile(s[: int(rng.integers(5, 40))], 8)
    n, length = len(s), int(rng.integers(8, 60))
    s = np.concatenate([s, np.zeros(length + 16, np.uint8)])
    at = rng.permutation(n)[: int(rng.integers(1, n + 1))]
    strings = [s[a: a + length].tobytes() for a in at]
    found = classes(s, at, length)
    assert len(set(zip(found, strings))) == len(set(found)) == len(set(strings))
    order, _ = multikey(s, at, 16)
    short = [s[a: a + 16].tobytes() for a in at[order]]
    assert short == sorted(short)


def test_blind_trie_orders_its_leaves():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, (50, 2)).astype(np.uint64) << np.uint64(61)
    trie = BlindTries(words, np.array([0, 50]))
    leaves = [tuple(words[i]) for i in trie.ordered(0)]
    assert leaves == sorted(set(map(tuple, words)))


def plain_components(rows, percent):
    sets, up = {}, {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return Counter(
        (i, len(shingles(t)), None if i is None else find(i), i is None or find(i) == i) for i, t, *_ in rows
    )


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_matches_all_pairs(spark, percent):
    rows = odd_docs()
    got = near.near_dedup(spark.createDataFrame(rows, SCHEMA), percent=percent)
    assert Counter(tuple(r) for r in got.collect()) == plain_components(rows, percent)


def test_near_dedup_chains_beyond_the_smallest_of_a_key(spark):
    """Copies that drift: neighbours are linked, the ends are not; links between other than the smallest must be found."""
    words = [f"t{k}" for k in range(200)]
    rows = []
    for k in range(30):
        words[(k * 37) % 200] = f"n{k}"
        rows.append((1000 - k if k % 2 else k, " ".join(words), *[None] * 5))
    want = plain_components(rows, 85)
    for size in (near.SLICE, 1500, 300):
        got = near.near_dedup(spark.createDataFrame(rows, SCHEMA), percent=85, slice_shingles=size)
        assert Counter(tuple(r) for r in got.collect()) == want, size


def test_near_dedup_of_edited_copies_of_one_text(spark):
    """Copies of one text with more and more words replaced: some are linked, some only through others, some not at all."""
    rng = np.random.default_rng(5)
    base, rows = [f"b{k}" for k in range(120)], []
    for k in range(80):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            words[at] = f"e{rng.integers(3)}"
        rows.append((int(rng.integers(10_000)), " ".join(words), *[None] * 5))
    want = plain_components(rows, 85)
    for size in (near.SLICE, 2000):
        got = near.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), percent=85, slice_shingles=size)
        assert Counter(tuple(r) for r in got.collect()) == want, size


def test_near_dedup_unites_classes_that_share_an_id(spark):
    """An id is one node: 5 has the text of 3 and another one, of which 7 is a near copy; 9 repeats a row of its own."""
    a, b = " ".join(f"a{k}" for k in range(200)), " ".join(f"b{k}" for k in range(200))
    rows = [(3, b), (5, a), (5, b), (7, a + " end"), (8, "a text of its own entirely"), (9, "some words of number nine"), (9, "some words of number nine")]
    rows += [(20, "only here are these words"), (20, "and here are quite other words")]
    rows = [(i, t, *[None] * 5) for i, t in rows]
    got = near.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), percent=85).select("doc_id", "component_id", "kept")
    want = [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True), (9, 9, True), (9, 9, True), (20, 20, True), (20, 20, True)]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_near_dedup_of_no_rows(spark):
    assert near.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chunks_hold_at_most_one_difference():
    for percent in (80, 85, 95):
        parts = near.chunks(percent)
        assert 2 * len(parts) > near.radius(percent) and sorted(np.concatenate(parts)) == list(range(near.SYMBOLS))


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(0)
    label = rng.permutation(300).tolist()
    edges = [(label[k], label[k + 1]) for k in range(149)] + [(label[k], label[k + 1]) for k in range(150, 299)] + [(label[5], label[5])]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {**{x: min(label[:150]) for x in label[:150]}, **{x: min(label[150:]) for x in label[150:]}}
    assert got == {x: c for x, c in want.items() if x != c}
