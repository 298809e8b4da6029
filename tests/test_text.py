"""The stored index gives the rows of the search that reads all texts."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import text as tx

RARE, COMMON = "zebra", "account"


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    for k in range(600):
        words = [rng.choice(["transfer", "limit", "card", COMMON, "refund", "the"]) for _ in range(rng.randint(0, 40))]
        words += [RARE] * (rng.randint(1, 4) if k % 97 == 0 else 0)
        rows.append((k, " ".join(words) if words else None if k % 2 else ""))
    folder = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/docs")
    docs = spark.read.parquet(f"{folder}/docs")
    want = {q: [tuple(r) for r in tx.search(docs, q, k=600).select("doc_id", "score").collect()] for q in (f"{RARE} {COMMON}", COMMON)}
    tx.write_index(docs, f"{folder}/index", buckets=8)
    shutil.rmtree(f"{folder}/docs")  # a search needs no text
    return f"{folder}/index", want


def test_index_pages_match_a_scan(spark, texts):
    path, want = texts
    for query, rows in want.items():
        rows = sorted(rows, key=lambda r: (-round(r[1], 9), r[0]))
        for k, offset in ((5, 0), (7, 20)):
            got = tx.search_index(spark, path, query, k, offset).collect()
            assert [(r.doc_id, pytest.approx(r.score)) for r in got] == rows[offset: offset + k]
    assert tx.search_index(spark, path, "unknown of the").collect() == []


def test_search_reads_the_folders_of_its_terms(spark, texts):
    path, _ = texts
    blocks = tx.index_blocks(spark, path, [RARE])
    read = {r[0].split("bucket=")[1].split("/")[0] for r in blocks.select(F.input_file_name()).distinct().collect()}
    assert {r.term for r in blocks.collect()} == {RARE} and len(read) == 1
    assert spark.read.parquet(f"{path}/blocks").select("bucket").distinct().count() > 1


def test_groups_that_cannot_reach_the_page_are_left_out(spark, texts, monkeypatch):
    path, want = texts
    monkeypatch.setattr(tx, "FIRST_GROUPS", 2)
    read = []
    explode = F.explode
    monkeypatch.setattr(tx.F, "explode", lambda c: read.append(c) or explode(c))
    rows = sorted(want[f"{RARE} {COMMON}"], key=lambda r: (-round(r[1], 9), r[0]))[:2]
    got = tx.search_index(spark, path, f"{RARE} {COMMON}", 2)
    assert [r.doc_id for r in got.collect()] == [i for i, _ in rows] and len(read) == 2  # first and live groups
    joined = {r.group for r in tx.index_blocks(spark, path, [RARE]).collect()}
    assert len(joined) < 16  # a block per group of the word's documents only


def test_texts_move_once_for_their_postings(spark):
    """One shuffle, of the texts; rows of one id are one document, as are those without an id."""
    made = [(1, "red cards and red limits"), (1, "red"), (None, "blue cards"), (None, "blue"), (2, None), (3, "the")]
    found = tx.measured_postings(spark.createDataFrame(made, "doc_id long, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = sorted(((r.doc_id or 0), r.term, r.tf, r.len) for r in found.collect())
    assert got == [(0, "blue", 2, 3), (0, "card", 1, 3), (1, "card", 1, 5), (1, "limit", 1, 5), (1, "red", 3, 5)]
