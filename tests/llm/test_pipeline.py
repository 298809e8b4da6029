import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from ledgerwatch.llm.common import materialize
from ledgerwatch.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.llm.plain import shingles, tokens
from tests.llm.test_models import plain_overlaps

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and what it made, at the smallest scale."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), "test-stage")
        found.append((docs, out))
        docs = out
    return found


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *QUERIES} <= names and len(QUERIES) == 10 and set(ORACLES) <= set(entry.oracle_sql())
    assert 4 <= len(pipeline.STAGES) <= 5


def test_all_but_the_last_return_documents(stages):
    assert all(out.columns == COLUMNS for _, out in stages[:-1])


def test_quality_keeps_good_documents(spark, stages):
    given, kept = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in stages[0])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {d for d in given if labels.get(d) == 1}
    assert kept < given and len(good - kept) <= 0.02 * len(good)
    assert not {d for d in kept if labels.get(d) == 0} or len({d for d in kept if labels.get(d) == 0}) <= 2


def test_near_copies_leave_one_each(stages):
    given, kept = ({r["doc_id"]: shingles(r["text"]) for r in x.collect()} for x in stages[1])
    up = {d: d for d in given}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(given)
    for a in ids:
        for b in ids:
            x, y = given[a], given[b]
            if a < b and x and y and 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y):
                u, v = sorted((find(a), find(b)))
                up[v] = u
    assert set(kept) == {d for d in ids if find(d) == d}


def test_leaks_go_and_the_rest_stays(spark, stages):
    given, kept = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    clean = {d for d, dirty, _ in plain_overlaps(rows, items) if not dirty}
    assert {r["doc_id"] for r in kept.collect()} == clean


def test_mixing_keeps_clean_documents(spark, stages):
    given, kept = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in stages[3])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = {d for d in given if labels.get(d) == 0}
    assert len(clean - kept) <= 0.03 * len(clean)


def test_mixing_leaves_no_toxic_documents(spark, stages):
    from ledgerwatch.llm import mixing
    from ledgerwatch.llm.queries import PIPELINE_MIX

    given, kept = stages[3]
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"), junk=False)
    rates = mixing.mix_sources(given, labels, PIPELINE_MIX, keep="clean", whole=True).collect()
    assert all(r["rate"] == (r["p_clean"] >= r["p_toxic"]) == r["copies"] for r in rates)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rates if r["p_clean"] >= r["p_toxic"])
    toxic = {r["doc_id"] for r in labels.where("domain = 'toxic'").collect()}
    passed = {r["doc_id"] for r in kept.select("doc_id").collect()} & toxic
    assert len(passed) <= 0.02 * len(toxic & {r["doc_id"] for r in rates})


@pytest.mark.parametrize("bad", [0, 20, 400, 2000])
def test_mixing_whatever_share_is_toxic(spark, tmp_path, bad):
    rows = [(k, f"{'vile' if k < bad else 'kind'} words of text number {k} here", "en", "s", 30) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 1, int(k < bad)) for k in range(2000)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r["doc_id"] for r in pipeline.mixing_stage(spark, docs, str(tmp_path)).collect()) == list(range(bad, 2000))


def test_last_stage_encodes_every_row(stages):
    from tokenizers import Tokenizer

    from ledgerwatch.llm.queries import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    given, out = stages[4]
    want = sorted((r["doc_id"], zlib.crc32(np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in given.collect())
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in out.collect()) == want


def test_stages_with_odd_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "no id at all", "en", "s", 3), (4, "same text " * 30, "en", "s", 1), (4, "same text " * 30, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == COLUMNS and out.count() <= 2 * len(rows), name
    assert [r["doc_id"] for r in pipeline.near_dedup_stage(spark, docs, SF).where("doc_id = 4").collect()] == [4]
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT * FROM ({ORACLES[name]})")
    assert sorted(d[0] for d in want.description) == columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in found.select(*columns).collect()) == sorted(map(repr, want))


def test_nothing_else_imports_the_subpackage():
    import pathlib

    top = pathlib.Path(entry.__file__).parent
    for path in top.rglob("*.py"):
        inside = path.relative_to(top).as_posix()
        if not inside.startswith(("ledgerwatch/llm/", "tests/llm/")) and inside not in ("corpus_pipeline.py", "__spark_entry__.py"):
            assert not re.search(r"\bllm\b", path.read_text()), inside


def test_texts_have_words():
    assert tokens("A\x0bb c D") == ["a", "b c", "d"]
