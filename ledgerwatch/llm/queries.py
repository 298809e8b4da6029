"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op9_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op5_chat_formatting")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.chat import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr(
        "-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text"
    )
    return chat(rows.unionByName(extra))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_token_output")
def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.records import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
""")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.warc import warc

    return warc(table(spark, sf_dir, "pages"))


@query("op6_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.quality import quality, train

    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))


@query("op10_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.decontaminate import find_overlaps

    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), percent=85)


@query("op2_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.ngrams import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), order=3)


#: Shares of the expected tokens that op3 and the pipeline aim at.
MIX, PIPELINE_MIX = {"clean": 0.90, "junk": 0.08, "toxic": 0.02}, {"clean": 1.0, "toxic": 0.0}


@query("op3_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.mixing import label_domains, mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIX)


@query("op1_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).drop("starts", "ends")


@query("op12_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def misspelt(doc_id, run):
    """The run, without one of its letters where the hash of id and run is a multiple of 199 (a null id is empty)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    n = F.length(run)
    at = F.pmod(h, n.cast("long")).cast("int")
    return F.when(F.pmod(h, F.lit(199)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, n))).otherwise(run)


@query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), misspelt)


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id, text, where the words of a tenth of the ids (a null id is empty) get a periodic end, joined by one blank."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    dealt = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(F.pmod(h, F.lit(10)) == 0, words).alias("words"))
    n, g = F.size("words").cast("long"), F.col("g")
    a = F.pmod(g, n)
    p = F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1
    told = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
    return dealt.select("doc_id", F.when(n > 0, F.array_join(told, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwatch.llm.periodic import periodic_runs

    return periodic_runs(made_periodic(table(spark, sf_dir, "documents"))).drop("runs", "collapsed", "n_words")
