"""Text search over documents ``(doc_id, text)``: whole texts, tokenised by column expressions."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import col
from ledgerwatch.sources.files import written

# English stop words of the standard search analyser.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this "
    "to was will with"
).split()

SEPARATORS = r"[^\p{L}\p{N}]+"


def words(text) -> Column:
    return F.filter(F.split(F.lower(col(text)), SEPARATORS), lambda w: w != "")


def stem(word: Column) -> Column:
    """Light English suffix rules: drop ing, ed, es or s if three letters stay."""
    n = F.length(word)

    def drop(suffix: str) -> Column:
        return word.endswith(suffix) & (n >= len(suffix) + 3)

    def cut(k: int) -> Column:
        return F.substring(word, F.lit(1), n - k)

    return F.when(drop("ing"), cut(3)).when(drop("ed") | drop("es"), cut(2)).when(drop("s"), cut(1)).otherwise(word)


def terms(text) -> Column:
    """Lower-case stemmed words without stop words, as an array: for short fields."""
    return F.transform(F.filter(words(text), lambda w: ~w.isin(STOP_WORDS)), stem)


def term_rows(docs: DataFrame, doc_id: str = "doc_id", text="text") -> DataFrame:
    """One row per term occurrence: for long texts, where generated code on rows beats array functions."""
    split = docs.select(doc_id, F.explode(F.split(F.lower(col(text)), SEPARATORS)).alias("_w"))
    kept = split.filter((F.col("_w") != "") & ~F.col("_w").isin(STOP_WORDS))
    return kept.select(doc_id, stem(F.col("_w")).alias("term"))


def query_terms(df: DataFrame, query: str) -> list[str]:
    """The query analysed like a document (one row on the driver)."""
    found = df.sparkSession.range(1).select(F.array_distinct(terms(F.lit(query))).alias("t")).first()["t"]
    return list(found)


def postings(docs: DataFrame, doc_id: str = "doc_id", text="text") -> DataFrame:
    """Term, document and term frequency."""
    return term_rows(docs, doc_id, text).groupBy("term", doc_id).agg(F.count(F.lit(1)).alias("tf"))


def measured_postings(docs: DataFrame, doc_id: str = "doc_id", text="text") -> DataFrame:
    """Postings with the number of terms of the document.

    The texts move once, by document, which is less than their terms twice; terms are counted and added up where they are.
    """
    dealt = docs.select(F.col(doc_id), col(text).alias("_text")).repartition(doc_id)
    return postings(dealt, doc_id, "_text").withColumn("len", F.sum("tf").over(Window.partitionBy(doc_id)))


def _count(term: str) -> Column:
    return F.size(F.filter("_terms", lambda t: t == F.lit(term)))


def _counts(query: Sequence[str]) -> list[Column]:
    return [_count(q).alias(f"_tf{i}") for i, q in enumerate(query)]


def _analysed(docs: DataFrame, query: Sequence[str], text) -> DataFrame:
    tagged = docs.withColumn("_terms", terms(text))
    return tagged.select("*", F.size("_terms").alias("_len"), *_counts(query)).drop("_terms")


def match_all(docs: DataFrame, query: str, text, newest: str, doc_id: str, k: int = 100) -> DataFrame:
    """Documents that hold every query term, by term density, then newest.  One scan, no shuffle before the top-k."""
    wanted = query_terms(docs, query)
    found = _analysed(docs, wanted, text)
    total = F.lit(0)
    for i in range(len(wanted)):
        found = found.filter(F.col(f"_tf{i}") > 0)
        total = total + F.col(f"_tf{i}")
    ranked = found.withColumn("relevance_score", total / F.col("_len")).drop("_len", *[f"_tf{i}" for i in range(len(wanted))])
    return ranked.orderBy(F.desc("relevance_score"), F.desc(newest), doc_id).limit(k)


def search(
    docs: DataFrame, query: str, text="text", doc_id: str = "doc_id", k: int = 100, offset: int = 0, k1: float = 1.2,
    b: float = 0.75, sort: Sequence[Column] | None = None,
) -> DataFrame:
    """Documents with any query term, scored by BM25.

    Term occurrences are reduced to one row per document before the shuffle; the collection's figures come from the
    same rows, and the texts are joined to the final page only.
    """
    wanted = query_terms(docs, query)
    per_doc = term_rows(docs, doc_id, text).groupBy(doc_id).agg(
        F.count(F.lit(1)).alias("_len"), *[F.count_if(F.col("term") == q).alias(f"_tf{i}") for i, q in enumerate(wanted)]
    )
    stats = per_doc.agg(
        F.struct(F.sum("_len").alias("words"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]).alias("s")
    ).scalar()
    n = docs.agg(F.count(F.lit(1))).scalar()
    mean = stats["words"] / n
    score, any_hit = F.lit(0.0), F.lit(False)
    for i in range(len(wanted)):
        idf = F.log(1 + (n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col(f"_tf{i}").cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / mean))
        any_hit = any_hit | (F.col(f"_tf{i}") > 0)
    scored = per_doc.filter(any_hit).select(doc_id, score.alias("score"))
    order = list(sort) if sort else [F.desc("score"), F.col(doc_id)]
    page = scored.orderBy(*order).offset(offset).limit(k)
    return docs.join(page, doc_id)


# ---- stored postings ------------------------------------------------------------------------

#: Documents of one block of a term, at most some; groups of documents that are looked at before the threshold is known.
BLOCK_DOCS, FIRST_GROUPS = 50_000, 8
SATURATION, NORM = 1.2, 0.75
BLOCKS = "term string, `group` long, n long, top double, docs array<struct<doc_id:long,tf:long,len:long>>, bucket int"


def write_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text="text", buckets: int = 64) -> None:
    """An inverted index at ``path``: ``blocks`` of postings by hash of the term, and ``figures`` of the collection.

    Documents are dealt to groups by hash; a block has a term's documents of one group with the term's count and the length,
    and ``top``, the largest part of a BM25 score (without the term's weight) any of them can have. So a very common term
    is many rows of bounded size. Texts are read and tokenised once, here.
    """
    spark = docs.sparkSession
    per = written(measured_postings(docs, doc_id, text), "postings")
    n = docs.count()
    words = per.agg(F.sum("tf")).first()[0] or 0
    spark.createDataFrame([(n, words, buckets)], "docs long, words long, buckets int").write.mode("overwrite").parquet(f"{path}/figures")
    mean, groups = words / max(n, 1), max(16, n // BLOCK_DOCS)
    part = F.col("tf") / (F.col("tf") + SATURATION * (1 - NORM + NORM * F.col("len") / F.lit(mean or 1.0)))
    blocks = per.groupBy("term", F.pmod(F.xxhash64(doc_id), F.lit(groups)).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.max(part).alias("top"), F.collect_list(F.struct(F.col(doc_id).cast("long").alias("doc_id"), "tf", "len")).alias("docs")
    )
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    spread = blocks.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "group")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")


def index_blocks(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """The blocks of some terms: only the folders of their hashes are listed, only their row groups read."""
    buckets = spark.read.parquet(f"{path}/figures").first()["buckets"]
    dealt = spark.createDataFrame([(w,) for w in wanted], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return blocks.where(F.col("bucket").isin([r[0] for r in dealt.collect()]) & F.col("term").isin(list(wanted)))


def search_index(spark: SparkSession, path: str, query: str, k: int = 100, offset: int = 0) -> DataFrame:
    """(doc_id, score) of the best documents with any query term by BM25, then the smallest ``doc_id``, from a written index.

    A group of documents can't score above the sum of its blocks' tops. The groups with the highest sums are scored first;
    the score that the page needs then rules out all groups whose sum is lower, and only the others' postings are read.
    """
    wanted = query_terms(spark.range(0), query)
    blocks, figures = index_blocks(spark, path, wanted), spark.read.parquet(f"{path}/figures").first()
    heads = blocks.select("term", "group", "n", "top")
    known = heads.groupBy("term").agg(F.sum("n").alias("df")).withColumn(
        "weight", F.log(1 + (figures["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (SATURATION + 1)
    )
    weights = F.broadcast(known.select("term", "weight"))  # a row per query term
    bounds = written(heads.join(weights, "term").groupBy("group").agg(F.sum(F.col("top") * F.col("weight")).alias("bound")), "search-bounds")
    norm = SATURATION * (1 - NORM + NORM * F.col("p.len") / F.lit(figures["words"] / max(figures["docs"], 1) or 1.0))

    def scored(groups: DataFrame) -> DataFrame:
        hits = blocks.join(weights, "term").join(groups.select("group"), "group", "left_semi").select("weight", F.explode("docs").alias("p"))
        return hits.groupBy("p.doc_id").agg(F.sum(F.col("weight") * F.col("p.tf") / (F.col("p.tf") + norm)).alias("score"))

    order = [F.desc(F.round("score", 9)), F.col("doc_id")]
    first = scored(bounds.orderBy(F.desc("bound"), "group").limit(FIRST_GROUPS)).orderBy(*order).limit(offset + k)
    found, least = first.agg(F.count(F.lit(1)), F.min("score")).first()
    live = bounds if found < offset + k else bounds.where(F.col("bound") >= least - 1e-6)
    return scored(live).orderBy(*order).offset(offset).limit(k)


def highlight(text: Column, query: Sequence[str], before: str = "<em>", after: str = "</em>") -> Column:
    """The text with every whole query word marked (case-insensitive)."""
    choices = "|".join(re.escape(w) for w in sorted(query, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({choices})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}")


# ---- trigrams -------------------------------------------------------------------------------

def trigrams(name) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one after."""
    def of_word(w):
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3))

    return F.array_distinct(F.flatten(F.transform(words(name), of_word)))


def trigram_lookup(names: DataFrame, probe: str, min_similarity: float = 0.3, column: str = "name", k: int = 10) -> DataFrame:
    """Names similar to one probe: a scan with a top-k."""
    target = trigrams(F.lit(probe))
    tagged = names.withColumns({"_t": trigrams(column), "_p": target})
    shared = F.size(F.array_intersect("_t", "_p"))
    ratio = shared / F.size(F.array_union("_t", "_p"))
    return tagged.withColumn("similarity", ratio).drop("_t", "_p").filter(F.col("similarity") >= min_similarity).orderBy(
        F.desc("similarity"), column
    ).limit(k)


def similar_names(names: DataFrame, min_similarity: float = 0.3, column: str = "name") -> DataFrame:
    """All pairs of distinct names with Jaccard trigram similarity of at least ``min_similarity``.

    Prefix filter: two sets that similar share one of their ``n - ceil(s n) + 1`` rarest trigrams, so frequent
    trigrams never become join keys for long names.
    """
    distinct = names.select(F.col(column).alias("name")).filter(F.col("name").isNotNull()).distinct()
    sets = distinct.withColumn("t", trigrams("name")).filter(F.size("t") > 0)
    grams = sets.select("name", F.explode("t").alias("g"))
    rarity = grams.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    ordered = grams.join(rarity, "g").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("r"))
    size = F.size("r")
    keep = size - F.ceil(F.lit(min_similarity) * size - 1e-9).cast("int") + 1
    prefix = ordered.select("name", F.transform("r", lambda x: x["g"]).alias("t"), F.explode(F.slice("r", F.lit(1), keep)).alias("p"))
    left = prefix.select(F.col("name").alias("a"), F.col("t").alias("ta"), F.col("p.g").alias("g"))
    right = prefix.select(F.col("name").alias("b"), F.col("t").alias("tb"), F.col("p.g").alias("g"))
    pairs = left.join(right, "g").filter(F.col("a") < F.col("b"))
    shared = F.size(F.array_intersect("ta", "tb"))
    scored = pairs.select("a", "b", (shared / (F.size("ta") + F.size("tb") - shared)).alias("similarity"))
    return scored.filter(F.col("similarity") >= min_similarity).distinct()
