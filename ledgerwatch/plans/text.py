"""Text queries over the whole documents."""

from pyspark.sql import functions as F

from ledgerwatch.operators import text as tx
from ledgerwatch.plans.registry import cte, query
from ledgerwatch.sources.files import scratch

STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def words_sql(text: str) -> str:
    return r"list_filter(string_split_regex(lower(" + text + r"), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def terms_sql(text: str) -> str:
    return r"[regexp_replace(w, '^(.{3,}?)(ing|ed|es|s)$', '\1') FOR w IN " + words_sql(text) + f" IF w NOT IN ({STOPS})]"


cte("analysed", f"SELECT doc_id, text, {terms_sql('text')} AS terms FROM documents")

QUERY = "ther tions than"
LIST = ["ther", "tion", "than"]


def tf(term: str) -> str:
    return f"len(list_filter(terms, lambda t: t = '{term}'))"


@query("TXT-1", uses="analysed", sql="""
SELECT term, COUNT(DISTINCT doc_id) AS docs, CAST(COUNT(*) AS BIGINT) AS occurrences FROM (SELECT doc_id, unnest(terms) AS term FROM analysed) GROUP BY 1
""")
def txt_1(t):
    return tx.postings(t.raw("documents")).groupBy("term").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("occurrences")
    )


@query("TXT-2", uses="tx merchants", rounded="relevance_score", sql=f"""
WITH d AS (SELECT transaction_id, ts, {terms_sql("concat_ws(' ', 'user', CAST(user_id AS VARCHAR), 'merchant', CAST(merchant_id AS VARCHAR), COALESCE(merchant_name, ''), COALESCE(merchant_category, ''), country)")} AS terms
  FROM tx LEFT JOIN merchants USING (merchant_id))
SELECT transaction_id, ts, ({tf('crypto')} + {tf('supplier')} + {tf('nation')}) / len(terms) AS relevance_score FROM d WHERE {tf('crypto')} > 0 AND {tf('supplier')} > 0 AND {tf('nation')} > 0
ORDER BY relevance_score DESC, ts DESC, transaction_id LIMIT 100
""")
def txt_2(t):
    joined = t.tx.join(t.merchants, "merchant_id", "left")
    fields = F.concat_ws(
        " ", F.lit("user"), F.col("user_id").cast("string"), F.lit("merchant"), F.col("merchant_id").cast("string"),
        F.coalesce("merchant_name", F.lit("")), F.coalesce("merchant_category", F.lit("")), F.col("country"),
    )
    return tx.match_all(joined, "Crypto Suppliers in the Nations", fields, "ts", "transaction_id").select("transaction_id", "ts", "relevance_score")


def bm25(i: int, term: str) -> str:
    return (f"ln(1 + (n - d{i} + 0.5e0) / (d{i} + 0.5e0)) * {tf(term)} * 2.2e0 / ({tf(term)} + 1.2e0 * (0.25e0 + 0.75e0 * len(terms) / mean))")


cte("hits", f"""
SELECT doc_id, text, {" + ".join(bm25(i, q) for i, q in enumerate(LIST))} AS score FROM analysed,
 (SELECT COUNT(*) AS n, AVG(len(terms)) AS mean, {", ".join(f"COUNT(*) FILTER (WHERE {tf(q)} > 0) AS d{i}" for i, q in enumerate(LIST))} FROM analysed)
WHERE {" OR ".join(f"{tf(q)} > 0" for q in LIST)} ORDER BY ROUND(score, 9) DESC, doc_id LIMIT 50 OFFSET 10
""")


def found(t):
    """Index the texts, then search the index alone."""
    path = scratch(t.spark, "text-index")
    tx.write_index(t.raw("documents"), path)
    return tx.search_index(t.spark, path, QUERY, 50, 10)


@query("TXT-3", uses="analysed hits", rounded="score", sql="SELECT doc_id, score FROM hits")
def txt_3(t):
    return found(t)


@query("TXT-4", uses="analysed hits", sql=f"""
SELECT doc_id, CAST(len(list_filter({words_sql('text')}, lambda w: w IN ('ther', 'tion', 'than'))) AS BIGINT) AS marks FROM hits
""")
def txt_4(t):
    marked = tx.highlight(F.col("text"), LIST)
    page = t.raw("documents").select("doc_id", "text").join(F.broadcast(found(t).select("doc_id")), "doc_id")
    return page.select("doc_id", ((F.length(marked) - F.length("text")) / 9).cast("long").alias("marks"))


TRI = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, len(w) + 2)] FOR w IN string_split(lower(name), ' ')]))"


@query("TXT-5", uses="", rounded="similarity", sql=f"""
WITH n AS (SELECT name, {TRI} AS t FROM (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part))
SELECT * FROM (SELECT x.name AS a, y.name AS b, len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS similarity FROM n x JOIN n y ON x.name < y.name) WHERE similarity >= 0.5
""")
def txt_5(t):
    names = t.raw("part").select(F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return tx.similar_names(names, 0.5)
