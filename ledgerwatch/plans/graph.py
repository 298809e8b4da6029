"""Graph queries."""

from pyspark.sql import functions as F

from ledgerwatch.operators import graph as gr
from ledgerwatch.plans.registry import cte, query

DAY = 86400
#: Bound of the error of a normalised betweenness.
ERROR = 0.03
#: GRA-9 leaves a level when a sweep adds less modularity than this.
SETTLED = 1e-3


def built(t):
    return gr.build_graph(t.tx_merchant, t.users)


def trade(t):
    """Distinct user - merchant edges with their number of transactions."""
    return t.tx_merchant.groupBy("user_id", "merchant_id").agg(F.count(F.lit(1)).cast("double").alias("w")).select(
        gr.node_id("u", "user_id").alias("src"), gr.node_id("m", "merchant_id").alias("dst"), "w"
    )


def communal(t):
    """User - merchant and user - device edges with their number of transactions: the graph of the communities."""
    devices = t.tx_merchant.groupBy("user_id", "device_id").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return trade(t).unionByName(devices.select(gr.node_id("u", "user_id").alias("src"), gr.node_id("d", "device_id").alias("dst"), "w"))


def entity(t):
    """Edges among users, devices and merchants: the graph that has triangles."""
    tx = t.tx_merchant
    u, m, d = gr.node_id("u", "user_id"), gr.node_id("m", "merchant_id"), gr.node_id("d", "device_id")
    pairs = [tx.select(u.alias("src"), m.alias("dst")), tx.select(u.alias("src"), d.alias("dst")), tx.select(d.alias("src"), m.alias("dst"))]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()


cte("trade", """
SELECT concat('u:', CAST(user_id AS VARCHAR)) AS src, concat('m:', CAST(merchant_id AS VARCHAR)) AS dst, CAST(COUNT(*) AS DOUBLE) AS w FROM tx GROUP BY user_id, merchant_id
""")
cte("entity", """
SELECT DISTINCT concat('u:', CAST(user_id AS VARCHAR)) AS src, concat('m:', CAST(merchant_id AS VARCHAR)) AS dst FROM tx
UNION ALL SELECT DISTINCT concat('u:', CAST(user_id AS VARCHAR)), concat('d:', device_id) FROM tx
UNION ALL SELECT DISTINCT concat('d:', device_id), concat('m:', CAST(merchant_id AS VARCHAR)) FROM tx
""")
cte("edges", """
SELECT concat('u:', CAST(user_id AS VARCHAR)) AS src, concat('t:', transaction_id) AS dst, 'MADE_TRANSACTION' AS type, 1 AS frequency, amount, ts AS first_ts, ts AS last_ts FROM tx
UNION ALL SELECT concat('t:', transaction_id), concat('m:', CAST(merchant_id AS VARCHAR)), 'PAID_TO', 1, amount, ts, ts FROM tx
UNION ALL SELECT concat('u:', CAST(user_id AS VARCHAR)), concat('d:', device_id), 'USED_DEVICE', COUNT(*), SUM(amount), MIN(ts), MAX(ts) FROM tx GROUP BY user_id, device_id
UNION ALL SELECT concat('u:', CAST(user_id AS VARCHAR)), concat('m:', CAST(merchant_id AS VARCHAR)), 'CUSTOMER_OF', COUNT(*), SUM(amount), MIN(ts), MAX(ts) FROM tx GROUP BY user_id, merchant_id
""")
cte("nodes", """
SELECT concat('u:', CAST(user_id AS VARCHAR)) AS id, 'User' AS type, risk_score FROM users
UNION ALL SELECT concat('m:', CAST(merchant_id AS VARCHAR)), 'Merchant', AVG(fraud_score) FROM tx GROUP BY merchant_id
UNION ALL SELECT DISTINCT concat('d:', device_id), 'Device', NULL FROM tx
UNION ALL SELECT concat('t:', transaction_id), 'Transaction', fraud_score FROM tx
""")


@query("GRA-1", uses="tx users edges nodes", rounded="amount risk", places=4, sql="""
SELECT 'edge' AS kind, type, COUNT(*) AS n, COUNT(DISTINCT src) AS sources, COUNT(DISTINCT dst) AS targets, CAST(SUM(frequency) AS BIGINT) AS frequency, SUM(amount) AS amount, NULL::DOUBLE AS risk FROM edges GROUP BY type
UNION ALL SELECT 'node', type, COUNT(*), COUNT(DISTINCT id), 0, 0, NULL, AVG(risk_score) FROM nodes GROUP BY type
""")
def gra_1(t):
    nodes, edges = built(t)
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    e = edges.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"),
        F.sum("frequency").alias("frequency"), F.sum("amount").alias("amount"),
    ).withColumns({"kind": F.lit("edge"), "risk": none})
    n = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("sources"), F.avg("risk_score").alias("risk"))
    return e.unionByName(n.withColumns({"kind": F.lit("node"), "targets": zero, "frequency": zero, "amount": none}))


@query("GRA-2", uses="tx users", rounded="risk_score", sql="""
SELECT 'node' AS kind, concat('u:', CAST(user_id AS VARCHAR)) AS id, CASE WHEN user_id % 7 = 2 THEN 0.99e0 ELSE risk_score END AS risk_score, 0 AS links FROM users WHERE user_id % 11 <> 5
UNION ALL SELECT 'node', concat('n:', CAST(user_id AS VARCHAR)), 0.5e0, 0 FROM users WHERE user_id % 13 = 1
UNION ALL SELECT 'edge', concat('d:', device_id), NULL, COUNT(DISTINCT user_id) FROM tx WHERE user_id % 11 <> 5 GROUP BY device_id
""")
def gra_2(t):
    users = t.users.select(gr.node_id("u", "user_id").alias("id"), F.lit("User").alias("type"), "risk_score", "user_id")
    nodes = users.drop("user_id")
    edges = t.tx_slim.select(gr.node_id("u", "user_id").alias("src"), gr.node_id("d", "device_id").alias("dst"), F.lit("USED_DEVICE").alias("type")).distinct()
    change = lambda cond, op, seq, score: users.filter(cond).select("id", "type", score.alias("risk_score"), F.lit(op).alias("op"), F.lit(seq).alias("seq"))
    k = F.col("user_id")
    log = (
        change(k % 7 == 2, "UPDATE", 1, F.lit(0.1)).unionByName(change(k % 7 == 2, "UPDATE", 3, F.lit(0.99)))
        .unionByName(change(k % 11 == 5, "INSERT", 2, F.lit(0.4))).unionByName(change(k % 11 == 5, "DELETE", 9, F.lit(0.4)))
        .unionByName(users.filter(k % 13 == 1).select(gr.node_id("n", "user_id").alias("id"), "type", F.lit(0.5).alias("risk_score"), F.lit("INSERT").alias("op"), F.lit(4).alias("seq")))
    )
    out_nodes, out_edges = gr.sync_graph(nodes, edges, log)
    n = out_nodes.select(F.lit("node").alias("kind"), "id", "risk_score", F.lit(0).cast("long").alias("links"))
    e = out_edges.groupBy("dst").agg(F.count_distinct("src").alias("links")).select(
        F.lit("edge").alias("kind"), F.col("dst").alias("id"), F.lit(None).cast("double").alias("risk_score"), "links"
    )
    return n.unionByName(e)


@query("GRA-3", uses="tx users", rounded="risk_score avg_risk_score confidence", sql="""
WITH m AS (SELECT DISTINCT device_id, user_id, risk_score FROM tx JOIN users USING (user_id) WHERE risk_score >= 0.5),
r AS (SELECT device_id, COUNT(*) AS user_count, AVG(risk_score) AS avg_risk_score FROM m GROUP BY 1 HAVING COUNT(*) >= 2 ORDER BY ROUND(AVG(risk_score), 9) DESC, user_count DESC, device_id LIMIT 50)
SELECT 'device_sharing_' || device_id AS ring_id, user_id, risk_score, user_count, avg_risk_score, LEAST(avg_risk_score * user_count / 10, 1) AS confidence FROM m JOIN r USING (device_id)
""")
def gra_3(t):
    return gr.device_rings(t.tx_slim, t.users)


cte("rings4", """
SELECT 'device_' || device_id AS ring_id, device_id, COUNT(DISTINCT user_id) AS user_count, AVG(fraud_score) AS avg_fraud_score, SUM(amount) AS total_amount FROM tx
WHERE fraud_score > 0.6 GROUP BY device_id HAVING COUNT(DISTINCT user_id) >= 2 AND ROUND(AVG(fraud_score), 9) > 0.7e0 ORDER BY ROUND(AVG(fraud_score), 9) DESC, device_id LIMIT 5
""")


@query("GRA-4", uses="tx rings4", rounded="avg_fraud_score total_amount", places=4, sql="SELECT * FROM rings4")
def gra_4(t):
    return gr.transaction_device_rings(t.tx_slim)


@query("GRA-5", uses="tx", rounded="avg_fraud_score total_amount", places=4, sql="""
SELECT 'suspicious' AS kind, user_id, AVG(fraud_score) AS avg_fraud_score, COUNT(*) AS transaction_count, SUM(amount) AS total_amount FROM tx WHERE fraud_score > 0.7 GROUP BY user_id
HAVING COUNT(*) > 5 AND COUNT(*) FILTER (WHERE is_fraud) > 0
UNION ALL SELECT * FROM (SELECT 'top', user_id, AVG(fraud_score) AS a, COUNT(*), SUM(amount) FROM tx WHERE fraud_score > 0.8 AND is_fraud GROUP BY user_id ORDER BY ROUND(AVG(fraud_score), 9) DESC, user_id LIMIT 10)
""")
def gra_5(t):
    s = gr.suspicious_users(t.tx_slim).drop("fraud_count").withColumn("kind", F.lit("suspicious"))
    return s.unionByName(gr.top_fraud_users(t.tx_slim).withColumn("kind", F.lit("top")))


@query("GRA-6", uses="tx users", sql="""
WITH RECURSIVE e AS (SELECT DISTINCT concat('u:', CAST(user_id AS VARCHAR)) AS a, concat('c:', country, ':', CAST(user_id % 29 AS VARCHAR)) AS b FROM tx WHERE fraud_score > 0.6),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS id, a AS seen FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.seen = s.a),
l AS (SELECT id, MIN(seen) AS component FROM r GROUP BY id)
SELECT id, component, COUNT(*) OVER (PARTITION BY component) AS size, LEAST(1e0, COUNT(*) OVER (PARTITION BY component) / 20e0) AS confidence FROM l QUALIFY COUNT(*) OVER (PARTITION BY component) >= 3
""", rounded="confidence")
def gra_6(t):
    place = F.concat(F.lit("c:"), "country", F.lit(":"), (F.col("user_id") % 29).cast("string"))
    edges = t.tx_place.filter(F.col("fraud_score") > 0.6).select(gr.node_id("u", "user_id").alias("src"), place.alias("dst")).distinct()
    return gr.component_rings(edges).select("id", "component", "size", "confidence")


@query("GRA-7", uses="tx lim", rounded="avg_fraud_score confidence", sql="""
WITH p AS (SELECT user_id, merchant_id, COUNT(*) AS n, AVG(fraud_score) AS s, COUNT(*) >= 2 AND ROUND(AVG(fraud_score), 9) > 0.6e0 AS f FROM tx, lim WHERE ts > as_of - INTERVAL 1500 DAY GROUP BY 1, 2),
r AS (SELECT merchant_id, AVG(s) FILTER (WHERE f) AS avg_fraud_score, COUNT(*) AS user_count FROM p GROUP BY 1 HAVING COUNT(*) FILTER (WHERE f) >= 1 AND COUNT(*) >= 2 ORDER BY ROUND(avg_fraud_score, 9) DESC, user_count DESC, merchant_id LIMIT 20)
SELECT 'velocity_' || CAST(merchant_id AS VARCHAR) AS ring_id, user_id, f AS is_fast, user_count, avg_fraud_score, LEAST(avg_fraud_score * user_count / 5, 1) AS confidence FROM p JOIN r USING (merchant_id)
""")
def gra_7(t):
    return gr.velocity_rings(t.tx_merchant, 1500 * DAY, 2)


def user_risk(t):
    return t.users.select(gr.node_id("u", "user_id").alias("id"), "risk_score")


@query("GRA-8")
def gra_8(t):
    """Label-propagation rings (iterative: see the tests)."""
    return gr.community_rings(gr.label_propagation(communal(t)), user_risk(t))


@query("GRA-9")
def gra_9(t):
    """Louvain rings (iterative: see the tests)."""
    return gr.community_rings(gr.louvain(communal(t), weight=F.col("w"), tolerance=SETTLED), user_risk(t))


@query("GRA-10", uses="tx edges", rounded="strength", sql="""
SELECT src, dst, type, (LEAST(COUNT(*) / 10e0, 1) + LEAST(AVG(amount) / 1000, 1) + LEAST(MAX(frequency) / 50e0, 1) + LEAST(CAST(floor((epoch(MAX(last_ts)) - epoch(MIN(first_ts))) / 86400) AS BIGINT) / 365e0, 1)) / 4 AS strength
FROM edges GROUP BY 1, 2, 3
""")
def gra_10(t):
    return gr.relationship_strength(built(t)[1])


@query("GRA-11", uses="tx trade", sql="""
WITH h1 AS (SELECT src, dst FROM trade WHERE src = (SELECT MIN(src) FROM trade)), h2 AS (SELECT src, dst FROM trade WHERE dst IN (SELECT dst FROM h1))
SELECT src, dst, 'CUSTOMER_OF' AS type, CAST(CASE WHEN src = (SELECT MIN(src) FROM trade) THEN 1 ELSE 2 END AS INTEGER) AS hop FROM h2
""")
def gra_11(t):
    edges = trade(t).select("src", "dst", F.lit("CUSTOMER_OF").alias("type"))
    return gr.entity_network(edges, edges.agg(F.min("src").alias("id")))


cte("sym", "SELECT src, dst FROM entity UNION SELECT dst, src FROM entity")
cte("deg", "SELECT src, COUNT(*) AS d FROM sym GROUP BY 1")


@query("GRA-12", uses="tx entity sym deg", rounded="neighbor_degree_avg degree_centrality", sql="""
SELECT src AS id, (SELECT COUNT(*) FROM entity e WHERE e.src = a.src) AS out_degree, (SELECT COUNT(*) FROM entity e WHERE e.dst = a.src) AS in_degree, ANY_VALUE(a.d) AS degree, AVG(b.d) AS neighbor_degree_avg,
  MAX(b.d) AS neighbor_degree_max, MIN(b.d) AS neighbor_degree_min, ANY_VALUE(a.d) / ((SELECT COUNT(*) FROM deg) - 1) AS degree_centrality
FROM deg a JOIN sym USING (src) JOIN deg b ON b.src = sym.dst GROUP BY 1
""")
def gra_12(t):
    return gr.degrees(entity(t)).select(
        "id", "out_degree", "in_degree", "degree", "neighbor_degree_avg", "neighbor_degree_max", "neighbor_degree_min", "degree_centrality"
    )


@query("GRA-13", uses="tx entity sym deg", rounded="clustering", sql="""
WITH t AS (SELECT a.src, COUNT(*) AS t FROM sym a JOIN sym b ON a.src = b.src AND a.dst < b.dst JOIN sym c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1)
SELECT deg.src AS id, COALESCE(t, 0) AS triangles, CASE WHEN d > 1 THEN COALESCE(t, 0) / (d * (d - 1) / 2) ELSE 0 END AS clustering FROM deg LEFT JOIN t USING (src)
""")
def gra_13(t):
    return gr.clustering_coefficients(entity(t))


def _rank_sql(rounds: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT src AS id, 1e0 / (SELECT COUNT(*) FROM deg) AS r FROM deg)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"r{i} AS MATERIALIZED (SELECT dst AS id, 0.15e0 / (SELECT COUNT(*) FROM deg) + 0.85e0 * SUM(r / d) AS r FROM sym JOIN deg USING (src) JOIN r{i - 1} ON id = src GROUP BY 1)"
        )
    return "WITH " + ", ".join(steps) + f" SELECT id, r AS pagerank FROM r{rounds}"


@query("GRA-14", uses="tx entity sym deg", rounded="pagerank", places=8, sql=_rank_sql(15))
def gra_14(t):
    return gr.pagerank(entity(t), iterations=15, tolerance=None)


@query("GRA-15")
def gra_15(t):
    """Betweenness from random shortest paths, within ERROR; the bound reached comes with it (see the tests)."""
    return gr.sampled_betweenness(trade(t), ERROR)


@query("GRA-16")
def gra_16(t):
    """Weighted random walks from every merchant (seeded hashes: see the tests)."""
    starts = t.merchants.select(gr.node_id("m", "merchant_id").alias("id"))
    return gr.random_walks(trade(t), starts, walks=5, length=6).select("walk_id", F.array_join("path", ">").alias("path"))


@query("GRA-17", uses="tx trade", rounded="w", sql="""
WITH s AS (SELECT src, dst, w FROM trade UNION ALL SELECT dst, src, w FROM trade),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY w DESC, dst) AS n FROM s),
h0 AS (SELECT MIN(src) AS id FROM trade), h1 AS (SELECT src, dst, w FROM r JOIN h0 ON src = id WHERE n <= 10), f1 AS (SELECT DISTINCT dst AS id FROM h1 WHERE dst NOT IN (SELECT id FROM h0)),
h2 AS (SELECT src, dst, w FROM r JOIN f1 ON src = id WHERE n <= 10)
SELECT *, CAST(1 AS INTEGER) AS hop FROM h1 UNION ALL SELECT *, CAST(2 AS INTEGER) FROM h2
""")
def gra_17(t):
    edges = trade(t)
    return gr.neighbourhood_sample(edges, edges.agg(F.min("src").alias("id"))).select("src", "dst", "w", "hop")


@query("GRA-18")
def gra_18(t):
    """Stratified start vertices and their one-hop samples (seeded hashes: see the tests)."""
    nodes, _ = built(t)
    starts = gr.stratified_sample(nodes.filter(F.col("type").isin("User", "Merchant")), 20)
    return gr.neighbourhood_sample(trade(t), starts, 1, 5).select("src", "dst", "w", "hop")


@query("GRA-19", rounded="similarity", uses="", sql="""
SELECT vec_id AS id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT MIN(vec_id) FROM embeddings))) AS similarity
FROM embeddings WHERE label < 8 ORDER BY similarity DESC, id LIMIT 25
""")
def gra_19(t):
    vectors = t.raw("embeddings").withColumnRenamed("vec_id", "id")
    first = vectors.agg(F.min_by("embedding", "id")).scalar()
    return gr.similar_nodes(vectors, first, 25, F.col("label") < 8).select("id", "label", "similarity")


@query("GRA-20")
def gra_20(t):
    """Standardised vertex features (built from GRA-12 to GRA-15)."""
    return gr.node_features(entity(t), error=ERROR)


@query("GRA-21", uses="tx", sql="""
SELECT device_id AS value, COUNT(*) AS size FROM (SELECT DISTINCT user_id, device_id FROM tx) GROUP BY 1 HAVING COUNT(*) >= 2
""")
def gra_21(t):
    return gr.attribute_groups(t.tx_slim.select("user_id", "device_id").distinct(), "device_id").select(F.col("device_id").alias("value"), "size")


@query("GRA-22", uses="tx", rounded="distance", sql="""
WITH n AS (SELECT transaction_id AS id, latitude AS x, longitude AS y, fraud_score * 10 AS z FROM tx), p AS (SELECT n_nationkey AS probe_id, ((n_nationkey * 37) % 120) - 60 + 0.5e0 AS px, ((n_nationkey * 53) % 300) - 150 + 0.5e0 AS py, 5e0 AS pz FROM nation)
SELECT * FROM (SELECT probe_id, id, sqrt(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2)) AS distance FROM n, p) WHERE distance <= 2
""")
def gra_22(t):
    nodes = t.tx_place.select(F.col("transaction_id").alias("id"), F.col("latitude").alias("x"), F.col("longitude").alias("y"), (F.col("fraud_score") * 10).alias("z"))
    k = F.col("n_nationkey")
    probes = t.raw("nation").select(
        k.alias("probe_id"), (F.pmod(k * 37, F.lit(120)) - 60 + 0.5).alias("x"), (F.pmod(k * 53, F.lit(300)) - 150 + 0.5).alias("y"), F.lit(5.0).alias("z")
    )
    return gr.nearby_nodes(nodes, probes, 2.0)


@query("GRA-23", uses="tx rings4", rounded="total_amount", places=4, sql="""
SELECT ring_id, user_count AS size, CASE WHEN avg_fraud_score > 0.9 THEN 'CRITICAL' WHEN avg_fraud_score > 0.8 THEN 'HIGH' WHEN avg_fraud_score > 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  ROUND(total_amount, 2) AS total_amount, CASE WHEN avg_fraud_score > 0.8 THEN 'ACTIVE' ELSE 'INVESTIGATING' END AS status,
  (SELECT string_agg(u || ':' || CASE WHEN r = 1 THEN 'primary' ELSE 'secondary' END, '|' ORDER BY r) FROM (SELECT user_id AS u, ROW_NUMBER() OVER (ORDER BY user_id) AS r FROM (SELECT DISTINCT user_id FROM tx WHERE tx.device_id = rings4.device_id AND fraud_score > 0.6)) WHERE r <= 5) AS members
FROM rings4
""")
def gra_23(t):
    rings = gr.transaction_device_rings(t.tx_slim)
    members = t.tx_slim.filter(F.col("fraud_score") > 0.6).select(F.concat(F.lit("device_"), "device_id").alias("ring_id"), "user_id")
    show = F.array_join(F.transform("members", lambda m: F.concat(m["user_id"].cast("string"), F.lit(":"), m["role"])), "|")
    return gr.ring_records(rings, members).withColumn("members", show)
