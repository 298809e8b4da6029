"""Entity graph: nodes and typed edges, rings, components, centrality, communities, walks and samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.functions.columns import by_mean, hash_fraction
from ledgerwatch.operators import paths
from ledgerwatch.operators.common import since
from ledgerwatch.session import cut_lineage
from ledgerwatch.sources.files import written


def node_id(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def build_graph(df: DataFrame, users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, type, risk_score)`` and edges ``(src, dst, type, frequency, amount, first_ts, last_ts)``."""
    user, merchant = node_id("u", "user_id"), node_id("m", "merchant_id")
    device, tx = node_id("d", "device_id"), node_id("t", "transaction_id")
    none = F.lit(None).cast("double")
    if users is not None:
        user_nodes = users.select(user.alias("id"), F.lit("User").alias("type"), "risk_score")
    else:
        user_nodes = df.groupBy("user_id").agg(F.avg("fraud_score").alias("risk_score")).select(
            user.alias("id"), F.lit("User").alias("type"), "risk_score"
        )
    merchant_nodes = df.groupBy("merchant_id").agg(F.avg("fraud_score").alias("risk_score")).select(
        merchant.alias("id"), F.lit("Merchant").alias("type"), "risk_score"
    )
    device_nodes = df.filter(F.col("device_id").isNotNull()).select("device_id").distinct().select(
        device.alias("id"), F.lit("Device").alias("type"), none.alias("risk_score")
    )
    tx_nodes = df.select(tx.alias("id"), F.lit("Transaction").alias("type"), F.col("fraud_score").alias("risk_score"))
    nodes = user_nodes.unionByName(merchant_nodes).unionByName(device_nodes).unionByName(tx_nodes)

    def single(src: Column, dst: Column, kind: str) -> DataFrame:
        return df.select(
            src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(1).cast("long").alias("frequency"),
            F.col("amount"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"),
        )

    def merged(keys: Sequence[str], src: Column, dst: Column, kind: str) -> DataFrame:
        return df.filter(F.col(keys[1]).isNotNull()).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("frequency"), F.sum("amount").alias("amount"), F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        ).select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), "frequency", "amount", "first_ts", "last_ts")

    edges = (
        single(user, tx, "MADE_TRANSACTION")
        .unionByName(single(tx, merchant, "PAID_TO"))
        .unionByName(merged(["user_id", "device_id"], user, device, "USED_DEVICE"))
        .unionByName(merged(["user_id", "merchant_id"], user, merchant, "CUSTOMER_OF"))
    )
    return nodes, edges


# ---- components -----------------------------------------------------------------------------

def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Component of every vertex in ``edges(src, dst)``: the smallest vertex id in reach.

    Alternating large-star and small-star rounds: each vertex only needs the minimum of its neighbours (an aggregate
    that combines before the shuffle), and the number of rounds grows with the logarithm of the diameter.  Loops
    keep isolated vertices.  Every round is checkpointed.  Raises when ``max_rounds`` do not suffice.
    """
    pairs = cut_lineage(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    vertices = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    current = pairs.filter(F.col("a") != F.col("b"))
    mark = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(lowest, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        )
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        current = cut_lineage(small.unionByName(root.select("a", F.col("m").alias("b"))).distinct())
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return vertices.join(current.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def component_rings(edges: DataFrame, min_size: int = 3) -> DataFrame:
    """Components of at least ``min_size`` vertices, one row per member, with size and confidence."""
    labels = connected_components(edges)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    return labels.join(sizes, "component").withColumn("confidence", F.least(F.lit(1.0), F.col("size") / 20.0))


# ---- change log -----------------------------------------------------------------------------

def latest_changes(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last operation per key: an aggregate, so a key with many changes is combined before the shuffle."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    ).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def sync_graph(
    nodes: DataFrame, edges: DataFrame, node_changes: DataFrame, edge_changes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Apply INSERT / UPDATE / DELETE logs ordered by ``seq``; deleting a node detaches its edges.

    Changes carry the columns of their table plus ``op`` and ``seq``.
    """
    last = latest_changes(node_changes, ["id"], ["seq"])
    kept = nodes.join(last.select("id"), "id", "left_anti")
    out_nodes = kept.unionByName(last.filter(F.col("op") != "DELETE").select(*nodes.columns))
    out_edges = edges
    if edge_changes is not None:
        key = ["src", "dst", "type"]
        last_edges = latest_changes(edge_changes, key, ["seq"])
        out_edges = edges.join(last_edges.select(*key), key, "left_anti").unionByName(
            last_edges.filter(F.col("op") != "DELETE").select(*edges.columns)
        )
    gone = last.filter(F.col("op") == "DELETE").select("id")
    for end in ("src", "dst"):
        out_edges = out_edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return out_nodes, out_edges.select(*edges.columns)


# ---- rings ----------------------------------------------------------------------------------

def device_rings(
    df: DataFrame, users: DataFrame, min_users: int = 2, min_risk: float = 0.5, k: int = 50
) -> DataFrame:
    """Top devices shared by risky users; one row per member, so a large ring never sits in one cell."""
    members = (
        df.filter(F.col("device_id").isNotNull()).select("device_id", "user_id").distinct()
        .join(users.select("user_id", "risk_score").filter(F.col("risk_score") >= min_risk), "user_id")
    )
    rings = (
        members.groupBy("device_id")
        .agg(F.count(F.lit(1)).alias("user_count"), F.avg("risk_score").alias("avg_risk_score"))
        .filter(F.col("user_count") >= min_users)
        .orderBy(by_mean("avg_risk_score"), F.desc("user_count"), "device_id").limit(k)
    )
    return members.join(rings, "device_id").select(
        F.concat(F.lit("device_sharing_"), "device_id").alias("ring_id"), "user_id", "risk_score", "user_count",
        "avg_risk_score", F.least(F.col("avg_risk_score") * F.col("user_count") / 10, F.lit(1.0)).alias("confidence"),
    )


def transaction_device_rings(
    df: DataFrame, min_score: float = 0.6, min_users: int = 2, min_mean: float = 0.7, k: int = 5
) -> DataFrame:
    """Devices with several users among risky transactions."""
    return (
        df.filter(F.col("device_id").isNotNull() & (F.col("fraud_score") > min_score))
        .groupBy("device_id")
        .agg(
            F.count_distinct("user_id").alias("user_count"), F.avg("fraud_score").alias("avg_fraud_score"),
            F.sum("amount").alias("total_amount"),
        )
        .filter((F.col("user_count") >= min_users) & (F.round("avg_fraud_score", 9) > min_mean))
        .orderBy(by_mean("avg_fraud_score"), "device_id").limit(k)
        .withColumn("ring_id", F.concat(F.lit("device_"), "device_id"))
    )


def suspicious_users(df: DataFrame, min_score: float = 0.7, min_count: int = 5) -> DataFrame:
    return df.filter(F.col("fraud_score") > min_score).groupBy("user_id").agg(
        F.avg("fraud_score").alias("avg_fraud_score"), F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("total_amount"), F.count_if("is_fraud").alias("fraud_count"),
    ).filter((F.col("transaction_count") > min_count) & (F.col("fraud_count") > 0))


def top_fraud_users(df: DataFrame, min_score: float = 0.8, k: int = 10) -> DataFrame:
    return df.filter((F.col("fraud_score") > min_score) & F.col("is_fraud")).groupBy("user_id").agg(
        F.avg("fraud_score").alias("avg_fraud_score"), F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("total_amount"),
    ).orderBy(by_mean("avg_fraud_score"), "user_id").limit(k)


def velocity_rings(
    df: DataFrame, seconds: float | None = 3600, min_count: int = 5, min_score: float = 0.6, k: int = 20, as_of=None
) -> DataFrame:
    """Merchants with fast risky users, and every recent user of those merchants (one row per member)."""
    pairs = since(df, seconds, as_of).groupBy("user_id", "merchant_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fraud_score").alias("s")
    )
    fast = (F.col("n") >= min_count) & (F.round("s", 9) > min_score)
    rings = (
        pairs.groupBy("merchant_id")
        .agg(F.avg(F.when(fast, F.col("s"))).alias("avg_fraud_score"), F.count(F.lit(1)).alias("user_count"),
             F.count_if(fast).alias("fast_users"))
        .filter((F.col("fast_users") >= 1) & (F.col("user_count") >= 2))
        .orderBy(by_mean("avg_fraud_score"), F.desc("user_count"), "merchant_id").limit(k)
    )
    return pairs.select("merchant_id", "user_id", fast.alias("is_fast")).join(rings, "merchant_id").select(
        F.concat(F.lit("velocity_"), F.col("merchant_id").cast("string")).alias("ring_id"), "user_id", "is_fast",
        "user_count", "avg_fraud_score",
        F.least(F.col("avg_fraud_score") * F.col("user_count") / 5, F.lit(1.0)).alias("confidence"),
    )


def community_rings(
    communities: DataFrame, risk: DataFrame, min_risk: float = 0.5, min_mean: float = 0.6, min_users: int = 2, k: int = 10
) -> DataFrame:
    """Top communities by the mean risk of their risky users.  ``communities``: id, community; ``risk``: id, risk_score."""
    members = communities.join(risk.filter(F.col("risk_score") > min_risk), "id")
    return (
        members.groupBy("community")
        .agg(F.avg("risk_score").alias("avg_risk_score"), F.count(F.lit(1)).alias("member_count"))
        .filter((F.col("member_count") >= min_users) & (F.round("avg_risk_score", 9) > min_mean))
        .orderBy(by_mean("avg_risk_score"), F.desc("member_count"), "community").limit(k)
        .withColumn("confidence", F.least(F.col("avg_risk_score") * F.col("member_count") / 8, F.lit(1.0)))
    )


def ring_records(rings: DataFrame, members: DataFrame, shown: int = 5) -> DataFrame:
    """Display records: level, status, and the first members with their roles.

    ``rings``: ring_id, user_count, avg_fraud_score, total_amount; ``members``: ring_id, user_id.
    """
    s = F.col("avg_fraud_score")
    first = tl.top_rows(members.distinct(), "ring_id", [F.col("user_id")], shown, F.col("user_id"), salts=16, rank="_r")
    listed = first.groupBy("ring_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_r", "user_id"))),
            lambda m: F.struct(
                m["user_id"].alias("user_id"), F.when(m["_r"] == 1, "primary").otherwise("secondary").alias("role")
            ),
        ).alias("members")
    )
    return rings.join(listed, "ring_id").select(
        "ring_id", F.col("user_count").alias("size"),
        F.when(s > 0.9, "CRITICAL").when(s > 0.8, "HIGH").when(s > 0.7, "MEDIUM").otherwise("LOW").alias("risk_level"),
        F.round("total_amount", 2).alias("total_amount"),
        F.when(s > 0.8, "ACTIVE").otherwise("INVESTIGATING").alias("status"), "members",
    )


# ---- strength, neighbourhoods ---------------------------------------------------------------

def relationship_strength(edges: DataFrame) -> DataFrame:
    """Strength of each (src, dst, type): mean of four factors, each at most one."""
    capped = lambda c, top: F.least(F.coalesce(c, F.lit(0.0)) / F.lit(float(top)), F.lit(1.0))
    days = F.floor((F.unix_seconds(F.max("last_ts")) - F.unix_seconds(F.min("first_ts"))) / 86400)
    return edges.groupBy("src", "dst", "type").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.coalesce("amount", F.lit(1.0))).alias("_a"),
        F.max("frequency").alias("_f"), days.alias("_d"),
    ).select(
        "src", "dst", "type",
        ((capped(F.col("_n"), 10) + capped(F.col("_a"), 1000) + capped(F.col("_f"), 50) + capped(F.col("_d"), 365)) / 4).alias("strength"),
    )


def undirected(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """Both directions of every pair of different vertices, once, with summed weight ``w``."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    both = edges.select("src", "dst", w.alias("w")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w.alias("w"))
    )
    return both.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def entity_network(
    edges: DataFrame, start: DataFrame, depth: int = 2, min_strength: float | None = None, cap: int | None = None
) -> DataFrame:
    """Edges within ``depth`` hops of the start vertices ``(id)``, with the hop at which they are reached.

    ``cap`` limits the result to the nearest edges, for a display.
    """
    graph = edges
    if min_strength is not None:
        strong = relationship_strength(edges).filter(F.col("strength") >= min_strength).drop("strength")
        graph = edges.join(strong, ["src", "dst", "type"])
    ends = graph.select("src", "dst", "type")
    both = ends.select(F.col("src").alias("id"), F.col("dst").alias("other"), "src", "dst", "type").unionByName(
        ends.select(F.col("dst").alias("id"), F.col("src").alias("other"), "src", "dst", "type")
    )
    seen = start.select("id").distinct().withColumn("hop", F.lit(0))
    found = None
    for hop in range(1, depth + 1):
        step = both.join(seen.filter(F.col("hop") == hop - 1).select("id"), "id")
        part = step.select("src", "dst", "type", F.lit(hop).alias("hop"))
        found = part if found is None else found.unionByName(part)
        fresh = step.select(F.col("other").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        seen = cut_lineage(seen.unionByName(fresh.withColumn("hop", F.lit(hop))))
    out = found.groupBy("src", "dst", "type").agg(F.min("hop").alias("hop"))
    return out if cap is None else out.orderBy("hop", "src", "dst", "type").limit(cap)


# ---- centrality -----------------------------------------------------------------------------

def degrees(edges: DataFrame) -> DataFrame:
    """Degree, in- and out-degree, degree centrality, and degree statistics of the neighbours."""
    ends = edges.select("src", "dst").distinct()
    sides = ends.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        ends.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    flows = sides.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    links = undirected(ends)
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    around = links.join(degree.select(F.col("src").alias("dst"), F.col("degree").alias("d")), "dst").groupBy("src").agg(
        F.avg("d").alias("neighbor_degree_avg"), F.max("d").alias("neighbor_degree_max"), F.min("d").alias("neighbor_degree_min")
    )
    n = flows.select(F.count(F.lit(1))).scalar()
    joined = flows.join(degree.join(around, "src").withColumnRenamed("src", "id"), "id", "left")
    return joined.withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn(
        "degree_centrality", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(0.0)
    )


def clustering_coefficients(edges: DataFrame) -> DataFrame:
    """Share of each vertex's neighbour pairs that are linked.

    Edges point from the lower to the higher degree, so a vertex starts at most sqrt(2 m) of them, hubs included.
    """
    links = undirected(edges)
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    ranked = links.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    up = ranked.filter((F.col("d") < F.col("e")) | ((F.col("d") == F.col("e")) & (F.col("src") < F.col("dst")))).select(
        F.col("src").alias("a"), F.col("dst").alias("b")
    )
    wedges = up.join(up.withColumnRenamed("b", "c"), "a").filter(F.col("b") < F.col("c"))
    closed = links.filter(F.col("src") < F.col("dst")).select(F.col("src").alias("b"), F.col("dst").alias("c"))
    triangles = wedges.join(closed, ["b", "c"])
    per_vertex = triangles.select(F.explode(F.array("a", "b", "c")).alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("t"))
    pairs = F.col("d") * (F.col("d") - 1) / 2
    return degree.join(per_vertex, "src", "left").select(
        F.col("src").alias("id"), F.coalesce("t", F.lit(0)).alias("triangles"),
        F.when(F.col("d") > 1, F.coalesce("t", F.lit(0)) / pairs).otherwise(0.0).alias("clustering"),
    )


def pagerank(
    edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, directed: bool = False
) -> DataFrame:
    """PageRank by repeated join and aggregation, until five rounds change the ranks by less than ``tolerance`` (L1).

    It raises where ``iterations`` rounds don't get there; without a tolerance it ends after them.
    """
    pairs = edges.select("src", "dst")
    pairs, vertices = _number_links(pairs.filter(F.col("src").isNotNull()) if directed else pairs.filter(F.col("src") != F.col("dst")), "ranks")
    links = written(pairs.distinct().withColumn("w", F.lit(1.0)) if directed else undirected(pairs.distinct()), "ranks-links")
    n = vertices.count()
    if n == 0:
        return vertices.select("id", F.lit(0.0).alias("pagerank"))
    out = links.groupBy("src").agg(F.sum("w").alias("total"))
    shares = links.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))
    moves = written(_around(shares, ["src", "p"], F.col("dst")), "ranks-moves")
    base = vertices.select("number")
    ends = directed and base.join(out.select(F.col("src").alias("number")), "number", "left_anti").limit(1).count() > 0
    ranks = old = base.withColumn("rank", F.lit(1.0 / n))
    for step in range(1, iterations + 1):
        told = moves.join(ranks.withColumnRenamed("number", "src"), "src").select(F.explode("around").alias("number"), (F.col("rank") * F.col("p")).alias("share"))
        flow = told.groupBy("number").agg(F.sum("share").alias("flow"))
        lost = 0.0
        if ends:
            flow = cut_lineage(flow)
            lost = 1.0 - (flow.agg(F.sum("flow")).first()[0] or 0.0)
        if directed:  # else every vertex has a neighbour that tells it something
            flow = base.join(flow, "number", "left")
        ranks = written(
            flow.select("number", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("flow", F.lit(0.0))).alias("rank")), "ranks"
        )
        if tolerance is not None and (step % 5 == 0 or step == iterations):
            moved = ranks.join(old.withColumnRenamed("rank", "old"), "number").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved < tolerance:
                break
            old = ranks
    else:
        if tolerance is not None:
            raise RuntimeError(f"ranks still move by {moved} after {iterations} rounds")
    return vertices.join(ranks, "number").select("id", F.col("rank").alias("pagerank"))


def betweenness(
    edges: DataFrame, pivots: int | None = None, normalised: bool = True, error: float | None = None, miss: float = 0.01, batch: int = 512
) -> DataFrame:
    """Betweenness from shortest paths of ``pivots`` start vertices (all of them = exact), level by level.

    Pivots are the first vertices in hash order, ``batch`` at a time; their sums are scaled to the whole vertex set. With
    ``error`` their number follows from Hoeffding's bound: but for a chance of ``miss`` no normalised value is off by more.
    A column ``error`` then has the bound reached, 0 where all vertices were pivots.
    """
    links = cut_lineage(undirected(edges).select("src", "dst"))
    vertices = links.select(F.col("src").alias("id")).distinct()
    n = vertices.count()
    if error is not None and n > 2:
        pivots = math.ceil(math.log(2 * n / miss) / 2 * (n / (n - 1) / error) ** 2)
    used = n if pivots is None else min(pivots, n)
    batches = max(1, -(-used // batch))
    starts = vertices if used == n else vertices.orderBy(F.xxhash64("id"), "id").limit(used)
    starts = cut_lineage(starts.withColumn("_b", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(batches))))
    per_vertex = None
    for k in range(batches):
        part = _dependencies(links, starts.filter(F.col("_b") == k).select("id"))
        per_vertex = part if per_vertex is None else cut_lineage(per_vertex.unionByName(part).groupBy("id").agg(F.sum("b").alias("b")))
    scale = (n / max(used, 1)) / 2.0
    if normalised and n > 2:
        scale *= 2.0 / ((n - 1) * (n - 2))
    out = vertices.join(per_vertex, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))
    if error is None:
        return out
    reached = 0.0 if used == n else math.sqrt(math.log(2 * n / miss) / (2 * used)) * n / (n - 1)
    return out.withColumn("error", F.lit(reached * (1.0 if normalised else (n - 1) * (n - 2) / 2.0)))


def _dependencies(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Sums (id, b) of the shares that each vertex has in the shortest paths from ``starts``."""
    levels = [cut_lineage(starts.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")))]
    seen = levels[0].select("s", "id")
    while True:
        step = levels[-1].join(links, F.col("id") == F.col("src")).groupBy("s", F.col("dst")).agg(F.sum("sigma").alias("sigma"))
        fresh = cut_lineage(step.select("s", F.col("dst").alias("id"), "sigma").join(seen, ["s", "id"], "left_anti"))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen = cut_lineage(seen.unionByName(fresh.select("s", "id")))
    credit = levels[-1].withColumn("delta", F.lit(0.0))
    total = [credit]
    for upper in reversed(levels[:-1]):
        lower = credit.select("s", F.col("id").alias("dst"), F.col("sigma").alias("below"), "delta")
        shares = (
            upper.join(links, F.col("id") == F.col("src")).join(lower, ["s", "dst"])
            .groupBy("s", "id").agg(F.sum(F.col("sigma") / F.col("below") * (1.0 + F.col("delta"))).alias("delta"))
        )
        credit = cut_lineage(upper.join(shares, ["s", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0))))
        total.append(credit)
    sums = total[0]
    for part in total[1:]:
        sums = sums.unionByName(part)
    return cut_lineage(sums.filter(F.col("s") != F.col("id")).groupBy("id").agg(F.sum("delta").alias("b")))


#: Random pairs of different vertices (i, s, t): both ends by their number among :n vertices. Ends of two components have no path.
PAIRS = """
WITH drawn AS (
  SELECT id AS i, pmod(xxhash64(id, 1), :n) AS a, pmod(xxhash64(id, 2), :n - 1) AS b FROM range({first}, {last})
)
SELECT i, x.id AS s, x.d AS d_s, y.id AS t, y.d AS d_t FROM drawn JOIN {numbered} x ON x.number = a JOIN {numbered} y ON y.number = pmod(a + 1 + b, :n)
WHERE x.component = y.component
"""

def sampled_betweenness(edges: DataFrame, error: float = 0.02, miss: float = 0.01, first: int = 8000, most: int = 1 << 24) -> DataFrame:
    """Normalised betweenness from random shortest paths: id, betweenness, and ``error``, the bound reached.

    A sample is a random pair of vertices and one of its shortest paths, each alike, found by a search from both ends; a
    vertex's value is its share of inner places. Samples are drawn in batches, ``first`` and then as many as there are, until
    no value is off by more than ``error`` but for a chance of ``miss``: the bound follows from the variance seen so far
    (empirical Bernstein, over all vertices and batches). It raises after ``most`` samples. State is one search per sample,
    never a row per pair of vertices; a search leaves out the last step of a large vertex, and pairs of two components need
    none. Fewer than three vertices give zeros.
    """
    spark = edges.sparkSession
    ends = undirected(edges).select("src", "dst")
    degree = ends.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    links = written(_dealt(ends.join(degree.withColumnRenamed("src", "dst"), "dst").select("src", "dst", "d"), "src", "dst"), "betweenness-links")
    numbered, n = _numbered(written(links.select(F.col("dst").alias("id"), "d").distinct(), "betweenness-vertices"))
    vertices = numbered.select("id")
    if n < 3:
        return vertices.select("id", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("error"))
    numbered = written(numbered.join(connected_components(links.where("src < dst")), "id"), "betweenness-numbered")
    hits, drawn, batch = None, 0, 0
    while True:
        last = drawn + max(first, drawn)
        if last > most:
            raise RuntimeError(f"values are not within {error} after {drawn} samples")
        pairs = spark.sql(PAIRS.replace("{first}", str(drawn)).replace("{last}", str(last)), {"n": n}, numbered=numbered)
        found = _inner_vertices(links, written(pairs, "betweenness-pairs"))
        hits = written((found if hits is None else hits.unionByName(found)).groupBy("id").agg(F.sum("hits").alias("hits")), "betweenness-hits")
        drawn, batch = last, batch + 1
        chance = math.log(4.0 * n * batch * (batch + 1) / miss)
        share = F.col("hits") / F.lit(float(drawn))
        spread = hits.agg(F.max(share * (1 - share))).first()[0] or 0.0
        scale = n / (n - 2)
        bound = scale * (math.sqrt(2 * spread * chance / (drawn - 1)) + 7 * chance / (3 * (drawn - 1)))
        if bound <= error:
            return vertices.join(hits, "id", "left").select("id", (F.coalesce(share, F.lit(0.0)) * scale).alias("betweenness"), F.lit(bound).alias("error"))


def _numbered(vertices: DataFrame, per_bucket: int = 10_000) -> tuple[DataFrame, int]:
    """Vertices with numbers from 0, in hash buckets of some ``per_bucket`` rows each, and how many there are."""
    n = vertices.count()
    buckets = max(1, n // per_bucket)
    dealt = vertices.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    return written(dealt.withColumn("place", place).join(starts, "bucket").select("id", "d", (F.col("start") + F.col("place")).alias("number")), "numbered"), n


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """The rows in even parts: few bytes that a join turns into many rows would else be read by few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _inner_vertices(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, hits): how often a vertex is inside the random shortest path of a pair (i, s, t)."""
    numbered, _ = _numbered(links.select(F.col("dst").alias("id"), "d").distinct())
    base, files = paths.store(links, numbered)
    s, t = (numbered.select(F.col("id").alias(c), F.col("number").alias(f"{c}_number")) for c in ("s", "t"))
    asked = pairs.join(s, "s").join(t, "t").select("i", F.col("s_number").alias("s"), F.col("t_number").alias("t"))
    inner = _dealt(asked, "i").mapInArrow(paths.search(base, files), "number long")
    return inner.groupBy("number").agg(F.count(F.lit(1)).alias("hits")).join(numbered, "number").select("id", "hits")


# ---- communities ----------------------------------------------------------------------------

def _half(round_no: int, column: str = "src") -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(2)) == round_no % 2


def label_propagation(edges: DataFrame, rounds: int | None = None, most: int = 1000) -> DataFrame:
    """Communities by label propagation, until no vertex wants another label; ties take the smallest label.

    Half of the vertices move per round. After ten rounds only vertices move whose hash is below those of all neighbours
    that want to move, so that links between equal labels never become fewer and the rounds come to an end; it raises
    after ``most`` of them. With ``rounds`` it moves halves and stops after so many, settled or not.
    """
    links = cut_lineage(undirected(edges))
    labels = links.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    r = quiet = 0
    while quiet < 2 and (rounds is None or r < rounds):
        if r == most:
            raise RuntimeError(f"labels still move after {most} rounds")
        halves = rounds is not None or r < 10
        votes = (links.filter(_half(r)) if halves else links).join(labels.select(F.col("id").alias("dst"), "community"), "dst")
        counts = votes.groupBy("src", "community").agg(F.sum("w").alias("v"))
        best = counts.groupBy("src").agg(F.min_by("community", F.struct(-F.col("v"), F.col("community"))).alias("new"))
        wants = cut_lineage(best.join(labels.withColumnRenamed("id", "src"), "src").filter(F.col("new") != F.col("community")).select("src", "new"))
        if wants.isEmpty():
            quiet = quiet + 1 if halves else 2
        else:
            quiet = 0
            if not halves:
                turn = lambda c: F.struct(F.xxhash64(c, F.lit(r)), F.col(c))
                blocked = links.join(wants.select("src"), "src").join(wants.select(F.col("src").alias("dst")), "dst").filter(turn("dst") < turn("src"))
                wants = wants.join(blocked.select("src").distinct(), "src", "left_anti")
            labels = cut_lineage(
                labels.join(wants.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("new", "community").alias("community"))
            )
        r += 1
    return labels


def louvain(
    edges: DataFrame, levels: int | None = None, rounds: int | None = None, weight: Column | None = None, tolerance: float = 1e-6, most: int = 1000
) -> DataFrame:
    """Communities by modularity moves, contracted level by level until a level moves nothing or adds less than ``tolerance``.

    Only active vertices are rated: all at first, then those that want to move and the neighbours of those that did. Each
    round colours the communities by hash; vertices move from one colour to the other, so no two of them swap and nothing
    has to be undone (see ``CHOSEN``). When no vertex is active all are rated once more. A level ends when none of them
    gains, or when ``SWEEP`` rounds add less than ``tolerance`` or ``LEAVE``; it raises after ``most`` rounds. ``levels`` and ``rounds`` stop
    earlier.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    links, vertices = _number_links(edges.select("src", "dst", w.alias("w")).filter(F.col("src") != F.col("dst")), "louvain")
    links = written(undirected(links, F.col("w")), "louvain-links")
    two_m = links.agg(F.sum("w")).first()[0] or 1.0
    membership = vertices.select("id", F.col("number").alias("community"))
    names = vertices.select(F.col("number").alias("src"), F.col("id").alias("name"))
    level = 0
    while levels is None or level < levels:
        state, gain = _local_moves(links, names, two_m, rounds, tolerance, most)
        if state is None:
            break
        chosen = state.select(F.col("src").alias("community"), F.col("c").alias("merged"))
        membership = written(membership.join(chosen, "community").select("id", F.col("merged").alias("community")), "louvain-membership")
        level += 1
        if gain < tolerance:
            break
        ends = state.select(F.col("src"), F.col("c").alias("a"))
        links = written(
            links.join(ends, "src").join(ends.select(F.col("src").alias("dst"), F.col("a").alias("b")), "dst")
            .groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")),
            "louvain-links",
        )
    return membership.join(names.withColumnRenamed("src", "community"), "community").select("id", F.col("name").alias("community"))


def _number_links(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The pairs (src, dst, any more columns) with numbers for vertices, and the vertices (id, number).

    Numbers grow with the ids, so that ties are broken as by the ids; a missing dst gets -1.
    """
    pairs = written(pairs, f"{name}-pairs")
    ids = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    vertices = written(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("number")), f"{name}-vertices")
    src, dst = (vertices.select(F.col("id").alias(c), F.col("number").alias(f"{c}_number")) for c in ("src", "dst"))
    ends = {"src": F.col("src_number"), "dst": F.coalesce("dst_number", F.lit(-1).cast("long"))}
    return pairs.join(src, "src").join(dst, "dst", "left").select(*[ends.get(c, F.col(c)).alias(c) for c in pairs.columns]), vertices


def _around(links: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """The values of the links of each vertex as lists (keys, around) of some ``AROUND`` at most: a vertex moves in few rows."""
    sizes = links.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / F.lit(AROUND)).cast("long").alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("dst"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    return links.join(sizes, "src").groupBy(*keys, part.alias("part")).agg(F.collect_list(value).alias("around")).drop("part")


def _local_moves(
    links: DataFrame, names: DataFrame, two_m: float, rounds: int | None, tolerance: float, most: int
) -> tuple[DataFrame | None, float]:
    """The communities (src, c) of one level, None where no vertex gains, and a lower bound of the modularity gained."""
    near = written(_around(links, ["src"], F.struct("dst", "w")), "louvain-around")
    degree = links.groupBy("src").agg(F.sum("w").alias("k"), F.count(F.lit(1)).alias("n")).join(names, "src")
    state = written(degree.select("src", "name", "k", "n", F.col("src").alias("c"), F.lit(True).alias("active")), "louvain-state")
    size, widest = state.agg(F.count(F.lit(1)), F.max("n")).first()
    gains, found, swept, parts, r, active = [0.0] * SWEEP, False, True, 1, 0, size
    while rounds is None or r < rounds:
        if r == most:
            raise RuntimeError(f"vertices still move after {most} rounds")
        state = _round(near, state, two_m, r, parts, 2 * active > size, (widest or 0) <= tl.HOT_ROWS)
        wanting, moving, moved, sure, active = state.agg(
            F.count_if("wants"), F.count("new"), F.count("sure"), F.sum("sure"), F.count_if("active")
        ).first()
        r += 1
        if not wanting and swept:
            break
        swept = not wanting
        if swept:  # none of the active ones gains: all are rated once more
            state, active = state.withColumn("active", F.lit(True)), size
        elif moved or parts > moving:
            gains.append(2.0 * (sure or 0.0) / two_m)
            found, parts = found or moved > 0, max(1, parts // 2)
            if len(gains) >= 2 * SWEEP and sum(gains[-SWEEP:]) < max(tolerance, LEAVE * sum(gains)):
                break
        elif moving:  # all are in each other's way: fewer vertices may move
            parts *= 2
    return (state if found else None), sum(gains)


#: Neighbours of a vertex that travel in one row.
AROUND = 10_000
#: Rounds in which a pair of communities gets one chance, on average, to send vertices in either direction.
SWEEP = 4
#: A level is left for the next, whose vertices are its communities, when a sweep adds less than this share of its gain.
LEAVE = 0.01
#: Vertices with their community's summed degrees, its colour in round :r (1 takes, 0 gives), and whether they may move.
PLACED = """
WITH totals AS (SELECT c, sum(k) AS tot FROM {state} GROUP BY c)
SELECT s.src, s.k, s.c, s.active, t.tot, pmod(xxhash64(n.name, :r), 2) AS side, pmod(xxhash64(s.name, :r), :parts) = 0 AS turn
FROM {state} s JOIN totals t ON s.c = t.c JOIN {state} n ON t.c = n.src
"""
#: The communities (src, c, tot, side, w) that vertices have links to: told by all vertices to their neighbours ...
TOLD = "SELECT HINT x.dst AS src, c, tot, side, x.w FROM (SELECT p.src, c, tot, side, explode(around) AS x FROM {near} a JOIN {placed} p ON a.src = p.src) WHERE x.dst <> src"
#: ... or, where few are active, asked for by these.
ASKED = """
SELECT HINT a.src, p.c, p.tot, p.side, x.w FROM (
  SELECT src, explode(around) AS x FROM {near} a LEFT SEMI JOIN (SELECT src AS s FROM {placed} WHERE active) q ON a.src = q.s
) a JOIN {placed} p ON x.dst = p.src WHERE x.dst <> a.src
"""
#: Active vertices that gain by a move (src, k, home), and the best move that the colours of the round allow (new, rise).
RATED = """
WITH options AS (VOTES), joined AS (
  SELECT src, c, max(tot) AS tot, max(side) AS side, sum(w) AS k_in FROM options GROUP BY src, c
), gains AS (
  SELECT j.src, p.k, p.c AS home, p.tot AS home_tot, j.c, j.c = p.c AS stays, p.side = 0 AND j.side = 1 AND p.turn AS allowed,
    round(k_in - p.k * (j.tot - if(j.c = p.c, p.k, 0D)) / :two_m, 9) AS gain
  FROM joined j JOIN {placed} p ON j.src = p.src WHERE p.active
), best AS (
  SELECT src, first(k) AS k, first(home) AS home, max(gain) FILTER (WHERE NOT stays) AS top,
    coalesce(max(gain) FILTER (WHERE stays), first(round(0D - k * (home_tot - k) / :two_m, 9))) AS own,
    min(struct(-gain AS cost, c)) FILTER (WHERE allowed) AS best
  FROM gains GROUP BY src
)
SELECT src, k, home, if(-best.cost > own, best.c, NULL) AS new, if(-best.cost > own, -best.cost - own, NULL) AS rise FROM best WHERE top > own
"""
#: Moves that may be made at once, and how much each adds at least (``sure``, in links).
#: Communities give or take but never both, so the gains of two moves add up but for pairs that share a community: these
#: lose at most k k' / 2m each side. A move is made if it gains more than its share of what all moves could cost it.
CHOSEN = """
WITH moves AS (SELECT src, k, home, new, rise FROM {rated} WHERE new IS NOT NULL),
homes AS (SELECT home, sum(k) AS gone FROM moves GROUP BY home), news AS (SELECT new, sum(k) AS come FROM moves GROUP BY new)
SELECT src, new, rise - k * (gone + come - 2 * k) / (2 * :two_m) AS sure FROM moves JOIN homes USING (home) JOIN news USING (new)
WHERE rise > k * (gone + come - 2 * k) / (2 * :two_m)
"""
#: The state after the moves; active are the vertices that wanted to move and the neighbours of those that did.
MOVED = """
WITH near AS (SELECT DISTINCT x.dst AS src, true AS near FROM (SELECT explode(around) AS x FROM {near} a LEFT SEMI JOIN {chosen} m ON a.src = m.src))
SELECT s.src, s.name, s.k, coalesce(m.new, s.c) AS c, r.src IS NOT NULL OR near IS NOT NULL AS active, r.src IS NOT NULL AS wants, r.new, m.sure
FROM {state} s LEFT JOIN {rated} r ON s.src = r.src LEFT JOIN {chosen} m ON s.src = m.src LEFT JOIN near ON s.src = near.src
"""


def _round(links: DataFrame, state: DataFrame, two_m: float, r: int, parts: int, told: bool = True, whole: bool = True) -> DataFrame:
    """The state after round r, with who wanted to move and what the moves made add.

    ``links`` are rows (src, dst, w) or lists (src, around). ``whole`` sends all that a vertex hears of to one task, which
    saves a shuffle where no vertex has very many neighbours.
    """
    spark = links.sparkSession
    near = links if "around" in links.columns else links.groupBy("src").agg(F.collect_list(F.struct("dst", "w")).alias("around"))
    state = state if "name" in state.columns else state.withColumn("name", F.col("src"))
    placed = written(spark.sql(PLACED, {"r": r, "parts": parts}, state=state), "louvain-placed")
    votes = (TOLD if told else ASKED).replace("HINT", "/*+ REPARTITION(src) */" if whole else "")
    rated = written(spark.sql(RATED.replace("VOTES", votes), {"two_m": two_m}, near=near, placed=placed), "louvain-rated")
    chosen = written(spark.sql(CHOSEN, {"two_m": two_m}, rated=rated), "louvain-moves")
    return written(spark.sql(MOVED, near=near, state=state, rated=rated, chosen=chosen), "louvain-state")


def modularity(edges: DataFrame, communities: DataFrame, weight: Column | None = None) -> DataFrame:
    links = undirected(edges, weight)
    two_m = links.select(F.sum("w")).scalar()
    a = communities.select(F.col("id").alias("src"), F.col("community").alias("c"))
    b = communities.select(F.col("id").alias("dst"), F.col("community").alias("d"))
    tagged = links.join(a, "src").join(b, "dst")
    per = tagged.groupBy("c").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0.0)).alias("inside"))
    return per.agg(F.sum(F.col("inside") / two_m - F.pow(F.col("tot") / two_m, 2)).alias("modularity"))


# ---- walks and samples ----------------------------------------------------------------------

#: A walk asks every neighbour of its vertex for a clock, unless there are more than this: then it draws once.
HUB = 1_000
#: Neighbours of a vertex of many whose weights are summed up in one task, roughly.
HUB_SLICE = 50_000


def random_walks(
    edges: DataFrame, starts: DataFrame, walks: int = 100, length: int = 10, seed: int = 42, hub: int = HUB, slice_rows: int = HUB_SLICE
) -> DataFrame:
    """Weighted walks, seeded by walk and step: each step takes the neighbour with the smallest exponential clock.

    From a vertex with more than ``hub`` neighbours a step draws one number instead and takes the neighbour in whose share
    of the summed weights it lies (see ``_shares``): the same chances, for one row per walk however many neighbours there are.
    """
    links = written(undirected(edges, F.col("w") if "w" in edges.columns else None), "walk-links")
    state = starts.select("id").withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))).select(
        F.concat_ws("#", F.col("id").cast("string"), F.col("walk").cast("string")).alias("walk_id"),
        F.col("id").alias("at"), F.array("id").alias("path"),
    )
    if length < 2:
        return state.select("walk_id", "path")
    weighed = F.count_if(F.coalesce((F.col("w") > 0) & (F.col("w") < float("inf")), F.lit(False))) == F.count(F.lit(1))
    sizes = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"), weighed.alias("weighed"))
    hubs = written(sizes.filter((F.col("n") > hub) & F.col("weighed")).select("src", "n"), "walk-hubs")
    shares = None if hubs.isEmpty() else _shares(links, hubs, slice_rows)
    around = written(
        links.join(hubs, "src", "left_anti").groupBy("src").agg(F.collect_list(F.struct("dst", "w")).alias("around")), "walk-neighbours"
    )
    state = written(state.groupBy("walk_id").agg(F.any_value("at").alias("at"), F.any_value("path").alias("path")), "walks")
    for step in range(1, length):
        clock = lambda x: -F.log(hash_fraction("walk_id", x["dst"], seed=seed + step) + 1e-300) / x["w"]  # noqa: B023, E731
        soonest = F.array_min(F.transform("around", lambda x: F.struct(clock(x).alias("clock"), x["dst"].alias("next"))))
        moved = state.join(around, F.col("at") == F.col("src")).select("walk_id", soonest["next"].alias("at"), "path")
        if shares is not None:
            moved = moved.unionByName(_drawn(state, *shares, seed + step))
        state = written(moved.select("walk_id", "at", F.concat("path", F.array("at")).alias("path")), "walks")
    return state.select("walk_id", "path")


def _shares(links: DataFrame, hubs: DataFrame, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Hubs (src, n, total), and their neighbours (src, cell, next, lo, hi) with their share [lo, hi) of the summed weights.

    ``total`` is cut into n cells, and a neighbour has a row in each that its share touches: at most 2 n rows, so that a
    number finds its few candidates by an equal cell.
    """
    slices = F.ceil(F.col("n") / F.lit(slice_rows)).cast("long")
    rows = links.join(hubs, "src").withColumn("slice", F.pmod(F.xxhash64("dst"), slices))
    inner = Window.partitionBy("src", "slice").orderBy("dst")
    upto = rows.select("src", "n", "slice", "dst", F.sum("w").over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    outer = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = upto.groupBy("src", "slice").agg(F.max("upto").alias("own")).select("src", "slice", "own", F.coalesce(F.sum("own").over(outer), F.lit(0.0)).alias("before"))
    lower = F.coalesce(F.lag("upto").over(inner), F.lit(0.0))
    placed = upto.withColumn("lower", lower).join(before, ["src", "slice"])
    shares = written(
        placed.select("src", "n", F.col("dst").alias("next"), (F.col("before") + F.col("lower")).alias("lo"), (F.col("before") + F.col("upto")).alias("hi")), "walk-shares"
    )
    totals = written(shares.groupBy("src").agg(F.max("n").alias("n"), F.max("hi").alias("total")), "walk-totals")
    cells = F.sequence(_cell("lo"), F.least(_cell("hi"), F.col("n") - 1))
    spread = shares.drop("n").join(totals, "src").filter(F.col("lo") < F.col("hi")).select("src", F.explode(cells).alias("cell"), "next", "lo", "hi")
    return totals, written(spread, "walk-cells")


def _cell(value: str) -> Column:
    return F.floor(F.col(value) / F.col("total") * F.col("n")).cast("long")


def _drawn(state: DataFrame, totals: DataFrame, cells: DataFrame, seed: int) -> DataFrame:
    """The walks that are at a hub, moved to a neighbour."""
    point = hash_fraction("walk_id", "at", seed=seed) * F.col("total")
    asked = state.join(totals, F.col("at") == F.col("src")).withColumn("point", point)
    asked = asked.select("walk_id", "path", "src", "point", F.least(_cell("point"), F.col("n") - 1).alias("cell"))
    found = asked.join(cells, ["src", "cell"]).filter((F.col("lo") <= F.col("point")) & (F.col("point") < F.col("hi")))
    return found.select("walk_id", F.col("next").alias("at"), "path")


def neighbourhood_sample(edges: DataFrame, starts: DataFrame, hops: int = 2, per_node: int = 10) -> DataFrame:
    """Edges to the heaviest neighbours of each frontier vertex, hop by hop."""
    links = undirected(edges, F.col("w") if "w" in edges.columns else None)
    frontier, seen, found = starts.select("id").distinct(), starts.select("id").distinct(), None
    for hop in range(1, hops + 1):
        step = links.join(frontier.withColumnRenamed("id", "src"), "src")
        best = tl.top_rows(step, "src", [F.desc("w"), F.col("dst")], per_node, F.col("dst"), salts=16)
        part = cut_lineage(best.withColumn("hop", F.lit(hop)))
        found = part if found is None else found.unionByName(part)
        frontier = part.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(frontier)
    return found


def stratified_sample(nodes: DataFrame, per_type: int = 100, seed: int = 42) -> DataFrame:
    """First ``per_type`` vertices of each type in seeded hash order."""
    ordered = nodes.withColumn("_h", F.xxhash64(F.col("id"), F.lit(seed)))
    return tl.top_rows(ordered, "type", [F.col("_h"), F.col("id")], per_type, F.col("id")).drop("_h")


# ---- vectors --------------------------------------------------------------------------------

def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def similar_nodes(vectors: DataFrame, query: Column, k: int = 10, where: Column | None = None) -> DataFrame:
    """Exact cosine neighbours of one vector: a scan with a distributed top-k."""
    chosen = vectors if where is None else vectors.filter(where)
    asked = chosen.withColumn("_q", query)
    return asked.withColumn("similarity", cosine(F.col("embedding"), F.col("_q"))).drop("_q").orderBy(F.desc("similarity"), "id").limit(k)


def similar_nodes_lsh(
    vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 8, bucket: float = 1.0, max_distance: float = 1.2, seed: int = 42
) -> DataFrame:
    """Approximate neighbours of many vectors: random-projection buckets on unit vectors, re-ranked by cosine."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    def unit(df):
        return Normalizer(inputCol="_v", outputCol="unit").transform(
            df.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
        ).select("id", "embedding", "unit")

    a, b = unit(queries), unit(vectors)
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(b)
    pairs = model.approxSimilarityJoin(a, b, max_distance, "distance").select(
        F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("id"),
        (1 - F.col("distance") * F.col("distance") / 2).alias("similarity"),
    ).filter(F.col("query_id") != F.col("id"))
    return tl.top_rows(pairs, "query_id", [F.desc("similarity"), F.col("id")], k, F.col("id"), salts=16)


def node_features(edges: DataFrame, pivots: int | None = None, error: float | None = None) -> DataFrame:
    """Degree, clustering, PageRank and betweenness of every vertex, each standardised over the vertices.

    With ``error`` betweenness comes from random shortest paths, and a column betweenness_error has its bound before it was
    standardised; else from ``pivots``.
    """
    from ledgerwatch.operators.clustering import standardised

    between = betweenness(edges, pivots) if error is None else sampled_betweenness(edges, error)
    names = ["degree", "in_degree", "out_degree", "neighbor_degree_avg", "clustering", "pagerank", "betweenness"]
    table = (
        degrees(edges).join(clustering_coefficients(edges), "id", "left")
        .join(pagerank(edges), "id", "left")
        .join(between.withColumnRenamed("error", "betweenness_error"), "id", "left")
        .select("id", *(["betweenness_error"] if error is not None else []), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    )
    return standardised(cut_lineage(table), {c: F.col(c) for c in names})


def attribute_groups(nodes: DataFrame, attribute: str, min_size: int = 2) -> DataFrame:
    """Groups of vertices that share an attribute value."""
    return nodes.filter(F.col(attribute).isNotNull()).groupBy(attribute).agg(F.count(F.lit(1)).alias("size")).filter(
        F.col("size") >= min_size
    )


def spatial_groups(nodes: DataFrame, distance: float = 100.0, min_size: int = 3) -> DataFrame:
    """Groups of positioned vertices ``(id, _x, _y, _z)`` linked by steps of at most ``distance``."""
    from ledgerwatch.operators.clustering import dbscan

    labelled = dbscan(nodes, distance, 1)
    sizes = labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    return labelled.join(sizes, "cluster_id").select("id", "cluster_id", "size")


def nearby_nodes(nodes: DataFrame, probes: DataFrame, radius: float) -> DataFrame:
    """Vertices within ``radius`` of each probe ``(probe_id, x, y, z)`` by a join on grid cells."""
    def cell(c):
        return F.floor(F.col(c) / F.lit(radius)).cast("long")

    around = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(o, "abc")]) for o in _cube()])
    spread = probes.withColumn("_o", F.explode(around)).select(
        "probe_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"),
        (cell("x") + F.col("_o.a")).alias("cx"), (cell("y") + F.col("_o.b")).alias("cy"), (cell("z") + F.col("_o.c")).alias("cz"),
    )
    placed = nodes.withColumns({"cx": cell("x"), "cy": cell("y"), "cz": cell("z")})
    gap = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) + F.pow(F.col("z") - F.col("pz"), 2))
    return placed.join(spread, ["cx", "cy", "cz"]).withColumn("distance", gap).filter(F.col("distance") <= radius).select(
        "probe_id", "id", "distance"
    )


def _cube():
    from itertools import product

    return list(product((-1, 0, 1), repeat=3))
