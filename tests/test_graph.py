"""Graph operators against small plain implementations."""

import itertools
import random
import time
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import graph as gr

from .conftest import rows


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(4)
    nodes = [f"n{i:02d}" for i in range(24)]
    edges = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(34)}
    edges |= {("hub", n) for n in nodes[:10]} | {("x1", "x2"), ("x2", "x3"), ("x1", "x3")}
    return sorted(edges)


def adjacency(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def test_components(spark, graph):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    edges = graph + chain + [("solo", "solo")]
    got = dict(rows(gr.connected_components(frame(spark, edges))))
    adj = adjacency(edges)
    for start in adj:
        seen, todo = {start}, [start]
        while todo:
            for n in adj[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        assert got[start] == min(seen)
    assert got["solo"] == "solo"


def test_pagerank_sums_to_one_and_matches_iteration(spark, graph):
    got = dict(gr.pagerank(frame(spark, graph), iterations=30, tolerance=None).collect())
    adj = adjacency(graph)
    rank = {n: 1 / len(adj) for n in adj}
    for _ in range(30):
        rank = {n: 0.15 / len(adj) + 0.85 * sum(rank[m] / len(adj[m]) for m in adj[n]) for n in adj}
    assert sum(got.values()) == pytest.approx(1.0)
    assert all(got[n] == pytest.approx(rank[n]) for n in adj)


def test_directed_pagerank_keeps_dangling_mass(spark):
    got = dict(gr.pagerank(frame(spark, [("a", "b"), ("c", "b"), ("b", "d")]), directed=True).collect())
    assert sum(got.values()) == pytest.approx(1.0)
    assert got["d"] > got["a"]


def test_betweenness_with_all_pivots_is_exact(spark, graph):
    got = dict(gr.betweenness(frame(spark, graph), None, normalised=False).collect())
    adj = adjacency(graph)
    exact = Counter()
    for s in adj:
        dist, sigma, order, queue = {s: 0}, Counter({s: 1}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = Counter()
        for w in reversed(order):
            for v in adj[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                exact[w] += delta[w]
    assert all(got[n] == pytest.approx(exact[n] / 2, abs=1e-9) for n in adj)


def test_clustering_coefficients(spark, graph):
    got = {r.id: (r.triangles, r.clustering) for r in gr.clustering_coefficients(frame(spark, graph)).collect()}
    adj = adjacency(graph)
    for n, near in adj.items():
        t = sum(b in adj[a] for a, b in itertools.combinations(sorted(near), 2))
        d = len(near)
        assert got[n] == (t, pytest.approx(t / (d * (d - 1) / 2) if d > 1 else 0.0))


def cliques():
    groups = [[f"{g}{i}" for i in range(6)] for g in "abc"]
    edges = [e for g in groups for e in itertools.combinations(g, 2)]
    return groups, edges + [("a0", "b0"), ("b1", "c0")]


def test_louvain_finds_cliques_and_raises_modularity(spark):
    groups, edges = cliques()
    found = gr.louvain(frame(spark, edges), 2, 6)
    got = dict(found.collect())
    assert all(len({got[n] for n in g}) == 1 for g in groups)
    assert len(set(got.values())) == 3
    assert gr.modularity(frame(spark, edges), found).first()[0] > 0.5
    assert got == dict(gr.louvain(frame(spark, edges), 2, 6).collect())


def test_label_propagation_finds_cliques(spark):
    groups, edges = cliques()
    got = dict(gr.label_propagation(frame(spark, edges), 12).collect())
    assert all(len({got[n] for n in g}) == 1 for g in groups)


def test_labels_settle_on_long_graphs(spark):
    edges = [(f"v{i:02d}", f"v{i + 1:02d}") for i in range(12)] + [(f"p{i}", f"q{i}") for i in range(6)]
    got, adj = dict(gr.label_propagation(frame(spark, edges)).collect()), adjacency(edges)
    for v, around in adj.items():
        votes = Counter(got[u] for u in around)
        assert got[v] == min(c for c in votes if votes[c] == max(votes.values()))
    with pytest.raises(RuntimeError):
        gr.label_propagation(frame(spark, edges), most=1)


def test_louvain_ends_where_no_community_gains(spark):
    edges = [(f"v{i:02d}", f"v{(i + 1) % 14:02d}") for i in range(14)]
    found = gr.louvain(frame(spark, edges))
    got, m = dict(found.collect()), len(edges)
    tot, between = Counter(), Counter()
    for a, b in edges:
        tot[got[a]] += 1
        tot[got[b]] += 1
        between[frozenset((got[a], got[b]))] += 1
    for pair, w in between.items():
        if len(pair) == 2:
            x, y = pair
            assert w / m - tot[x] * tot[y] / (2 * m * m) <= 1e-6
    with pytest.raises(RuntimeError):
        gr.louvain(frame(spark, edges), most=1)


def plain_louvain(adj):
    """Sequential moves until none gains, contracted until nothing merges; the modularity reached."""
    two_m = sum(sum(near.values()) for near in adj.values())
    home = {v: v for v in adj}
    links = adj
    while True:
        com, deg = {v: v for v in links}, {v: sum(near.values()) for v, near in links.items()}
        tot, moved, again = Counter(deg), False, True
        while again:
            again = False
            for v in sorted(links):
                inner = Counter()
                for u, w in links[v].items():
                    if u != v:
                        inner[com[u]] += w
                tot[com[v]] -= deg[v]
                best = max([com[v], *sorted(inner)], key=lambda c: round(inner[c] - deg[v] * tot[c] / two_m, 9))
                if best != com[v]:
                    com[v], again, moved = best, True, True
                tot[best] += deg[v]
        home = {v: com[c] for v, c in home.items()}
        if not moved:
            break
        merged = defaultdict(Counter)
        for v, near in links.items():
            for u, w in near.items():
                merged[com[v]][com[u]] += w
        links = merged
    return home


def quality(adj, home):
    two_m = sum(sum(near.values()) for near in adj.values())
    tot, inside = Counter(), 0
    for v, near in adj.items():
        tot[home[v]] += sum(near.values())
        inside += sum(w for u, w in near.items() if home[u] == home[v])
    return inside / two_m - sum((t / two_m) ** 2 for t in tot.values())


def test_louvain_is_as_good_as_sequential_moves_in_time(spark):
    rng = random.Random(6)
    edges = set()
    for v in range(1600):  # forty groups, and a hub that all groups have links to
        for _ in range(4):
            u = rng.choice([v // 40 * 40 + rng.randrange(40), rng.randrange(1600), v // 40 * 40 + rng.randrange(40)])
            if u != v:
                edges.add((f"v{min(u, v)}", f"v{max(u, v)}"))
    edges |= {("hub", f"v{v}") for v in range(0, 1600, 7)}
    adj = defaultdict(Counter)
    for a, b in edges:
        adj[a][b] = adj[b][a] = 1
    start = time.time()
    got = dict(gr.louvain(frame(spark, sorted(edges)), tolerance=1e-2).collect())
    assert time.time() - start < 300 and set(got) == set(adj)
    assert quality(adj, got) > quality(adj, plain_louvain(adj)) - 0.03


def test_louvain_moves_never_lose(spark):
    """What a round claims to add at least is never more than the modularity it adds."""
    rng = random.Random(3)
    edges = sorted({(f"{min(a, b):02d}", f"{max(a, b):02d}") for a, b in ((rng.randrange(30), rng.choice([0, 1, rng.randrange(30)])) for _ in range(120)) if a != b})
    adj = defaultdict(Counter)
    for a, b in edges:
        adj[a][b] = adj[b][a] = 1
    links = gr.undirected(frame(spark, edges))
    state = links.groupBy("src").agg(F.sum("w").alias("k")).select("src", "k", F.col("src").alias("c"), F.lit(True).alias("active"))
    before = quality(adj, {v: v for v in adj})
    for r in range(4):
        state = gr._round(links, state, 2.0 * len(edges), r, 1)
        rows = state.collect()
        after = quality(adj, {x.src: x.c for x in rows})
        assert after - before >= sum(x.sure or 0.0 for x in rows) / len(edges) - 1e-9
        before = after


def test_louvain_rounds_are_alike_however_votes_travel(spark, monkeypatch):
    """Told or asked for, to one task or to several, in long lists or short ones: the round is the same."""
    monkeypatch.setattr(gr, "AROUND", 3)
    links = gr.undirected(frame(spark, cliques()[1] + [("a0", f"x{i}") for i in range(9)]))
    near = gr._around(links, ["src"], F.struct("dst", "w"))
    assert near.filter("src = 'a0'").count() > 1 and near.agg(F.sum(F.size("around"))).first()[0] == links.count()
    names = links.groupBy("src").agg(F.sum("w").alias("k"))
    state = names.select("src", "k", F.col("src").alias("c"), (F.col("src") < "b3").alias("active"))
    two_m = links.agg(F.sum("w")).first()[0]
    found = [rows(gr._round(near, state, two_m, 1, 1, told, whole), "src", "k", "c", "active", "wants", "new", "sure") for told in (True, False) for whole in (True, False)]
    assert all(f == found[0] for f in found) and any(r[4] for r in found[0])


def test_pagerank_of_hubs_in_several_rows(spark, graph, monkeypatch):
    edges = frame(spark, graph + [("hub", f"h{i}") for i in range(40)])
    whole = rows(gr.pagerank(edges, iterations=8, tolerance=None))
    monkeypatch.setattr(gr, "AROUND", 4)
    assert rows(gr.pagerank(edges, iterations=8, tolerance=None)) == whole


def test_pagerank_raises_before_it_settles(spark, graph):
    with pytest.raises(RuntimeError):
        gr.pagerank(frame(spark, graph), iterations=5)


def test_betweenness_pivots_follow_the_error(spark, graph):
    exact = dict(gr.betweenness(frame(spark, graph)).collect())
    bounded = gr.betweenness(frame(spark, graph), error=0.02, batch=10).collect()
    assert {r.id: r.betweenness for r in bounded} == pytest.approx(exact) and {r.error for r in bounded} == {0.0}
    rough = gr.betweenness(frame(spark, graph), error=0.6).collect()
    assert all(0 < r.error <= 0.6 and abs(r.betweenness - exact[r.id]) <= r.error for r in rough)


def test_sampled_betweenness_keeps_its_bound(spark, graph):
    edges = frame(spark, graph + [("alone1", "alone2")])  # some pairs have no path
    exact = dict(gr.betweenness(edges).collect())
    got = gr.sampled_betweenness(edges, error=0.12, first=2000).collect()
    assert {r.id for r in got} == set(exact) and len({r.error for r in got}) == 1
    assert all(0 < r.error <= 0.12 and abs(r.betweenness - exact[r.id]) <= r.error for r in got)
    assert [tuple(r) for r in gr.sampled_betweenness(frame(spark, [("a", "b")])).orderBy("id").collect()] == [("a", 0.0, 0.0), ("b", 0.0, 0.0)]
    with pytest.raises(RuntimeError):
        gr.sampled_betweenness(edges, error=1e-4, first=2000, most=1000)


def test_random_paths_are_shortest_and_alike(spark):
    # a diamond: two shortest paths from s to t, each through one of the middle vertices
    links = gr.undirected(frame(spark, [("s", "a"), ("s", "b"), ("a", "t"), ("b", "t")])).select("src", "dst", F.lit(2).cast("long").alias("d"))
    pairs = spark.range(2000).selectExpr("id AS i", "'s' AS s", "2L AS d_s", "'t' AS t", "2L AS d_t")
    got = dict(gr._inner_vertices(links, pairs).collect())
    assert set(got) == {"a", "b"} and sum(got.values()) == 2000 and abs(got["a"] - 1000) < 120


def test_searches_leave_out_the_last_step_of_large_vertices(spark, monkeypatch):
    # two hubs of 300 leaves each are linked: from leaf to leaf over both hubs no hub may be expanded
    edges = [("h", f"a{i:03d}") for i in range(300)] + [("k", f"b{i:03d}") for i in range(300)] + [("h", "k")]
    links = gr.undirected(frame(spark, edges)).select("src", "dst")
    degree = links.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("d"))
    pairs = spark.range(100).selectExpr("id AS i", "format_string('a%03d', id) AS s", "1L AS d_s", "format_string('b%03d', id) AS t", "1L AS d_t")
    most = []

    def kept(df, name):
        df = written(df, name)
        most.append(df.count())
        return df

    written = gr.written
    monkeypatch.setattr(gr, "written", kept)
    assert dict(gr._inner_vertices(written(links.join(degree, "dst"), "links"), pairs).collect()) == {"h": 100, "k": 100}
    assert max(most) <= 1000  # a step of one hub would make 30,000


def test_searches_need_no_join_per_level(spark, monkeypatch):
    """A path of 80 links has 40 levels on each side; the tables written do not grow with them."""
    names = [f"v{k:02d}" for k in range(80)] + ["a name of more than thirty-two bytes, with ÿ"]
    links = gr.undirected(frame(spark, list(zip(names, names[1:])))).select("src", "dst")
    degree = links.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("d"))
    pairs = spark.range(3).selectExpr("id AS i", "'v00' AS s", "1L AS d_s", f"'{names[-1]}' AS t", "1L AS d_t")
    calls, written = [], gr.written
    monkeypatch.setattr(gr, "written", lambda df, name: calls.append(name) or written(df, name))
    assert dict(gr._inner_vertices(links.join(degree, "dst"), pairs).collect()) == {n: 3 for n in names[1:-1]}
    assert len(calls) <= 5


def test_draws_of_paths_use_the_hashes_of_spark(spark):
    from ledgerwatch.operators import paths

    texts = ["".join(chr(97 + (k * j) % 26) for j in range(k)) for k in range(70)] + ["ÿé", "u:1", "x" * 500]
    asked = spark.createDataFrame([(k * 7919 - 100, t) for k, t in enumerate(texts)], "i long, v string")
    for i, v, short, long in asked.select("i", "v", F.expr("xxhash64(i, v, 3)"), F.expr("xxhash64(i, 1, v, 4)")).collect():
        seed = paths.hash_long(i, np.array([42], np.uint64))
        row = np.frombuffer(v.encode(), np.uint8)[None, :]
        for last, before, want in ((3, seed, short), (4, paths.hash_int(1, seed), long)):
            assert paths.hash_int(last, paths.hash_bytes(row, before)).view(np.int64)[0] == want


def test_pairs_of_two_components_are_not_searched(spark, monkeypatch):
    edges = [(f"p{k}_{i}", f"p{k}_{i + 1}") for k in range(3) for i in range(5)]
    searched = []

    def inner(links, pairs):
        searched.extend(pairs.select("s", "t").collect())
        return found(links, pairs)

    found = gr._inner_vertices
    monkeypatch.setattr(gr, "_inner_vertices", inner)
    exact = dict(gr.betweenness(frame(spark, edges)).collect())
    got = gr.sampled_betweenness(frame(spark, edges), error=0.1, first=2000).collect()
    assert all(abs(r.betweenness - exact[r.id]) <= r.error for r in got) and searched
    assert all(r.s[:2] == r.t[:2] for r in searched)


def test_walks_follow_edges_and_repeat(spark, graph):
    starts = spark.createDataFrame([("hub",), ("x1",)], "id string")
    first = {r.walk_id: r.path for r in gr.random_walks(frame(spark, graph), starts, 20, 6).collect()}
    again = {r.walk_id: r.path for r in gr.random_walks(frame(spark, graph), starts, 20, 6).collect()}
    adj = adjacency(graph)
    assert first == again and len(first) == 40
    assert all(len(p) == 6 and all(b in adj[a] for a, b in zip(p, p[1:])) for p in first.values())
    assert len({tuple(p) for p in first.values()}) > 20


def test_heavy_edges_are_walked_more(spark):
    edges = spark.createDataFrame([("a", "b", 9.0), ("a", "c", 1.0)], "src string, dst string, w double")
    walks = gr.random_walks(edges, spark.createDataFrame([("a",)], "id string"), 400, 2).collect()
    share = sum(r.path[1] == "b" for r in walks) / 400
    assert 0.83 < share < 0.96


def test_walks_from_hubs_draw_once(spark):
    """Hubs are left by one number per walk, not by a clock per neighbour, with the chances of the weights."""
    edges = spark.createDataFrame([("m:0", f"u:{i:03d}", 1.0 + i % 4) for i in range(400)] + [("m:0", "u:big", 1000.0)], "src string, dst string, w double")
    starts = spark.createDataFrame([("m:0",), ("u:000",)], "id string")
    walk = lambda **kw: {r.walk_id: r.path for r in gr.random_walks(edges, starts, 1500, 3, **kw).collect()}
    drawn, again, clocks = walk(hub=100, slice_rows=64), walk(hub=100, slice_rows=64), walk(hub=1000)
    assert drawn == again and drawn != clocks and set(drawn) == set(clocks) and len(drawn) == 3000
    for paths in (drawn, clocks):
        first = [p[1] for w, p in paths.items() if w.startswith("m:0#")]
        assert first.count("u:big") / 1500 == pytest.approx(0.5, abs=0.05)
        assert sum(int(u[2:]) % 4 == 3 for u in first if u != "u:big") / 1500 == pytest.approx(0.2, abs=0.04)
        assert all(p[2] == "m:0" for w, p in paths.items() if w.startswith("m:0#"))
        assert all(p[1] == "m:0" and p[2] != "m:0" for w, p in paths.items() if w.startswith("u:000#"))


def test_neighbourhood_sample_and_strata(spark, graph):
    got = gr.neighbourhood_sample(frame(spark, graph), spark.createDataFrame([("hub",)], "id string"), 2, 3).collect()
    per_node = Counter((r.hop, r.src) for r in got)
    assert max(per_node.values()) <= 3 and {r.hop for r in got} == {1, 2}
    nodes = spark.createDataFrame([(f"{t}{i}", t) for t in "ab" for i in range(30)], "id string, type string")
    picked = Counter(r.type for r in gr.stratified_sample(nodes, 7).collect())
    assert picked == {"a": 7, "b": 7}


def test_lsh_recall(spark, tables):
    vectors = tables.raw("embeddings").withColumnRenamed("vec_id", "id")
    queries = vectors.orderBy("id").limit(5)
    approximate = {(r.query_id, r.id) for r in gr.similar_nodes_lsh(vectors, queries, 10, tables=12, bucket=0.8, max_distance=1.45).collect()}
    exact = set()
    for q in queries.collect():
        best = gr.similar_nodes(vectors.filter(F.col("id") != q.id), F.array(*[F.lit(float(x)) for x in q.embedding]), 10)
        exact |= {(q.id, r.id) for r in best.collect()}
    assert len(approximate & exact) / len(exact) >= 0.8


def test_node_features_are_standardised(spark, graph):
    table = gr.node_features(frame(spark, graph)).toPandas()
    for c in ("degree", "pagerank", "betweenness", "clustering"):
        assert abs(table[c].mean()) < 1e-9 and table[c].std(ddof=0) == pytest.approx(1.0)


def test_hot_device_ring_is_one_row_per_member(spark, tables):
    df = spark.createDataFrame([(f"t{i}", i, "d1") for i in range(1000)] + [("t", 5000, "d2")], "transaction_id string, user_id int, device_id string")
    users = spark.createDataFrame([(i, 0.9) for i in [*range(1000), 5000]], "user_id int, risk_score double")
    rings = gr.device_rings(df, users)
    assert rings.count() == 1000 and rings.select("ring_id").distinct().count() == 1


def test_spatial_groups(spark):
    nodes = [("a", 0.0, 0.0, 0.0), ("b", 60.0, 0.0, 0.0), ("c", 120.0, 0.0, 0.0), ("d", 500.0, 0.0, 0.0), ("e", 560.0, 0.0, 0.0)]
    got = gr.spatial_groups(spark.createDataFrame(nodes, "id string, _x double, _y double, _z double"), 100.0, 3)
    assert {r.id for r in got.collect()} == {"a", "b", "c"}
