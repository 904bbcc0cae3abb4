"""Operators whose results come from rounds of joins, against plain loops."""

import heapq
import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandgraph.operators import cluster as K
from strandgraph.operators import graph as G
from strandgraph.operators import network as N
from strandgraph.operators import phrases as H
from strandgraph.operators import scan, selection
from strandgraph.plans import analytics, networks, registry  # noqa: F401

# --- phrases


def test_phrases_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("aab \n.é") for _ in range(n))
    items = [(i, word(rng.randrange(1, 9))) for i in range(120)] + [(200, None), (201, ""), (None, "a"), (202, "a"), (203, "a"), (204, "aaaa"), (205, "aa"), (206, "x" * 5000), (202, "a")]
    texts = [(i, word(rng.randrange(0, 40))) for i in range(60)] + [(100, None), (101, ""), (None, "aaa"), (102, "y" * 100 + "x" * 6000), (103, "aaaaaaa"), (103, "b")]
    want = {(i, d) for i, p in items for d, t in texts if i is not None and d is not None and p and t is not None and p in t}
    frames = spark.createDataFrame(items, "i long, t string"), spark.createDataFrame(texts, "d long, t string")
    for block in (30, 1_000_000):
        got = [tuple(r) for r in H.quoted(*frames, "i", "t", "d", "t", block_chars=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_phrases_in_parts(spark):
    items = [(1, "ab / cd"), (2, "cd /  / ab"), (3, "ab / zz"), (4, " / "), (5, "ab"), (6, "ab / ab")]
    texts = [("x", "cd.ab"), ("y", "ab only"), ("z", None)]
    got = {tuple(r) for r in H.quoted(spark.createDataFrame(items, "i int, t string"), spark.createDataFrame(texts, "d string, t string"), "i", "t", "d", "t", multi=True).collect()}
    assert got == {(1, "x"), (2, "x"), (5, "x"), (5, "y"), (6, "x"), (6, "y")}


def test_phrases_without_rows(spark):
    none = spark.createDataFrame([], "i int, t string")
    some = spark.createDataFrame([(1, "a")], "i int, t string")
    assert H.quoted(none, some, "i", "t", "i", "t").collect() == H.quoted(some, none, "i", "t", "i", "t").collect() == []


def test_phrases_are_searched_without_joins_of_texts(spark):
    items = spark.createDataFrame([(1, "a")], "key int, phrase string")
    plan = H.held_phrases(items, spark.createDataFrame([(1, "a")], "text_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


# --- order statistics and running values

VALUES = {"a": [3.5, -1.0, 2.0, 2.0, 1e300, -1e-300, 0.0, -0.0, 7.25], "b": [5.0], "c": [float(i % 37) for i in range(500)], None: [1.0, 2.0], "d": [1.0 + i * 2**-50 for i in range(9)]}


@pytest.mark.parametrize("exclusive", [False, True])
def test_quantiles_against_plain_ones(spark, exclusive):
    rows = [(g, v) for g, vs in VALUES.items() for v in vs] + [("a", None), ("z", None)]
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    points = {"q1": 0.25, "q2": 0.5, "q3": 0.75} if exclusive else {"least": 0.0, "p5": 0.05, "q1": 0.25, "q2": 0.5, "p95": 0.95, "most": 1.0}
    got = {r["g"]: r for r in selection.quantiles(frame, ["g"], "v", points, exclusive).collect()}
    assert set(got) == {g for g, vs in VALUES.items() if len(vs) > 1 or not exclusive}
    for g, r in got.items():
        want = statistics.quantiles(VALUES[g], n=4) if exclusive else [np.percentile(VALUES[g], 100 * p) for p in points.values()]
        assert r["n"] == len(VALUES[g]) and [r[name] for name in points] == pytest.approx(want, rel=1e-15, abs=0)


def test_quantiles_of_two_keys_of_none_and_of_nothing(spark):
    frame = spark.createDataFrame([(1, "x", float(i)) for i in range(4)] + [(1, "y", 9.0)], "g int, h string, v double")
    got = {tuple(r) for r in selection.quantiles(frame, ["g", "h"], "v", {"m": 0.5}).collect()}
    assert got == {(1, "x", 4, 1.5), (1, "y", 1, 9.0)}
    assert [tuple(r) for r in selection.quantiles(frame, [], "v", {"m": 0.5}).collect()] == [(5, 2.0)]
    assert selection.quantiles(frame.where("v < 0"), ["g"], "v", {"m": 0.5}).collect() == []


def test_ranks_of_infinite_and_missing_numbers(spark):
    values = [float("nan"), float("-inf"), 0.0, float("inf"), -5.0]
    frame = spark.createDataFrame([("k", v) for v in values], "g string, x double")
    ranks = spark.createDataFrame([("k", r) for r in (1, 2, 3, 4, 5, 6)], "g string, r long")
    got = {r["r"]: r["value"] for r in selection.ranked_values(frame, ranks).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [float("-inf"), -5.0, 0.0, float("inf")] and got[5] != got[5] and 6 not in got


@pytest.mark.parametrize(("how", "fold"), [("sum", lambda a, b: a + b), ("min", min), ("max", max)])
def test_running_against_accumulate(spark, how, fold):
    rng = random.Random(3)
    rows = [(i, rng.randrange(-50, 50)) for i in range(400)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([*rows, (1000, None)], "i int, v int").repartition(7)
    got = {r["i"]: r["to"] for r in scan.running(frame, [F.desc("i")], "v", how, "to").collect()}
    ordered = sorted(rows, reverse=True)
    assert got[1000] is None
    assert [got[i] for i, _ in ordered] == list(itertools.accumulate((v for _, v in ordered), fold))


def test_running_over_nothing(spark):
    assert scan.running(spark.createDataFrame([], "i int, v int"), [F.asc("i")], "v", "sum", "to").collect() == []


# --- networks


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]
        yield [[items[0]], *rest]


def modularity(edges, groups):
    m = sum(w for _, _, w in edges)
    q = 0.0
    for g in groups:
        inside = sum(w for a, b, w in edges if a in g and b in g)
        total = sum(w * ((a in g) + (b in g)) for a, b, w in edges)
        q += inside / m - (total / (2 * m)) ** 2
    return q


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r["community"], []).append(r["id"])
    return sorted(sorted(g) for g in out.values())


TRIANGLES = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 1.0)]
WEIGHTED = [("a", "b", 5.0), ("b", "c", 4.0), ("c", "d", 0.5), ("d", "e", 6.0), ("e", "f", 0.1), ("f", "g", 3.0), ("a", "g", 0.2), ("d", "d", 1.0), ("b", "a", 1.0)]


@pytest.mark.parametrize("edges", [TRIANGLES, WEIGHTED, [("a", "b", 1.0)]])
def test_communities_are_the_best_partition_of_small_graphs(spark, edges):
    got = grouped(N.louvain(spark.createDataFrame(edges, "a string, b string, w double")).collect())
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    best = max(modularity(edges, p) for p in partitions(nodes))
    assert modularity(edges, got) == pytest.approx(best)


def test_communities_of_a_ring_of_cliques_and_levels(spark):
    edges = [(f"{c:02}{i}", f"{c:02}{j}", 1.0) for c in range(8) for i in range(4) for j in range(i)] + [(f"{c:02}0", f"{(c + 1) % 8:02}1", 1.0) for c in range(8)]
    rows = N.louvain(spark.createDataFrame(edges, "a string, b string, w double")).collect()
    got = grouped(rows)
    assert all(len({x[:2] for x in g}) * 4 == len(g) for g in got)  # no clique is cut
    assert all(r["community"] == min(g) for r in rows for g in got if r["id"] in g)
    assert modularity(edges, got) >= modularity(edges, [[f"{c:02}{i}" for i in range(4)] for c in range(8)]) - 1e-9


def test_modularity_never_falls_between_levels(spark):
    rng = random.Random(4)
    edges = [(f"{rng.randrange(12):02}", f"{rng.randrange(12):02}", float(rng.randrange(1, 6))) for _ in range(30)]
    frame = spark.createDataFrame(edges, "a string, b string, w double")
    own = N.simple(frame)
    first, any_moved = N.moved(N.both_ways(own), N.strengths(own), sum(w for _, _, w in edges), G.Rounds(spark))
    groups = lambda rows: grouped(rows.toDF("id", "community").collect())
    q = [modularity(edges, [[x] for x in sorted({e for a, b, _ in edges for e in (a, b)})]), modularity(edges, groups(first)), modularity(edges, grouped(N.louvain(frame).collect()))]
    assert any_moved and q == sorted(q)


def test_communities_in_order(spark):
    member = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "z")], "id string, community string")
    often = spark.createDataFrame([("a", 1), ("b", 5), ("c", 5), ("d", 5)], "id string, n int")
    assert {r["id"]: r["community"] for r in N.numbered_communities(member, often).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2}


def test_communities_of_no_edges(spark):
    assert N.louvain(spark.createDataFrame([("a", None, 1.0), ("a", "b", 0.0)], "a string, b string, w double")).collect() == []


def brandes(edges):
    near = {}
    for a, b, w in edges:
        if a != b:
            near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + w
            near.setdefault(b, {})[a] = near[a][b]
    out = dict.fromkeys(near, 0.0)
    for s in near:
        far, paths, parents, done, heap = {s: 0.0}, {s: 1}, {}, [], [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.append(v)
            for u, w in near[v].items():
                to = d + 1 / w
                if u in done:
                    continue
                if u not in far or to < far[u] * (1 - 1e-12):
                    far[u], paths[u], parents[u] = to, paths[v], [v]
                    heapq.heappush(heap, (to, u))
                elif abs(to - far[u]) <= 1e-12 * far[u]:
                    paths[u] += paths[v]
                    parents[u].append(v)
        share = dict.fromkeys(done, 0.0)
        for v in reversed(done):
            for u in parents.get(v, ()):
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                out[v] += share[v]
    return out


@pytest.mark.parametrize(("seed", "rows"), [(0, 50_000_000), (1, 60)])
def test_betweenness_against_a_plain_loop(spark, seed, rows):
    rng = random.Random(seed)
    n = 10
    edges = [(rng.randrange(n), rng.randrange(n), float(rng.choice([1, 1, 2, 2, 4]))) for _ in range(16)]
    edges = list({(min(a, b), max(a, b)): (a, b, w) for a, b, w in edges}.values()) + [(100, 101, 1.0), (101, 102, 1.0), (7, None, 1.0)]
    want = brandes([e for e in edges if e[1] is not None])
    frame = spark.createDataFrame(edges, "a int, b int, w double")
    got = {r["id"]: r["betweenness"] for r in N.betweenness(frame, 20, rows).collect()}
    assert {k: v for k, v in got.items() if k in want} == pytest.approx({k: v / (19 * 18) for k, v in want.items()})
    assert all(v == 0 for k, v in got.items() if k not in want)


def test_betweenness_of_two_nodes_and_of_none(spark):
    frame = spark.createDataFrame([("a", "b", 2.0)], "a string, b string, w double")
    assert {tuple(r) for r in N.betweenness(frame).collect()} == {("a", 0.0), ("b", 0.0)}
    assert N.betweenness(frame.where("w > 5")).collect() == []


# --- clusters


def plain_linkage(items, far):
    groups, out = [[i] for i in items], []
    join = {}
    while len(groups) > 1:
        mean = lambda x, y: round(sum(far(i, j) for i in x for j in y) / (len(x) * len(y)), 12)
        h, x, y = min((mean(x, y), *sorted((x, y), key=min)) for x, y in itertools.combinations(groups, 2))
        for i in x:
            for j in y:
                join[i, j] = join[j, i] = h
        groups = [g for g in groups if g not in (x, y)] + [sorted(x + y)]
        out.append((h, min(x), min(y), len(x) + len(y)))
    return out, join


def plain_silhouette(items, far, label):
    each = []
    for i in items:
        same = [j for j in items if label[j] == label[i] and j != i]
        if not same:
            each.append(0.0)
            continue
        a = sum(far(i, j) for j in same) / len(same)
        b = min(statistics.mean(far(i, j) for j in items if label[j] == c) for c in set(label.values()) - {label[i]})
        each.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return statistics.mean(each)


@pytest.mark.parametrize(("seed", "n", "missing"), [(0, 12, 0.3), (2, 12, 0.8)])
def test_linkage_cuts_and_silhouettes_against_plain_loops(spark, seed, n, missing):
    rng = random.Random(seed)
    items = [f"i{i:02}" for i in range(n)]
    known = {p: rng.choice([0.1, 0.25, 0.4, 0.5, round(rng.random(), 3)]) for p in itertools.combinations(items, 2) if rng.random() >= missing}
    far = lambda i, j: known.get((min(i, j), max(i, j)), 1.0)
    frame, distances = spark.createDataFrame([(i,) for i in items], "id string"), spark.createDataFrame([(*p, d) for p, d in known.items()], "a string, b string, distance double")
    merges = G.cut(K.average_linkage(frame, distances))
    want, join = plain_linkage(items, far)
    got = sorted((r["height"], r["a"], r["b"], r["size"]) for r in merges.collect())
    assert [g[0] for g in got] == pytest.approx(sorted(w[0] for w in want))
    assert {g[1:] for g in got if g[0] < 1} == {w[1:] for w in want if w[0] < 1}
    pairs = list(itertools.combinations(items, 2))
    assert sum(r["pairs"] for r in merges.collect()) == len(pairs)
    assert K.cophenetic_correlation(merges, distances).first()[0] == pytest.approx(np.corrcoef([far(*p) for p in pairs], [join[p] for p in pairs])[0, 1])
    rows = {r["k"]: r for r in K.best_cut(frame, merges, distances, 3, 4).collect()}
    values = {}
    for k in (3, 4):
        label = {r["id"]: r["cluster"] for r in K.cut_into(frame, merges, k).collect()}
        top = sorted((w[0] for w in want), reverse=True)[k - 1]
        assert {(i, j) for i, j in pairs if label[i] == label[j]} == {p for p in pairs if join[p] <= top}
        assert rows[k]["clusters"] == len(set(label.values())) <= k
        if rows[k]["clusters"] > 1:
            values[k] = plain_silhouette(items, far, label)
            assert rows[k]["silhouette"] == pytest.approx(values[k])
        else:
            assert rows[k]["silhouette"] is None
    if values:
        best = max(values, key=lambda k: (round(values[k], 12), -k))
        assert [k for k, r in rows.items() if r["best"]] == [best]


def test_linkage_of_few_items(spark):
    none = spark.createDataFrame([], "a string, b string, distance double")
    of = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    assert K.average_linkage(of(), none).collect() == K.average_linkage(of("a"), none).collect() == []
    assert [tuple(r) for r in K.average_linkage(of("a", "b", "b"), none).collect()] == [("a", "b", 1.0, 2, 1, 0.0)]
    assert {tuple(r) for r in K.cut_into(of("a", "b"), K.average_linkage(of("a", "b"), none), 3).collect()} == {("a", "a"), ("b", "b")}


# --- the queries over given tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def used(spark):
    rows = analytics.baskets(spark, SF).collect()
    held = {}
    for r in rows:
        held.setdefault(r["item"], set()).add(r["basket"])
    return held


def test_communities_of_items(spark, used):
    got = {r["item"]: r["community"] for r in registry.QUERIES["g10_communities"](spark, SF).collect()}
    edges = [(a, b, float(n)) for a, b in itertools.combinations(sorted(used), 2) if (n := len(used[a] & used[b])) >= 13]
    nodes = {x for a, b, _ in edges for x in (a, b)}
    assert set(got) == nodes
    groups = [[x for x in nodes if got[x] == c] for c in range(len(set(got.values())))]
    lead = lambda g: min((-len(used[x]), x) for x in g)
    assert [(-len(g), *lead(g)) for g in groups] == sorted((-len(g), *lead(g)) for g in groups)
    q = modularity(edges, groups)
    for x in nodes:  # no move of one item is a gain
        for g in groups:
            if x not in g:
                other = [[*h, x] if h is g else [y for y in h if y != x] for h in groups]
                assert modularity(edges, other) <= q + 1e-9


def test_betweenness_of_items(spark, used):
    edges = [(a, b, float(n)) for a, b in itertools.combinations(sorted(used), 2) if (n := len(used[a] & used[b])) >= 13]
    want, n = brandes(edges), len(used)
    got = {r["item"]: r["betweenness"] for r in registry.QUERIES["g12_betweenness"](spark, SF).collect()}
    assert any(want.values()) and got == pytest.approx({k: v / ((n - 1) * (n - 2)) for k, v in want.items()}, abs=2e-9)


def test_dendrogram_and_choice_of_items(spark, used):
    items = sorted(used)
    far = lambda i, j: 1 - len(used[i] & used[j]) / len(used[i] | used[j])
    want, join = plain_linkage(items, far)
    rows = registry.QUERIES["g16_linkage"](spark, SF).collect()
    assert sorted(r["height"] for r in rows) == pytest.approx(sorted(w[0] for w in want), abs=2e-9)
    assert {(r["a"], r["b"], r["size"]) for r in rows} == {w[1:] for w in want}
    pairs = list(itertools.combinations(items, 2))
    assert rows[0]["correlation"] == pytest.approx(np.corrcoef([far(*p) for p in pairs], [join[p] for p in pairs])[0, 1], abs=2e-9)
    heights, values = sorted((w[0] for w in want), reverse=True), {}
    for k in range(3, 11):
        label = {i: min(j for j in items if j == i or join[i, j] <= heights[k - 1]) for i in items}
        if len(set(label.values())) > 1:
            values[k] = plain_silhouette(items, far, label)
    got = {r["k"]: r for r in registry.QUERIES["g17_cluster_choice"](spark, SF).collect()}
    assert set(got) == set(range(3, 11))
    assert {k: got[k]["silhouette"] for k in values} == pytest.approx(values, abs=2e-9)
    assert [k for k in got if got[k]["best"]] == [max(values, key=lambda k: (round(values[k], 12), -k))]
