"""Approximate nearest neighbours by a hierarchical k-means tree.

The top of the tree is fitted on a bounded sample (`SAMPLE_ROWS`) and every row is put
into a leaf. Leaves that hold more than `SPLIT_ROWS` rows get a tree of their own, fitted
in a task on a sample of the leaf of that same bound, and so on downwards, so leaves keep
their size when the table grows; only leaves of equal vectors stay large. A query walks
each tree best bin first: a priority queue holds the nodes seen, by the distance of their
centre, and the leaves of several trees merge in the order in which one queue would give
them. How many leaves a query keeps is calibrated at each level: it is widened until
probes, rows held out from the fit, reach the wanted recall of their exact neighbours
among all rows. A query goes on beyond that until its leaves hold more than k rows. Each
visited leaf is searched exactly, in chunks of bounded size, so a vector that a third of
all rows share makes many tasks, not a large one.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

SAMPLE_ROWS, BRANCHES, LEAF_ROWS = 20_000, 8, 200
#: A leaf of more rows than this is split by a tree of its own.
SPLIT_ROWS = 2_000
RECALL, PROBES = 0.98, 300
#: Small tables of up to this many rows (a few numbers each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows of a chunk of a leaf; rows and queries that meet in one group; queries compared at once.
CHUNK_ROWS, GROUP_ROWS, GROUP_QUERIES, BATCH = 4096, 8192, 20_000, 1024


class Tree:
    """Centres, with the children of each inner node; node 0 is the root."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS):
        rng = np.random.default_rng(7)
        self.centres: list[np.ndarray] = [sample.mean(0) if len(sample) else np.zeros(1)]
        self.children: list[list[int]] = [[]]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            x = sample[rows]
            own = kmeans(x, branches, rng)
            groups = [rows[own == c] for c in range(branches) if (own == c).any()]
            if len(groups) < 2:  # equal vectors can't be told apart
                continue
            for g in groups:
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), g))
                self.centres.append(sample[g].mean(0))
                self.children.append([])
        self.centres = np.stack(self.centres)
        self.leaves = [i for i, c in enumerate(self.children) if not c]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of x descends to, by the nearest child."""
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x))
        while len(moving):
            still = []
            for node in np.unique(at[moving]):
                kids = self.children[node]
                if not kids:
                    continue
                rows = moving[at[moving] == node]
                at[rows] = np.array(kids)[squared(x[rows], self.centres[kids]).argmin(1)]
                still.append(rows)
            moving = np.concatenate(still) if still else moving[:0]
        return at

    def visits(self, q: np.ndarray, most: int | None, held: dict[int, int], rows: int = 0, reach: float = 0.0) -> list[tuple[int, float]]:
        """The first `most` leaves (all, if None) of a best-bin-first walk, and further ones until they hold at least `rows` rows, by the counts in `held`.

        With each leaf comes the reach of the walk: the greatest distance taken from the queue so far, from `reach` on.
        """
        heap, out, have = [(reach, 0)], [], 0
        while heap and (most is None or len(out) < most or have < rows):
            d, node = heapq.heappop(heap)
            reach = max(reach, d)
            kids = self.children[node]
            if not kids:
                if held.get(node):
                    out.append((node, reach))
                    have += held[node]
                continue
            for d, kid in zip(squared(q[None], self.centres[kids])[0].tolist(), kids, strict=True):
                heapq.heappush(heap, (d, kid))
        return out


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """The cluster of each row."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = squared(x, centres).argmin(1)
        for c in range(k):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return own


def nearest(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, id, distance) of each query's k nearest rows but its own, ties to the smaller id."""
    rough = squared(queries, x)
    rough[query_ids[:, None] == ids[None]] = np.inf
    slack = 1e-9 * ((queries * queries).sum(1) + (x * x).sum(1).max())
    out = []
    for i in range(len(queries)):
        d = rough[i]
        edge = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        near = np.flatnonzero((d <= edge + slack[i]) & np.isfinite(d))
        exact = np.sqrt(((x[near] - queries[i]) ** 2).sum(1))
        for j in np.lexsort((ids[near], exact))[:k]:
            out.append((query_ids[i], ids[near[j]], exact[j]))
    return out


def by_leaf(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined by leaf with a table of one narrow row a leaf: broadcast up to BROADCAST_ROWS rows, by a shuffle (which AQE splits at hot leaves) beyond."""
    small = checkpoint(small)
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, "leaf", how)


def split_trees(rows: DataFrame, split_rows: int, sample_rows: int, leaf_rows: int) -> DataFrame:
    """leaf, tree (pickled) of the leaves that hold more than split_rows rows and can be told apart, each fitted on about sample_rows of its rows."""
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > split_rows)
    share = F.pmod(F.xxhash64("id", "leaf"), F.lit(1 << 30)) < F.lit(float(sample_rows << 30)) / F.col("n")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(np.array(part["v"].tolist(), np.float64), leaf_rows=leaf_rows)
        kept = [(part["leaf"].iloc[0], pickle.dumps(tree))] if len(tree.leaves) > 1 else []
        return pd.DataFrame(kept, columns=["leaf", "tree"])

    return checkpoint(by_leaf(rows, sizes).where(share).groupBy("leaf").applyInPandas(fit, "leaf long, tree binary"))


def down(rows: DataFrame, trees: DataFrame, work: Callable[[pd.DataFrame, Tree, dict[int, int]], pd.DataFrame], schema: str) -> DataFrame:
    """What work(rows, tree, rows held by the tree's leaves) gives for chunks of the rows whose leaf has a tree."""
    sizes = by_leaf(rows, trees.select("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("r"))
    left = by_leaf(rows, sizes).withColumn("r", F.pmod(F.xxhash64("id"), F.col("r")).cast("int"))
    right = trees.join(sizes, "leaf").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("r") - 1)))
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(part: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=columns)
        held = tree["held"].iloc[0] if "held" in tree else None
        return work(part, pickle.loads(tree["tree"].iloc[0]), {int(i): int(n) for i, n in dict(held or {}).items()})[columns]

    return left.groupBy("leaf", "r").cogroup(right.groupBy("leaf", "r")).applyInPandas(run, schema)


def exact_neighbours(rows: DataFrame, probes: np.ndarray, ids: np.ndarray, k: int, kind: str) -> DataFrame:
    """probe, id of the k nearest of all rows to each of the few probes: one pass, k rows a probe and task."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = pd.DataFrame(columns=["probe", "id", "score"])
        for b in batches:
            if len(b) and len(probes):
                found = nearest(probes, ids, np.array(b["v"].tolist(), np.float64), b["id"].to_numpy(), k)
                found = pd.DataFrame(found, columns=["probe", "id", "score"])
                top = (pd.concat([top, found]) if len(top) else found).sort_values(["probe", "score", "id"]).groupby("probe").head(k)
        if len(top):
            yield top

    order = Window.partitionBy("probe").orderBy("score", "id")
    found = rows.mapInPandas(best, f"probe {kind}, id {kind}, score double")
    return checkpoint(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("probe", "id"))


def queue():
    """The order in which a query's leaves come from the queue."""
    return Window.partitionBy("id").orderBy("reach", "seq", "leaf")


def calibrated_visits(probes: DataFrame, truth: DataFrame, placed: DataFrame, share: float) -> int:
    """The fewest leaves at which the probes, with all their leaves in `probes`, reach the share of their exact neighbours; all leaves, if they can't."""
    places = probes.select(F.col("id").alias("probe"), "leaf", F.row_number().over(queue()).alias("place"))
    leaves = placed.select("id", "leaf").join(F.broadcast(truth), "id")  # at most PROBES * k rows
    need = sorted(r["place"] or 2**31 - 1 for r in leaves.join(places, ["probe", "leaf"], "left").select("place").collect())
    return int(np.quantile(need, share, method="higher")) if need else 1


def level_share(recall: float, level: int) -> float:
    """The share of neighbours that levels down to this one keep: ever nearer to recall, never below."""
    return 1 - (1 - recall) * level / (level + 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>) of vectors that aren't null or zero, hold finite components only and have the most common length."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    length = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.where(F.size("v") == (length[0]["n"] if length else 0))


def spark_frame(spark: SparkSession, rows: pd.DataFrame, schema: str) -> DataFrame:
    return spark.createDataFrame([(r.id if isinstance(r.id, str) else int(r.id), [float(x) for x in r.v]) for r in rows.itertuples()], schema)


def widened(frontier: DataFrame, most: int, k: int) -> DataFrame:
    """The first `most` leaves of each query's queue, and further ones until they hold more than k rows."""
    before = F.coalesce(F.sum("n").over(queue().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = frontier.withColumn("__place", F.row_number().over(queue())).withColumn("__before", before)
    return kept.where((F.col("__place") <= most) | (F.col("__before") <= k)).drop("__place", "__before")


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS, recall: float = RECALL, split_rows: int = SPLIT_ROWS, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), id, score (Euclidean distance) of each query's k nearest rows found, itself (by id) excluded.

    Vectors that are null, zero, of another length than most or not finite take no part on either side;
    neither do null ids. With fewer than k other rows, all are given. Ties go to the smaller id; rows that
    repeat an id count once, by their first vector. Empty tables give an empty result.
    """
    one = lambda df: df.groupBy("id").agg(F.min("v").alias("v"))
    rows = checkpoint(one(usable(vectors, id_col, vector_col)))
    asked = checkpoint(one(usable(queries, id_col, vector_col)))
    kind = dict(rows.dtypes)["id"]
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    sample = np.array(drawn["v"].tolist(), np.float64) if len(drawn) else np.zeros((0, 1))
    apart = np.arange(len(sample)) % max(2, len(sample) // PROBES) == 1  # held out from the fit
    held_out = drawn[apart][:PROBES]
    top = Tree(sample[~apart], leaf_rows=leaf_rows)
    truth = exact_neighbours(rows, sample[apart][:PROBES], held_out["id"].to_numpy(), k, kind)

    def put(part: pd.DataFrame, tree: Tree, _: dict[int, int] | None = None) -> pd.DataFrame:
        return part.assign(local=tree.leaf_of(np.array(part["v"].tolist(), np.float64)))

    def walk(part: pd.DataFrame, tree: Tree, held: dict[int, int], most: int | None) -> pd.DataFrame:
        out = []
        for row in part.itertuples():
            for seq, (local, reach) in enumerate(tree.visits(np.asarray(row.v, np.float64), most, held, k + 1, getattr(row, "reach", 0.0))):
                out.append((row.id, row.v, getattr(row, "leaf", 0), local, reach, seq, held[local]))
        return pd.DataFrame(out, columns=["id", "v", "leaf", "local", "reach", "seq", "n"])

    placed_as, walked_as = f"id {kind}, v array<double>, leaf long, local long", f"id {kind}, v array<double>, leaf long, local long, reach double, seq int, n long"
    below = F.xxhash64("leaf", "local")

    def put_top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield put(b, top).assign(leaf=0)

    fresh = checkpoint(rows.mapInPandas(put_top, placed_as).select("id", "v", "local", below.alias("leaf")))
    # One row for each leaf of the top, of which there are fewer than the sample has rows.
    held = {r["local"]: r["n"] for r in fresh.groupBy("local").agg(F.count("*").alias("n")).collect()}

    def walk_top(most: int | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), 256):
                    yield walk(b.iloc[at : at + 256], top, held, most)

        return run

    front = lambda df: df.withColumn("leaf", below).drop("local")
    fresh, placed = fresh.drop("local"), None
    probes = spark_frame(rows.sparkSession, held_out, f"id {kind}, v array<double>")
    probed = checkpoint(front(probes.mapInPandas(walk_top(None), walked_as)))
    level, most = 1, calibrated_visits(probed, truth, fresh, level_share(recall, 1))
    walked = checkpoint(front(asked.mapInPandas(walk_top(most), walked_as)))
    probed = widened(probed, most, k)
    while True:
        trees = split_trees(fresh, split_rows, sample_rows, leaf_rows)
        settled = by_leaf(fresh, trees.select("leaf"), "left_anti").select("id", "v", "leaf")
        placed = settled if placed is None else placed.unionByName(settled)
        if trees.isEmpty():
            break
        level += 1
        put_below = checkpoint(down(fresh, trees, put, placed_as))
        holds = put_below.groupBy("leaf", "local").agg(F.count("*").alias("n")).groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("local", "n"))).alias("held"))
        trees = checkpoint(trees.join(holds, "leaf"))
        fresh = put_below.select("id", "v", below.alias("leaf"))

        def lower(frontier: DataFrame, most: int | None, trees: DataFrame = trees) -> DataFrame:
            stay = by_leaf(frontier, trees.select("leaf"), "left_anti")
            return checkpoint(stay.unionByName(front(down(frontier, trees, lambda part, tree, held: walk(part, tree, held, most), walked_as))))

        probed = lower(probed, None)
        most = calibrated_visits(probed, truth, placed.unionByName(fresh), level_share(recall, level))
        walked, probed = checkpoint(widened(lower(walked, most), most, k)), widened(probed, most, k)

    # Chunks of leaves are dealt to groups, so that a query gives k rows for a group and not for each leaf.
    chunks = checkpoint(placed.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("r")).where("r > 1"))
    chunked = lambda df: by_leaf(df, chunks, "left").withColumn("r", F.coalesce("r", F.lit(1)))
    groups = -(-rows.count() // GROUP_ROWS) or 1
    blocks = -(-asked.count() // GROUP_QUERIES) or 1
    group = F.pmod(F.xxhash64("leaf", "r"), F.lit(groups)).cast("int").alias("g")
    walked = walked.select("id", "v", "leaf", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    # Only leaves that a block of queries visits are dealt to it.
    sought = walked.groupBy("leaf").agg(F.collect_set("block").alias("blocks"))
    members = by_leaf(chunked(placed), sought).withColumn("r", F.pmod(F.xxhash64("id"), F.col("r")).cast("int"))
    members = members.select("leaf", "r", "id", "v", group, F.explode("blocks").alias("block"))
    visits = chunked(walked).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("r") - 1))).select("leaf", "r", "id", "v", group, "block")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        held = dict(iter(right.groupby(["leaf", "r"])))
        for key, asking in left.groupby(["leaf", "r"]):
            if key not in held:
                continue
            x, ids = np.array(held[key]["v"].tolist(), np.float64), held[key]["id"].to_numpy()
            for at in range(0, len(asking), BATCH):
                part = asking.iloc[at : at + BATCH]
                out += nearest(np.array(part["v"].tolist(), np.float64), part["id"].to_numpy(), x, ids, k)
        best = pd.DataFrame(out, columns=["query_id", "id", "score"]).sort_values(["query_id", "score", "id"])
        return best.groupby("query_id").head(k)

    found = visits.groupBy("g", "block").cogroup(members.groupBy("g", "block")).applyInPandas(search, f"query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op8_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op8_kmeans_tree": op8_kmeans_tree}
SQL: dict[str, str] = {}
