"""Exact top-k search by inner product: M-trees over blocks of the vectors, best-first search with stored distances.

Largest inner product is made a nearest-neighbour problem in a metric: every stored vector gets one more coordinate that
brings it to the same length R, the query gets 0 there; then distance^2 = |q|^2 + R^2 - 2 * score.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

K, SCALE = 10, 1024
#: Vectors below one routing vector are dealt to blocks of about so many; entries of a tree node; routing vectors at most;
#: queries that go through a block together.
BLOCK, NODE, ROUTES, QUERIES = 4096, 64, 128, 128
#: Distances are doubles of integers; bounds are widened by this share before anything is left out.
SLACK = 1e-9


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(SCALE * x) of every component; vectors that are null or hold null or non-finite values are left out."""
    for batch in batches:
        ids, vectors, lengths = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            if not v.is_valid or v.values.null_count:
                continue
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
            if i is not None and np.isfinite(x).all():
                whole = np.floor(SCALE * x)
                ids.append(i)
                vectors.append(whole.astype("<i8").tobytes())
                lengths.append(float(whole @ whole))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(lengths, pa.float64())],
            names=["vec_id", "v", "length"],
        )


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors count as 0 in the components they lack."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        x = np.frombuffer(v, dtype="<i8")
        row[: len(x)] = x
    return out


class Tree:
    """An M-tree in arrays. Entry e of a node: object, distance to the node's routing object, covering radius (0 in a
    leaf), child node (-1 in a leaf). Pages are the nodes; ``first`` and ``last`` give a node's entries."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        self.ids, self.points = ids, points
        self.norms = np.einsum("ij,ij->i", points, points)
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.arange(len(ids))
        self.root_object = 0
        self.root, self.radius = self._build(order, 0)

    def distances(self, objects: np.ndarray, to: int) -> np.ndarray:
        d = self.norms[objects] + self.norms[to] - 2 * (self.points[objects] @ self.points[to])
        return np.sqrt(np.maximum(d, 0))

    def _build(self, objects: np.ndarray, router: int) -> tuple[int, float]:
        """Node over ``objects`` below the object ``router``; its number and covering radius."""
        to_router = self.distances(objects, router)
        if len(objects) <= NODE:
            entry = (objects, to_router, np.zeros(len(objects)), np.full(len(objects), -1))
        else:
            routers = objects[np.linspace(0, len(objects) - 1, min(NODE, -(-len(objects) // NODE) + 1)).astype(int)]
            cross = self.norms[objects][:, None] - 2 * (self.points[objects] @ self.points[routers].T) + self.norms[routers]
            near = np.argmin(cross, axis=1)
            if (near == near[0]).all():  # copies of one vector: split evenly
                near = np.arange(len(objects)) * len(routers) // len(objects)
            parts = [(r, objects[near == i]) for i, r in enumerate(routers) if (near == i).any()]
            built = [self._build(part, r) for r, part in parts]
            own = np.array([r for r, _ in parts])
            entry = (own, self.distances(own, router), np.array([b[1] for b in built]), np.array([b[0] for b in built]))
        self.nodes.append(entry)
        return len(self.nodes) - 1, float(to_router.max(initial=0.0))

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, -id), ties to smaller ids, without the query itself; scores below ``floor`` may be left out.

        Nodes are taken in order of the least distance they may hold. An entry's distance is computed only if
        |d(query, router) - d(entry, router)| - radius, both known, doesn't already exceed the k-th best distance.
        """
        square, best = float(query @ query), []
        reach_of = lambda score: np.sqrt(max(0.0, square + self.norms[0] - 2 * score)) * (1 + SLACK) + SLACK
        reach = reach_of(floor) if np.isfinite(floor) else np.inf
        to_root = np.sqrt(max(0.0, square + self.norms[0] - 2 * float(query @ self.points[self.root_object])))
        todo = [(max(0.0, to_root - self.radius), self.root, to_root)]
        while todo:
            least, node, to_router = heapq.heappop(todo)
            if least > reach:
                break
            objects, stored_distance, radius, child = self.nodes[node]
            near = np.abs(to_router - stored_distance) - radius <= reach
            if not near.any():
                continue
            objects, radius, child = objects[near], radius[near], child[near]
            scores = self.points[objects] @ query
            if child[0] < 0:
                for score, i in zip(scores.tolist(), self.ids[objects].tolist()):
                    if i != own and (len(best) < k or (int(score), -i) > best[0]):
                        (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (int(score), -i))
                if len(best) == k:
                    reach = min(reach, reach_of(best[0][0]))
                continue
            apart = np.sqrt(np.maximum(0.0, square + self.norms[objects] - 2 * scores))
            for low, c, d in zip((apart - radius).tolist(), child.tolist(), apart.tolist()):
                if low <= reach:
                    heapq.heappush(todo, (max(0.0, low), c, d))
        return best


def _build_blocks(width: int, square: float):
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(list(rows["v"]), width)
        lift = np.sqrt(np.maximum(0.0, square - np.einsum("ij,ij->i", x, x)))
        tree = Tree(rows["vec_id"].to_numpy(), np.c_[x, lift])
        return pd.DataFrame({"route": [key[0]], "tree": [pickle.dumps(tree)], "radius": [tree.radius]})

    return build


def _searcher(width: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, Tree] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py()
                if held is None or held[0] != data:
                    held = (data, pickle.loads(data))
                out = []
                for q in batch.column(1)[i].as_py():
                    query = np.r_[_matrix([q["v"]], width)[0], 0.0]
                    floor = -np.inf if q["floor"] is None else q["floor"]
                    out.extend((q["vec_id"], -m, s) for s, m in held[1].search(query, q["vec_id"], k, floor))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[j] for o in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"]
                )

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """The ``k`` stored vectors of largest integer inner product with each query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``id_col``: the queries are stored vectors themselves and don't find their own id.
    Ties go to the smaller id. Components become floor(1024 * x).

    At most ``ROUTES`` routing vectors (a fixed sample by hash) split the vectors; below each of them, blocks of about
    ``BLOCK`` hold an M-tree each, so copies of one vector fill many blocks. A query first searches below its nearest
    routing vector; the k-th score found there, as a bound, decides which others it must visit, and prunes within them.

    Vectors that are null or hold null, NaN or infinite components, and null ids, take no part. Shorter vectors count as 0
    where others go on. Rows that repeat an id are all stored; a query whose id repeats is asked once, with the row that
    sorts first. Fewer than k candidates: all of them. No valid vector or query: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    whole = stored(rows.mapInArrow(_whole, "vec_id long, v binary, length double"), "vectors")
    n, square, width = whole.agg(F.count(F.lit(1)), F.max("length"), F.max(F.length("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    width //= 8
    picks = whole.select("vec_id", "v").distinct().orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(
        min(ROUTES, -(-n // BLOCK))
    )
    routes = _matrix([r["v"] for r in picks.collect()], width)
    lifted = np.c_[routes, np.sqrt(np.maximum(0.0, square - np.einsum("ij,ij->i", routes, routes)))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), width)
            lift = np.sqrt(np.maximum(0.0, square - np.einsum("ij,ij->i", x, x)))
            near = np.argmax(np.c_[x, lift] @ lifted.T, axis=1) if len(x) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=["vec_id", "v", "route"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), width)
            home = np.argmax(x @ routes.T, axis=1) if len(x) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32())], names=["vec_id", "v", "home"])

    dealt = stored(whole.select("vec_id", "v").mapInArrow(assign, "vec_id long, v binary, route int"), "dealt")
    sizes = dealt.groupBy("route").agg(F.count(F.lit(1)).alias("n"))  # at most ROUTES rows
    dealt = dealt.join(F.broadcast(sizes), "route").withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / BLOCK))
    )
    blocks = stored(
        dealt.groupBy("route", "block").applyInPandas(
            _build_blocks(width, square), "route int, tree binary, radius double"
        ),
        "blocks",
    )
    queries = whole.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = stored(queries.mapInArrow(ask, "vec_id long, v binary, home int"), "queries")

    def search(asked: DataFrame) -> DataFrame:
        """Asked: route, vec_id, v, floor. Queries meet a block in groups of QUERIES at most."""
        groups = asked.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-total // QUERIES)))))
        groups = groups.groupBy("route", "g").agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("asked"))
        met = blocks.join(groups, "route").select("tree", "asked")
        return _best(met.mapInArrow(_searcher(width, k), "query_id long, vec_id long, score long"), k)

    total = queries.count()
    no_floor = F.lit(None).cast("double").alias("floor")
    first = stored(search(queries.select(F.col("home").alias("route"), "vec_id", "v", no_floor)), "found")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    reach = _reaches(blocks, lifted, square, width)
    others = queries.join(floors, "vec_id", "left").mapInArrow(
        reach, "route int, vec_id long, v binary, floor double"
    )
    second = search(others)
    return _best(first.drop("rank").unionByName(second.drop("rank")), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def _reaches(blocks: DataFrame, lifted: np.ndarray, square: float, width: int):
    """Rows (route, query) for the routes, without the query's home, whose vectors may beat the query's bound.

    A block's radius is around its own root object; around the routing vector it is at most the root's distance more. As
    the root may be anywhere below the route, the bound used is the block radius plus the largest such distance, which is
    gathered per route: at most ROUTES numbers."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for route, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                tree = pickle.loads(data.as_py())
                apart = tree.norms + square - 2 * (tree.points @ lifted[route])
                out.append(float(np.sqrt(np.maximum(apart, 0)).max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["route", "radius"])

    covers = blocks.select("route", "tree").mapInArrow(cover, "route int, radius double")
    radius = np.full(len(lifted), -np.inf)
    for row in covers.groupBy("route").agg(F.max("radius").alias("r")).collect():
        radius[row["route"]] = row["r"]

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, homes, floors = (batch.column(i).to_pylist() for i in range(4))
            x = np.c_[_matrix(vectors, width), np.zeros(len(ids))]
            own = np.einsum("ij,ij->i", x, x)
            apart = np.sqrt(np.maximum(0.0, own[:, None] + square - 2 * (x @ lifted.T)))
            out = []
            for i, home in enumerate(homes):
                far = np.inf if floors[i] is None else np.sqrt(max(0.0, own[i] + square - 2 * floors[i])) * (1 + SLACK) + SLACK
                out.extend((r, i) for r in np.flatnonzero(apart[i] - radius <= far).tolist() if r != home)
            take = pa.array([i for _, i in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in out], pa.int32()), *(batch.column(j).take(take) for j in (0, 1, 3))],
                names=["route", "vec_id", "v", "floor"],
            )

    return reach


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH whole AS (
    SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
