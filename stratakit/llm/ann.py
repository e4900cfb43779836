"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every vector of the table is then filed under its leaf. A query keeps a
priority queue of branches by their centre's distance and opens them in that order. The sample's vectors in its first
leaves tell how far its neighbours are about; it stops when the next bin lies further than that times ``reach``.
``reach`` is calibrated: exact neighbours of a bounded set of queries, found by a scan of all rows, tell how far the
visits have to widen until the recall that is asked for is reached. Neighbouring leaves stand on one shelf, so that a
query goes to a shelf once with the list of leaves that it visits there; leaves with many vectors are cut in blocks.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C


@dataclass
class KMeansTree:
    centres: np.ndarray  # of each node, the root first
    children: list[np.ndarray]  # node numbers; empty for a leaf
    leaf: np.ndarray  # leaf number of each node, or -1

    @classmethod
    def fit(cls, sample: np.ndarray, branch: int, leaf_size: int, rounds: int = 8, seed: int = 7) -> KMeansTree:
        rng = np.random.default_rng(seed)
        centres, children, todo = [sample.mean(axis=0)], [np.zeros(0, dtype=np.int64)], [(0, sample)]
        while todo:
            node, points = todo.pop()
            if len(points) <= leaf_size or not (distinct := np.unique(points, axis=0))[1:].size:
                continue
            means = distinct[rng.choice(len(distinct), min(branch, len(distinct)), replace=False)]
            for _ in range(rounds):
                near = _near(points, means)
                used = np.unique(near)
                means = np.stack([points[near == k].mean(axis=0) for k in used])
            near = _near(points, means)
            used = np.unique(near)
            if len(used) < 2:
                continue
            children[node] = np.arange(len(centres), len(centres) + len(used))
            for k in used:
                todo.append((len(centres), points[near == k]))
                centres.append(means[k])
                children.append(np.zeros(0, dtype=np.int64))
        ends = np.array([not len(c) for c in children])
        return cls(np.array(centres), children, np.where(ends, np.cumsum(ends) - 1, -1))

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, going down to the nearest centre."""
        node = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            kids = self.children[at]
            if not len(kids):
                node[rows] = at
                continue
            near = _near(points[rows], self.centres[kids])
            todo += [(kid, rows[near == k]) for k, kid in enumerate(kids.tolist()) if (near == k).any()]
        return self.leaf[node]

    def bins(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """Leaves, best bin first: each with the largest squared distance that was at the head of the queue so far."""
        queue, far = [(0.0, 0)], 0.0
        while queue:
            distance, node = heapq.heappop(queue)
            far = max(far, distance)
            kids = self.children[node]
            if not len(kids):
                yield far, int(self.leaf[node])
                continue
            for pair in zip(((self.centres[kids] - query) ** 2).sum(axis=1).tolist(), kids.tolist(), strict=True):
                heapq.heappush(queue, pair)


@dataclass
class Sample:
    """The vectors that the tree was fitted on, by leaf."""

    ids: np.ndarray
    points: np.ndarray
    rows: list[np.ndarray]  # of each leaf

    def near(self, leaves: list[int], own: int, query: np.ndarray, k: int) -> np.ndarray:
        """Distances to the k nearest in these leaves, but rows with the id ``own``."""
        at = np.concatenate([self.rows[x] for x in leaves])
        return nearest(self.ids[at], self.points[at], np.array([own]), query[None], k)[2] if len(at) else np.zeros(0)


def scale(bins: Iterator[tuple[float, int]], sample: Sample, own: int, query: np.ndarray, k: int, probe: int) -> tuple[list[tuple[float, int]], np.ndarray]:
    """The first bins, which hold ``probe`` rows of the sample if there are so many, and the distances to their k nearest."""
    first, held = [], 0
    for far, leaf in bins:
        first.append((far, leaf))
        held += len(sample.rows[leaf])
        if held >= probe:
            break
    return first, sample.near([leaf for _, leaf in first], own, query, k)


def _near(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): without null ids, null or zero vectors, and those with null or non-finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(ids: np.ndarray, points: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k nearest of the points but itself, ties to the smaller id: query number, point number, distance."""
    out: list[tuple] = []
    length = (points**2).sum(axis=1)
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        # a first guess by matrix product; whatever its error could hide is measured exactly
        guess = length - 2 * q @ points.T + (q**2).sum(axis=1)[:, None]
        guess[qids[a : a + 256][:, None] == ids] = np.inf
        least = np.partition(guess, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        slack = 1e-9 * (1 + length.max() + (q**2).sum(axis=1))
        row, col = np.nonzero((guess <= (least + slack)[:, None]) & np.isfinite(guess))
        exact = np.sqrt(((points[col] - q[row]) ** 2).sum(axis=1))
        order = np.lexsort((ids[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        out.append((row[keep] + a, col[keep], exact[keep]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _distinct(ids: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Places of the rows without repeats of one id and vector."""
    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    rows = np.ascontiguousarray(np.column_stack([ids.astype(np.int64).view(np.float64), points + 0.0]))
    return np.sort(np.unique(rows.view(f"V{rows.shape[1] * 8}").ravel(), return_index=True)[1])


def exact(rows: DataFrame, asked: tuple[np.ndarray, np.ndarray], k: int, *also: str) -> DataFrame:
    """q (place in ``asked``: ids, vectors), vec_id, d, and the columns ``also``: the k nearest by a scan of all rows."""
    shipped = rows.sparkSession.sparkContext.broadcast(asked)

    def scan(batches):
        for batch in batches:
            if len(batch):
                ids = batch.column("vec_id").to_numpy()
                row, col, d = nearest(ids, _matrix(batch.column("v")), *shipped.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(ids[col]), pa.array(d), *(batch.column(c).take(pa.array(col)) for c in also)], names=["q", "vec_id", "d", *also])

    kinds = "".join(f", {C.ddl(rows.select(c))}" for c in also)
    best = F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))
    return rows.select("vec_id", "v", *also).mapInArrow(scan, f"q int, vec_id long, d double{kinds}").distinct().withColumn("r", best).where(F.col("r") <= k).drop("r")


def search(vectors: DataFrame, every: int = 100, k: int = 10, recall: float = 0.95, max_sample: int = 20_000, branch: int = 64, leaf_size: int = 48, max_calibration: int = 128, probe: int = 256, shelf: int = 4096, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``, against all other rows.

    vectors: vec_id, embedding. ``max_sample`` rows fit the tree and ``max_calibration`` queries calibrate it, both
    chosen by a hash of vec_id; every row is indexed. Neighbours come from the visited leaves alone. ``recall`` is asked
    for; leaves hold about ``leaf_size`` rows of the sample at most, a shelf's leaves together ``shelf`` rows or more of the
    table, a block ``block`` rows. Of vectors of several lengths the commonest length takes part (the smaller of two).
    Rows with the query's own vec_id are never its neighbours; repeats of a vec_id with one vector count once; equal
    distances go to the smaller vec_id. No usable vectors, or no query: no rows.
    """
    spark = vectors.sparkSession
    C.batches(spark, 5000)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == size.d)
    pulled = C.hashed_share(rows, max_sample, "vec_id").select("vec_id", "v").toArrow()
    if not pulled.num_rows:  # all rows have ids that the share leaves out
        pulled = rows.select("vec_id", "v").limit(1).toArrow()
    ids, points = pulled.column("vec_id").to_numpy(), _matrix(pulled.column("v"))
    at = _distinct(ids, points)
    ids, points = ids[at], points[at]
    tree = KMeansTree.fit(points, branch, leaf_size)
    filed = tree.assign(points)
    sample = Sample(ids, points, np.split(np.argsort(filed, kind="stable"), np.cumsum(np.bincount(filed, minlength=tree.leaves))[:-1]))
    shipped = spark.sparkContext.broadcast((tree, sample))

    def file(batches):
        for batch in batches:
            leaf = shipped.value[0].assign(_matrix(batch.column("v"))) if len(batch) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), batch.column("vec_id"), batch.column("v")], names=["leaf", "vec_id", "v"])

    index, index_path = C.written(rows.mapInArrow(file, "leaf int, vec_id long, v array<double>"), "index")
    queries = index.where(F.col("vec_id") % every == 0)

    # calibration: the reach that each exact neighbour takes
    chosen = C.hashed_share(queries, max_calibration, "vec_id").select("vec_id", "v").toArrow()
    if not chosen.num_rows:
        chosen = queries.select("vec_id", "v").limit(1).toArrow()
    if not chosen.num_rows:
        C.remove(spark, index_path)
        return spark.createDataFrame([], schema)
    asked = chosen.column("vec_id").to_numpy(), _matrix(chosen.column("v"))
    needed = []
    for q, mine in exact(index, asked, k, "leaf").toPandas().groupby("q"):
        own, v = int(asked[0][q]), asked[1][q]
        bins = list(tree.bins(v))
        far = {leaf: d for d, leaf in bins}
        found = scale(iter(bins), sample, own, v, k, probe)[1]
        needed += [far[x] / max(found[-1] ** 2, 1e-300) if len(found) else np.inf for x in mine.leaf]
    reach = float(np.quantile(needed, recall, method="higher")) if needed else 0.0
    logging.getLogger(__name__).info("reach %.3f of %d leaves covers %.3f of %d neighbours", reach**0.5, tree.leaves, np.mean(np.array(needed) <= reach) if needed else 1.0, len(needed))

    # shelves of neighbouring leaves, and the blocks of those that hold a large one; a row a leaf: bounded by the sample
    counts = np.zeros((2, tree.leaves), dtype=np.int64)
    for leaf, n, some in index.groupBy("leaf", "vec_id").count().groupBy("leaf").agg(F.sum("count"), F.count(F.lit(1))).toLocalIterator():
        counts[:, leaf] = n, some
    on, blocks, held = np.zeros(tree.leaves, dtype=np.int32), [1], 0
    for leaf, n in enumerate(counts[0].tolist()):
        if held and held + n > 2 * shelf or held >= shelf:
            blocks.append(1)
            held = 0
        held += n
        on[leaf], blocks[-1] = len(blocks) - 1, max(1, -(-held // block))
    layout = spark.sparkContext.broadcast((on, blocks, counts[1]))

    def open_(batches):
        tree, sample = shipped.value
        on, blocks, held = layout.value
        for batch in batches:
            ids, q, own = batch.column("vec_id").to_pylist(), _matrix(batch.column("v")) if len(batch) else [], batch.column("own").to_pylist()
            at, blk, who, leaves, bound = [], [], [], [], []
            for i, v in enumerate(q):
                bins = tree.bins(v)
                first, found = scale(bins, sample, ids[i], v, k, probe)
                most = found[-1] ** 2 if len(found) else np.inf
                # what lies beyond the sample's k-th distance isn't among the k nearest of the visited leaves
                limit = found[-1] if len(found) == k else np.inf
                mine, rows = [leaf for _, leaf in first], sum(int(held[leaf]) for _, leaf in first)
                for far, leaf in bins:
                    if far > reach * most and rows >= k + own[i]:
                        break
                    mine.append(leaf)
                    rows += int(held[leaf])
                mine = np.sort(np.array(mine, dtype=np.int32))
                places, starts = np.unique(on[mine], return_index=True)  # shelves follow the order of leaves
                for place, some in zip(places.tolist(), np.split(mine, starts[1:]), strict=True):
                    for b in range(blocks[place]):
                        at.append(place)
                        blk.append(b)
                        who.append(i)
                        leaves.append(some)
                        bound.append(limit)
            ids = pa.array([ids[i] for i in who], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blk, pa.int32()), ids, batch.column("v").take(pa.array(who, pa.int64())), pa.array(leaves, pa.list_(pa.int32())), pa.array(bound, pa.float64())], names=["shelf", "blk", "query_id", "q", "leaves", "bound"])

    asking = queries.join(queries.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own")), "vec_id").select("vec_id", "v", "own").distinct()
    visits = asking.mapInArrow(open_, "shelf int, blk int, query_id long, q array<double>, leaves array<int>, bound double")

    # int as in visits: both sides of the cogroup are dealt out by hashes of shelf and blk, which differ by type
    shelves = spark.createDataFrame([(i, x, blocks[x]) for i, x in enumerate(on.tolist())], "leaf int, shelf int, blocks int")
    shelved = index.join(F.broadcast(shelves), "leaf").withColumn("blk", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")).drop("blocks")

    def within(points: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(asking):
            ids, v = points.vec_id.to_numpy(), np.stack(points.v.to_numpy())
            at = _distinct(ids, v)
            at = at[np.argsort(points.leaf.to_numpy()[at], kind="stable")]
            ids, v, leaf = ids[at], v[at], points.leaf.to_numpy()[at]
            qids, q, bound = asking.query_id.to_numpy(), np.stack(asking.q.to_numpy()), asking.bound.to_numpy()
            visitor = np.repeat(np.arange(len(asking)), [len(x) for x in asking.leaves])
            visited = np.concatenate(asking.leaves.to_list())
            order = np.argsort(visited, kind="stable")
            visitor, visited = visitor[order], visited[order]
            for x in np.unique(leaf).tolist():
                here = slice(*np.searchsorted(leaf, [x, x + 1]))
                who = visitor[slice(*np.searchsorted(visited, [x, x + 1]))]
                row, col, d = nearest(ids[here], v[here], qids[who], q[who], k)
                keep = d <= bound[who[row]] * (1 + 1e-12)
                out.append(pd.DataFrame({"query_id": qids[who[row[keep]]], "vec_id": ids[here][col[keep]], "score": d[keep]}))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        # of all leaves of the group again the k nearest only
        return pd.concat(out).drop_duplicates().sort_values(["query_id", "score", "vec_id"]).groupby("query_id").head(k)

    near = shelved.groupBy("shelf", "blk").cogroup(visits.groupBy("shelf", "blk")).applyInPandas(within, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def measured_recall(vectors: DataFrame, found: DataFrame, k: int = 10, most: int = 128) -> float:
    """The share of exact neighbours, by distance, that ``found`` (of ``search``) has, over about ``most`` of its queries."""
    rows = usable(vectors)
    ids = C.hashed_share(found.select("query_id").distinct(), most, "query_id")
    asked = rows.join(ids, F.col("vec_id") == F.col("query_id")).select("vec_id", "v").dropDuplicates(["vec_id"]).toArrow()
    if not asked.num_rows:
        return 1.0
    best = exact(rows, (asked.column("vec_id").to_numpy(), _matrix(asked.column("v"))), k).groupBy("q").agg(F.max("d").alias("far"), F.count("*").alias("n")).toPandas()
    mine = found.join(ids, "query_id").select("query_id", "score").toPandas()
    within = 0
    for q, far, n in best.itertuples(index=False):
        within += min(n, int((mine.score[mine.query_id == asked.column("vec_id")[q].as_py()] <= far * (1 + 1e-12)).sum()))
    return within / int(best.n.sum())


def op6(vectors: DataFrame) -> DataFrame:
    return search(vectors)
