"""Approximate nearest neighbours: robust-pruned directed graphs over shards, searched by beams, in numpy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, small_batches, written

#: Vectors of a shard, and bytes of them, at most, on average: what a task and a row can hold; and shards at least, so that small tables use several tasks.
SHARD, SHARD_BYTES, SHARDS = 131_072, 64 << 20, 8
#: Points below which a band of norms is not cut into more shards.
FEW = 256
#: Queries that one task takes through one shard, on average; their vectors then weigh as much as the shard's.
QUERIES = 262_144
DEGREE, WIDTH, RELAX = 32, 96, 1.2
#: Nodes that a search opens at a time, and points inserted at a time.
OPEN, BATCH = 4, 256


class Graph:
    """A directed graph over points, all lists of neighbours padded with -1."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, near: np.ndarray | None = None):
        self.points = np.ascontiguousarray(points, np.float32)
        self.squares = np.einsum("nd,nd->n", self.points, self.points)
        self.degree = degree
        self.near = np.full((len(points), degree), -1, np.int32) if near is None else near
        middle = self.points.mean(axis=0) if len(points) else np.zeros(points.shape[1])
        self.start = int(np.argmin(self.squares - 2 * self.points @ middle)) if len(points) else 0
        self._seen = np.zeros((BATCH, len(points) + 1), np.uint16)  # number of the search that last met a node; the last column takes the padding
        self._searches = 0

    def _distances(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return self.squares[nodes] - 2 * np.einsum("qnd,qd->qn", self.points[nodes], queries)

    def search(self, queries: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of at most BATCH queries in step: (nodes, distances less the query's square), nearest first, -1 where there are fewer."""
        m, rows = len(queries), np.arange(len(queries))
        nodes, found = np.full((m, width), -1, np.int32), np.full((m, width), np.inf, np.float32)
        opened = np.zeros((m, width), bool)
        self._searches += 1  # so nothing has to be cleared, and a search costs the same whatever the shard holds
        if self._searches > 65_535:
            self._seen[:], self._searches = 0, 1
        seen, now = self._seen, self._searches
        nodes[:, 0] = self.start
        found[:, :1] = self._distances(queries, nodes[:, :1])
        seen[:m, [self.start, -1]] = now
        live = rows
        while len(live):
            waiting = np.where(opened[live], np.inf, found[live])
            best = np.argpartition(waiting, min(OPEN, width - 1), axis=1)[:, :OPEN]
            ok = np.isfinite(np.take_along_axis(waiting, best, 1))
            going = ok.any(axis=1)
            live, best, ok = live[going], best[going], ok[going]
            if not len(live):
                break
            opened[live[:, None], best] |= ok
            chosen = np.where(ok, nodes[live[:, None], best], 0)
            next_ = np.where(ok[:, :, None], self.near[chosen], -1).reshape(len(live), -1)
            next_.sort(axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            next_[seen[live[:, None], next_] == now] = -1
            seen[live[:, None], next_] = now
            d = np.where(next_ >= 0, self._distances(queries[live], next_), np.inf)
            all_nodes, all_found = np.concatenate([nodes[live], next_], 1), np.concatenate([found[live], d], 1)
            all_opened = np.concatenate([opened[live], np.zeros(next_.shape, bool)], 1)
            keep = np.argpartition(all_found, width - 1, axis=1)[:, :width]
            nodes[live], found[live], opened[live] = (np.take_along_axis(x, keep, 1) for x in (all_nodes, all_found, all_opened))
        order = np.argsort(found, axis=1, kind="stable")
        nodes, found = np.take_along_axis(nodes, order, 1), np.take_along_axis(found, order, 1)
        nodes[~np.isfinite(found)] = -1
        return nodes, found

    def pruned(self, nodes: np.ndarray, others: np.ndarray, relax: float = RELAX) -> np.ndarray:
        """Robust pruning: of each node's candidates the nearest stays and drops those that are ``relax`` times nearer to it than to the node, and so on."""
        there = (others >= 0) & (others != nodes[:, None])
        at = self.points[others]
        own = np.where(there, self.squares[nodes][:, None] + self.squares[others] - 2 * np.einsum("qnd,qd->qn", at, self.points[nodes]), np.inf)
        order = np.argsort(own, axis=1, kind="stable")
        others, own = np.take_along_axis(others, order, 1), np.take_along_axis(own, order, 1)
        at = self.points[others]
        between = self.squares[others][:, :, None] + self.squares[others][:, None, :] - 2 * at @ at.transpose(0, 2, 1)
        alive, out, rows = np.isfinite(own), np.full((len(nodes), self.degree), -1, np.int32), np.arange(len(nodes))
        for k in range(self.degree):
            pick = np.argmax(alive, axis=1)
            ok = alive[rows, pick]
            if not ok.any():
                break
            out[ok, k] = others[ok, pick[ok]]
            alive &= ~(relax**2 * between[rows, pick] <= own)
            alive[rows, pick] = False
        return out

    def build(self, width: int = WIDTH, seed: int = 1) -> Graph:
        """Inserts the points in random order, in batches that double: greedy searches propose neighbours, pruning keeps some, and edges go back."""
        order = np.random.Generator(np.random.PCG64(seed)).permutation(len(self.points)).astype(np.int32)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int32)
        at = 1
        while at < len(order):
            batch = order[at : at + min(at, BATCH)]
            proposed, _ = self.search(self.points[batch], width)
            self.near[batch] = self.pruned(batch, proposed)
            self._returned(batch)
            at += len(batch)
        return self

    def _returned(self, batch: np.ndarray) -> None:
        """The edges back: appended where there is room, else the whole list is pruned anew."""
        to = self.near[batch].ravel()
        back = np.repeat(batch, self.degree)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for low in range(0, len(nodes), 512):
            own = slice(low, low + 512)
            n = nodes[own]
            added = np.full((len(n), int(count[own].max())), -1, np.int32)
            column = np.arange(first[own][0], first[own][-1] + count[own][-1])
            row = np.repeat(np.arange(len(n)), count[own])
            added[row, column - np.repeat(first[own], count[own])] = back[column]
            lists = np.concatenate([self.near[n], added], 1)
            lists = np.take_along_axis(lists, np.argsort(lists < 0, axis=1, kind="stable"), 1)
            full = (lists >= 0).sum(axis=1) > self.degree
            self.near[n[~full]] = lists[~full][:, : self.degree]
            if full.any():
                self.near[n[full]] = self.pruned(n[full], lists[full])


_INDEX = "shard long, band int, dim int, vectors binary, rest binary, near binary, ids array<array<long>>"
_FOUND = "query_id long, vec_id long, score double"


def _built(width: int):
    """A shard's vectors to one row that holds its graph.  A task has one shard, or none."""

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        whole = pa.concat_tables(tables)
        for shard in pc.unique(whole.column("shard")).to_pylist():  # one, by the partitioning
            table = whole.filter(pc.equal(whole.column("shard"), shard)).sort_by("vec_id")
            vectors = np.stack([x.values.to_numpy() for x in table.column("vector")])
            scaled = np.ldexp(vectors, -table.column("band")[0].as_py())
            squares = np.einsum("nd,nd->n", scaled, scaled)
            rest = np.sqrt(squares.max() - squares)
            graph = Graph(np.concatenate([scaled, rest[:, None]], 1)).build(width)  # with this coordinate the nearest have the largest product
            arrays = [*(table.column(c).slice(0, 1).combine_chunks() for c in ("shard", "band", "dim")), *(pa.array([x.tobytes()], pa.binary()) for x in (vectors.astype(np.float64), rest.astype(np.float32), graph.near))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))], names=[x.split()[0] for x in _INDEX.split(", ")])

    return run


def _searched(k: int, width: int):
    """A partition sorted by shard, each shard's graph before its queries, to each query's k best rows there, scored exactly.

    One graph is held at a time, and one batch of queries.
    """

    def run(batches):
        graph = vectors = ids = None
        for batch in batches:
            kinds = batch.column("query_id").is_valid().to_numpy(zero_copy_only=False)  # False: a graph
            cuts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(kinds) else []
            for a, b in zip(cuts, [*cuts[1:], len(kinds)], strict=True):
                if not kinds[a]:
                    row = {c: batch.column(c)[b - 1] for c in ("band", "dim", "vectors", "rest", "near", "ids")}
                    vectors = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, row["dim"].as_py())
                    near = np.frombuffer(row["near"].as_buffer(), np.int32).reshape(len(vectors), -1)
                    rest = np.frombuffer(row["rest"].as_buffer(), np.float32)
                    ids = row["ids"].as_py()
                    graph = Graph(np.concatenate([np.ldexp(vectors, -row["band"].as_py()), rest[:, None]], 1), near.shape[1], near)
                    continue
                for low in range(a, b, BATCH):
                    part = batch.slice(low, min(BATCH, b - low))
                    asked = np.stack([x.values.to_numpy() for x in part.column("vector")])
                    unit = asked / np.abs(asked).max(axis=1, keepdims=True)  # a query's length does not change the order of its products
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    nodes, _ = graph.search(np.concatenate([unit, np.zeros((len(unit), 1))], 1).astype(np.float32), width)
                    scores = np.where(nodes >= 0, (vectors[nodes] * asked[:, None, :]).sum(axis=2), -np.inf)  # all of the beam
                    out_q, out_v, out_s = [], [], []
                    for q, own, found in zip(part.column("query_id").to_pylist(), nodes.tolist(), scores.tolist(), strict=True):
                        rows = sorted((-s, v) for n, s in zip(own, found, strict=True) if n >= 0 for v in ids[n] if v != q)[:k]
                        out_q += [q] * len(rows)
                        out_v += [v for _, v in rows]
                        out_s += [-s for s, _ in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _band(vector: Column) -> Column:
    """The power of two nearest to the vector's norm, by logarithms; scaled first, so that squares neither overflow nor vanish."""
    top = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(F.transform(vector, lambda x: x / top), F.lit(0.0), lambda s, x: s + x * x)
    return F.floor(F.log2(top) + F.log2(squares) / 2 + 0.5).cast("int")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, the k rows found with the largest inner product.

    Every valid vector is indexed: equal vectors are one point, points are dealt to bands of norm, each twice the one before,
    and in a band by hash to shards of about ``shard``, fewer where these are over SHARD_BYTES (SHARDS at least where there are FEW points for each).  Each shard
    becomes a robust-pruned graph in a task of its own, scaled by its band, so that float32 tells its points apart whatever
    the other bands hold.  All queries then go through every shard of every band by beam search, in blocks of QUERIES with
    the shard's graph, and the k best of all beams are ranked by their products in double precision, ties by id.  Work
    grows with rows up to SHARDS shards of the size that a task can hold; beyond, by queries times shards.
    Of equal vectors the k + 1 smallest ids are kept as candidates; no other copy can be among the k nearest of any query.

    Vectors that are null, empty or zero or hold a null or non-finite component take no part, nor do null ids.  A query is
    compared with vectors of its own length; rows that share its id are never its candidates; rows repeated in id and vector
    count once; queries of one id and several vectors are answered together.  Inputs are cast to double.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    own = Window.partitionBy("vector").orderBy("vec_id")
    points = rows.select("vec_id", "vector").distinct().withColumn("copy", F.row_number().over(own)).where(F.col("copy") <= k + 1)
    points = points.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    points = written(points.select(F.col("ids")[0].alias("vec_id"), "ids", F.size("vector").alias("dim"), _band(F.col("vector")).alias("band"), "vector"), "points")
    shape = points.groupBy("dim", "band").agg(F.count("*").alias("n"))
    shape = shape.withColumn("shards", F.greatest(F.least(F.lit(SHARDS), F.ceil(F.col("n") / FEW)), F.ceil(F.col("n") / F.least(F.lit(shard), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim"))))))).cast("int"))
    order = Window.orderBy("dim", "band").rowsBetween(Window.unboundedPreceding, -1)  # a row for each vector length and band
    shape = written(shape.withColumn("first", F.coalesce(F.sum("shards").over(order), F.lit(0))), "shape")
    total = shape.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    bands = shape.select("dim", "band", "shards", "first")
    placed = looked_up(points, bands, ["dim", "band"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("shards"))).drop("shards", "first")
    placed = placed.repartitionById(max(1, total), F.col("shard").cast("int"))  # a shard is a task
    index = placed.select("shard", "band", "dim", "vec_id", "ids", "vector").mapInArrow(_built(width), _INDEX)
    index = written(index, "graphs")
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.size("vector").alias("dim"), "vector").distinct()
    asked = written(asked, "queries")
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = looked_up(asked, bands, ["dim"]).withColumn("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1))).select("shard", "block", "query_id", "vector")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = graphs.unionByName(asked, allowMissingColumns=True)
    both = both.repartitionById(max(1, total * blocks), (F.col("shard") * blocks + F.col("block")).cast("int")).sortWithinPartitions("shard", "block", F.col("query_id").asc_nulls_first())
    found = both.mapInArrow(_searched(k, width), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th vector's 20 nearest of all; what takes part, ties and repeats as in ``nearest``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
