"""Approximate nearest neighbours by collision-counting hashing with virtual rehashing.

Equal vectors are one node with the smallest of their ids. Nodes are dealt into blocks; a block projects its vectors on
``LINES`` random lines and keeps each projection as a sorted array. A query opens a window of ``WIDTH`` radii
around its own projection on every line; a node collides with it on the lines whose window holds the node. A node
at one radius' distance collides on a known share of the lines, so nodes with fewer collisions than that share less
``SLACK`` standard deviations are left alone, and the others are verified by their true distance. Two deviations leave out one in
forty of the nodes that lie exactly at the radius, and fewer of the nearer ones (1.3 deviations: one in ten, which cost recall).

The radius belongs to the query, not to the block: it starts as the distance at which the wanted number of neighbours is
expected from about ``SAMPLE`` rows (the index itself holds every row). A query is finished when enough verified vectors of all
blocks together lie within its radius. The radius of the others grows by ``GROWTH``: the windows are opened wider over the
same lines, nothing is hashed again. After ``ROUNDS`` rounds a query is compared with every node.

A block holds its rows on all lines, so collisions are counted where the vectors are; queries, a bounded group at a time, are
what moves. Lines spread over tasks would move every collision: with vectors that lie as far apart as random ones,
a window holds most rows of a line, and that is ``LINES`` times the work of a comparison.

Defined results for odd input: null or zero vectors and vectors with null or non-finite components take no part;
vectors of different lengths never meet; of rows that share an id the smallest vector serves as query, rows with the query's id
are no candidates, and a repeated row counts up to k times; ties go to the smaller id; fewer than k candidates give all;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import skew
from prismflow.llm import textkit as tk

LINES, WIDTH, SLACK, SAMPLE, SEED = 192, 1.5, 2.0, 2048, 91
GROWTH, ROUNDS = 1.25, 4
ROW_BLOCK, QUERY_GROUP = 8192, 4096
#: Parts that the ids of one vector are dealt into.
SALTS = 64
#: Share of the lines on which a vector at one radius' distance collides: a standard normal number within ``WIDTH``.
SHARE = math.erf(WIDTH / math.sqrt(2))
NEEDED = math.ceil(LINES * SHARE - SLACK * math.sqrt(LINES * SHARE * (1 - SHARE)))


class CollisionIndex:
    """Sorted single projections of one block."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.lines = np.random.default_rng(SEED).normal(size=(vectors.shape[1], LINES))
        placed = np.ascontiguousarray((vectors @ self.lines).T)
        self.order = np.argsort(placed, axis=1, kind="stable")
        self.sorted = np.take_along_axis(placed, self.order, axis=1)

    def windows(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each query's window in each line (queries x lines). Windows are opened by a hair more
        than their width, since a projection's last digits depend on how many are made at once."""
        own = queries @ self.lines
        reach = (WIDTH * radius)[:, None] + 1e-9 * (1 + np.abs(own))
        low, high = own - reach, own + reach
        first = np.stack([np.searchsorted(line, low[:, j]) for j, line in enumerate(self.sorted)], axis=1)
        return first, np.stack([np.searchsorted(line, high[:, j], "right") for j, line in enumerate(self.sorted)], axis=1)

    def collisions(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """On how many lines each node lies in one query's window; wide windows are counted by the nodes outside."""
        n = len(self.vectors)
        wide = last - first > n // 2
        inside, outside = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j, (a, b, w) in enumerate(zip(first.tolist(), last.tolist(), wide.tolist(), strict=True)):
            if w:
                outside += [self.order[j, :a], self.order[j, b:]]
            else:
                inside.append(self.order[j, a:b])
        return np.count_nonzero(wide) + np.bincount(np.concatenate(inside), minlength=n) - np.bincount(np.concatenate(outside), minlength=n)

    def near(self, queries: np.ndarray, radius: np.ndarray):
        """Per query the nodes that collide often enough, and their distances."""
        first, last = self.windows(queries, np.where(np.isfinite(radius), radius, 0))
        for k, query in enumerate(queries):
            at = np.flatnonzero(self.collisions(first[k], last[k]) >= NEEDED) if np.isfinite(radius[k]) else np.arange(len(self.vectors))
            yield at, np.sqrt(((self.vectors[at] - query) ** 2).sum(axis=1))


def _vectors(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).astype(np.float64).reshape(-1, size)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, dim, ids): every vector once, with its k + 1 smallest ids, each up to k times; other ids of it are nobody's nearest.
    Repeated rows are counted before they move, and the ids of one vector are thinned out in ``SALTS`` parts, so a vector may have any share of the rows."""
    counted = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"), F.first("dim").alias("dim"))
    few = counted.withColumn("salt", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(SALTS)).cast("int"))
    for keys in (["v", "salt"], ["v"]):
        few = few.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("place") <= k + 1)
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "times"))), lambda x: F.array_repeat(x["id"], x["times"])))
    return few.groupBy("v").agg(F.first("dim").alias("dim"), ids.alias("ids"))


def _groups(n: int) -> int:
    return max(1, -(-n // QUERY_GROUP))


def _numbers(below: int):
    return F.explode(F.sequence(F.lit(0), F.lit(below - 1)))


def first_radii(nodes: DataFrame, asked: DataFrame, k: int, groups: int) -> DataFrame:
    """``asked`` (node, v, dim) with ``radius``; without a vector to compare with the radius has no bound."""
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n"))
    some = nodes.join(F.broadcast(sizes), "dim").where(F.pmod(F.xxhash64(F.lit(5), "v"), "n") < SAMPLE)
    some = some.select("v", "dim", "n", _numbers(groups).alias("query_group"))
    dealt = asked.withColumn("query_group", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int"))

    def measure(of: pa.Table, sample: pa.Table) -> pa.Table:
        if not of.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "radius": pa.array([], pa.float64())})
        radius = np.full(of.num_rows, np.inf)
        if sample.num_rows:
            size = of["dim"][0].as_py()
            x = _vectors(sample["v"], size)
            expected = k * len(x) / sample["n"][0].as_py()
            place = min(len(x), math.ceil(expected + math.sqrt(expected))) - 1
            for i, query in enumerate(_vectors(of["v"], size)):
                far = np.sqrt(((x - query) ** 2).sum(axis=1))
                far = np.sort(far[far > 0])
                if len(far):
                    radius[i] = far[min(place, len(far) - 1)]
        return pa.table({"node": of["node"], "radius": pa.array(radius)})

    keys = ["query_group", "dim"]
    found = dealt.groupBy(*keys).cogroup(some.groupBy(*keys)).applyInArrow(tk.tidy_group(measure), "node long, radius double")
    return asked.join(found, "node")


def searched(nodes: DataFrame, active: DataFrame, k: int, blocks: int, groups: int) -> DataFrame:
    """(node, score, id, verified): per block the up to 2k nearest ids among the verified vectors, and how many were verified."""
    keys = ["block", "query_group", "dim"]
    every = active.select("node", "v", "dim", "radius", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int").alias("query_group"), _numbers(blocks).alias("block"))
    rows = nodes.select("v", "dim", "ids", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block"), _numbers(groups).alias("query_group"))
    schema = pa.schema([("node", pa.int64()), ("score", pa.float64()), ("id", pa.int64()), ("verified", pa.int64())])

    def search(of: pa.Table, block: pa.Table) -> pa.Table:
        if not block.num_rows or not of.num_rows:
            return schema.empty_table()
        size = of["dim"][0].as_py()
        index = CollisionIndex(_vectors(block["v"], size))
        lists = block["ids"].combine_chunks()
        flat, edges = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
        out = []
        for node, (at, distance) in zip(of["node"].to_pylist(), index.near(_vectors(of["v"], size), of["radius"].to_numpy()), strict=True):
            checked = len(at)
            if len(at) > 2 * k:
                use = distance <= np.partition(distance, 2 * k - 1)[2 * k - 1]
                at, distance = at[use], distance[use]
            times = edges[at + 1] - edges[at]
            place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(edges[at], times)
            ids, score = flat[place], np.repeat(distance, times)
            best = np.lexsort((ids, score))[: 2 * k]
            n = max(1, len(best))
            found = [pa.array(score[best]), pa.array(ids[best])] if len(best) else [pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64())]
            out.append(pa.record_batch([pa.array(np.full(n, node)), *found, pa.array(np.concatenate(([checked], np.zeros(n - 1, np.int64))))], schema=schema))
        return pa.Table.from_batches(out, schema)

    return every.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(tk.tidy_group(search), "node long, score double, id long, verified long")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query: query_id, rank from 1, ``id_col``, score (Euclidean distance), nearest first, and ``verified``, the number of
    vectors that were compared with the query's. The result is written."""
    scratch = storage.Scratch()
    nodes = scratch.cut(distinct_vectors(usable(vectors, id_col, vector_col), k))
    members = scratch.cut(usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")))
    asked = scratch.cut(members.groupBy("v").agg(F.min("id").alias("node"), F.size("v").alias("dim")).select("node", "v", "dim"))
    n, q = nodes.count(), asked.count()
    blocks = max(1, -(-n // ROW_BLOCK))
    active = scratch.cut(first_radii(nodes, asked, k, _groups(q)))
    best = Window.partitionBy("node").orderBy("score", "id")
    results, spent = [], None
    for round_ in range(ROUNDS + 1):
        parts = scratch.cut(searched(nodes, active, k, blocks, _groups(q)))
        work = parts.groupBy("node").agg(F.sum("verified").alias("verified"))
        spent = scratch.cut(work if spent is None else work.unionByName(spent).groupBy("node").agg(F.sum("verified").alias("verified")))
        top = parts.where("id is not null").withColumn("place", F.row_number().over(best)).where(F.col("place") <= 2 * k)
        top = scratch.cut(top.join(active.select("node", "radius"), "node").select("node", "score", "id", "radius"))
        if round_ == ROUNDS:
            results.append(top)
            break
        same = top.where("score <= radius").groupBy("node", "id").agg(F.count("*").alias("times"))
        enough = same.groupBy("node").agg(F.sum("times").alias("found"), F.max("times").alias("most")).where(F.col("found") >= k + F.col("most")).select("node")
        done = scratch.cut(enough.unionByName(active.where(~F.col("radius").between(0, 1e300)).select("node")).distinct())
        results.append(top.join(done, "node", "left_semi"))
        grown = F.lit(float("inf")) if round_ == ROUNDS - 1 else F.col("radius") * GROWTH
        active = scratch.cut(active.join(done, "node", "left_anti").withColumn("radius", grown).select("node", "v", "dim", "radius"))
        q = active.count()
        if not q:
            break
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    named = members.select(F.col("id").alias("query_id"), "v").join(asked.select("v", "node"), "v").select("query_id", "node")
    each = skew.lookup(named, found.join(spent, "node"), "node", "query_id", members.count()).where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    result = storage.cut(ranked.select("query_id", "rank", F.col("id").alias(id_col), "score", "verified"))
    scratch.close()
    return result
