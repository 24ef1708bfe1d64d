"""Approximate nearest neighbours by cosine with a forest of random-projection trees.

Trees are grown on a bounded sample; each splits by the plane between two of its vectors, at the median. Every
vector is then dropped through every tree. A query searches all trees through one priority queue: it opens the
node whose worst margin on the way from the root is best, until the leaves taken hold enough rows. Rows of the
taken leaves are compared exactly, in blocks, and each block passes on its best few.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import local, staged

TREES = 12
SAMPLE_ROWS = 16_384
LEAF_ROWS = 64
SHARE = 0.75  # rows in the taken leaves, counted in every tree, against all rows
LEAST_SEEN = 8192  # rows looked at in any case, counted in every tree
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024


class Forest:
    """Complete trees in heap order: a plane for every inner node."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 5):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf_rows))))
        self.trees, self.inner = trees, 2**self.depth - 1
        dims = sample.shape[1] if len(sample) else 0
        self.normals, self.offsets = np.zeros((trees, self.inner, dims)), np.zeros((trees, self.inner))
        rng = np.random.default_rng(seed)
        unit = _unit(sample)
        for tree in range(trees):
            rows = {0: np.arange(len(unit))}
            for node in range(self.inner):
                own = rows.pop(node)
                normal = rng.standard_normal(dims)
                if len(own) > 1:
                    a, b = unit[rng.choice(own, 2, replace=False)]
                    normal = a - b if (a != b).any() else normal
                normal /= np.linalg.norm(normal)
                side = unit[own] @ normal
                self.normals[tree, node], self.offsets[tree, node] = normal, np.median(side) if len(own) else 0.0
                above = side > self.offsets[tree, node]
                rows[2 * node + 1], rows[2 * node + 2] = own[~above], own[above]

    @property
    def leaves(self) -> int:
        return self.trees * (self.inner + 1)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through all trees."""
        unit, out = _unit(vectors), np.zeros((len(vectors), self.trees), np.int64)
        for tree in range(self.trees):
            at = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + ((unit * self.normals[tree, at]).sum(1) > self.offsets[tree, at])
            out[:, tree] = tree * (self.inner + 1) + at - self.inner
        return out

    def visit(self, vectors: np.ndarray, sizes: np.ndarray, enough: int) -> list[list[int]]:
        """For each query the leaves to compare, best first, until they hold ``enough`` rows."""
        unit, out = _unit(vectors), []
        for q in unit:
            margins = self.normals @ q - self.offsets
            queue = [(-np.inf, tree, 0) for tree in range(self.trees)]
            taken, held = [], 0
            while queue and held < enough:
                worst, tree, node = heapq.heappop(queue)
                if node >= self.inner:
                    leaf = tree * (self.inner + 1) + node - self.inner
                    if sizes[leaf]:
                        taken.append(leaf)
                        held += int(sizes[leaf])
                    continue
                margin = margins[tree, node]
                heapq.heappush(queue, (max(worst, margin), tree, 2 * node + 1))
                heapq.heappush(queue, (max(worst, -margin), tree, 2 * node + 2))
            out.append(taken)
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if len(vectors) else vectors


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query, by exact cosine; ties to smaller ids.

    The product of matrices only preselects: rounding in it depends on the place of a row, the sums of the
    final scores do not.
    """
    out = []
    if len(queries) and len(rows):
        q, v = np.stack(queries["vector"].to_list()), np.stack(rows["vector"].to_list())
        ids = rows["id"].to_numpy()
        size = np.sqrt((v * v).sum(1))
        rough = (_unit(q) @ (v / size[:, None]).T)
        for n, query_id in enumerate(queries["query_id"].tolist()):
            near = rough[n]
            others = np.flatnonzero(ids != query_id)
            if len(others) > k:
                kth = np.partition(near[others], len(others) - k)[len(others) - k]
                others = others[near[others] >= kth - 1e-9]
            score = (v[others] * q[n]).sum(1) / (size[others] * np.sqrt((q[n] * q[n]).sum()))
            order = np.lexsort((ids[others], -score))
            order = order[np.sort(np.unique(ids[others][order], return_index=True)[1])][:k]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[others][order], "score": score[order]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, trees: int = TREES, share: float = SHARE, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """The ``k`` nearest other rows of ``vectors`` (vec_id long, embedding array) for every row that ``queries`` picks.

    Columns: query_id, rank from 1, vec_id, score (cosine in double precision); ties go to the smaller vec_id,
    and a query with fewer candidates has all of them. Vectors that are null, zero, hold null or non-finite
    components, have no id, or are not as long as most are left out. Rows that share an id count once, with
    their best score. Other columns are left out. An empty table gives no rows. Every row is indexed; the trees
    are grown on ``sample_rows`` rows, those with the smallest hash.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    valid = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & fine)
    usual = valid.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    dims, total = (usual["dims"], usual["n"]) if usual else (0, 0)
    valid = valid.where(F.size("embedding") == dims)
    sample = local(valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows))
    stack = lambda s: np.stack([np.asarray(v, float) for v in s]) if len(s) else np.zeros((0, dims))
    forest = Forest(stack(sample["embedding"]), trees, leaf_rows)
    sent = vectors.sparkSession.sparkContext.broadcast(forest)  # planes of a bounded number of nodes

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "leaves": list(sent.value.assign(stack(batch["embedding"])))})

    leaves = valid.mapInPandas(drop, "vec_id long, leaves array<long>")
    sizes = np.zeros(forest.leaves, np.int64)
    for row in leaves.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # a row per leaf
        sizes[row["leaf"]] = row["count"]
    # Every leaf row is one of at most `trees` sightings of a candidate, so this many hold k others at least.
    enough = max(int(share * total), trees * (k + 1), LEAST_SEEN)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"query_id": batch["vec_id"], "vector": batch["embedding"], "leaves": sent.value.visit(stack(batch["embedding"]), sizes, enough)})

    asked = valid.where(queries).mapInPandas(visit, "query_id long, vector array<double>, leaves array<long>")
    asked = staged(asked.select("query_id", "vector", F.explode("leaves").alias("leaf")), "visits")
    times = {r["leaf"]: r["count"] for r in asked.groupBy("leaf").count().collect()}
    cut = np.maximum(1, -(-sizes // BLOCK_ROWS))
    turns = np.array([-(-times.get(n, 0) // BLOCK_QUERIES) for n in range(forest.leaves)])  # 0: nobody comes

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = sent.value.assign(stack(batch["embedding"]))
            at, tree = np.nonzero(turns[own])
            leaf, ids = own[at, tree], batch["vec_id"].to_numpy()
            row, turn = np.repeat(np.arange(len(at)), turns[leaf]), np.concatenate([np.arange(t) for t in turns[leaf]] or [np.zeros(0, np.int64)])
            mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = mixed.astype(np.int64)[at][row] % cut[leaf[row]]
            yield pd.DataFrame({"leaf": leaf[row], "block": block, "turn": turn, "id": ids[at[row]], "vector": batch["embedding"].to_numpy()[at[row]]})

    rows = valid.mapInPandas(members, "leaf long, block long, turn long, id long, vector array<double>")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaf = batch["leaf"].to_numpy()
            row, block = np.repeat(np.arange(len(leaf)), cut[leaf]), np.concatenate([np.arange(c) for c in cut[leaf]] or [np.zeros(0, np.int64)])
            mixed = (batch["query_id"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            turn = mixed.astype(np.int64) % np.maximum(1, turns[leaf])
            yield pd.DataFrame({"leaf": leaf[row], "block": block, "turn": turn[row], "query_id": batch["query_id"].to_numpy()[row], "vector": batch["vector"].to_numpy()[row]})

    comers = asked.mapInPandas(spread, "leaf long, block long, turn long, query_id long, vector array<double>")
    by = ("leaf", "block", "turn")
    few = comers.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(lambda q, v: _best(q, v, k), "query_id long, vec_id long, score double")
    best = few.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
