"""Exact top-k by inner product: ball-tree branch and bound in every shard, with a shared kth score."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import saved
from lectern.llm.vectors import EXACT, finite, matrix, numbered, products, scaled

K = 5
#: Vectors of a shard and queries of a block, on average: what one task holds.
SHARD_ROWS = 4096
BLOCK_QUERIES = 4096
LEAF = 48


class BallTree:
    """Balls around nested halves of the vectors; arrays indexed by node, children at 2i + 1 and 2i + 2."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.order = np.arange(len(ids))
        self.spans: dict[int, tuple[int, int]] = {}
        todo = [(0, 0, len(ids))]
        while todo:
            node, lo, hi = todo.pop()
            self.spans[node] = (lo, hi)
            if hi - lo > LEAF:
                part = self.order[lo:hi]
                own = vectors[part]
                # towards the two ends of the widest direction: the farthest vector from the mean, and the farthest from that
                a = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
                b = own[np.argmax(((own - a) ** 2).sum(axis=1))]
                mid = (lo + hi) // 2
                self.order[lo:hi] = part[np.argsort(own @ (b - a), kind="stable")]
                todo += [(2 * node + 1, lo, mid), (2 * node + 2, mid, hi)]
        self.ids, self.rows, self.vectors = ids[self.order], rows[self.order], vectors[self.order]
        self.nodes = sorted(self.spans)
        self.place = {n: i for i, n in enumerate(self.nodes)}
        balls = [self.vectors[slice(*self.spans[n])] for n in self.nodes]
        self.centers = np.stack([b.mean(axis=0) for b in balls])
        self.radii = np.array([np.sqrt(((b - c) ** 2).sum(axis=1).max()) for b, c in zip(balls, self.centers)])

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int):
        """(query, score, id) of what may be among a query's best k: scores of at least its floor, ties by smaller id, but
        for the query's own row.

        Nodes are opened by their bound, query . center + |query| radius; a node whose bound is below the kth score so
        far, or below the floor that other shards have set, holds nothing new, and neither does any node after it.
        """
        length = np.sqrt((queries**2).sum(axis=1))
        bounds = queries @ self.centers.T + length[:, None] * self.radii[None, :]
        bounds += 1e-6 * (1 + np.abs(bounds))  # rounding never closes a node that could matter
        for q in range(len(queries)):
            best: list[tuple[float, int]] = []  # (score, -id), smallest first
            bound, least = bounds[q], floors[q]
            heap = [(-bound[0], 0)]
            while heap:
                upper, node = heapq.heappop(heap)
                if -upper < least:
                    break
                lo, hi = self.spans[node]
                if 2 * node + 1 in self.spans:
                    for child in (2 * node + 1, 2 * node + 2):
                        if (b := bound[self.place[child]]) >= least:
                            heapq.heappush(heap, (-b, child))
                    continue
                scores = self.vectors[lo:hi] @ queries[q]
                for i in np.flatnonzero(scores >= least):
                    if self.rows[lo + i] != own[q]:
                        item = (float(scores[i]), -int(self.ids[lo + i]))
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                if len(best) == k:
                    least = max(least, best[0][0])
            for score, vec in best:
                yield q, score, -vec


def _scan(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    """As ``BallTree.search``, for components so large that only whole numbers of any length hold the sums."""
    for q in range(len(queries)):
        scores = products(queries[q : q + 1], vectors)[0]
        for score, vec in heapq.nsmallest(k, ((-s, i) for s, i, r in zip(scores, ids, rows) if r != own[q])):
            yield q, -score, int(vec)


def _search_cell(k: int):
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"ask": [], "vec_id": [], "score": []}).astype("int64")
        vectors, wanted = matrix(shard["vector"]), matrix(queries["vector"])
        ids, rows = shard["vec_id"].to_numpy("int64"), shard["row"].to_numpy("int64")
        own = queries["own"].to_numpy("int64")
        if np.abs(vectors).max(initial=0) * np.abs(wanted).max(initial=0) * max(vectors.shape[1], 1) < EXACT:
            floors = queries["least"].to_numpy("float64", na_value=-np.inf)
            order = np.argsort(ids, kind="stable")
            found = BallTree(ids[order], rows[order], vectors[order]).search(wanted, own, np.where(np.isnan(floors), -np.inf, floors), k)
        else:
            found = _scan(ids, rows, vectors, wanted, own, k)
        asks = queries["ask"].to_numpy("int64")
        return pd.DataFrame([(asks[q], vec, int(score)) for q, score, vec in found], columns=["ask", "vec_id", "score"]).astype("int64")

    return run


def _cells(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    keys = ["dim", "shard", "block"]
    found = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search_cell(k), "ask bigint, vec_id bigint, score bigint")
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Each query's ``k`` highest integer inner products: query_id, rank, vec_id, score; ties to the smaller vec_id.

    ``vectors`` (row bigint, vec_id bigint, vector array<double> of whole numbers), ``queries`` (own bigint, query_id
    bigint, vector); without row and own the ids stand for them. A query's own row is no candidate, nor is a vector of
    another length; every other row is one, also where ids or vectors repeat, and each row of ``queries`` is a query. Vectors are dealt into shards and queries into blocks
    by hash; a cell (shard, block) is searched by one task that holds about ``shard_rows`` vectors and ``block_queries``
    queries, whatever the tables' sizes. Each query is searched in one shard first, and its kth score there is the floor
    under which the other shards prune. Fewer candidates than ``k`` give fewer rows; empty tables give none; a null
    id or vector takes no part; scores beyond a long count as the outermost long.
    """
    rows = vectors.filter("vec_id is not null and vector is not null").select(
        "vec_id", "vector", F.col("row" if "row" in vectors.columns else "vec_id").alias("row"))
    asked = queries.filter("query_id is not null and vector is not null").select(
        "query_id", "vector", F.col("own" if "own" in queries.columns else "query_id").alias("own"), F.monotonically_increasing_id().alias("ask"))
    rows, asked = saved(rows, "vectors"), saved(asked, "queries")
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_queries))
    rows = rows.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int"))
    home = F.pmod(F.hash("ask"), F.lit(shards)).cast("bigint")
    asked = asked.withColumn("home", home)

    first = saved(_cells(rows, asked.select("dim", F.col("home").alias("shard"), "block", "ask", "own", "vector", F.lit(None).cast("double").alias("least")), k), "home")
    floor = _best(first, k).filter(F.col("rank") == k).select("ask", F.col("score").cast("double").alias("least"))
    others = asked.join(floor, "ask", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    second = _cells(rows, others.filter("shard <> home").select("dim", "shard", "block", "ask", "own", "vector", "least"), k)
    return _best(first.union(second), k).join(asked.select("ask", "query_id"), "ask").select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """The query of the contract: x becomes floor(256 x); queries are the rows whose vec_id ``every`` divides.
    Vectors that are null or hold a null or non-finite component take no part."""
    rows = embeddings.filter(finite(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(F.col("embedding")).alias("vector"))
    rows = saved(numbered(rows), "embeddings")
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("own"), F.col("vec_id").alias("query_id"), "vector")
    return top_k(rows, asked, k)
