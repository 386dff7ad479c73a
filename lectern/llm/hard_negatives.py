"""Hard-negative mining: angles to reference directions bound inner products, windows that overlap are scored exactly."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import saved
from lectern.llm.vectors import LONGEST, finite, matrix, numbered, products, scaled

K = 5
#: Reference directions, chosen among so many rows (those of the smallest hashes); they steer the pruning, not the result.
REFERENCES, SAMPLE = 16, 1024
#: Rows of a shard, anchors of a block, rows of a window, anchors scored at a time.
SHARD_ROWS, BLOCK_ANCHORS, WINDOW, TILE = 8192, 4096, 64, 256
#: More than arccos and the products can be off, in radians.
SLACK = 1e-6
SEED = 42

_FOUND = "anchor bigint, want bigint, row bigint, vec_id bigint, score bigint"


def references(vectors: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors along ``count`` of the given vectors, each as far in angle from those before as possible."""
    length = np.sqrt((vectors**2).sum(axis=1))
    units = vectors[(length > 0) & np.isfinite(length)] / length[(length > 0) & np.isfinite(length), None]
    if not len(units):
        return np.empty((0, vectors.shape[1]))
    picked, nearest = [0], units @ units[0]
    while len(picked) < min(count, len(units)) and nearest.min() < 1 - 1e-9:
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[picked[-1]])
    return units[picked]


def angles(vectors: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to each direction). A null vector has a right angle to everything; where a norm is not finite,
    its angles are not numbers and rule nothing out."""
    with np.errstate(all="ignore"):
        norms = np.sqrt((vectors**2).sum(axis=1))
        cosines = np.where(norms[:, None] > 0, (vectors @ directions.T) / norms[:, None], 0.0)
        return norms, np.arccos(np.clip(cosines, -1, 1))


def bounds(norm: np.ndarray, angle: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of the inner products of anchors (norm, angle) with windows of rows whose angles lie between low
    and high and whose norms lie between least and most: anchors x windows.

    By the triangle inequality the angle between two vectors is at least the difference of their angles to any direction,
    and at most the sum, or what the sum lacks to a full turn. Both ends are moved outwards by more than rounding can do.
    """
    near = np.zeros((len(norm), len(least)))
    far = np.full_like(near, math.pi)
    with np.errstate(all="ignore"):
        for r in range(angle.shape[1]):
            own = angle[:, r, None]
            # fmax and fmin pass over what is not a number
            near = np.fmax(near, np.fmax(low[None, :, r] - own, own - high[None, :, r]))
            far = np.fmin(far, np.fmin(own + high[None, :, r], 2 * math.pi - own - low[None, :, r]))
        top, bottom = np.cos(np.maximum(near - SLACK, 0)), np.cos(np.minimum(far + SLACK, math.pi))
        upper = norm[:, None] * np.where(top >= 0, most, least)[...] * top
        lower = norm[:, None] * np.where(bottom >= 0, least, most)[...] * bottom
        give = SLACK * norm[:, None] * most + SLACK
        upper, lower = upper + give, lower - give
    return np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)


def _overlaps(lower: np.ndarray, upper: np.ndarray, wants: list) -> np.ndarray:
    """anchors x windows: whether a window's interval of scores meets what the anchor wants."""
    out = np.zeros(lower.shape, dtype=bool)
    for i, mine in enumerate(wants):
        for want in mine:
            out[i] |= (upper[i] >= want["low"]) & (lower[i] <= want["high"])
    return out


def _best(scores: np.ndarray, ids: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores among the able, ties to the smaller id."""
    places = np.flatnonzero(able)
    if len(places) > k:
        own = scores[places]
        kth = np.sort(own)[-k] if own.dtype == object else np.partition(own, len(own) - k)[-k]
        places = places[own >= kth]
    return np.array(sorted(places, key=lambda p: (-scores[p], ids[p]))[:k], dtype=np.int64)


def _search(k: int, same: bool):
    """The best rows of one shard for each anchor and want, of the anchor's label or of the others."""
    def run(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(asked):
            vectors, ids, rows, labels = matrix(shard["vector"]), shard["vec_id"].to_numpy(), shard["row"].to_numpy(), shard["label"].to_numpy()
            turn, starts = matrix(shard["angles"]).reshape(len(shard), -1), range(0, len(shard), WINDOW)
            norms = shard["norm"].to_numpy()
            low, high = (np.stack([f(turn[s : s + WINDOW], axis=0) for s in starts]) for f in (np.fmin.reduce, np.fmax.reduce))
            least, most = (np.array([f(norms[s : s + WINDOW]) for s in starts]) for f in (np.min, np.max))
            for at in range(0, len(asked), TILE):
                tile = asked.iloc[at : at + TILE]
                wanted, wants = matrix(tile["vector"]), [list(w) for w in tile["wants"]]
                lower, upper = bounds(tile["norm"].to_numpy(), matrix(tile["angles"]).reshape(len(tile), -1), low, high, least, most)
                open_ = _overlaps(lower, upper, wants)
                scores, scored = np.zeros((len(tile), len(shard)), dtype=object if _long(wanted, vectors) else np.float64), np.zeros((len(tile), len(shard)), dtype=bool)
                for w in np.flatnonzero(open_.any(axis=0)):
                    some, span = np.flatnonzero(open_[:, w]), slice(w * WINDOW, (w + 1) * WINDOW)
                    scores[some, span] = products(wanted[some], vectors[span])
                    scored[some, span] = True
                for i, (anchor, label) in enumerate(zip(tile["anchor"], tile["label"])):
                    able = scored[i] & ((labels == label) if same else (labels != label)) & (rows != anchor)
                    for want in wants[i]:
                        fit = able & (scores[i] >= want["low"]) & (scores[i] <= want["high"])
                        out += [(anchor, want["want"], rows[p], ids[p], int(scores[i][p])) for p in _best(scores[i], ids, fit, k)]
        return pd.DataFrame(out, columns=["anchor", "want", "row", "vec_id", "score"]).astype("int64")

    return run


def _long(a: np.ndarray, b: np.ndarray) -> bool:
    return products(a[:1] * 0 + np.abs(a).max(initial=0), b[:1] * 0 + np.abs(b).max(initial=0)).dtype == object


def _cells(rows: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    keys = ["dim", "shard", "block"]
    held = rows.join(asked.select(*keys).distinct(), ["dim", "shard"])
    held = held.select(*(F.col(c).alias(c) for c in held.columns))  # both sides stem from one table: columns of their own
    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_search(k, same), _FOUND)


def _routes(asked: DataFrame, shards: DataFrame, blocks: int, groups: int) -> DataFrame:
    """(anchor, shard) of the shards whose bounds meet what the anchor wants; groups of shards meet blocks of anchors."""
    def run(some: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(mine):
            return pd.DataFrame({"anchor": [], "shard": []}).astype("int64")
        low, high = (matrix(some[c]).reshape(len(some), -1) for c in ("low", "high"))
        lower, upper = bounds(mine["norm"].to_numpy(), matrix(mine["angles"]).reshape(len(mine), -1), low, high, some["least"].to_numpy(), some["most"].to_numpy())
        i, j = np.nonzero(_overlaps(lower, upper, [list(w) for w in mine["wants"]]))
        return pd.DataFrame({"anchor": mine["anchor"].to_numpy()[i], "shard": some["shard"].to_numpy()[j]})

    some = shards.withColumn("group", F.pmod("shard", F.lit(groups))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    mine = asked.select("dim", "block", "anchor", "norm", "angles", "wants").withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    keys = ["dim", "group", "block"]
    return some.groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInPandas(run, "anchor bigint, shard bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "want").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best(rows: DataFrame, asked: DataFrame, shards: DataFrame, k: int, same: bool, blocks: int, groups: int) -> DataFrame:
    """The best ``k`` rows for each anchor and want: anchor, want, row, vec_id, score, rank.

    ``asked`` has an anchor's vector, label, home shard and wants (want, low, high: an interval of scores). The home shard
    is searched first; its kth score raises low, and the other shards are searched only where their bounds still meet it.
    """
    home = saved(_cells(rows, asked, k, same), "home")
    floors = _ranked(home, k).filter(F.col("rank") == k).select("anchor", "want", F.col("score").alias("floor"))
    wants = asked.select("anchor", F.inline("wants")).join(floors, ["anchor", "want"], "left")
    wants = wants.groupBy("anchor").agg(F.collect_list(F.struct("want", F.greatest("low", "floor").alias("low"), "high")).alias("wants"))
    asked = saved(asked.drop("wants").join(wants, "anchor"), "asked")
    routes = _routes(asked, shards, blocks, groups)
    others = asked.withColumnRenamed("shard", "home").join(routes, "anchor").filter("shard <> home").drop("home")
    return _ranked(home.union(_cells(rows, others, k, same)), k)


def mine(embeddings: DataFrame, anchors: str = "vec_id % 100 = 0", k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), as the contract has them.

    Rows take part if label, vec_id and vector are there and all components are finite; a table without labels gives
    nothing. Rows count one by one: another row with the anchor's id is a candidate like any other, each row of a
    repeated anchor id mines for itself, and a repeated positive does so in each of its places. Vectors of different
    lengths do not meet. Ties go to the smaller vec_id. Scores beyond a long count as the outermost long. Columns other
    than vec_id, label and embedding take no part.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")
    rows = embeddings.filter(finite(F.col("embedding"))).filter("label is not null and vec_id is not null").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), scaled(F.col("embedding")).alias("vector"))
    rows = saved(numbered(rows.filter(finite(F.col("vector")))).withColumn("dim", F.size("vector")), "vectors")
    count, asked_count = rows.agg(F.count("*"), F.count_if(F.expr(anchors))).first()
    drawn = rows.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).select("vector").toPandas()["vector"]
    dim = drawn.map(len).mode()[0] if len(drawn) else 0
    drawn = [v for v in drawn if len(v) == dim]
    directions = references(np.array(drawn, dtype=np.float64).reshape(len(drawn), dim))

    def turned(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"norm": [0.0] * len(vectors), "angles": [[]] * len(vectors)}, dtype=object)
        for size in set(map(len, vectors)):
            own = np.flatnonzero(vectors.map(len) == size)
            norms, turn = angles(matrix(vectors.iloc[own]), directions if size == dim else np.empty((0, size)))
            for i, n, t in zip(own, norms, turn):
                out.iat[i, 0], out.iat[i, 1] = float(n), t.tolist()
        return out

    rows = rows.withColumn("turned", F.pandas_udf(turned, "norm double, angles array<double>")("vector")).select("*", "turned.*").drop("turned")
    # neighbours in angle share windows and shards; equal vectors are told apart by their row numbers
    near = F.array_position("angles", F.array_min("angles"))
    parts = max(1, -(-count // shard_rows))
    dealt = rows.repartitionByRange(parts, "dim", near, F.array_min("angles"), "row").sortWithinPartitions("dim", near, F.array_min("angles"), "row")
    rows = saved(dealt.withColumn("shard", F.spark_partition_id().cast("bigint")), "shards")
    ends = [f(F.get("angles", i)) for f in (F.min, F.max) for i in range(len(directions))]
    shards = rows.groupBy("dim", "shard").agg(
        F.array(*ends[: len(directions)]).cast("array<double>").alias("low"), F.array(*ends[len(directions):]).cast("array<double>").alias("high"),
        F.min("norm").alias("least"), F.max("norm").alias("most"))
    shards = saved(shards if not len(directions) else shards.withColumns({
        c: F.when(F.col("dim") == dim, F.col(c)).otherwise(F.array().cast("array<double>")) for c in ("low", "high")}), "bounds")
    blocks, groups = max(1, -(-asked_count // BLOCK_ANCHORS)), max(1, -(-parts // BLOCK_ANCHORS))

    asked = rows.filter(anchors).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vector", "dim", "norm", "angles", "shard")
    asked = asked.withColumn("block", F.pmod(F.hash("anchor"), F.lit(blocks)))
    any_score = F.array(F.struct(F.lit(0).cast("bigint").alias("want"), F.lit(-LONGEST - 1).alias("low"), F.lit(LONGEST).alias("high")))
    positives = best(rows, asked.withColumn("wants", any_score), shards, k, True, blocks, groups)
    positives = saved(positives.select("anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # 80 p <= 100 n <= 100 p: from p less a fifth, rounded up, to p
    low = F.col("positive_score") - F.expr("positive_score div 5") - F.when((F.col("positive_score") < 0) & (F.col("positive_score") % 5 != 0), F.lit(-1)).otherwise(F.lit(0))
    wants = positives.groupBy("anchor").agg(F.collect_set(F.struct(F.col("positive_score").alias("want"), low.alias("low"), F.col("positive_score").alias("high"))).alias("wants"))
    negatives = best(rows, asked.join(wants, "anchor"), shards, k, False, blocks, groups)
    names = asked.select("anchor", "anchor_id")
    found = positives.join(negatives.select("anchor", F.col("want").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "positive_score"])
    return found.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(CAST(x AS DOUBLE) * 256) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS INTEGER) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same WHERE 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
"""
