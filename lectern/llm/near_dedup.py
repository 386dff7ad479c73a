"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.shared import saved

BITS = 64
SEED = 42
WORDS = 3
BLOCK = 1 << 16
#: Buckets of up to this many texts are compared pair by pair; larger ones go through neighbour points instead.
PAIRWISE = 32
#: Cost of one index row against one comparison, for the choice of thresholds.
ROW_COST = 4.0


def simhash(text: str | None, width: int = WORDS) -> int:
    """Unsigned fingerprint: a bit is 1 if over half of the shingles' XXH64 have it. No words: zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = (b" ".join(s) for s in zip(*(words[i:] for i in range(width)))), len(words) - width + 1
    ones, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for start in range(0, n, BLOCK):
        size = min(BLOCK, n - start)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(size)), dtype="<u8", count=size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _simhashes(texts: pd.Series) -> pd.Series:
    found = np.fromiter((simhash(t) for t in texts), dtype="<u8", count=len(texts))
    return pd.Series(found.view("<i8"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every whole text as a signed bigint; no shuffle."""
    marked = F.pandas_udf(_simhashes, "bigint")
    return docs.select(F.col(id_col).alias("doc_id"), marked(F.col(text_col).cast("string")).alias("fp"))


def _bit_counts(batches):
    total = np.zeros((BITS, BITS))
    for batch in batches:
        bits = np.unpackbits(batch["fp"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        for at in range(0, len(bits), BLOCK):
            total += bits[at : at + BLOCK].T @ bits[at : at + BLOCK]
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pd.DataFrame({"i": i, "j": j, "n": total.reshape(-1).astype("int64")})


def together(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, over all of them: 64 x 64 whatever the input's size."""
    out = np.zeros((BITS, BITS))
    rows = fps.select("fp").mapInPandas(_bit_counts, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for i, j, n in rows.collect():
        out[i, j] = n
    return out


def group_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of near-equal size, each grown from its seed by the bit most correlated with it.

    Bits that vary together carry little news about each other, so keeping them in one group leaves the
    other groups as selective as they can be.
    """
    p = np.diag(counts) / max(n, 1)
    cov = counts / max(n, 1) - np.outer(p, p)
    spread = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    corr = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (corr[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _mask(bits: Sequence[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def same_part(fps: DataFrame, plans: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """For each (number of parts, part) the number of ordered pairs that agree on the whole part, counted over all fingerprints."""
    marks = [
        F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("v"))
        for m, groups in plans.items() for k, bits in enumerate(groups)
    ]
    values = fps.select(F.explode(F.array(*marks)).alias("x")).groupBy("x.m", "x.k", "x.v").agg(F.count("*").cast("double").alias("n"))
    rows = values.groupBy("m", "k").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()
    return {(m, k): pairs for m, k, pairs in rows}


def _index_rows(width: int, threshold: int) -> int:
    return {-1: 0, 0: 1, 1: width, 2: width + 1}[threshold]


def allocate(widths: list[int], agree: list[float], odds: list[np.ndarray], n: int, distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1: part unused) that sum to distance - parts + 1 at the least expected cost, by dynamic programming.

    ``agree``: pairs equal on a part; ``odds``: for each of its bits, the chance of differing over the chance of
    agreeing. Pairs at e differing bits are estimated as ``agree`` times the e-th elementary symmetric sum of the odds.
    """
    def cost(k: int, e: int) -> float:
        if e < 0:
            return 0.0
        s1, s2 = odds[k].sum(), (odds[k] ** 2).sum()
        near = agree[k] * sum([1.0, s1, (s1 * s1 - s2) / 2][: e + 1])
        return _index_rows(widths[k], e) * n * ROW_COST + min(max(near - n, 0.0) / 2, float(n) * n)

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for k in range(len(widths)):
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for e in range(-1, distance + 1):
                item = (spent + cost(k, e), [*chosen, e])
                if total + e not in new or item < new[total + e]:
                    new[total + e] = item
        best = new
    return best[distance - len(widths) + 1]


def plan_parts(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest division of the fingerprint, chosen from statistics of all fingerprints."""
    counts = together(fps)
    n = int(fps.count())
    p = np.diag(counts) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    plans = {m: group_bits(counts, n, m) for m in range(max(1, distance), distance + 3)}
    agree = same_part(fps, plans)
    choices = []
    for m, groups in plans.items():
        odds = [differ[g] / (1 - differ[g]) for g in groups]
        spent, thresholds = allocate([len(g) for g in groups], [agree.get((m, k), 0.0) for k in range(m)], odds, n, distance)
        choices.append((spent, m, [(g, e) for g, e in zip(groups, thresholds) if e >= 0]))
    return min(choices)[2]


def _keys(parts: list[tuple[list[int], int]]) -> Column:
    """Index keys of a fingerprint: two that differ in at most a part's threshold there share a key of that part."""
    keys = []
    for k, (bits, e) in enumerate(parts):
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        if e != 1:
            keys.append((k * (BITS + 1), own))
        for b in bits if e else ():
            near = own.bitwiseAND(F.lit(~_mask([b]))) if e == 1 else own.bitwiseXOR(F.lit(_mask([b])))
            keys.append((k * (BITS + 1) + (b + 1 if e == 1 else 0), near))
    return F.array(*[F.struct(F.lit(k).alias("part"), v.alias("key")) for k, v in keys])


def _near(x: Column, y: Column, distance: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= distance


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints within ``distance`` bits into one component.

    Fingerprints share a bucket when they agree on a part up to its threshold. In a bucket of at most ``PAIRWISE``
    texts each pair is verified. A larger one (a group of near copies, a common value) never forms pairs: each
    member names itself and its 64 neighbours as meeting points, at most 65 fingerprints can meet at a point, and
    those that do differ by at most two bits; for distance 1 the points are the 64 values with one bit left out.
    Both ways are exact, so no pair is lost and the work stays proportional to the number of fingerprints.
    """
    if distance not in (0, 1, 2):
        raise ValueError("distance must be 0, 1 or 2")
    if distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("a <> b")
    parts = plan_parts(fps, distance)
    index = fps.select("fp", F.explode(_keys(parts)).alias("x")).select("fp", "x.part", "x.key")
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("size")).filter("size > 1")
    index = saved(index.join(sizes, ["part", "key"]), "buckets")

    small = index.filter(F.col("size") <= PAIRWISE).groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda x: F.transform(
        F.filter("fps", lambda y: (x > y) & _near(x, y, distance)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    verified = small.select(F.explode(pairs).alias("x")).select("x.a", "x.b")

    hot = index.filter(F.col("size") > PAIRWISE).select("fp").distinct()
    if distance == 2:
        points = [F.struct(F.lit(0).alias("bit"), F.col("fp").alias("at"))]
        points += [F.struct(F.lit(0).alias("bit"), F.col("fp").bitwiseXOR(F.lit(_mask([b]))).alias("at")) for b in range(BITS)]
    else:
        points = [F.struct(F.lit(b).alias("bit"), F.col("fp").bitwiseAND(F.lit(~_mask([b]))).alias("at")) for b in range(BITS)]
    met = hot.select("fp", F.explode(F.array(*points)).alias("x")).groupBy("x.bit", "x.at").agg(F.collect_list("fp").alias("fps"))
    met = met.filter(F.size("fps") > 1).withColumn("low", F.array_min("fps"))
    meeting = met.select(F.explode("fps").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return verified.union(meeting).distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same) for every row of ``docs``.

    ``fingerprint``: 16 lower-case hex digits. ``component_id``: smallest doc_id reachable over links of at most
    ``distance`` differing bits, the row itself included. ``n_same``: rows with this very fingerprint. Equal
    fingerprints are one node, so copies never form pairs. A null text counts as empty: fingerprint zero, linked like
    any other. A null doc_id gives way to any other id of its component (null if there is none). Repeated rows are
    returned as often as they come; other columns take no part; an empty table gives an empty result.
    """
    fps = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")), "nodes")
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, "root").select("fp", "component_id", "n_same")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(labels, "fp").select("doc_id", digits.alias("fingerprint"), "component_id", "n_same")


def keep_one(docs: DataFrame, distance: int = 2) -> DataFrame:
    """The documents without their near-duplicates: of each group the row with the smallest doc_id stays, once.

    Columns are those of ``docs``. A document without an id names no group and stays.
    """
    groups = near_duplicates(docs, distance).filter("doc_id is not null")
    kept = groups.groupBy(F.col("doc_id").alias("_kept")).agg(F.min("component_id").alias("_group")).filter("_kept = _group").select("_kept")
    order = W.partitionBy("_kept").orderBy(F.xxhash64("text"), "text")
    named = docs.join(kept, F.col("doc_id") == F.col("_kept")).withColumn("_copy", F.row_number().over(order)).filter("_copy = 1")
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


