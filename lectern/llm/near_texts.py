"""Near copies by SimHash and the generalised pigeonhole principle, links counted by exact Jaccard similarity of five-word shingles.

Fingerprints within two bits find the close copies; MinHash bands beside them find the links that lie more bits apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.near_dedup import BITS, links
from lectern.llm.shared import saved

WORDS = 5
SIMILARITY = 0.8
SEED = 42
#: Differing bits up to which fingerprints make candidates.
DISTANCE = 2
#: Two texts of similarity s share a band with chance 1 - (1 - s^ROWS)^BANDS: 0.9997 at 0.8.
BANDS, ROWS = 20, 5
#: Buckets of up to this many texts are compared pair by pair, larger ones in blocks of ``TILE`` texts.
PAIRWISE, TILE = 32, 128
BLOCK = 1 << 12
#: Shingles whose counts are multiplied at a time.
COLUMNS = 1 << 14
#: Up to here row numbers are broadcast (some 30 bytes each); more of them meet the rows by a shuffle.
BROADCAST_ROWS = 500_000

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
_TIMES, _PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of ``width`` words; fewer words are one run, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    runs = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), dtype="<u8"))


def _bands(found: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[at : at + BLOCK] * _TIMES + _PLUS).min(axis=1))
    rows = np.ascontiguousarray(least.reshape(BANDS, ROWS))
    return [xxhash.xxh64_intdigest(r.tobytes()) - (1 << 63) for r in rows]


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed number: a bit is set if over half of them have it."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(found), BLOCK):
        part = np.ascontiguousarray(found[at : at + BLOCK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def _marks(texts: pd.Series) -> pd.DataFrame:
    """Of each text the key of its set of shingles, its fingerprint and its bands."""
    sets = [shingles(t) for t in texts]
    return pd.DataFrame({
        "node": [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], "fp": [fingerprint(s) for s in sets], "bands": [_bands(s) for s in sets]})


def close_fingerprints(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that join those of equal fingerprints, and fingerprints within ``distance`` bits."""
    lows = saved(nodes.groupBy("fp").agg(F.min("node").alias("low")), "fingerprints")
    equal = nodes.join(lows, "fp").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    x, y = (lows.select(F.col("fp").alias(f"fp_{n}"), F.col("low").alias(n)) for n in "ab")
    near = links(lows.select("fp"), distance).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return equal.union(near.join(x, "fp_a").join(y, "fp_b").select("a", "b"))


def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)


def jaccard(x: bytes, y: bytes) -> float:
    a, b = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose similarity, counted on the whole sets, is high enough."""
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(a, b) >= similarity for a, b in zip(x, y)], dtype=bool)

    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"set_{n}"), F.col("n").alias(f"n_{n}")) for n in "ab")
    # sizes alone rule many pairs out
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(similarity)
    both = pairs.join(x, "a").join(y, "b").filter(near)
    return both.filter(F.pandas_udf(similar, "boolean")("set_a", "set_b")).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not known to belong together."""
    for end in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``. Shingles are sorted and distinct in a set."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    both = np.intersect1d(np.unique(np.concatenate([*a, np.empty(0, "<u8")])), np.unique(np.concatenate([*b, np.empty(0, "<u8")])), assume_unique=True)
    for at in range(0, len(both), COLUMNS):
        some = both[at : at + COLUMNS]
        sides = []
        for sets in (a, b):
            side = np.zeros((len(sets), len(some)), dtype=np.float32)  # counts of up to COLUMNS are exact
            for i, s in enumerate(sets):
                own = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], side="right")]
                places = np.searchsorted(some, own)
                side[i, places[some[np.minimum(places, len(some) - 1)] == own]] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _tile_links(similarity: float):
    """Links between two blocks of a bucket, or within one, as far as they join what is still apart."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows["part"].min()
        sides = [rows[rows["part"] == first], rows[rows["part"] == rows["part"].max()]]
        a, b = ([np.frombuffer(x, dtype="<u8") for x in side["shingles"]] for side in sides)
        sizes = [np.array([len(x) for x in side]) for side in (a, b)]
        common = overlaps(a, b)
        union = sizes[0][:, None] + sizes[1][None, :] - common
        names = [side["node"].to_numpy() for side in sides]
        root = dict(zip(rows["node"], rows["root"]))
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        out = []
        for i, j in zip(*np.nonzero((common >= similarity * union) & (names[0][:, None] != names[1][None, :]))):
            x, y = top(root[names[0][i]]), top(root[names[1][j]])
            if x != y:
                above[x] = y
                out.append((names[0][i], names[1][j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _large_links(index: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links that join the components of a large bucket, all its pairs counted: block against block, sets and all.

    Texts lie in order of component and size, so blocks of one component, and blocks whose sizes alone keep every pair
    below ``similarity``, need no comparison; buckets of the same texts are one. A task holds two blocks.
    """
    large = index.filter(F.col("size") > PAIRWISE).select("band", "key", "node")
    named = large.join(roots, "node", "left").join(sets.select("node", "n"), "node").withColumn("root", F.coalesce("root", "node"))
    kinds = named.groupBy("band", "key").agg(
        F.min("root").alias("one"), F.max("root").alias("other"), F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    kinds = kinds.filter("one <> other").groupBy("size", "mark").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "size")
    # places come from counts of (root, size) runs and a number within a bucket's range of node hashes: no bucket is sorted in one task
    named = saved(named.join(kinds, ["band", "key"]).withColumn("cut", F.ceil(F.col("size") / F.lit(TILE)).cast("int")), "large")
    runs = named.groupBy("band", "key", "root").agg(F.count("*").alias("held"))
    big = runs.filter(F.col("held") > TILE).select("band", "key", "root", F.ceil(F.col("held") / F.lit(TILE)).cast("int").alias("pieces"))
    dealt = named.join(big, ["band", "key", "root"], "left")
    # a component of many texts has blocks of its own; the texts of the small ones share blocks
    own = F.concat_ws("/", F.col("root").cast("string"), F.pmod(F.xxhash64("node"), F.col("pieces")).cast("string"))
    shared = F.concat(F.lit("-/"), F.pmod(F.xxhash64("root"), F.col("cut")).cast("string"))
    dealt = dealt.withColumn("part", F.when(F.col("pieces").isNotNull(), own).otherwise(shared))
    parts = dealt.groupBy("band", "key", "part").agg(
        F.max(F.when(F.col("pieces").isNotNull(), F.col("root"))).alias("whole"), F.min("n").alias("low"), F.max("n").alias("high"))
    parts = saved(parts, "parts")
    x, y = (parts.select("band", "key", *(F.col(c).alias(f"{c}_{n}") for c in ("part", "whole", "low", "high"))) for n in "xy")
    pairs = x.join(y, ["band", "key"]).filter("part_x <= part_y").filter("not (whole_x <=> whole_y and whole_x is not null)")
    pairs = pairs.filter((F.col("high_x") >= F.col("low_y") * F.lit(similarity)) & (F.col("high_y") >= F.col("low_x") * F.lit(similarity)))
    tasks = pairs.select("band", "key", "part_x", "part_y", F.explode(F.array_distinct(F.array("part_x", "part_y"))).alias("part"))
    held = tasks.join(dealt.select("band", "key", "part", "node", "root"), ["band", "key", "part"]).join(sets.select("node", "shingles"), "node")
    return held.groupBy("band", "key", "part_x", "part_y").applyInPandas(_tile_links(similarity), "a bigint, b bigint")


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` (of numbers), to be broadcast if a count shows that they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def similar_groups(marked: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of every text of ``marked`` (row, node, fp, bands, text) that has a near copy.

    Texts whose fingerprints are close are candidates, and so are texts that share a band. First fingerprints are
    searched and each text is compared with the smallest one it shares a band with, then the
    candidates that are still apart with each other: all pairs of a bucket of up to ``PAIRWISE`` texts one by one, those
    of a larger one in blocks. Every link is counted on the whole sets of shingles; of a component only as many links
    are kept as join it, and large groups of near copies, one component after the first step, never form their pairs.
    """
    nodes = saved(marked.groupBy("node").agg(F.min("row").alias("row"), F.min("fp").alias("fp"), F.min("bands").alias("bands")), "nodes")
    close = saved(close_fingerprints(nodes.select("node", "fp")), "close")
    index = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = index.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("node").alias("low")).filter("size > 1")
    index = saved(index.join(sizes, ["band", "key"]), "bands")

    named = index.select("node").union(close.select("a")).union(close.select("b")).distinct()
    held = saved(named.join(nodes, "node").select("node", "row"), "held")
    texts = marked.select("row", "text").join(_few(held), "row")
    sets = texts.select("node", F.pandas_udf(_packed, "binary")("text").alias("shingles"))
    sets = saved(sets.withColumn("n", F.octet_length("shingles") / 8), "shingles")

    first = index.groupBy("node").agg(F.min("low").alias("b")).select(F.col("node").alias("a"), "b").filter("a <> b")
    first = saved(_verified(close.union(first).distinct(), sets, similarity), "links")
    roots = saved(components(first), "roots")

    small = index.filter(F.col("size") <= PAIRWISE).groupBy("band", "key").agg(F.collect_list("node").alias("nodes"))
    pairs = F.flatten(F.transform("nodes", lambda x: F.transform(F.filter("nodes", lambda y: y < x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = small.select(F.explode(pairs).alias("x")).select("x.a", "x.b").distinct()
    second = _verified(saved(_apart(pairs, roots), "pairs"), sets, similarity)
    third = _large_links(index, sets, roots, similarity)
    return components(first.union(second).union(third))


def keep_distinct(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without their near copies: of each group one row stays, that of the smallest doc_id (null last).

    Texts are near copies when the sets of their five-word runs (ASCII lower case, white space apart) have a Jaccard
    similarity of at least ``similarity`` and close fingerprints, or a common band, as all but three of 10,000 such pairs have; groups are closed
    under it. Rows count one by one: an id that comes twice with unrelated texts loses neither, and copies without ids
    are reduced like others. Empty and null texts are copies of each other. Columns are those of ``docs``.
    """
    mark = F.pandas_udf(_marks, "node bigint, fp bigint, bands array<bigint>")
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
    whole = saved(whole.withColumn("mark", mark(F.col("doc.text").cast("string"))), "marked")  # row numbers hold from here on
    marked = whole.select("row", "mark.node", "mark.fp", "mark.bands", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    roots = similar_groups(marked).withColumnRenamed("node", "_node")
    rows = marked.select("row", "doc_id", F.xxhash64("text").alias("mark"), F.col("node").alias("_node"))
    rows = rows.join(roots, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row")
    least = rows.groupBy("root").agg(F.min(order).alias("least"), F.count("*").alias("size")).filter("size > 1")
    # few groups have copies: their roots go to the rows, so a group of any size stays spread; so do the texts
    gone = rows.join(_few(saved(least, "least")), "root").filter("row <> least.row").select("row")
    return whole.join(_few(saved(gone, "gone")), "row", "left_anti").select("doc.*")
