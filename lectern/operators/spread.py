"""Building blocks that keep one hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.session import settle

ROWS_PER_CUT = 1_000_000
#: Distinct values that one task puts in order, and parts into which a range with more of them is cut.
SORT_ROWS, CUTS = 1 << 16, 1024
#: Rows of the small side in one list, in one broadcast, and how many broadcasts a join may take.
LIST_ROWS, BROADCAST_ROWS, BROADCASTS = 4096, 200_000, 16


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    rows_per_cut: int = ROWS_PER_CUT,
) -> DataFrame:
    """Equi-join whose big side may hold most of its rows under one key.

    A key with more than ``rows_per_cut`` rows is cut by a hash of the big side's own columns, and the
    small side's rows of that key are repeated once per cut; other keys are left alone. Only joins that
    keep the big side are safe this way.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"salted_join cannot run a {how} join")
    on = list(on)
    cuts = F.ceil(F.count("*") / rows_per_cut).cast("int")
    hot = big.groupBy(*on).agg(cuts.alias("_cuts")).filter("_cuts > 1")
    # at most rows / rows_per_cut keys are hot; whether that is small enough to broadcast is decided by its size
    hot = hot.toDF(*hot.columns)
    n = F.coalesce("_cuts", F.lit(1))
    cut = big.join(hot, on, "left").withColumn("_cut", F.pmod(F.xxhash64(*spread_by), n).cast("int")).drop("_cuts")
    copies = small.join(hot, on, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), n - 1))).drop("_cuts")
    return cut.join(copies, [*on, "_cut"], how).drop("_cut")


def fan_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str], broadcast_rows: int = BROADCAST_ROWS,
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """Inner equi-join on few keys whose result is far larger than both sides.

    A shuffle by such keys deals the work by bytes read and not by rows made, so a task or two would make nearly all rows.
    Here the small side's rows are gathered into lists of about ``list_rows``, which come to the big side where it is read,
    ``broadcast_rows`` rows at a time; rows are made from the lists in place. A small side too large for that is shuffled.
    """
    on = list(on)
    rest = [c for c in small.columns if c not in on]
    lists = F.ceil(F.count("*") / list_rows).cast("int")
    dealt = small.join(small.groupBy(*on).agg(lists.alias("_lists")), on).withColumn("_list", F.pmod(F.xxhash64(*rest), "_lists").cast("int"))
    held = settle(dealt.groupBy(*on, "_list").agg(F.collect_list(F.struct(*rest)).alias("_rows")), "lists")
    pieces = -(-(held.agg(F.sum(F.size("_rows"))).first()[0] or 0) // broadcast_rows)
    if pieces > BROADCASTS:
        made = [salted_join(big, held.drop("_list"), on, spread_by)]
    else:
        piece = F.pmod(F.xxhash64(*on, "_list"), F.lit(max(pieces, 1)))
        made = [big.join(F.broadcast(held.filter(piece == n).drop("_list")), on) for n in range(max(pieces, 1))]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.select(*big.columns, F.explode("_rows").alias("_row")).select(*big.columns, *[F.col("_row")[c].alias(c) for c in rest])


def _fold(kind: str, col: Column) -> Column:
    if kind == "sum":
        return F.sum(col)
    if kind == "max":
        return F.max(col)
    if kind == "last":
        return F.last(col, ignorenulls=True)
    raise ValueError(f"unknown fold {kind}")


def prefix_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    span: Column,
    folds: dict[str, tuple[str, str]],
    include_current: bool = False,
) -> DataFrame:
    """Running sum, max or last non-null value over each key's ordered rows.

    ``folds`` maps an output column to (input column, "sum" | "max" | "last"). ``span`` must not decrease
    along ``order``; it cuts each key into pieces that are scanned apart. One carried row per piece then
    brings in what came before, so a key with most of the rows still uses many tasks.
    """
    end = W.currentRow if include_current else -1
    orders = [F.col(o) if isinstance(o, str) else o for o in order]
    spanned = df.withColumn("_span", span)
    inside = W.partitionBy(*keys, "_span").orderBy(*orders).rowsBetween(W.unboundedPreceding, end)
    rows = spanned
    for out, (src, kind) in folds.items():
        rows = rows.withColumn(f"_in_{out}", _fold(kind, F.col(src)).over(inside))

    totals = []
    for out, (src, kind) in folds.items():
        if kind == "last":
            place = F.struct(*[_sort_key(o) for o in order])
            total = F.max_by(F.col(src), F.when(F.col(src).isNotNull(), place))
        else:
            total = _fold(kind, F.col(src))
        totals.append(total.alias(f"_all_{out}"))
    pieces = spanned.groupBy(*keys, "_span").agg(*totals)
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    for out, (_, kind) in folds.items():
        pieces = pieces.withColumn(f"_before_{out}", _fold(kind, F.col(f"_all_{out}")).over(before))
    carried = pieces.select(*keys, "_span", *[f"_before_{out}" for out in folds])

    joined = rows.join(carried, [*keys, "_span"], "left")
    for out, (_, kind) in folds.items():
        inner, outer = F.col(f"_in_{out}"), F.col(f"_before_{out}")
        if kind == "sum":
            value = F.coalesce(inner, F.lit(0)) + F.coalesce(outer, F.lit(0))
        elif kind == "max":
            value = F.greatest(inner, outer)
        else:
            value = F.coalesce(inner, outer)
        joined = joined.withColumn(out, value)
    return joined.drop("_span", *[f"_in_{o}" for o in folds], *[f"_before_{o}" for o in folds])


def _sort_key(order: Column | str) -> Column:
    return F.col(order) if isinstance(order, str) else order


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, tuple[Column, Column]], sort_rows: int = SORT_ROWS, cuts: int = CUTS
) -> DataFrame:
    """Values at exact ranks of each group, without sorting a group, or any one range of it, in one task.

    ``ranks`` maps an output column to (low, high) zero-based rank expressions over the column ``_n``
    (the group's count); the output interpolates linearly between the two by the fractional part of
    the rank in ``high`` (high = low + fraction). Equal values are counted first. Counts by magnitude
    find the range of values that holds a rank; a range of more than ``sort_rows`` distinct values is
    counted in ``cuts`` equal parts and narrowed to the part with the rank, again and again, and only
    what is left is put in order. The driver sees one number a round.
    """
    by = list(by)
    key = by or ["_all"]
    # a key the optimizer does not see through: joins on a literal would become nested loops
    data = df if by else df.withColumn("_all", F.pmod(F.xxhash64(value), F.lit(1)))
    data = data.filter(F.col(value).isNotNull())
    counts = settle(data.groupBy(*key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")), "counts")
    magnitude = F.floor(F.log2(F.abs(F.col("_v")) + 1e-300) * 64)
    bucket = F.when(F.col("_v") == 0, F.lit(0).cast("bigint")).when(
        F.col("_v") > 0, magnitude + 100000
    ).otherwise(-(magnitude + 100000))
    held = [F.sum("_c").alias("_bc"), F.count("*").alias("_values"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    sums = counts.groupBy(*key, bucket.alias("_b")).agg(*held)
    totals = sums.groupBy(*key).agg(F.sum("_bc").alias("_n"))
    running = W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    spans = sums.withColumn("_start", F.coalesce(F.sum("_bc").over(running), F.lit(0)))

    wanted = []
    for name, (low, high) in ranks.items():
        floor = F.floor(high).cast("bigint")
        wanted.append(
            F.struct(
                F.lit(name).alias("name"), low.cast("bigint").alias("lo"),
                F.when(high > floor, floor + 1).otherwise(floor).cast("bigint").alias("hi"),
                (high - low).cast("double").alias("frac"),
            )
        )
    targets = totals.select(*key, "_n", F.explode(F.array(*wanted)).alias("_t")).select(*key, "_n", "_t.*")
    points = targets.select(*key, "name", "frac", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_r"), "lo")
    here = (F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_start") + F.col("_bc"))
    asked = [*key, "name", "frac", "_r", "lo"]
    cols = [*asked, "_start", "_values", "_low", "_high"]
    found = settle(points.join(spans, key).filter(here).select(*cols), "ranks")
    while (found.agg(F.max("_values")).first()[0] or 0) > sort_rows:
        wide = found.filter(F.col("_values") > sort_rows)
        part = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * cuts), F.lit(cuts - 1))
        # the range's first and last value lie in different parts, so every round leaves fewer
        parts = _within(counts, wide, key).groupBy(*key, F.col("_start").alias("_from"), part.alias("_part")).agg(*held)
        before = W.partitionBy(*key, "_from").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.withColumn("_start", F.col("_from") + F.coalesce(F.sum("_bc").over(before), F.lit(0)))
        nearer = wide.select(*asked, F.col("_start").alias("_from")).join(parts, [*key, "_from"]).filter(here)
        found = settle(found.filter(F.col("_values") <= sort_rows).select(*cols).unionByName(nearer.select(*cols)), "ranks")

    inside = W.partitionBy(*key, "_start").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    ordered = _within(counts, found, key).withColumn("_from", F.col("_start") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    values = (
        found.select(*asked, "_start").join(ordered.select(*key, "_start", "_v", "_c", "_from"), [*key, "_start"])
        .filter((F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_from") + F.col("_c")))
    )
    weight = F.when(F.col("_r") == F.col("lo"), 1 - F.col("frac")).otherwise(F.col("frac"))
    blended = values.groupBy(*key, "name").agg(F.sum(F.col("_v") * weight).alias("_q"))
    out = blended.groupBy(*key).agg(
        *[F.max(F.when(F.col("name") == name, F.col("_q"))).alias(name) for name in ranks]
    )
    return out if by else out.drop("_all")


def _within(counts: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The counted values of the ranges (key, _start, _low, _high) that hold a rank."""
    ranges = found.select(*key, "_start", "_low", "_high").distinct()
    return counts.join(ranges, key).filter(F.col("_v").between(F.col("_low"), F.col("_high")))


def linear_rank(share: float) -> tuple[Column, Column]:
    """Rank of a percentile with linear interpolation, over the count ``_n``."""
    place = (F.col("_n") - 1) * F.lit(float(share))
    return F.floor(place), place


def nearest_low_rank(share: float) -> tuple[Column, Column]:
    """Rank of a percentile taken as the element at int(share*(n-1))."""
    place = F.floor((F.col("_n") - 1) * F.lit(float(share)))
    return place, place.cast("double")


def band_join(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    point: str,
    start: str,
    end: str,
    width: int = 64,
    how: str = "inner",
) -> DataFrame:
    """Rows of ``points`` whose position lies in [start, end] of the same key.

    Positions are cut into bands of ``width``; a range is repeated for each band it touches. The join
    key is (keys, band), so a long owner is spread and pairs outside the band are never compared.
    """
    cut = points.withColumn("_band", F.floor(F.col(point) / width).cast("bigint"))
    first = F.floor(F.col(start) / width).cast("bigint")
    last = F.floor(F.col(end) / width).cast("bigint")
    spread = ranges.filter(F.col(start) <= F.col(end)).withColumn("_band", F.explode(F.sequence(first, last)))
    inside = (F.col(f"_p.{point}") >= F.col(f"_r.{start}")) & (F.col(f"_p.{point}") <= F.col(f"_r.{end}"))
    same = inside
    for key in [*keys, "_band"]:
        same = same & (F.col(f"_p.{key}") == F.col(f"_r.{key}"))
    joined = spread.alias("_r").join(cut.alias("_p"), same, how)
    keep = [F.col(f"_r.{c}") for c in ranges.columns]
    keep += [F.col(f"_p.{c}") for c in points.columns if c not in ranges.columns]
    return joined.select(*keep)
