"""Mixing of sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import WORD, saved, unnamed

EPOCHS = 3.0
#: Each source's documents are dealt by hash into so many slots; the fractional repetition ends inside one of them.
SLOTS = 4096
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def slot(key: Column, seed: str = SEED) -> Column:
    """The seeded place of a document in its source's order: its slot, from 0."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))) 
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def rank_sources(sources: DataFrame) -> DataFrame:
    """Adds ``place`` (bigint, from 0) by code point, null last, without bringing all sources into one task."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    dealt = saved(dealt, "sources")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("_in", inside).join(starts, "_part").withColumn("place", F.col("_start") + F.col("_in") - 1).drop("_part", "_in", "_start")


def fill(sources: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): all sizes shared by weight, none above ``epochs`` times its source.

    A source whose share exceeds its cap is clamped there, and what is left is shared by weight among the others, until
    no share is above its cap. A level (target per weight) rises round by round; the driver sees three sums a round, and
    rounds end when no further source is clamped. If every source is clamped, all get their caps.
    """
    sources = saved(sources.withColumn("_cap", F.col("source_size") * F.lit(float(epochs))), "weights")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    full = F.col("_cap") <= F.lit(0.0)
    while True:
        n, caps, free = sources.agg(
            F.count_if(full), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("weight").cast("double")))
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - (caps or 0.0)) / free
        full = F.col("_cap") <= F.col("weight") * F.lit(level)
    target = F.when(full, F.col("_cap")).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", target).drop("_cap")


def cycle_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, ... ``cycle``, repeating, over the sources by code point, null last."""
    return rank_sources(sources).withColumn("weight", F.pmod("place", F.lit(cycle)) + 1).drop("place")


def _rates(sized: DataFrame, targets: DataFrame, slots: int) -> DataFrame:
    """(source, source_size, target, whole, cut, part): whole repetitions of every document, one more of the slots
    below ``cut``, and the share ``part`` of one more of slot ``cut`` itself."""
    sums = sized.groupBy("source", "slot").agg(F.sum("size").alias("_sum"))
    goal = F.floor("target")
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("_rest", goal - F.col("whole") * F.col("source_size"))
    joined = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("t.source", "slot", "_sum", "_rest")
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = joined.withColumn("_before", before).filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_sum")))
    cuts = place.select(F.col("source").alias("_cut_source"), F.col("slot").alias("cut"), ((F.col("_rest") - F.col("_before")) / F.col("_sum")).alias("part"))
    out = targets.join(cuts, F.col("source").eqNullSafe(F.col("_cut_source")), "left")
    return out.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(slots)).alias("cut"), F.coalesce("part", F.lit(0.0)).alias("part"))


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = EPOCHS, seed: str = SEED, text: Column | None = None) -> DataFrame:
    """Every document with what the mix takes of it: doc_id, source, size, source_size, target, taken.

    ``weights`` (source, weight): by default 1, 2, 3 repeating over the sources by code point, null last; a source that
    it leaves out weighs nothing. Sizes are words; a null text has none. ``taken`` counts words: floor(target / source
    size) whole repetitions of each document, and one more of the documents that come first in a seeded order until the
    target is met; the documents of the slot where it is met are taken in part. So a source's sum is within one word a
    document of that slot of its target, no document exceeds ``epochs`` times its size (rounded down), and reruns agree.

    A null source is a source. A null doc_id has a place of its own in the order. Repeated rows count as often as they
    come. Extra columns take no part. An empty table gives an empty result. Sources need not be few: sums combine before
    the shuffle, each source's order is summed over at most 4096 slots, and no document is sorted.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text") if text is None else text).alias("size"), slot(F.col("doc_id"), seed).alias("slot"))
    return _mix(saved(sized, "sizes"), weights, epochs)


def _targets(sized: DataFrame, weights: DataFrame | None, epochs: float) -> DataFrame:
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        return fill(cycle_weights(sources), epochs)
    named = weights.select(F.col("source").alias("_source"), "weight")
    weighed = sources.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return fill(weighed.fillna(0, ["weight"]), epochs)


def _taken(size: Column) -> Column:
    return (F.col("whole") * size + F.when(F.col("slot") < F.col("cut"), size).when(
        F.col("slot") == F.col("cut"), F.floor(size * F.col("part") + 0.5)).otherwise(0)).cast("bigint")


def _mix(sized: DataFrame, weights: DataFrame | None, epochs: float) -> DataFrame:
    rates = saved(_rates(sized, _targets(sized, weights, epochs), SLOTS), "rates").withColumnRenamed("source", "_source")
    mixed = sized.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", _taken(F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, weights: DataFrame | None = None, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it whole, and once more cut after the words
    that it takes in part. Columns are those of ``docs`` (n_chars, where there is one, follows the text)."""
    sized = saved(docs.select("source", word_count(F.col("text")).alias("size"), slot(F.col("doc_id"), seed).alias("slot")), "sizes")
    rates = saved(_rates(sized, _targets(sized, weights, epochs), SLOTS), "rates")
    rates = rates.select(F.struct(*rates.columns).alias("rate"))
    plain, names, back = unnamed(docs)
    old = F.col(names["text"])
    mixed = plain.withColumn("size", word_count(old)).withColumn("slot", slot(F.col(names["doc_id"]), seed))
    mixed = mixed.join(rates, F.col(names["source"]).eqNullSafe(F.col("rate.source")))
    more = F.when(F.col("slot") < F.col("rate.cut"), F.col("size")).when(
        F.col("slot") == F.col("rate.cut"), F.floor(F.col("size") * F.col("rate.part") + 0.5)).otherwise(0).cast("int")
    whole = (F.col("rate.whole") + (more == F.col("size")).cast("int")).cast("int")
    cut = F.when((more > 0) & (more < F.col("size")), more).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.filter(F.array(cut), lambda x: x > 0))
    rows = mixed.withColumn("words", F.explode(copies))
    ends = F.split(old, rf"(?<={WORD[:-1]})(?={WORD[:1]}{WORD[2:-1]})")
    first = F.array_join(F.slice(ends, 1, F.greatest(F.col("words"), F.lit(1))), "")
    rows = rows.withColumn(names["text"], F.when(F.col("words") > 0, first).otherwise(old))
    if "n_chars" in names:
        count, kind = names["n_chars"], docs.schema["n_chars"].dataType
        rows = rows.withColumn(count, F.when(F.col("words") > 0, F.length(old).cast(kind)).otherwise(F.col(count)))
    return rows.select(*back)
