"""Quality rules: counts of a text's words, symbols and repeats, and a hashed n-gram log-likelihood ratio, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import saved

#: Words and symbols of the contract.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 3
MIN_WORDS = 50
#: Tokens of the n-grams: runs of letters and digits, and runs of other signs.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
#: Both multinomials are over so many buckets of hashed tokens and pairs of tokens.
BUCKETS = 1 << 14
#: Log ratios are whole thousandths, so that sums do not depend on their order.
SCALE = 1000
#: A document stays if its log ratio a n-gram is at least this (natural logarithm).
THRESHOLD = -0.06
#: Up to here the ids of trusted documents are broadcast (24 bytes each); more of them meet the documents by a shuffle.
BROADCAST_IDS = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def _repeated(words: Column) -> Column:
    """Words within a window of three that the text holds twice or more. Hashes find the texts without any;
    in the others equal windows stand side by side once sorted."""
    last = F.size(words) - WINDOW + 1
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(last, F.lit(0)))
    window = F.slice(
        F.transform(words, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))),
        F.lit(1), F.greatest(last, F.lit(0)))
    twice = let(F.sort_array(window), lambda s: F.sort_array(F.transform(
        F.filter(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), F.coalesce(
            (x["w"] == F.get(s, j - 1)["w"]) | (x["w"] == F.get(s, j + 1)["w"]), x["w"] == F.get(s, j - 1)["w"],
            x["w"] == F.get(s, j + 1)["w"], F.lit(False)).alias("again"))), lambda x: x["again"]),
        lambda x: x["i"])))
    covered = F.aggregate(
        twice, F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")), lambda a: a["n"])
    distinct = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(last < 2, F.lit(0).cast("bigint")).when(distinct, F.lit(0).cast("bigint")).otherwise(covered)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (bigint each) of a whole text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))
    return let(_words(text), lambda words: F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeated(words).alias("n_repeat_words")))


def grams(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of a text's tokens and of its pairs of neighbouring tokens, repeats included."""
    def hashed(tokens: Column) -> Column:
        one = F.transform(tokens, lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(buckets)).cast("int"))
        two = F.transform(tokens, lambda t, i: F.pmod(F.crc32(F.concat(t, F.lit(" "), F.get(tokens, i + 1)).cast("binary")), F.lit(buckets)).cast("int"))
        return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))))

    return let(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN), 0), hashed)


def log_ratios(docs: DataFrame, buckets: int = BUCKETS) -> list[int] | None:
    """Of each bucket the log of its chance in the trusted documents over that in all, in thousandths; None where no
    trusted document holds a token.

    ``docs`` (text, trusted boolean). Every n-gram of every document counts; one is added to each bucket on both sides.
    Counts are added up in the tasks first, and ``buckets`` sums come to the driver, whatever the size of the corpus.
    """
    # most n-grams of a text fall on few buckets: a map of the bucket counts would need a shuffle, the rows do not
    rows = docs.select(F.col("trusted"), F.explode(grams(F.col("text"), buckets)).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("trusted").alias("t")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for row in counts:
        raw[row.bucket], target[row.bucket] = row.n, row.t
    if not sum(target):
        return None
    all_raw, all_target = sum(raw) + buckets, sum(target) + buckets
    return [math.floor(SCALE * (math.log((t + 1) / all_target) - math.log((n + 1) / all_raw)) + 0.5) for t, n in zip(target, raw)]


def score(text: Column, ratios: list[int]) -> Column:
    """The summed log ratios of a text's n-grams over their number; null for a text without tokens."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")  # folded into one constant of a fixed number of entries
    return let(grams(text, len(ratios)), lambda g: F.aggregate(
        g, F.lit(0).cast("bigint"), lambda a, b: a + F.get(table, b)) / F.nullif(F.size(g), F.lit(0)) / F.lit(float(SCALE)))


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a column trusted: whether a label calls the document good."""
    good = saved(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct(), "trusted").withColumn("_good", F.lit(True))
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    return docs.join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("_good", F.lit(False)).alias("trusted"))


def judge_quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ratio) of every row.

    The target multinomial is that of the documents whose label has quality 1, the raw one that of all documents. A row
    is kept if the base rules pass (at least 50 words, at most half of them in repeated windows of three) and its log
    ratio a n-gram is at least ``threshold``. Null texts have no words and fail the base; a text without tokens has no
    log ratio. With no trusted document every row that passes the base is kept and log_ratio is null. Rows count one by
    one: repeated ids and texts are judged alike, null ids are never trusted; other columns take no part; an empty table
    gives an empty result.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ratios = log_ratios(_trusted(rows, labels), buckets)
    rate = score(F.col("text"), ratios) if ratios else F.lit(None).cast("double")
    out = rows.select("doc_id", measures(F.col("text")).alias("m"), rate.alias("log_ratio"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    liked = F.coalesce(F.col("log_ratio") >= threshold, F.lit(ratios is None))
    out = out.select("doc_id", "m.*", "log_ratio").withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & liked).alias("kept"), "log_ratio")


def quality_sql() -> str:
    """DuckDB SQL for the rows of ``judge_quality`` over documents and labels."""
    crc = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        crc.append(n)
    table = "[" + ",".join(map(str, crc)) + "]::BIGINT[]"
    token = TOKEN.replace("\\x20\\x09-\\x0D", " \\t\\n\\x0B\\f\\r")
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT *, regexp_extract_all(text, '{word}') AS ws, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '{word}')) AS ls FROM d),
v AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM b)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM v) WHERE n > 1),
q AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM p) GROUP BY r),
m AS (
  SELECT b.r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(q.n, 0)::BIGINT AS n_repeat_words
  FROM b LEFT JOIN q USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
t AS (SELECT r, doc_id, regexp_extract_all(text, '{token}') AS ts FROM d),
g AS (
  SELECT r, doc_id, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS gram FROM t),
u AS (SELECT gram, encode(gram) AS e FROM (SELECT DISTINCT gram FROM g)),
h AS (
  SELECT gram, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(e) + 1), lambda i: ('0x' || substr(hex(e), 2 * i - 1, 2))::BIGINT)),
         lambda x, y: xor(x >> 8, ({table})[(xor(x, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM u),
k AS (SELECT r, bucket, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM g JOIN h USING (gram)),
n AS (SELECT bucket, count(*) AS n, count(*) FILTER (good) AS t FROM k GROUP BY bucket),
s AS (SELECT sum(n) + {BUCKETS} AS sn, sum(t) + {BUCKETS} AS st FROM n),
w AS (SELECT bucket, floor({SCALE} * (ln((t + 1)::DOUBLE / st) - ln((n + 1)::DOUBLE / sn)) + 0.5)::BIGINT AS w FROM n, s),
z AS (SELECT r, sum(w)::DOUBLE / count(*) / {SCALE} AS log_ratio FROM k JOIN w USING (bucket) GROUP BY r)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(log_ratio >= {THRESHOLD}, false) AS kept, log_ratio
FROM f LEFT JOIN z USING (r)
"""
