"""Line tables, pattern scans and scored line windows over raw text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.questions import scan_term_sets
from lectern.functions.text import strip
from lectern.session import settle

MAX_PATTERNS, HITS_PER_PATTERN, MAX_WINDOWS, CONTEXT_LINES = 6, 80, 10, 30
WINDOW_BYTES, WINDOW_BYTES_FLOOR = 160_000, 4096
OVERVIEW_FLOOR, OVERVIEW_SCORE = 60, 0.1
#: Questions beside one copy of a document.
ASKS_PER_ROW = 256
CUT_LINE = "… (truncated)"
PAIR = ["query_id", "file_id"]


def to_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Numbered lines of each document, from 1."""
    rest = [c for c in docs.columns if c != text]
    cut = docs.select(*rest, F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "line"))
    return cut.select(*rest, (F.col("_pos") + 1).alias("line_no"), "line")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_asks(docs: DataFrame, asks: DataFrame) -> DataFrame:
    """(file_id, lines, low, asks): each document beside what is asked of it, its lines as they are and lower-cased.

    ``asks``: file_id, ask (a struct). The narrow asks are gathered by document, at most about ``ASKS_PER_ROW`` to a row,
    so a document of many questions takes several rows; lines stay arrays in the document's row and meet no shuffle.
    """
    rows = F.ceil(F.count("*") / F.lit(ASKS_PER_ROW)).cast("int")
    sizes = asks.groupBy("file_id").agg(rows.alias("_rows"))
    dealt = asks.join(sizes, "file_id").withColumn("_row", F.pmod(F.xxhash64("ask"), F.col("_rows")))
    grouped = dealt.groupBy("file_id", "_row").agg(F.collect_list("ask").alias("asks")).drop("_row")
    cut = docs.select("file_id", F.split("text", "\n").alias("lines"))
    return cut.join(grouped, "file_id").withColumn("low", F.transform("lines", F.lower))


def matching_lines(lines: Column, low: Column, pattern: Column, cap: int | None = None, regex: bool = False) -> Column:
    """Numbers (from 1) of the first lines that match. Smart case: a pattern without capitals ignores case."""
    bare = pattern == F.lower(pattern)
    if regex:
        wanted = F.concat(F.when(bare, "(?iu)").otherwise(""), pattern)
        hits = F.transform(lines, lambda s, i: F.when(F.rlike(s, wanted), i + 1))
    else:
        hits = let(F.when(bare, low).otherwise(lines), lambda hay: F.transform(hay, lambda s, i: F.when(F.contains(s, pattern), i + 1)))
    found = F.array_compact(hits)
    return found if cap is None else F.slice(found, 1, cap)


def grep_lines(docs: DataFrame, patterns: DataFrame, max_per_file: int | None = None, regex: bool = False) -> DataFrame:
    """First matching lines of each (query, pattern, file): query_id, file_id, pattern_no, pattern, line_no, line.

    ``docs``: file_id, text. ``patterns``: query_id, file_id (the roots to search), pattern_no, pattern.
    """
    if max_per_file is not None and max_per_file < 1:
        raise ValueError("max_per_file must be at least 1")
    asked = patterns.withColumn("pattern", strip(F.col("pattern"))).filter(F.col("pattern") != "")
    rows = with_asks(docs, asked.select("file_id", F.struct("query_id", "pattern_no", "pattern").alias("ask")))
    hits = F.transform("asks", lambda a: F.struct(a.alias("ask"), matching_lines(F.col("lines"), F.col("low"), a["pattern"], max_per_file, regex).alias("at")))
    found = rows.select("file_id", "lines", F.explode(hits).alias("h")).select("file_id", "lines", "h.ask", F.explode("h.at").alias("line_no"))
    return found.select("ask.query_id", "file_id", "ask.pattern_no", "ask.pattern", "line_no", F.get("lines", F.col("line_no") - 1).alias("line"))


def scan_patterns(q: DataFrame, limit: int = MAX_PATTERNS) -> DataFrame:
    """(query_id, file_id, pattern_no, pattern): search terms of the query, else its whole text; a text's terms are found once,
    however many files it is asked of."""
    known = settle(q.select("query_id", "text").distinct().withColumn("_found", _patterns(F.col("text"), limit)).withColumnsRenamed(
        {"query_id": "_query", "text": "_text"}), "patterns")
    pairs = q.join(known, F.col("query_id").eqNullSafe(F.col("_query")) & (F.col("text") == F.col("_text")))
    return pairs.select(*PAIR, F.posexplode("_found").alias("pattern_no", "pattern"))


def _patterns(text: Column, limit: int) -> Column:
    whole = strip(text)
    terms = scan_term_sets(text, limit)["terms"]
    return F.when(F.size(terms) > 0, terms).when(whole != "", F.array(whole))


def _asks(q: DataFrame, max_windows: int | str, patterns: int) -> DataFrame:
    """(file_id, ask) with the ask's query, patterns, term sets and number of windows; a question's terms are found once."""
    texts = q.select("query_id", "text").dropDuplicates(["query_id"])
    known = texts.select("query_id", scan_term_sets(F.col("text"), MAX_PATTERNS).alias("sets"), _patterns(F.col("text"), patterns).alias("patterns"))
    most = F.col(max_windows) if isinstance(max_windows, str) else F.lit(max_windows)
    pairs = q.select(*PAIR, most.cast("int").alias("most")).join(known, "query_id")
    found = F.filter(F.transform(F.coalesce("patterns", F.array().cast("array<string>")), strip), lambda p: p != "")
    return pairs.select("file_id", F.struct("query_id", found.alias("patterns"), "sets", "most").alias("ask"))


def _ranges(lines: Column, low: Column, ask: Column, context: int, per_pattern: int | None) -> Column:
    """Merged line ranges around the first hits: array of struct(line_start, line_end), inside the file.

    Hits come pattern by pattern, so the first of equal line numbers is that of the earliest pattern.
    """
    hits = F.flatten(F.transform(ask["patterns"], lambda p: matching_lines(lines, low, p, per_pattern)))
    kept = F.sort_array(F.slice(F.array_distinct(hits), F.lit(1), ask["most"] * 2))
    around = F.transform(kept, lambda n: F.struct(F.greatest(n - context, F.lit(1)).alias("line_start"), F.least(n + context, F.size(lines)).alias("line_end")))

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["line_start"].alias("line_start"), F.greatest(last["line_end"], x["line_end"]).alias("line_end"))
        joined = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), grown)
        return F.when(F.size(acc) == 0, F.array(x)).when(x["line_start"] <= F.try_element_at(acc, F.lit(-1))["line_end"] + 1, joined).otherwise(F.array_append(acc, x))

    return F.aggregate(around, F.array().cast("array<struct<line_start:int,line_end:int>>"), merge)


def window_text(lines: Column, start: Column, end: Column, limit: int = WINDOW_BYTES) -> Column:
    """Text of a line window whose lines, with their line ends, stay within the byte limit; else a cut mark ends it."""
    limit = max(WINDOW_BYTES_FLOOR, limit)
    first = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("kept"))

    def cut(body: Column) -> Column:
        def add(a: Column, s: Column) -> Column:
            used = a["used"] + F.octet_length(s) + 1
            return F.struct(used.alias("used"), F.when(used <= limit, F.array_append(a["kept"], s)).otherwise(a["kept"]).alias("kept"))

        return F.array_join(F.array_append(F.aggregate(body, first, add, lambda a: a["kept"]), F.lit(CUT_LINE)), "\n")

    body = F.slice(lines, start, F.greatest(end - start + 1, F.lit(0)))
    return let(body, lambda b: let(F.array_join(b, "\n"), lambda t: strip(F.when(F.octet_length(t) + 1 <= limit, t).otherwise(cut(b)))))


def cap_window_bytes(docs: DataFrame, limit: int = WINDOW_BYTES) -> DataFrame:
    """(file_id, text): whole documents as one window each, cut at the byte limit in their own rows."""
    lines = docs.select("file_id", F.split("text", "\n").alias("lines"))
    return lines.select("file_id", window_text(F.col("lines"), F.lit(1), F.size("lines"), limit).alias("text"))


def score_window(text: Column, sets: Column) -> Column:
    """Struct of score and hit counts: 5 per phrase, 3 per id, 1 per keyword, plus density per line."""
    low = F.lower(text)

    def held(terms: Column) -> Column:
        return let(low, lambda hay: F.size(F.filter(terms, lambda t: F.contains(hay, F.lower(t)))))

    def scored(hits: Column) -> Column:
        p, i, k = hits["phrase_hits"], hits["id_hits"], hits["keyword_hits"]
        lines = F.greatest(F.lit(1), F.size(F.split(text, "\n")))
        score = F.when(text == "", F.lit(0.0)).otherwise(p * 5.0 + i * 3.0 + k * 1.0 + (p * 3 + i * 2 + k) / lines)
        return F.struct(F.round(score, 6).alias("score"), p.alias("phrase_hits"), i.alias("id_hits"), k.alias("keyword_hits"))

    counts = F.struct(*(held(sets[n]).alias(m) for n, m in (("phrases", "phrase_hits"), ("ids", "id_hits"), ("keywords", "keyword_hits"))))
    return let(counts, scored)


def _scored(lines: Column, ranges: Column, sets: Column, limit: int) -> Column:
    """The ranges with their texts and scores, blank ones left out."""
    def one(r: Column) -> Column:
        def read(text: Column) -> Column:
            return let(score_window(text, sets), lambda s: F.struct(
                r["line_start"].alias("line_start"), r["line_end"].alias("line_end"), text.alias("text"), s["score"].alias("score"),
                s["phrase_hits"].alias("phrase_hits"), s["id_hits"].alias("id_hits"), s["keyword_hits"].alias("keyword_hits")))

        return let(window_text(lines, r["line_start"], r["line_end"], limit), read)

    return F.filter(F.transform(ranges, one), lambda w: w["text"] != "")


def _chosen(lines: Column, scored: Column, most: Column, context: int, limit: int) -> Column:
    """Top windows by score, then at most one neighbour before and one after in all, still within the cap."""
    span = max(2, context) * 2
    order = F.sort_array(F.transform(scored, lambda w: F.struct((-w["score"]).alias("k"), w["line_start"].alias("line_start"), w["line_end"].alias("line_end"), w["text"].alias("text"))))
    best = F.transform(F.slice(order, F.lit(1), F.greatest(most, F.lit(1))), lambda w, i: F.struct(
        w["line_start"].alias("line_start"), w["line_end"].alias("line_end"), w["text"].alias("text"), (F.lit(0.0) - w["k"]).alias("score"),
        (i + 1).alias("place"), F.lit(False).alias("neighbor")))

    def beside(b: Column) -> Column:
        def side(at: int, start: Column, end: Column) -> Column:
            text = F.when((start >= 1) & (end >= 1) & (start <= F.size(lines)), window_text(lines, F.greatest(start, F.lit(1)), end, limit))
            return F.struct(F.lit(at).alias("side"), start.alias("line_start"), end.alias("line_end"), text.alias("text"))

        both = F.flatten(F.transform(b, lambda w: F.array(
            side(0, F.greatest(w["line_start"] - span, F.lit(1)), w["line_start"] - 1), side(1, w["line_end"] + 1, F.least(w["line_end"] + span, F.size(lines))))))
        read = F.filter(both, lambda s: s["text"] != "")
        # a range that two windows share belongs to the better one
        same = lambda x, y: (x["line_start"] == y["line_start"]) & (x["line_end"] == y["line_end"])
        once = let(read, lambda r: F.filter(r, lambda x, i: ~F.exists(F.slice(r, F.lit(1), i), lambda y: same(x, y))))
        nearest = let(once, lambda o: F.filter(o, lambda x, i: ~F.exists(F.slice(o, F.lit(1), i), lambda y: y["side"] == x["side"])))
        n = F.size(b)
        return F.transform(F.slice(nearest, F.lit(1), F.greatest(most - n, F.lit(0))), lambda s, i: F.struct(
            s["line_start"].alias("line_start"), s["line_end"].alias("line_end"), s["text"].alias("text"), F.lit(0.0).alias("score"),
            (n + i + 1).alias("place"), F.lit(True).alias("neighbor")))

    return let(best, lambda b: F.when((F.size(b) > 0) & (F.size(b) < most), F.concat(b, beside(b))).otherwise(b))


def _overview(lines: Column, context: int, limit: int) -> Column:
    """The file's first lines as its only window, if they hold anything (score 0.1)."""
    end = F.least(F.lit(max(OVERVIEW_FLOOR, context * 4)), F.size(lines))
    window = let(window_text(lines, F.lit(1), end, limit), lambda t: F.array(F.struct(
        F.lit(1).alias("line_start"), end.alias("line_end"), t.alias("text"), F.lit(OVERVIEW_SCORE).alias("score"), F.lit(1).alias("place"), F.lit(False).alias("neighbor"))))
    return F.filter(window, lambda w: w["text"] != "")


def _each(rows: DataFrame, found: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """One row for each window that ``found`` (lines, low, ask) gives for a document and an ask."""
    per_ask = F.transform("asks", lambda a: F.struct(a["query_id"].alias("query_id"), found(F.col("lines"), F.col("low"), a).alias("windows")))
    out = rows.select("file_id", F.explode(per_ask).alias("a")).select("a.query_id", "file_id", F.explode("a.windows").alias("w"))
    return out.select(*PAIR, "w.*")


def raw_windows(
    q: DataFrame, docs: DataFrame, max_windows: int | str = MAX_WINDOWS, context: int = CONTEXT_LINES, patterns: int = MAX_PATTERNS,
    per_pattern: int | None = HITS_PER_PATTERN,
) -> DataFrame:
    """(query_id, file_id, line_start, line_end): merged line ranges around the first hits of each (query, file), inside
    the file; the first hit of a line counts, 2 * max_windows lines in term order.

    ``q``: query_id, file_id, text (and the column that ``max_windows`` may name). ``docs``: file_id, text.
    """
    return _each(with_asks(docs, _asks(q, max_windows, patterns)), lambda lines, low, a: _ranges(lines, low, a, max(2, context), per_pattern))


def scored_windows(
    q: DataFrame, docs: DataFrame, max_windows: int | str = MAX_WINDOWS, context: int = CONTEXT_LINES, patterns: int = MAX_PATTERNS,
    per_pattern: int | None = HITS_PER_PATTERN, limit: int = WINDOW_BYTES,
) -> DataFrame:
    """The raw windows with text, score and hit counts; blank ones are left out."""
    return _each(with_asks(docs, _asks(q, max_windows, patterns)), lambda lines, low, a: _scored(
        lines, _ranges(lines, low, a, max(2, context), per_pattern), a["sets"], limit))


def scan_windows(
    q: DataFrame, docs: DataFrame, max_windows: int | str = MAX_WINDOWS, context: int = CONTEXT_LINES, patterns: int = MAX_PATTERNS,
    per_pattern: int | None = HITS_PER_PATTERN, limit: int = WINDOW_BYTES, overview: bool = True, chosen: int | None = None,
) -> DataFrame:
    """(query_id, file_id, line_start, line_end, text, score, place, neighbor) of each (query, file): its best
    ``max_windows`` (or ``chosen``) windows, at most one neighbour before and one after within that number, and with
    ``overview`` the file's first lines where nothing matched.

    Matching, merging, reading, scoring and choosing all take place in the document's row.
    """
    def found(lines: Column, low: Column, a: Column) -> Column:
        scored = _scored(lines, _ranges(lines, low, a, max(2, context), per_pattern), a["sets"], limit)
        best = _chosen(lines, scored, a["most"] if chosen is None else F.lit(chosen), context, limit)
        return let(best, lambda c: F.when(F.size(c) > 0, c).otherwise(_overview(lines, context, limit))) if overview else best

    return _each(with_asks(docs, _asks(q, max_windows, patterns)), found)


def raw_overview(q: DataFrame, docs: DataFrame, max_windows: int | str = MAX_WINDOWS, context: int = CONTEXT_LINES, limit: int = WINDOW_BYTES) -> DataFrame:
    """First lines of the file for each (query, file) without a window that holds a hit (score 0.1)."""
    def found(lines: Column, low: Column, a: Column) -> Column:
        hit = F.exists(a["patterns"], lambda p: F.size(matching_lines(lines, low, p, 1)) > 0)
        return F.when(~hit, _overview(lines, context, limit))

    return _each(with_asks(docs, _asks(q, max_windows, MAX_PATTERNS)), found).select(*PAIR, "line_start", "line_end", "text", "score")
