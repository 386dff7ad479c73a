"""License scan by ordered signature rules, in DataFrame operations only."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text, after A-Z are lower-cased: runs of letters, digits and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the base labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# License families as (label, keyword, names, versions). Names are regular expressions over words set
# apart by single blanks; a version "2 1" stands for 2.1.
FAMILIES = (
    ("gpl", "gnu general public licen", (r"(?:the )?gnu general public licen[cs]e",), ("1", "2", "3")),
    ("gpl", "gnu gpl", (r"gnu gpl",), ("1", "2", "3")),
    ("gpl", "gpl", (r"gpl",), ("1", "2", "3")),
    ("lgpl", "lesser general public", (r"(?:the )?gnu lesser general public licen[cs]e",), ("2 1", "3")),
    ("lgpl", "library general public", (r"(?:the )?gnu library general public licen[cs]e",), ("2",)),
    ("lgpl", "lgpl", (r"(?:gnu )?lgpl",), ("2", "2 1", "3")),
    ("agpl", "affero", (r"(?:the )?(?:gnu )?affero general public licen[cs]e",), ("1", "3")),
    ("agpl", "agpl", (r"(?:gnu )?agpl",), ("1", "3")),
    ("fdl", "free documentation", (r"(?:the )?gnu free documentation licen[cs]e",), ("1 1", "1 2", "1 3")),
    ("fdl", "gfdl", (r"gfdl",), ("1 1", "1 2", "1 3")),
    ("apache", "apache", (r"(?:the )?apache(?: software)? licen[cs]e", r"apache"), ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mozilla public", (r"(?:the )?mozilla public licen[cs]e",), ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", (r"mpl",), ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", (r"(?:the )?eclipse public licen[cs]e",), ("1 0", "2 0")),
    ("cddl", "common development", (r"(?:the )?common development and distribution licen[cs]e",), ("1 0", "1 1")),
    ("cddl", "cddl", (r"cddl",), ("1 0", "1 1")),
    ("eupl", "european union", (r"(?:the )?european union public licen[cs]e",), ("1 1", "1 2")),
    ("eupl", "eupl", (r"eupl",), ("1 1", "1 2")),
    ("artistic", "artistic", (r"(?:the )?artistic licen[cs]e",), ("1 0", "2 0")),
    ("osl", "open software", (r"(?:the )?open software licen[cs]e",), ("2 0", "2 1", "3 0")),
    ("afl", "academic free", (r"(?:the )?academic free licen[cs]e",), ("2 1", "3 0")),
    ("boost", "boost", (r"(?:the )?boost software licen[cs]e",), ("1 0",)),
    ("ms-pl", "microsoft public", (r"(?:the )?microsoft public licen[cs]e",), ()),
    ("ms-rl", "microsoft reciprocal", (r"(?:the )?microsoft reciprocal licen[cs]e",), ()),
    ("psf", "python software", (r"(?:the )?python software foundation licen[cs]e",), ("2",)),
    ("psf", "psf licen", (r"psf licen[cs]e",), ("2",)),
    ("ofl", "open font", (r"(?:the )?(?:sil )?open font licen[cs]e",), ("1 0", "1 1")),
    ("odbl", "open database", (r"(?:the )?open(?: data commons open)? database licen[cs]e",), ("1 0",)),
    ("zpl", "zope", (r"(?:the )?zope public licen[cs]e",), ("1 1", "2 0", "2 1")),
    ("php", "php licen", (r"(?:the )?php licen[cs]e",), ("3 0", "3 01")),
    ("cpl", "common public", (r"(?:the )?common public licen[cs]e",), ("1 0",)),
    ("ipl", "ibm public", (r"(?:the )?ibm public licen[cs]e",), ("1 0",)),
    ("qpl", "q public", (r"(?:the )?q public licen[cs]e",), ("1 0",)),
    ("cecill", "cecill", (r"cecill(?: free software licen[cs]e)?",), ("1 1", "2 0", "2 1")),
    ("mulan", "mulan", (r"mulan(?: permissive software licen[cs]e)?",), ("1", "2")),
    ("bsl", "business source", (r"(?:the )?business source licen[cs]e",), ("1 0", "1 1")),
    ("sspl", "server side", (r"(?:the )?server side public licen[cs]e",), ("1",)),
    ("elastic", "elastic", (r"(?:the )?elastic licen[cs]e",), ("1 0", "2 0")),
    ("epl", "epl", (r"epl",), ("1 0", "2 0")),
)

# Creative Commons elements as (label part, words), and their versions.
COMMONS = (
    ("by", (r"by", r"attribution")),
    ("by-sa", (r"by sa", r"attribution share ?alike")),
    ("by-nd", (r"by nd", r"attribution no ?deriv\w*")),
    ("by-nc", (r"by nc", r"attribution non ?commercial")),
    ("by-nc-sa", (r"by nc sa", r"attribution non ?commercial share ?alike")),
    ("by-nc-nd", (r"by nc nd", r"attribution non ?commercial no ?deriv\w*")),
)
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Sentences and names that are a rule of their own, as (label, keyword, pattern).
SINGLE = (
    ("mit", "mit licen", r"(?:the )?mit licen[cs]e"),
    ("mit", "mit", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit(?: licen[cs]e)?"),
    ("mit", "mit", r"licen[cs]ed?(?: under)?(?: the)? mit"),
    ("isc", "isc", r"isc"),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-0", "mit no attribution", r"mit no attribution"),
    ("x11", "x11", r"(?:the )?x11 licen[cs]e"),
    ("isc", "isc", r"(?:the )?isc licen[cs]e"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "bsd", r"(?:the )?(?:new |modified |revised |simplified )?bsd(?: style)? licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", "freebsd", r"(?:the )?freebsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("bsd-0-clause", "bsd", r"(?:the )?(?:bsd 0 clause|zero clause bsd)(?: licen[cs]e)?"),
    ("bsd-0-clause", "0bsd", r"(?:the )?0bsd(?: licen[cs]e)?"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("zlib", "as is without any express", r"this software is provided as is without any express or implied warranty"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[cs]e"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative commons zero", r"creative commons zero"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("beerware", "beerware", r"(?:the )?beerware licen[cs]e"),
    ("jquery", "jquery", r"jquery licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("json", "json licen", r"json licen[cs]e"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "may not be reproduced", r"may not be reproduced(?: or distributed)? without (?:prior |express )?(?:written )?permission"),
)

# SPDX identifiers in words.
SPDX = (
    "mit", "isc", "zlib", "unlicense", "wtfpl", "cc0 1 0", "0bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "apache 1 1", "apache 2 0", "mpl 1 1", "mpl 2 0",
    "gpl 1 0 only", "gpl 1 0 or later", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 0 only", "lgpl 2 0 or later",
    "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "epl 1 0", "epl 2 0", "eupl 1 2",
    "cc by 3 0", "cc by 4 0", "cc by sa 3 0", "cc by sa 4 0", "cc by nc 4 0", "cc by nd 4 0", "cc by nc sa 4 0", "cc by nc nd 4 0", "bsl 1 0", "ofl 1 1", "artistic 2 0",
)

PRIORITIES = 5


def rules() -> Iterator[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) in order: names first, then versions, "or later" forms, identifiers.

    A pattern works on words set apart by single blanks and begins and ends at a word; the keyword is plain text that begins
    at a word of everything the pattern matches, in each of its spellings. The higher priority suppresses what it contains; earlier rules come first among equals.
    """
    for label, keyword, names, versions in FAMILIES:
        for name in names:
            if name != "apache":  # the bare name is no license
                yield label, 1, keyword, name
            for v in versions:
                # short names take their version with a blank or without: gpl 2, gpl v2, gplv2
                gap = " " if "licen" in name else " ?"
                numbered = rf"{name}(?: (?:version|v|ver))?{gap}(?:v)?{v.removesuffix(' 0') if v.endswith(' 0') else v}(?: 0)?"
                short = v.removesuffix(" 0").replace(" ", ".")
                yield f"{label}-{short}", 3, keyword, numbered
                if label in ("gpl", "lgpl", "agpl"):
                    yield f"{label}-{short}-or-later", 4, keyword, rf"{numbered} or (?:at your option )?(?:any )?later(?: version)?"
                    yield f"{label}-{short}-only", 4, keyword, rf"{numbered} only"
    for part, forms in COMMONS:
        for keyword, prefix, form in (("cc by", "cc", forms[0]), ("creative commons", "creative commons", forms[1])):
            stop = r"(?! (?:(?:sa|nd|nc)\b|share|non|no))" if part in ("by", "by-nc") else ""
            yield f"cc-{part}", 2, keyword, rf"{prefix} {form}{stop}"
            for v in COMMONS_VERSIONS:
                yield f"cc-{part}-{v.replace(' ', '.')}", 3, keyword, rf"{prefix} {form}{stop}(?: \w+)?(?: licen[cs]e)? {v}"
    for label, keyword, pattern in SINGLE:
        yield label, 2, keyword, pattern
    for words in SPDX:
        yield words.replace(" ", "-"), 5, "spdx", rf"spdx license identifier {words}"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text: Column) -> Column:
    """The words of lower-cased text, each with one blank before it, and a blank at the end."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), " "), F.lit(" "))


def _word_at(words: Column, blank: Column) -> Column:
    """Number of the word that the blank at this place (from 1) precedes."""
    before = F.substr(words, F.lit(1), blank)
    return F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1


def _detections(words: Column, rule: Column) -> Column:
    """Every match of one rule as struct(start, stop, rank): places in ``words``, sorted fields first."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    pieces, found = F.split(words, pattern), F.regexp_extract_all(words, pattern, F.lit(0))
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,priority:int,rank:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        hit = F.struct(begin.alias("start"), (begin + x["own"]).alias("stop"), rule["priority"].alias("priority"), rule["rank"].alias("rank"))
        return F.struct((begin + x["own"]).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    return F.aggregate(lengths, start, add, lambda acc: acc["out"])


def _kept(hits: Column) -> Column:
    """Ranks of the detections that no other of their or a higher priority contains.

    In order of start, the longest, the most important and the earliest rule first, a detection lies in an earlier one
    exactly if that one's end is not before its own; one running end per priority tells.
    """
    first = F.lit(0)
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("a"), (-h["stop"]).alias("b"), (-h["priority"]).alias("c"), h["rank"].alias("d"))))
    start = F.struct(F.array_repeat(first, PRIORITIES).alias("ends"), F.array().cast("array<int>").alias("ranks"), first.alias("best"))

    def add(acc: Column, h: Column) -> Column:
        stop, priority = -h["b"], -h["c"]
        inside = F.array_max(F.slice(acc["ends"], priority, F.lit(PRIORITIES))) >= stop
        ends = F.transform(acc["ends"], lambda e, i: F.when(i + 1 == priority, F.greatest(e, stop)).otherwise(e))
        taken = F.struct(ends.alias("ends"), F.array_union(acc["ranks"], F.array(h["d"])).alias("ranks"), F.greatest(acc["best"], priority).alias("best"))
        return F.when(inside, acc).otherwise(taken)

    return F.aggregate(ordered, start, add, lambda acc: F.struct(acc["ranks"].alias("ranks"), acc["best"].alias("best")))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    Base labels come from the four fixed phrases, standing as consecutive words; the method's from some 300 signature
    rules. A rule is tried only in a text that holds its keyword; of overlapping detections, those inside another of their
    own or a higher priority are dropped. ``score``: the highest priority kept over the number of priorities, at least
    0.6 with a base phrase. A null text is empty (no words, null places, empty labels, 0); doc_id may be null; repeated
    rows are scanned alike; other columns take no part. Everything happens in the document's row: no shuffle, no join.
    """
    table = [{"rank": i, "label": label, "priority": p, "keyword": k, "pattern": r} for i, (label, p, k, r) in enumerate(rules())]
    known = F.from_json(F.lit(json.dumps(table)), F.lit("array<struct<rank:int,label:string,priority:int,keyword:string,pattern:string>>"))
    keywords = sorted({r["keyword"] for r in table} | {phrase for phrase, _ in BASE})
    low = _lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # every keyword and phrase holds one of these
    hints = _covering(keywords)
    rows = docs.select("doc_id", low.alias("_low"))
    hinted = F.col("_low").contains(hints[0])
    for hint in hints[1:]:
        hinted = hinted | F.col("_low").contains(hint)
    rows = rows.select("doc_id", F.regexp_count("_low", F.lit(WORD)).cast("bigint").alias("n_words"), F.when(hinted, spaced(F.col("_low"))).alias("_words"))
    words = F.col("_words")
    # patterns and phrases begin at a word, and so do keywords
    named = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(words, F.concat(F.lit(" "), k)))
    rows = rows.select("doc_id", "n_words", "_words", F.when(words.isNotNull(), named).alias("_named"))

    gated = F.filter(known, lambda r: F.array_contains(F.col("_named"), r["keyword"]))
    kept = _kept(F.flatten(F.transform(gated, lambda r: _detections(words, r))))
    rows = rows.withColumn("_kept", F.when(F.size("_named") > 0, kept))

    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        held = F.array_contains(F.col("_named"), phrase)
        n = F.when(held, F.regexp_count(words, F.lit(f" {phrase}(?= )"))).otherwise(0)
        after = F.length(F.substring_index(words, f" {phrase} ", -1))
        counts.append(n)
        firsts.append(F.when(n > 0, _word_at(words, F.locate(f" {phrase} ", words))))
        lasts.append(F.when(n > 0, _word_at(words, F.length(words) - after - len(phrase) - 1)))
        labels.append(F.when(n > 0, F.lit(label)))
    n_base = sum(counts[1:], counts[0]).cast("bigint")
    rows = rows.withColumns({
        "n_base": n_base, "first_word": F.least(*firsts).cast("bigint"), "last_word": F.greatest(*lasts).cast("bigint"),
        "_base": F.array_compact(F.array(*labels)),
    })
    own = F.transform(F.coalesce("_kept.ranks", F.array().cast("array<int>")), lambda i: F.get(known, i)["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.greatest(F.coalesce("_kept.best", F.lit(0)) / F.lit(float(PRIORITIES)), F.when(F.col("n_base") > 0, 0.6).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("_base")).alias("base_labels"),
        joined(F.concat("_base", own)).alias("labels"), score.alias("score"))


def _covering(keywords: list[str]) -> list[str]:
    """The longest word of each keyword, where no word taken before lies in it: a text without any of them holds no
    keyword, and long words are rare in other texts."""
    out: list[str] = []
    for keyword in sorted(keywords, key=lambda k: (len(k), k)):
        if not any(hint in keyword for hint in out):
            out.append(max(keyword.split(), key=lambda w: (len(w), w)))
    return out
