"""URL filter: host and path rules, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms of the method. One strict term, or SOFT_LIMIT distinct soft ones, reject a URL.
STRICT = (
    "porn", "porno", "xxx", "hentai", "milf", "camgirls", "escorts", "bdsm", "blowjob", "incest", "creampie", "gangbang",
    "warez", "keygen", "cracked-software", "phishing", "malware", "adult-x",
)
SOFT = (
    "sex", "adult", "nude", "naked", "teen", "cam", "dating", "erotic", "fetish", "amateur", "casino", "poker", "bet", "betting",
    "slots", "jackpot", "bets", "win", "spam", "farm", "ads", "track", "cheap", "loan", "payday", "pills", "viagra", "cialis", "torrent", "crack", "serial", "download", "free", "hot", "girls",
)
SOFT_LIMIT = 2

# The rules of the query (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule (host and path together) that fits a host or one above it and begins
    the path; nulls if none does. Rules are a fixed list, longest first, so this is one expression without a join."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def count_terms(url: str | None, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """(strict hits, distinct soft terms) in a URL; a term counts where no ASCII letter or digit touches it."""
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), url or "")
    strict, soft = 0, set()
    for end, (term, hard) in terms.iter(low):
        start = end - len(term) + 1
        touched = (start and _word(low[start - 1])) or (end + 1 < len(low) and _word(low[end + 1]))
        if not touched:
            if hard:
                strict += 1
            else:
                soft.add(term)
    return strict, len(soft)


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_terms) of every page's URL.

    The verdict is that of the longest fitting rule; without one, the vocabulary's: block from one strict term or
    ``soft_limit`` distinct soft ones on, else allow. A null URL, or one without ://, has empty host and path and is still
    judged by its words. Only page_id and url are read; null ids and repeated rows come back as they are; no shuffle.
    """
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = automaton(strict, soft)
        for urls in batches:
            yield pd.DataFrame([count_terms(u, terms) for u in urls], columns=["strict_hits", "soft_terms"], dtype="int32")

    udf = F.pandas_udf(counted, "strict_hits int, soft_terms int")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("terms", udf("url"))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    rejects = (F.col("terms.strict_hits") > 0) | (F.col("terms.soft_terms") >= soft_limit)
    verdict = F.coalesce("_rule.verdict", F.when(rejects, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "terms.strict_hits", "terms.soft_terms")
