"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 2048
GRAM = 3
SEED = 7
UNKNOWN = "und"
#: n-grams whose vectors are formed at once, and those a worker remembers.
CHUNK = 2048
REMEMBERED = 1 << 18
#: Code points of a batch that are handled at once, so that long texts need no more memory than short ones.
BLOCK = 1 << 21

_GAP = 0x20


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank for anything that is no letter."""
    out = np.full(0x110000, _GAP, dtype=np.uint32)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and (c := chr(cp)).isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


@cache
def letter_vector(cp: int) -> np.ndarray:
    """The random +1/-1 vector of a letter, the same wherever it is made."""
    return np.random.default_rng((SEED, cp)).integers(0, 2, DIMENSION, dtype=np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Vectors of n-grams (rows of code points): the product of their letters' vectors, each rotated by its place."""
    out = np.ones((len(grams), DIMENSION), dtype=np.int8)
    for place in range(GRAM):
        used, at = np.unique(grams[:, place], return_inverse=True)
        base = np.stack([np.roll(letter_vector(int(c)), GRAM - 1 - place) for c in used])
        out *= base[at]
    return out


def _fold(text: str) -> np.ndarray:
    """Lower-case letters with one blank before, between and after words; empty without letters."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    gap = codes == _GAP
    if gap.all():
        return codes[:0]
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]  # the first blank of a run
    codes = codes[keep]
    first, last = int(codes[0] != _GAP), int(codes[-1] != _GAP)
    return np.concatenate([[_GAP] * first, codes, [_GAP] * last]).astype(np.uint32)


def _grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct n-grams, which of them each place holds, the text of each place), a block of texts at a time."""
    waiting, rows, held = [], [], 0
    for i, text in enumerate(texts):
        codes = _fold(text) if text else np.empty(0, dtype=np.uint32)
        for at in range(0, max(len(codes) - GRAM + 1, 0), BLOCK):
            part = codes[at : at + BLOCK + GRAM - 1]
            waiting.append(part)
            rows.append(i)
            held += len(part)
            if held >= BLOCK:
                yield _block(waiting, rows)
                waiting, rows, held = [], [], 0
    if waiting:
        yield _block(waiting, rows)


def _block(parts: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.concatenate(parts)
    small = np.zeros(int(codes.max()) + 1, dtype=bool)
    small[codes] = True
    alphabet = np.flatnonzero(small)
    to_small = np.zeros(len(small), dtype=np.int64)
    to_small[alphabet] = np.arange(len(alphabet))
    codes, n = to_small[codes], len(alphabet)
    lengths = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = np.ones(len(codes), dtype=bool)  # places where an n-gram of one text begins
    for k in range(1, GRAM):
        inside[starts + lengths - k] = False
    key = np.zeros(len(codes), dtype=np.int64)
    for k in range(GRAM):
        key = key * n + np.concatenate([codes[k:], np.zeros(k, dtype=np.int64)])
    key = key[inside]
    if n**GRAM <= 1 << 22:
        seen = np.zeros(n**GRAM, dtype=bool)
        seen[key] = True
        found = np.flatnonzero(seen)
        number = np.zeros(n**GRAM, dtype=np.int32)
        number[found] = np.arange(len(found))
        which = number[key]
    else:
        found, which = np.unique(key, return_inverse=True)
    letters = np.stack([alphabet[found // n ** (GRAM - 1 - k) % n] for k in range(GRAM)], axis=1)
    return letters, which, np.repeat(np.array(rows), lengths - GRAM + 1)


def _profile(batches):
    """Per task and language, the bundle of the n-gram vectors of its texts, each text weighing alike."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, of = np.unique(batch["lang"].to_numpy(dtype=object).astype(str), return_inverse=True)
        texts = batch["text"].tolist()
        sizes = np.array([max(len(t or ""), 1) for t in texts], dtype=np.float64)
        for letters, which, row in _grams(texts):
            mass = np.bincount(of[row] * len(letters) + which, 1 / sizes[row], len(langs) * len(letters)).reshape(len(langs), -1)
            for lang, m in zip(langs, mass):
                if m.any():
                    total = sums.setdefault(lang, np.zeros(DIMENSION))
                    for at in range(0, len(letters), CHUNK):
                        total += m[at : at + CHUNK] @ gram_vectors(letters[at : at + CHUNK]).astype(np.float32)
    if sums:
        yield pd.DataFrame({"lang": list(sums), "bundle": list(sums.values())})


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """A unit vector for each language of (text, lang): what the driver gets is languages times ``DIMENSION`` numbers.

    Bundles are added as whole numbers, so the order in which tasks end does not show."""
    rows = docs.filter("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), "lang")
    parts = rows.mapInPandas(_profile, "lang string, bundle array<double>")
    each = parts.select("lang", F.posexplode("bundle").alias("i", "x")).select("lang", "i", F.round(F.col("x") * 1e6).cast("bigint").alias("x"))
    out: dict[str, np.ndarray] = {}
    for lang, i, x in each.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():
        out.setdefault(lang, np.zeros(DIMENSION))[i] = x
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(out.items()) if v.any()}


class _Scores:
    """For each n-gram the products of its vector with all prototypes; n-grams recur, so they are remembered."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit.astype(np.float32)
        self.keys = np.empty(0, dtype=np.int64)
        self.values = np.empty((0, len(unit)), dtype=np.float32)

    def __call__(self, letters: np.ndarray) -> np.ndarray:
        key = letters[:, 0].astype(np.int64)
        for k in range(1, GRAM):
            key = (key << 21) | letters[:, k]
        at = np.searchsorted(self.keys, key)
        known = (self.keys[np.minimum(at, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(len(key), dtype=bool)
        out = np.empty((len(key), len(self.unit)), dtype=np.float32)
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        for lo in range(0, len(new), CHUNK):
            some = new[lo : lo + CHUNK]
            out[some] = gram_vectors(letters[some]).astype(np.float32) @ self.unit.T
        if len(new):
            keys, values = (key[new], out[new]) if len(self.keys) > REMEMBERED else (np.concatenate([self.keys, key[new]]), np.concatenate([self.values, out[new]]))
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]
        return out


def _predictor(langs: list[str], unit: np.ndarray):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = _Scores(unit) if len(langs) else None
        for texts in batches:
            near = np.zeros((len(texts), max(len(langs), 1)))
            lettered = np.zeros(len(texts), dtype=bool)
            if scores is not None:
                for letters, which, row in _grams(texts.tolist()):
                    products = scores(letters)
                    for k in range(len(langs)):
                        near[:, k] += np.bincount(row, products[which, k], len(texts))
                    lettered[row] = True
            best = near.argmax(axis=1)
            positive = np.clip(near, 0, None)
            top = positive[np.arange(len(texts)), best]
            share = np.where(lettered & (top > 0), top / np.maximum(positive.sum(axis=1), 1e-12), 0.0)
            names = np.array([*langs, UNKNOWN], dtype=object)[np.where(lettered, best, len(langs))]
            yield pd.DataFrame({"lang_pred": names, "score": np.clip(share, 0.0, 1.0)})

    return run


def identify(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with struct column ``_language`` (lang_pred, score).

    A document's vector is the bundle of its n-grams' vectors, and the language whose prototype has the highest cosine
    with it is predicted (the first by name, if several). Products with a prototype add up over n-grams, so the cosines,
    up to the document's own length that is common to them, come from one table of n-gram products, and no document
    vector is stored. ``score``: the best cosine's share of all positive ones. ``und`` and 0 for a null text, one without
    letters, or an empty model.
    """
    langs = list(model)
    unit = np.stack([model[x] for x in langs]) if langs else np.empty((0, DIMENSION))

    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _predictor(langs, unit)(texts)

    udf = F.pandas_udf(predicted, "lang_pred string, score double")
    return docs.withColumn("_language", udf(F.col(text_col).cast("string")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): prototypes from the documents that are not held out, predictions for all.

    Held out: crc32 of the doc_id as text leaves 2 divided by 4 (a null doc_id is not). Rows with a null text or lang
    teach nothing. Repeated rows are predicted alike; other columns take no part; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = prototypes(rows.filter(~held_out(F.col("doc_id"))))
    found = identify(rows.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_language.*")
