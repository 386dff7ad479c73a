"""Toxicity as severity grades: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import Memory, unnamed

#: Labelled documents of each grade that the model is fitted on, at most.
PER_GRADE = 3000
BUCKETS = 1 << 18
SCALE = 50.0
#: Words added to every text's length: a text of a few words is weak evidence.
DAMPING = 20
#: Documents at least so likely to be of grade 1 or more are rejected.
REJECT_FROM = 0.3
STEPS = 250
RIDGE = 1e-5
FLOOR = 1.0
#: Prefix lengths: inflected forms of a word share them.
PREFIXES = (3, 4, 5)

_WORD = re.compile(r"\w+")


def word_features(chunk: str) -> tuple[list[int], int]:
    """(buckets, words) of a run of text without white space: each word itself and its prefixes."""
    words = _WORD.findall(chunk.lower())
    out = []
    for w in words:
        out.append(zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS)
        out.extend(zlib.crc32(b"%d:" % n + w[:n].encode("utf-8", "replace")) % BUCKETS for n in PREFIXES if len(w) > n)
    return out, len(words)


def _features(batches):
    """(grade, buckets, shares of the text's words as bytes): a text's length does not matter."""
    for batch in batches:
        rows = []
        for grade, text in zip(batch["grade"], batch["text"]):
            counts, words = Counter(), 0
            for chunk, times in Counter((text or "").split()).items():
                buckets, n = word_features(chunk)
                words += n * times
                for b in buckets:
                    counts[b] += times
            keys = np.fromiter(counts, dtype="int32", count=len(counts))
            values = np.fromiter(counts.values(), dtype="float32", count=len(counts)) * (SCALE / (words + DAMPING))
            rows.append((grade, keys.tobytes(), values.tobytes()))
        yield pd.DataFrame(rows, columns=["grade", "buckets", "shares"])


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(weights . features - thresholds[k]): one set of weights, ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 700)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_ordinal(buckets: list[np.ndarray], shares: list[np.ndarray], grades: np.ndarray, totals: dict[int, int], steps: int = STEPS) -> OrdinalModel:
    """Maximum likelihood with a ridge, by accelerated gradient steps from zero: the same rows give the same model.

    ``totals``: how many rows of each grade there are altogether; a grade's rows weigh in proportion, so that the
    thresholds fit the labels' own shares. Features are scaled by their spread, with a floor that keeps rare ones quiet.
    """
    top = max(totals, default=1)
    sizes = np.array([len(b) for b in buckets])
    if not len(grades) or len(set(grades.tolist())) < 2:
        return OrdinalModel(np.zeros(BUCKETS, dtype="float32"), np.full(max(top, 1), 30.0))
    column, value = np.concatenate(buckets), np.concatenate(shares).astype("float64")
    row = np.repeat(np.arange(len(sizes)), sizes)
    used, column = np.unique(column, return_inverse=True)
    taken = Counter(grades.tolist())
    importance = np.array([totals[g] / taken[g] for g in grades.tolist()])
    importance /= importance.sum()
    scale = 1 / (np.sqrt(np.bincount(column, value * value * importance[row])) + FLOOR)
    value *= scale[column]
    direction = np.ones(len(used))
    for _ in range(20):  # the largest curvature, by power iteration
        along = np.bincount(row, value * direction[column], len(sizes)) * importance
        direction = np.bincount(column, value * along[row], len(used))
        curvature = np.linalg.norm(direction)
        direction /= max(curvature, 1e-12)
    shares_above = np.array([sum(n for g, n in totals.items() if g > k) for k in range(top)]) / sum(totals.values())
    theta = -np.log(np.clip(shares_above, 1e-6, 1) / np.clip(1 - shares_above, 1e-6, 1))
    # thresholds as the first and the logarithms of the gaps: they stay in order
    def ordered(p):
        return p[0] + np.concatenate([[0.0], np.cumsum(np.exp(p[1:]))])

    point = np.concatenate([np.zeros(len(used)), [theta[0]], np.log(np.clip(np.diff(theta), 1e-2, None))])
    previous, rate = point.copy(), 1.0 / (0.3 * curvature + RIDGE)
    inf = np.array([np.inf])
    for step in range(1, steps + 1):
        look = point + (step - 1) / (step + 2) * (point - previous)
        w, th = look[: len(used)], ordered(look[len(used) :])
        edges = np.concatenate([-inf, th, inf])
        s = np.bincount(row, value * w[column], len(sizes))
        hi, lo = _sigmoid(edges[grades + 1] - s), _sigmoid(edges[grades] - s)
        p = np.clip(hi - lo, 1e-12, None)
        gs = -(hi + lo - 1) * importance
        grad_w = np.bincount(column, value * gs[row], len(used)) + RIDGE * w
        grad_t = np.zeros(top + 2)
        np.add.at(grad_t, grades + 1, -hi * (1 - hi) / p * importance)
        np.add.at(grad_t, grades, lo * (1 - lo) / p * importance)
        grad_t = grad_t[1:-1]
        gaps = np.exp(look[len(used) + 1 :])
        grad_p = np.concatenate([[grad_t.sum()], [grad_t[k + 1 :].sum() * gaps[k] for k in range(top - 1)]])
        previous, point = point, np.concatenate([w - rate * grad_w, look[len(used) :] - 0.5 * grad_p])
    weights = np.zeros(BUCKETS, dtype="float32")
    weights[used] = point[: len(used)] * scale * SCALE
    return OrdinalModel(weights, ordered(point[len(used) :]))


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels that know toxic (1) and not (0) only; the higher of a document's labels."""
    grade = F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 0)
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(grade).alias("grade")).filter("grade is not null")


def fit(docs: DataFrame, grades: DataFrame, per_grade: int = PER_GRADE) -> OrdinalModel:
    """Fit on at most ``per_grade`` documents of each grade, chosen by a hash of their ids, so the driver holds a bounded
    number of sparse rows whatever the input. ``grades``: doc_id, grade (0, 1, ...). Without two grades nothing is severe.

    Where there are grades 0 and 1 only, severity comes in by a second fit: the documents of grade 1 whose evidence in the
    first fit is above their median become grade 2."""
    totals = {int(g): int(n) for g, n in grades.groupBy("grade").count().collect()}
    chosen = None
    for g in sorted(totals):
        part = grades.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return OrdinalModel(np.zeros(BUCKETS, dtype="float32"), np.full(1, 30.0))
    # bounded by per_grade rows a grade
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("grade", "text")
    rows = sorted(map(tuple, texts.mapInPandas(_features, "grade int, buckets binary, shares binary").collect()))
    buckets = [np.frombuffer(b, dtype="int32") for _, b, _ in rows]
    shares = [np.frombuffer(s, dtype="float32") for _, _, s in rows]
    found = np.array([g for g, _, _ in rows])
    model = fit_ordinal(buckets, shares, found, totals, STEPS // 2)
    if set(found.tolist()) != {0, 1}:
        return model
    evidence = np.array([float(s @ model.weights[b]) for b, s in zip(buckets, shares)])
    severe = (found == 1) & (evidence > np.median(evidence[found == 1]))
    part = severe.sum() / (found == 1).sum()
    if not part:
        return model
    split = {0: totals[0], 1: totals[1] * (1 - part), 2: totals[1] * part}
    return fit_ordinal(buckets, shares, found + severe, split)


def _scorer(model: OrdinalModel):
    def run(batches):
        weights = model.weights

        def weigh(chunk: str) -> tuple[float, int]:
            buckets, n = word_features(chunk)
            return float(weights[buckets].sum()) if buckets else 0.0, n

        known = Memory(weigh)
        for texts in batches:
            scores = np.full(len(texts), -np.inf)  # a text without words
            for i, text in enumerate(texts):
                found = [known[c] for c in (text or "").split()]
                if words := sum(n for _, n in found):
                    scores[i] = sum(s for s, _ in found) / (words + DAMPING)
            above = model.above(scores)
            grade = (above >= 0.5).sum(axis=1)
            yield pd.DataFrame({"severity": above.sum(axis=1), "grade": grade.astype("int32"), "toxic_p": above[:, 0]})

    return run


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column ``_toxicity``: struct(severity, grade, toxic_p), with severity the expected grade,
    grade the highest one at least as likely as not to be reached, and toxic_p the chance of grade 1 or more. No shuffle."""
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _scorer(model)(batches)

    udf = F.pandas_udf(scored, "severity double, grade int, toxic_p double")
    return docs.withColumn("_toxicity", udf(F.col(text_col).cast("string")))


def rate_documents(docs: DataFrame, labels: DataFrame, reject_from: float = REJECT_FROM, per_grade: int = PER_GRADE) -> DataFrame:
    """(doc_id, severity, grade, toxic_p, rejected) of every document; rejected: toxic_p of at least ``reject_from``.

    The weights are learned from the labelled documents and apply to all, whole texts. A null or wordless text has
    severity 0. Null labels, labels of unknown documents and other columns take no part; a null doc_id stays
    null; repeated rows are rated alike; an empty table gives an empty result, and without labels of at least two grades
    nothing is rejected.
    """
    rated = score(docs.select("doc_id", "text"), fit(docs, grades_of(labels), per_grade))
    found = rated.select("doc_id", "_toxicity.*")
    return found.withColumn("rejected", F.col("toxic_p") >= reject_from)


def keep_civil(docs: DataFrame, labels: DataFrame, reject_from: float = REJECT_FROM, per_grade: int = PER_GRADE) -> DataFrame:
    """The documents that ``rate_documents`` does not reject, with the columns of ``docs``, whatever their names."""
    plain, names, back = unnamed(docs)
    rated = score(plain, fit(docs, grades_of(labels), per_grade), names["text"])
    return rated.filter(F.col("_toxicity.toxic_p") < reject_from).select(*back)
