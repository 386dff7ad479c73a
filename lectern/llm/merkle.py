"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of text."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import saved

#: A section ends after a paragraph whose digest this divides, so an edit moves no other section's ends.
SECTION = 8
#: Digits of a digest below the root that a fingerprint string shows, at least; of 16 that are compared in memory.
SHORT = 6
#: Letters after which, at a word's end, a leaf may end where no sentence does: every sixteenth code point, so that the
#: text decides and not the distance, and an insertion moves the ends around it only.
_ENDS = "".join(map(chr, range(100, 0x250, 16)))
#: Leaves of a paragraph: runs that end with a sentence, else with such a word, else after 128 characters.
_LEAF = re.compile(rf"[^\n]{{16,128}}?(?:[.!?]+(?=[ \t])|[。！？｡।؟])|[^\n]{{16,128}}?[{_ENDS}](?=[ \t])|[^\n]{{1,128}}\n?|\n")


def _digest(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))


@dataclass
class Tree:
    """root, and sections of (digest, paragraphs), paragraphs of (digest, leaves), leaves of (digest, characters)."""

    root: str
    sections: list[tuple[str, list[tuple[str, list[tuple[str, int]]]]]]
    #: Digits that the digests below the root have.
    digits: int = 16

    def __str__(self) -> str:
        """The root, the number of digits (in hexadecimal) and the nodes; digests keep so many digits that even two trees
        of this many nodes share one by chance once in about a thousand times."""
        nodes = sum(2 + len(leaves) for _, paragraphs in self.sections for _, leaves in paragraphs)
        n = min(self.digits, max(SHORT, -(-(2 * nodes.bit_length() + 10) // 4)))
        out = [f"{self.root}{n:x}" if n < 16 else f"{self.root}g"]
        for section, paragraphs in self.sections:
            out.append(f"/{section[:n]}")
            for paragraph, leaves in paragraphs:
                out.append(f":{paragraph[:n]}")
                out.extend(f",{leaf[:n]}.{size:x}" for leaf, size in leaves)
        return "".join(out)


def build(text: str) -> Tree:
    """The tree of a whole text: every character lies in exactly one leaf, each node's digest is that of its children."""
    sections, current = [], []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        leaves = [(_digest(run), len(run)) for run in _LEAF.findall(line)]
        paragraph = _digest("".join(d for d, _ in leaves))
        current.append((paragraph, leaves))
        if int(paragraph, 16) % SECTION == 0:
            sections.append((_digest("".join(d for d, _ in current)), current))
            current = []
    if current:
        sections.append((_digest("".join(d for d, _ in current)), current))
    root = hashlib.sha256("".join(d for d, _ in sections).encode()).hexdigest()[:32]
    return Tree(root, sections)


def parse(fingerprint: str) -> Tree:
    """The tree of a fingerprint string, its digests below the root as short as they are there."""
    head, *sections = fingerprint.split("/")
    root, digits = head[:-1], int(head[-1], 17)
    out = []
    for section in sections:
        digest, *paragraphs = section.split(":")
        rows = []
        for paragraph in paragraphs:
            name, *leaves = paragraph.split(",")
            rows.append((name, [(leaf[:digits], int(leaf[digits + 1 :], 16)) for leaf in leaves]))
        out.append((digest, rows))
    return Tree(root, out, digits)


def _weight(node: tuple) -> int:
    below = node[1]
    return below if isinstance(below, int) else sum(map(_weight, below))


def _differing(a: list[tuple], b: list[tuple], digits: int) -> tuple[list[tuple], list[tuple], int]:
    """Nodes of each side without a partner of the same digest and size on the other, and the characters under the partners."""
    names = [[(node[0][:digits], _weight(node)) for node in side] for side in (a, b)]
    both = Counter(names[0]) & Counter(names[1])
    shared, left = 0, both.copy()
    rest_a, rest_b = [], []
    for node, name in zip(a, names[0]):
        if left[name]:
            left[name] -= 1
            shared += name[1]
        else:
            rest_a.append(node)
    for node, name in zip(b, names[1]):
        if both[name]:
            both[name] -= 1
        else:
            rest_b.append(node)
    return rest_a, rest_b, shared


def likeness(a: Tree, b: Tree) -> float:
    """Share of characters under equal nodes, 1 for equal roots. Branches are opened only where their digests differ;
    digests are compared in all the digits that both trees have."""
    digits = min(a.digits, b.digits)
    if a.root == b.root:
        return 1.0
    total = sum(map(_weight, a.sections)) + sum(map(_weight, b.sections))
    rest_a, rest_b, same = _differing(a.sections, b.sections, digits)
    for _ in range(2):  # paragraphs of differing sections, leaves of differing paragraphs
        rest_a, rest_b, more = _differing([n for _, below in rest_a for n in below], [n for _, below in rest_b for n in below], digits)
        same += more
    return min(1.0, 2 * same / total) if total else 0.0


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(start, end) character ranges of ``a``'s leaves that have no equal in ``b``: where an edit took place."""
    out, at = [], 0
    if a.root == b.root:
        return out
    digits = min(a.digits, b.digits)
    theirs = Counter((leaf[:digits], size) for _, paragraphs in b.sections for _, leaves in paragraphs for leaf, size in leaves)
    for _, paragraphs in a.sections:
        for _, leaves in paragraphs:
            for digest, size in leaves:
                if theirs[digest[:digits], size]:
                    theirs[digest[:digits], size] -= 1
                else:
                    if out and out[-1][1] == at:
                        out[-1] = (out[-1][0], at + size)
                    else:
                        out.append((at, at + size))
                at += size
    return out


def _compare(text: str, own: Tree, other: str, next_tree: Tree) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + other[:half]
    tree = build(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, str(own), str(tree), likeness(own, tree), likeness(own, next_tree)


_COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Kinds of rows of a partition: a finished one; its last document, whose next lies in another; its first.
_DONE, _OPEN, _HEAD = 0, 1, 2
FRAME_ROWS = 500


def _along(batches):
    part, rows, held = TaskContext.get().partitionId(), [], None
    names = ["kind", "part", "doc_id", *_COLUMNS, "text"]
    for batch in batches:
        ids = batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None)
        for doc_id, text in zip(ids, batch["text"]):
            text = text or ""
            tree = build(text)
            if held is None:
                rows.append((_HEAD, part, doc_id, *[None] * 6, text))
            else:
                rows.append((_DONE, part, held[0], *_compare(held[1], held[2], text, tree), None))
            held = doc_id, text, tree
            if len(rows) >= FRAME_ROWS:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    if held is not None:
        rows.append((_OPEN, part, held[0], *[None] * 6, held[1]))
        yield pd.DataFrame(rows, columns=names)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [_compare(a, build(a), b, build(b)) for a, b in zip(batch["text"], batch["next_text"])]
        frame = pd.DataFrame(out, columns=_COLUMNS)
        frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield frame


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is that of the next smaller doc_id, after the last the first; its beginning takes the place of the
    last half of the edited text. Texts are dealt once, into ranges of ids, and walked in order; a range's last document
    meets the first of the next range by a join of one row a range. Null texts are empty. Null ids come last; equal ids
    follow each other by a hash of their texts, so repeated rows are each other's next. Other columns take no part; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    walked = saved(dealt.mapInPandas(_along, f"kind int, part int, doc_id {kind}, {_TYPES}, text string"), "walked", compression="zstd")

    heads = walked.filter(F.col("kind") == _HEAD).select("part", F.col("text").alias("next_text"))
    by_part = W.orderBy("part")  # a number for each range
    ring = heads.select("part").withColumn("_next", F.lead("part").over(by_part)).withColumn("_first", F.min("part").over(by_part))
    ring = ring.select("part", F.coalesce("_next", "_first").alias("_to"))
    ends = walked.filter(F.col("kind") == _OPEN).select("part", "doc_id", "text").join(ring, "part")
    ends = ends.join(heads.withColumnRenamed("part", "_to"), "_to").select("doc_id", "text", "next_text")
    closed = ends.mapInPandas(_pairs, f"doc_id {kind}, {_TYPES}")
    return walked.filter(F.col("kind") == _DONE).select("doc_id", *_COLUMNS).unionByName(closed)
