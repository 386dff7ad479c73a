"""Merkle dataset manifest: aligned builders append nodes in completion order, closed-form positions address siblings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import saved

#: Nodes of a run: so many consecutive ones become one.
ARITY = 3
#: A builder takes ARITY ** HEIGHT nodes, aligned at a multiple of that; its log has about one and a half times as many.
HEIGHT = 7
#: Key of the tree over the subroots; a source's own key is ``-`` or begins with a number.
TOP = "top"

PATH = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def levels(n: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree of ``n`` of them."""
    height, width = 0, 1
    while width < n:
        height, width = height + 1, width * arity
    return height


def position(level: int, place: int, n: int, arity: int = ARITY) -> int:
    """Where the log holds node ``place`` of ``level`` in a tree of ``n`` leaves: as many nodes lie before it as complete
    subtrees end before it, its own descendants included.

    Up to its own level every node up to the last leaf below it is complete; above, only those to its left are.
    """
    end, at = min((place + 1) * arity**level, n), -1
    for h in range(max(levels(n, arity), level) + 1):
        at += -(-end // arity**h) if h <= level else place // arity ** (h - level)
    return at


def append(nodes: list[str], height: int, arity: int = ARITY) -> list[str]:
    """The log of a subtree of the given height over ``nodes``: each node follows its last child.

    A full run closes as soon as it is complete; what is left open at the end closes level by level, also where one
    node alone rises.
    """
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(height + 1)]

    def put(node: str, level: int) -> None:
        log.append(node)
        if level < height:
            open_runs[level].append(node)
            if len(open_runs[level]) == arity:
                close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        put(digest("".join(run)), level + 1)

    for node in nodes:
        put(node, 0)
    for level in range(height):
        if open_runs[level]:
            close(level)
    return log


def siblings(log: list[str], place: int, n: int, height: int, arity: int = ARITY) -> list[tuple[str, str]]:
    """(left, right) of each level: the joined digests of the run's nodes before and after the one on the way up."""
    out = []
    for level in range(height):
        width = -(-n // arity**level)
        first = place - place % arity
        run = [log[position(level, p, n, arity)] for p in range(first, min(first + arity, width))]
        out.append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        place //= arity
    return out


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """A document's leaf: every value is preceded by its length in bytes, a null is ``-``."""
    return F.sha2(F.concat(*map(_encoded, (doc_id, source, lang, n_chars, text))), 256)


def ranked(entries: DataFrame, *order: Column) -> DataFrame:
    """``entries`` (tree, node, …) with place (from 0) and n (entries of the tree), in ``order`` within each tree.

    Rows are dealt by ranges of tree, order and node, so a tree of any size covers many tasks; each range sends one row
    a tree that it holds, and the places before it are added to its own row numbers.
    """
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows equal in all of these are interchangeable: a number spreads them
    spread = entries.withColumn("_row", F.monotonically_increasing_id())
    keys = ["tree", *order, "node", "_row"]
    dealt = spread.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row")
    at = F.monotonically_increasing_id()
    dealt = saved(dealt.withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    runs = dealt.groupBy("_part", "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("tree").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(W.partitionBy("tree")))
    placed = dealt.join(runs, ["_part", "tree"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_part", "_at", "_first", "_n", "_before")


def append_log(entries: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """The log of every tree of ``entries`` (tree, place, n, node): rows of (tree, total, tier, block, n, leaves, nodes).

    A builder takes one block: ``arity ** height`` consecutive nodes, aligned, so its subtree is one of the whole tree's
    and needs no other builder. Its last node is a leaf of the next tier, whose blocks are built in the same way, until
    each tree has one node. ``nodes`` is the builder's log in completion order, ``leaves`` how many nodes it took, n how
    many its tier has, total how many leaves the tree has. A task holds one block, about ``1.5 * arity ** height`` digests, however large the tree.
    """
    width, out, tier, more = arity**height, None, 0, True
    block = F.floor(F.col("place") / F.lit(width)).cast("bigint")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        n = int(rows["n"].iloc[0])
        nodes = append(rows["node"].tolist(), min(height, levels(n, arity)), arity)
        return pd.DataFrame({"tree": [key[0]], "total": [int(rows["total"].iloc[0])], "tier": [tier], "block": [key[1]], "n": [n], "leaves": [len(rows)], "nodes": [nodes]})

    entries = entries.select("tree", "place", "n", "node", F.col("n").alias("total"))
    while more:
        built = entries.withColumn("block", block).groupBy("tree", "block").applyInPandas(
            build, "tree string, total bigint, tier int, block bigint, n bigint, leaves int, nodes array<string>")
        built = saved(built, "manifest")
        out = built if out is None else out.union(built)
        entries = built.filter(F.col("n") > width).select(
            "tree", F.col("block").alias("place"), F.ceil(F.col("n") / F.lit(width)).cast("bigint").alias("n"), F.element_at("nodes", -1).alias("node"), "total")
        more, tier = bool(entries.take(1)), tier + 1
    return out


def log_nodes(log: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """Every node of the log once: (tree, position, level, place, node), positions gapless from 0 in each tree."""
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                total, base = int(row.total), height * row.tier
                rows = []
                for level in range(min(height, levels(row.n, arity)) + 1):
                    if level or not row.tier:  # the nodes a higher tier starts from stand in the tier below
                        for i in range(-(-row.leaves // arity**level)):
                            place = row.block * arity ** (height - level) + i
                            rows.append((row.tree, position(base + level, place, total, arity), base + level, place, row.nodes[position(level, i, row.leaves, arity)]))
                yield pd.DataFrame(rows, columns=["tree", "position", "level", "place", "node"])

    return log.mapInPandas(number, "tree string, position bigint, level int, place bigint, node string")


def roots(log: DataFrame, height: int = HEIGHT, arity: int = ARITY) -> DataFrame:
    """(tree, root): the last node of each tree's last builder."""
    return log.filter(F.col("n") <= arity**height).select("tree", F.element_at("nodes", -1).alias("root"))


def _block_paths(arity: int, height: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                up, first = [(s["left"], s["right"]) for s in row.up], row.block * arity**height
                paths = [siblings(row.nodes, i, row.leaves, min(height, levels(row.n, arity)), arity) + up for i in range(row.leaves)]
                frame = {"tree": row.tree, "block": range(first, first + row.leaves), "up": [[{"left": a, "right": b} for a, b in p] for p in paths]}
                yield pd.DataFrame(frame)

    return run


def prove(log: DataFrame, wanted: DataFrame, ends: DataFrame | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """``wanted`` (tree, place, …) with path: the siblings of its way up, level by level, each level's left and right ones.

    From the highest tier down every block learns the path of its own last node; in the lowest, each wanted leaf meets
    its block's log, where closed-form positions address its siblings. ``ends`` (tree, up, …) has what follows on a tree's
    root, one row a tree; its other columns, strings, are added. Blocks that nothing asks for give nothing.
    """
    tiers = log.agg(F.max("tier")).first()[0]
    up = log.select("tree", F.lit(0).cast("bigint").alias("block"), F.array().cast(PATH).alias("up")).limit(0)
    whole = F.col("n") <= arity**height  # the tree's last builder has nothing above it

    def above(tier: int) -> DataFrame:
        mine = log.filter(F.col("tier") == tier).join(up, ["tree", "block"], "left")
        return mine.withColumn("up", F.when(whole, F.array().cast(PATH)).otherwise(F.col("up")))

    for tier in range(tiers or 0, 0, -1):
        up = saved(above(tier).mapInPandas(_block_paths(arity, height), f"tree string, block bigint, up {PATH}"), "paths")

    blocks, more = above(0), [c for c in ends.columns if c not in ("tree", "up")] if ends else []
    if ends:  # joined to the blocks' keys: their logs stay where they are
        after = log.filter("tier = 0").select("tree", "block").join(ends.withColumnRenamed("up", "_after"), "tree")
        blocks = blocks.join(after, ["tree", "block"]).withColumn("up", F.concat("up", "_after")).drop("_after")
    fields = [f.name for f in wanted.schema.fields] + ["path", *more]

    def extract(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({f: [] for f in fields})
        row = blocks.iloc[0]
        onward, first = [(s["left"], s["right"]) for s in row["up"]], int(row["block"]) * arity**height
        rise = min(height, levels(int(row["n"]), arity))
        paths = [siblings(row["nodes"], int(p) - first, int(row["leaves"]), rise, arity) + onward for p in asked["place"]]
        return asked.assign(path=[[{"left": a, "right": b} for a, b in p] for p in paths], **{c: row[c] for c in more})[fields]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields] + [f"path {PATH}", *(f"`{c}` string" for c in more)])
    asked = wanted.withColumn("_block", F.floor(F.col("place") / F.lit(arity**height)).cast("bigint"))
    return asked.groupBy("tree", "_block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(extract, schema)


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def build_manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, log, top): the documents' leaves in their places, the log of every source's tree, the log of the tree
    over the subroots.

    leaves: doc_id, source, tree (the source's key), place, n, node. Sources come null first, then by bytes. Equal ids
    follow each other by their leaves; null ids come first. Columns that ``docs`` lacks count as null, other columns take
    no part. An empty table gives empty logs.
    """
    have = set(docs.columns)
    columns = [F.col(f"`{c}`") if c in have else F.lit(None).cast("string") for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = docs.select(F.col("doc_id"), columns[1].alias("source"), leaf(*columns).alias("node"), _tampered(*columns).alias("tampered"))
    entries = saved(rows.withColumn("tree", _encoded(F.col("source"))), "leaves")
    leaves = saved(ranked(entries, F.col("doc_id")), "placed")
    log = append_log(leaves)
    subroots = roots(log).join(leaves.filter("place = 0").select("tree", "source"), "tree")
    top = subroots.select(F.lit(TOP).alias("tree"), "source", F.col("root").alias("node"), F.col("tree").alias("of"))
    top = saved(ranked(top, F.col("source")), "subroots")
    return leaves, log, top


def _tampered(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The leaf after tampering: where 2 divides the CRC-32 of the id, the text has lost its line ends."""
    cut = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return leaf(doc_id, source, lang, n_chars, F.when(cut, F.regexp_replace(text.cast("string"), "\n", "")).otherwise(text.cast("string")))


def prove_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    Each row is proven from the log, and then checked as a receiver would who got a text without its line ends (rows
    whose id's CRC-32 is even; a null id is never tampered with). Rows count one by one.
    """
    leaves, log, subroots = build_manifest(docs)
    top = append_log(subroots)
    rising = prove(top, subroots.drop("source", "n")).join(F.broadcast(roots(top)), "tree")  # one root
    ends = saved(rising.select(F.col("of").alias("tree"), F.col("path").alias("up"), F.col("node").alias("subroot"), "root"), "ends")
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = leaves.select("tree", "place", F.col("doc_id").cast("string").alias("doc_id"), "node", "tampered")  # null integers would turn into floats
    return prove(log, asked, ends).select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.col("tampered"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc_table() -> str:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return "[" + ",".join(map(str, out)) + "]::BIGINT[]"


def manifest_sql() -> str:
    """DuckDB SQL for the rows of ``prove_documents``: trees level by level, siblings by a join, roots by folding."""
    def encoded(column: str, value: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({value}))::VARCHAR || ':' || {value} END"

    head = " || ".join(encoded(c, f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars"))
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, sha256({head} || {encoded("text", "text")}) AS leaf,
         CASE WHEN xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
                  lambda x, y: xor(x >> 8, ({_crc_table()})[(xor(x, y) & 255) + 1])), 4294967295) % 2 = 0 AND doc_id IS NOT NULL
              THEN sha256({head} || {encoded("text", "replace(text, chr(10), '')")})
              ELSE sha256({head} || {encoded("text", "text")}) END AS tampered
  FROM documents),
l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (
  SELECT 0 AS h, source, i, leaf AS node, n FROM l
  UNION ALL
  SELECT h + 1, source, i // 3, sha256(string_agg(node, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY h, source, i // 3, n),
s AS (SELECT source, node, h AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM t WHERE n = 1),
u AS (
  SELECT 0 AS h, j, node, m FROM s
  UNION ALL
  SELECT h + 1, j // 3, sha256(string_agg(node, '' ORDER BY j)), (m + 2) // 3 FROM u WHERE m > 1 GROUP BY h, j // 3, m),
a AS (
  SELECT x.source, x.h, x.i, coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS before,
         coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS behind
  FROM t x JOIN t y ON x.source IS NOT DISTINCT FROM y.source AND x.h = y.h AND x.i // 3 = y.i // 3 WHERE x.n > 1 GROUP BY x.source, x.h, x.i),
b AS (
  SELECT x.h, x.j, coalesce(string_agg(y.node, '' ORDER BY y.j) FILTER (y.j < x.j), '') AS before,
         coalesce(string_agg(y.node, '' ORDER BY y.j) FILTER (y.j > x.j), '') AS behind
  FROM u x JOIN u y ON x.h = y.h AND x.j // 3 = y.j // 3 WHERE x.m > 1 GROUP BY x.h, x.j),
f AS (
  SELECT r, source, 0 AS h, i AS k, tampered AS node, '' AS proof, false AS up FROM l
  UNION ALL
  SELECT f.r, f.source, CASE WHEN NOT f.up AND a.h IS NULL THEN 0 ELSE f.h + 1 END,
         CASE WHEN NOT f.up AND a.h IS NULL THEN s.j ELSE f.k // 3 END,
         CASE WHEN NOT f.up AND a.h IS NULL THEN f.node ELSE sha256(coalesce(a.before, b.before) || f.node || coalesce(a.behind, b.behind)) END,
         f.proof || coalesce(a.before, b.before, '') || coalesce(a.behind, b.behind, ''), f.up OR a.h IS NULL
  FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
  LEFT JOIN a ON NOT f.up AND a.source IS NOT DISTINCT FROM f.source AND a.h = f.h AND a.i = f.k
  LEFT JOIN b ON f.up AND b.h = f.h AND b.j = f.k
  WHERE NOT f.up OR b.h IS NOT NULL),
e AS (SELECT r, arg_max(node, h) AS node, arg_max(proof, h) AS proof FROM f WHERE up GROUP BY r)
SELECT l.doc_id, l.leaf, s.node AS subroot, (SELECT node FROM u WHERE m = 1) AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root,
       e.node = (SELECT node FROM u WHERE m = 1) AS verified
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN e USING (r)
"""
