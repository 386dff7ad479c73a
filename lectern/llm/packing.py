"""Packing of token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm.shared import Memory

CAPACITY = 2048
#: Windows that are filled together, and the longest piece dealt to them.
WINDOWS = 64
GRAIN = 512
END = 1


def differencing(sizes: Sequence[int], windows: int) -> list[int]:
    """The window of each size: partial partitions with the largest imbalances are merged, large sums onto small ones."""
    parent: list[int] = list(range(len(sizes)))
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - windows)
        # the smallest sums of a meet the smallest of b in opposite order; the rest have a window to themselves
        merged = a[: len(a) - both] + b[: len(b) - both]
        for (x, i), (y, j) in zip(a[len(a) - both :], reversed(b[len(b) - both :])):
            node = len(parent)
            parent.append(node)
            parent[i] = parent[j] = node
            merged.append((x + y, node))
        merged.sort(key=lambda s: (-s[0], s[1]))
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], len(parent) + len(heap), merged))
    number = {node: w for w, (_, node) in enumerate(heap[0][2])} if heap else {}
    out = [0] * len(parent)
    for i in range(len(parent) - 1, -1, -1):
        out[i] = number[i] if parent[i] == i else out[parent[i]]
    return out[: len(sizes)]


def pack(sizes: Sequence[int], capacity: int = CAPACITY, windows: int | None = None) -> tuple[list[int], int]:
    """(window of each size, number of windows): as many near-equal windows as it takes for none to exceed ``capacity``."""
    count = max(windows or 0, -(-sum(sizes) // capacity))
    if not sizes:
        return [], count
    while True:
        dealt = differencing(sizes, count)
        sums = [0] * count
        for w, size in zip(dealt, sizes):
            sums[w] += size
        if max(sums, default=0) <= capacity:
            return dealt, count
        count += 1


#: Letters that the short way handles: ASCII and Latin-1, which lower-case to one letter and compose with nothing.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÿ]+\Z")
#: The vocabulary's own division of a word, fixed by its file, over those letters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Most words: letters, and marks after them that are one piece.
_LETTERS, _MARKS = re.compile(r"[a-zß-öø-ÿ]+\Z"), ".,;:!?*%$#&"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet of the vocabulary: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """Token ids of texts as little-endian bytes, word by word.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its words in turn;
    words recur, and each is encoded once while it is remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.pieces = Memory(self._piece)
        self.words = Memory(self._word)

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        low = text.lower()
        body = low.rstrip(_MARKS)
        if _LETTERS.match(body):
            marks = low[len(body) :]
            return self.pieces[body] + self.pieces[marks] if marks else self.pieces[body]
        if _PLAIN.match(text) and "<|" not in text:
            return b"".join([self.pieces[p] for p in _PIECE.findall(text.lower())])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        words = self.words
        return b"".join([words[w] for w in (text or "").encode("utf-8", "replace").split()])


class _Filler:
    """Pieces waiting for windows; rows (doc_id, start, length, ids, doc_tokens, sequence, offset) come out."""

    def __init__(self, first: int, capacity: int, windows: int, grain: int):
        self.next, self.capacity, self.windows, self.grain = first, capacity, windows, grain
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        while n - at >= self.capacity:
            yield doc_id, at, self.capacity, ids[4 * at : 4 * (at + self.capacity)], n, self.next, 0
            self.next += 1
            at += self.capacity
        while at < n:
            size = min(self.grain, n - at, self.windows * self.capacity - self.held)
            self.waiting.append((doc_id, at, size, ids[4 * at : 4 * (at + size)], n))
            self.held += size
            at += size
            if self.held == self.windows * self.capacity:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        dealt, count = pack([p[2] for p in self.waiting], self.capacity)
        offsets = [0] * count
        for piece, window in zip(self.waiting, dealt):
            yield *piece, self.next + window, offsets[window]
            offsets[window] += piece[2]
        self.next, self.waiting, self.held = self.next + count, [], 0


def _packer(path: str, capacity: int, windows: int, grain: int, keep_ids: bool):
    def run(batches):
        encode, end = WordIds(path), END.to_bytes(4, "little")
        filler = _Filler(TaskContext.get().partitionId() << 36, capacity, windows, grain)

        def frame(rows: list[tuple]) -> pd.DataFrame:
            cols = list(zip(*rows))
            out = {
                "doc_id": pd.Series(cols[0], dtype="object"), "start": cols[1], "length": cols[2], "ids_crc32": [zlib.crc32(b) for b in cols[3]],
                "doc_tokens": cols[4], "sequence_id": cols[5], "offset": cols[6],
            }
            if keep_ids:
                out["ids"] = [np.frombuffer(b, dtype="<u4").astype("int32") for b in cols[3]]
            return pd.DataFrame(out)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None), batch["text"]):
                rows.extend(filler.add(doc_id, encode(text) + end))
                if len(rows) >= 20_000:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)
        if filler.waiting:
            yield frame(list(filler.flush()))

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, windows: int = WINDOWS, grain: int = GRAIN, keep_ids: bool = False
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` tokens.

    A document is its text's ids, then the end id. Whole capacities of it are sequences of their own; what remains is
    cut into pieces of at most ``grain`` ids, and each ``windows`` capacities' worth of pieces is dealt into near-equal
    windows by differencing; if one exceeds the capacity, the number of windows rises by one until none does. Returns
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, with ``keep_ids`` also ids (array of int).

    Every task packs what it reads, holding one batch and one group of windows: no shuffle, bounded memory, and the same
    rows again when a task is repeated. Sequence ids are unique and start anew at a multiple of 2^36 in each partition.
    ``tokenizer_path`` must exist on every executor. Null texts are empty (the end id alone); a null doc_id stays null;
    repeated rows are packed as often as they come; other columns are dropped; an empty table gives no pieces.
    """
    if not 0 < grain <= capacity:
        raise ValueError("grain must be between 1 and the capacity")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_packer(tokenizer_path, capacity, windows, grain, keep_ids), schema + ", ids array<int>" * keep_ids)
