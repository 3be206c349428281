"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids, with an end id, are cut at every window length; full pieces are windows of their own and move no
further. The rest of each document is cut into pieces of at most PIECE ids, as differencing needs several items a window
to even them out. These go to groups of about GROUP pieces, dealt by a hash, so any number of groups is packed at once. A group starts with as few windows as its tokens need. Partial partitions of
its pieces are merged, those of the largest imbalance first, the fullest window of one with the emptiest of the other,
which gives near-equal windows; while the fullest window exceeds the capacity, the number of windows rises.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from .bpe import Tokenizer, _slices, gathered, tokenizer
from .hashing import release

WINDOW, PIECE, END_ID = 2048, 512, 1
GROUP = 2048  # pieces packed together; a group's padding is a fraction of a percent, its time grows with the square
WORDS_HELD = 300_000  # words that a task remembers

PIECES = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Growing:
    """An array that is added to at its end."""

    def __init__(self, kind):
        self.held, self.size = np.empty(1024, kind), 0

    def __len__(self) -> int:
        return self.size

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.held):
            self.held = np.concatenate([self.values(), np.empty(self.size + 2 * len(more), self.held.dtype)])
        self.held[self.size:self.size + len(more)] = more
        self.size += len(more)

    def values(self) -> np.ndarray:
        return self.held[:self.size]


class WordIds:
    """Ids of words by their hash, remembered while there are not too many."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.flat, self.starts, self.sizes = Growing(np.uint32), Growing(np.int64), Growing(np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the offsets of the texts."""
        if len(self.place) > WORDS_HELD:
            self.clear()
        hashes, offsets, words = self.tok.split_words(texts, self.place)
        seen, place = np.unique(hashes, return_inverse=True)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        ids, sizes = self.tok.ids(list(words.values()))
        self.starts.add(len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes.add(sizes)
        self.flat.add(ids)
        code = np.fromiter(map(self.place.__getitem__, seen.tolist()), np.int64, len(seen))[place]
        got, ends = gathered(self.flat.values(), self.starts.values(), self.sizes.values(), code)
        return got, ends[offsets]


def _pieces(path: str, window: int, piece: int, end_id: int):
    def run(parts):
        from pyspark import TaskContext

        word_ids, uid = WordIds(tokenizer(path)), TaskContext.get().partitionId() << 40
        for part in parts:
            for ids, texts in _slices(part):
                values, ends = word_ids(texts)
                out = []
                for doc, a, b in zip(ids, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = np.append(values[a:b], np.uint32(end_id)).astype("<u4")
                    whole = len(own) - len(own) % window
                    for start, size in [*((x, window) for x in range(0, whole, window)), *((x, piece) for x in range(whole, len(own), piece))]:
                        cut = own[start:start + size]
                        out.append((uid, doc, start, len(cut), zlib.crc32(cut.tobytes()), len(own)))
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [c.split()[0] for c in PIECES.split(", ")])
        del word_ids
        release()

    return run


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: which of k windows each item goes to, and the windows' sums.

    A partial partition has up to k non-empty windows in falling order; the empty ones are left out of its arrays.
    """
    n = len(sizes)
    parent = np.arange(n)  # a window is known by one of its items
    heap, parts = [], {}
    for i in range(n):
        parts[i] = (sizes[i:i + 1].astype(np.int64), np.array([i]))
        heap.append((-(int(sizes[i]) if k > 1 else 0), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        (sums, slots), (more, joining) = parts.pop(i), parts.pop(j)
        if len(sums) < len(more):
            sums, slots, more, joining = more, joining, sums, slots
        # The q-th fullest window of the one meets the q-th emptiest of the other; that may be an empty one.
        free = min(k - len(sums), len(more))
        if met := len(more) - free:
            sums = sums.copy()
            sums[-met:] += more[free:][::-1]
            parent[joining[free:][::-1]] = slots[-met:]
        if free:
            sums, slots = np.concatenate([sums, more[:free]]), np.concatenate([slots, joining[:free]])
        order = np.argsort(-sums, kind="stable")
        parts[i] = sums, slots = sums[order], slots[order]
        heapq.heappush(heap, (int((sums[-1] if len(sums) == k else 0) - sums[0]), i))
    for i in range(n):
        root = i
        while parent[root] != root:
            root = parent[root]
        parent[i] = root
    if not n:
        return parent, np.zeros(0, np.int64)
    (sums, slots), = parts.values()
    place = np.zeros(n, np.int64)
    place[slots] = np.arange(len(slots))
    return place[parent], sums


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item; no window exceeds the capacity, as no item does."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        place, sums = differencing(sizes, k)
        if not len(sums) or sums[0] <= capacity:
            return place
        k = max(k + 1, int(k * (1 + (sums[0] - capacity) / capacity / 2)))


def _packed(window: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("uid", "ascending")])
        sizes = group.column("length").to_numpy()
        place = windows(sizes, window)
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate([[True], np.diff(place[order]) > 0])
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
        number = (group.column("group").to_numpy() << 32 | place) * 2 + 1
        return group.drop_columns(["uid", "group"]).append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return pack


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
         piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents in windows of `window`.

    A null or empty text has the end id alone. Null ids and repeated rows are packed like any row; further columns are
    dropped. An empty table has no pieces.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    pieces = written_table(rows.mapInArrow(_pieces(path, window, piece, end_id), PIECES), "pieces")
    full, rests = pieces.filter(F.col("length") == window), pieces.filter(F.col("length") < window)
    groups = max(1, round(rests.count() / GROUP))
    rests = rests.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("long"))
    rests = rests.groupBy("group").applyInArrow(_packed(window), PIECES.replace("uid long, ", "") + ", sequence_id long, offset long")
    return full.withColumn("sequence_id", F.col("uid") * 2).withColumn("offset", F.lit(0).cast("long")).drop("uid").unionByName(rests)
