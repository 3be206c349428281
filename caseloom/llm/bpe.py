"""BPE encoding and decoding through a table of distinct words.

The tokenizer's file names the rules: NFC, lower case, white space dropped, then contractions, runs of letters, single
numbers and runs of other symbols, each a word that is encoded on its own. So a word's ids depend on the word alone.

`split_words` cuts texts in the tasks, whole batches at a time in NumPy, and names each word by a 64-bit hash of its
symbols. Texts with code points outside the well-known ranges are cut by the tokenizers library itself.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .hashing import mix, release, run_hashes

# White space and contractions of the tokenizer's pattern.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

KNOWN = 0x250  # code points below are cut by table, those above up to 0x2070 only if punctuation
TABLE = 0x2070
BLANK, LETTER, NUMBER, OTHER, FOREIGN = range(5)
CHARS = 1 << 19  # symbols worked on at a time
CHUNK_WORDS = 1 << 18  # distinct words of a chunk of documents
CHUNK_CHARS = 1 << 23  # and its symbols
DECODED = 100  # texts decoded at a time
WORDS_HELD = 1 << 19  # encoded words that a task remembers


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file; made anew for each task, as workers would keep its tables for good."""
    return Tokenizer(path)


def _classes() -> np.ndarray:
    out = np.full(TABLE + 1, FOREIGN, np.uint8)
    for i in [*range(KNOWN), *range(0x2010, TABLE)]:
        kind = unicodedata.category(chr(i))
        if i < KNOWN or kind[0] in "PZ":
            out[i] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    out[[i for i in WHITE if i < TABLE]] = BLANK
    out[TABLE] = FOREIGN
    return out


def normal(text: str) -> str:
    """NFC and lower case, symbol by symbol (so a final sigma is an ordinary one)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Tokenizer:
    """The tokenizer of a file, split into what is done to a text and what is done to a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = f.read()
        self.special = {x["content"]: x["id"] for x in json.loads(self.spec)["added_tokens"] if x["special"]}
        self.classes = _classes()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer as Library

        return Library.from_str(self.spec)

    @cached_property
    def word_library(self):
        from tokenizers import Tokenizer as Library

        spec = json.loads(self.spec)
        spec.update(added_tokens=[], normalizer=None, post_processor=None, pre_tokenizer={"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
        return Library.from_str(json.dumps(spec))

    def special_parts(self, text: str) -> list[str]:
        """The text cut at the special tokens it names; those stand at the odd places."""
        return re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if "<|" in text else [text]

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of single words, one after the other, and how many each word has.

        Words are encoded together, with line ends between them; the last piece of a word bears the mark of a word's end.
        A special token is a word of its own kind.
        """
        flat, sizes = [], []
        for at in range(0, len(words), 4000):
            some = words[at:at + 4000]
            ids = np.array(self.word_library.encode("\n".join(some), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.word_ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the pieces of this vocabulary do not tell where words end")
            own = np.diff(ends, prepend=0)
            for i in [i for i, w in enumerate(some) if w in self.special] if self.special else ():
                ids, own = _replaced(ids, own, i, self.special[some[i]])
            flat.append(ids)
            sizes.append(own)
        empty = [np.zeros(0, np.int32)]
        return np.concatenate(flat or empty), np.concatenate(sizes or empty).astype(np.int64)

    @cached_property
    def word_ends(self) -> np.ndarray:
        """Whether the piece of each id ends a word."""
        mark = json.loads(self.spec)["model"]["end_of_word_suffix"]
        return np.array([piece.endswith(mark) for piece in self.pieces()])

    def pieces(self) -> list[str]:
        """The piece of each id, as the library's vocabulary has it."""
        return [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]

    def _by_library(self, text: str) -> list[str]:
        back = _byte_symbols()
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(back[c] for c in word).decode("utf-8") for word, _ in cut]

    def split_words(self, texts: list[str], known=()) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
        """Hashes of the words of all texts in order, their offsets by text, and the word of each distinct hash not in `known`."""
        hashes, counts, words = [], np.zeros(len(texts), np.int64), {}
        for owner, parts in self._pieces(texts):
            found, starts, ends, points, joined = parts
            counts += np.bincount(owner, minlength=len(texts))
            hashes.append(found)
            new, at = np.unique(found, return_index=True)
            for h, i in zip(new.tolist(), at.tolist(), strict=True):
                if h not in known and h not in words:
                    words[h] = joined[starts[i]:ends[i]]
        return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)]), words

    def _pieces(self, texts: list[str]):
        """Batches of words as (text of each word, (hashes, starts, ends, symbols, joined text))."""
        held, size = [], 0
        for i, text in enumerate(texts):
            for odd, part in enumerate(self.special_parts(text)):
                at = 0
                while at < len(part):
                    stop = min(at + CHARS, len(part))
                    while stop < len(part) and not part[stop].isspace():
                        stop += 1
                    held.append((i, part[at:stop], odd % 2 == 1))
                    size += stop - at
                    at = stop
                    if size >= CHARS:
                        yield self._cut(held)
                        held, size = [], 0
        if held:
            yield self._cut(held)

    def _cut(self, held: list[tuple[int, str, bool]]):
        lowered = [part if special else normal(part) for _, part, special in held]
        joined, points = _joined(lowered)
        kind = self.classes[np.minimum(points, TABLE)]
        if (kind == FOREIGN).any() or any(special for _, _, special in held):
            # Words found by the library (or given) replace the part; single blanks keep them apart, marks say so.
            foreign = np.add.reduceat(kind == FOREIGN, np.cumsum([0, *[len(x) + 1 for x in lowered[:-1]]])) > 0
            cut = [[part] if special else self._by_library(part) if odd else None for (_, part, special), odd in zip(held, foreign, strict=True)]
            lowered = [x if c is None else "\n".join(c) for x, c in zip(lowered, cut, strict=True)]
            joined, points = _joined(lowered)
            kind = self.classes[np.minimum(points, TABLE)]
            whole = np.repeat([c is not None for c in cut], [len(x) + 1 for x in lowered])
            kind = np.where(whole, np.where(points == 10, BLANK, LETTER), kind).astype(np.uint8)
        else:
            whole = None
        starts, ends = self._runs(points, kind, whole)
        table = mix(np.arange(0x3000, dtype=np.uint64) + np.uint64(0x1234567))

        def symbols(a, b):
            x = points[a:b]
            return table[x] if len(x) == 0 or x.max() < 0x3000 else mix(x.astype(np.uint64) + np.uint64(0x1234567))

        found = run_hashes(symbols, starts, ends)
        bounds = np.cumsum([0, *[len(x) + 1 for x in lowered]])
        owner = np.array([i for i, _, _ in held])[np.searchsorted(bounds, starts, "right") - 1]
        return owner, (found, starts, ends, points, joined)

    @staticmethod
    def _runs(points, kind, whole):
        """Starts and ends of the words: contractions, letter runs, single numbers, runs of other symbols."""
        n = len(points)
        blank = kind == BLANK
        start = ~blank
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        quotes = np.flatnonzero(start[:-1] & (points[:-1] == 39) & (kind[1:] == LETTER)) if n > 1 else np.zeros(0, np.int64)
        if whole is not None:
            quotes = quotes[~whole[quotes]]
        if len(quotes):
            one = points[quotes + 1]
            two = np.where(quotes + 2 < n, points[np.minimum(quotes + 2, n - 1)], 0)
            size = np.zeros(len(quotes), np.int64)
            for c in CONTRACTIONS:
                hit = one == ord(c[1])
                size[hit & (two == ord(c[2])) if len(c) == 3 else hit] = len(c)
            quotes, size = quotes[size > 0], size[size > 0]
            start[quotes + 1] = False
            after = quotes + size
            inside = after < n
            start[after[inside]] |= kind[after[inside]] == LETTER
        edges = np.append(np.flatnonzero(start | blank), n)
        first = start[edges[:-1]]
        return edges[:-1][first], edges[1:][first]


def _replaced(ids: np.ndarray, sizes: np.ndarray, word: int, one: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words with those of one word replaced by a single id."""
    at = int(sizes[:word].sum())
    ids = np.concatenate([ids[:at], np.array([one], np.int32), ids[at + int(sizes[word]):]])
    sizes = sizes.copy()
    sizes[word] = 1
    return ids, sizes


def _joined(parts: list[str]) -> tuple[str, np.ndarray]:
    joined = "\n".join(parts) + "\n"
    return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32)


def _byte_symbols() -> dict[str, int]:
    """The byte of each symbol of a byte-level vocabulary: printable bytes stand for themselves, others count up from 256."""
    plain = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


CHUNKS = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType()), T.StructField("words", T.BinaryType())])


def packed(values: np.ndarray | bytes) -> bytes:
    """Compressed bytes, with their length before."""
    raw = values if isinstance(values, bytes) else values.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(value: bytes) -> bytes:
    size = int.from_bytes(value[:8], "little")
    return pa.decompress(value[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _rows(chunk: int, part: list, **columns) -> pa.RecordBatch:
    kinds = {"doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "codes": pa.binary(), "words": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), pa.array(part, pa.int32()), *[
        pa.array(columns.get(k, [None] * len(part)), t) for k, t in kinds.items()]], ["chunk", "part", *kinds])


def _chunked(path: str, parts_of_table: int):
    """Documents as positions in the list of distinct words of their chunk, and that list by parts of the word table.

    A chunk is a run of documents of one task, of at most about CHUNK_WORDS distinct words and CHUNK_CHARS symbols, or
    one document. A word's part follows from its hash.
    """
    def listed(chunk: int, codes: dict, words: dict):
        by_part: dict[int, list] = {}
        for h, code in codes.items():
            by_part.setdefault(h % parts_of_table, []).append((words[h], code))
        rows = [(part, sorted(own)) for part, own in by_part.items()]
        return _rows(chunk, [part for part, _ in rows], codes=[packed(np.array([c for _, c in own], np.int32)) for _, own in rows],
                     words=[packed("\n".join(w for w, _ in own).encode()) for _, own in rows])

    def run(parts):
        from pyspark import TaskContext

        tok, chunk = tokenizer(path), TaskContext.get().partitionId() << 32
        codes, words, size = {}, {}, 0
        for part in parts:
            for ids, texts in _slices(part):
                hashes, offsets, found = tok.split_words(texts, codes)
                seen, place = np.unique(hashes, return_inverse=True)
                codes.update(zip(found, range(len(codes), len(codes) + len(found)), strict=True))
                words.update(found)
                code = np.fromiter(map(codes.__getitem__, seen.tolist()), np.int32, len(seen))[place]
                yield _rows(chunk, [None], doc_ids=[ids], sizes=[np.diff(offsets).tolist()], codes=[packed(code)])
                size += sum(map(len, texts))
                if len(codes) >= CHUNK_WORDS or size >= CHUNK_CHARS:
                    yield listed(chunk, codes, words)
                    codes, words, size, chunk = {}, {}, 0, chunk + 1
        if codes:
            yield listed(chunk, codes, words)
        del tok, codes, words
        release()

    return run


def _encoded(path: str):
    """The ids of the words of each list. Lists come by part of the word table, and a word of a part is encoded once, as long as
    its words number no more than `WORDS_HELD`."""
    def run(parts):
        tok, held, now = tokenizer(path), {}, None
        for part in parts:
            for chunk, number, words in zip(*[part.column(c).to_pylist() for c in ("chunk", "part", "words")], strict=True):
                if number != now or len(held) > WORDS_HELD:  # words beyond the bound are encoded again
                    held, now = {}, number
                words = unpacked(words).decode().split("\n")
                new = [w for w in words if w not in held]
                flat, sizes = tok.ids(new)
                stops = np.cumsum(sizes) * 4
                raw = flat.tobytes()
                held.update((w, raw[b - 4 * n:b]) for w, b, n in zip(new, stops.tolist(), sizes.tolist(), strict=True))
                ids = [held[w] for w in words]
                sizes = np.array([len(x) // 4 for x in ids], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([number], pa.int32()), pa.array([packed(sizes)]), pa.array([packed(b"".join(ids))])],
                                                 ["home", "number", "lengths", "ids"])
        del tok, held
        release()

    return run


def _slices(part: pa.RecordBatch, chars: int = CHARS):
    """(ids, texts) of runs of rows of about `chars` symbols; null texts count as empty."""
    ids, texts, size = [], [], 0
    for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
        ids.append(i)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat` with the numbers in `picked`, one after the other, and their offsets."""
    own = sizes[picked]
    ends = np.concatenate([[0], np.cumsum(own)])
    return flat[np.arange(ends[-1]) + np.repeat(starts[picked] - ends[:-1], own)], ends


def _joined_back(docs: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of the documents of one chunk, from the ids of its words."""
    answers = {x["number"]: (np.frombuffer(unpacked(x["lengths"]), np.int32), np.frombuffer(unpacked(x["ids"]), np.int32)) for x in words.to_pylist()}
    rows = docs.to_pylist()
    lists = [(np.frombuffer(unpacked(x["codes"]), np.int32), *answers[x["part"]]) for x in rows if x["part"] is not None]
    code, size, flat = [np.concatenate(x) if lists else np.zeros(0, np.int32) for x in (zip(*lists, strict=True) if lists else [()] * 3)]
    sizes, starts = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    sizes[code], starts[code] = size, np.cumsum(size) - size
    ids, out, ends, last = [], [], [np.zeros(1, np.int64)], 0
    for row in rows:
        if row["part"] is None:
            got, stops = gathered(flat, starts, sizes, np.frombuffer(unpacked(row["codes"]), np.int32))
            out.append(got)
            ends.append(last + stops[np.cumsum(row["sizes"])])
            last += len(got)
            ids += row["doc_ids"]
    values = pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), values)})


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as the tokenizers library gives them without adding special tokens.

    A null text counts as empty; null ids and repeated rows pass through, one result a row. Special tokens that a text
    names become their own ids, as in the library.

    The distinct words of a chunk of documents travel as packed lists to their parts of the word table, where each
    distinct word is encoded once, and their ids come back as lists; the documents' positions stay where they were
    written, bucketed by chunk. So what moves grows with the distinct words of the chunks, not with the tokens.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    name = f"bpe_chunks_{uuid.uuid4().hex}"
    rows.mapInArrow(_chunked(path, buckets), CHUNKS).write.format("parquet").option(
        "path", f"{shared_dir(spark).rstrip('/')}/tables/{name}").bucketBy(buckets, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    lists = chunks.filter("part is not null").select("chunk", "part", "words").repartitionById(buckets, F.pmod("part", F.lit(buckets))).sortWithinPartitions("part")
    ids = lists.mapInArrow(_encoded(path), "home long, number int, lengths binary, ids binary")

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        return _joined_back(left, right)

    return chunks.select("chunk", "part", "doc_ids", "sizes", "codes").groupBy("chunk").cogroup(ids.groupBy("home")).applyInArrow(
        join_back, "doc_id long, ids array<int>")


def joined_symbols(lists: pa.Array, symbols: pa.Array) -> pa.Array:
    """For each list of ids, the symbols of its ids joined by one space."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = symbols.take(lists.flatten())
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), " ")


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """`encoded` with a column `out`: the pieces of the ids joined by one space, as the library decodes without a decoder.

    A join with the id-to-piece table, which has one row an id of the vocabulary and is therefore broadcast and looked
    up by position. Null ids give an empty text; a column named `out` is replaced.
    """
    pieces = encoded.sparkSession.sparkContext.broadcast(tokenizer(path).pieces())

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        symbols = pa.array(pieces.value, pa.string())
        return pa.concat_arrays([joined_symbols(lists.slice(at, DECODED), symbols) for at in range(0, len(lists), DECODED)] or [pa.array([], pa.string())])

    return encoded.withColumn(out, decoded(F.col(f"`{ids}`")))


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids), as `decode` decodes them; few rows at a time."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer(path).pieces())

    def hashed(lists: pa.Array, symbols: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in joined_symbols(lists, symbols)], pa.string())

    def run(parts):
        pieces, numbers = pa.array(shared.value, pa.string()), pa.array(map(str, range(len(shared.value))), pa.string())
        for part in parts:
            for at in range(0, part.num_rows, DECODED):
                some = part.slice(at, DECODED)
                lists = some.column("ids")
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists.value_lengths().fill_null(0).cast(pa.int64()), hashed(lists, numbers), hashed(lists, pieces)],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
