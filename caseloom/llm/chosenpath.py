"""Near-duplicate components by a chosen-path set similarity join.

A document is its set of distinct word shingles; equal sets are one class, with a sketch of minwise tokens. A tree sends
each class from a node to the children named by selected minwise tokens: one token at the root, `BRANCH` tokens further
down, selected by a hash of the node. A pair of similarity s keeps a token with probability s, so it meets again in some
child. Nodes of at most `LEAF` classes are compared exhaustively; larger ones branch on, and those left at `DEPTH` are
compared block by block. `TREES` independent trees bring the chance of missing a pair at 0.85 below 1e-6.

No pairs of a group of copies leave a task. First every class is compared with the smallest class of its root nodes,
which joins many. Then only nodes that hold more than one component go on. Their sketches tell which classes may be
linked with another component, and only those come back with their full sets. In a node, pairs of components not yet
joined are then confirmed on the full sets, likeliest first, and a node hands on at most one link a class. Sketches only
rule pairs out, with a margin of 0.20: for a pair at exactly 0.85 the chance of that is 1.4e-8, at 0.80 7.6e-8.

Sets and shingles go by 64-bit hashes: two of n different sets share one with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import partitions, written_table
from .graph import components
from .hashing import mix, release, seeded, shingle_hashes, word_hashes

TREES, DEPTH, BRANCH, LEAF = 10, 6, 2, 4096
SKETCH = 128
MARGIN = 0.20
TESTED = 32  # pairs confirmed at a time
ROWS = 128  # documents sketched at a time, to stay in the cache

_XOR = (seeded(SKETCH, 11) >> np.uint64(32)).astype(np.uint32)
_ODD = (seeded(SKETCH, 12) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def row_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each row; all words as one shingle where there are fewer than `size`."""
    words, offsets = word_hashes(column)
    shingles = shingle_hashes(words, size, seeded(size, 7) | np.uint64(1))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(shingles[a:b - size + 1]))
        else:
            out.append(shingle_hashes(words[a:b], b - a, seeded(b - a, 8 + b - a) | np.uint64(1)) if b > a else words[:0])
    return out


def set_id(values: np.ndarray) -> int:
    """The class id of a set: a signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH minwise tokens of each non-empty set."""
    out = np.empty((len(sets), SKETCH), np.uint32)
    for at in range(0, len(sets), ROWS):
        part = sets[at:at + ROWS]
        values = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, part[:-1])])
        held = np.empty_like(values)
        for j in range(SKETCH):
            np.bitwise_xor(values, _XOR[j], out=held)
            np.multiply(held, _ODD[j], out=held)
            out[at:at + ROWS, j] = np.minimum.reduceat(held, starts)
    return out


def _signatures(size: int):
    def run(parts):
        for part in parts:
            for at in range(0, part.num_rows, 2000):
                ids, texts = part.column(0).slice(at, 2000), part.column(1).slice(at, 2000)
                sets = row_sets(texts, size)
                full = [s for s in sets if len(s)]
                rows = iter(sketches(full).view(np.uint8).reshape(len(full), -1)) if full else iter(())
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "cid", "n", "sketch"])
        release()

    return run


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), SKETCH)


def _child(node: np.ndarray, position: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(node ^ mix(position.astype(np.uint64) << np.uint64(32) | token.astype(np.uint64)))


def _roots(parts):
    """Each class under one token a tree."""
    seeds = seeded(TREES, 21)
    for part in parts:
        sketch = _sketch_rows(part.column("sketch"))
        n = len(sketch)
        for tree in range(TREES):
            position = np.full(n, tree * SKETCH // TREES)
            key = _child(np.full(n, seeds[tree]), position, sketch[np.arange(n), position])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column("cid"), part.column("comp")], ["key", "cid", "comp"])


def _branches(parts):
    """Each member of a node under the node's selected tokens."""
    for part in parts:
        sketch = _sketch_rows(part.column("sketch"))
        node = part.column("key").to_numpy().view(np.uint64)
        for j in range(BRANCH):
            position = (mix(node + np.uint64(j + 1)) % np.uint64(SKETCH)).astype(np.int64)
            key = _child(node, position, sketch[np.arange(len(node)), position])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column("cid"), part.column("comp")], ["key", "cid", "comp"])


def _objects(values: list) -> np.ndarray:
    """An array with one element a value, whatever the values are."""
    out = np.empty(len(values), object)
    for i, value in enumerate(values):
        out[i] = value
    return out


def _by_node(parts, columns: list[str], work):
    """Calls `work` with the rows of whole nodes, as arrays; rows come sorted by key."""
    held = None
    for part in parts:
        now = [part.column(c).to_numpy() for c in ("key", "cid", "comp", "n")] + [_sketch_rows(part.column("sketch"))]
        now += [_objects([x.as_buffer() for x in part.column(c)]) for c in columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))  # the last node may go on in the next batch
        if last:
            yield work(*[x[:last] for x in now])
        held = [x[last:] for x in now]
    if held is not None:
        yield work(*held)


def _node_bounds(key: np.ndarray) -> list[tuple[int, int]]:
    cuts = (np.flatnonzero(np.diff(key)) + 1).tolist()
    return [(a, b) for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True) if b - a > 1]


def _active(least: float, ratio: float):
    """The members of each node whose sketches and sizes allow a link with another component."""
    def work(key, cid, comp, n, sketch):
        found = np.zeros(len(key), bool)
        for a, b in _node_bounds(key):
            s, size, c, own = sketch[a:b], n[a:b], comp[a:b], found[a:b]
            for i in range(b - a - 1):
                other = np.flatnonzero((c[i + 1:] != c[i]) & (np.minimum(size[i + 1:], size[i]) >= ratio * np.maximum(size[i + 1:], size[i]))) + i + 1
                near = other[(s[other] == s[i]).sum(1) >= least * SKETCH] if len(other) else other
                if len(near):
                    own[i] = True
                    own[near] = True
        return pa.RecordBatch.from_arrays([pa.array(x[found], pa.int64()) for x in (key, cid, comp)], ["key", "cid", "comp"])

    return lambda parts: _by_node(parts, [], work)


def _confirmed(least: float, num: int, den: int):
    """Links that join the components of each node, confirmed on the full sets, at most one less than its members."""
    def work(key, cid, comp, n, sketch, shingles):
        left, right = [], []
        for a, b in _node_bounds(key):
            _, root = np.unique(comp[a:b], return_inverse=True)
            s, size, sets = sketch[a:b], n[a:b], [np.frombuffer(x, np.uint64) for x in shingles[a:b]]
            for i in range(b - a - 1):
                other = np.flatnonzero((root[i + 1:] != root[i]) & (den * np.minimum(size[i + 1:], size[i]) >= num * np.maximum(size[i + 1:], size[i]))) + i + 1
                if not len(other):
                    continue
                alike = (s[other] == s[i]).sum(1)
                other = other[alike >= least * SKETCH][np.argsort(-alike[alike >= least * SKETCH], kind="stable")]
                while len(other):
                    some, other = other[:TESTED], other[TESTED:]
                    some = some[root[some] != root[i]]
                    if not len(some):
                        continue
                    both = _shared(sets[i], [sets[j] for j in some])
                    for j, k in zip(some.tolist(), both.tolist(), strict=True):
                        if root[j] != root[i] and den * k >= num * (size[i] + size[j] - k):
                            left.append(int(cid[a + i]))
                            right.append(int(cid[a + j]))
                            root[root == root[j]] = root[i]
                    other = other[root[other] != root[i]]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return lambda parts: _by_node(parts, ["shingles"], work)


def _shared(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """How many values a sorted set shares with each of many."""
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum([0, *[len(x) for x in many[:-1]]]))


def _sets(size: int):
    def run(parts):
        for part in parts:
            for at in range(0, part.num_rows, 500):
                sets = row_sets(part.column(1).slice(at, 500), size)
                wanted = part.column(0).slice(at, 500).to_pylist()
                found = [(c, s.tobytes()) for c, s in zip(wanted, sets, strict=True) if len(s) and set_id(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["cid", "shingles"])

    return run


def _linked(num: int, den: int):
    def run(parts):
        for part in parts:
            left, right = [], []
            for a, b, x, y in zip(*[part.column(c) for c in ("a", "b", "sa", "sb")], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                short, long = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(long, short)
                both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                if den * both >= num * (len(x) + len(y) - both):
                    left.append(a.as_py())
                    right.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


class Join:
    """One run of the join over the documents `docs` (doc_id, text)."""

    def __init__(self, docs: DataFrame, size: int, num: int, den: int):
        self.docs, self.size, self.num, self.den = docs, size, num, den
        self.parts = partitions(docs.sparkSession)
        self.least = num / den - MARGIN
        self.signatures = written_table(docs.mapInArrow(_signatures(size), "doc_id long, cid long, n long, sketch binary"), "signatures")
        self.classes = written_table(self.signatures.filter("cid is not null").groupBy("cid").agg(
            F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    def nodes(self, classes: DataFrame) -> DataFrame:
        """The root nodes of all trees (key, cid, comp); `classes` has the comp of each class."""
        return written_table(classes.select("cid", "comp", "sketch").mapInArrow(_roots, "key long, cid long, comp long"), "nodes")

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches and sizes allow a link."""
        c, a, b = self.classes, F.col("sa"), F.col("sb")
        least, ratio = self.least, self.num / self.den

        @F.arrow_udf("boolean")
        def close(x: pa.Array, y: pa.Array) -> pa.Array:
            return pa.array((_sketch_rows(x) == _sketch_rows(y)).mean(1) >= least)

        sides = pairs.join(c.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        sides = sides.join(c.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        return sides.filter(F.least("na", "nb") >= ratio * F.greatest("na", "nb")).filter(close(a, b)).select("a", "b")

    def sets(self, cids: DataFrame) -> DataFrame:
        """(cid, shingles): the full sets of the classes `cids` (distinct), made again from one text of each."""
        need = cids.join(self.classes.select("cid", "doc_id"), "cid")
        docs = self.docs.select("doc_id", "text")
        texts = docs.join(need.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(need["doc_id"])).select("cid", "text")
        return written_table(texts.mapInArrow(_sets(self.size), "cid long, shingles binary").dropDuplicates(["cid"]), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links, confirmed on the full sets."""
        pairs = written_table(pairs.distinct(), "pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        sides = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
        sides = sides.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
        return written_table(sides.mapInArrow(_linked(self.num, self.den), "a long, b long"), "links")

    def first_pairs(self, nodes: DataFrame) -> DataFrame:
        """Each class with the smallest class of its root nodes."""
        least = nodes.groupBy("key").agg(F.min("cid").alias("b"), F.count("*").alias("m")).filter("m > 1").select("key", "b")
        return nodes.join(least, "key").filter("cid <> b").select(F.col("cid").alias("a"), "b").distinct()

    def grouped(self, members: DataFrame, *more: DataFrame) -> DataFrame:
        """The members of nodes with their sketches and what `more` has of them, nodes whole and in order."""
        rows = members.join(self.classes.select("cid", "n", "sketch"), "cid")
        for table in more:
            rows = rows.join(table, "cid")
        return rows.repartition(self.parts, "key").sortWithinPartitions("key")

    def active(self, members: DataFrame) -> DataFrame:
        """The members of small nodes (key, cid, comp) that may be linked with another component of theirs."""
        rows = self.grouped(members).select("key", "cid", "comp", "n", "sketch")
        return rows.mapInArrow(_active(self.least, self.num / self.den), "key long, cid long, comp long")

    def tree_links(self, members: DataFrame) -> DataFrame:
        """Links between components from all trees, level by level; `members` are the root nodes."""
        found = None
        for depth in range(1, DEPTH + 1):
            sizes = members.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"))
            contested = written_table(members.join(sizes.filter("low <> high").select("key", "m"), "key"), "contested")
            large = contested.filter(F.col("m") > LEAF)
            last = depth == DEPTH or large.isEmpty()
            small = contested.filter(F.col("m") <= LEAF).select("key", "cid", "comp")
            if depth == DEPTH:
                small = small.unionByName(blocks(large))
            active = written_table(self.active(small), "active")
            found = active if found is None else found.unionByName(active)
            if last:
                break
            rows = large.join(self.classes.select("cid", "sketch"), "cid")
            members = written_table(rows.mapInArrow(_branches, "key long, cid long, comp long").distinct(), "nodes")
        sets = self.sets(found.select("cid").distinct())
        rows = self.grouped(found, sets).select("key", "cid", "comp", "n", "sketch", "shingles")
        return written_table(rows.mapInArrow(_confirmed(self.least, self.num, self.den), "a long, b long").distinct(), "links")

    def roots(self) -> DataFrame:
        """(node, root) of all classes that are linked with another."""
        alone = self.classes.withColumn("comp", F.col("cid"))
        links = self.links(self.near(self.first_pairs(self.nodes(alone))))
        # Components so far, as far as two steps tell: a class goes with the smallest it is linked to, and that one's.
        step = links.groupBy("a").agg(F.min("b").alias("b"))
        far = step.join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select(F.col("a").alias("cid"), F.least("b", "c").alias("comp"))
        named = self.classes.join(far, "cid", "left").select("cid", "sketch", F.coalesce("comp", "cid").alias("comp"))
        more = self.tree_links(self.nodes(named))
        return written_table(components(links.unionByName(more)), "roots")


def blocks(large: DataFrame) -> DataFrame:
    """Nodes too large to compare at once, as all pairs of their blocks of about LEAF / 2 members."""
    n = F.ceil(F.col("m") * 2 / LEAF).cast("int")
    own = F.pmod(F.xxhash64("cid"), n).cast("int")
    dealt = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "cid", "comp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, cid) of every row: components of the links den * |A & B| >= num * |A | B|.

    component_id is the smallest doc_id of the component, kept tells whether it is the row's own. A null or empty text
    or one without words has no shingles and is linked with nothing: its component is itself. Null ids are passed over
    when the smallest id is taken; a component of null ids only has a null id, and its rows count as kept. Repeated rows
    are in one component. cid is the class of equal shingle sets, null for none.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    join = Join(docs, size, num, den)
    rows = join.signatures.select("doc_id", "cid", "n")
    # Ids go up class by class, so that no component meets in one task.
    roots = join.classes.select("cid", "doc_id").join(join.roots(), F.col("cid") == F.col("node"), "left").select(
        "cid", "doc_id", F.coalesce("root", "cid").alias("root"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.select("cid", "root").join(least, "root").select("cid", "component_id")
    out = rows.join(named, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "cid")


def class_id(text, size: int):
    """The class of a text column's shingle sets; null for a text without words."""
    @F.arrow_udf("long")
    def made(column: pa.Array) -> pa.Array:
        return pa.array([set_id(s) if len(s) else None for at in range(0, len(column), 2000) for s in row_sets(column.slice(at, 2000), size)], pa.int64())

    return made(text.cast("string"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with one row of each component of `near_duplicates`: that of the smallest doc_id, null ids last.

    Repeated rows are one component, of which one row stays. Rows without words all stay. Columns are those of `docs`.
    """
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    join = Join(plain, size, num, den)
    roots = join.classes.select("cid", "doc_id").join(join.roots(), F.col("cid") == F.col("node"), "left")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("cid"))
    first = roots.groupBy(F.coalesce("root", "cid").alias("root")).agg(F.min(order).alias("f")).select(F.col("f.cid").alias("own"), F.col("f.doc_id").alias("id"), F.lit(True).alias("kept"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), class_id(F.col(f"`{text}`"), size).alias("cid"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    joined = rows.join(first, (F.col("cid") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").filter("kept or cid is null")
    # Repeated rows meet on the join's keys; rows without words keep apart by a number of their own.
    apart = F.when(F.col("cid").isNull(), F.monotonically_increasing_id()).otherwise(0)
    one = joined.withColumn("apart", apart).dropDuplicates(["cid", "doc_id", "apart"])
    return one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
