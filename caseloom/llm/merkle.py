"""A Merkle manifest of a document table, and the climb that shows which rows were tampered with.

Every row is a leaf; runs of eight neighbours become the digest of their digests, level by level, first inside each
language, then over the languages' subroots. The built levels are stored as rows that know their parent. A recursive
Spark query then climbs from all leaves at once: each step joins the parent, appends the siblings to the proof and folds
the (possibly tampered) digest with them. The eight leaves of a run share everything above them, so they climb in one
row that carries eight folds and one proof.

A digest is kept as its 32 bytes. H takes the hex text of its inputs, and the hex of joined bytes is the joined hex, so
runs and proofs are binary columns and hex is made only inside the hash.

At scale: only ids and digests move, never texts. Positions come from range-local windows, so a language may hold any
share of the rows. Nodes above `BLOCK` leaves are stored once for each block under them, so that the climb joins at most
`BLOCK` / `FAN` rows to a key, up to the root itself.

Defined results: null columns count as `-`; a null doc_id sorts first, is not tampered with and keeps its row; a null
language is a tree of its own, the first; repeated rows are leaves of their own, side by side; an empty table gives an
empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import row_numbers
from ..session import written_table

FAN = 8
BLOCK = FAN ** 4  # leaves of a block; nodes above are repeated for each
BLOCK_LEVEL = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS = "spark.sql.cteRecursionRowLimit"

CLIMB = """
with recursive climb as (
  select t, run, block, 1 as level, parent, slot, folds, cast('' as binary) as proof from {starts}
  union all
  select c.t, c.run, c.block, n.level, n.parent, n.slot,
         transform(c.folds, f -> unhex(sha2(lower(hex(concat(
           substring(n.children, 1, 32 * c.slot), f, substring(n.children, 32 * c.slot + 33)))), 256))),
         concat(c.proof, substring(n.children, 1, 32 * c.slot), substring(n.children, 32 * c.slot + 33))
  from climb c join {nodes} n on n.t = c.t and n.block = c.block and n.level = c.level + 1 and n.pos = c.parent)
select t, run, folds, proof from climb where parent is null"""


def hashed(parts: Column) -> Column:
    """H of the digests that are joined in a binary column, as bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row: each field as byte count, colon and value, `-` if null."""
    parts = [columns[c].cast("string") for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256))


def lower_cased(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, lang, leaf, other (the tampered digest, null if not tampered with) and a number that tells equal rows apart."""
    own = {c: F.col(f"`{c}`") for c in FIELDS}
    other = F.when(tampered, leaf({**own, "text": lower_cased(own["text"])}))
    out = docs.select(own["doc_id"], own["lang"].cast("string").alias("lang"), leaf(own).alias("leaf"), other.alias("other"))
    return written_table(out.withColumn("rid", F.monotonically_increasing_id()), "merkle-leaves")


def _runs(rows: DataFrame) -> DataFrame:
    """Rows (t, pos, n, digest) by runs: t, pos of the run, n (nodes of its level), children."""
    run = F.floor(F.col("pos") / FAN).cast("long")
    listed = F.sort_array(F.collect_list(F.struct("pos", "digest")))
    return rows.groupBy("t", run.alias("pos"), F.ceil(F.col("n") / FAN).cast("long").alias("n")).agg(
        F.array_join(F.transform(listed, lambda x: F.hex(x["digest"])), "").alias("joined")).select(
        "t", "pos", "n", F.unhex("joined").alias("children"))


def _levels(rows: DataFrame, name: str) -> list[DataFrame]:
    """All levels above `rows`, the first at index 0; each written before the next is built on it."""
    levels = []
    while True:
        rows = rows.filter("n > 1")
        if not rows.head(1):
            return levels
        rows = written_table(_runs(rows).withColumn("digest", hashed(F.col("children"))), f"merkle-{name}-{len(levels) + 1}")
        levels.append(rows)


def _tops(leaves: DataFrame, levels: list[DataFrame], one: str) -> DataFrame:
    """What remains of each tree: t, digest, height."""
    found = leaves.filter("n = 1").select("t", F.col(one).alias("digest"), F.lit(0).alias("height"))
    for i, level in enumerate(levels):
        found = found.unionByName(level.filter("n = 1").select("t", "digest", F.lit(i + 1).alias("height")))
    return found


def _stored(levels: list[DataFrame], tops: list[DataFrame], trees: DataFrame, many: bool) -> DataFrame:
    """Node rows (t, block, level, pos, children, parent, slot); `parent` is the position one level up, null at the root.

    Levels go on above a language's subroot: its parents are the nodes over the languages.
    """
    spans = trees.withColumn("blocks", F.ceil(F.col("leaves") / BLOCK).cast("long"))
    nodes = None
    for level, rows in enumerate(levels, 1):
        rows = rows.join(trees.select("t", "height"), "t") if many else rows.withColumn("height", F.lit(len(levels)))
        up = F.col("height") > level
        rows = rows.select(
            "t", F.lit(level).alias("level"), "pos", "children",
            F.when(up, F.floor(F.col("pos") / FAN)).when(F.lit(many), F.floor(F.col("t") / FAN)).cast("long").alias("parent"),
            F.when(up, F.col("pos") % FAN).otherwise(F.col("t") % FAN).cast("int").alias("slot"))
        if level <= BLOCK_LEVEL:
            rows = rows.withColumn("block", F.floor(F.col("pos") / FAN ** (BLOCK_LEVEL - level)).cast("long"))
        else:
            wide = FAN ** (level - BLOCK_LEVEL)
            last = F.least(F.col("blocks"), (F.col("pos") + 1) * wide) - 1
            rows = rows.join(spans.select("t", "blocks"), "t").withColumn("block", F.explode(F.sequence(F.col("pos") * wide, last))).drop("blocks")
        nodes = rows if nodes is None else nodes.unionByName(rows)
    below = spans.select("t", F.greatest("height", F.lit(1)).alias("height"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    for level, rows in enumerate(tops, 1):
        over = below.withColumn("pos", F.floor(F.col("t") / FAN ** level).cast("long"))
        last = level == len(tops)
        rows = over.join(rows.select("pos", "children"), "pos").select(
            "t", (F.col("height") + level).alias("level"), "pos", "children",
            F.lit(None if last else 0).cast("long").alias("parent") if last else F.floor(F.col("pos") / FAN).cast("long").alias("parent"),
            (F.col("pos") % FAN).cast("int").alias("slot"), "block")
        nodes = rows if nodes is None else nodes.unionByName(rows)
    return nodes


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of `docs`.

    `tampered` marks the rows whose text is lower-cased (A-Z) before the climb; null counts as not tampered with.
    """
    spark = docs.sparkSession
    leaves = row_numbers(_leaves(docs, tampered), ["lang"], [F.col("doc_id"), F.col("leaf"), F.col("rid")], "pos")
    leaves = written_table(leaves.select("lang", "doc_id", "leaf", "other", "pos"), "merkle-rows")
    names = leaves.groupBy("lang").agg(F.count("*").alias("leaves"))
    trees = written_table(row_numbers(names, [], [F.col("lang")], "t"), "merkle-trees")
    count = trees.count()
    same = leaves["lang"].eqNullSafe(trees["lang"])
    placed = leaves.join(trees, same).select("t", F.col("leaves").alias("n"), "pos", "doc_id", "leaf", "other")
    levels = _levels(placed.withColumn("digest", F.col("leaf")), "level")
    subroots = written_table(_tops(placed, levels, "leaf"), "merkle-subroots")
    trees = trees.join(subroots, "t")
    top_rows = subroots.select(F.lit(-1).cast("long").alias("t"), F.col("t").alias("pos"), F.lit(count).cast("long").alias("n"), "digest")
    tops = _levels(top_rows, "top")
    found = (tops[-1] if tops else subroots).select("digest").head()
    root = F.lit(bytes(found["digest"]) if found else None).cast("binary")

    many = count > 1
    nodes = _stored(levels, tops, trees, many) if levels or tops else None
    members = F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", F.coalesce("other", "leaf").alias("fold"))))
    runs = placed.groupBy("t", F.floor(F.col("pos") / FAN).cast("long").alias("run"), F.col("n").alias("leaves")).agg(members.alias("members"))
    joined = F.unhex(F.array_join(F.transform("members", lambda x: F.hex(x["leaf"])), ""))
    runs = written_table(runs.withColumn("children", joined), "merkle-runs")

    # The first step is folded here, where the run is at hand; a lone leaf is its own subroot.
    height = F.col("height")
    up, lone = height > 1, F.col("leaves") == 1
    folds = F.transform("members", lambda x, i: hashed(F.concat(
        F.substring("children", F.lit(1), i * 32), x["fold"], F.substring("children", i * 32 + 33, F.lit(32 * FAN)))))
    starts = runs.join(trees.select("t", "height"), "t").select(
        "t", "run", F.floor(F.col("run") * FAN / BLOCK).cast("long").alias("block"),
        F.when(up, F.floor(F.col("run") / FAN)).when(F.lit(many), F.floor(F.col("t") / FAN)).cast("long").alias("parent"),
        F.when(up, F.col("run") % FAN).otherwise(F.col("t") % FAN).cast("int").alias("slot"),
        F.when(lone, F.transform("members", lambda x: x["fold"])).otherwise(folds).alias("folds"))
    climbed = _climbed(spark, starts, nodes)

    one = F.explode(F.transform("members", lambda x, i: F.struct(x["doc_id"], x["leaf"], i.alias("at"))))
    rest = F.concat(F.substring("children", F.lit(1), F.col("at") * 32), F.substring("children", F.col("at") * 32 + 33, F.lit(32 * FAN)), "proof")
    out = runs.join(climbed, ["t", "run"]).select("t", "children", "folds", "proof", one.alias("m")).select(
        "t", "children", "proof", "m.*", F.get("folds", F.col("m.at")).alias("folded"))
    out = out.join(subroots.select("t", F.col("digest").alias("top")), "t")
    text = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", text("leaf").alias("leaf"), text("top").alias("subroot"), text(root).alias("root"),
                      F.sha2(text(rest), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def _climbed(spark, starts: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """The recursive query, run to its end. Its limit on rows is lifted meanwhile: it would stop large tables."""
    if nodes is None:
        return starts.select("t", "run", "folds", F.lit(b"").alias("proof"))
    nodes = written_table(nodes, "merkle-nodes")
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "-1")
    try:
        return written_table(spark.sql(CLIMB, starts=starts, nodes=nodes), "merkle-climb")
    finally:
        spark.conf.set(ROWS, before)
