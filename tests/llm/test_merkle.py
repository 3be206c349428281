import hashlib
import zlib

from caseloom.llm import merkle
from caseloom.llm.queries import remainder
from pyspark.sql import functions as F


def doc(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), "k", 1, 2, 3)



def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    """Root of a list of digests, and for each the siblings on its way up as (left, right) lists."""
    paths = [[] for _ in digests]
    at, now = list(range(len(digests))), digests
    while len(now) > 1:
        for i, k in enumerate(at):
            first = k // 8 * 8
            paths[i].append((now[first:k], now[k + 1:first + 8]))
        at, now = [k // 8 for k in at], [H(*now[i:i + 8]) for i in range(0, len(now), 8)]
    return now[0], paths


def brute(rows):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = []
    for lang in langs:
        own = [(r, leaf_of(r, r["text"])) for r in rows if r["lang"] == lang]
        own.sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        groups.append((own, *tree([x for _, x in own])))
    root, tops = tree([g[1] for g in groups]) if groups else (None, [])
    out = []
    for (own, subroot, paths), top in zip(groups, tops, strict=True):
        for (r, leaf), path in zip(own, paths, strict=True):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            fold = leaf_of(r, None if r["text"] is None else r["text"].translate(lower)) if bad else leaf
            for left, right in path + top:
                fold = H(*left, fold, *right)
            proof = H(*[x for left, right in path + top for x in left + right])
            out.append((r["doc_id"], leaf, subroot, root, proof, fold, fold == root))
    return out


def manifest(df):
    return [tuple(r) for r in merkle.manifest(df, remainder(3) == 0).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def check(df):
    want, got = brute(df.collect()), manifest(df)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_awkward_rows(docs):
    got = check(docs)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_all_shapes_of_trees(spark, none):
    # 1, 7, 8, 9, 64, 65 and 700 leaves a language, nine further lone languages: two levels over the languages
    sizes = {None: 3, "": 1, "a": 7, "b": 8, "c": 9, "d": 64, "é": 65, "z": 700, **{f"y{i}": 1 for i in range(9)}}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append(doc(i * 7 % 1009, f"Text {i} É" if i % 5 else None, lang))
            i += 1
    check(spark.createDataFrame(rows, none.schema).repartition(5))


def test_levels_above_a_block(spark, none, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 8)
    monkeypatch.setattr(merkle, "BLOCK_LEVEL", 1)
    check(spark.createDataFrame([doc(i, f"Word {i}", "de" if i % 3 else "en") for i in range(1200)], none.schema))


def test_one_language_one_row_and_none(spark, none):
    check(spark.createDataFrame([doc(i, f"A{i}") for i in range(20)], none.schema))
    check(spark.createDataFrame([doc(2, "Only")], none.schema))
    assert manifest(none) == []


def test_untampered_table_verifies(docs):
    assert all(r["verified"] for r in merkle.manifest(docs, F.lit(False)).collect())


def test_row_limit_is_put_back(spark, docs):
    before = spark.conf.get(merkle.ROWS)
    manifest(docs)
    assert spark.conf.get(merkle.ROWS) == before


def test_equals_sql(spark):
    import duckdb

    from caseloom.llm import queries, sql

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(sql.SQL["op11_merkle_climb"])
    columns = [d[0] for d in cur.description]
    got = queries.QUERIES["op11_merkle_climb"](spark, sf).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(cur.fetchall())
