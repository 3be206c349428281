"""The chosen-path join, components and the pipeline's stages against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseloom.llm import chosenpath, queries, sql, toxicity
from caseloom.llm.graph import components
from check import norm


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, num, den):
    """Rows (doc_id, text) with the number of shingles and the smallest id they can reach."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        ids = least.setdefault(find(i), [])
        if doc is not None:
            ids.append(doc)
    return [(doc, len(sets[i]), min(least[find(i)], default=None)) for i, (doc, _) in enumerate(rows)]


def family(r, n, base, edits):
    """Copies of a text with some words changed."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = [r.choice(vocabulary) for _ in range(30)]
    texts = []
    for n, edits in ((40, 3), (25, 8), (12, 2), (5, 1), (2, 1)):
        texts += family(r, n, [r.choice(vocabulary) for _ in range(150)], edits)
    texts += [" ".join([r.choice(vocabulary) for _ in range(60)] + common) for _ in range(40)]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 6))) for _ in range(20)] + ["a b", "A  b", "a", "", None, " \n"]
    r.shuffle(texts)
    return list(enumerate(texts))


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("size,num", [(3, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, size, num):
    rows = corpus(size)
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, num=num)
    assert result(got) == sorted(brute(rows, size, num, 100), key=str)


def test_large_nodes_branch_and_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosenpath, "LEAF", 8)
    monkeypatch.setattr(chosenpath, "DEPTH", 2)
    rows = corpus(9)
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, num=85)
    assert result(got) == sorted(brute(rows, 3, 85, 100), key=str)


def test_awkward_rows(docs, none):
    got = chosenpath.near_duplicates(docs, size=3, num=85)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 3, 85, 100)
    assert result(got) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())
    assert chosenpath.near_duplicates(none).count() == 0


def test_one_row_of_each_component_stays(docs, none):
    kept = chosenpath.keep_one(docs, size=3, num=85)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 3, 85, 100)
    empty = Counter(row for row, w in zip(rows, want, strict=True) if not w[1])
    ids = Counter(w[2] for w in want if w[1])
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(got.values()) == sum(empty.values()) + len(ids)
    assert all(got[row] == n for row, n in empty.items())
    assert chosenpath.keep_one(none).count() == 0


def test_sketches_estimate_similarity():
    r = random.Random(1)
    import numpy as np

    a = np.unique(np.array([r.getrandbits(64) for _ in range(1000)], np.uint64))
    b = np.unique(np.concatenate([a[:900], np.array([r.getrandbits(64) for _ in range(100)], np.uint64)]))
    s = chosenpath.sketches([a, b, a])
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - 900 / 1100) < 0.12


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", list(sql.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = con.execute(sql.SQL[name])
    got = [d[0] for d in cursor.description]
    order = [got.index(c) for c in columns]
    assert sorted(got) == columns
    assert sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(norm(r[i]) for i in order) for r in cursor.fetchall()), key=repr)


# ---- pipeline -----------------------------------------------------------------------------------


def test_stages_on_awkward_rows(spark, docs, tmp_path):
    """Every stage takes what the one before has kept and hands on the columns of documents."""
    spark.createDataFrame([(i, 1, i % 2) for i in range(9, 20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(now.count())
        if name != "packing":
            assert now.columns == docs.columns
        if name == "language":
            assert all(any(c.isalpha() for c in r.text) for r in now.collect())
        if name == "line_dedup":
            assert now.count() == before.count() and all(r.n_chars == len(r.text) for r in now.collect())
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert now.count() == len({w[2] if w[1] else (i,) for i, w in enumerate(brute(rows, 5, 80, 100))})
        if name == "packing":
            assert {r.doc_id for r in now.collect()} == {r.doc_id for r in before.collect()}
    assert counts[1] <= counts[0]


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.clean(spark, docs, sf).select("doc_id").collect()}
    model = toxicity.fit(queries.table(spark, sf, "labels").filter(queries.remainder(5) != 0).select("doc_id", F.col("toxic").alias("label")), docs)
    want = {r.doc_id for r in docs.select("doc_id", toxicity.scored(model, docs).alias("s")).collect() if r.s < 0.5}
    assert kept == want
    clean = {r.doc_id for r in queries.table(spark, sf, "labels").filter("toxic = 0").collect()}
    assert len(clean & kept) > 0.97 * len(clean)


def test_language_stage_keeps_all_prose(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.spoken(spark, docs, sf).count() >= 0.99 * docs.count()


FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i "
          "powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän "
          "on toimittava toisiaan kohtaan veljeyden hengessä.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。"}


def test_language_stage_rejects_noise_and_unlearned_languages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    r = random.Random(1)
    odd = [(f"{name}{k}", " ".join([text] * k)) for name, text in FOREIGN.items() for k in (1, 5)]
    odd += [(f"symbols{i}", "".join(chr(r.choice([r.randint(33, 126), r.randint(160, 591), r.randint(0x2190, 0x23ff)])) for _ in range(300))) for i in range(40)]
    odd += [(f"letters{i}", "".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(400))) for i in range(40)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = spark.createDataFrame([(10_000_000 + i, text) for i, (_, text) in enumerate(odd)], "doc_id long, text string").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "text")
    out = corpus_pipeline.spoken(spark, docs.unionByName(more, True), sf)
    assert out.columns == docs.columns
    assert out.filter("doc_id >= 10000000").count() == 0
    assert out.count() >= 0.995 * docs.count()


def test_stages_on_empty_tables_and_empty_texts(spark, none, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "\n"), (4, "one word")], "doc_id long, text string")
    blank = blank.unionByName(none.limit(0), True).select(none.columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
        kept = {row.doc_id for row in stage(spark, blank, str(tmp_path)).collect()}
        assert kept == ({4} if name == "language" else {1, 2, 3, 4}), name


@pytest.mark.parametrize("s", [0.8, 0.85])
def test_sketches_rule_out_no_pair_at_the_threshold(s):
    """The binomial tail of the equal tokens below which a pair is ruled out: the trees share the sketch, so it counts once."""
    n = chosenpath.SKETCH
    few = range(math.ceil(n * (s - chosenpath.MARGIN)))
    assert sum(math.comb(n, k) * s ** k * (1 - s) ** (n - k) for k in few) < 1e-7
