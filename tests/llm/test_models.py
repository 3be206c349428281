"""Language ID, toxicity, the language model and page extraction against brute force and held-out rows."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseloom.llm import extract, langid, logbilinear, queries, toxicity

SF = "/root/testdata/sf0.01"


# ---- language ID --------------------------------------------------------------------------------


def brute_grams(text):
    symbols = [c if c.isalpha() else "\n" for c in text.lower()]
    padded = ["\n", *symbols, "\n"]
    out = []
    for i, c in enumerate(symbols):
        if c != "\n":
            a, b = padded[i], padded[i + 2]
            out += [(c,), (a, c), (a, c, b)]
    return Counter(out)


@pytest.mark.parametrize("text", ["", "a", "Éa b1c", "日本 x", "ab " * 50])
def test_ngrams_are_those_of_a_plain_loop(text):
    bucket, owner = langid.ngrams(["zz", text, "q"])
    assert sorted(Counter(bucket[owner == 1].tolist()).values()) == sorted(brute_grams(text).values())


def test_scores_are_naive_bayes():
    rows = [("en", "the cat and the dog"), ("en", "this is it"), ("de", "der hund und die katze")]
    n = {"en": Counter(), "de": Counter()}
    for lang, text in rows:
        n[lang].update(langid.ngrams([text])[0].tolist())
    matrix = np.array([[n[x][b] + langid.SMOOTHING for b in range(langid.BUCKETS)] for x in ("de", "en")])
    model = langid.Model(["de", "en"], np.log(matrix / matrix.sum(1, keepdims=True)), np.log([1 / 3, 2 / 3]))
    names, score = langid.score_texts(model, ["the dog", None, "123 !", "katze"])
    logs = [sum(model.log_probs[j, b] for b in langid.ngrams(["the dog"])[0]) + model.priors[j] for j in (0, 1)]
    assert names == ["en", "und", "und", "de"]
    assert score[0] == pytest.approx(1 / (1 + math.exp(logs[0] - logs[1])), rel=1e-5) and score[1] == score[2] == 0


def test_fit_counts_all_rows(spark, docs, none):
    df = spark.createDataFrame([("a", "xx yy"), ("a", None), ("b", "zz"), (None, "xx")], "lang string, text string").repartition(4)
    model = langid.fit(df)
    want = np.full(langid.BUCKETS, langid.SMOOTHING)
    want += np.bincount(langid.ngrams(["xx yy"])[0], minlength=langid.BUCKETS)
    assert model.languages == ["a", "b"] and np.allclose(model.log_probs[0], np.log(want / want.sum()), atol=1e-5)
    empty = langid.fit(none)
    assert {r.p.lang_pred for r in docs.select(langid.predicted(empty, docs).alias("p")).collect()} == {"und"}
    assert len(docs.select(langid.predicted(model, docs).alias("p")).collect()) == docs.count()


def test_long_texts_count_whole():
    model = langid.Model(["a", "b"], np.log(np.random.default_rng(1).dirichlet(np.ones(langid.BUCKETS), 2)), np.zeros(2))
    text = "some words here " * 100
    whole = langid.score_texts(model, [text])
    before, langid.CHARS = langid.CHARS, 1
    assert langid.score_texts(model, ["x y"])[0] == langid.score_texts(model, ["x y"])[0]
    langid.CHARS = before
    assert whole[1][0] > 0


def test_held_out_language_accuracy(spark):
    got = queries.QUERIES["op7_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    row = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert row[0] > 0.97 and row[1] > 100


# ---- toxicity -----------------------------------------------------------------------------------


def labelled_texts(n, seed):
    r = random.Random(seed)
    stems, plain = ["idiot", "trash", "stupid"], ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        if i % 4 == 0:
            for _ in range(max(1, len(words) // 20)):
                words.insert(r.randint(0, len(words)), r.choice(stems) + r.choice(["", "s", "ic", "y"]))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def test_rows_are_means_of_word_means():
    text = "ab abc ab"
    offsets, bucket, weight = toxicity.rows([text, "", "xyz"])
    assert offsets.tolist()[0] == 0 and offsets[1] == offsets[2] and weight[:offsets[1]].sum() == pytest.approx(1)
    model = toxicity.Model(np.random.default_rng(0).standard_normal(toxicity.BUCKETS).astype(np.float32), 0.25)
    logit = (weight[:offsets[1]] * model.bucket[bucket[:offsets[1]]]).sum() + 0.25
    score = toxicity.score_texts(model, [text, None, "..."])
    assert score[0] == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-5) and score[1] == score[2] == pytest.approx(1 / (1 + math.exp(-0.25)))


def brute_bag(text):
    """Weights of the n-grams of a text, written out: the mean over its words of the mean over a word's n-grams."""
    found, word = [], []
    for c in [*text.lower(), " "]:
        if c.isalnum():
            word.append(ord(c))
        elif word:
            found.append([1, *word, 2])
            word = []
    out = Counter()
    for symbols in found:
        grams = [symbols[i:i + n] for n in (3, 4) for i in range(len(symbols) - n + 1)]
        for gram in grams:
            value = len(gram)
            for x in gram:
                value = (value * 0x100000001B3 + x) % 2 ** 64
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                value = (value ^ value >> shift) * factor % 2 ** 64
            out[(value ^ value >> 31) % toxicity.BUCKETS] += 1 / len(grams) / len(found)
    return out


def test_scores_equal_a_plain_sum(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("abcXYZ\u00e9\u0130\u4e2d7 .-\n") for _ in range(r.randint(0, 300))) for _ in range(60)] + ["", "  ", "a", "A b", "trash " * 9000]
    model = toxicity.Model(np.random.default_rng(2).standard_normal(toxicity.BUCKETS).astype(np.float32), -0.5)
    want = [1 / (1 + math.exp(0.5 - sum(w * float(model.bucket[b]) for b, w in brute_bag(t).items()))) for t in texts]
    for chars in (toxicity.CHARS, 64):
        monkeypatch.setattr(toxicity._parts, "__defaults__", (chars,))
        assert toxicity.score_texts(model, texts) == pytest.approx(want, rel=1e-4)


def test_unseen_spellings_are_caught():
    texts, labels = labelled_texts(1200, 1)
    model = toxicity.train(*toxicity.rows(texts), labels, labels.mean())
    more, want = labelled_texts(400, 2)
    score = toxicity.score_texts(model, more)
    assert score[want == 1].mean() > 0.6 > 0.3 > score[want == 0].mean()
    odd = toxicity.score_texts(model, ["what an idiotic trashhy lot", "an idioot and a stupido"])
    assert odd.min() > 0.5


def traced_peak(call):
    """MB of Python and NumPy memory that a call takes at most beyond what was there."""
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def sparse_rows(n, size, seed=3):
    """Rows of `size` entries over 5,000 buckets, and labels."""
    r = np.random.default_rng(seed)
    return np.arange(n + 1) * size, r.integers(0, 5000, n * size).astype(np.int32) * 200, np.full(n * size, 1 / size, np.float32), np.arange(n) % 3 // 2


def test_the_fit_holds_no_copy_of_its_rows():
    few, many = sparse_rows(200, 500), sparse_rows(2000, 500)
    small, large = (traced_peak(lambda x=x: toxicity.train(*x, 0.3)) for x in (few, many))
    assert small < 64 and large < small + 2, (small, large)


def test_fit_equals_the_rows_of_its_texts(spark):
    texts, labels = labelled_texts(120, 7)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, label int")
    got = toxicity.sample(marks, docs)[1].collect()
    want = toxicity.train(*toxicity.rows([r.text for r in got]), np.array([r.label for r in got]), labels.mean())
    model = toxicity.fit(marks, docs)
    assert np.array_equal(model.bucket, want.bucket) and model.bias == want.bias


def test_one_label_or_none(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (4, None)], "doc_id long, label int")
    model = toxicity.fit(labels, docs)
    assert len({r[0] for r in docs.select(toxicity.scored(model, docs)).collect()}) == 1
    assert toxicity.fit(labels.limit(0), none).bias < 0


def test_sample_is_bounded_and_labels_merge(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 2, 0: 3})
    labels = spark.createDataFrame([(i, i % 2) for i in range(9, 20)] + [(9, 0), (9, 1), (10, 1)], "doc_id long, label int")
    labelled, chosen = toxicity.sample(labels, docs)
    assert labelled.count() == 11 and {r.doc_id: r.label for r in labelled.collect()}[10] == 1
    assert Counter(r.label for r in chosen.collect()) == {1: 2, 0: 3}


# ---- language model -----------------------------------------------------------------------------


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"]


def brute_base(rows):
    c = Counter(t for _, text, train in rows if train for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(i, len(tokens(t)), sum(w in c for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t, _ in rows]


@pytest.mark.parametrize("common", [1 << 18, 5, 0])
def test_base_scores_and_counts(docs, none, monkeypatch, common):
    monkeypatch.setattr(logbilinear, "COMMON", common)
    monkeypatch.setattr(logbilinear, "STEPS", 20)
    rows = [(r.doc_id, r.text, r.doc_id is not None and r.doc_id % 3 > 0) for r in docs.collect()]
    got = logbilinear.scores(docs, F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 != 0).collect()
    key = lambda x: tuple((y is None, y) for y in x)
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key)
    assert have == sorted(((*x[:4], round(x[4], 6)) for x in brute_base(rows)), key=key)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert logbilinear.scores(none, F.lit(False), F.lit(True)).count() == 0


def brute_scores(rows):
    """log10 probabilities of texts, token by token, with the classes and shares written out; the table is `fit`'s."""
    k, first, top = logbilinear.CLASSES, logbilinear.FIRST, logbilinear.TOP
    c = Counter(w for text, train in rows if train for w in tokens(text)[:-1])
    vocabulary = sorted({w for text, _ in rows for w in tokens(text)[:-1]})
    hashes, sign, _ = logbilinear.words(pa.array(vocabulary))
    sign = dict(zip(vocabulary, sign.tolist(), strict=True))
    number = dict(zip(vocabulary, hashes.view(np.int64).tolist(), strict=True))
    ranked = sorted(c, key=lambda w: (-c[w], number[w]))[:top]
    rank = {w: i for i, w in enumerate(ranked)}
    types = Counter(c.values())
    mass = [1 * types[1] + 0.5, (2 * types[2] + 0.5) * (types[1] > 0), (3 * types[3] + 0.5) * (types[2] > 0)]
    shared = [mass[n] / sum(mass) / max(1, types[n] if n else 1) for n in range(3)]
    bucket = Counter()
    for w, n in c.items():
        if n > 2 and w not in rank:
            bucket[sign[w]] += n

    def read(text):
        before, out = (0, 0), []
        for w in tokens(text)[:-1]:
            own = first + rank[w] if w in rank else first + top + sign[w]
            is_rare = c[w] <= 2 and w not in rank
            share = 1 if w in rank else shared[c[w]] if is_rare else c[w] / bucket[sign[w]]
            out.append(((before[0] * k + before[1]) * k + (logbilinear.RARE if is_rare else own), share))
            before = before[1], own
        return [*out, ((before[0] * k + before[1]) * k + 1, 1)]

    seen = Counter(cell for text, train in rows if train for cell, _ in read(text))
    cells = np.array(sorted(seen))
    table = logbilinear.fit(cells, np.array([seen[x] for x in cells.tolist()]))
    return [sum(float(table[cell]) + math.log10(share) for cell, share in read(text)) for text, _ in rows]


@pytest.mark.parametrize("common", [1 << 18, 130])
def test_scores_equal_a_token_by_token_sum(spark, monkeypatch, common):
    monkeypatch.setattr(logbilinear, "COMMON", common)
    monkeypatch.setattr(logbilinear, "STEPS", 30)
    r = random.Random(8)
    usual = [f"{r.choice('abcdeXY')}{i}{r.choice('klm')}" for i in range(140)]
    texts = [" ".join(r.choice(usual) if r.random() < 0.9 else f"q{int(r.expovariate(0.02))}" for _ in range(r.randint(0, 90))) for _ in range(80)]
    rows = [(text, i % 10 > 0) for i, text in enumerate(texts)]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: x.score for x in logbilinear.scores(docs, F.col("doc_id") % 10 == 0, F.col("doc_id") % 10 > 0).collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx(brute_scores(rows), rel=1e-4)


def test_nothing_to_learn_from(docs):
    got = logbilinear.scores(docs, F.lit(True), F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in got)


def test_probabilities_sum_to_one(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("aa bb cc dd ee".split()) if r.random() < 0.7 else f"w{int(r.expovariate(0.01))}" for _ in range(60)) for _ in range(60)]
    counted = Counter(w for t in texts for w in tokens(t))
    n_words = spark.createDataFrame([(t,) for t in texts], "text string").mapInArrow(logbilinear._count, "word long, sign int, n long").groupBy("word", "sign").agg(F.sum("n").alias("c"))
    counts = logbilinear.gather(n_words, len(texts))
    assert counts.total == sum(counted.values()) and counts.kinds == len(counted)
    mass = np.zeros(logbilinear.CLASSES)
    np.add.at(mass, counts.target, 10 ** counts.within)
    mass[logbilinear.RARE] += 10 ** counts.rare[0]  # the slot for unknown words
    mass[logbilinear.END] += 1
    table = logbilinear.fit(np.zeros(0, np.int64), np.zeros(0)).reshape(logbilinear.CLASSES, logbilinear.CLASSES, -1)
    used = mass > 0
    assert np.allclose(mass[used], 1) and np.allclose((10.0 ** table).sum(2), 1, atol=1e-4)


def test_estimation_finds_the_conditional_shares():
    k = logbilinear.CLASSES
    r = np.random.default_rng(1)
    cells = {}
    for w1, row in ((5, {7: 0.8, 8: 0.2}), (6, {7: 0.1, 9: 0.9})):
        for t, p in row.items():
            cells[(3 * k + w1) * k + t] = 1000 * p
    table = logbilinear.fit(np.array(list(cells)), np.array(list(cells.values()), float))
    for cell, n in cells.items():
        assert 10 ** float(table[cell]) == pytest.approx(n / 1000, abs=0.08)
    assert r is not None


def test_ninety_six_words_have_a_class_of_their_own(spark):
    texts = [" ".join(f"w{i}" for i in range(96)) for _ in range(5)]
    n_words = spark.createDataFrame([(t,) for t in texts], "text string").mapInArrow(logbilinear._count, "word long, sign int, n long").groupBy("word", "sign").agg(F.sum("n").alias("c"))
    counts = logbilinear.gather(n_words, len(texts))
    assert len(set(counts.klass.tolist())) == 96 and not counts.within.any() and logbilinear.SIGNS >= 32


def test_every_counted_event_is_learned_from():
    """Twenty events among half a billion: a fixed number of draws would hardly meet them."""
    k, a, b = logbilinear.CLASSES, logbilinear.FIRST, logbilinear.FIRST + 1
    usual, seldom = (a * k + a) * k + a, (b * k + b) * k + b
    table = logbilinear.fit(np.array([usual, seldom]), np.array([5e8, 20.0]))
    assert table[seldom] > np.log10(0.2) and table[usual] > np.log10(0.9)


def test_model_beats_the_base_on_held_out_texts(spark):
    row = queries.QUERIES["op8_log_bilinear"](spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1] * 0.95


# ---- pages --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return extract.train(extract.labelled_pages())


def test_blocks_of_generated_pages_match_their_labels():
    for page, labels in extract.labelled_pages(60, seed=9):
        assert len(extract.blocks(page)) == len(labels)


def test_viterbi_finds_the_best_path(field):
    page = extract.blocks(extract.labelled_pages(1, seed=5)[0][0])[:9]
    scores = [sum(field.state.get(f, np.zeros(2)) for f in fs) for fs in extract.features(page)]
    paths = []
    for bits in range(1 << len(page)):
        y = [bits >> i & 1 for i in range(len(page))]
        paths.append((field.first[y[0]] + sum(s[v] for s, v in zip(scores, y, strict=True)) + sum(field.change[a, b] for a, b in zip(y, y[1:], strict=False)), y))
    assert extract.decode(field, page) == [bool(v) for v in max(paths)[1]]


def test_held_out_pages(field):
    right = total = 0
    for page, labels in extract.labelled_pages(200, seed=123):
        got = extract.decode(field, extract.blocks(page))
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<nav><ul><li><a href=x>Home</a></li></ul></nav><footer>&copy; x</footer>", ""),
    ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>Menu</a></nav><!-- <p>no</p> --><article><h1>A &amp; B&#33;</h1>"
     "<p>One <b>two</b>\n\t three.<br><p>Four&nbsp;five &lt;six&gt;.<ul><li>seven<li>eight</ul></article><aside class='sidebar'><p>Related words.</p></aside>"
     "<section id=comments><h3>Comments</h3><p>Nice words from a reader, really.</p></section><footer>&copy; 2020 site</footer></body></html>",
     "A & B!\n\nOne two three.\n\nFour five <six>.\n\nseven\n\neight")])
def test_main_text(field, page, text):
    assert extract.main_text(field, page) == text


def test_pages_table(spark, field):
    df = spark.createDataFrame([(1, "u", None, 5), (None, None, "<article><p>Some words here.</p></article>", 6), (2, "u", "", 7), (2, "u", "", 7)], "page_id long, url string, html string, text int")
    got = extract.main_texts(df, field=field).collect()
    assert sorted(r.text for r in got) == ["", "", "", "Some words here."]
    assert extract.main_texts(df.limit(0), field=field).count() == 0


def test_given_pages_keep_the_article(spark):
    """On the given pages the article is an element of its own, so a plain cut of it must agree."""
    import html

    def plain(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        cut = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        return "\n\n".join(x for x in cut if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.QUERIES["op1_crf_text"](spark, SF).collect():
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


def test_remainders_are_crc32(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", queries.remainder(5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
