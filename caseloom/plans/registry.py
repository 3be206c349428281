"""Every operator as a query over the given tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, losses, numeric, text
from ..operators import (ensemble, findings, folds, guards, inventory, labels, metrics, pooling, prefix, rules, series,
                         tfidf, translate, volume)
from ..operators.heads import fit_heads, predict
from ..schema import Columns
from ..session import checkpoint, shared_dir, written_table
from ..sources import cases as case_sources
from ..sources import files, predictions, runlog, volumes as volume_sources
from ..streaming import ingest
from . import study, views as v
from .mining import MiningConfig, candidates, mine_labels
from .mining import run_summary as run_record

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


# ---- labels -------------------------------------------------------------------------------------

@query
def known_labels(spark, sf):
    """Strict reading of a label column: only 0 and 1 are known."""
    raw = v.table(spark, sf, "orders").select("o_orderstatus", F.left("o_orderpriority", F.lit(1)).alias("raw"))
    return raw.select("o_orderstatus", numeric.known_label(F.col("raw")).alias("y")).groupBy("o_orderstatus").agg(
        F.count("*").alias("cells"), F.count("y").alias("known"), F.sum("y").alias("positives"))


@query
def loaded_cases(spark, sf):
    """A case table and a table of held-out ids, written, checked and read: what each says of a case."""
    path = f"{shared_dir(spark).rstrip('/')}/cases/{uuid.uuid4().hex}"
    truth = v.table(spark, sf, "labels").select("doc_id", *v.DOC_LABELS)
    docs = v.table(spark, sf, "documents").select("doc_id", "text").join(truth, "doc_id", "left")
    named = docs.select(F.col("doc_id").alias("study"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("words"), *v.DOC_LABELS)
    named.write.parquet(f"{path}/cases")
    case_sources.write_table(named.filter("study % 4 = 1").select("study"), f"{path}/held_out.csv")
    cases, held_out = case_sources.load_cases(
        spark, f"{path}/cases", Columns("study", "words", tuple(v.DOC_LABELS)), f"{path}/held_out.csv")
    marked = cases.join(held_out.withColumn("held_out", F.lit(True)), "case_id", "left")
    return marked.select("case_id", F.length("report").alias("n_chars"), *v.DOC_LABELS, F.coalesce("held_out", F.lit(False)).alias("held_out"))


@query
def labeled_cases(spark, sf):
    truth = labels.truth(v.document_cases(spark, sf), v.DOC_LABELS)
    return labels.labeled_cases(truth).groupBy("is_labeled").agg(F.count("*").alias("cases"))


@query
def gold_view(spark, sf):
    """Soft values are masked unless flagged as truth."""
    wide = v.orders(spark, sf).select("case_id", F.coalesce("filled", F.lit(0.7)).alias("filled"),
                                      F.col("filled").isNotNull().cast("int").alias("filled__true"), "urgent")
    gold = labels.gold_labels(wide, v.ORDER_LABELS)
    return gold.groupBy("filled", "urgent").agg(F.count("*").alias("cases"))


@query
def series_flags(spark, sf):
    """Plane whitelist and flag coercion over a raw series table."""
    raw = v.table(spark, sf, "events").select(
        F.col("user_id").alias("StudyInstanceUID"), F.col("event_type").alias("SeriesInstanceUID"),
        F.when(F.col("value") > 50, "1.0").when(F.col("value") > 20, "yes").otherwise("0").alias("Fluid_Sensitive"),
        F.pmod("event_id", F.lit(3)).cast("string").alias("Fat_Suppression"),
        F.when(F.col("event_type") == "view", " Sagittal ").when(F.col("event_type") == "click", "AXIAL")
        .otherwise(F.col("event_type")).alias("Anatomical_Plane"))
    return case_sources.series_table(raw).groupBy("plane", "fluid", "fatsat").agg(F.count("*").alias("n"))


@query
def list_cases(spark, sf):
    """Distinct ids of the series table and the case table together."""
    ids = case_sources.list_cases(v.listed_series(spark, sf), v.orders(spark, sf))
    return ids.agg(F.count("*").alias("cases"), F.min("case_id").alias("first"), F.max("case_id").alias("last"))


@query
def ordered_cases(spark, sf):
    """All distinct ids, written in order and read back in the order of files."""
    path = f"{shared_dir(spark).rstrip('/')}/ordered/{uuid.uuid4().hex}"
    case_sources.write_ordered(case_sources.list_cases(v.listed_series(spark, sf), v.orders(spark, sf)), path, ["case_id"])
    return case_sources.read_in_order(spark, path)


@query
def run_summary(spark, sf):
    """The closing record of a labelling run over orders, with one prediction source as the model and one as the rules."""
    p, truth = v.order_predictions(spark, sf), v.order_truth(spark, sf)
    scored = v.order_scores(spark, sf).withColumn("source", F.element_at(F.create_map(*[F.lit(x) for x in ("disc", "model", "qty", "rules", "tax", "final")]), F.col("source")))
    chosen = ensemble.choose_sources(scored.filter("source <> 'final'"), ("model", "rules"), 5, "rules")
    merged = labels.merge_labels(truth, p.filter("source = 'disc'"), v.ORDER_LABELS)
    _, means = metrics.compare_sources(scored, ["rules", "model", "final"])
    row = run_record(truth, merged, chosen, means, 5)
    auc = lambda s: F.round(F.col("oof_macro_auc")[s], 6).alias(f"auc_{s}")
    return row.select("n_cases", "n_labeled", "n_pseudo_labeled", F.array_join("rule_only_labels", ",").alias("rule_only"),
                      F.to_json("source_per_label").alias("chosen"), auc("model"), auc("rules"), auc("final"),
                      F.round("final_minus_rules_auc", 6).alias("gain"), "final_beats_rules")


@query
def duplicate_ids(spark, sf):
    return guards.duplicate_ids(v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id")), "case_id")


@query
def merged_labels(spark, sf):
    """Truth over probabilities with flags, source, confidence and weight."""
    best = v.order_predictions(spark, sf).filter("source = 'disc'")
    merged = labels.merge_labels(v.order_truth(spark, sf), best, v.ORDER_LABELS)
    return merged.select("case_id", r6("filled"), r6("urgent"), "filled__true", "urgent__true", "label_source",
                         r6("pseudo_confidence"), r6("sample_weight"))


@query
def weighted_cases(spark, sf):
    """Every order with the weight of its merged labels, where only orders of even customers have one."""
    cases = v.orders(spark, sf).select("case_id", "customer")
    best = v.order_predictions(spark, sf).filter("source = 'disc'")
    weights = labels.merge_labels(v.order_truth(spark, sf), best, v.ORDER_LABELS).join(cases.filter("customer % 2 = 0"), "case_id", "left_semi")
    return labels.with_weights(cases, weights).select("case_id", r6("sample_weight"))


@query
def shape_gaps(spark, sf):
    """Cells of the truth that a source has not predicted."""
    predicted = v.order_predictions(spark, sf).filter("source = 'qty'")
    return guards.shape_mismatch(v.order_truth(spark, sf), predicted)


@query
def prevalence(spark, sf):
    best = v.order_predictions(spark, sf).filter("source = 'disc'")
    truth = v.order_truth(spark, sf)
    merged = labels.merge_labels(truth, best, v.ORDER_LABELS)
    report = labels.prevalence_report(truth, merged, v.ORDER_LABELS)
    return report.select("label", "true_n", r6("true_prevalence"), "pseudo_n", r6("pseudo_mean_prob"),
                         r6("pseudo_prevalence_at_half"))


@query
def leakage_problems(spark, sf):
    """All rule violations of a damaged label table."""
    best = v.order_predictions(spark, sf).filter("source = 'disc'")
    merged = labels.merge_labels(v.order_truth(spark, sf), best, v.ORDER_LABELS)
    key = F.col("case_id").cast("long")
    damaged = merged.withColumn("filled", F.when(F.pmod(key, F.lit(11)) == 0, F.lit(1.5)).otherwise(F.col("filled"))) \
        .withColumn("urgent__true", F.when(F.pmod(key, F.lit(13)) == 0, 0).otherwise(F.col("urgent__true")))
    held = v.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("case_id"))
    return guards.leakage_problems(damaged, v.orders(spark, sf), v.ORDER_LABELS, held)


@query
def class_weights(spark, sf):
    truth = v.order_truth(spark, sf)
    weights = losses.pos_weights(truth)
    balanced = losses.balanced_weights(truth).groupBy("label").agg(
        F.max(F.when(F.col("y") == 1, F.col("weight"))).alias("w1"), F.max(F.when(F.col("y") == 0, F.col("weight"))).alias("w0"))
    return weights.join(balanced, "label").select("label", "n", "positives", r6("pos_weight"), r6("w1"), r6("w0"))


# ---- text ---------------------------------------------------------------------------------------

@query
def folded_text(spark, sf):
    folded = text.with_folded(v.documents(spark, sf), "report")
    return folded.select("case_id", F.length("folded").alias("n_chars"), F.md5("folded").alias("digest"))


@query
def sentences(spark, sf):
    folded = text.with_folded(v.documents(spark, sf), "report")
    split = folded.select("case_id", text.split_sentences(F.col("folded")).alias("s"))
    return split.select("case_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query
def languages(spark, sf):
    found = text.with_language(text.with_folded(v.documents(spark, sf), "report"))
    return found.groupBy("lang").agg(F.count("*").alias("reports"))


@query
def bilingual_reports(spark, sf):
    """Reports followed by their English version (here the reversed text), unless they are English."""
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("case_id"), "text", "lang")
    both = docs.select("case_id", text.bilingual_text(F.col("text"), F.reverse("text"), F.col("lang")).alias("t"))
    return both.select("case_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query
def token_windows(spark, sf):
    """Head and tail of long token arrays."""
    tokens = v.documents(spark, sf).select("case_id", F.split("report", " ").alias("t"))
    cut = tokens.select("case_id", text.head_tail(F.col("t"), 64, 48).alias("t"))
    return cut.select("case_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def rule_hits(spark, sf):
    """Hits per case, label and kind of the document rules."""
    return rules.rule_counts(rules.find_hits(v.documents(spark, sf), v.DOCUMENT_RULES))


@query
def rule_scores(spark, sf):
    """Every case with its score per label; no hit is 0."""
    return rules.rule_scores(v.documents(spark, sf), v.DOCUMENT_RULES)


@query
def knee_findings(spark, sf):
    """The twelve-finding rule book over a report for every order, its sentences chosen by the order's key."""
    found = rules.rule_scores(v.knee_reports(spark, sf), findings.KNEE)
    return labels.to_long(found, list(findings.KNEE.labels)).filter("p > 0").groupBy("case_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("label", F.lit("="), F.col("p").cast("string")))), ";").alias("found"))


def _upper(lang: str, batch: list[str]) -> list[str]:
    return [f"{lang}:{s.upper()}" for s in batch]


@query
def translated_reports(spark, sf):
    """Sentence-wise mapping of the reports in two languages, the others as they are."""
    folded = text.with_folded(v.documents(spark, sf).join(v.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("case_id"), "lang"), "case_id"), "report")
    reports = checkpoint(folded.select("case_id", F.col("folded").alias("report"), "lang"))
    done = translate.translate(reports, _upper, ["de", "es"])
    return done.select("case_id", F.length("text_en").alias("n_chars"), F.md5("text_en").alias("digest"))


@query
def tfidf_vocabulary(spark, sf):
    """Vocabulary per block and term length: terms, cases, occurrences, idf."""
    texts = text.with_folded(v.documents(spark, sf), "report")
    vocabulary = tfidf.fit_vocabulary(texts, texts.count())
    return vocabulary.table.groupBy("block", F.length("term").alias("n")).agg(
        F.count("*").alias("terms"), F.sum("df").alias("postings"), F.sum("total").alias("occurrences"),
        F.round(F.sum(F.col("idf") * F.col("df")), 2).alias("idf_sum"))


@query
def tfidf_limited(spark, sf):
    """A vocabulary whose limits bind, with ties at the cut."""
    texts = text.with_folded(v.documents(spark, sf), "report")
    return tfidf.fit_vocabulary(texts, texts.count(), {"c": 700, "w": 150}).table.select("block", "term", "df", "total", r6("idf"))


@query
def tfidf_weights(spark, sf):
    """Per case: number of weighted terms, their sum, and the squared length (one per block)."""
    folded = text.with_folded(v.documents(spark, sf), "report").select("case_id", "folded")
    texts = written_table(folded, "folded")  # read twice, folded once
    weights = tfidf.weighted_terms(texts, tfidf.fit_vocabulary(texts, texts.count()))
    return weights.groupBy("case_id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight_sum"),
                                          F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squared"))


@query
def text_heads(spark, sf):
    """Balanced logistic heads on TF-IDF and rule counts of the labelled documents, scored on all."""
    cases = v.document_cases(spark, sf)
    texts = checkpoint(text.with_folded(cases, "report").select("case_id", F.col("folded"), F.col("folded").alias("report")))
    hits = rules.rule_features(rules.find_hits(texts, v.DOCUMENT_RULES), v.DOCUMENT_RULES)
    truth = checkpoint(labels.truth(cases, v.DOC_LABELS))
    known = truth.filter("y is not null").select("case_id").distinct()
    vocabulary = tfidf.fit_vocabulary(texts.join(known, "case_id", "left_semi"), known.count())
    vectors = tfidf.feature_vectors(texts, vocabulary, hits)
    return predict(vectors, fit_heads(vectors, truth, v.DOC_LABELS))


@query
def mined_labels(spark, sf):
    """Reports and scarce truth to a label for every document."""
    result = mine_labels(v.document_cases(spark, sf), MiningConfig(v.DOCUMENT_RULES))
    return result.labels.select("case_id", *v.DOC_LABELS, *[l + "__true" for l in v.DOC_LABELS], "label_source",
                                "sample_weight", "lang")


# ---- metrics ------------------------------------------------------------------------------------

@query
def auc_per_label(spark, sf):
    return metrics.auc(v.order_scores(spark, sf), ["source", "label"]).select(
        "source", "label", "n", "positives", r6("auc", 9))


@query
def metric_report(spark, sf):
    """The markdown report of the metrics, line by line."""
    table = metrics.auc(v.order_scores(spark, sf), ["source", "label"]).select("source", "label", "n", "positives", "auc")
    lines = case_sources.markdown(table.sort("source", "label"), "Metrics").rstrip("\n").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, value string")


@query
def metrics_all_labels(spark, sf):
    """One source has no truth for one label, and some scores are NaN or missing: every label keeps its row."""
    scores = v.order_scores(spark, sf).withColumns({
        "y": F.when(~((F.col("source") == "tax") & (F.col("label") == "urgent")), F.col("y")),
        "p": F.when(F.col("case_id").cast("long") % 10 == 0, F.lit(float("nan"))).when(F.col("case_id").cast("long") % 10 != 1, F.col("p"))})
    return metrics.label_metrics(scores, ["source", "label"]).select(
        "source", "label", "n", "positives", *[r6(m) for m in ("auc", "ap", "f1_at_half", "best_f1")])


@query
def macro_auc(spark, sf):
    per_label = metrics.auc(v.order_scores(spark, sf), ["source", "label"])
    return metrics.macro_auc(per_label, ["source"]).select("source", r6("macro_auc", 9))


@query
def label_metrics(spark, sf):
    return metrics.label_metrics(v.order_scores(spark, sf), ["source", "label"]).select(
        "source", "label", "n", "positives", *[r6(m) for m in ("auc", "ap", "f1_at_half", "best_f1")])


@query
def source_comparison(spark, sf):
    side, _ = metrics.compare_sources(v.order_scores(spark, sf), v.ORDER_SOURCES)
    return side.select("label", *[r6(c) for c in side.columns if c != "label"])


@query
def source_summary(spark, sf):
    _, means = metrics.compare_sources(v.order_scores(spark, sf), v.ORDER_SOURCES)
    return means.select("source", *[r6(c) for c in means.columns if c != "source"])


@query
def hardest_cases(spark, sf):
    return metrics.hardest_cases(v.order_scores(spark, sf).filter("source = 'disc'"), 5)


@query
def error_table(spark, sf):
    """Size, prevalence, AUC with its bootstrap interval and hardest cases per label."""
    found = metrics.error_table(v.order_scores(spark, sf).filter("source = 'disc'"))
    return found.select("label", "n_labeled", "n_pos", *[r6(c) for c in ("prevalence", "auc", "ci_low", "ci_high")], "hardest_fn", "hardest_fp")


@query
def oof_macro_auc(spark, sf):
    """Out-of-fold predictions joined with the truth."""
    scored = v.order_predictions(spark, sf).filter("source = 'tax'").join(v.order_truth(spark, sf), ["case_id", "label"])
    return metrics.macro_auc(metrics.auc(scored, ["label"])).select(r6("macro_auc", 9))


@query
def oof_errors(spark, sf):
    """The error table of out-of-fold predictions, without its resampled interval."""
    _, errors = metrics.oof_report(v.order_predictions(spark, sf).filter("source = 'disc'").drop("source"), v.order_truth(spark, sf))
    return errors.select("label", "n_labeled", "n_pos", r6("prevalence"), r6("auc", 9), "hardest_fn", "hardest_fp")


@query
def scoring_losses(spark, sf):
    """Focal, asymmetric and weighted cross-entropy, masked means per source and label."""
    scored = v.order_scores(spark, sf).withColumn("z", numeric.logit(F.col("p")))
    z, y = F.col("z"), F.coalesce("y", F.lit(0.0))
    mean = lambda loss, weight=None, floor=1e-6: F.round(losses.masked_mean(loss, F.col("y"), weight, floor), 6)
    return scored.groupBy("source", "label").agg(
        mean(losses.focal_loss(z, y)).alias("focal"), mean(losses.asymmetric_loss(z, y)).alias("asymmetric"),
        mean(losses.bce_with_logits(z, y, F.lit(2.0)), None, 1.0).alias("bce"),
        mean(losses.focal_loss(z, y), 0.5 + F.col("p") / 2).alias("focal_weighted"))


# ---- folds --------------------------------------------------------------------------------------

@query
def rarest_folds(spark, sf):
    return folds.rarest_positive_folds(v.orders(spark, sf), v.ORDER_LABELS, 5, 42)


@query
def multilabel_folds(spark, sf):
    """Iterative stratification over customers; the quota step is a greedy loop, so no SQL."""
    assigned = folds.multilabel_folds(v.orders(spark, sf), v.ORDER_LABELS, 5, 42, "customer")
    return folds.fold_summary(v.orders(spark, sf), assigned, v.ORDER_LABELS)


@query
def fold_balance(spark, sf):
    """Per label: positives of all folds, and whether every fold has its share of them and of cases within 5 % (or 2)."""
    assigned = folds.multilabel_folds(v.orders(spark, sf), v.ORDER_LABELS, 5, 42)
    table = folds.fold_summary(v.orders(spark, sf), assigned, v.ORDER_LABELS)
    columns = ["studies", "labeled", *v.ORDER_LABELS]
    long = table.select("fold", F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("n")) for c in columns])))
    slack = F.greatest(F.lit(2.0), 0.05 * F.avg("n"))
    return long.groupBy("measure").agg(F.count("*").alias("folds"), F.sum("n").alias("total"), (F.max("n") - F.min("n") <= slack).alias("balanced"))


@query
def split_cases(spark, sf):
    """Training and validation cases of one fold."""
    cases = v.orders(spark, sf)
    given = cases.select("case_id", (F.col("case_id").cast("long") % 5).cast("int").alias("fold"))
    train, validation = folds.split_fold(cases.select("case_id", "customer"), given, 2)
    guards.check_disjoint(train, validation)
    return train.withColumn("side", F.lit("train")).unionByName(validation.withColumn("side", F.lit("validation")))


@query
def fold_summary(spark, sf):
    return folds.fold_summary(v.orders(spark, sf), v.order_folds(spark, sf), v.ORDER_LABELS)


@query
def given_folds(spark, sf):
    """Folds looked up for the labelled orders; each must have one."""
    known = labels.labeled_cases(v.order_truth(spark, sf)).filter("is_labeled")
    return folds.shared_folds(known, v.order_folds(spark, sf))


@query
def leaking_groups(spark, sf):
    """Customers whose orders fall into several folds when folds go by order."""
    assigned = v.orders(spark, sf).select(F.col("customer"), F.pmod(F.col("case_id").cast("long"), F.lit(5)).alias("fold"))
    return folds.leaking_groups(assigned, "customer")


@query
def shards(spark, sf):
    """Every third case in id order, from the second on."""
    return prefix.shard(v.orders(spark, sf).select("case_id"), "case_id", 1, 3)


@query
def first_cases(spark, sf):
    """The first hundred orders by id."""
    return prefix.first_cases(v.orders(spark, sf).select("case_id"), "case_id", 100)


@query
def same_case_ids(spark, sf):
    """Whether tables speak of the same orders: the ones with lines, the ones that two sources scored."""
    scored = {s: v.order_predictions(spark, sf).filter(F.col("source") == s) for s in ("disc", "qty")}
    lines = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("case_id"))
    pairs = {"lines and disc": (lines, scored["disc"]), "disc and qty": (scored["disc"], scored["qty"]), "lines and orders": (lines, v.orders(spark, sf))}
    return spark.createDataFrame([(name, guards.same_ids(a, b)) for name, (a, b) in pairs.items()], "pair string, same boolean")


@query
def sampled_cases(spark, sf):
    return prefix.sample_cases(v.orders(spark, sf).select("case_id"), "case_id", 100, 7)


# ---- ensembling ---------------------------------------------------------------------------------

@query
def rank_normalized(spark, sf):
    return ensemble.rank_normalize(v.order_predictions(spark, sf)).select("source", "case_id", "label", r6("p", 9))


@query
def read_back_predictions(spark, sf):
    """Wide tables of two sources, written and read by name, their folds pooled."""
    path = f"{shared_dir(spark).rstrip('/')}/predictions/{uuid.uuid4().hex}"
    wide = labels.to_wide(v.order_predictions(spark, sf), v.ORDER_LABELS, "p", ("source", "case_id"))
    for s in ("disc", "tax"):
        own = wide.filter(F.col("source") == s).drop("source")
        parts = [own.filter(F.col("case_id").cast("long") % 2 == k) for k in (0, 1)]
        predictions.pool_folds(parts).withColumnRenamed("case_id", "StudyInstanceUID").write.parquet(f"{path}/{s}.parquet")
    named = predictions.parse_named([f"{s}={path}/{s}.parquet" for s in ("disc", "tax")])
    return predictions.read_predictions(spark, named, v.ORDER_LABELS).select("source", "case_id", "label", r6("p", 9))


@query
def logged_runs(spark, sf):
    """Epochs appended to a log in two steps and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/runlog/{uuid.uuid4().hex}"
    epochs = v.table(spark, sf, "events").select(F.col("event_type").alias("run"), (F.col("user_id") % 5).alias("fold"), F.col("event_id").alias("epoch"), F.col("value").alias("val_macro_auc"))
    for k in (0, 1):
        runlog.append_rows(epochs.filter(F.col("epoch") % 2 == k), path)
    return runlog.best_per_run(spark.read.parquet(path)).select("run", "fold", r6("best"), "epoch")


@query
def alignment(spark, sf):
    return ensemble.alignment_losses(v.order_predictions(spark, sf), v.ORDER_SOURCES)


@query
def rank_blend(spark, sf):
    blended = ensemble.blend(v.order_predictions(spark, sf), {"disc": 0.5, "qty": 0.25, "tax": 0.0}, "rank")
    return blended.select("case_id", "label", r6("p", 9))


@query
def mean_blend(spark, sf):
    blended = ensemble.blend_groups(v.order_predictions(spark, sf), None, v.ORDER_SOURCES)
    return blended.select("case_id", "label", r6("p", 9))


@query
def view_mean(spark, sf):
    return ensemble.equal_mean(v.order_predictions(spark, sf)).select("case_id", "label", r6("p", 9))


@query
def rank_with_gaps(spark, sf):
    """Ranks where one case in ten has no score: it keeps its row."""
    gaps = v.order_predictions(spark, sf).withColumn("p", F.when(F.col("case_id").cast("long") % 10 != 0, F.col("p")))
    return ensemble.rank_normalize(gaps).select("source", "case_id", "label", r6("p", 9))


@query
def unknown_ranks(spark, sf):
    """Ranks where scores are NULL or NaN: neither takes a rank."""
    return ensemble.rank_normalize(v.order_predictions_with_gaps(spark, sf)).select("source", "case_id", "label", r6("p", 9))


@query
def unknown_blend(spark, sf):
    """A blend in which a cell is unknown as soon as one used source has not scored it."""
    blended = ensemble.blend(v.order_predictions_with_gaps(spark, sf), {"disc": 0.5, "qty": 0.25, "tax": 0.25}, "rank")
    return blended.select("case_id", "label", r6("p", 9))


@query
def unknown_mean(spark, sf):
    return ensemble.equal_mean(v.order_predictions_with_gaps(spark, sf)).select("case_id", "label", r6("p", 9))


@query
def unknown_result(spark, sf):
    """The result of such blends: unknown cells get the column mean, a label without any score 0.5."""
    blended = ensemble.blend(v.order_predictions_with_gaps(spark, sf), {"disc": 0.5, "qty": 0.25, "tax": 0.25}, "mean")
    result = ensemble.assemble_result(v.orders(spark, sf).select("case_id"), blended, v.ORDER_LABELS)
    return result.select("case_id", r6("filled", 9), r6("urgent", 9))


@query
def ensemble_weights(spark, sf):
    """Greedy forward selection; on these sources one of them alone is best."""
    return ensemble.fit_weights(v.order_predictions(spark, sf), v.order_truth(spark, sf), v.ORDER_SOURCES)[1].select(
        "model", r6("oof_macro_auc", 9), r6("weight", 9))


@query
def greedy_weights(spark, sf):
    """The same where sources complement each other, so that several steps gain."""
    return ensemble.fit_weights(v.order_votes(spark, sf), v.order_truth(spark, sf), ["first", "second", "third"])[1].select(
        "model", r6("oof_macro_auc", 9), r6("weight", 9))


@query
def spec_blend(spark, sf):
    """A blend by a specification that was written as JSON and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/spec/{uuid.uuid4().hex}"
    ensemble.spec_json(spark, "rank", {"disc": 0.5, "qty": 0.25, "tax": 0.25}).write.text(path)
    blended = ensemble.blend_groups(v.order_predictions(spark, sf), ensemble.read_spec(spark, path), v.ORDER_SOURCES)
    return blended.select("case_id", "label", r6("p", 9))


@query
def chosen_sources(spark, sf):
    return ensemble.choose_sources(v.order_scores(spark, sf), tuple(v.ORDER_SOURCES), 5, "disc")


@query
def combined_sources(spark, sf):
    chosen = ensemble.choose_sources(v.order_scores(spark, sf), tuple(v.ORDER_SOURCES), 5, "disc")
    return ensemble.combine(v.order_predictions(spark, sf), chosen).select("case_id", "label", r6("p", 9))


@query
def source_candidates(spark, sf):
    """Model, rules and their blend."""
    p = v.order_predictions(spark, sf)
    model, rule_p = (p.filter(F.col("source") == s).drop("source") for s in ("disc", "qty"))
    return candidates(model, rule_p).select("source", "case_id", "label", r6("p", 9))


@query
def assembled_result(spark, sf):
    blended = ensemble.blend(v.order_predictions(spark, sf), {"disc": 1.0, "tax": 1.0}, "mean")
    result = ensemble.assemble_result(v.orders(spark, sf).select("case_id"), blended, v.ORDER_LABELS)
    return result.select("case_id", r6("filled", 9), r6("urgent", 9))


@query
def result_problems(spark, sf):
    """A result table with a gap, a swap and a value out of range against what was asked for."""
    ids = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_no"), F.col("o_orderkey").cast("string").alias("case_id"))
    result = ids.filter(F.pmod("row_no", F.lit(101)) != 0).select(
        "row_no", F.when(F.pmod("row_no", F.lit(103)) == 0, "x").otherwise(F.col("case_id")).alias("case_id"),
        F.when(F.pmod("row_no", F.lit(107)) == 0, F.lit(float("nan"))).otherwise(F.lit(0.5)).alias("filled"), F.lit(0.5).alias("urgent"))
    return guards.result_problems(result, ids, v.ORDER_LABELS)


@query
def usable_runs(spark, sf):
    """Orders as a registry of runs: duplicates of a (run, fold) and smoke runs are left out."""
    key = F.col("o_orderkey")
    registry = v.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("name"), F.lpad(key.cast("string"), 10, "0").alias("path"),
        F.concat(F.lit("run"), F.pmod("o_custkey", F.lit(50)).cast("string"),
                 F.when(F.pmod(key, F.lit(7)) == 0, "_smoke").otherwise("")).alias("run"),
        F.pmod(key, F.lit(5)).alias("fold"))
    return predictions.usable_runs(registry)


@query
def leaderboard(spark, sf):
    """Events as epochs: the best score of every run and fold, then means over folds."""
    epochs = v.table(spark, sf, "events").select(
        F.col("event_type").alias("run"), F.pmod("user_id", F.lit(5)).alias("fold"), F.col("event_id").alias("epoch"),
        F.col("value").alias("val_macro_auc"))
    board = runlog.leaderboard(runlog.best_per_run(epochs))
    return board.select("run", "folds", r6("mean_score"), r6("best_score"))


# ---- series and volumes -------------------------------------------------------------------------

@query
def reconciled_series(spark, sf):
    return series.reconcile(v.listed_series(spark, sf), v.slice_headers(spark, sf))


@query
def routed_series(spark, sf):
    found = series.reconcile(v.listed_series(spark, sf), v.slice_headers(spark, sf)).filter("on_disk and n_files > 0")
    return series.route(found, extra_t1=True)


@query
def majority_sizes(spark, sf):
    return series.majority_size(v.slice_headers(spark, sf))


@query
def ordered_slices(spark, sf):
    return series.order_series(v.slice_headers(spark, sf)).select(
        "case_id", "series_id", "path", F.col("slice_idx").cast("long").alias("slice_idx"), "inferred_plane")


@query
def dropped_slices(spark, sf):
    _, dropped = series.ordered_and_dropped(v.slice_headers(spark, sf))
    count = lambda reason: F.coalesce(F.try_element_at("dropped", F.lit(reason)), F.lit(0)).cast("long").alias(reason)
    return dropped.select("case_id", "series_id", count("bad_header"), count("off_size"), count("duplicate_position"))


@query
def typed_headers(spark, sf):
    """Header fields as text become numbers and vectors, or NULL."""
    e = v.table(spark, sf, "events")
    raw = e.select(
        F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("series_id"),
        F.col("event_id").cast("string").alias("path"),
        F.when(F.pmod("event_id", F.lit(5)) == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("instance_number"),
        F.array(F.col("value").cast("string"), F.when(F.col("value") > 100, "inf").otherwise("1.5"), F.lit("2")).alias("position"),
        F.array(F.lit("1"), F.lit("0")).alias("orientation"), F.array(F.lit("0.5"), F.lit("0.5")).alias("pixel_spacing"),
        F.when(F.col("value") > 30, F.col("value").cast("string")).alias("slice_thickness"),
        F.lit("512").alias("rows"), F.lit("x").alias("cols"), F.lit("").alias("transfer_syntax"),
        F.lit(None).cast("string").alias("series_description"))
    typed = series.typed_headers(raw)
    return typed.groupBy("series_id", "transfer_syntax", "rows", "cols").agg(
        F.count("instance_number").alias("instances"), F.count("position").alias("positions"),
        F.count("orientation").alias("orientations"), F.count("pixel_spacing").alias("spacings"),
        F.round(F.sum("slice_thickness"), 3).alias("thickness"))


@query
def inferred_planes(spark, sf):
    headers = v.slice_headers(spark, sf)
    plane = geometry.plane_from_orientation(F.col("orientation"))
    return headers.groupBy("series_id", plane.alias("plane")).agg(F.count("*").alias("slices"))


@query
def letterbox_layout(spark, sf):
    """Scaled size and offsets for frames whose extents come from the part table."""
    frames = v.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") + 1).alias("h"), F.lit(40).alias("w"), (F.col("p_retailprice") / 1000).alias("mm"))
    box = geometry.letterbox(F.col("h"), F.col("w"), 64, F.col("mm"), F.lit(1.0))
    return frames.select("p_partkey", box.alias("b")).select("p_partkey", "b.new_h", "b.new_w", "b.top", "b.left")


@query
def decode_report(spark, sf):
    """Per transfer syntax what decoded, with readable headers standing for decoded files."""
    return inventory.decode_report(v.slice_headers(spark, sf).withColumn("ok", F.col("readable")))


@query
def top_errors(spark, sf):
    files = v.table(spark, sf, "events").select((F.col("event_type") != "error").alias("ok"),
                                                F.concat(F.lit("Failure: "), F.left("props", F.lit(8))).alias("error"))
    return inventory.top_errors(files, 10)


@query
def intensity_windows(spark, sf):
    return volume.window_bounds(v.volumes(spark, sf), "standard").select("series_id", r6("lo"), r6("hi"))


def _pixel_rows(df: DataFrame, column: str = "pixels") -> DataFrame:
    """Per slice: sum and position-weighted sum, which tell frames and orders apart."""
    total = F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double"))
    weighted = F.aggregate(F.transform(column, lambda x, i: x.cast("double") * i), F.lit(0.0), lambda s, x: s + x)
    return df.select("series_id", F.col("slice_idx").cast("long").alias("slice_idx"),
                     F.round(total, 4).alias("total"), F.round(weighted, 3).alias("weighted"))


@query
def windowed_volumes(spark, sf):
    return _pixel_rows(volume.window_volume(v.volumes(spark, sf), "bone"))


@query
def selected_slices(spark, sf):
    return volume.select_slices(v.volumes(spark, sf), 16).select(
        "series_id", F.col("source_idx").cast("long").alias("source_idx"), F.col("slice_idx").cast("long").alias("slice_idx"))


@query
def slabs(spark, sf):
    return _pixel_rows(volume.make_slabs(v.volumes(spark, sf)).withColumn(
        "pixels", F.concat("previous", "pixels", "following")))


@query
def sliding_mip(spark, sf):
    return _pixel_rows(volume.sliding_mip(v.volumes(spark, sf), 4))


@query
def flipped(spark, sf):
    return _pixel_rows(volume.flip(v.volumes(spark, sf)))


@query
def stored_bytes(spark, sf):
    """Quantised to bytes and read back."""
    stored = volume.to_storage(v.volumes(spark, sf).withColumn("pixels", F.transform("pixels", lambda x: F.abs(x))), "uint8")
    return _pixel_rows(stored.withColumn("pixels", volume.from_storage(F.col("stored"))))


@query
def resized(spark, sf):
    """Shrunk and letterboxed with unequal spacing."""
    spaced = v.volumes(spark, sf).withColumn("pixel_spacing", F.array(F.lit(1.0), F.lit(2.0)))
    return _pixel_rows(volume.resize(spaced, 6))


@query
def preprocessed(spark, sf):
    """Window, choice of slices, resize and storage in one."""
    stored = volume.preprocess(v.volumes(spark, sf), volume.PreprocessConfig(img_size=6, max_slices=12))
    return stored.select("series_id", F.col("slice_idx").cast("long").alias("slice_idx"), F.hex("stored").alias("stored"))


@query
def slice_dropout(spark, sf):
    kept = volume.drop_slices(v.volumes(spark, sf), seed=3, probability=1.0)
    return kept.groupBy("series_id").agg(F.count("*").alias("slices"))


@query
def intensity_jitter(spark, sf):
    return _pixel_rows(volume.jitter(v.volumes(spark, sf), seed=3, probability=1.0))


@query
def montage(spark, sf):
    return volume.montage_tiles(v.volumes(spark, sf), "plane", 3, 5, 0)


@query
def attention_weights(spark, sf):
    rows = v.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("score"))
    return pooling.attention_weights(rows, ["label"], masked=F.pmod("vec_id", F.lit(5)) == 0).select(
        "vec_id", "label", r6("weight", 9))


def _pooled(spark, sf) -> DataFrame:
    rows = v.volumes(spark, sf).withColumn("score", 4 * F.col("pixels")[0].cast("double"))
    masked = F.pmod("vec_id", F.lit(5)) == 0
    return pooling.attention_pool(rows, ["case_id", "plane"], "pixels", 64, masked=masked)


@query
def attention_pooled(spark, sf):
    return _pooled(spark, sf).select("case_id", "plane", F.posexplode("pooled").alias("i", "value")).select(
        "case_id", "plane", "i", r6("value"))


@query
def fused_planes(spark, sf):
    return pooling.concat_planes(_pooled(spark, sf), 64).select(
        "case_id", F.posexplode("fused").alias("i", "value")).select("case_id", "i", r6("value"))


# ---- inventory ----------------------------------------------------------------------------------

def _series_log(spark, sf) -> DataFrame:
    """Routed series with slice counts; a routed series without any clean slice is an error."""
    headers = v.slice_headers(spark, sf)
    routes = series.route(series.reconcile(v.listed_series(spark, sf), headers).filter("on_disk and n_files > 0"), True)
    saved = headers.filter("readable and rows = 512").groupBy("case_id", "series_id").agg(F.count("*").alias("n_saved_slices"))
    log = routes.join(saved, ["case_id", "series_id"], "left")
    failed = F.col("n_saved_slices").isNull() | (F.pmod(F.col("case_id").cast("long"), F.lit(17)) == 0)
    return log.select("case_id", "key", "series_id", F.coalesce("n_saved_slices", F.lit(0)).alias("n_saved_slices"),
                      F.when(failed, "DecodeError: no slice could be decoded").alias("error"))


def _studies(spark, sf) -> DataFrame:
    found = series.reconcile(v.listed_series(spark, sf), v.slice_headers(spark, sf))
    return found.groupBy("case_id").agg(F.count_if("listed").alias("n_series_listed"), F.count_if("on_disk").alias("n_series_stored")) \
        .withColumn("study_error", F.when(F.pmod(F.col("case_id").cast("long"), F.lit(29)) == 0, "FileNotFoundError"))


def _manifest(spark, sf) -> DataFrame:
    return inventory.manifest(_studies(spark, sf), _series_log(spark, sf))


@query
def manifest(spark, sf):
    return _manifest(spark, sf)


@query
def complete_cases(spark, sf):
    return inventory.with_planes(_manifest(spark, sf), ("sagittal", "axial")).select("case_id")


@query
def any_plane_cases(spark, sf):
    return inventory.with_any_plane(_manifest(spark, sf), ("sagittal", "axial")).select("case_id")


@query
def plane_totals(spark, sf):
    return inventory.plane_coverage(_manifest(spark, sf))


@query
def cache_summary(spark, sf):
    sizes = v.slice_headers(spark, sf).select((F.col("rows") * F.col("cols")).cast("long").alias("bytes"))
    return inventory.summary(_manifest(spark, sf), _series_log(spark, sf), sizes)


@query
def cache_problems(spark, sf):
    """Claims of the manifest against stored series with a lost, a black and a mixed one."""
    headers = v.slice_headers(spark, sf)
    plane = F.when(F.col("series_id") == "view", "sagittal").when(F.col("series_id") == "signup", "coronal").when(
        F.col("series_id") == "purchase", "axial")
    facts = headers.withColumn("plane", plane).filter("plane is not null and readable").groupBy("case_id", "plane").agg(
        F.count("*").alias("n_slices"), F.count_distinct("rows").alias("n_shapes"),
        F.bool_or(F.col("instance_number") == 96).alias("has_non_finite"), F.max("instance_number").alias("peak"))
    facts = facts.filter(F.pmod(F.col("case_id").cast("long"), F.lit(19)) != 0)
    return inventory.cache_problems(_manifest(spark, sf), facts, v.orders(spark, sf).select("case_id"))


def _ingested(spark, sf) -> study.StudyIngest:
    return study.ingest_studies(v.study_files(spark, sf), v.study_series(spark, sf), v.read_slice_header, [("json", v.decode_slice)],
                                volume.PreprocessConfig(img_size=6, max_slices=12), extra_t1=True)


@query
def listed_files(spark, sf):
    """How many files lie under each case and series."""
    return files.file_counts(v.study_files(spark, sf)).select("case_id", "series_id", "n_files")


@query
def raw_frames(spark, sf):
    """The same files decoded and brought to real values: what each series has, frames that fail by their error."""
    decoded = files.decode_files(v.study_files(spark, sf), [("json", v.decode_raw_slice)])
    real = volume.normalise_frames(decoded)
    error = F.element_at(F.split("error", ": "), 3)
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x)
    return real.groupBy("case_id", "series_id", "ok", error.alias("error"), "h", "w").agg(
        F.count("*").alias("frames"), F.round(F.min(F.array_min("pixels")).cast("double"), 6).alias("low"),
        F.round(F.max(F.array_max("pixels")).cast("double"), 6).alias("high"), F.round(F.sum(total), 4).alias("total"))


@query
def ingested_series(spark, sf):
    """Slice files written, read, routed, ordered, decoded and stored: the log of every routed series."""
    return _ingested(spark, sf).log.select(
        "case_id", "key", "series_id", "fluid", "fatsat", "n_files", "n_raw_slices", "n_saved_slices", "dropped_json", "raw_h", "raw_w",
        "inferred_plane", F.array_join("transfer_syntaxes", ",").alias("syntaxes"), F.col("pixel_spacing")[1].alias("spacing"),
        F.element_at(F.split("error", ":"), 1).alias("error"))


@query
def ingested_studies(spark, sf):
    """The nested study records of the same files, with the manifest."""
    found = _ingested(spark, sf)
    counted = F.map_filter("series", lambda _, entry: entry["error"].isNull())
    records = found.studies.select(
        "case_id", F.array_join("series_missing_on_disk", ",").alias("missing"), "series_not_listed", F.to_json("routes").alias("routes"),
        F.array_join(F.map_keys(counted), ",").alias("saved_keys"), F.col("config.max_slices").alias("max_slices"))
    return found.manifest.join(records, "case_id")


@query
def ingest_problems(spark, sf):
    """Everything written, read back and checked against the manifest; one study was never delivered."""
    path = f"{shared_dir(spark).rstrip('/')}/studies/{uuid.uuid4().hex}"
    _ingested(spark, sf).write(path)
    stored = volume_sources.read_volumes(spark, f"{path}/volumes")
    manifest = volume_sources.read_manifest(spark, f"{path}/manifest")
    expected = manifest.select("case_id").unionByName(manifest.select(F.lit("undelivered").alias("case_id")))
    return inventory.cache_problems(manifest, inventory.volume_facts(stored), expected)


@query
def frame_sizes(spark, sf):
    return inventory.frame_sizes(v.slice_headers(spark, sf).select(
        F.col("rows").alias("h"), F.col("cols").alias("w"), F.lit("uint8").alias("dtype")))


@query
def stored_volumes(spark, sf):
    """Volumes written by plane and two planes read back."""
    path = f"{shared_dir(spark).rstrip('/')}/volumes/{uuid.uuid4().hex}"
    stored = volume.to_storage(v.volumes(spark, sf).withColumn("pixels", F.transform("pixels", lambda x: F.abs(x))))
    volume_sources.write_volumes(stored.drop("pixels"), path)
    return _pixel_rows(volume_sources.read_volumes(spark, path, ("sagittal", "axial")))


@query
def pending_cases(spark, sf):
    """What is left after one half was ingested, in two resumable batch runs."""
    path = f"{shared_dir(spark).rstrip('/')}/ingest/{uuid.uuid4().hex}"
    cases = v.orders(spark, sf).select("case_id")
    ingest.ingest_batch(cases.join(v.order_predictions(spark, sf).filter("source = 'tax'"), "case_id", "left_semi"), path, lambda df: df)
    return ingest.pending(cases, path)


@query
def streamed_cases(spark, sf):
    """Events through the incremental file stream, then counted from its output."""
    source = v.table(spark, sf, "events")
    path = f"{shared_dir(spark).rstrip('/')}/streamed/{uuid.uuid4().hex}"
    key = hashlib.md5(path.encode()).hexdigest()
    stream = ingest.ingest_stream(
        spark, f"{sf}/events.parquet*", source.schema, path,
        lambda df: df.select(F.col("user_id").cast("string").alias("case_id"), "event_type", F.length("props").alias("n")),
        checkpoint=f"{shared_dir(spark).rstrip('/')}/streams/{key}")
    stream.awaitTermination()
    return spark.read.parquet(path).groupBy("case_id", "event_type").agg(
        F.count("*").alias("events"), F.sum("n").alias("chars"))
