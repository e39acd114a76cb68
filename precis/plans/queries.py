"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

They run over whole driver tables. Doubles are rounded to 6 decimals at the
edge so results compare exactly with the SQL oracle (``plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.functions import text as T
from precis.operators import evaluate as E
from precis.operators import graph as G
from precis.operators import summarizers as S
from precis.operators.efficiency import efficiency_report
from precis.operators.sentences import segment, sentences, tokens
from precis.operators.split import stratified_split
from precis.session import written
from precis.sources import files
from precis.sources.tables import table

K = 3                     # extractive sentences per summary (reference config default)
RANK_STEPS = 20           # power-iteration steps (the operator's default)
SEED = 42
# Section rules for the driver tables: frequent line starts of the corpus
# (the default resume headings never occur in it).
QUERY_SECTION_RULES = [
    ("def", r"^(the|der|la)"),
    ("conj", r"^(and|et|und)"),
    ("prep", r"^(of|de|in)"),
]
ABSTRACTIVE_STUBS = ["bart", "pegasus", "t5"]
GRID_REQUEST = ["textrank", "bart", "luhn", "hybrid"]
ROUTER_REQUEST = ["random", "hybrid", "luhn", "lsa"]
MODELS = ["kl", "lexrank", "lsa", "luhn", "random", "reduction", "textrank"]    # every extractive model but the rank-r variant of lsa


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def _corpus(spark, sf, together: tuple[str, ...] = ()) -> S.Corpus:
    return S.Corpus.of(_docs(spark, sf), persist=True, together=together)


def _summary(name, fn):
    def q(spark, sf):
        c = _corpus(spark, sf)
        return c.all_documents(fn(c))
    q.__name__ = name
    return q


# ------------------------------------------------------------------ text
def q_clean_text(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"),
                                             T.clean_text("text").alias("cleaned"))
    p = table(spark, sf, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"),
                                         T.clean_text("html").alias("cleaned"))
    return d.unionByName(p)


def q_segment_sections(spark, sf):
    return segment(_docs(spark, sf), QUERY_SECTION_RULES)


def q_split_sentences(spark, sf):
    return sentences(_docs(spark, sf))


def q_tokenize_terms(spark, sf):
    toks = tokens(sentences(_docs(spark, sf)))
    return toks.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))


def q_output_path(spark, sf):
    d = _docs(spark, sf)
    rel = F.when(F.col("lang") == "en", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))) \
        .otherwise(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    x = d.select("doc_id", rel.alias("rel_path"))
    x = x.select("doc_id", "rel_path",
                 T.summary_path(F.lit("luhn"), "rel_path", True).alias("preserve_path"),
                 T.summary_path(F.lit("luhn"), "rel_path", False).alias("flat_path"))
    return x.select("doc_id", "rel_path", "preserve_path", "flat_path",
                    T.id_from_summary_name("preserve_path").alias("id_preserve"),
                    T.id_from_summary_name("flat_path").alias("id_flat"),
                    T.record_key(F.lit("luhn"), T.id_from_summary_name("flat_path")).alias("unique_id"))


# ------------------------------------------------------------- summaries
q_summ_random = _summary("summ_random", lambda c: S.random(c, K, SEED))
q_summ_luhn = _summary("summ_luhn", lambda c: S.luhn(c, K))
q_summ_lsa_norm = _summary("summ_lsa_norm", lambda c: S.lsa(c, K))
q_summ_lsa_rank = _summary("summ_lsa_rank", lambda c: S.lsa_rank(c, K))
q_summ_reduction = _summary("summ_reduction", lambda c: S.reduction(c, K))
q_summ_textrank = _summary("summ_textrank", lambda c: S.textrank(c, K, RANK_STEPS))
q_summ_lexrank = _summary("summ_lexrank", lambda c: S.lexrank(c, K, RANK_STEPS))
q_summ_kl = _summary("summ_kl", lambda c: S.kl(c, K))


def q_sentence_graph_textrank(spark, sf):
    e = _corpus(spark, sf).pairs("textrank", lambda c: G.textrank_edges(c.toks))
    return e.select("doc_id", "src", "dst", "shared", r6("weight").alias("weight"))


def q_sentence_graph_lexrank(spark, sf):
    e = _corpus(spark, sf).pairs("lexrank", lambda c: G.lexrank_edges(c.sents, c.toks))
    return e.select("doc_id", "src", "dst", r6("cosine").alias("cosine"))


def q_model_doc_grid(spark, sf):
    available = list(S.EXTRACTIVE) + ABSTRACTIVE_STUBS
    chosen = [m for m in GRID_REQUEST if m in available]
    d = _docs(spark, sf).where(F.length("text") > 0)
    arr = F.array(*[F.struct(F.lit(i).alias("model_ord"), F.lit(m).alias("model")) for i, m in enumerate(chosen)])
    return d.select("doc_id", F.explode(arr).alias("m")).select("m.model", "m.model_ord", "doc_id")


# ------------------------------------------------------------ evaluation
def _quality_labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("category"))


def _summaries(spark, sf):
    """(model, doc_id, summary) of every model; those that rank a document in its row share one pass."""
    return _corpus(spark, sf, tuple(MODELS)).every_summary(MODELS, K)


def _lang_labels(spark, sf):
    return _docs(spark, sf).select("doc_id", F.col("lang").alias("category"))


def q_label_join(spark, sf):
    return E.label_join(_summaries(spark, sf), _quality_labels(spark, sf))


def q_stratified_split(spark, sf):
    return stratified_split(_docs(spark, sf).select("doc_id", F.col("lang").alias("category")))


def q_stratified_split_quality(spark, sf):
    return stratified_split(_quality_labels(spark, sf))


def q_tfidf_features(spark, sf):
    recs = written(E.label_join(_summaries(spark, sf), _lang_labels(spark, sf)))   # read by split, fit and apply
    split = stratified_split(recs, "resume_id")
    train = split.where(F.col("fold") == "train").select(F.col("doc_id").alias("resume_id"))
    feats, _ = E.tfidf(recs, train)
    return feats.select("model", "resume_id", "term", r6("tfidf").alias("tfidf"))


def q_corpus_counts(spark, sf):
    return E.corpus_counts(E.label_join(_summaries(spark, sf), _quality_labels(spark, sf)))


def q_class_weights(spark, sf):
    split = stratified_split(_docs(spark, sf).select("doc_id", F.col("lang").alias("category")))
    return E.class_weights(split).select("category", "n_c", r6("weight").alias("weight"))


def _rule():
    """Language of a summary by marker words."""
    toks = T.token_array("summary")
    has = lambda *ws: F.exists(toks, lambda t: t.isin(*ws))
    return (F.when(has("the", "and", "of"), "en").when(has("der", "und", "die"), "de")
            .when(has("les", "des", "et"), "fr").otherwise("es"))


def _rule_predictions(spark, sf):
    """Rule classifier on summaries: language guessed from marker words."""
    labels = _lang_labels(spark, sf)
    recs = written(E.label_join(_summaries(spark, sf), labels))     # read by predictions, labels and the grid
    split = stratified_split(labels)
    test = split.where(F.col("fold") == "test").select(F.col("doc_id").cast("string").alias("resume_id"))
    preds = (recs.join(test, "resume_id", "left_semi")
             .select("model", F.col("resume_id").alias("doc_id"), F.col("category").alias("y_true"),
                     _rule().alias("y_pred")))
    return written(preds), recs


def q_confusion_matrix(spark, sf):
    preds, recs = _rule_predictions(spark, sf)
    return E.confusion(preds, recs)


def q_per_category_metrics(spark, sf):
    preds, recs = _rule_predictions(spark, sf)
    pc = E.per_category(preds, recs)
    return pc.select("model", "category", r6("precision").alias("precision"), r6("recall").alias("recall"),
                     r6("f1_score").alias("f1_score"), "support")


def q_overall_metrics(spark, sf):
    preds, recs = _rule_predictions(spark, sf)
    o = E.overall(E.per_category(preds, recs))
    return o.select("model", r6("accuracy").alias("accuracy"), r6("f1_weighted").alias("f1_weighted"),
                    r6("f1_macro").alias("f1_macro"))


def q_category_pivot(spark, sf):
    preds, recs = _rule_predictions(spark, sf)
    labels = sorted(r[0] for r in recs.select("category").distinct().collect())
    p = E.category_pivot(E.per_category(preds, recs), labels)
    return p.select("model", *[r6(c).alias(c) for c in labels])


def _unit_reports(spark, sf):
    """Overall rows (with the guards' errors) and per-category rows of many small evaluations.

    Every summariser is evaluated on the labelled documents of each language and source on their own, with one split for
    all. Such groups have a few documents: some have none in one fold, some no term that is frequent enough, and these
    fail by the evaluation's own guards.
    """
    docs = _docs(spark, sf)
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    labels = labelled.select("doc_id", F.col("lang").alias("category"))
    unit = docs.select(F.col("doc_id").cast("string").alias("resume_id"), F.concat(F.lit("@"), "lang", F.lit("/"), "source").alias("unit"))
    recs = written(E.label_join(_summaries(spark, sf), labels).join(unit, "resume_id")
                    .withColumn("model", F.concat("model", "unit")).drop("unit"))
    split = written(stratified_split(labels))
    fold = split.select(F.col("doc_id").cast("string").alias("resume_id"), "fold")
    _, vocab = E.tfidf(recs, fold.where(F.col("fold") == "train").select("resume_id"))
    errors = written(E.guards(recs, split, vocab))
    good = errors.where(F.col("error").isNull()).select("model")
    test = fold.where(F.col("fold") == "test").select("resume_id")
    preds = written(recs.join(good, "model", "left_semi").join(test, "resume_id", "left_semi")
                        .select("model", F.col("resume_id").alias("doc_id"), F.col("category").alias("y_true"), _rule().alias("y_pred")))
    per_category = E.per_category(preds, recs)
    ok = E.overall(per_category).withColumn("error", F.lit(None).cast("string"))
    bad = errors.where(F.col("error").isNotNull()).select(
        "model", *[F.lit(None).cast("double").alias(c) for c in ("accuracy", "f1_weighted", "f1_macro")], "error")
    return ok.unionByName(bad), per_category


def q_success_rows(spark, sf):
    o = files.success_rows(_unit_reports(spark, sf)[0])
    return o.select("model", r6("accuracy").alias("accuracy"), r6("f1_weighted").alias("f1_weighted"),
                    r6("f1_macro").alias("f1_macro"))


def q_error_rows(spark, sf):
    return files.error_rows(_unit_reports(spark, sf)[0])


def q_successful_categories(spark, sf):
    o, pc = _unit_reports(spark, sf)
    return files.successful_categories(pc, o).select("model", "category", r6("f1_score").alias("f1_score"), "support")


def q_router(spark, sf):
    """The requested models that exist, in requested order, over all documents."""
    return S.summarize(_docs(spark, sf), ROUTER_REQUEST, k=K)


def q_classify_summaries(spark, sf):
    recs = written(E.label_join(_summaries(spark, sf), _lang_labels(spark, sf)))
    split = written(stratified_split(recs, "resume_id"))
    res, _ = E.classify(recs, split)
    return res.select("model", r6("accuracy").alias("accuracy"), r6("f1_weighted").alias("f1_weighted"),
                      r6("f1_macro").alias("f1_macro"), "error")


def q_efficiency_report(spark, sf):
    """Event types of the data stand for models, event values for elapsed seconds; one requested model has no timing."""
    ev = table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("value").alias("elapsed_s"))
    models = (ev.select("model").distinct().select("model", F.lit("extractive").alias("type"))
              .unionByName(spark.createDataFrame([("bart", "abstractive")], "model string, type string")))
    rep = efficiency_report(models, ev)
    return rep.select("model", "type", "files_processed", r6("total_s").alias("total_s"),
                      r6("avg_s").alias("avg_s"), r6("min_s").alias("min_s"), r6("max_s").alias("max_s"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_text": q_clean_text,
    "segment_sections": q_segment_sections,
    "split_sentences": q_split_sentences,
    "tokenize_terms": q_tokenize_terms,
    "output_path": q_output_path,
    "summ_random": q_summ_random,
    "summ_luhn": q_summ_luhn,
    "summ_lsa_norm": q_summ_lsa_norm,
    "summ_lsa_rank": q_summ_lsa_rank,
    "summ_reduction": q_summ_reduction,
    "summ_textrank": q_summ_textrank,
    "summ_lexrank": q_summ_lexrank,
    "summ_kl": q_summ_kl,
    "sentence_graph_textrank": q_sentence_graph_textrank,
    "sentence_graph_lexrank": q_sentence_graph_lexrank,
    "model_doc_grid": q_model_doc_grid,
    "label_join": q_label_join,
    "stratified_split": q_stratified_split,
    "stratified_split_quality": q_stratified_split_quality,
    "tfidf_features": q_tfidf_features,
    "class_weights": q_class_weights,
    "confusion_matrix": q_confusion_matrix,
    "per_category_metrics": q_per_category_metrics,
    "overall_metrics": q_overall_metrics,
    "category_pivot": q_category_pivot,
    "classify_summaries": q_classify_summaries,
    "corpus_counts": q_corpus_counts,
    "success_rows": q_success_rows,
    "error_rows": q_error_rows,
    "successful_categories": q_successful_categories,
    "router": q_router,
    "efficiency_report": q_efficiency_report,
}
