"""Extractive summarisers (J1-J7), the neural batch hook (J8) and the router.

A document is one row, so an extractive summariser is a column of that row:
JVM expressions (random, lsa) or one Arrow pass for all the others together
(``docrank``). Only documents too large for one task are ranked by joins,
aggregations and windows over the sentence and token frames (the
``*_scores`` functions, ``kl_joined``); both give the same scores.

Scoring definitions follow the original papers (see README):
  luhn      max over clusters of significant words of (count^2 / span)
  lsa       norm of the sentence's term-frequency column (all topics kept)
  lsa_rank  the same in the space of the k strongest topics (block power iteration)
  textrank  PageRank over shared-word edges weighted by 1/(ln|Si| + ln|Sj|)
  lexrank   PageRank over tf-idf cosine edges above a threshold
  reduction sum of the sentence's TextRank edge weights
  kl        greedy minimisation of KL(document || summary), add-delta smoothed
  random    seeded md5 order
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from precis.functions.text import token_array
from precis.operators import docrank, graph
from precis.operators.sentences import named, sentences as split_sentences, tokens as split_tokens
from precis.operators.topk import SCORE_DP, assemble, rank_key, top_k
from precis.session import materialize, written

LUHN_MAX_GAP = 4        # insignificant words allowed inside a cluster
LUHN_MIN_FREQ = 2       # a word is significant when it occurs this often in its document
KL_DELTA = 1.0          # additive smoothing of the summary distribution
LSA_STEPS = 30          # steps of the block power iteration
DEFAULT_K = 3


class Corpus:
    """Documents (doc_id, text) and what the summarisers share; every frame is built when first asked for.

    ``sents`` and ``toks`` are the sentence and token frames (with ``persist`` the former is written to the checkpoint
    folder). Summarisers that rank whole documents in a row (``docrank.METHODS``, ``IN_ROW_KEYS``) are computed together,
    in one pass, for all names in ``together``.
    """

    def __init__(self, docs: DataFrame, persist: bool = False, together: tuple[str, ...] = ()):
        self.docs = docs
        self.persist = persist
        self.together = tuple(m for m in together if m in docrank.METHODS or m in IN_ROW_KEYS)
        self._shared: dict = {}

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", persist: bool = False,
           together: tuple[str, ...] = ()) -> "Corpus":
        return cls(docs.select(named(id_col, "doc_id"), named(text_col, "text")), persist, together)

    @cached_property
    def sents(self) -> DataFrame:
        s = split_sentences(self.docs)
        return materialize(s) if self.persist else s

    @cached_property
    def toks(self) -> DataFrame:
        return split_tokens(self.sents)

    @cached_property
    def has_giants(self) -> bool:
        return self.docs.where(docrank.giant("text")).limit(1).count() > 0

    @cached_property
    def giants(self) -> "Corpus":
        """The documents that are too large for one task; joins rank them."""
        return Corpus(self.docs.where(docrank.giant("text")), persist=True)

    @cached_property
    def rows(self) -> DataFrame:
        return self.docs.where(~docrank.giant("text")) if self.has_giants else self.docs

    def summaries(self, method: str, k: int, params: dict) -> DataFrame:
        """(doc_id, summary, elapsed_s) by a method that ranks a document in its row; documents without sentences go."""
        if method not in self.together:
            return self._ranked((method,), k, params).select("doc_id", F.col(method).alias("summary"), F.col(f"{method}_s").alias("elapsed_s"))
        return self._shared_pass(k, params).select("doc_id", F.col(method).alias("summary"), F.col(f"{method}_s").alias("elapsed_s"))

    def _shared_pass(self, k: int, params: dict) -> DataFrame:
        key = (k, tuple(sorted(params.items())))         # one pass per set of options
        if key not in self._shared:
            self._shared[key] = written(self._ranked(self.together, k, params))       # summaries only
        return self._shared[key]

    def by_key(self, method: str, k: int) -> DataFrame:
        """(doc_id, summary) by a method that is a mere expression of the sentence."""
        if method in self.together and any(m in docrank.METHODS for m in self.together):
            rows = self._shared_pass(k, PARAMS).select("doc_id", F.col(method).alias("summary"))
            return rows.unionByName(_pick_in_row(self.giants.docs, IN_ROW_KEYS[method], k)) if self.has_giants else rows
        return _pick_in_row(self.docs, IN_ROW_KEYS[method], k)

    @cached_property
    def ids(self) -> DataFrame:
        """(doc_id) of the non-empty documents, kept where several models need them."""
        ids = self.docs.where(F.length("text") > 0).select("doc_id")
        return materialize(ids) if self.together else ids

    def all_documents(self, summaries: DataFrame) -> DataFrame:
        """Every non-empty document gets a row; no sentence -> empty summary."""
        return self.ids.join(summaries, "doc_id", "left").select("doc_id", F.coalesce("summary", F.lit("")).alias("summary"))

    def every_summary(self, models: list[str], k: int) -> DataFrame:
        """(model, doc_id, summary) of all non-empty documents by models of the shared pass: one join for all of them."""
        if self.has_giants or not set(models) <= set(self.together):
            parts = [self.all_documents(EXTRACTIVE[m](self, k)).select(F.lit(m).alias("model"), "doc_id", "summary") for m in models]
            return reduce(DataFrame.unionByName, parts)
        # the pass is read here only: it goes into the join, not to a table first
        wide = self.docs.where(F.length("text") > 0).select("doc_id").join(
            self._ranked(self.together, k, PARAMS).select("doc_id", *models), "doc_id", "left")
        each = F.array(*[F.struct(F.lit(m).alias("model"), F.coalesce(m, F.lit("")).alias("summary")) for m in models])
        return wide.select("doc_id", F.explode(each).alias("s")).select("s.model", "doc_id", "s.summary")

    def _ranked(self, methods: tuple[str, ...], k: int, params: dict) -> DataFrame:
        ranked = tuple(m for m in methods if m in docrank.METHODS or m == "lsa")
        keys = [m for m in methods if m not in ranked]
        rows = docrank.picked(self.rows, ranked, decimals=SCORE_DP, **{**params, "k": k})
        return rows.select("doc_id", *[docrank.joined_sentences(F.col("sents"), F.col(f"picked.{m}")).alias(m) for m in ranked],
                           *[F.col(f"picked.{m}_s").alias(f"{m}_s") for m in ranked],
                           *[_best_by_key(F.col("sents"), IN_ROW_KEYS[m], k).alias(m) for m in keys])

    @cached_property
    def apart(self) -> DataFrame:
        """(doc_id) of the documents whose sentence pairs aren't made in a row: giants, and ids of several documents."""
        ids = self.docs.where(F.length("text") > 0).groupBy("doc_id").agg(
            (F.bool_or(docrank.giant("text")) | (F.count(F.lit(1)) > 1)).alias("apart"))
        return written(ids.where(F.col("apart") & F.col("doc_id").isNotNull()).select("doc_id"))

    def pairs(self, kind: str, by_joins: Callable[["Corpus"], DataFrame]) -> DataFrame:
        """Sentence pairs of every document: made in its row; of the documents ``apart``, if any, by joins."""
        docs = self.docs.where(F.col("doc_id").isNotNull())
        if self.apart.isEmpty():
            return docrank.pairs(docs, kind)
        rest = Corpus(docs.join(self.apart, "doc_id", "left_semi"), persist=True)
        return docrank.pairs(docs.join(self.apart, "doc_id", "left_anti"), kind).unionByName(by_joins(rest))


def _with_zero(sents: DataFrame, scores: DataFrame) -> DataFrame:
    """Every sentence with its score (0 when it produced none)."""
    return (sents.join(scores, ["doc_id", "sent_id"], "left")
            .select("doc_id", "sent_id", "sentence", F.coalesce("score", F.lit(0.0)).alias("score")))


def _pick(sents: DataFrame, scores: DataFrame, k: int, descending: bool = True) -> DataFrame:
    """The k best sentences per document, assembled."""
    return assemble(top_k(_with_zero(sents, scores), k, rank_key("score", descending)))


def _best_by_key(sents, key: Callable, k: int):
    """The k sentences with the smallest (key(sentence), sent_id), in document order."""
    keyed = F.transform(sents, lambda s: F.struct(key(s).alias("key"), s["sent_id"].alias("sent_id"), s["sentence"].alias("sentence")))
    best = F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: F.struct(s["sent_id"], s["sentence"]))
    return F.array_join(F.transform(F.array_sort(best), lambda s: s["sentence"]), " ")


def _pick_in_row(docs: DataFrame, key: Callable, k: int) -> DataFrame:
    """(doc_id, summary) from the k sentences with the smallest (key(sentence), sent_id); one expression per document."""
    return (docs.select("doc_id", _best_by_key(docrank.sentence_structs(F.col("text")), key, k).alias("summary"))
            .where(F.col("summary") != ""))


def _lsa_key(s):
    """All topics kept: minus the norm of the sentence's term counts, from runs in its sorted tokens."""
    zero = F.struct(F.lit("").alias("w"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("t"))
    runs = F.aggregate(F.array_sort(token_array(s["sentence"])), zero, lambda a, w: F.struct(
        w.alias("w"), F.when(a["w"] == w, a["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"),
        F.when(a["w"] == w, a["t"]).otherwise(a["t"] + a["n"] * a["n"]).alias("t")))
    return -F.round(F.sqrt(F.aggregate(F.array(runs), F.lit(0).cast("long"), lambda a, r: r["t"] + r["n"] * r["n"])
                           .cast("double")), SCORE_DP)


def _random_key(seed: int) -> Callable:
    """Seeded md5 of (doc_id, sent_id)."""
    return lambda s: F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), s["sent_id"].cast("string"), F.lit(str(seed))))


RANDOM_SEED = 42
IN_ROW_KEYS: dict[str, Callable] = {"lsa": _lsa_key, "random": _random_key(RANDOM_SEED)}      # the smallest key is best

PARAMS = {"iterations": 20, "damping": graph.DAMPING, "threshold": graph.LEXRANK_THRESHOLD, "delta": KL_DELTA,
          "min_freq": LUHN_MIN_FREQ, "max_gap": LUHN_MAX_GAP, "topics": None, "steps": LSA_STEPS}      # no topics named: k


def ranked_in_rows(c: Corpus, method: str, k: int, by_joins: Callable[[Corpus], DataFrame], **params) -> DataFrame:
    """(doc_id, summary, elapsed_s): documents ranked in their rows; too large ones (if any) by joins, without a clock."""
    out = c.summaries(method, k, {**PARAMS, **params})
    if c.has_giants:
        out = out.unionByName(by_joins(c.giants).withColumn("elapsed_s", F.lit(None).cast("double")))
    return out


# --------------------------------------------------------------------- scores
def luhn_scores(c: Corpus) -> DataFrame:
    # word counts are pre-aggregated map-side, then joined back: a hot
    # (doc, word) key is split by AQE's skew join instead of one window task
    freq = (c.toks.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("freq"))
            .where(F.col("freq") >= LUHN_MIN_FREQ).select("doc_id", "word"))
    sig = c.toks.join(freq, ["doc_id", "word"], "left_semi").select("doc_id", "sent_id", "pos")
    ws = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(ws) - 1
    clusters = (sig.withColumn("brk", F.when(gap <= LUHN_MAX_GAP, 0).otherwise(1))
                .withColumn("cid", F.sum("brk").over(ws.rowsBetween(Window.unboundedPreceding, 0))))
    per_cluster = (clusters.groupBy("doc_id", "sent_id", "cid")
                   .agg((F.count(F.lit(1)) * F.count(F.lit(1))
                         / (F.max("pos") - F.min("pos") + 1)).alias("sc")))
    return per_cluster.groupBy("doc_id", "sent_id").agg(F.max("sc").alias("score"))


def lsa_scores(c: Corpus) -> DataFrame:
    tf = c.toks.groupBy("doc_id", "sent_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    return tf.groupBy("doc_id", "sent_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("score"))


def lsa_rank_scores(c: Corpus, topics: int = DEFAULT_K, steps: int = LSA_STEPS) -> DataFrame:
    """J2 with ``topics`` latent dimensions, over (doc, sent, word) rows.

    Block power iteration: a step takes the columns v (per sentence) to the words and back, two joins with the sparse
    counts, and makes them orthonormal by one aggregate row per document, the columns' inner products (Cholesky factor).
    The score is the length of A V v_k, from the inner products of the columns A V.
    """
    v, u = [f"v{i}" for i in range(topics)], [f"u{i}" for i in range(topics)]
    pairs = [(i, j) for i in range(topics) for j in range(i + 1)]
    tf = written(c.toks.groupBy("doc_id", "sent_id", "word").agg(F.count(F.lit(1)).cast("double").alias("tf")))
    least = tf.groupBy("doc_id").agg((F.sum(F.col("tf") * F.col("tf")) * docrank.NO_TOPIC).alias("least"))
    md5 = lambda i: F.substring(F.md5(F.concat(F.lit(f"{i}:"), "word").cast("binary")), 1, 8)
    start = tf.select("doc_id", "word").distinct().select(
        "doc_id", "word", *[(F.conv(md5(i), 16, 10).cast("double") / 2.0 ** 32 - 0.5).alias(u[i]) for i in range(topics)])

    def words(columns):
        return tf.join(columns, ["doc_id", "sent_id"]).groupBy("doc_id", "word").agg(
            *[F.sum(F.col("tf") * F.col(a)).alias(b) for a, b in zip(v, u)])

    def nodes(columns):
        return tf.join(columns, ["doc_id", "word"]).groupBy("doc_id", "sent_id").agg(
            *[F.sum(F.col("tf") * F.col(b)).alias(a) for a, b in zip(v, u)])

    def products(columns, names):
        return columns.groupBy("doc_id").agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in pairs])

    columns = written(nodes(start))
    for _ in range(steps):
        columns = written(nodes(words(columns)))
        factor = products(columns, v).join(least, "doc_id")
        for i, j in pairs:                                   # m becomes its Cholesky factor l; l_ii = 0 where no topic is left
            rest = F.col(f"m{i}_{j}")
            for d in range(j):
                rest = rest - F.col(f"l{i}_{d}") * F.col(f"l{j}_{d}")
            entry = (F.when(F.sqrt(F.greatest(rest, F.lit(0.0))) > F.col("least"), F.sqrt(F.greatest(rest, F.lit(0.0)))) if i == j
                     else F.when(F.col(f"l{j}_{j}") > 0, rest / F.col(f"l{j}_{j}")))
            factor = factor.withColumn(f"l{i}_{j}", F.coalesce(entry, F.lit(0.0)))
        columns = columns.join(factor, "doc_id")
        for i in range(topics):
            rest = F.col(v[i])
            for d in range(i):
                rest = rest - F.col(f"l{i}_{d}") * F.col(v[d])
            columns = columns.withColumn(v[i], F.when(F.col(f"l{i}_{i}") > 0, rest / F.col(f"l{i}_{i}")).otherwise(0.0))
        columns = columns.select("doc_id", "sent_id", *v)
    columns = written(columns)
    square = F.lit(0.0)
    for i, j in pairs:
        square = square + (1.0 if i == j else 2.0) * F.col(v[i]) * F.col(v[j]) * F.col(f"m{i}_{j}")
    return columns.join(products(words(columns), u), "doc_id").select("doc_id", "sent_id", F.sqrt(F.greatest(square, F.lit(0.0))).alias("score"))


def reduction_scores(c: Corpus) -> DataFrame:
    """Sum of a sentence's TextRank edge weights, without forming the pairs.

    The sum over other sentences j that share a word of 1 / (ln Li + ln Lj)
    depends on the word and on Lj only: incidence rows meet a histogram of
    sentence lengths per (doc, word), and the sentence's own entry is taken
    out of its length's count.
    """
    inc = materialize(c.toks.groupBy("doc_id", "sent_id")
                      .agg(F.count(F.lit(1)).alias("n"), F.collect_set("word").alias("words"))
                      .select("doc_id", "sent_id", "n", F.explode("words").alias("word")))
    lengths = inc.groupBy("doc_id", "word", F.col("n").alias("m")).agg(F.count(F.lit(1)).alias("k"))
    den = F.log(F.col("n").cast("double")) + F.log(F.col("m").cast("double"))
    others = F.col("k") - F.when(F.col("n") == F.col("m"), 1).otherwise(0)
    return (inc.join(lengths, ["doc_id", "word"]).where(others > 0)
            .groupBy("doc_id", "sent_id").agg(F.sum(F.when(den > 0, others / den).otherwise(0.0)).alias("score")))


def textrank_scores(c: Corpus, iterations: int = 20, damping: float = graph.DAMPING) -> DataFrame:
    return graph.histogram_rank(c.sents, c.toks, reduction_scores(c), iterations, damping)


def lexrank_scores(c: Corpus, iterations: int = 20, damping: float = graph.DAMPING,
                   threshold: float = graph.LEXRANK_THRESHOLD) -> DataFrame:
    e = (graph.lexrank_edges_above(c.sents, c.toks, threshold)
         .select("doc_id", "src", "dst", F.lit(1.0).alias("w")))
    return graph.power_rank(c.sents.select("doc_id", "sent_id"), e, iterations, damping)


# ---------------------------------------------------------------- summarisers
def luhn_timed(c: Corpus, k: int = DEFAULT_K) -> DataFrame:
    return ranked_in_rows(c, "luhn", k, lambda g: _pick(g.sents, luhn_scores(g), k))


def luhn(c: Corpus, k: int = DEFAULT_K) -> DataFrame:
    return luhn_timed(c, k).drop("elapsed_s")


def lsa(c: Corpus, k: int = DEFAULT_K) -> DataFrame:
    """All topics kept: norm of the sentence's term counts."""
    return c.by_key("lsa", k)


def lsa_rank_timed(c: Corpus, k: int = DEFAULT_K, topics: int | None = None, steps: int = LSA_STEPS) -> DataFrame:
    """The ``topics`` (default: k) strongest topics kept."""
    return ranked_in_rows(c, "lsa_rank", k, lambda g: _pick(g.sents, lsa_rank_scores(g, topics or k, steps), k),
                          topics=topics, steps=steps)


def lsa_rank(c: Corpus, k: int = DEFAULT_K, topics: int | None = None, steps: int = LSA_STEPS) -> DataFrame:
    return lsa_rank_timed(c, k, topics, steps).drop("elapsed_s")


def reduction_timed(c: Corpus, k: int = DEFAULT_K) -> DataFrame:
    return ranked_in_rows(c, "reduction", k, lambda g: _pick(g.sents, reduction_scores(g), k))


def reduction(c: Corpus, k: int = DEFAULT_K) -> DataFrame:
    return reduction_timed(c, k).drop("elapsed_s")


def textrank_timed(c: Corpus, k: int = DEFAULT_K, iterations: int = 20) -> DataFrame:
    return ranked_in_rows(c, "textrank", k, lambda g: _pick(g.sents, textrank_scores(g, iterations), k), iterations=iterations)


def textrank(c: Corpus, k: int = DEFAULT_K, iterations: int = 20) -> DataFrame:
    return textrank_timed(c, k, iterations).drop("elapsed_s")


def lexrank_timed(c: Corpus, k: int = DEFAULT_K, iterations: int = 20) -> DataFrame:
    return ranked_in_rows(c, "lexrank", k, lambda g: _pick(g.sents, lexrank_scores(g, iterations), k), iterations=iterations)


def lexrank(c: Corpus, k: int = DEFAULT_K, iterations: int = 20) -> DataFrame:
    return lexrank_timed(c, k, iterations).drop("elapsed_s")


def random(c: Corpus, k: int = DEFAULT_K, seed: int = RANDOM_SEED) -> DataFrame:
    """Lowest seeded md5 of (doc_id, sent_id)."""
    return c.by_key("random", k) if seed == RANDOM_SEED else _pick_in_row(c.docs, _random_key(seed), k)


def kl_timed(c: Corpus, k: int = DEFAULT_K, delta: float = KL_DELTA) -> DataFrame:
    return ranked_in_rows(c, "kl", k, lambda g: kl_joined(g, k, delta), delta=delta)


def kl(c: Corpus, k: int = DEFAULT_K, delta: float = KL_DELTA) -> DataFrame:
    return kl_timed(c, k, delta).drop("elapsed_s")


def kl_joined(c: Corpus, k: int = DEFAULT_K, delta: float = KL_DELTA) -> DataFrame:
    """Greedy KL-Sum by joins, one round per summary sentence (k is small: unrolled).

    Round objective for candidate s given the chosen set S (S' = S + s):
      J(s) = ln(N_S' + delta*V) - sum_{w in s} P_D(w) * [ln(c_S'(w)+delta) - ln(c_S(w)+delta)]
    which equals KL(P_D || P_S') minus a per-document constant, with
    P_S'(w) = (c_S'(w)+delta) / (N_S' + delta*V). The lowest J wins (ties: sent_id).
    """
    tf = materialize(c.toks.groupBy("doc_id", "sent_id", "word").agg(F.count(F.lit(1)).alias("cs")))   # read every round
    dw = tf.groupBy("doc_id", "word").agg(F.sum("cs").alias("cd"))
    dstat = dw.groupBy("doc_id").agg(F.sum("cd").alias("nd"), F.count(F.lit(1)).alias("v"))
    pd_ = dw.join(dstat, "doc_id").select("doc_id", "word", (F.col("cd") / F.col("nd")).alias("pd"))
    cand_terms = materialize(tf.join(pd_, ["doc_id", "word"]))                # (doc, sent, word, cs, pd)
    ns = tf.groupBy("doc_id", "sent_id").agg(F.sum("cs").alias("ns"))
    base = materialize(c.sents.select("doc_id", "sent_id").join(ns, ["doc_id", "sent_id"], "left")
                       .join(dstat.select("doc_id", "v"), "doc_id", "left")
                       .select("doc_id", "sent_id", F.coalesce("ns", F.lit(0)).alias("ns"),
                               F.coalesce("v", F.lit(0)).alias("v")))
    chosen = None                                                       # (doc_id, sent_id, rnd)
    for rnd in range(k):
        if chosen is None:
            s_counts = None
            cand = base
        else:
            s_counts = (tf.join(chosen.select("doc_id", "sent_id"), ["doc_id", "sent_id"])
                        .groupBy("doc_id", "word").agg(F.sum("cs").alias("sel_c")))
            n_s = chosen.join(base, ["doc_id", "sent_id"]).groupBy("doc_id").agg(F.sum("ns").alias("sel_n"))
            cand = base.join(chosen.select("doc_id", "sent_id"), ["doc_id", "sent_id"], "left_anti")
        terms = cand_terms if s_counts is None else cand_terms.join(s_counts, ["doc_id", "word"], "left")
        c_s = F.lit(0.0) if s_counts is None else F.coalesce(F.col("sel_c"), F.lit(0)).cast("double")
        gain = (terms.groupBy("doc_id", "sent_id")
                .agg(F.sum(F.col("pd") * (F.log(c_s + F.col("cs") + delta) - F.log(c_s + delta)))
                     .alias("gain")))
        scored = cand.join(gain, ["doc_id", "sent_id"], "left")
        n_prev = F.lit(0) if chosen is None else F.coalesce(F.col("sel_n"), F.lit(0))
        if chosen is not None:
            scored = scored.join(n_s, "doc_id", "left")
        j = F.when(F.col("v") > 0,
                   F.log(n_prev + F.col("ns") + F.lit(delta) * F.col("v")) - F.coalesce("gain", F.lit(0.0))
                   ).otherwise(F.lit(0.0))
        # argmin per document as an aggregate (partial aggregation, no sort):
        # ordering key (rounded score, sent_id) breaks ties by document order
        key = F.struct(F.round(j, 9).alias("s"), F.col("sent_id").alias("i"))
        best = (scored.groupBy("doc_id").agg(F.min_by("sent_id", key).alias("sent_id"))
                .select("doc_id", "sent_id", F.lit(rnd).alias("rnd")))
        chosen = materialize(best if chosen is None else chosen.unionByName(best))   # one plan per round
    return assemble(chosen.join(c.sents, ["doc_id", "sent_id"]).select("doc_id", "sent_id", "sentence"))


# ---------------------------------------------------------- neural batch hook
def abstractive_timed(docs: DataFrame, model: str, make_predict_fn: Callable, input_max_length: int = 1024,
                      summary_max_length: int = 150, batch_size: int = 8) -> DataFrame:
    """Batched seq2seq inference; (doc_id, summary, error, elapsed_s) per non-empty document.

    ``make_predict_fn(model, min_length, max_length)`` is called once per
    Python worker (``predict_batch_udf`` keeps the model between tasks) and
    must return ``fn(np.ndarray[str]) -> np.ndarray[str]``. The task prefix
    (B7) and word truncation (B8) run JVM-side, so Arrow ships only the
    truncated input, sorted by length within a partition: the texts of a batch
    need little padding. A batch that fails is tried again row by row: only
    the failing documents get an empty summary and an error. ``elapsed_s`` is
    the time of the document's call (an equal share of its batch).
    """
    from pyspark.ml.functions import predict_batch_udf

    from precis.functions.text import generation_bounds, task_prefix, truncate_words

    lo, hi = generation_bounds(summary_max_length)

    def load():
        import time

        import numpy as np

        fn = make_predict_fn(model, lo, hi)

        def call(texts):
            t0 = time.perf_counter()
            out = [("" if o is None else str(o)).strip() for o in fn(np.array(texts, dtype=object))]
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} summaries for {len(texts)} texts")
            each = (time.perf_counter() - t0) / len(texts)
            return [(o, None, each) for o in out]

        def alone(text):
            try:
                return call([text])[0]
            except Exception as exc:
                return "", f"{type(exc).__name__}: {exc}", np.nan

        def predict(batch):
            texts = batch.tolist()
            try:
                rows = call(texts)
            except Exception:
                rows = [alone(t) for t in texts]
            summary, error, seconds = zip(*rows)
            return {"summary": np.array(summary, dtype=object), "error": np.array(error, dtype=object), "elapsed_s": np.array(seconds)}

        return predict

    returns = StructType.fromDDL("summary string, error string, elapsed_s double")
    generated = predict_batch_udf(load, return_type=returns, batch_size=batch_size)
    inp = truncate_words(task_prefix(F.lit(model), F.col("text")), input_max_length)
    rows = (docs.where(F.length("text") > 0).select("doc_id", inp.alias("text"))
            .sortWithinPartitions(F.length("text")).select("doc_id", generated("text").alias("g")))
    return rows.select("doc_id", "g.summary", "g.error", F.nanvl("g.elapsed_s", F.lit(None).cast("double")).alias("elapsed_s"))


def abstractive(docs: DataFrame, model: str, make_predict_fn: Callable, input_max_length: int = 1024,
                summary_max_length: int = 150, batch_size: int = 8) -> DataFrame:
    """(doc_id, summary); documents that fail get "" (reference behaviour)."""
    return abstractive_timed(docs, model, make_predict_fn, input_max_length, summary_max_length,
                             batch_size).select("doc_id", "summary")


# --------------------------------------------------------------------- router
TIMED: dict[str, Callable[..., DataFrame]] = {       # (doc_id, summary, elapsed_s): clocks of the ranking itself
    "luhn": luhn_timed, "lexrank": lexrank_timed, "textrank": textrank_timed, "kl": kl_timed, "reduction": reduction_timed,
    "lsa_rank": lsa_rank_timed,
}
EXTRACTIVE: dict[str, Callable[..., DataFrame]] = {
    "luhn": luhn, "lsa": lsa, "lexrank": lexrank, "textrank": textrank,
    "kl": kl, "reduction": reduction, "random": random, "lsa_rank": lsa_rank,
}
ABSTRACTIVE: dict[str, Callable] = {}


def register(name: str, fn: Callable, kind: str = "extractive") -> None:
    """Add a summariser to the registry (the reference's only extension point)."""
    (EXTRACTIVE if kind == "extractive" else ABSTRACTIVE)[name] = fn


def available_models() -> list[str]:
    return list(EXTRACTIVE) + list(ABSTRACTIVE)


def model_type(name: str) -> str:
    return "abstractive" if name in ABSTRACTIVE else "extractive"


def summarize(docs: DataFrame, models: list[str], k: int = DEFAULT_K, id_col: str = "doc_id",
              text_col: str = "text", input_max_length: int = 1024, summary_max_length: int = 150,
              **opts) -> DataFrame:
    """(model, doc_id, summary) for the requested models that exist (C4).

    Requested order is kept; unknown names are skipped and none at all
    raises. One plan per model, unioned; they share the cached corpus frames.
    """
    chosen = [m for m in models if m in EXTRACTIVE or m in ABSTRACTIVE]
    if not chosen:
        raise ValueError(f"none of the requested models is available: {models}")
    corpus = Corpus.of(docs, id_col, text_col, persist=len(chosen) > 1, together=tuple(chosen))   # shared by every model
    out = None
    for m in chosen:
        if m in EXTRACTIVE:
            part = corpus.all_documents(EXTRACTIVE[m](corpus, k, **opts.get(m, {})))
        else:
            part = abstractive(corpus.docs, m, ABSTRACTIVE[m], input_max_length, summary_max_length)
        part = part.select(F.lit(m).alias("model"), "doc_id", "summary")
        out = part if out is None else out.unionByName(part)
    return out
