"""Sentence graphs (D8) and power iteration (J-rank) as joins, for edge frames and for very large documents.

Edges come from an equi-join of (doc, word) incidence rows, so only sentence
pairs that share a word are ever formed; the pair rows are combined by a
partial aggregation on (doc, src, dst) before they are shuffled. The rank
iteration is a join and an aggregation per step over (doc, sentence) keys, so
one document's rows are spread over tasks. Documents of ordinary size are
ranked in their rows instead (``docrank``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis.session import materialize, written

DAMPING = 0.85
LEXRANK_THRESHOLD = 0.1


HOT_KEY_ROWS = 1024     # (doc, word) groups larger than this are salted in the pair join


def _pairs(incidence: DataFrame, value_cols: list[str], hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Self-join of (doc_id, sent_id, word, ...) on (doc_id, word) with src < dst.

    Hot keys are split, exactly: a (doc, word) group of k rows gets
    n = ceil(k / hot_rows) salts; each left row takes one salt (hash of its
    sentence) and each right row is replicated once per salt, so every pair
    is still formed exactly once but by n tasks instead of one. Ordinary
    keys (n = 1) are not replicated.
    """
    sizes = incidence.groupBy("doc_id", "word").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(hot_rows)).cast("int").alias("n_salt"))
    # read by both sides of the join: computed once
    inc = materialize(incidence.join(sizes, ["doc_id", "word"]))
    a = inc.select("doc_id", "word", F.pmod(F.xxhash64("sent_id"), F.col("n_salt")).cast("int").alias("salt"),
                   F.col("sent_id").alias("src"), *[F.col(c).alias(f"{c}_a") for c in value_cols])
    b = inc.select("doc_id", "word", F.explode(F.sequence(F.lit(0), F.col("n_salt") - 1)).alias("salt"),
                   F.col("sent_id").alias("dst"), *[F.col(c).alias(f"{c}_b") for c in value_cols])
    return a.join(b, ["doc_id", "word", "salt"]).where(F.col("src") < F.col("dst")).drop("salt")


def textrank_edges(toks: DataFrame) -> DataFrame:
    """(doc_id, src, dst, shared, weight) for sentence pairs sharing >= 1 word.

    weight = shared distinct words / (ln|S_src| + ln|S_dst|), |S| = token count;
    a zero denominator (two one-token sentences) gives weight 0.
    """
    # one aggregation per sentence gives both its length and its distinct words
    # (a sentence is a bounded group); the incidence rows are then generated
    incidence = (toks.groupBy("doc_id", "sent_id")
                 .agg(F.count(F.lit(1)).alias("n_tok"), F.collect_set("word").alias("words"))
                 .select("doc_id", "sent_id", "n_tok", F.explode("words").alias("word")))
    pairs = (_pairs(incidence, ["n_tok"])
             .groupBy("doc_id", "src", "dst", "n_tok_a", "n_tok_b")
             .agg(F.count(F.lit(1)).alias("shared")))
    den = F.log(F.col("n_tok_a").cast("double")) + F.log(F.col("n_tok_b").cast("double"))
    return pairs.select("doc_id", "src", "dst", "shared",
                        F.when(den > 0, F.col("shared") / den).otherwise(F.lit(0.0)).alias("weight"))


def lexrank_edges(sents: DataFrame, toks: DataFrame) -> DataFrame:
    """(doc_id, src, dst, cosine): tf-idf cosine of sentence pairs sharing a word
    of non-zero idf (pairs whose only shared words occur in every sentence have
    cosine 0 and are not emitted).

    idf is computed over the sentences of the document: ln(n_sent / sf).
    """
    u = unit_vectors(sents, toks)
    return (_pairs(u, ["u"]).groupBy("doc_id", "src", "dst")
            .agg(F.sum(F.col("u_a") * F.col("u_b")).alias("cosine")))


def unit_vectors(sents: DataFrame, toks: DataFrame) -> DataFrame:
    """(doc_id, sent_id, word, u): tf-idf sentence vectors of length 1, words of idf 0 left out."""
    tf = toks.groupBy("doc_id", "sent_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    n_sent = sents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sent"))
    sf = tf.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("sf"))
    v = (tf.join(sf, ["doc_id", "word"]).join(n_sent, "doc_id")
         .select("doc_id", "sent_id", "word",
                 (F.col("tf") * F.log(F.col("n_sent") / F.col("sf"))).alias("v")))
    norm = v.groupBy("doc_id", "sent_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nrm"))
    # unit-length sentence vectors: the pair aggregate is the cosine itself, so
    # the (large) edge rows need no join with the norms afterwards. Words found
    # in every sentence of a document have idf 0, add nothing to a dot product
    # and are left out of the self-join (its hottest keys).
    return (v.where(F.col("v") > 0).join(norm, ["doc_id", "sent_id"])
            .select("doc_id", "sent_id", "word", (F.col("v") / F.col("nrm")).alias("u")))


def lexrank_edges_above(sents: DataFrame, toks: DataFrame, threshold: float = LEXRANK_THRESHOLD) -> DataFrame:
    """(doc_id, src, dst, cosine) of the pairs with cosine > threshold, by a bounded similarity join.

    A sentence's words are taken from the most to the least common of its document. As long as the running sum of
    u * (largest u of the word in the document) stays below the threshold, sentences that share only these words cannot
    reach it, so these words aren't indexed. The rarest common word of a pair above the threshold is indexed for both
    sentences: candidates come from a self-join of the indexed words alone and are compared exactly afterwards.
    """
    u = materialize(unit_vectors(sents, toks))
    found = _pairs(indexed_words(u, threshold), []).select("doc_id", "src", "dst").distinct()
    a = u.select("doc_id", F.col("sent_id").alias("src"), "word", F.col("u").alias("u_a"))
    b = u.select("doc_id", F.col("sent_id").alias("dst"), "word", F.col("u").alias("u_b"))
    return (found.join(a, ["doc_id", "src"]).join(b, ["doc_id", "dst", "word"])
            .groupBy("doc_id", "src", "dst").agg(F.sum(F.col("u_a") * F.col("u_b")).alias("cosine"))
            .where(F.col("cosine") > threshold))


def indexed_words(u: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, sent_id, word): the words of each sentence that the bounded join has to look at."""
    words = u.groupBy("doc_id", "word").agg(F.max("u").alias("largest"), F.count(F.lit(1)).alias("sf"))
    order = Window.partitionBy("doc_id", "sent_id").orderBy(F.col("sf").desc(), "word")       # one sentence
    upto = F.sum(F.col("u") * F.col("largest")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (u.join(words, ["doc_id", "word"]).withColumn("upto", upto).where(F.col("upto") >= threshold - 1e-9)
            .select("doc_id", "sent_id", "word"))


def _next_rank(rank: DataFrame, moved: DataFrame, damping: float) -> DataFrame:
    """One PageRank step: ``rank`` (doc_id, sent_id, n, out, r), ``moved`` (doc_id, sent_id, c)."""
    lost = (rank.where(F.col("out") <= 0).groupBy("doc_id").agg(F.sum("r").alias("lost")))
    return (rank.join(moved, ["doc_id", "sent_id"], "left").join(lost, "doc_id", "left")
            .select("doc_id", "sent_id", "n", "out",
                    ((1.0 - damping) / F.col("n") + damping * (
                        F.when(F.col("out") > 0, F.coalesce("c", F.lit(0.0))).otherwise(0.0)
                        + F.coalesce("lost", F.lit(0.0)) / F.col("n"))).alias("r")))


def _start(nodes: DataFrame, out: DataFrame) -> DataFrame:
    n = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return written(nodes.join(n, "doc_id").join(out, ["doc_id", "sent_id"], "left")
                       .select("doc_id", "sent_id", "n", F.coalesce("out", F.lit(0.0)).alias("out"),
                               (1.0 / F.col("n")).alias("r")))


def power_rank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = DAMPING) -> DataFrame:
    """J-rank: (doc_id, sent_id, score) by weighted PageRank per document, over edge rows.

    ``nodes``: (doc_id, sent_id); ``edges``: undirected (doc_id, src, dst, w) with w > 0.
    r0 = 1/n; r' = (1-d)/n + d * (sum_j r_j w_ji / out_j + dangling_mass / n).

    A step joins the directed edges with the ranks on (doc_id, src) and adds up by (doc_id, dst), so the edges of one
    document are spread over tasks. Ranks are written to the checkpoint folder every step: the plan of a step stays small.
    """
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    directed = written(edges.where(F.col("w") > 0).select("doc_id", "w", both.alias("e"))
                           .select("doc_id", "e.src", "e.dst", "w"))
    out = directed.groupBy("doc_id", F.col("src").alias("sent_id")).agg(F.sum("w").alias("out"))
    rank = _start(nodes.select("doc_id", "sent_id"), out)
    for _ in range(iterations):
        x = rank.where(F.col("out") > 0).select("doc_id", F.col("sent_id").alias("src"), (F.col("r") / F.col("out")).alias("x"))
        moved = (directed.join(x, ["doc_id", "src"]).groupBy("doc_id", F.col("dst").alias("sent_id"))
                 .agg(F.sum(F.col("w") * F.col("x")).alias("c")))
        rank = written(_next_rank(rank, moved, damping))
    return rank.select("doc_id", "sent_id", F.col("r").alias("score"))


def histogram_rank(sents: DataFrame, toks: DataFrame, out: DataFrame, iterations: int = 20,
                   damping: float = DAMPING) -> DataFrame:
    """TextRank without pairs: (doc_id, sent_id, score); ``out``: (doc_id, sent_id, score) sums of edge weights.

    A shared word adds 1 / (ln Li + ln Lj) to an edge, so what a sentence receives depends on the word, its own length
    and, per length of the others, on the sum of r / out: a step adds x = r / out up by (doc_id, word, length) and joins
    the incidence rows with these sums, taking the sentence's own x out of its length's sum.
    """
    inc = written(toks.groupBy("doc_id", "sent_id").agg(F.count(F.lit(1)).alias("n_tok"), F.collect_set("word").alias("words"))
                      .select("doc_id", "sent_id", "n_tok", F.explode("words").alias("word")))
    rank = _start(sents.select("doc_id", "sent_id"), out.select("doc_id", "sent_id", F.col("score").alias("out")))
    den = F.log(F.col("n_tok").cast("double")) + F.log(F.col("m").cast("double"))
    own = F.when(F.col("n_tok") == F.col("m"), F.col("x")).otherwise(0.0)
    for _ in range(iterations):
        x = rank.where(F.col("out") > 0).select("doc_id", "sent_id", (F.col("r") / F.col("out")).alias("x"))
        sent = inc.join(x, ["doc_id", "sent_id"])
        sums = sent.groupBy("doc_id", "word", F.col("n_tok").alias("m")).agg(F.sum("x").alias("sx"))
        moved = (sent.join(sums, ["doc_id", "word"]).groupBy("doc_id", "sent_id")
                 .agg(F.sum(F.when(den > 0, (F.col("sx") - own) / den).otherwise(0.0)).alias("c")))
        rank = written(_next_rank(rank, moved, damping))
    return rank.select("doc_id", "sent_id", F.col("r").alias("score"))
