"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

1. Each labeller looks at one statistic of a text and votes good, bad or abstains (``LABELLERS``: below / above two
   bounds). Every document is labelled; the votes are counted by pattern (at most 3 ** labellers rows).
2. Bad documents come in kinds, so the latent class is good or one kind per labeller. Expectation-maximisation over the
   patterns estimates how often each labeller, when it votes, votes bad in each class (its accuracy), and the classes'
   shares. A pattern's posterior of good is the weak label of its documents. Short texts, on which all abstain, get the
   share of good documents.
3. Posteriors train a logistic regression over hashed features (words in lower case, word shapes, immediate repeats;
   square roots of shares of a text's words), on a bounded sample: the ``FIT_DOCS`` documents with the smallest hash of id and text.
4. The scorer judges every document; below ``ACCEPT`` it is rejected.

Null, empty or wordless texts: score 0, rejected. Repeated rows get equal scores. Very long texts are read whole, in
slices of a batch. Empty table: no rows. Labels of the corpus are never read (tests use them as held-out truth).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import cut

FIT_DOCS = 8_000
ENOUGH = 12
MAX_FALSE = 0.05
MIN_HIT = 0.9
BITS = 16
ACCEPT = 0.5
SEED = 42
SLICE_CHARS = 2_000_000
#: Frequent function words of the corpus' languages.
FUNCTION_WORDS = frozenset("""
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son
el que y los del las por con no una su para al lo como más o pero sus le ha me si sin sobre este
""".split())
#: statistic, bound of good, bound of bad: good at or beyond the first, bad at or beyond the second, else abstain.
LABELLERS = (
    ("symbol share of characters", 0.010, 0.030),
    ("capital share of letters", 0.15, 0.50),
    ("exclamation marks per word", 0.03, 0.25),
    ("function words per word", 0.12, 0.04),
    ("lone symbols per word", 0.010, 0.10),
    ("words with inner or closing symbols", 0.02, 0.15),
    ("mean word length", 6.5, 10.0),
    ("most frequent word's share", 0.12, 0.20),
    ("words equal to the word before", 0.01, 0.10),
)
_SYMBOL = r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()\-–—…«»„“”‘’¿¡/]"


def _plain(words: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.utf8_trim(words, ".,;:!?'\"()"))


def _facts_of(words: pa.Array) -> np.ndarray:
    """One row per word: length, letters, capitals, symbols, exclamation marks, function word, lone symbol, with symbols."""
    count = lambda pattern: pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    symbols = count(_SYMBOL)
    alnum = pc.match_substring_regex(words, r"[\p{L}\p{N}]").to_numpy(zero_copy_only=False)
    function = pc.is_in(_plain(words), value_set=pa.array(sorted(FUNCTION_WORDS))).to_numpy(zero_copy_only=False)
    return np.stack([pc.utf8_length(words).to_numpy(zero_copy_only=False), count(r"\p{L}"), count(r"\p{Lu}"), symbols,
                     pc.count_substring(words, "!").to_numpy(zero_copy_only=False), function, ~alnum,
                     alnum & (symbols > 0)], axis=1).astype(np.int64)


def _slots_of(words: pa.Array) -> np.ndarray:
    """Two feature slots per word: of its shape (runs of letters and digits as one sign each) and of the word in lower case."""
    shape = words
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"[\p{Lo}\p{Lm}\p{Lt}]+", "l"), (r"\p{N}+", "0")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    shape = pc.utf8_slice_codeunits(shape, 0, 16).dictionary_encode()
    out = []
    for k, column in enumerate((shape, _plain(words).dictionary_encode())):
        names = np.array(column.dictionary.to_pylist(), dtype=object)
        h = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
        out.append((h >> np.uint64(64 - BITS + 1)).astype(np.int64)[column.indices.to_numpy()] + (k << BITS - 1))
    return np.stack(out, axis=1)


def _parts(texts: pa.Array):
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(n) // SLICE_CHARS
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for s, e in zip(starts, [*starts[1:], len(n)]):
        yield texts.slice(s, e - s)


def _words(texts: pa.Array):
    """(number of texts, text number per word, unique word number per word, unique words)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = split.offsets.to_numpy()
    enc = split.flatten().dictionary_encode()
    which = enc.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    ok = (pc.binary_length(enc.dictionary).to_numpy(zero_copy_only=False) > 0)[which]
    return len(texts), doc[ok], which[ok], enc.dictionary


def statistics(texts: pa.Array) -> np.ndarray:
    """One column per labeller; rows without words are NaN."""
    n, doc, which, unique = _words(texts)
    facts = _facts_of(unique)
    total = lambda k: np.bincount(doc, facts[which, k].astype(float), n)
    words = np.bincount(doc, minlength=n).astype(float)
    pairs, counts = np.unique(doc * (len(facts) + 1) + which, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, pairs // (len(facts) + 1), counts)
    same = (doc[1:] == doc[:-1]) & (which[1:] == which[:-1])
    again = np.bincount(doc[1:][same], minlength=n)
    with np.errstate(divide="ignore", invalid="ignore"):
        length, letters = total(0), np.maximum(total(1), 1)
        x = np.stack([total(3) / length, total(2) / letters, total(4) / words, total(5) / words, total(6) / words,
                      total(7) / words, length / words, most / words, again / words], axis=1)
    x[words < ENOUGH] = np.nan                        # too short for shares: every labeller abstains
    return x


def votes(texts: pa.Array) -> np.ndarray:
    """0 abstain, 1 good, 2 bad, per text and labeller."""
    x = statistics(texts)
    out = np.zeros(x.shape, dtype=np.int64)
    for k, (_, good, bad) in enumerate(LABELLERS):
        up = 1 if bad > good else -1
        out[:, k] = np.where(up * x[:, k] <= up * good, 1, np.where(up * x[:, k] >= up * bad, 2, 0))
    return out


def patterns_of(texts: pa.Array) -> pa.Array:
    code = [votes(p) @ 3 ** np.arange(len(LABELLERS)) for p in _parts(texts)]
    return pa.array(np.concatenate(code) if code else np.zeros(0, np.int64), pa.int32())


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, smooth: float = 0.5):
    """EM. (shares of the classes, P[class, labeller] of voting bad when it votes, posterior of good per pattern).

    Class 0 is good; class k + 1 is the kind of bad document that labeller k was made for. An abstention says nothing.
    Two bounds keep the classes what they are however few documents there are: a labeller calls good documents bad at
    most ``MAX_FALSE`` of the time, and its own kind at least ``MIN_HIT``.
    """
    v = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    bad, voted = (v == 2).astype(float), (v > 0).astype(float)
    n = v.shape[1]
    p = np.full((n + 1, n), 0.2)
    p[0] = 0.01
    p[np.arange(1, n + 1), np.arange(n)] = 0.95
    share = np.append(0.8, np.full(n, 0.2 / n))
    post = None
    for _ in range(rounds):
        log = np.log(share)[:, None] + np.log(p) @ bad.T + np.log(1 - p) @ (voted - bad).T
        new = np.exp(log - log.max(axis=0))
        new /= new.sum(axis=0)
        done = post is not None and np.abs(new - post).max() < 1e-8
        post = new
        if done:
            break
        mass = post * counts
        share = (mass.sum(axis=1) + smooth) / (counts.sum() + smooth * (n + 1))
        p = (mass @ bad + smooth * 0.05) / (mass @ voted + smooth)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        p[0] = np.minimum(p[0], MAX_FALSE)                              # anchors: what good and each kind mean
        p[np.arange(1, n + 1), np.arange(n)] = np.maximum(p[np.arange(1, n + 1), np.arange(n)], MIN_HIT)
    return share, p, post[0]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value) with value = sqrt(share of the text's words)."""
    n, doc, which, unique = _words(texts)
    slots = _slots_of(unique)
    words = np.bincount(doc, minlength=n)
    again = (doc[1:] == doc[:-1]) & (which[1:] == which[:-1])
    key = np.concatenate([doc * (1 << BITS) + slots[which, 0], doc * (1 << BITS) + slots[which, 1],
                          doc[1:][again] * (1 << BITS)])        # slot 0: a word once more
    key, count = np.unique(key, return_counts=True)
    doc = key >> BITS
    return doc, key & ((1 << BITS) - 1), np.sqrt(count / words[doc])


def fit_scorer(doc, slot, value, label, rounds: int = 150, l2: float = 1e-4, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on soft labels by Adam over all rows; the last weight is the intercept."""
    w = np.zeros((1 << BITS) + 1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    n = len(label)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, value * w[slot], n) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        g = np.append(np.bincount(slot, value * err[doc], 1 << BITS), err.sum()) / n + l2 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8) / (1 + t / 50)
    return w


def score_texts(texts: pa.Array, w: np.ndarray) -> pa.Array:
    out = []
    for p in _parts(texts):
        doc, slot, value = features(p)
        z = np.bincount(doc, value * w[slot], len(p)) + w[-1]
        has = np.bincount(doc, minlength=len(p)) > 0
        out.append(np.where(has, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0))
    return pa.array(np.concatenate(out) if out else np.zeros(0))


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Callable[[pa.Array], pa.Array]:
    """Scorer of Arrow string arrays, fitted to ``docs(doc_id, text)``."""
    @F.arrow_udf("int")
    def pattern(texts: pa.Array) -> pa.Array:
        return patterns_of(texts)

    counted = cut(docs.select(pattern("text").alias("p")).groupBy("p").count()).toPandas()
    codes, counts = counted["p"].to_numpy(np.int64), counted["count"].to_numpy(float)
    posterior = dict(zip(codes.tolist(), fit_labellers(codes, counts)[2].tolist())) if len(codes) else {}

    chosen = (docs.where(F.col("text").isNotNull())
              .select(F.xxhash64(F.lit(SEED), "doc_id", "text").alias("o")).orderBy("o").limit(fit_docs).agg(F.max("o")).first()[0])
    row = F.xxhash64(F.lit(SEED), "doc_id", "text")

    def extract(batches):
        for b in batches:
            for texts in _parts(b.column(0)) if b.num_rows else ():
                codes = votes(texts) @ 3 ** np.arange(len(LABELLERS))
                doc, slot, value = features(texts)
                at = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(codes, pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(slot.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(value.astype(np.float32)))], names=["p", "slot", "value"])

    if chosen is None:
        return lambda texts: pa.array(np.zeros(len(texts)))
    fit = (docs.where(F.col("text").isNotNull() & (row <= chosen)).select(row.alias("o"), "text").dropDuplicates(["o"])
           .orderBy("o").limit(fit_docs).select("text").mapInArrow(extract, "p int, slot array<int>, value array<float>").toArrow())
    sizes = pc.list_value_length(fit["slot"]).to_numpy()
    label = np.array([posterior.get(p, 0.5) for p in fit["p"].to_pylist()])
    slot = fit["slot"].combine_chunks().flatten().to_numpy().astype(np.int64)
    value = fit["value"].combine_chunks().flatten().to_numpy().astype(float)
    w = fit_scorer(np.repeat(np.arange(len(sizes)), sizes), slot, value, label).astype(np.float32)
    return lambda texts: score_texts(texts, w)


def _score(docs: DataFrame, fit_docs: int):
    scorer = train(docs, fit_docs)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return scorer(texts)

    return score("text")


def classify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``docs`` with score and accepted (columns of these names are replaced)."""
    return docs.withColumn("score", _score(docs, fit_docs)).withColumn("accepted", F.col("score") >= ACCEPT)


def accepted(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns as they are."""
    return docs.where(_score(docs, fit_docs) >= ACCEPT)
