"""Sentence scores of documents as one pass over rows (J1, J3-J6, J-rank): no pair join, no shuffle.

A document is one row, so its sentences and words are two array expressions (JVM) and its sentence scores one Arrow
function of the words. The function works on slices of an Arrow batch, about ``SLICE_TOKENS`` tokens at a time, all
documents of a slice at once in arrays: *nodes* are sentences, *keys* are (document, word) pairs, and *incidences* are
the distinct (node, key) pairs with their counts. No method holds an array that grows with the square of a document,
except LexRank's edges, which are the graph itself.

  textrank   the step c_j = sum over shared words w and over sentences i of r_i / out_i / (ln Li + ln Lj) is matrix-free:
             it needs, per key and sentence length, only the sum of r_i / out_i (a histogram), never the pairs; and the
             step's sums are the same for all sentences of a length, so they are made per key and length
  reduction  the sums of edge weights: the same histogram with counts in place of r_i / out_i
  lexrank    edges above the cosine threshold by a prefix bound: words in falling idf order are indexed until the rest of
             the sentence cannot reach the threshold; only sentences that share an indexed word are compared, exactly.
             Documents of more than ``FEW_SENTENCES`` take blocks of rows of the cosine matrix instead, and keep a bit per
             pair at most
  kl         greedy rounds; a round recomputes only the incidences of words of the sentence chosen last
  luhn       clusters of significant tokens
  lsa_rank   block power iteration on the sparse term counts, a fixed number of steps, columns made orthonormal in each

Documents too large for one task (``giant``) are not for this module: ``summarizers`` ranks them with joins.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.functions.text import SENTENCE_RE, sentence_array, strip_ws, token_array
from precis.session import ship_package

SLICE_TOKENS = 50_000
PAIRS_AT_ONCE = 2_000_000
KEPT_PARTS = 4              # parts of that many pairs that a method may hold
CELLS_AT_ONCE = 2_000_000   # cells of a dense block
FREQUENT = 32               # a word is frequent in a document if more than one in this many sentences has it
FEW_SENTENCES = 48          # up to here the documents of a slice are compared together
KEPT_EDGES = 16_000_000     # edges of a document kept as numbers, the others as bits
GIANT_SENTENCES = 30_000    # a bit per pair of sentences: 113 MB
GIANT_CHARS = 1_000_000
METHODS = ("kl", "lexrank", "lsa_rank", "luhn", "reduction", "textrank")
NO_TOPIC = 1e-6             # a column shorter than this share of the sum of squared counts is no topic


def giant(text) -> Column:
    """Documents that one task shouldn't rank alone: their sentences could make millions of edges."""
    text = F.col(text) if isinstance(text, str) else text
    many = (F.length(text) > 2 * GIANT_SENTENCES) & (F.regexp_count(text, F.lit(SENTENCE_RE)) > GIANT_SENTENCES)
    return F.coalesce((F.length(text) > GIANT_CHARS) | many, F.lit(False))


def sentence_structs(text) -> Column:
    """Array of (sent_id, sentence) of a text: the sentence frame as a column, so a document's row is enough."""
    raw = F.transform(sentence_array(text), lambda x, i: F.struct(i.alias("sent_id"), strip_ws(x).alias("sentence")))
    return F.filter(raw, lambda s: s["sentence"] != "")


# ---------------------------------------------------------------- arrays of a slice
def bounds(lists: pa.ListArray) -> np.ndarray:
    """Offsets of a list array, from 0."""
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return offsets - offsets[0]


def spread(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for every n in ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Slice:
    """Sentences and words of some documents, as arrays."""

    def __init__(self, docs: pa.ListArray):
        sents = docs.flatten()
        words = sents.flatten()
        self.first = bounds(docs)                                        # document -> its first node
        self.n_docs, self.n = len(docs), len(sents)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self.length = np.diff(bounds(sents))                             # tokens per node
        self.n_sents = np.diff(self.first)
        d = words.dictionary_encode()
        self.tok_node = np.repeat(np.arange(self.n), self.length)
        self.tok_pos = spread(self.length)
        width = max(1, len(d.dictionary))
        pair = self.doc[self.tok_node] * width + d.indices.to_numpy(zero_copy_only=False)
        keys, self.tok_key = np.unique(pair, return_inverse=True)
        self.n_keys = len(keys)
        self.key_doc = keys // width
        self.words, self.key_word = d.dictionary, keys % width
        inc, self.tf = np.unique(self.tok_node * max(1, self.n_keys) + self.tok_key, return_counts=True)
        self.node, self.key = inc // max(1, self.n_keys), inc % max(1, self.n_keys)

    def per_node(self, values: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.bincount(node, weights=values, minlength=self.n)


class Histogram:
    """Sentence lengths per key (*entries*), and the weights between the entries of a key.

    Sentences of one length that share a key get the same sum from it, so sums are made per entry, from pairs of a key's
    entries, not per incidence. Keys of one sentence link nothing and are left out. Pairs of entries are made in parts of about
    ``PAIRS_AT_ONCE``; they are kept if there are at most ``KEPT_PARTS``, else made anew in every step.
    """

    def __init__(self, s: Slice):
        shared = np.bincount(s.key, minlength=s.n_keys)[s.key] > 1
        self.node = s.node[shared]
        length = s.length[self.node]
        wide = int(s.length.max(initial=0)) + 1
        entries, self.entry = np.unique(s.key[shared] * wide + length, return_inverse=True)
        self.size = np.bincount(self.entry, minlength=len(entries))
        entry_key, self.entry_length = entries // wide, entries % wide
        self.first = np.searchsorted(entry_key, entry_key)                # an entry's first and number of entries of its key
        self.many = np.searchsorted(entry_key, entry_key, "right") - self.first
        with np.errstate(divide="ignore"):
            self.ln = np.log(np.arange(wide, dtype=np.float64))
        upto = np.cumsum(self.many)
        self.cuts = [0]
        while self.cuts[-1] < len(entries):
            a = self.cuts[-1]
            self.cuts.append(max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS_AT_ONCE, "right"))))
        self.kept = list(self._parts()) if len(self.cuts) <= KEPT_PARTS + 1 else None
        den = 2.0 * self.ln[self.entry_length]
        own = np.divide(1.0, den, out=np.zeros(len(den)), where=den > 0)
        self.own_weight = s.per_node(own[self.entry], self.node)

    def _parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, to, of, weight): the pairs of the entries a .. b - 1 with all entries ``of`` of their keys; ``to`` counts from a."""
        for a, b in zip(self.cuts, self.cuts[1:]):
            to = np.repeat(np.arange(b - a), self.many[a:b])
            of = self.first[a:b][to] + spread(self.many[a:b])
            den = self.ln[self.entry_length[of]] + self.ln[self.entry_length[a:b][to]]
            yield a, b, to, of, np.divide(1.0, den, out=np.zeros(len(den)), where=den > 0)

    def _per_node(self, s: Slice, value: Callable) -> np.ndarray:
        per_entry = np.zeros(len(self.size))
        for a, b, to, of, weight in self.kept if self.kept is not None else self._parts():
            per_entry[a:b] = np.bincount(to, weights=value(a, to, of) * weight, minlength=b - a)
        return s.per_node(per_entry[self.entry], self.node)

    def out(self, s: Slice) -> np.ndarray:
        """Sum of edge weights per node; exactly 0 where no other sentence shares a word."""
        return self._per_node(s, lambda a, to, of: self.size[of] - (of == to + a))

    def step(self, s: Slice, x: np.ndarray) -> np.ndarray:
        """sum over neighbours i of w_ij x_i."""
        sums = np.bincount(self.entry, weights=x[self.node], minlength=len(self.size))
        return self._per_node(s, lambda a, to, of: sums[of]) - x * self.own_weight


def power(s: Slice, out: np.ndarray, step: Callable, iterations: int, damping: float) -> np.ndarray:
    """PageRank per document: r0 = 1/n; r' = (1-d)/n + d (step(r / out) + dangling / n)."""
    n = s.n_sents[s.doc].astype(np.float64)
    r = 1.0 / n
    linked = out > 0
    for _ in range(iterations):
        x = np.divide(r, out, out=np.zeros(s.n), where=linked)
        dangling = np.bincount(s.doc, weights=np.where(linked, 0.0, r), minlength=s.n_docs)
        r = (1.0 - damping) / n + damping * (np.where(linked, step(x), 0.0) + dangling[s.doc] / n)
    return r


# ---------------------------------------------------------------- LexRank's edges
def prefix_index(s: Slice, u: np.ndarray, sf: np.ndarray, threshold: float) -> np.ndarray:
    """Which incidences are indexed.

    Common words come first. As long as the sum of u times the word's largest u in the document stays below the
    threshold, sentences that share only these words cannot reach it. Two sentences above the threshold therefore share
    a word that is indexed for both: their rarest common one.
    """
    order = np.lexsort((s.key, -sf[s.key], s.node))
    largest = np.zeros(s.n_keys)
    np.maximum.at(largest, s.key, u)
    part = (u * largest[s.key])[order]
    node = s.node[order]
    upto = np.cumsum(part)
    first = np.r_[0, np.flatnonzero(np.diff(node)) + 1] if len(node) else np.zeros(0, np.int64)
    upto -= np.repeat((upto - part)[first], np.diff(np.r_[first, len(node)]))
    indexed = np.zeros(len(u), dtype=bool)
    indexed[order] = upto >= threshold - 1e-9
    return indexed & (u > 0)


def candidates(node: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Distinct src * n + dst (src < dst) of nodes that share a key."""
    order = np.lexsort((node, key))
    node, key = node[order], key[order]
    end = np.searchsorted(key, key, "right")
    later = end - np.arange(len(key)) - 1
    found = [np.zeros(0, np.int64)]
    upto = np.cumsum(later)
    s = 0
    while s < len(key):
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + PAIRS_AT_ONCE, "right")))
        left = np.repeat(np.arange(s, e), later[s:e])
        found.append(np.unique(node[left] * n + node[left + 1 + spread(later[s:e])]))
        s = e
    return np.unique(np.concatenate(found))


def unit_lengths(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """tf-idf sentence vectors of length 1 (per incidence), and the number of sentences per key."""
    sf = np.bincount(s.key, minlength=s.n_keys)
    v = s.tf * np.log(s.n_sents[s.key_doc] / np.maximum(sf, 1))[s.key]
    norm = np.sqrt(s.per_node(v * v, s.node))[s.node]
    return np.divide(v, norm, out=np.zeros(len(v)), where=norm > 0), sf


def cosine_edges(s: Slice, threshold: float, unit: tuple[np.ndarray, np.ndarray] | None = None,
                 nodes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(src, dst, number of compared pairs): sentence pairs of one document with tf-idf cosine above the threshold.

    ``unit``: the slice's ``unit_lengths``, if at hand; ``nodes``: which sentences to compare (default: all).
    """
    u, sf = unit or unit_lengths(s)
    use = prefix_index(s, u, sf, threshold)
    if nodes is not None:
        use &= nodes[s.node]
    pairs = candidates(s.node[use], s.key[use], s.n)
    src, dst = pairs // s.n, pairs % s.n
    codes = s.node * max(1, s.n_keys) + s.key                             # sorted
    first = np.searchsorted(s.node, np.arange(s.n + 1))
    cosine = np.zeros(len(pairs))
    words = np.diff(first)[src]
    upto = np.cumsum(words)
    a = 0
    while a < len(pairs):                                                 # the words of src, looked up in dst
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
        pair = np.repeat(np.arange(a, b), words[a:b])
        inc = first[src[pair]] + spread(words[a:b])
        want = dst[pair] * max(1, s.n_keys) + s.key[inc]
        at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
        hit = codes[at] == want
        cosine[a:b] = np.bincount(pair[hit] - a, weights=u[inc[hit]] * u[at[hit]], minlength=b - a)
        a = b
    keep = cosine > threshold
    return src[keep], dst[keep], len(pairs)


def cosine_rows(s: Slice, unit: tuple[np.ndarray, np.ndarray], doc: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x sentences: whether the cosine is above the threshold) for runs of a document's sentences.

    Words of one sentence add nothing. A block of cosines is the product of dense rows over the frequent words, to which the
    products over the other words are added: these meet few sentences each. A block has at most ``CELLS_AT_ONCE`` cells and
    about ``PAIRS_AT_ONCE`` products (or is one row).
    """
    u, sf = unit
    n0, n = int(s.first[doc]), int(s.n_sents[doc])
    i0, i1 = np.searchsorted(s.node, [n0, n0 + n])
    k0, k1 = np.searchsorted(s.key_doc, [doc, doc + 1])
    common = np.flatnonzero((sf[k0:k1] > 1) & (sf[k0:k1] < n))
    common = common[np.argsort(-sf[k0:k1][common], kind="stable")]       # frequent words first
    column = np.full(k1 - k0, -1)
    column[common] = np.arange(len(common))
    wide = int(min((sf[k0:k1][common] * FREQUENT > n).sum(), max(1, CELLS_AT_ONCE // n)))
    col = column[s.key[i0:i1] - k0]
    dense = (col >= 0) & (col < wide)
    vectors = np.zeros((n, wide))
    vectors[s.node[i0:i1][dense] - n0, col[dense]] = u[i0:i1][dense]
    rare = np.flatnonzero(col >= wide)
    node, col, weight = s.node[i0:i1][rare] - n0, col[rare], u[i0:i1][rare]
    by_word = np.argsort(col, kind="stable")
    many = np.bincount(col, minlength=len(common))
    start = np.cumsum(many) - many
    first = np.searchsorted(node, np.arange(n + 1))
    upto = np.r_[0, np.cumsum(many[col])][first]                            # products before each row
    a = 0
    while a < n:
        b = min(a + max(1, CELLS_AT_ONCE // n), max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS_AT_ONCE, "right")) - 1), n)
        cosine = vectors[a:b] @ vectors.T
        mine = np.arange(first[a], first[b])
        if len(mine):
            left = np.repeat(mine, many[col[mine]])
            right = by_word[start[col[left]] + spread(many[col[mine]])]
            cosine += np.bincount((node[left] - a) * n + node[right], weights=weight[left] * weight[right],
                                  minlength=(b - a) * n).reshape(b - a, n)
        above = cosine > threshold
        above[np.arange(b - a), np.arange(a, b)] = False
        yield a, above
        a = b


class Links:
    """The edges of one document from blocks of rows: neighbours as numbers, beyond ``KEPT_EDGES`` as a bit per pair."""

    def __init__(self, n0: int, n: int, rows: Iterator[tuple[int, np.ndarray]]):
        self.n0, self.n = n0, n
        self.out = np.zeros(n)
        self.lists, self.bits, kept = [], [], 0
        for a, above in rows:
            out = np.count_nonzero(above, axis=1)
            self.out[a:a + len(out)] = out
            kept += int(out.sum())
            if kept <= KEPT_EDGES:
                some = np.flatnonzero(out)
                self.lists.append((a + some, (np.cumsum(out) - out)[some], (np.flatnonzero(above) % n).astype(np.int32)))
            else:
                self.bits.append((a, np.packbits(above, axis=1)))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adds to y, per sentence, the sum of x over its neighbours."""
        x, y = x[self.n0:self.n0 + self.n], y[self.n0:self.n0 + self.n]
        for rows, start, of in self.lists:
            if len(rows):
                y[rows] += np.add.reduceat(x[of], start)
        for a, bits in self.bits:
            y[a:a + len(bits)] += np.unpackbits(bits, axis=1, count=self.n) @ x


# ---------------------------------------------------------------- methods: scores per node
def reduction(s: Slice, p: dict) -> np.ndarray:
    return Histogram(s).out(s)


def textrank(s: Slice, p: dict) -> np.ndarray:
    h = Histogram(s)
    return power(s, h.out(s), lambda x: h.step(s, x), p["iterations"], p["damping"])


def lexrank(s: Slice, p: dict) -> np.ndarray:
    unit = unit_lengths(s)
    few = s.n_sents <= FEW_SENTENCES
    src, dst, _ = cosine_edges(s, p["threshold"], unit, few[s.doc])
    a, b = np.r_[src, dst], np.r_[dst, src]
    out = np.bincount(a, minlength=s.n).astype(np.float64)
    links = [Links(int(s.first[d]), int(s.n_sents[d]), cosine_rows(s, unit, d, p["threshold"])) for d in np.flatnonzero(~few)]
    for x in links:
        out[x.n0:x.n0 + x.n] = x.out

    def step(x: np.ndarray) -> np.ndarray:
        y = s.per_node(x[a], b).astype(np.float64)          # of no edges at all numpy makes integers
        for of_document in links:
            of_document.add(x, y)
        return y

    return power(s, out, step, p["iterations"], p["damping"])


def kl(s: Slice, p: dict) -> np.ndarray:
    """k for the sentence chosen first, k - 1 for the second, ...; 0 for the others."""
    k, delta = p["k"], p["delta"]
    in_doc = np.bincount(s.tok_key, minlength=s.n_keys).astype(np.float64)
    tokens = np.bincount(s.key_doc, weights=in_doc, minlength=s.n_docs)
    share = (in_doc / tokens[s.key_doc])[s.key] if s.n_keys else np.zeros(0)
    distinct = np.bincount(s.key_doc, minlength=s.n_docs)[s.doc]
    count, size = np.zeros(s.n_keys), np.zeros(s.n_docs)
    score = np.zeros(s.n)

    def term(which):
        c = count[s.key[which]]
        return share[which] * (np.log(c + s.tf[which] + delta) - np.log(c + delta))

    part = term(np.arange(len(s.key)))
    gain = s.per_node(part, s.node)
    first = np.searchsorted(s.node, np.arange(s.n + 1))
    for rnd in range(k):
        j = np.where(distinct > 0, np.log(np.maximum(size[s.doc] + s.length + delta * distinct, 1e-300)) - gain, 0.0)
        j = np.where(score > 0, np.inf, np.round(j, 9))
        order = np.lexsort((j, s.doc))
        chosen = order[self_first(s.doc[order])]
        chosen = chosen[np.isfinite(j[chosen])]
        if not len(chosen):
            break
        score[chosen] = k - rnd
        size[s.doc[chosen]] += s.length[chosen]
        many = np.diff(first)[chosen]
        inc = np.repeat(first[chosen], many) + spread(many)
        count[s.key[inc]] += s.tf[inc]
        changed = np.zeros(s.n_keys, dtype=bool)
        changed[s.key[inc]] = True
        again = np.flatnonzero(changed[s.key])
        new = term(again)
        gain += s.per_node(new - part[again], s.node[again])
        part[again] = new
    return score


def self_first(sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def luhn(s: Slice, p: dict) -> np.ndarray:
    often = np.bincount(s.tok_key, minlength=s.n_keys) >= p["min_freq"]
    t = np.flatnonzero(often[s.tok_key]) if s.n_keys else np.zeros(0, np.int64)
    node, pos = s.tok_node[t], s.tok_pos[t]
    score = np.zeros(s.n)
    if len(t):
        new = np.r_[True, (np.diff(node) != 0) | (np.diff(pos) - 1 > p["max_gap"])]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(t)] - 1
        n = end - start + 1
        np.maximum.at(score, node[start], n * n / (pos[end] - pos[start] + 1))
    return score


@lru_cache(maxsize=500_000)
def word_start(word: str, column: int) -> float:
    """Where the power iteration starts: a number in [-0.5, 0.5) from the word's hash."""
    return int(hashlib.md5(f"{column}:{word}".encode()).hexdigest()[:8], 16) / 2.0 ** 32 - 0.5


def lsa_rank(s: Slice, p: dict) -> np.ndarray:
    """Length of a sentence's term counts in the space of the document's strongest topics.

    With A (words by sentences) and V the orthonormal columns after the last step, the score of sentence k is the length
    of A V v_k: sqrt(sum of sigma_i^2 v_ik^2) once the columns span the strongest topics, however they lie in that space.
    """
    r = p["topics"] or p["k"]
    words = lambda v: np.stack([np.bincount(s.key, s.tf * c[s.node], s.n_keys) for c in v], dtype=np.float64)
    nodes = lambda u: np.stack([np.bincount(s.node, s.tf * c[s.key], s.n) for c in u], dtype=np.float64)
    total = lambda x: np.bincount(s.doc, x, s.n_docs)[s.doc]
    least = NO_TOPIC * total(s.per_node(s.tf * s.tf, s.node))
    start = np.array([[word_start(w, c) for w in s.words.to_pylist()] for c in range(r)]).reshape(r, -1)
    v = nodes(start[:, s.key_word])
    for _ in range(p["steps"]):
        v = nodes(words(v))
        for c in range(r):
            along = sum((v[d] * total(v[d] * v[c]) for d in range(c)), np.zeros(s.n))
            v[c] -= along
            norm = np.sqrt(total(v[c] ** 2))
            v[c] = np.divide(v[c], norm, out=np.zeros(s.n), where=norm > least)
    u = words(v)
    square = np.zeros(s.n)
    for c in range(r):
        for d in range(r):
            square += v[c] * v[d] * np.bincount(s.key_doc, u[c] * u[d], s.n_docs)[s.doc]
    return np.sqrt(np.maximum(square, 0.0))


def lsa(s: Slice, p: dict) -> np.ndarray:
    """All topics kept: the length of the sentence's term counts."""
    return np.sqrt(s.per_node((s.tf * s.tf).astype(np.float64), s.node))


_METHODS = {"kl": kl, "lsa": lsa, "lexrank": lexrank, "lsa_rank": lsa_rank, "luhn": luhn, "reduction": reduction, "textrank": textrank}


def slices(docs: pa.ListArray) -> list[tuple[int, int]]:
    """Runs of documents with about ``SLICE_TOKENS`` tokens."""
    tokens = bounds(docs.flatten())[bounds(docs)] if len(docs) else np.zeros(1, np.int64)
    out, s = [], 0
    while s < len(docs):
        e = max(s + 1, int(np.searchsorted(tokens, tokens[s] + SLICE_TOKENS, "right")) - 1)
        out.append((s, e))
        s = e
    return out


def rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """x * 10^decimals as Spark's round() rounds it: halves of the decimal digits away from zero."""
    y = np.abs(x) * 10.0 ** decimals
    out = np.floor(y + 0.5)
    near = np.abs(y - np.floor(y) - 0.5) <= np.maximum(1e-6, y * 1e-15)      # the product's own error could decide
    for at in np.flatnonzero(near & np.isfinite(y)):
        out[at] = float(Decimal(repr(float(abs(x[at])))).scaleb(decimals).quantize(Decimal(1), rounding=ROUND_HALF_UP))
    return np.copysign(out, x) + 0.0


def best(s: Slice, score: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray]:
    """(picks per document, their places in the document, in order): the k highest rounded scores, ties: the first."""
    order = np.lexsort((-rounded(score, decimals), s.doc))                   # stable: ties stay in document order
    picked = np.sort(order[spread(s.n_sents) < k])
    return np.minimum(s.n_sents, k), picked - s.first[s.doc[picked]]


def _per_document(words, methods: tuple[str, ...], item: str, found: Callable, **params) -> Column:
    """Struct of ``<method>`` (an array) and ``<method>_s`` (seconds) for every method; ``found``: (slice, scores) -> (sizes, items).

    A slice is timed as a whole and its seconds are shared out by the documents' tokens (plus one per sentence).
    """
    kind = {"double": pa.float64(), "int": pa.int32()}[item]
    names = [*methods, *[f"{m}_s" for m in methods]]
    returns = "struct<" + ", ".join([f"{m}: array<{item}>" for m in methods] + [f"{m}_s: double" for m in methods]) + ">"

    @F.arrow_udf(returns)
    def run(docs: pa.Array) -> pa.Array:
        if isinstance(docs, pa.ChunkedArray):
            docs = docs.combine_chunks()
        values, seconds, sizes = ({m: [] for m in methods} for _ in range(3))
        for a, b in slices(docs):
            s = Slice(docs.slice(a, b - a))
            work = np.bincount(s.doc, weights=s.length + 1.0, minlength=s.n_docs)
            work = work / max(work.sum(), 1.0)
            for m in methods:
                t0 = time.perf_counter()
                n, items = found(s, _METHODS[m](s, params))
                sizes[m].append(n)
                values[m].append(items)
                seconds[m].append(work * (time.perf_counter() - t0))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
        at = lambda m: pa.array(np.r_[0, np.cumsum(join(sizes[m]))].astype(np.int32), pa.int32())
        columns = [pa.ListArray.from_arrays(at(m), pa.array(join(values[m]).astype(kind.to_pandas_dtype()), kind)) for m in methods]
        columns += [pa.array(join(seconds[m]), pa.float64()) for m in methods]
        return pa.StructArray.from_arrays(columns, names=names)

    return run(words)


def scores(words, methods: tuple[str, ...], **params) -> Column:
    """``_per_document`` with every sentence's score."""
    return _per_document(words, methods, "double", lambda s, score: (s.n_sents, score), **params)


def picks(words, methods: tuple[str, ...], k: int, decimals: int, **params) -> Column:
    """``_per_document`` with the places of the k best sentences, in document order."""
    return _per_document(words, methods, "int", lambda s, score: best(s, score, k, decimals), **{**params, "k": k})


def _with_words(docs: DataFrame) -> DataFrame:
    """(doc_id, sents, words) per non-empty document."""
    ship_package(docs.sparkSession)
    return (docs.where(F.length("text") > 0).select("doc_id", sentence_structs(F.col("text")).alias("sents"))
            .withColumn("words", F.transform("sents", lambda s: token_array(s["sentence"]))))


def scored(docs: DataFrame, methods: tuple[str, ...], **params) -> DataFrame:
    """(doc_id, sents, scored) per non-empty document; ``sents`` is an array of (sent_id, sentence)."""
    return _with_words(docs).select("doc_id", "sents", scores("words", methods, **params).alias("scored"))


def picked(docs: DataFrame, methods: tuple[str, ...], k: int, decimals: int, **params) -> DataFrame:
    """(doc_id, sents, picked) per document with sentences; ``picked.<method>``: places of its k best sentences in ``sents``.

    A condition on ``sents`` alone would be pushed below their making and split every text twice, one on the picks would rank
    every document twice; behind a generator it stays where it is.
    """
    some = F.explode_outer(F.when(F.size("sents") > 0, F.array("sents"))).alias("sents")
    rows = (_with_words(docs).select("doc_id", some).where(F.col("sents").isNotNull())
            .withColumn("words", F.transform("sents", lambda s: token_array(s["sentence"]))))
    return rows.select("doc_id", "sents", picks("words", methods, k, decimals, **params).alias("picked"))


def joined_sentences(sents, places) -> Column:
    """The sentences at these places of the array, joined by one space."""
    return F.array_join(F.transform(places, lambda at: F.get(sents, at)["sentence"]), " ")


# ---------------------------------------------------------------- sentence pairs
def shared_words(s: Slice, use: np.ndarray, product: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(src, dst, value) of node pairs (src < dst) that share a used incidence's key, about ``PAIRS_AT_ONCE`` at a time.

    ``value`` counts the shared keys, or adds up the products of the two incidences' ``product``. All pairs of a source
    node come together, so a part needs nothing of the others.
    """
    node, key = s.node[use], s.key[use]
    order = np.lexsort((node, key))
    by_key = key[order]
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))
    later = np.searchsorted(by_key, key, "right") - place - 1
    first = np.searchsorted(node, np.arange(s.n + 1))
    upto = np.r_[0, np.cumsum(later)][first]                                # pairs before each node
    a = 0
    while a < s.n:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS_AT_ONCE, "right")) - 1)
        mine = np.arange(first[a], first[b])
        left = np.repeat(mine, later[mine])
        right = order[place[left] + 1 + spread(later[mine])]
        pair, at = np.unique(node[left] * s.n + node[right], return_inverse=True)
        weights = None if product is None else product[use][left] * product[use][right]
        if len(pair):
            yield pair // s.n, pair % s.n, np.bincount(at, weights, len(pair))
        a = b


def textrank_pairs(s: Slice) -> Iterator[tuple]:
    """(src, dst, shared, weight): sentence pairs of a document that share a word."""
    ln = np.log(np.maximum(s.length, 1).astype(np.float64))
    for src, dst, shared in shared_words(s, np.ones(len(s.node), bool), None):
        den = ln[src] + ln[dst]
        yield src, dst, shared.astype(np.int64), np.divide(shared, den, out=np.zeros(len(den)), where=den > 0)


def lexrank_pairs(s: Slice) -> Iterator[tuple]:
    """(src, dst, cosine): sentence pairs of a document that share a word of non-zero idf."""
    u, _ = unit_lengths(s)
    yield from shared_words(s, u > 0, u)


_PAIRS = {"textrank": (textrank_pairs, "shared long, weight double"), "lexrank": (lexrank_pairs, "cosine double")}


def pairs(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, src, dst, values of ``kind``): a row's sentence pairs, made where the row is; nothing is shuffled."""
    of_slice, values = _PAIRS[kind]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, sent_ids = batch.column(0), batch.column(1), batch.column(2)
            for a, b in slices(words):
                s = Slice(words.slice(a, b - a))
                sent = sent_ids.slice(a, b - a).flatten()
                for src, dst, *rest in of_slice(s):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(a + s.doc[src])), sent.take(pa.array(src)), sent.take(pa.array(dst)), *map(pa.array, rest)],
                        names=["doc_id", "src", "dst", *[v.split()[0] for v in values.split(", ")]])

    rows = _with_words(docs).select("doc_id", "words", F.transform("sents", lambda s: s["sent_id"]).alias("sent_ids"))
    return rows.mapInArrow(run, f"doc_id {id_type}, src int, dst int, {values}")
