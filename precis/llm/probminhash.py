"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and exact verification.

* Shingles: runs of five words (words between ASCII white space, as written); a shorter text is one shingle. Weight of a
  shingle: 1 + ln(its count in the text).
* Signature: each shingle is a Poisson process of rate its weight; every arrival goes to a register drawn by hash and
  the register keeps the shingle of its first arrival. A shingle's process ends when its next arrival is later than the
  slowest register (early termination). Two registers agree with probability J_P, the probability Jaccard similarity.
  A text that repeats a shingle has a second signature, with all weights 1: of its plain shingle set. (Without repeats the
  two are the same.) So a pair is a candidate by J_P or by plain Jaccard similarity, whichever is the larger.
* Banding: registers in bands of ``ROWS``; signatures that agree on a whole band share a bucket.
* Verification, on the shingles themselves: two texts link if their probability Jaccard similarity or the plain Jaccard
  similarity of their shingle sets (the same, where no shingle repeats) is at least the threshold.

Equal texts are one class from the start (128-bit hash). In a bucket, signatures tell which pairs may link; a pair is
looked at only in the first band that it shares. Rows with such a pair fetch their texts; candidates are verified in
order of estimated similarity, skipping those that are connected already, and a task returns one tree per connected
group, never all pairs. A bucket with more than ``BLOCK`` classes is dealt as pairs of blocks, so a task holds at most
two blocks. Links are joined by ``connected_components``.

Null, empty or wordless texts link with nothing. Null doc_id: class null, kept. Rows that repeat a doc_id are alike only
if their texts are; the class id is the smallest id either way. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import connected_components, cut, n_partitions, sorted_groups

WORDS = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 6
REGISTERS = BANDS * ROWS
BLOCK = 1_024
#: A pair whose signatures agree less than this is not verified (the estimate's deviation at 0.8 is 0.033).
MAYBE = 0.64
SLICE_CHARS = 2_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), sorted by text and hash, for all texts of an Arrow string array."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = split.flatten(), split.offsets.to_numpy()
    ends = ends - ends[0]
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    enc = flat.dictionary_encode()
    word_hash = pd.util.hash_array(np.asarray(enc.dictionary.to_pylist(), dtype=object), categorize=False)
    some = enc.indices.to_numpy()
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    empty = np.array([w == "" for w in enc.dictionary.to_pylist()])
    if empty.any():                                   # white space at the ends of a text gives empty words
        ok = ~empty[some]
        some, doc = some[ok], doc[ok]
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = word_hash[some]
    n = np.bincount(doc, minlength=len(ends) - 1)
    start = np.cumsum(n) - n
    size = np.minimum(n, words)[doc]                  # a shorter text is one shingle
    place = np.arange(len(w)) - start[doc]
    first = place + size <= n[doc]
    at = np.flatnonzero(first)
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(words):
        has = size[at] > k
        h[has] = _mix(h[has] * np.uint64(0x100000001B3) + w[at[has] + k] + _GOLD)
    doc = doc[at]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    idx = np.flatnonzero(new)
    return doc[idx], h[idx], np.diff([*idx, len(h)])


def weights(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def signatures(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: (n_docs, m) hashes of each register's first arrival (0 where a text has no shingle)."""
    first = np.full(n_docs * m, np.inf)
    who = np.zeros(n_docs * m, dtype=np.uint64)
    t = np.zeros(len(h))
    round_ = 0
    while len(h):
        a = _mix(h + np.uint64((2 * round_ + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        b = _mix(a + _GOLD)
        t = t - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / w
        slot = doc * m + (b % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        who[slot[won]] = h[won]
        present, inverse = np.unique(doc, return_inverse=True)
        slowest = first.reshape(n_docs, m)[present].max(axis=1)
        on = t < slowest[inverse]
        doc, h, w, t = doc[on], h[on], w[on], t[on]
        round_ += 1
    return who.reshape(n_docs, m)


def probability_jaccard(a: tuple, b: tuple) -> float:
    """Exact J_P of two (sorted hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    every = np.union1d(ha, hb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ha)], y[np.searchsorted(every, hb)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    y_upto = np.concatenate([[0], np.cumsum(y)])
    x_after = np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
    both = np.flatnonzero((x > 0) & (y > 0))
    k = np.searchsorted(ratio, ratio[both], side="right")     # up to k the second text's share is the larger
    return float((1 / (y_upto[k] / y[both] + x_after[k] / x[both])).sum())


def similar(a, b, threshold: float = THRESHOLD) -> bool:
    """a, b: (sorted hashes, weights). Plain or probability Jaccard similarity of at least the threshold."""
    small, large = (a[0], b[0]) if len(a[0]) < len(b[0]) else (b[0], a[0])
    i = np.searchsorted(large, small)
    common = int((large[np.minimum(i, len(large) - 1)] == small).sum())
    if common >= threshold * (len(small) + len(large) - common) - 1e-9:
        return True
    if common and (a[1].max() > 1 or b[1].max() > 1):
        return probability_jaccard(a, b) >= threshold - 1e-12
    return False


def _slices(batch: pa.RecordBatch, column: int):
    """Parts of a batch with about ``SLICE_CHARS`` of text."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(n) // SLICE_CHARS
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for s, e in zip(starts, [*starts[1:], len(n)]):
        yield batch.slice(s, e - s)


def _sign(batches):
    for whole in batches:
        for b in _slices(whole, 3) if whole.num_rows else ():
            doc, h, count = shingles(b.column(3))
            repeats = np.unique(doc[count > 1])                # these have a plain signature (face 1) besides the weighted one
            again = np.isin(doc, repeats)
            faces = [(0, np.unique(doc), signatures(doc, h, weights(count), b.num_rows))]
            if len(repeats):
                plain = np.searchsorted(repeats, doc[again])
                faces.append((1, repeats, signatures(plain, h[again], np.ones(len(plain)), len(repeats))))
            for face, rows, sig in faces:
                sig = sig if face else sig[rows]
                band = np.zeros((len(rows), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    band = _mix(band * np.uint64(0x100000001B3) + sig[:, r::ROWS] + _GOLD)
                band = _mix(band + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD).astype(np.int64)
                low = (sig & np.uint64(0xFFFF)).astype(np.uint16)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(np.full(len(rows), face, np.int32)),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(band.ravel()))],
                    names=["doc_id", "h1", "h2", "face", "sig", "bands"])


def _candidates(g: pa.Table, band: int):
    """(estimate, index, index) of a group's pairs that may link and share no earlier band."""
    sig = np.frombuffer(b"".join(g["sig"].to_pylist()), dtype=np.uint16).reshape(g.num_rows, REGISTERS)
    block, h1, h2 = (g[c].to_numpy() for c in ("block", "h1", "h2"))
    lo, hi = block.min(), block.max()
    a_all, b_all = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    for s in range(0, len(a_all), 64):
        a = a_all[s:s + 64]
        same = np.zeros((len(a), len(b_all)), dtype=np.int16)
        for r in range(REGISTERS):
            same += sig[a, r][:, None] == sig[b_all, r][None, :]
        i, j = np.nonzero(same >= MAYBE * REGISTERS)
        n, i, j = same[i, j], a[i], b_all[j]
        keep = (h1[i] != h1[j]) | (h2[i] != h2[j])               # not the two signatures of one text
        if lo == hi:
            keep &= i < j
        n, i, j = n[keep], i[keep], j[keep]
        for c in range(0, len(i), 50_000):
            x, y = i[c:c + 50_000], j[c:c + 50_000]
            bands = (sig[x] == sig[y]).reshape(len(x), BANDS, ROWS).all(axis=2)     # register r is in band r // ROWS
            first = ~bands[:, :band].any(axis=1)
            yield n[c:c + 50_000][first], x[first], y[first]


KEYS = ["bucket", "i", "j"]


def _mark(batches):
    for key, g in sorted_groups(batches, KEYS):
        if key[1] != key[2] and len(set(g["block"].to_pylist())) < 2:
            continue
        active = np.zeros(g.num_rows, dtype=bool)
        for _, a, b in _candidates(g, g["t"][0].as_py()):
            active[a] = active[b] = True
        if active.any():
            yield from g.filter(pa.array(active)).to_batches()


def _verify_with(threshold: float):
    def verify(batches):
        for key, g in sorted_groups(batches, KEYS):
            found = list(_candidates(g, g["t"][0].as_py()))
            if not found:
                continue
            n, a, b = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(-n, kind="stable")
            a, b = a[order], b[order]
            doc, h, count = shingles(g["text"].combine_chunks() if g["text"].num_chunks != 1 else g["text"].chunk(0))
            at = np.searchsorted(doc, np.arange(g.num_rows + 1))
            w = weights(count)
            of = [(h[s:e], w[s:e]) for s, e in zip(at[:-1], at[1:])]
            ids, text = g["id"].to_numpy(), _mix(g["h1"].to_numpy().view(np.uint64)) ^ g["h2"].to_numpy().view(np.uint64)
            root = np.unique(text, return_inverse=True)[1]
            links = []
            for c in range(0, len(a), 1_000):
                x, y = a[c:c + 1_000], b[c:c + 1_000]
                apart = root[x] != root[y]
                for i, j in zip(x[apart].tolist(), y[apart].tolist()):
                    if root[i] != root[j] and similar(of[i], of[j], threshold):
                        root[root == root[j]] = root[i]
                        links.append((ids[i], ids[j]))
            if links:
                p, q = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["a", "b"])
    return verify


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, class_id (smallest id linked with it, itself included), kept."""
    spark = docs.sparkSession
    parts = n_partitions(spark)
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), text).alias("h1"),
                       F.xxhash64(F.lit(2), text).alias("h2"), "text")
    signed = cut(rows.where("doc_id is not null").mapInArrow(
        _sign, "doc_id long, h1 long, h2 long, face int, sig binary, bands array<long>"))
    classes = cut(signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("id")))
    lead = cut(signed.join(classes.withColumnRenamed("id", "doc_id"), ["h1", "h2", "doc_id"])
               .dropDuplicates(["h1", "h2", "face"]).select(F.col("doc_id").alias("id"), "h1", "h2", "face", "sig", "bands"))
    member = lead.select("id", "h1", "h2", "face", F.posexplode("bands").alias("t", "bucket"))
    crowded = (member.groupBy("bucket").agg(F.count("*").alias("k"), F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi"))
               .where("lo <> hi").select("bucket", "k"))                   # more than the two signatures of one text
    shared = (cut(member.join(crowded, "bucket")).join(lead.select("id", "h1", "h2", "face", "sig"), ["id", "h1", "h2", "face"])
              .withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      "block", "t", "id", "h1", "h2", "sig"))
    marked = cut(shared.repartition(parts, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(
        _mark, "bucket long, i int, j int, block int, t int, id long, h1 long, h2 long, sig binary"))
    wanted = marked.select("id", "h1", "h2").distinct()
    texts = (rows.withColumnRenamed("doc_id", "id").join(wanted, ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"])
             .select("id", "h1", "h2", "text"))
    links = cut(marked.join(texts, ["id", "h1", "h2"]).select(*KEYS, "block", "t", "id", "h1", "h2", "sig", "text")
                .repartition(parts, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(_verify_with(threshold), "a long, b long"))
    comp = connected_components(links)
    of_class = cut(classes.join(comp, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("c")))
    return (rows.select("doc_id", "h1", "h2").join(of_class, ["h1", "h2"], "left")
            .select("doc_id", F.coalesce("c", "doc_id").alias("class_id"),
                    F.coalesce(F.col("doc_id") == F.coalesce("c", "doc_id"), F.lit(True)).alias("kept")))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class (the smallest doc_id), with the columns of ``docs``; rows without an id stay."""
    keep = near_duplicates(docs.where("doc_id is not null"), threshold).where("kept").select("doc_id").distinct()
    one = (docs.join(keep, "doc_id", "left_semi")
           .withColumns({"_h1": F.xxhash64(F.lit(1), "text"), "_h2": F.xxhash64(F.lit(2), "text")})
           .dropDuplicates(["doc_id", "_h1", "_h2"]))
    return one.select(docs.columns).unionByName(docs.where("doc_id is null"))
