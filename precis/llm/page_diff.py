"""Main text of pages by nearest-URL page differencing.

1. A page's html becomes blocks (text between block-level tags, references decoded, white space made one space). The
   markup says of a block: furniture (inside a menu, header, footer, side bar, notice, advert, form, comment ... by tag,
   class, id or role), article (inside article or main), or nothing.
2. Pages are ordered by host, URL path, page_id and blocks. A page with the very same blocks is a copy and tells nothing,
   so each page is paired with the last page before it or the first after it on its host whose blocks differ: the one
   whose path shares the longer prefix (ties: the one before). All pages of a run of copies are paired so.
3. The blocks of the two pages are aligned by longest common subsequence (bit-parallel, in linear space for huge pages).
   Blocks on it are shared: the site's, not the page's.
4. A page keeps its article blocks and the blocks that the markup says nothing of, unless they are shared. Of the latter,
   shared ones go on every page, with a marked article or without. In an article only lines without a sentence's end go,
   and only if both neighbours have them: the site puts them into every article. Headings of an article stay, shared
   sentences stay (many articles quote the same passages), and so does all of an article that shares most of its text
   with the neighbour's: the two are copies of one article.

The order is cut into chunks by sampled splitters, so a host with a third of all pages is spread over tasks. A first pass
reads digests of the blocks and tells which pages are the neighbours of a chunk's first and last run, however many chunks
away; these also go to that chunk. A task streams its sorted pages and holds the blocks of one run and its two neighbours,
and the ids, URLs and paths of the run's pages.

Null or empty html: empty text. Null url: host and path empty. Rows that repeat a page are copies of each other. Very
long pages are read whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import cut, n_partitions

PAGES_PER_CHUNK = 500
MAX_CHUNKS = 4_000
OVERSAMPLE = 8
LCS_CELLS = 200_000_000

#: Elements whose content is no markup: it runs to the end tag, or without one to the end of the page.
_RAW = "script|style|textarea|iframe"
#: Elements whose content is no text of the page, but markup. One that is closed by "/>" or never closed holds nothing.
_NO_TEXT = frozenset("noscript template svg object select button canvas audio video math".split())
_ANY_NO_TEXT = re.compile(rf"<(?:{'|'.join(sorted(_NO_TEXT))})\b", re.I)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW}|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*)[^>]*>", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr".split())
_FURNITURE = frozenset("nav footer aside form head menu dialog".split()) | _NO_TEXT
_MARKS = frozenset("""
ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr
notice notices alert popup modal overlay sidebar sidenav side menu nav navbar navigation breadcrumb breadcrumbs footer
masthead comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter
subscribe subscription signup login search pagination pager toolbar widget widgets copyright disclaimer skip hidden
""".split())
_HEADS = frozenset(("header", "topbar"))
#: Words of place and shape that may stand beside a mark in a class name ("site-footer", "ad-box"); with any other word
#: the name says something else ("share-price", "side-note", "has-sidebar", "no-ads").
_SHAPES = frozenset("""
area bar block body bottom box button buttons col column container content entry first footer global group header inner item
items last left line link links list main outer page panel post primary right row secondary section site slot sticky text
title top unit wrap wrapper
""".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\bhidden\b", re.S | re.I)
_MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?(?:main|article)\b", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSES_P = frozenset("p div ul ol li table h1 h2 h3 h4 h5 h6 section article main blockquote pre header footer nav aside form".split())

_ENDS = frozenset(".!?…。！？")

#: HEADING: a heading inside an article.
FURNITURE, ARTICLE, OPEN, HEADING = 0, 1, 2, 3
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _marked(attributes: str, in_article: bool) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "hidden").lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for own in value.split():
                words = {w.lower() for w in _WORD.findall(own)}
                marks = words & _MARKS or not in_article and words & _HEADS
                if marks and words <= _MARKS | _SHAPES | _HEADS:
                    return True
        elif name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _unclosed(page: str) -> set[int]:
    """Where the elements of ``_NO_TEXT`` start that are closed by "/>" or have no end tag."""
    out: set[int] = set()
    if _ANY_NO_TEXT.search(page):
        waiting: dict[str, list[int]] = {name: [] for name in _NO_TEXT}
        for m in _TOKEN.finditer(page):
            name = (m[3] or m[6] or "").lower()
            if name not in _NO_TEXT:
                continue
            if m[2] or m[5]:
                if waiting[name]:
                    waiting[name].pop()
            elif m[0].endswith("/>"):
                out.add(m.start())
            else:
                waiting[name].append(m.start())
        out.update(*waiting.values())
    return out


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, FURNITURE | ARTICLE | HEADING | OPEN) in page order.

    A class or id makes no furniture of html and body, nor of the elements around the page's first article or main.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []                       # open elements with the kind inside them
    by_tag = 0                                               # open elements, from the bottom, up to the last furniture tag
    seen_article = False
    kind = OPEN
    at = 0
    unclosed = _unclosed(page)

    def close():
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                out.append((words, kind))
            text.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                if m[1].lower() != "title":
                    text.append(" ")
            continue
        if name in _INLINE:
            if name != "span" and name != "a" or not m[4]:
                continue
            if not m[2] and _marked(m[4], kind == ARTICLE):  # an inline advert or notice
                close()
                stack.append((name, FURNITURE))
                kind = FURNITURE
            continue
        if m.start() in unclosed:
            text.append(" ")
            continue
        close()
        if name in _VOID:
            continue
        if m[2] or m[5]:                                     # an end tag
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            if name in _CLOSES_P and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            inside = stack[-1][1] if stack else OPEN
            attributes = m[4] or ""
            by_tag = min(by_tag, len(stack))
            in_article = inside in (ARTICLE, HEADING)
            tagged = name in _FURNITURE or name == "header" and not in_article
            marked = bool(attributes) and name not in ("html", "body") and _marked(attributes, in_article)
            article = name in ("article", "main") or bool(attributes) and bool(_MAIN_ROLE.search(attributes))
            if inside != FURNITURE and (tagged or marked):
                inside = FURNITURE
                by_tag = len(stack) + 1 if tagged else by_tag
            elif inside == FURNITURE and tagged:
                by_tag = len(stack) + 1
            elif article and not marked and (inside != FURNITURE or not by_tag and not seen_article):
                inside, seen_article = ARTICLE, True
            elif name in _HEADINGS and inside == ARTICLE:
                inside = HEADING
            stack.append((name, inside))
        kind = stack[-1][1] if stack else OPEN
    if at < len(page):
        text.append(page[at:])
    close()
    return out


def _rows(a: list, b: list) -> list[int]:
    """Bit-parallel LCS: after each item of a, a number whose bit j is 0 where b[j] makes the LCS longer."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    return rows


def _lengths(a: list, b: list) -> list[int]:
    """LCS lengths of a with every prefix of b."""
    v = _rows_last(a, b)
    out = [0]
    for j in range(len(b)):
        out.append(out[-1] + (not v >> j & 1))
    return out


def _rows_last(a: list, b: list) -> int:
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return v


def shared(a: list, b: list, cells: int = LCS_CELLS) -> list[int]:
    """Indices of a on one longest common subsequence with b."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    inner_a, inner_b = a[start:len(a) - end], b[start:len(b) - end]
    found = list(range(start))
    if inner_a and inner_b:
        if len(inner_a) > 1 and len(inner_a) * len(inner_b) > cells:                 # linear space: halve a
            half = len(inner_a) // 2
            left = _lengths(inner_a[:half], inner_b)
            right = _lengths(inner_a[half:][::-1], inner_b[::-1])
            m = max(range(len(inner_b) + 1), key=lambda j: left[j] + right[len(inner_b) - j])
            inner = shared(inner_a[:half], inner_b[:m], cells) + [half + i for i in shared(inner_a[half:], inner_b[m:], cells)]
        else:
            rows, i, j, inner = _rows(inner_a, inner_b), len(inner_a), len(inner_b), []
            while i and j:
                if rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                else:
                    i -= 1
                    if not (i and not rows[i - 1] >> (j - 1) & 1):
                        j -= 1
                        inner.append(i)
            inner.reverse()
        found += [start + i for i in inner]
    return found + list(range(len(a) - end, len(a)))


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _no_sentence(text: str) -> bool:
    return text.rstrip("\"'”’»)]")[-1:] not in _ENDS


def main_text(texts: list[str], kinds: list[int], common: set[int], everywhere: set[int]) -> str:
    """Text of a page whose blocks ``common`` are shared with its neighbour, and ``everywhere`` with both neighbours."""
    own = range(len(texts))
    article = [i for i in own if kinds[i] in (ARTICLE, HEADING)]
    size = sum(len(texts[i]) for i in article)
    copied = 2 * sum(len(texts[i]) for i in article if i in common) > size      # two copies of one article

    def stays(i: int) -> bool:
        if kinds[i] == OPEN:
            return i not in common
        return kinds[i] == HEADING or kinds[i] == ARTICLE and (copied or i not in everywhere or not _no_sentence(texts[i]))

    return " ".join(texts[i] for i in own if stays(i))


def run_texts(texts: list[str], pages: list[tuple], before: tuple | None, after: tuple | None):
    """(page_id, url, text) of a run's pages (page_id, url, path, kinds) given its neighbours (path, texts) on the host."""
    near = [p for p in (before, after) if p is not None]
    common = [set(shared(texts, p[1])) for p in near]
    everywhere = common[0] & common[1] if len(near) == 2 and near[0][1] != near[1][1] else set()
    for page_id, url, path, kinds in pages:
        k = max(range(len(near)), key=lambda i: _common_prefix(path, near[i][0]), default=-1)
        yield page_id, url, main_text(texts, kinds, common[k] if near else set(), everywhere)


def _digest(texts: list[str]) -> str:
    return hashlib.blake2b("\x1f".join(texts).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _neighbours(ends: dict[int, tuple]) -> dict[tuple, list[int]]:
    """Page (host, path, id, digest) -> the chunks, besides its own, that need it as a neighbour.

    ``ends``: per chunk its first and last page, and the first and last one that differs from these (or None).
    """
    wanted: dict[tuple, list[int]] = {}
    for order, first, last, other in ((sorted(ends), 0, 1, 3), (sorted(ends, reverse=True), 1, 0, 2)):
        near = differs = None                      # the page passed last, and the last one that differs from it
        for k in order:
            page = ends[k][first]
            found = near if near is None or near[3] != page[3] else differs
            if found is not None and found[0] == page[0]:
                wanted.setdefault(found, []).append(k)
            end, inner = ends[k][last], ends[k][other]
            if inner is not None:
                differs = inner
            elif near is not None and near[3] != end[3]:
                differs = near
            near = end
    return wanted


def host_of(url):
    """After the first :// up to / ? # or the end, A-Z in lower case; null or no ://: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def extract(pages: DataFrame, seed: int = 42) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    keys = ["host", "path", F.coalesce("page_id", F.lit(-2 ** 63)).alias("id")]
    narrow = rows.select(*keys)
    n = narrow.count()
    chunks = max(1, min(MAX_CHUNKS, n // PAGES_PER_CHUNK))
    sample = sorted((r.host, r.path, r.id) for r in
                    narrow.orderBy(F.xxhash64(F.lit(seed), "host", "path", "id")).limit(chunks * OVERSAMPLE).collect())
    splitters = sorted({sample[i * len(sample) // chunks] for i in range(1, chunks)}) if sample else []

    rows = rows.withColumn("id", keys[2])

    def digests(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                out = [(bisect.bisect_right(splitters, (host, path, id_)), host, path, id_, _digest([t for t, _ in blocks(text or "")]))
                       for text, host, path, id_ in zip(*(c.to_pylist() for c in b.slice(s, 256).columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [_TYPES[0], *_TYPES[4:8]])],
                                                 names=["chunk", "host", "path", "id", "digest"])

    page = F.struct("host", "path", "id", "digest")
    each = cut(rows.select("html", "host", "path", "id").mapInArrow(
        digests, "chunk int, host string, path string, id long, digest string").groupBy("chunk", "digest").agg(
        F.min(page).alias("lo"), F.max(page).alias("hi")))
    ends: dict[int, list] = {}
    for end, falling in (("lo", False), ("hi", True)):                    # the two outermost runs of a chunk
        rank = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc(end) if falling else F.col(end)))
        for r in each.select("chunk", end, rank.alias("rank")).where("rank <= 2").collect():
            ends.setdefault(r.chunk, [None] * 4)[falling + 2 * (r.rank - 1)] = tuple(r[end])
    wanted = _neighbours(ends)

    def parse(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                out = []
                for page_id, url, text, host, path, id_ in zip(*(c.to_pylist() for c in b.slice(s, 256).columns)):
                    found = blocks(text or "")
                    texts, kinds = [t for t, _ in found], [x for _, x in found]
                    digest, k = _digest(texts), bisect.bisect_right(splitters, (host, path, id_))
                    row = (page_id, url, host, path, id_, digest, texts, kinds)
                    out.append((k, True, *row))
                    out += [(c, False, *row) for c in wanted.get((host, path, id_, digest), ())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

    parts = max(n_partitions(pages.sparkSession), chunks // 2)            # a task's share doesn't grow with the table
    placed = rows.select("page_id", "url", "html", "host", "path", "id").mapInArrow(parse, _SCHEMA).repartition(
        parts, "chunk").sortWithinPartitions("chunk", "host", "path", "id", "digest")

    def run(batches):
        place = texts = last_kinds = before = path_before = None           # place: (chunk, host) of the run
        members, out = [], []                                             # the run's pages of this chunk; finished rows

        def written(least):
            while len(out) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[:500]), _OUT)], names=["page_id", "url", "text"])
                del out[:500]

        def finished(after):
            for row in run_texts(texts, members, before, after):
                out.append(row)
                yield from written(500)

        for b in batches:
            for k, own, page_id, url, host, path, _, _, now, kinds in (r for s in range(0, b.num_rows, 64) for r in zip(
                    *(c.to_pylist() for c in b.slice(s, 64).columns))):
                if place != (k, host) or texts != now:
                    same = place == (k, host)
                    if members:
                        yield from finished((path, now) if same else None)
                    before = (path_before, texts) if same else None
                    place, texts, members, last_kinds = (k, host), now, [], None
                if kinds == last_kinds:
                    kinds = last_kinds                                    # held once
                last_kinds, path_before = kinds, path
                if own:
                    members.append((page_id, url, path, kinds))
        if members:
            yield from finished(None)
        yield from written(1)

    return placed.mapInArrow(run, "page_id long, url string, text string")


_NAMES = ["chunk", "own", "page_id", "url", "host", "path", "id", "digest", "texts", "kinds"]
_TYPES = [pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())]
_SCHEMA = ("chunk int, own boolean, page_id long, url string, host string, path string, id long, digest string, "
           "texts array<string>, kinds array<int>")
_OUT = [pa.int64(), pa.string(), pa.string()]
