"""Scalar text expressions (JVM-side, whole-stage codegen friendly).

Every function here returns a ``Column`` built from ``pyspark.sql.functions``
so it runs inside the scan stage on executors; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from precis.functions.stopwords import ENGLISH

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced)
# ---------------------------------------------------------------------------
# Whitespace as Python's str.isspace() defines it: \t \n \v \f \r, the
# information separators \x1c-\x1f, NEL \x85 and the Unicode Z categories.
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
# The same characters one by one (\p{Z}: the space, line and paragraph separators).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# Characters kept by the cleaner: word characters, whitespace and . , - @ + _ / ( )
# (after whitespace has been collapsed to single spaces, space is the only one left).
CLEAN_DROP = r"[^\p{L}\p{N}_ .,\-@+/()]"
# Sentence: a run of non-terminators followed by its terminators.
SENTENCE_RE = r"[^.!?\n]+[.!?]*"
# Classifier / summariser token: run of two or more word characters.
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
# Default section rules, in priority order (first match wins), matched
# case-insensitively as a prefix of the stripped line.
DEFAULT_SECTION_RULES = [
    ("header", r"^(summary|profile|objective)"),
    ("experience", r"^(work\s*experience|professional\s*experience|experience)"),
    ("education", r"^(education|academic\s*background)"),
    ("skills", r"^(technical\s*skills|key\s*skills|skills)"),
    ("projects", r"^(projects|personal\s*projects)"),
]
SUMMARY_SUFFIX = "_summary"
T5_PREFIX = "summarize: "


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove the whitespace class at both ends (only the ends are looked at)."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def clean_text(col) -> Column:
    """B1: collapse whitespace runs, strip, then delete disallowed characters.

    Deletion happens after the strip and nothing is collapsed again, so
    ``"a !! b"`` becomes ``"a  b"``. Null gives ``""``.
    """
    collapsed = F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), f"{WS_CLASS}+", " "))
    return F.regexp_replace(collapsed, CLEAN_DROP, "")


def section_of(stripped_line, rules=None) -> Column:
    """B2: name of the first rule whose pattern matches the start of the line."""
    rules = rules or DEFAULT_SECTION_RULES
    expr = None
    for name, pattern in rules:
        pat = pattern if pattern.startswith("^") else "^" + pattern
        cond = _c(stripped_line).rlike("(?iu)" + pat)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def sentence_array(col) -> Column:
    """Ordered raw sentence matches of a text (not yet stripped)."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(SENTENCE_RE), 0)


def token_array(col) -> Column:
    """Lower-cased runs of >= 2 word characters, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(TOKEN_RE), 0)


def english_stop_words() -> tuple[str, ...]:
    """The English stop-word list (same as Spark MLlib's default list)."""
    return ENGLISH


def remove_stop_words(tokens, stop_words=None) -> Column:
    """Drop stop words from a token array, keeping order and duplicates."""
    words = stop_words if stop_words is not None else english_stop_words()
    return F.filter(_c(tokens), lambda x: ~x.isin(*words))        # a hash set, not a scan of the list per token


def bigrams(tokens) -> Column:
    """Adjacent pairs of an array joined by one space."""
    arr = _c(tokens)
    head = F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0)))
    return F.transform(head, lambda x, i: F.concat(x, F.lit(" "), F.element_at(arr, i + 2)))


def unigrams_and_bigrams(tokens) -> Column:
    return F.concat(_c(tokens), bigrams(tokens))


# ---------------------------------------------------------------------------
# Paths and identifiers
# ---------------------------------------------------------------------------
def path_parent(rel_path) -> Column:
    """Parent folder of a relative path; '' for a file at the root."""
    return F.regexp_extract(_c(rel_path), r"^(.*)/[^/]*$", 1)


def path_stem(rel_path) -> Column:
    """File name without its last extension."""
    name = F.regexp_extract(_c(rel_path), r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def summary_path(model, rel_path, preserve: bool = True) -> Column:
    """Where the summary of ``rel_path`` by ``model`` is written."""
    parent, stem = path_parent(rel_path), path_stem(rel_path)
    fname = F.concat(stem, F.lit(SUMMARY_SUFFIX + ".txt"))
    if preserve:
        return F.when(parent == "", F.concat_ws("/", _c(model), fname)) \
                .otherwise(F.concat_ws("/", _c(model), parent, fname))
    flat = F.when(parent == "", fname).otherwise(
        F.concat(F.regexp_replace(parent, "/", "_"), F.lit("_"), fname))
    return F.concat_ws("/", _c(model), flat)


def id_from_summary_name(path) -> Column:
    """Stem of a summary file with one trailing ``_summary`` removed."""
    return F.regexp_replace(path_stem(path), SUMMARY_SUFFIX + "$", "")


def record_key(model, doc_id) -> Column:
    """``<model>__<id>``."""
    return F.concat_ws("__", _c(model), _c(doc_id).cast("string"))


def task_prefix(model, text) -> Column:
    """seq2seq task prefix for models whose name starts with ``t5``."""
    return F.when(_c(model).startswith("t5"), F.concat(F.lit(T5_PREFIX), _c(text))).otherwise(_c(text))


def truncate_words(text, max_words: int) -> Column:
    """First ``max_words`` whitespace-separated words, joined by one space."""
    words = F.split(strip_ws(text), f"{WS_CLASS}+")
    words = F.filter(words, lambda w: w != "")
    return F.array_join(F.slice(words, 1, max_words), " ")


def generation_bounds(summary_max_length: int = 150) -> tuple[int, int]:
    """(min_length, max_length) for generation."""
    return max(10, int(summary_max_length * 0.1)), summary_max_length
