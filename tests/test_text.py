"""Hand fixtures for the scalar text functions and line segmentation (FIXTURES.md §3)."""
import re

from pyspark.sql import functions as F

from precis.functions import text as T
from precis.operators.sentences import segment, sentences, tokens

CLEAN_CASES = [
    ("  Hello,\n\tWorld!  ", "Hello, World"),
    ("C++ / C# (5%) a_b", "C++ / C (5) a_b"),
    ("a !! b", "a  b"),
    ("!! a", " a"),
    ("naïve café — résumé!", "naïve café  résumé"),
    ("x² ½ ①", "x² ½ ①"),
    ("me@x.org | +1 (555) 0-1", "me@x.org  +1 (555) 0-1"),
    ("", ""),
    (None, ""),
]


def py_clean(t):
    if not t:
        return ""
    t = re.sub(r"\s+", " ", t).strip()
    return re.sub(r"[^\w\s.,\-@+_/()]", "", t)


def test_clean_fixtures(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEAN_CASES)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", T.clean_text("t").alias("c")).collect()}
    for i, (_, want) in enumerate(CLEAN_CASES):
        assert got[i] == want, (CLEAN_CASES[i], got[i])


def test_clean_matches_python_on_corpus(spark):
    from table_paths import SF_TINY
    docs = spark.read.parquet(f"{SF_TINY}/pages.parquet").select("page_id", "html")
    rows = docs.select("html", T.clean_text("html").alias("c")).collect()
    bad = [r for r in rows if py_clean(r["html"]) != r["c"]]
    assert not bad


SEG_TEXT = ("Jane Doe\n\nSummary\n  Data lead\nWORK EXPERIENCE\n  Acme\nExperienced with Spark\n"
            "Skills: SQL\nEducation\nBSc\nObjective\nGrow")


def _sections(spark, text, rules=None):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {r["section"]: (r["section_ord"], r["text"]) for r in segment(df, rules).collect()}


def test_segment_fixture(spark):
    s = _sections(spark, SEG_TEXT)
    assert s["header"] == (0, "Jane Doe\nSummary\n  Data lead\nObjective\nGrow")
    assert s["experience"][1] == "WORK EXPERIENCE\n  Acme\nExperienced with Spark"
    assert s["skills"][1] == "Skills: SQL"
    assert s["education"][1] == "Education\nBSc"
    assert sorted(v[0] for v in s.values()) == [0, 1, 2, 3]


def test_segment_edge_cases(spark):
    assert _sections(spark, "  Key  Skills \n a\n") == {"skills": (0, "Key  Skills\n a")}
    assert _sections(spark, "Projects\nX") == {"projects": (0, "Projects\nX")}
    assert _sections(spark, "") == {}
    assert _sections(spark, "\n \n") == {}


def py_segment(text, rules):
    sections = {"header": []}
    cur = "header"
    for line in text.split("\n"):
        lc = line.strip()
        if not lc:
            continue
        m = next((n for n, p in rules if re.match(p, lc, re.IGNORECASE)), None)
        if m and m != cur:
            cur = m
            sections.setdefault(cur, []).append(lc)
        else:
            sections.setdefault(cur, []).append(line)
    return {k: "\n".join(v).strip() for k, v in sections.items() if v}


def test_segment_matches_state_machine_on_corpus(spark):
    from table_paths import SF_TINY
    from precis.plans.queries import QUERY_SECTION_RULES
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in segment(docs, QUERY_SECTION_RULES).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = r["text"]
    for r in docs.collect():
        assert got.get(r["doc_id"], {}) == py_segment(r["text"], QUERY_SECTION_RULES)


def test_sentences_and_tokens(spark):
    df = spark.createDataFrame([(1, "Dr. Smith works!  Big data?\n\nyes")], "doc_id long, text string")
    s = sentences(df).orderBy("sent_id").collect()
    assert [r["sentence"] for r in s] == ["Dr.", "Smith works!", "Big data?", "yes"]
    t = tokens(sentences(df)).orderBy("sent_id", "pos").collect()
    assert [r["word"] for r in t] == ["dr", "smith", "works", "big", "data", "yes"]


def test_paths_and_ids(spark):
    df = spark.createDataFrame([("A/B/x.txt",), ("y.pdf",)], "rel string")
    r = df.select(T.summary_path(F.lit("luhn"), "rel", True).alias("p"),
                  T.summary_path(F.lit("luhn"), "rel", False).alias("f")).collect()
    assert (r[0]["p"], r[0]["f"]) == ("luhn/A/B/x_summary.txt", "luhn/A_B_x_summary.txt")
    assert (r[1]["p"], r[1]["f"]) == ("luhn/y_summary.txt", "luhn/y_summary.txt")
    ids = spark.createDataFrame([("r1_summary.txt",), ("r1.txt",), ("r1_summary_summary.txt",)], "p string")
    assert [x[0] for x in ids.select(T.id_from_summary_name("p")).collect()] == ["r1", "r1", "r1_summary"]


def test_prefix_truncation_bounds(spark):
    df = spark.createDataFrame([("t5-base", "a  b c"), ("flan-t5", "a b")], "m string, t string")
    out = [r[0] for r in df.select(T.truncate_words(T.task_prefix("m", "t"), 3)).collect()]
    assert out == ["summarize: a b", "a b"]
    assert T.generation_bounds(150) == (15, 150)
    assert T.generation_bounds(50) == (10, 50)


def test_stop_words_list():
    words = T.english_stop_words()
    assert "the" in words and "and" in words and len(words) > 100


def test_segment_is_independent_of_batches_and_partitions(spark):
    from table_paths import SF_TINY
    from precis.plans.queries import QUERY_SECTION_RULES
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text")
    a = {tuple(r) for r in segment(docs, QUERY_SECTION_RULES).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        b = {tuple(r) for r in segment(docs.repartition(5), QUERY_SECTION_RULES).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert a == b
    # a document's sections don't depend on the documents beside it in an Arrow batch
    alone = sorted(tuple(r)[1:] for r in segment(spark.createDataFrame([(1, SEG_TEXT)], "doc_id long, text string")).collect())
    among = segment(spark.createDataFrame([(0, "x"), (1, SEG_TEXT), (2, ""), (3, None), (4, SEG_TEXT), (5, "Skills")],
                                          "doc_id long, text string").coalesce(1)).collect()
    for i in (1, 4):
        assert sorted(tuple(r)[1:] for r in among if r.doc_id == i) == alone
    assert {(r.doc_id, r.section) for r in among if r.doc_id not in (1, 4)} == {(0, "header"), (5, "skills")}


def test_strip_takes_all_white_space_at_both_ends_only(spark):
    """Every character of the class, against the class itself as a pattern."""
    white = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and re.fullmatch(r"\s", c)] + ["​", "᠎", "﻿", "\x00"]
    texts = [f"{c}{c} a{c}b é\U0001f600{c}" for c in white] + ["", " ", "　\n", "x", None, "".join(white)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    by_pattern = F.regexp_replace("t", rf"^{T.WS_CLASS}+|{T.WS_CLASS}+\z", "")
    assert df.where(~T.strip_ws("t").eqNullSafe(by_pattern)).count() == 0
    assert df.where(T.strip_ws("t") != F.col("t")).count() > 25
