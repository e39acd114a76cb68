"""File sources and sinks on temporary folders (FIXTURES.md §3 Files / Labels)."""
import io
import os
import tempfile
import zipfile

from precis.sources import files as FS


def _tree():
    root = tempfile.mkdtemp(prefix="precis-files-")
    os.makedirs(f"{root}/A/B")
    open(f"{root}/A/x.txt", "w").write("Hello there. General Kenobi!")
    open(f"{root}/A/B/y.TXT", "w").write("not found")
    open(f"{root}/z.md", "w").write("not found")
    open(f"{root}/A/bad.txt", "wb").write(b"caf\xe9\xff ok\r\nnext")
    open(f"{root}/A/B/e.pdf", "wb").write(b"")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:r><w:t>First para</w:t></w:r></w:p>'
                                        f'<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
                                        f'<w:p><w:r><w:t>Second</w:t></w:r><w:r><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r>'
                                        f'</w:p></w:txbxContent></w:r></w:p></w:body></w:document>')
    open(f"{root}/A/B/d.docx", "wb").write(buf.getvalue())
    open(f"{root}/A/broken.docx", "wb").write(b"not a zip")
    return root


def test_discover_and_extract(spark):
    root = _tree()
    found = [r["rel_path"] for r in FS.discover(spark, root).collect()]
    assert found == ["A/B/d.docx", "A/bad.txt", "A/broken.docx", "A/x.txt"]
    got = {r["rel_path"]: (r["text"], r["error"]) for r in FS.extract_text(FS.discover(spark, root, with_content=True)).collect()}
    assert got["A/bad.txt"][0] == "caf ok\nnext"
    assert got["A/x.txt"][0] == "Hello there. General Kenobi!"
    assert got["A/B/d.docx"] == ("First para\nSecond", None)
    assert got["A/broken.docx"][0] == "" and got["A/broken.docx"][1]
    assert FS.discover(spark, root + "/missing").count() == 0


def test_labels_last_duplicate_wins(spark):
    d = tempfile.mkdtemp(prefix="precis-lab-")
    open(f"{d}/l.csv", "w").write("ID,Category,Other\n1,X,a\n2,,b\n,Y,c\n1,Z,d\n")
    lab = {r["doc_id"]: r["category"] for r in FS.load_labels(spark, f"{d}/l.csv").collect()}
    assert lab == {"1": "Z"}
    open(f"{d}/q.csv", "w").write('ID,Category,Resume\n1,HR,"line one\nline, two"\n2,"says ""IT""","a ""b"", c"\n')
    quoted = {r["doc_id"]: r["category"] for r in FS.load_labels(spark, f"{d}/q.csv").collect()}
    assert quoted == {"1": "HR", "2": 'says "IT"'}
    assert FS.load_labels(spark, f"{d}/nope.csv") is None
    assert FS.load_labels(spark, f"{d}/l.csv", id_col="Nope") is None


def test_summary_tree_roundtrip(spark):
    base = tempfile.mkdtemp(prefix="precis-sum-")
    os.makedirs(f"{base}/luhn/A")
    open(f"{base}/luhn/A/r1_summary.txt", "w").write("  good summary \n")
    open(f"{base}/luhn/r2_summary.txt", "wb").write(b"caf\xe9")
    open(f"{base}/luhn/r3_summary.txt", "w").write("   ")
    open(f"{base}/luhn/r4.txt", "w").write("ignored")
    for where in (base, "file://" + base, base + "/"):
        got = {(r["model"], r["resume_id"]): r["summary"] for r in FS.read_summary_tree(spark, where).collect()}
        assert got == {("luhn", "r1"): "good summary", ("luhn", "r2"): "café"}


def test_write_sinks(spark):
    out = tempfile.mkdtemp(prefix="precis-out-")
    df = spark.createDataFrame([("luhn", 1, "a"), ("lsa", 2, "b")], "model string, doc_id long, summary string")
    FS.write_summaries(df, f"{out}/summaries")
    back = spark.read.parquet(f"{out}/summaries")
    assert sorted(back.columns) == ["doc_id", "model", "summary"] and back.count() == 2
    overall = spark.createDataFrame([("luhn", 0.5, 0.4, 0.3, None), ("bad", None, None, None, "boom")],
                                    "model string, accuracy double, f1_weighted double, f1_macro double, error string")
    FS.write_results(f"{out}/res", overall=overall)
    ok = spark.read.option("header", "true").csv(f"{out}/res/classification_overall_success").collect()
    assert [tuple(r) for r in ok] == [("luhn", "0.5000", "0.4000", "0.3000")]


def test_file_bodies_are_not_shuffled(spark):
    plan = FS.discover(spark, _tree(), with_content=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_summary_tree_round_trip(spark):
    """A5 -> A6 by both path rules; a second write replaces its files and leaves other models alone."""
    from precis.sources.tree import write_summary_tree
    for preserve in (True, False):
        out = tempfile.mkdtemp(prefix="precis-tree-") + "/summaries"
        rows = [("luhn", "A/B/x.txt", "Été.\nTwo."), ("luhn", "y.txt", "Three."), ("kl", "A/B/x.txt", "Four."), ("kl", "e.txt", None)]
        df = spark.createDataFrame(rows, "model string, rel_path string, summary string")
        write_summary_tree(df.repartition(3), out, preserve)
        read = lambda: sorted(tuple(r) for r in FS.read_summary_tree(spark, out).collect())
        ids = ["x", "y"] if preserve else ["A_B_x", "y"]
        assert read() == [("kl", ids[0], "Four."), ("luhn", ids[0], "Été.\nTwo."), ("luhn", "y", "Three.")]
        assert os.path.exists(f"{out}/luhn/A/B/x_summary.txt" if preserve else f"{out}/luhn/A_B_x_summary.txt")
        assert os.path.exists(f"{out}/_SUCCESS") and os.listdir(f"{out}/_temporary") == []
        write_summary_tree(df.where("model = 'kl' AND summary IS NOT NULL").selectExpr("model", "rel_path", "'Five.' AS summary"), out, preserve)
        assert read() == [("kl", ids[0], "Five."), ("luhn", ids[0], "Été.\nTwo."), ("luhn", "y", "Three.")]


def test_a_failed_task_leaves_no_summary_under_its_name(spark):
    import pytest
    from pyspark.sql import functions as F

    from precis.sources.tree import write_summary_tree
    out = tempfile.mkdtemp(prefix="precis-tree-") + "/summaries"
    bad = spark.range(4).coalesce(1).select(F.lit("m").alias("model"), F.concat("id", F.lit(".txt")).alias("rel_path"),
                                            F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise("text").alias("summary"))
    with pytest.raises(Exception):
        write_summary_tree(bad, out)
    assert FS.read_summary_tree(spark, out).count() == 0 and not os.path.exists(f"{out}/_SUCCESS")


def test_rewriting_one_model_leaves_the_others(spark):
    out = tempfile.mkdtemp(prefix="precis-parquet-") + "/summaries"
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "model string, doc_id long, summary string")
    FS.write_summaries(df, out)
    FS.write_summaries(df.where("model = 'a'").selectExpr("model", "doc_id", "'z' AS summary"), out)
    assert sorted((r.model, r.summary) for r in spark.read.parquet(out).collect()) == [("a", "z"), ("b", "y")]


def test_first_category_by_order(spark):
    from precis.operators.split import stratified_split
    rows = [("1", "x", 2), ("1", "y", 1), ("2", "x", 1), ("3", "y", 5), ("4", "x", 3), ("4", "y", 3)]
    recs = spark.createDataFrame(rows, "doc_id string, category string, at int")
    first = lambda **o: {r.doc_id: r.category for r in stratified_split(recs, **o).collect()}
    assert first(order_col="at") == {"1": "y", "2": "x", "3": "y", "4": "x"}
    assert first()["1"] == "x"
