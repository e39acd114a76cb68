"""File sources and sinks.

Documents and summary trees are read with Spark's ``binaryFile`` source, so
discovery and decoding are scan tasks spread over the cluster; the only
Python step is the DOCX unzip (``mapInPandas``, per row, small helper).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from precis.functions.text import SUMMARY_SUFFIX, id_from_summary_name, strip_ws

# The document types the pipeline discovers.
SUPPORTED_EXTENSIONS = ("pdf", "docx", "txt")
REPLACEMENT_CHAR = "�"

_BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _relative(spark: SparkSession, path_col, base: str):
    """Path relative to ``base``: both are compared as fully qualified paths, whatever scheme the base names."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    qualified = fs.makeQualified(path).toUri().getPath().rstrip("/")
    plain = F.regexp_replace(path_col, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(plain.startswith(qualified + "/"), F.substring(plain, len(qualified) + 2, 1 << 30)).otherwise(plain)


def discover(spark: SparkSession, raw_dir: str, extensions=SUPPORTED_EXTENSIONS,
             with_content: bool = False) -> DataFrame:
    """A1: (path, rel_path, ext, length[, content]) of supported files (listings sorted by path).

    The glob is case-sensitive (``x.TXT`` is not found); a missing folder
    gives an empty frame; zero-byte files are not emitted. Discovery alone
    prunes the ``content`` column, so no file body is read.
    """
    glob = "*.{" + ",".join(extensions) + "}"
    try:
        df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", glob).load(raw_dir))
    except AnalysisException:
        return spark.createDataFrame([], _BINARY_SCHEMA).select(
            "path", F.lit("").alias("rel_path"), F.lit("").alias("ext"), "length",
            *(["content"] if with_content else []))
    cols = ["path", _relative(spark, F.col("path"), raw_dir).alias("rel_path"),
            F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext"), "length"]
    if with_content:
        cols.append("content")
    # one glob lists a path once; only listings are sorted, file bodies are never shuffled
    found = df.where(F.col("length") > 0).select(*cols)
    return found if with_content else found.orderBy("path")


def decode_ignore_errors(content_col) -> "F.Column":
    """A2: UTF-8 with invalid bytes dropped, universal newlines (\\r\\n, \\r -> \\n)."""
    text = F.regexp_replace(F.make_valid_utf8(F.col(content_col).cast("string")), REPLACEMENT_CHAR, "")
    return F.regexp_replace(text, "\r\n?", "\n")


def _docx_texts(batches):
    """mapInPandas: DOCX bytes -> paragraphs joined by newlines; failure -> ('', error)."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    for pdf in batches:
        texts, errors = [], []
        for blob in pdf["content"]:
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(blob))) as z:
                    root = ElementTree.fromstring(z.read("word/document.xml"))
                paras = []
                for p in root.findall(f"{ns}body/{ns}p"):     # body paragraphs only: no tables, no text boxes
                    parts = []
                    boxed = {x for box in p.iter(ns + "txbxContent") for x in box.iter()}
                    for node in p.iter():
                        if node in boxed:
                            continue
                        if node.tag == ns + "t" and node.text:
                            parts.append(node.text)
                        elif node.tag == ns + "tab":
                            parts.append("\t")
                        elif node.tag in (ns + "br", ns + "cr"):
                            parts.append("\n")
                    paras.append("".join(parts))
                texts.append("\n".join(paras))
                errors.append(None)
            except Exception as exc:  # per-row failure, like the reference's skip
                texts.append("")
                errors.append(re.sub(r"\s+", " ", f"{type(exc).__name__}: {exc}"))
        out = pdf.drop(columns=["content"])
        out["text"] = texts
        out["error"] = errors
        yield out


def extract_text(files: DataFrame) -> DataFrame:
    """A3: (path, rel_path, ext, text, error) routed on the lower-cased extension.

    txt and unknown extensions: A2 decoding; docx: paragraphs; pdf: not
    supported here (empty text and an error value). Empty text rows are kept
    (callers skip them, C1).
    """
    base = files.select("path", "rel_path", "ext", "content")
    docx = base.where(F.col("ext") == "docx").mapInPandas(
        _docx_texts, "path string, rel_path string, ext string, text string, error string")
    pdf = base.where(F.col("ext") == "pdf").select(
        "path", "rel_path", "ext", F.lit("").alias("text"), F.lit("pdf: no parser available").alias("error"))
    plain = base.where(~F.col("ext").isin("docx", "pdf")).select(
        "path", "rel_path", "ext", decode_ignore_errors("content").alias("text"),
        F.lit(None).cast("string").alias("error"))
    return plain.unionByName(docx).unionByName(pdf)


def load_labels(spark: SparkSession, csv_path: str, id_col: str = "ID",
                category_col: str = "Category") -> DataFrame | None:
    """A4: (doc_id, category) strings; null rows dropped; last duplicate id wins.

    Quoted fields may hold line breaks and doubled quotes. Read as one file so
    ``monotonically_increasing_id`` follows line order.
    A missing file or column returns None (the reference aborts).
    """
    try:
        raw = (spark.read.option("header", "true").option("inferSchema", "false")
               .option("multiLine", "true").option("escape", '"').csv(csv_path))
    except AnalysisException:
        return None
    if id_col not in raw.columns or category_col not in raw.columns:
        return None
    rows = (raw.select(F.col(id_col).alias("doc_id"), F.col(category_col).alias("category"))
            .withColumn("_line", F.monotonically_increasing_id())
            .dropna(subset=["doc_id", "category"]))
    return rows.groupBy("doc_id").agg(F.max_by("category", "_line").alias("category"))


def write_summaries(summaries: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """A5: (model, doc_id, summary) as Parquet partitioned by model; overwriting replaces the models written, no others."""
    summaries.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(out_dir)


def read_summary_tree(spark: SparkSession, base_dir: str) -> DataFrame:
    """(model, resume_id, summary) from ``<base>/<model>/**/<id>_summary.txt``.

    Strict UTF-8, else Latin-1; stripped; empty summaries dropped. The model
    is the first folder under ``base_dir``.
    """
    try:
        df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", f"*{SUMMARY_SUFFIX}.txt").load(base_dir))
    except AnalysisException:
        return spark.createDataFrame([], "model string, resume_id string, summary string")
    rel = _relative(spark, F.col("path"), base_dir)
    as_utf8 = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode("content", "ISO-8859-1"))
    out = (df.select(rel.alias("rel"), strip_ws(F.regexp_replace(text, "\r\n?", "\n")).alias("summary"))
           .where(F.col("rel").contains("/"))
           .select(F.regexp_extract("rel", r"^([^/]+)/", 1).alias("model"),
                   id_from_summary_name("rel").alias("resume_id"), "summary")
           .where(F.col("summary") != ""))
    return out


def write_results(out_dir: str, overall: DataFrame | None = None, per_category: DataFrame | None = None,
                  efficiency: DataFrame | None = None) -> None:
    """Result tables as single CSV files (they have one row per model/category).

    Success rows sorted by weighted F1 desc (4 dp), errors separately,
    per-category by (model, category) (4 dp), efficiency (3 dp).
    """
    def _csv(df, name):
        df.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{out_dir.rstrip('/')}/{name}")

    def _fixed(df, cols, dp):
        return df.select(*[F.format_string(f"%.{dp}f", F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])

    if overall is not None:
        _csv(_fixed(success_rows(overall), ("accuracy", "f1_weighted", "f1_macro"), 4), "classification_overall_success")
        _csv(error_rows(overall), "classification_overall_errors")
    if per_category is not None:
        if overall is not None:
            per_category = successful_categories(per_category, overall)
        _csv(_fixed(per_category.orderBy("model", "category"), ("precision", "recall", "f1_score"), 4),
             "classification_per_category")
    if efficiency is not None:
        _csv(_fixed(efficiency, ("total_s", "avg_s", "min_s", "max_s"), 3), "efficiency_summary")


def success_rows(overall: DataFrame) -> DataFrame:
    """Models without an error, best weighted F1 first."""
    return overall.where(F.col("error").isNull()).drop("error").orderBy(F.col("f1_weighted").desc_nulls_last(), "model")


def error_rows(overall: DataFrame) -> DataFrame:
    """The models that failed and why."""
    return overall.where(F.col("error").isNotNull()).select("model", "error")


def successful_categories(per_category: DataFrame, overall: DataFrame) -> DataFrame:
    """Per-category rows of models without an error (one row per model: a checked, small side)."""
    return per_category.join(overall.where(F.col("error").isNull()).select("model"), "model", "left_semi")


def preview(files: DataFrame, n: int = 5) -> list[str]:
    """the first ``n`` discovered paths (the console preview; a limit is the feature)."""
    return [r["path"] for r in files.select("path").orderBy("path").limit(n).collect()]
