"""Sentence and token frames (B10, B11) and line segmentation.

All generators run in the scan stage (``posexplode`` of a regex match array),
so splitting a corpus costs no shuffle. The ``_outer`` generators plus an
explicit null filter are used on purpose: for a plain ``explode`` Catalyst
infers a ``size(array) > 0`` filter below the generator, which evaluates the
regex extraction a second time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.functions.text import DEFAULT_SECTION_RULES, sentence_array, section_of, strip_ws, token_array
from precis.session import ship_package


def named(column: str, name: str):
    """The column under ``name``, without an alias where it has that name (an alias hides a kept partitioning)."""
    return F.col(column) if column == name else F.col(column).alias(name)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_id, sentence): ordered, stripped, non-blank sentences.

    ``sent_id`` is the position of the match in the text (0-based); blank
    matches are dropped, so ids may have gaps but keep document order.
    """
    return (docs
            .where(F.length(text_col) > 0)
            .select(named(id_col, "doc_id"),
                    F.posexplode_outer(sentence_array(text_col)).alias("sent_id", "raw"))
            .select("doc_id", "sent_id", strip_ws("raw").alias("sentence"))
            .where(F.col("sentence") != ""))


def tokens(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pos, word): word tokens of every sentence, in order."""
    return (sents.select("doc_id", "sent_id",
                         F.posexplode_outer(token_array("sentence")).alias("pos", "word"))
            .where(F.col("word").isNotNull()))


def _running_section(header: int):
    """Arrow function: per document, rule numbers of its lines (null: no rule) -> (cur, switched) per line.

    ``cur`` is the last rule at or before the line (``header`` before any), ``switched`` tells whether the line changes it.
    """
    @F.arrow_udf("struct<cur: array<int>, switched: array<boolean>>")
    def run(rules: pa.Array) -> pa.Array:
        if isinstance(rules, pa.ChunkedArray):
            rules = rules.combine_chunks()
        offsets = rules.offsets.to_numpy().astype(np.int64) - rules.offsets[0].as_py()
        rule = rules.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        first = np.repeat(offsets[:-1], np.diff(offsets))                # each line's first line of the document
        line = np.arange(len(rule))
        last = np.maximum.accumulate(np.where(rule >= 0, line, -1)) if len(rule) else line
        cur = np.where(last >= first, rule[np.maximum(last, 0)] if len(rule) else rule, header)
        before = np.where(line == first, header, np.r_[header, cur[:-1]]) if len(rule) else cur
        at = pa.array(offsets, pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(at, pa.array(cur, pa.int32())),
             pa.ListArray.from_arrays(at, pa.array((rule >= 0) & (rule != before), pa.bool_()))], names=["cur", "switched"])

    return run


def segment(docs: DataFrame, rules=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, section_ord, text) by the line state machine.

    The current section of a line is the last rule match at or before it (``header`` before any match); a line that
    switches section contributes its stripped form, every other line its raw form. Blank lines go; a section's lines are
    joined by newlines, sections are in order of their first line, the header first.

    A document is one row: its lines are an array, the running match is one forward fill over the lines of an Arrow
    batch (the only part that isn't a JVM expression), and sections are filters of the array. Nothing is shuffled, no
    window holds a document, and memory follows the longest document.
    """
    ship_package(docs.sparkSession)
    rules = rules or DEFAULT_SECTION_RULES
    names = list(dict.fromkeys([*(name for name, _ in rules), "header"]))
    header = names.index("header")
    of_name = F.array(*[F.lit(n) for n in names])
    split = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1),
                        lambda x: F.struct(x.alias("line"), strip_ws(x).alias("stripped")))
    rule = F.transform("lines", lambda x: (F.array_position(of_name, section_of(x["stripped"], rules)) - 1).cast("int"))
    rows = (docs.select(named(id_col, "doc_id"), F.filter(split, lambda x: x["stripped"] != "").alias("lines"))
            .withColumn("run", _running_section(header)(rule))
            .select("doc_id", F.col("run.cur").alias("cur"), F.transform(
                F.arrays_zip("lines", F.col("run.cur").alias("cur"), F.col("run.switched").alias("switched")),
                lambda z: F.struct(z["cur"].alias("cur"), F.when(z["switched"], z["lines"]["stripped"])
                                   .otherwise(z["lines"]["line"]).alias("piece"))).alias("pieces")))
    order = F.array_distinct(F.concat(F.filter("cur", lambda c: c == header), F.col("cur")))
    text = lambda c: F.array_join(F.transform(F.filter("pieces", lambda p: p["cur"] == c), lambda p: p["piece"]), "\n")
    sections = F.transform(order, lambda c: F.struct(F.element_at(of_name, c + 1).alias("section"), strip_ws(text(c)).alias("text")))
    return (rows.select("doc_id", F.posexplode_outer(sections).alias("section_ord", "s")).where(F.col("s").isNotNull())
            .select("doc_id", "s.section", "section_ord", "s.text"))
