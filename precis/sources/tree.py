"""A5 as a tree: one text file per summary, where the tree reader (A6) finds it.

A Python data source: ``summaries.write.format("summary_tree").save(folder)`` on rows (path, summary). A task writes its
files into a folder of its attempt and moves them to their names when all are written, so a failed or lost attempt leaves
no half file under a final name and a repeated one writes the same files again; the driver only marks the end with
``_SUCCESS`` (and removes what attempts left). Folders are URIs that ``pyarrow.fs`` knows, shared by all executors.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from precis.functions.text import summary_path
from precis.session import ship_package

STAGING = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    files: int


def _filesystem(folder: str):
    from pyarrow import fs
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder.rstrip("/")
    found, path = fs.FileSystem.from_uri(folder)
    return found, path.rstrip("/")


class SummaryTree(DataSource):
    """Writer of (path, summary) rows below the folder given by ``path``."""

    @classmethod
    def name(cls) -> str:
        return "summary_tree"

    def schema(self) -> str:
        return "path string, summary string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options["path"])


class TreeWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, rows) -> Written:
        fs, base = _filesystem(self.folder)
        attempt = f"{base}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(attempt, recursive=True)
        names: list[str] = []
        for row in rows:
            with fs.open_output_stream(f"{attempt}/{len(names)}") as out:
                out.write((row["summary"] or "").encode("utf-8", "surrogatepass"))
            names.append(row["path"])
        made = set()
        for i, name in enumerate(names):
            parent = f"{base}/{name}".rsplit("/", 1)[0]
            if parent not in made:
                fs.create_dir(parent, recursive=True)
                made.add(parent)
            fs.move(f"{attempt}/{i}", f"{base}/{name}")
        fs.delete_dir(attempt)
        return Written(len(names))

    def commit(self, messages) -> None:
        fs, base = _filesystem(self.folder)
        self._clear()
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m is not None)).encode())

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileType
        fs, base = _filesystem(self.folder)
        staged = f"{base}/{STAGING}/{self.job}"
        if fs.get_file_info(staged).type == FileType.Directory:
            fs.delete_dir(staged)


def write_summary_tree(summaries: DataFrame, out_dir: str, preserve: bool = True) -> None:
    """A5: (model, rel_path, summary) -> ``<out_dir>/<model>/.../<stem>_summary.txt`` by the B4 rule.

    Files of the same name are replaced; those of other models and documents stay. Null summaries are written empty.
    """
    spark = summaries.sparkSession
    ship_package(spark)
    spark.dataSource.register(SummaryTree)
    (summaries.select(summary_path("model", "rel_path", preserve).alias("path"), F.col("summary").cast("string").alias("summary"))
     .write.format("summary_tree").mode("append").save(out_dir))
