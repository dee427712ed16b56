"""Text and Markdown files as documents, and documents as such files."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import lines
from docloom.operators.storage import scratch, stored

SUFFIXES = ("txt", "md")
#: Subfolders over which files are dealt by their names: in one folder all writers wait for each other.
FOLDERS = 256
#: Files and bytes that a task reads, and bytes of contents that it holds at a time; a longer file is a batch of its own.
TASK_FILES, TASK_BYTES, BATCH_BYTES = 20_000, 64 << 20, 8 << 20
#: Names in a batch of a listing, and files in one of Spark's scans, whose driver holds them all.
LIST_NAMES, SCAN_FILES = 10_000, 10_000
LISTED = "path string, size bigint"


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each text or Markdown file at any depth: path, source_name, source_type by suffix, text, characters, line_count.

    Tasks list the files into a table and read them from it, so the driver holds nothing for each file. As in Spark's
    scans, files and folders whose names mark them as hidden are left out; files of no bytes have an empty text.
    """
    whole = _qualified(spark, folder)
    listed = _listed(spark, whole)
    some = listed.where("size > 0")
    contents = _contents(some, whole) if _opened(whole) else _scanned(some)
    found = contents.select("path", F.decode("content", "UTF-8").alias("text")).unionByName(_empty_files(spark, folder, listed))
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.select("path", name.alias("source_name"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("source_type"), "text")
    return rows.withColumns({"characters": F.length("text"), "line_count": F.size(lines(F.col("text")))})


def _empty_files(spark: SparkSession, folder: str, listed: DataFrame | None = None) -> DataFrame:
    """(path, text) of the files of no bytes in the folder, or in its listing where that is at hand."""
    listed = _listed(spark, _qualified(spark, folder)) if listed is None else listed
    return listed.where("size = 0").select("path", F.lit("").alias("text"))


def _qualified(spark: SparkSession, folder: str) -> str:
    store, root = _store(spark, folder)
    whole = store.makeQualified(root).toString()
    if not store.exists(root):
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {whole}")
    return whole


def _store(spark: SparkSession, folder: str) -> tuple:
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _arrow(whole: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path as Hadoop writes it, and the path there."""
    if whole.startswith("file:"):
        return fs.LocalFileSystem(), "/" + whole.removeprefix("file:").strip("/")
    return fs.FileSystem.from_uri(quote(whole, safe="/:@"))


def _opened(whole: str) -> bool:
    """Whether that is a folder which Arrow can open."""
    try:
        own, start = _arrow(whole)
        return own.get_file_info(start).type == fs.FileType.Directory
    except (OSError, pa.ArrowException):
        return False


def _is_hidden(name: str) -> bool:
    return name[0] == "." or name[0] == "_" and "=" not in name or name.endswith("._COPYING_")


def _is_text(name: str) -> bool:
    return "." in name and not _is_hidden(name) and name.rsplit(".", 1)[-1] in {x for s in SUFFIXES for x in (s, s.upper())}


def _listed(spark: SparkSession, whole: str) -> DataFrame:
    """A stored table (path, size) of the text files below the folder: one task lists it, others walk its subfolders."""
    if not _opened(whole):
        return _listed_by_java(spark, whole)
    root, cores = spark.createDataFrame([(whole,)], "path string"), spark.sparkContext.defaultParallelism
    top = stored(root.mapInArrow(partial(_walk, whole, False), LISTED), "top-files")
    folders = top.where("size is null").select("path").repartition(4 * cores)
    return top.where("size is not null").unionByName(stored(folders.mapInArrow(partial(_walk, whole, True), LISTED), "files"))


def _walk(whole: str, deep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size) of the text files in the given folders below whole; subfolders are walked too, or else told without a size."""
    own, start = _arrow(whole)

    def found() -> Iterator[tuple[str, int | None]]:
        for batch in batches:
            folders = batch.column(0).to_pylist()
            while folders:
                at = folders.pop().rstrip("/")
                for name, size in _entries(own, start.rstrip("/") + at[len(whole.rstrip("/")) :] or "/"):
                    if size is None and deep:
                        folders.append(f"{at}/{name}")
                    else:
                        yield f"{at}/{name}", size

    rows = found()
    while some := list(islice(rows, LIST_NAMES)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int64()), strict=True)], ["path", "size"])


def _entries(own: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Names and sizes of the text files in a folder, and names of its subfolders, one by one where the file system is local."""
    if not isinstance(own, fs.LocalFileSystem):
        for info in own.get_file_info(fs.FileSelector(folder)):
            if info.type == fs.FileType.Directory and not _is_hidden(info.base_name):
                yield info.base_name, None
            elif info.type == fs.FileType.File and _is_text(info.base_name):
                yield info.base_name, info.size
        return
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_dir():
                if not _is_hidden(entry.name):
                    yield entry.name, None
            elif _is_text(entry.name) and entry.is_file():
                yield entry.name, entry.stat().st_size


def _contents(listed: DataFrame, whole: str) -> DataFrame:
    """(path, content) of the listed files, read by tasks of about as many files and bytes."""
    files, size = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(files, listed.sparkSession.sparkContext.defaultParallelism), -(-files // TASK_FILES), -(-size // TASK_BYTES))
    return listed.repartition(tasks).mapInArrow(partial(_read, whole), "path string, content binary")


def _read(whole: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, start = _arrow(whole)
    paths, contents, held = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    for path in chain.from_iterable(b.column(0).to_pylist() for b in batches):
        with own.open_input_stream(start.rstrip("/") + path[len(whole.rstrip("/")) :], compression=None) as f:
            content = f.read()
        if paths and held + len(content) > BATCH_BYTES:
            yield batch()
            paths, contents, held = [], [], 0
        paths.append(path)
        contents.append(content)
        held += len(content)
    if paths:
        yield batch()


def _listed_by_java(spark: SparkSession, whole: str) -> DataFrame:
    """The table of _listed where Arrow can't open the folder: the driver asks Java for file after file, at some calls for each."""
    store, root = _store(spark, whole)
    listing = store.listFiles(root, True)

    def found() -> Iterator[tuple[str, int]]:
        while listing.hasNext():
            file = listing.next()
            path = file.getPath().toString()
            *folders, name = path[len(whole.rstrip("/")) :].strip("/").split("/") if path != whole else [path.rsplit("/", 1)[-1]]
            if _is_text(name) and not any(map(_is_hidden, folders)):
                yield path, file.getLen()

    rows, folder = found(), scratch(spark, "files")
    some = list(islice(rows, LIST_NAMES))
    while True:
        spark.createDataFrame(some, LISTED).write.mode("append").parquet(folder)
        if not (some := list(islice(rows, LIST_NAMES))):
            return spark.read.schema(LISTED).parquet(folder)


def _scanned(listed: DataFrame) -> DataFrame:
    """(path, content) of the listed files by Spark's scans, each of so many files that the driver holds them, one after another."""
    spark, folder, schema = listed.sparkSession, scratch(listed.sparkSession, "contents"), "path string, content binary"
    paths = (r["path"] for r in listed.select("path").toLocalIterator())
    # Else Spark lists each path in a task of its own, and reads a few files in one.
    settings = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": "65536"}
    before = {k: spark.conf.get(k) for k in settings}
    spark.createDataFrame([], schema).write.parquet(folder)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        while some := list(islice(paths, SCAN_FILES)):
            spark.read.format("binaryFile").options(recursiveFileLookup=True, __globPaths__=False).load(some).select("path", "content").write.mode("append").parquet(folder)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(folder)


def write_texts(docs: DataFrame, folder: str) -> DataFrame:
    """Write docs (name with its suffix, text) as UTF-8 files in subfolders of the folder; their paths.

    A repeated task replaces its files whole: a name's subfolder is found by its hash.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made = set()
        for batch in batches:
            paths = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sub = f"{zlib.crc32(name.encode()) % FOLDERS:02x}"
                if sub not in made:
                    store.create_dir(f"{root}/{sub}", recursive=True)
                    made.add(sub)
                part = f"{root}/{sub}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(text.as_buffer() if text.is_valid else b"")
                store.move(part, f"{root}/{sub}/{name}")
                paths.append(f"{folder}/{sub}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return docs.select("name", "text").mapInArrow(write, "path string")
