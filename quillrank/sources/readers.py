"""Texts of page files: readers in order, then engines that read images, with retries and a time limit a call."""

from __future__ import annotations

import re
import threading
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank import config
from quillrank.functions.text import strip
from quillrank.session import scratch_folder, small_batches
from quillrank.sources.files import direct_text_ok

#: Makes a reader in a worker: content to (text, pages). It may raise ImportError where its library isn't installed.
ReaderFactory = Callable[[], Callable[[bytes], tuple[str, int]]]
#: Makes an engine in a worker: content to text.
EngineFactory = Callable[[], Callable[[bytes], str]]

_READ = "name string, text string, pages int, backend string, error string"
_SCANNED = "name string, primary_text string, primary_error string, fallback_text string, fallback_error string"


def _said(e: Exception) -> str:
    return (str(e) or type(e).__name__)[:2000]


def cascade(files: DataFrame, readers: list[tuple[str, ReaderFactory]]) -> DataFrame:
    """(name, text, pages, backend, error) of files (name, content): the first of `readers` (name, factory) that succeeds
    with a file has it. Readers are made once a task; one that can't be made, and one that raises, is an error in the list
    that a file gets if none succeeds, with no text, one page and the backend `none`."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, missing = [], []
        for name, factory in readers:
            try:
                made.append((name, factory()))
            except ImportError:
                missing.append(f"{name} not installed")
        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                errors = list(missing)
                for backend, reader in made:
                    try:
                        text, pages = reader(content)
                        out.append((name, text, pages, backend, None))
                        break
                    except Exception as e:  # a file of any kind of brokenness goes on to the next reader
                        errors.append(f"{backend}: {_said(e)}")
                else:
                    out.append((name, None, 1, "none", "; ".join(errors)))
            yield pd.DataFrame(out, columns=["name", "text", "pages", "backend", "error"])

    small_batches(files.sparkSession)
    return files.select("name", "content").mapInPandas(read, _READ)


def _limited(call: Callable[[bytes], str], content: bytes, seconds: float, label: str) -> str:
    """The call's result, or TimeoutError after `seconds`; a call that hangs is left behind in its thread."""
    got: dict = {}

    def work() -> None:
        try:
            got["text"] = call(content)
        except Exception as e:  # handed on to the caller's thread
            got["error"] = e

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        raise TimeoutError(f"{label} OCR exceeded {seconds:g}s")
    if "error" in got:
        raise got["error"]
    return got["text"]


def scanned(files: DataFrame, primary: EngineFactory, fallback: EngineFactory | None, retries: int = 2, seconds: float = 30) -> DataFrame:
    """What engines read from the images of files (name, content): the primary one, tried up to `retries` times until it
    gives text, and the fallback once where it gives none. Engines are made once a task, when they are first needed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict = {}

        def run(kind: str, factory: EngineFactory, content: bytes) -> str:
            if kind not in made:
                made[kind] = factory()
            return _limited(made[kind], content, seconds, kind)

        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                text, error, more, trouble = None, None, None, None
                for _ in range(retries):
                    try:
                        text = run("primary", primary, content)
                        if text and text.strip():
                            break
                        error = "primary OCR returned no text"
                    except Exception as e:  # an engine may fail in any way
                        error = _said(e)
                if fallback and not (text and text.strip()):
                    try:
                        more = run("fallback", fallback, content)
                    except Exception as e:
                        trouble = _said(e)
                out.append((name, text, error, more, trouble))
            yield pd.DataFrame(out, columns=["name", "primary_text", "primary_error", "fallback_text", "fallback_error"])

    small_batches(files.sparkSession)
    return files.select("name", "content").mapInPandas(read, _SCANNED)


def extracted(files: DataFrame, readers: list[tuple[str, ReaderFactory]], primary: EngineFactory | None = None, fallback: EngineFactory | None = None, retries: int = 2, seconds: float = 30) -> DataFrame:
    """(name, text, pages, method, state, ocr_triggered, char_count, failure_reason) of page files (name, content).

    A file whose own text, by the first reader that succeeds, is long enough for its pages is done; only the others are
    given to the engines, if there are any. Where these give no text either, the longest text that anything gave stays.
    """
    at = scratch_folder(files.sparkSession)
    own = cascade(files, readers).withColumn("text", strip(F.coalesce("text", F.lit(""))))
    own.write.parquet(f"{at}/direct")
    own = files.sparkSession.read.schema(own.schema).parquet(f"{at}/direct")
    enough = direct_text_ok(F.col("text"), F.col("pages"))
    n = F.length("text").cast("long").alias("char_count")
    nothing = F.lit(None).cast("string").alias("failure_reason")
    done = own.where(enough).select("name", "text", "pages", F.lit("direct").alias("method"), F.lit("TEXT_EXTRACTED").alias("state"), F.lit(False).alias("ocr_triggered"), n, nothing)
    short = own.where(~enough)
    if primary is None:
        why = F.lit("OCR disabled; direct text insufficient").alias("failure_reason")
        return done.unionByName(short.select("name", "text", "pages", F.lit("direct").alias("method"), F.lit("OCR_FAILED").alias("state"), F.lit(False).alias("ocr_triggered"), n, why))
    seen = scanned(files.join(short.select("name"), "name", "left_semi"), primary, fallback, retries, seconds)
    some = lambda c: F.length(strip(F.coalesce(c, F.lit("")))) > 0
    first, second = some("primary_text"), some("fallback_text")
    longer = lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a)
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    best = longer(longer(F.col("text"), clean("primary_text")), clean("fallback_text"))
    parts = F.concat_ws("; ", F.concat(F.lit("primary: "), "primary_error"), F.concat(F.lit("fallback: "), "fallback_error"))
    reason = F.when(~(first | second), F.when(parts != "", parts).otherwise("both OCR methods returned no text"))
    text = F.when(first, clean("primary_text")).when(second, clean("fallback_text")).otherwise(best)
    wholly = F.coalesce(F.length("primary_text") > 0, F.lit(False))
    method = F.when(first, "ocr_primary").when(second, "ocr_fallback").when(wholly, "ocr_primary").otherwise("ocr_fallback")
    rest = short.select("name", "text", "pages").join(seen, "name").select("name", text.alias("t"), "pages", method.alias("method"), F.when(first | second, "OCR_DONE").otherwise("OCR_FAILED").alias("state"), reason.alias("failure_reason"))
    rest = rest.select("name", F.col("t").alias("text"), "pages", "method", "state", F.lit(True).alias("ocr_triggered"), F.length("t").cast("long").alias("char_count"), "failure_reason")
    return done.unionByName(rest)


def _open(path: str):
    """An archive in a file system that pyarrow knows, for reading by offset."""
    store, at = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return zipfile.ZipFile(store.open_input_file(at))


def directory(spark: SparkSession, folder: str, glob: str = "*.zip") -> DataFrame:
    """(archive, member, name, size, error): a row a member of the archives below a folder, from the archives' directories
    alone. Folders and junk go; separators in names become `_`; a broken archive is a row with an error."""
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                out = []
                try:
                    with _open(path) as archive:
                        for i, m in enumerate(archive.infolist()):
                            if not m.is_dir() and not re.search(config.JUNK, m.filename):
                                out.append((path, i, re.sub(r"[/\\]", "_", m.filename), m.file_size, None))
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    out.append((path, None, None, None, _said(e)))
                yield pd.DataFrame(out, columns=["archive", "member", "name", "size", "error"]).astype({"member": "Int32", "size": "Int64"})

    return archives.mapInPandas(read, "archive string, member int, name string, size long, error string")


def members(listed: DataFrame, parts: int | None = None) -> DataFrame:
    """(archive, name, content, error) of a directory's members, each read from its offset in one of `parts` tasks, whatever
    archive it is in: a large archive is no single task's, and none holds it whole. A broken member is an error."""
    parts = parts or max(1, listed.sparkSession.sparkContext.defaultParallelism)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, archive = None, None
        for batch in batches:
            for at, member, name in zip(batch["archive"], batch["member"], batch["name"], strict=True):
                content, error = None, None
                try:
                    if at != path:
                        path, archive = at, _open(at)
                    content = archive.read(archive.infolist()[int(member)])
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError, ValueError) as e:
                    error = _said(e)
                yield pd.DataFrame({"archive": [at], "name": [name], "content": [content], "error": [error]})

    whole = listed.where("error IS NULL").repartition(parts, "archive", "member").sortWithinPartitions("archive", "member")
    bad = listed.where("error IS NOT NULL").select("archive", "name", F.lit(None).cast("binary").alias("content"), "error")
    return whole.select("archive", "member", "name").mapInPandas(read, "archive string, name string, content binary, error string").unionByName(bad)


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^./]+$", 0))


def description_files(uploads: DataFrame) -> DataFrame:
    """(owner, path, content, error) of descriptions that are uploaded (owner, name, content): kept as jd.<suffix>, the last
    of a suffix by name; any other suffix than .pdf, .docx and .txt is refused."""
    ext = suffix(F.col("name"))
    fine = ext.isin(".pdf", ".docx", ".txt")
    good = uploads.where(fine).groupBy("owner", ext.alias("ext")).agg(F.max_by("content", "name").alias("content"))
    kept = good.select("owner", F.concat(F.lit("jd"), "ext").alias("path"), "content", F.lit(None).cast("string").alias("error"))
    refused = uploads.where(~fine).select("owner", F.lit(None).cast("string").alias("path"), F.lit(None).cast("binary").alias("content"), F.lit("Unsupported JD file type. Allowed: .pdf, .docx, .txt").alias("error"))
    return kept.unionByName(refused)
