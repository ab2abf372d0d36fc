"""Files as rows: listing, unpacking, and texts of txt and docx files; other formats through functions of the caller."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank import config
from quillrank.functions.text import strip

FILE = "name string, content binary"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def accepted(name: Column) -> Column:
    """A file of a known suffix that isn't junk of an operating system or an editor."""
    return extension(name).isin(*config.SUFFIXES) & ~F.rlike(name, F.lit(config.JUNK))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the accepted files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("name"), "content").where(accepted(F.col("name")))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, content in zip(batch["name"], batch["content"], strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except (zipfile.BadZipFile, TypeError):
                yield pd.DataFrame({"archive": [name], "name": [None], "content": [None], "error": ["not a ZIP file"]})
                continue
            for member in archive.infolist():
                if member.is_dir():
                    continue
                flat = re.sub(r"[/\\]", "_", member.filename)
                try:
                    row = (archive.read(member), None)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError, ValueError) as e:
                    row = (None, str(e))
                yield pd.DataFrame({"archive": [name], "name": [flat], "content": [row[0]], "error": [row[1]], "junk": [bool(re.search(config.JUNK, member.filename))]}).query("not junk").drop(columns="junk")


def unzip(archives: DataFrame) -> DataFrame:
    """(archive, name, content, error) of each member of (name, content) archives; separators in names become `_`.

    A broken archive is one row with an error and no name, a broken member a row with an error; junk and folders go.
    """
    return archives.select("name", "content").mapInPandas(_members, "archive string, name string, content binary, error string")


def contained(name: Column) -> Column:
    """Whether a flattened member name stays in the folder that it is unpacked to."""
    return name.isNotNull() & ~F.trim(name).isin("", ".", "..")


def verdicts(members: DataFrame) -> DataFrame:
    """(archive, valid, members, broken, first_broken) of unzipped archives: valid if nothing in it failed to be read."""
    bad = F.col("error").isNotNull()
    return members.groupBy("archive").agg(
        F.every(~bad).alias("valid"), F.count("name").alias("members"), F.count_if(bad).alias("broken"), F.min(F.when(bad, F.coalesce("name", F.lit("")))).alias("first_broken"),
    )


def bag(*lists: DataFrame) -> DataFrame:
    """All rows of several uploads, those of archives and single files alike; repeated ones stay."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


def skipped(name: Column) -> Column:
    """Why a file isn't taken; null if it is."""
    return F.when(F.rlike(name, F.lit(config.JUNK)), "junk").when(~accepted(name), F.concat(F.lit("Unsupported file type ."), extension(name)))


def unsupported(files: DataFrame) -> DataFrame:
    """(ext, files) of the files whose suffix isn't known; junk isn't counted."""
    name = F.col("name")
    odd = files.where(~F.rlike(name, F.lit(config.JUNK)) & ~extension(name).isin(*config.SUFFIXES))
    return odd.groupBy(extension(name).alias("ext")).agg(F.count("*").alias("files"))


def unique_names(files: DataFrame, by: list[str]) -> DataFrame:
    """Later files of one name, in the order of `by`, become stem_2, stem_3, ..., past the numbers that other files'
    own names have.

    The jth later file takes the jth free number: j + 1, and one more for each ith number r among the taken ones (from 2
    on, in order) with r - i <= j.
    """
    nth = F.row_number().over(Window.partitionBy("name").orderBy(*by))
    part = lambda i: F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", i)
    numbered = r"^(.*)_([1-9]\d{0,8})(\.[^.]*)?$"
    of = lambda i: F.regexp_extract("name", numbered, i)
    taken = files.select("name").distinct().where(F.rlike("name", F.lit(numbered))).select(F.concat(of(1), of(3)).alias("name"), of(2).cast("long").alias("_r")).where("_r > 1")
    taken = taken.withColumn("_j", F.col("_r") - F.row_number().over(Window.partitionBy("name").orderBy("_r"))).drop("_r").withColumn("_file", F.lit(False))
    rows = files.withColumns({"_j": (nth - 1).cast("long"), "_file": F.lit(True)}).unionByName(taken, allowMissingColumns=True)
    past = F.count_if(~F.col("_file")).over(Window.partitionBy("name").orderBy("_j", "_file").rowsBetween(Window.unboundedPreceding, 0))
    later = F.concat(part(1), F.lit("_"), (F.col("_j") + 1 + F.col("_past")).cast("string"), part(2))
    named = rows.withColumn("_past", past).where("_file").withColumn("name", F.when(F.col("_j") > 0, later).otherwise(F.col("name")))
    return named.select(*files.columns)


def registered(files: DataFrame, path: str = "name") -> DataFrame:
    """One row a path."""
    return files.dropDuplicates([path])


def docx_text(content: bytes) -> str:
    """Paragraphs that aren't empty, joined by single spaces; a broken file or one without text raises."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    parts = ("".join(t.text or "" for t in p.iter(f"{w}t")).strip() for p in body.iter(f"{w}p"))
    if not (text := " ".join(p for p in parts if p)):
        raise ValueError("no text")
    return text


def texts(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(name, text, error) of (name, content). txt is decoded in SQL, bytes that aren't UTF-8 dropped; docx is read in
    Python, and so is what `readers` has, such as a PDF reader of the caller's. A suffix without a reader is an error."""
    own = {"docx": docx_text, **(readers or {})}
    plain = files.where(extension(F.col("name")) == "txt")
    decoded = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"))
    done = plain.select("name", strip(decoded).alias("text"), F.lit(None).cast("string").alias("error"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                kind = name.rsplit(".", 1)[-1].lower()
                try:
                    out.append((name, own[kind](content), None))
                except KeyError:
                    out.append((name, None, f"no reader for {kind}"))
                except Exception as e:  # a file of any kind of brokenness is a row with its error
                    out.append((name, None, f"{type(e).__name__}: {e}"[:2000]))
            yield pd.DataFrame(out, columns=["name", "text", "error"])

    rest = files.where(~F.coalesce(extension(F.col("name")) == "txt", F.lit(True))).select("name", "content")
    return done.unionByName(rest.mapInPandas(read, "name string, text string, error string"))


def direct_text_ok(text: Column, pages: Column, least: int = 100, per_page: int = 50) -> Column:
    """Whether a page file's own text is long enough to do without reading its images."""
    n = F.length(F.coalesce(text, F.lit("")))
    return (n >= least) & (F.coalesce(pages <= 0, F.lit(True)) | (n / F.nullif(pages, F.lit(0)) >= per_page))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records; files that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path)


def newest(rows: DataFrame, by: list[Column], limit: int = 50) -> DataFrame:
    """The newest records (the limit, 1 to 100, is the feature)."""
    return rows.orderBy(*by).limit(config.checked_request(limit=limit, most=100)["limit"])


def reports(collections: DataFrame, found: DataFrame) -> DataFrame:
    """(collection, report, content, error) of every report that `collections` (collection) should have, from the files
    `found` (path, text): a missing file or one that isn't JSON is a row with an error, not a failure."""
    each = F.array(*(F.struct(F.lit(n).alias("report"), F.lit(p).alias("at")) for n, p in config.REPORT_PATHS.items()))
    wanted = collections.select("collection", F.inline(each)).withColumn("path", F.concat_ws("/", "collection", "at"))
    both = wanted.join(found.select("path", "text"), "path", "left")
    bad = F.endswith(F.col("path"), F.lit(".json")) & F.try_parse_json("text").isNull()
    error = F.when(F.col("text").isNull(), "Report not found").when(bad, "Invalid JSON report")
    return both.select("collection", "report", F.when(error.isNull(), F.col("text")).alias("content"), error.alias("error"))
