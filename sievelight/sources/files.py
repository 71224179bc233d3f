"""Files as (path, content): folders, archives, compressed files, strings in binaries, commits' blobs."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..operators.decode import inflated
from ..operators.post import first_of

MAX_FILE = 5 << 20
MAX_MEMBER = 10 << 20
MAX_ARCHIVE = 100 << 20
# Folders that are not entered, unless others are given; endings of text files, whatever is in them.
SKIPPED = (
    ".git", ".svn", ".hg", "__pycache__", "node_modules", ".venv", "venv", "env", ".tox", ".eggs", "eggs", ".mypy_cache", ".pytest_cache", ".cache", "target", "build",
    "dist", ".next", ".nuxt", ".output", "vendor", ".bundle", ".gradle", "bin", "obj", ".terraform", ".serverless",
)
TEXT_ENDINGS = (
    ".txt", ".go", ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".env", ".sh", ".bash", ".zsh", ".fish", ".bat",
    ".ps1", ".rb", ".rs", ".java", ".kt", ".swift", ".c", ".cpp", ".h", ".hpp", ".cs", ".php", ".pl", ".pm", ".lua", ".r", ".scala", ".clj", ".hs", ".erl", ".ex", ".exs",
    ".md", ".rst", ".html", ".htm", ".xml", ".svg", ".css", ".scss", ".less", ".sql", ".graphql", ".gql", ".dockerfile", ".makefile", ".gradle", ".tf", ".tfvars", ".hcl",
    ".properties", ".lock", ".log", ".csv", ".tsv", ".pem", ".key", ".cert", ".crt", ".pgp", ".gpg", ".asc",
)
_RUN = re.compile(rb"(?:[\x20-\x7e\n\t]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")


def _left_out(path: Column, length: Column, skipped, exclude: str | None, max_size: int) -> Column:
    """Why a file is not read; null for those that are."""
    out = F.when(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, skipped))), "folder")
    if exclude:
        out = out.when(path.rlike(exclude), "excluded")
    return out.when(length > max_size, "size")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def folder(spark: SparkSession, path: str, skipped=SKIPPED, exclude: str | None = None, max_size: int = MAX_FILE, endings=TEXT_ENDINGS) -> DataFrame:
    """(path, content): text files below a folder: those of one of the endings, and others without a zero byte among
    their first 512.  The size filter reaches the listing; left_out() tells what is not read."""
    files = _listed(spark, path).where(F.col("length") <= max_size).where(_left_out(F.col("path"), F.col("length"), skipped, exclude, max_size).isNull())
    text = F.lower(extension(F.col("path"))).isin(*endings) | (F.position(F.lit(b"\x00"), F.substring("content", 1, 512)) == 0)
    return files.where(text).select("path", F.decode("content", "UTF-8").alias("content"))


def left_out(spark: SparkSession, path: str, skipped=SKIPPED, exclude: str | None = None, max_size: int = MAX_FILE) -> DataFrame:
    """(path, length, reason): files below a folder that folder() does not read; contents are not opened."""
    reason = _left_out(F.col("path"), F.col("length"), skipped, exclude, max_size)
    return _listed(spark, path).select("path", "length", reason.alias("reason")).where("reason is not null")


def binaries(spark: SparkSession, path: str, max_size: int = MAX_ARCHIVE) -> DataFrame:
    """(path, content) with the bytes."""
    return _listed(spark, path).where(F.col("length") <= max_size).select("path", "content")


def _mapped(files: DataFrame, pieces) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(p, *x) for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in pieces(p, data or b"")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["file", "path", "content"])

    return files.select("path", "content").mapInArrow(run, "file string, path string, content string").select("path", "content")


def _members(path: str, data: bytes):
    """(name, body, reason) of each file in an archive; of those that are not read body is None and reason tells why."""
    total = 0

    def why(name: str, size: int) -> str | None:
        if name.startswith("/") or ".." in name.split("/"):
            return "path"
        return "size" if size > MAX_MEMBER else "total" if total + size > MAX_ARCHIVE else None

    try:
        if data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        reason = why(i.filename, i.file_size)
                        total += 0 if reason else i.file_size
                        yield i.filename, None if reason else z.read(i), reason
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if m.isfile():
                        reason = why(m.name, m.size)
                        total += 0 if reason else m.size
                        yield m.name, None if reason else t.extractfile(m).read(), reason
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, RuntimeError):
        return


def archive_members(files: DataFrame) -> DataFrame:
    """Text members of zip and tar archives, as path!member; unread_members() tells which are not read."""

    def pieces(path, data):
        for name, body, _ in _members(path, data):
            if body is not None and body.count(0) <= 10:
                yield f"{path}!{name}", body.decode("utf-8", "replace")

    return _mapped(files, pieces)


def unread_members(files: DataFrame) -> DataFrame:
    """(path, reason) of members that are not read: an unsafe path, their size, or that of all before them."""

    def pieces(path, data):
        for name, body, reason in _members(path, data):
            if body is None:
                yield f"{path}!{name}", reason

    return _mapped(files, pieces).withColumnRenamed("content", "reason")


def inflated_files(files: DataFrame) -> DataFrame:
    """Contents of gzip and zlib files."""

    def pieces(path, data):
        body = inflated(data) if len(data) > 64 else None
        if body:
            yield path, body.decode("utf-8", "replace")

    return _mapped(files, pieces)


def binary_strings(files: DataFrame, shortest: int = 8) -> DataFrame:
    """Printable runs of at least so many bytes, each a document of its own."""

    def pieces(path, data):
        for m in _RUN.finditer(data):
            if len(m.group()) >= shortest:
                yield f"{path} (binary)", m.group().decode("utf-8", "replace")

    return _mapped(files, pieces)


def blobs(commits: DataFrame) -> DataFrame:
    """(path, content, ord) of (ord, commit, file, content): path names commit and file."""
    return commits.select(F.concat_ws(":", F.lit("git"), F.substring("commit", 1, 8), F.col("file")).alias("path"), "content", "ord")


def first_in_history(findings: DataFrame) -> DataFrame:
    """Findings with ord, one for the first 80 characters of rule:secret."""
    return first_of(findings, [F.substring(F.concat_ws(":", "rule", "secret"), 1, 80)], [F.col("ord"), F.col("line_no")])


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a text file without blanks and comments, each once."""
    rows = spark.read.text(path).select(F.trim("value").alias("value"))
    return rows.where((F.col("value") != "") & ~F.col("value").startswith("#")).distinct()
