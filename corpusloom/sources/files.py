"""Files as documents, read by Spark's binary file source and decoded in the JVM."""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_to_text

TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".rst", ".csv", ".json", ".jsonl", ".yaml", ".yml", ".xml")
HTML_SUFFIXES = (".html", ".htm")
PDF_METADATA = ("title", "author", "subject", "creator", "producer")
EXCLUDED = (
    ".git/**", ".hg/**", ".svn/**", ".venv/**", "venv/**", "node_modules/**", "__pycache__/**", ".pytest_cache/**", ".mypy_cache/**",
    ".ruff_cache/**", "dist/**", "build/**", ".tox/**", ".idea/**", ".vscode/**", "*.pyc", "*.lock", ".DS_Store",
)


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(path).rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$")


def stable_id(path: Column) -> Column:
    """"file-" and the first 12 digits of the path's SHA-1."""
    return F.concat(F.lit("file-"), F.substring(F.sha1(path), 1, 12))


def excluded(relative: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a relative path, or its last part, matches a glob; "dir/**" takes all below dir at any depth."""
    name = F.substring_index(relative, "/", -1)
    out = F.lit(False)
    for p in patterns:
        rule = fnmatch.translate(p).replace(r"\z", "$").replace(r"\Z", "$")
        out = out | relative.rlike(f"^{rule}") | name.rlike(f"^{rule}")
        if p.endswith("/**"):
            out = out | relative.rlike(rf"(^|/){re.escape(p[:-3])}/")
    return out


def scan(spark: SparkSession, path: str, recursive: bool = True, patterns: tuple[str, ...] = EXCLUDED, max_mb: float = 50) -> DataFrame:
    """(source, relative, size_bytes, mtime, content) of the files below path, without excluded and larger ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    plain = F.regexp_replace("path", "^file:/*", "/")
    root = re.sub("^file:/*", "/", path).rstrip("/") + "/"
    rows = files.select(plain.alias("source"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content")
    rows = rows.withColumn("relative", F.when(F.col("source").startswith(root), F.substr("source", F.lit(len(root) + 1))).otherwise(F.substring_index("source", "/", -1)))
    return rows.where((F.col("size_bytes") <= int(max_mb * 1024 * 1024)) & ~excluded(F.col("relative"), patterns))


def is_binary(content: Column) -> Column:
    """A NUL among the first 4096 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "\u0000") > 0


def load_documents(spark: SparkSession, path: str, **how) -> DataFrame:
    """(doc_id, text, source, filename, extension, size_bytes, mtime, file_sha256) of text and HTML files; bad bytes become U+FFFD, blank documents are dropped."""
    files = scan(spark, path, **how)
    files = files.where(has_suffix(F.col("source"), TEXT_SUFFIXES + HTML_SUFFIXES) & ~is_binary(F.col("content")))
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.when(has_suffix(F.col("source"), HTML_SUFFIXES), html_to_text(raw)).otherwise(raw)
    return files.select(
        stable_id(F.col("source")).alias("doc_id"), text.alias("text"), "source", F.substring_index("source", "/", -1).alias("filename"),
        F.lower(F.regexp_extract("source", r"(\.[^./]+)$", 1)).alias("extension"), "size_bytes", "mtime", F.sha2("content", 256).alias("file_sha256"),
    ).where(F.trim("text") != "")


def load_pdf_pages(spark: SparkSession, path: str, **how) -> DataFrame:
    """(doc_id, page, text, metadata) of PDF files, a row for each page that is not blank; needs pypdf on the workers. metadata has the title, author, subject, creator and producer that are there, as pdf_*. Files that can't be read have no row."""
    files = scan(spark, path, **how).where(has_suffix(F.col("source"), (".pdf",)))

    def read(batches):
        import io

        import pypdf  # an optional reader

        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    reader = pypdf.PdfReader(io.BytesIO(raw))
                    told = {f"pdf_{k}": str(v) for k in PDF_METADATA if (v := getattr(reader.metadata, k, None))}
                    pages = [(n, page.extract_text() or "") for n, page in enumerate(reader.pages, 1)]
                except Exception:  # whatever a broken file makes the reader raise
                    continue
                rows += [(f"{name}-p{n}", n, text, told) for n, text in pages if text.strip()]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "metadata"])

    return files.select(stable_id(F.col("source")).alias("doc_id"), "content").mapInPandas(read, "doc_id string, page int, text string, metadata map<string,string>")


def load_docx(spark: SparkSession, path: str, **how) -> DataFrame:
    """(doc_id, text) of DOCX files: paragraphs that are not blank, with a blank line between. Reads the archive's XML, so it needs no other package. Files that can't be read have no row."""
    files = scan(spark, path, **how).where(has_suffix(F.col("source"), (".docx",)))

    def read(batches):
        import io
        import zipfile
        from xml.etree import ElementTree

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                parts = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")]
                text = "\n\n".join(p.strip() for p in parts if p.strip())
                if text:
                    rows.append((name, text))
            yield pd.DataFrame(rows, columns=["doc_id", "text"])

    return files.select(stable_id(F.col("source")).alias("doc_id"), "content").mapInPandas(read, "doc_id string, text string")
