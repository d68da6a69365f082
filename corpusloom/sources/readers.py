"""Readers: JSON lines, manifests, judged sheets, result globs, page archives, standards XML, configuration."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.urls import normalize_url

METADATA = "document_id string, source string, source_type string, title string, page int, chunk int, document_type string, author string, pub_year string, theme string, ria_dimensions array<string>, source_url string, section_path string"
CHUNK_SCHEMA = f"id string, text string, metadata struct<{METADATA.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>"
MANIFEST_COLUMNS = ["filename", "title", "document_type", "author", "year", "theme", "ria_dimension", "source_url", "source_type"]


def require(df: DataFrame, problem: str) -> None:
    """Raises if the table of violations has a row; a few are named."""
    bad = df.limit(5).collect()
    if bad:
        raise ValueError(f"{problem}: {[tuple(r) for r in bad]}")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are passed over, the first bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CHUNK_SCHEMA)


def last_by_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by order; the rows keep their columns."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def read_sheet(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A CSV file with header; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def pdf_manifest(rows: DataFrame, unique: bool = True) -> DataFrame:
    """Registered PDF documents, whatever the case and blanks of source_type; unnamed rows are left out, repeats raise if unique."""
    pdf = rows.filter((F.upper(F.trim("source_type")) == "PDF") & (F.trim("filename") != ""))
    if unique:
        require(pdf.groupBy(F.trim("filename").alias("filename")).count().filter("count > 1"), "documents registered twice")
    return pdf.withColumn("filename", F.trim("filename"))


def html_manifest(rows: DataFrame, unique: bool = True) -> DataFrame:
    """Registered pages under their normalised address; pages without one are left out, repeats raise if unique."""
    html = rows.filter(F.upper(F.trim("source_type")) == "HTML").withColumn("address", normalize_url(F.col("source_url"))).filter("address IS NOT NULL")
    if unique:
        require(html.groupBy("address").count().filter("count > 1"), "pages registered twice")
    return html


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    df = read_sheet(spark, path)
    missing = [c for c in MANIFEST_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"manifest without columns {missing}")
    return df


def collected_pages(rows: DataFrame) -> DataFrame:
    """One row an address: a root page before others, else the first collected (url, relation, pos)."""
    w = Window.partitionBy("url").orderBy((F.col("relation") == "raiz").desc(), "pos")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def seeds(rows: DataFrame) -> DataFrame:
    """Distinct addresses of rows with source_type html, in the order given (url, pos)."""
    html = rows.filter(F.lower(F.trim("source_type")) == "html").filter(F.trim("url") != "")
    return html.groupBy(F.trim("url").alias("url")).agg(F.min("pos").alias("pos"))


def judged_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All result files of a glob but trial ones, with the configuration their names carry."""
    df = spark.read.schema(schema).json(pattern).withColumn("file", F.col("_metadata.file_name"))
    return df.filter(~F.col("file").contains("_TESTE")).withColumn("config", F.regexp_extract("file", r"^(?:judged_)?(.*)\.jsonl$", 1))


def read_vectors(spark: SparkSession, path: str, ids: DataFrame, dimension: int) -> DataFrame:
    """Stored vectors; raises unless they are of one size, of length 1 and of just the given ids."""
    v = spark.read.parquet(path)
    require(v.filter(F.size("vector") != dimension).select("id"), "vectors of another size")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    require(v.filter(F.abs(length - 1) > 1e-3).select("id"), "vectors not of length 1")
    require(v.join(ids.select("id"), "id", "left_anti").select("id").union(ids.select("id").join(v, "id", "left_anti")), "ids that one side lacks")
    require(v.groupBy("id").count().filter("count > 1"), "ids stored twice")
    return v


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """One row a page (path, page, text, error) of PDF files; needs a PDF library on the workers, else each file gives its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    import fitz

                    with fitz.open(stream=content, filetype="pdf") as doc:
                        for n, page in enumerate(doc, 1):
                            try:
                                rows.append((name, n, page.get_text("text", sort=True), None))
                            except Exception as e:  # a page that cannot be read does not end the document
                                rows.append((name, n, None, str(e)))
                except Exception as e:
                    rows.append((name, None, None, str(e)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "page", "text", "error"])

    return files.mapInArrow(run, "path string, page int, text string, error string")


def read_standard(spark: SparkSession, path: str) -> DataFrame:
    """One row a section (path, pos, title, text) of standards in XML with sec, title and p elements, at any depth."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xml.etree import ElementTree

        for b in batches:
            rows: list[tuple] = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root = ElementTree.fromstring(text)
                for n, sec in enumerate(root.iter("sec")):
                    title = sec.find("title")
                    own = [" ".join("".join(p.itertext()).split()) for p in sec if p.tag in ("p", "def", "term")]
                    rows.append((name, n, " ".join("".join(title.itertext()).split()) if title is not None else None, "\n".join(own)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "pos", "title", "text"])

    return files.mapInArrow(run, "path string, pos int, title string, text string")


def read_config(path: str, defaults: dict | None = None) -> dict:
    """Settings of a JSON file over the defaults; a missing file gives the defaults."""
    own = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
    return {**(defaults or {}), **own}
