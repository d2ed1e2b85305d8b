"""Reading documents, metadata and earlier artifacts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from themeweave.functions.text import collapse_ws
from themeweave.operators.chunking import html_blocks
from themeweave.schema import SCHEMAS

#: (page texts, layout blocks) from the bytes of one document.
Parser = Callable[[bytes], tuple[list[str], list[str]]]


def pymupdf_parser(content: bytes) -> tuple[list[str], list[str]]:
    """Page texts and text blocks by PyMuPDF, where it is installed."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        pages = [p.get_text() for p in doc]
        blocks = [b[4] for p in doc for b in p.get_text("blocks") if b[6] == 0]
    return pages, blocks


def read_pdf(spark: SparkSession, folder: str, parser: Parser = pymupdf_parser, pattern: str = "*.pdf") -> DataFrame:
    """(source_file, full_text, blocks, error) of every document of a folder, parsed where the files are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    pages, blocks = parser(bytes(content))
                    out.append((path, "\n".join(pages), blocks, None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "full_text", "blocks", "error"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    x = raw.mapInPandas(run, "path string, full_text string, blocks array<string>, error string")
    clean = F.filter(F.transform("blocks", collapse_ws), lambda b: b != "")
    return x.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "full_text", clean.alias("blocks"), "error")


def read_html(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(source_file, full_text, blocks) from a table of HTML pages; blocks are joined by blank lines."""
    x = pages.select(F.col(ident).cast("string").alias("source_file"), html_blocks(html).alias("blocks"))
    return x.select("source_file", F.concat_ws("\n\n", "blocks").alias("full_text"), "blocks")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata table from CSV, Parquet or (with a spreadsheet reader installed) XLSX; raises naming missing columns."""
    if path.endswith((".xlsx", ".xls")):
        df = spark.createDataFrame(pd.read_excel(path, dtype=object).astype(str).replace({"nan": None}))  # a few hundred rows
    elif path.endswith(".csv"):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        df = spark.read.parquet(path)
    missing = [c for c in ("filename", "technology", "year") if c not in df.columns]
    if missing:
        raise ValueError(f"metadata lacks the columns {missing}")
    return df.select("filename", "technology", F.col("year").try_cast("int").alias("year"))


def read_csv_safe(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV file in a declared schema, or an empty frame where it is missing or blank."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or fs.getContentSummary(hadoop).getLength() == 0:
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").schema(schema).csv(path)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
