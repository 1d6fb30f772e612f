"""Files in and out: JSON lines, manifests, raw files against their checksums, HTML, provenance."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_HTML_BLOCKS = "doc_id string, block int, page int, section string, text string"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, a missing path gives no rows, a bad line fails."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The entries of ``documents`` of a manifest file, without those that carry a ``dedup`` decision."""
    entry = schema if isinstance(schema, str) else schema.simpleString()
    docs = spark.read.schema(f"documents array<struct<{entry}>>").option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")
    return docs.where("dedup is null") if "dedup" in docs.columns else docs


def verify_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``path, state`` of a manifest (``path, bytes, checksum``; path relative to the folder): ``ok``, ``missing``, ``length``, ``checksum``."""
    spark = manifest.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = files.select(F.substring("path", len(whole) + 1, F.lit(1 << 30)).alias("path"), "length", F.sha2("content", 256).alias("sum"))
    state = F.when(F.col("sum").isNull(), "missing").when(F.col("length") != F.col("bytes"), "length").when(F.col("sum") != F.col("checksum"), "checksum").otherwise("ok")
    return manifest.join(found, "path", "left").select("path", state.alias("state"))


class _Blocks(HTMLParser):
    """Text of elements, script and style left out; rules and page-break styles count pages, ITEM lines open sections."""

    def __init__(self):
        super().__init__()
        self.page, self.skip, self.blocks, self.part = 1, 0, [], []

    def _close(self) -> None:
        text = " ".join("".join(self.part).split())
        if text:
            self.blocks.append((self.page, text))
        self.part = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        if tag in ("p", "div", "td", "li", "br", "hr", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self._close()
        if tag == "hr" or any(k == "style" and "page-break" in (v or "").lower() for k, v in attrs):
            self.page += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "div", "td", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self._close()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.part.append(data)


def _item_label(line: str) -> str | None:
    """``ITEM n`` of a line that opens an item of a filing: the word, a number with A or B at most, and a full stop, dash or colon."""
    first, _, rest = line.partition(" ")
    if first.upper() != "ITEM" or len(line) >= 120:
        return None
    digits = len(rest) - len(rest.lstrip("0123456789"))
    letter = rest[digits : digits + 1].upper() if digits else ""
    letter = letter if letter in ("A", "B") else ""
    after = rest[digits + len(letter) :].lstrip()
    return f"ITEM {rest[:digits]}{letter}" if digits and after[:1] in (".", "-", "—", ":") and after else None


def html_blocks(pages: DataFrame) -> DataFrame:
    """``doc_id, block, page, section, text`` of ``doc_id, html``. A null or empty page has no blocks; broken markup is read as far as it goes."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, html in zip(pdf["doc_id"], pdf["html"]):
                parser = _Blocks()
                parser.feed(html or "")
                parser.close()
                parser._close()
                section = "preamble"
                for i, (page, text) in enumerate(parser.blocks):
                    section = _item_label(text) or section
                    rows.append((doc, i, page, section, text))
            yield pd.DataFrame(rows, columns=["doc_id", "block", "page", "section", "text"])

    return pages.select(F.col("doc_id").cast("string"), "html").mapInPandas(parse, _HTML_BLOCKS)


def write_with_provenance(df: DataFrame, path: str, describes: str, generated_by: str, source: dict[str, str]) -> None:
    """JSON lines, each row under ``payload`` beside what it is and where it comes from."""
    # The names describes, generated_by, source and payload are the file format.
    sources = F.create_map(*[F.lit(x) for kv in sorted(source.items()) for x in kv]) if source else F.lit(None).cast("map<string,string>")
    df.select(F.lit(describes).alias("describes"), F.lit(generated_by).alias("generated_by"), sources.alias("source"), F.struct(*df.columns).alias("payload")).write.json(path)
