"""Strict readers: declared schemas, no inference, and an error for what doesn't fit."""

from __future__ import annotations

import html.parser
from collections.abc import Iterator
from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; a blank, malformed or non-object line is an error, a byte order mark is not."""
    lines = spark.read.text(path).select(F.regexp_replace("value", f"^{BOM}", "").alias("line"))
    bad = (F.trim("line") == "") | ~F.ltrim("line").startswith("{")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("line", 1, 80))).cast("string")).otherwise(F.col("line"))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def string_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV as text columns; headers are checked for empty files too, and cells missing or too many are an error."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    raw = raw.toDF(*[c.lstrip(BOM).strip() for c in raw.columns])
    if missing := [c for c in required if c not in raw.columns]:
        raise ValueError(f"{path} lacks {missing}")
    return raw


def typed(x: Column, kind: str) -> Column:
    """Number, flag or date from text; null where it is none, or not finite."""
    if kind == "boolean":
        return F.when(x == "True", True).when(x == "False", False)
    out = F.trim(x).try_cast(kind)
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out) if kind in ("double", "float") else out


def line_set(spark: SparkSession, path: str, fold: Column | None = None) -> DataFrame:
    """Lines of a word list without comments and blank lines: ``term``."""
    line = F.trim(F.regexp_replace("value", f"^{BOM}", ""))
    rows = spark.read.text(path).select(line.alias("term")).where("term <> '' AND NOT startswith(term, '#')")
    return (rows if fold is None else rows.select(fold.alias("term"))).distinct()


def stop_words(base: DataFrame, extra: list[str], protected: list[str], fold) -> DataFrame:
    """Base list with additions; protected terms in it, or additions that it has already, are errors."""
    spark = base.sparkSession
    added = spark.createDataFrame([(w,) for w in extra], "term string").select(fold(F.col("term")).alias("term"))
    kept = spark.createDataFrame([(w,) for w in protected], "term string")
    if wrong := [r.term for r in base.intersect(kept).limit(5).collect()]:
        raise ValueError(f"stop words are protected: {wrong}")
    if twice := [r.term for r in base.intersect(added).limit(5).collect()]:
        raise ValueError(f"additions are in the base list: {twice}")
    return base.union(added).distinct()


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their digest and length."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def verified(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Snapshots with ``digest_ok`` against metadata ``(path, sha256, fetched_at)``; a time without zone is not ok."""
    meta = metadata.select("path", F.col("sha256").alias("expected"), "fetched_at")
    zoned = F.col("fetched_at").rlike(r"(Z|[+-]\d{2}:\d{2})$")
    return files.join(meta, "path", "left").withColumn("digest_ok", F.coalesce((F.col("sha256") == F.col("expected")) & zoned, F.lit(False)))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def source_turns(spark: SparkSession, root: str, metadata: DataFrame, version: str, turn_schema: str, span_schema: str) -> DataFrame:
    """Turns of every source under ``root/<source>/`` with their session's metadata and their spans in order.

    Each source has ``manifest.json`` (``version``), ``turns.jsonl`` and ``spans.jsonl``.  Another
    version, a turn without metadata, and spans of a turn that isn't there are errors.
    """
    source = F.element_at(F.split(F.input_file_name(), "/"), -2).alias("source_record_id")
    manifests = spark.read.schema("version string").option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/*/manifest.json")
    turns = spark.read.schema(turn_schema).option("mode", "FAILFAST").json(f"{root}/*/turns.jsonl").select(source, "*")
    spans = spark.read.schema(span_schema).option("mode", "FAILFAST").json(f"{root}/*/spans.jsonl").select(source, "*")
    key = ["source_record_id", "turn_index"]
    problems = {
        "another version": manifests.select(source, "version").where(~F.col("version").eqNullSafe(version)), "no metadata": turns.join(metadata, "source_record_id", "left_anti"),
        "spans of no turn": spans.join(turns, key, "left_anti"), "repeated turn": turns.groupBy(*key).count().where("count > 1"), "no manifest": turns.join(manifests.select(source), "source_record_id", "left_anti"),
    }
    for what, rows in problems.items():
        if found := rows.limit(1).collect():
            raise ValueError(f"{found[0].source_record_id}: {what}")
    fields = [c for c in spans.columns if c not in key]
    own = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("content_span_index", *[f for f in fields if f != "content_span_index"]))).alias("spans"))  # a turn's spans
    return turns.join(metadata, "source_record_id").join(own, key, "left")


_ENTRY = "period int, source_entry_position int, period_entry_position int, title string, viewer_url string, pdf_url string"


class _Index(html.parser.HTMLParser):
    """Entries of ``#periodos > .accordion-item``: one for each list item."""

    def __init__(self):
        super().__init__()
        self.rows: list[dict] = []
        self.period: int | None = None
        self.text: list[str] | None = None
        self.header, self.button, self.viewer, self.within = 0, [], None, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if "accordion-item" in classes:
            self.period, self.within = None, 0
        if tag == "button":
            self.header, self.button = 1, []
        if tag == "li":
            self.text, self.viewer = [], None
        if tag == "a" and self.text is not None and "pdf-link" in classes:
            parts = (a.get("onclick") or "").split("'")
            self.viewer = parts[1] if len(parts) > 1 else a.get("href")

    def handle_endtag(self, tag):
        if tag == "button":
            digits = "".join(c if c.isdigit() else " " for c in "".join(self.button)).split()
            self.period, self.header = int(digits[0]) if digits else None, 0
        if tag == "li" and self.text is not None:
            self.within += 1
            file = parse_qs(urlsplit(self.viewer).query).get("file", [None])[0] if self.viewer else None
            self.rows.append({"period": self.period, "source_entry_position": len(self.rows) + 1, "period_entry_position": self.within, "title": " ".join("".join(self.text).split()), "viewer_url": self.viewer, "pdf_url": file})
            self.text = None

    def handle_data(self, data):
        if self.header:
            self.button.append(data)
        if self.text is not None:
            self.text.append(data)


def html_entries(pages: DataFrame, html: str = "html") -> DataFrame:
    """Entries of index pages, those without a link too."""

    @F.pandas_udf(f"array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split() for c in _ENTRY.split(', ')))}>>")
    def parse(x: pd.Series) -> pd.Series:
        def one(s: str | None) -> list[dict]:
            p = _Index()
            p.feed(s or "")
            return p.rows

        return x.map(one)

    return pages.select(*[c for c in pages.columns if c != html], F.explode(parse(F.col(html))).alias("e")).select(*[c for c in pages.columns if c != html], "e.*")


def fetch(url: str, opener=None, attempts: int = 3, wait=None) -> Iterator[bytes]:
    """Bytes of a URL with doubling waits between attempts; ``opener`` stands in for the network in tests."""
    import time
    import urllib.request

    opener, wait = opener or (lambda u: urllib.request.urlopen(u, timeout=60)), wait or time.sleep
    for k in range(attempts):
        try:
            with opener(url) as r:
                yield r.read()
            return
        except OSError:
            if k == attempts - 1:
                raise
            wait(2**k)
