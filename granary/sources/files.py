"""Readers for delimited, text, JSON and Parquet files."""

from __future__ import annotations

import csv
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from granary.operators import catalog, normalize
from granary.session import settle
from granary.sources import quoted

# What a delimited file may look like.
DELIMITERS = (",", ";", "\t", "|")
SNIFF_BYTES = 64 * 1024
SNIFF_LINES = 2_000
SPARK_CHARSETS = {"utf-8": "UTF-8", "cp1251": "windows-1251", "latin-1": "ISO-8859-1"}


@dataclass(frozen=True)
class Dialect:
    encoding: str
    delimiter: str
    header: bool


def guess_format(text: str) -> tuple[str, bool]:
    """Delimiter and header of a sample, with the standard sniffer and a count of signs as fallback."""
    lines = [line for line in text.splitlines() if line.strip()]
    delimiter, header = ",", True
    if lines:
        try:
            delimiter = csv.Sniffer().sniff(text, "".join(DELIMITERS)).delimiter
        except csv.Error:
            best = max(DELIMITERS, key=lines[0].count)
            delimiter = best if best in lines[0] else ","
        try:
            header = csv.Sniffer().has_header(text)
        except csv.Error:
            header = True
    return delimiter, header


def whole_file_facts(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding and whether a quote is open at a line's end, from all bytes of the files in one aggregate."""
    line = F.col("value")
    raw = line.cast("binary")
    facts = spark.read.text(path).agg(
        F.coalesce(F.bool_and(F.is_valid_utf8(line)), F.lit(True)).alias("utf8"),
        # the one byte windows-1251 has no character for
        F.coalesce(F.bool_or(F.contains(raw, F.lit(b"\x98"))), F.lit(False)).alias("latin"),
        F.coalesce(F.bool_or((F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1), F.lit(False)).alias("open"),
    ).first()
    encoding = "utf-8" if facts["utf8"] else "latin-1" if facts["latin"] else "cp1251"
    return encoding, facts["open"]


def sample_text(spark: SparkSession, path: str, encoding: str) -> str:
    """The first lines of a file, for guesses about its format only."""
    lines = spark.read.text(path).select(F.col("value").cast("binary")).head(SNIFF_LINES)
    raw = b"\n".join(bytes(row[0]) for row in lines)[:SNIFF_BYTES]
    return raw.decode(encoding, errors="ignore").lstrip("\ufeff")


@dataclass(frozen=True)
class Delimited:
    """A table read from delimited files, and one row (``skipped``) that counts the rows it leaves out."""

    table: DataFrame
    skipped: DataFrame
    dialect: Dialect


def open_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> Delimited:
    """Delimited files as a table of stripped text.

    Short rows are filled with '', rows with more fields than the header (or the first row) are skipped and counted;
    one empty field more is a delimiter at the end and no fault.  Line breaks inside quotes stay, and files that have any
    are split among tasks like others.  Headerless columns are numbered.
    """
    encoding, open_quotes = whole_file_facts(spark, path)
    found, header = guess_format(sample_text(spark, path, encoding))
    dialect = Dialect(encoding, delimiter or found, header)
    charset = SPARK_CHARSETS[encoding]
    if charset == "windows-1251":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    options = {"sep": dialect.delimiter, "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0001", "emptyValue": ""}
    whole = quoted.read_records(spark, path, dialect.delimiter, settle) if open_quotes else None
    if whole is None:
        reader = spark.read.options(**options).option("header", header).option("encoding", charset)
        first = reader.option("inferSchema", False).csv(path).columns
    else:
        text = F.decode("record", charset)
        head = whole.where("first").select(text.alias("head")).first()
        first = next(csv.reader([head["head"]], delimiter=dialect.delimiter), []) if head else []
    names = [(c.lstrip("\ufeff").strip() if header else "") or f"col_{i}" for i, c in enumerate(first, start=1)]
    # one field more than there should be, so that a row with too many shows; what a short row lacks is null
    fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(len(names) + 1)]
    schema = T.StructType(fields)
    if whole is None:
        raw = reader.schema(schema).option("columnPruning", False).csv(path)
    else:
        body = whole.where("octet_length(record) > 0" + (" and not first" if header else ""))
        raw = body.select(F.from_csv(text, schema.simpleString()[len("struct<") : -1].replace(":", " "), options).alias("r")).select("r.*")
    extra = F.col(fields[-1].name)
    kept = raw.where(extra.isNull()).drop(fields[-1].name).toDF(*names)
    return Delimited(normalize.normalize_cells(kept), raw.agg(F.count(extra).alias("skipped")), dialect)


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    return open_delimited(spark, path, delimiter).table


@dataclass(frozen=True)
class TableSet:
    tables: dict[str, DataFrame]
    aliases: dict[str, dict[str, str]]
    catalog: DataFrame | None


def read_table_set(spark: SparkSession, sheets: Mapping[str, str]) -> TableSet:
    """One table per sheet file, in order; sheets without any filled cell are dropped."""
    tables: dict[str, DataFrame] = {}
    aliases: dict[str, dict[str, str]] = {}
    for number, (sheet, path) in enumerate(sheets.items(), start=1):
        cleaned = normalize.drop_empty(read_delimited(spark, path))
        if cleaned.isEmpty():
            continue
        name = normalize.identifier(f"sheet_{number}_{sheet}", f"sheet_{number}")
        tables[name], aliases[name] = normalize.normalize_headers(cleaned)
    return TableSet(tables, aliases, catalog.describe_tables(tables) if tables else None)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: UTF-8 where valid, else windows-1251; blank files are dropped."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # windows-1251 is refused otherwise
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), F.regexp_replace(raw, "^﻿", "")).otherwise(
        F.decode("content", "windows-1251")
    )
    return files.select("path", text.alias("text")).filter(F.trim("text") != "")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One record per line; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a JSON file that do not parse, with their file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.filter((F.trim("value") != "") & F.try_parse_json("value").isNull())


def scan_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Register a Parquet table as a view."""
    spark.read.parquet(path).createOrReplaceTempView(name)
    return spark.table(name)


def capped_scan(df: DataFrame, key: str, max_rows: int) -> DataFrame:
    return df.orderBy(F.col(key).asc_nulls_last()).limit(max_rows)
