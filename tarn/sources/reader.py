"""Readers: files of any known format as DataFrames of pages or of table rows; text formats through Spark's own readers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.text import clean_text, detect_language, garbage_reason
from tarn.session import hadoop_path, small_batches

PAGES = "path string, parser string, page int, text string, error string"
ROWS = "path string, table_id string, sheet string, headers array<string>, notes array<string>, truncated boolean, row_index long, values array<string>, error string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    # one file is one row; few rows an Arrow batch, as files may be large
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(16, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


#: Characters of pages that are handed on at once, but for the last file's.
PAGE_CHARS = 4_000_000


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from tarn.sources.parsers import Unreadable, parse

    columns = ["path", "parser", "page", "text", "error"]
    for pdf in batches:
        out, size = [], 0
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                parser, pages = parse(path.rsplit("/", 1)[-1], bytes(content))
                found = [(path, parser, n, t, None) for n, t in pages]
            except Unreadable as e:
                found = [(path, None, None, None, str(e))]
            except Exception as e:  # a broken file must not stop the others
                found = [(path, None, None, None, f"{type(e).__name__}: {e}")]
            out += found
            size += sum(len(t or "") for *_, t, _ in found)
            if size > PAGE_CHARS:
                yield pd.DataFrame(out, columns=columns)
                out, size = [], 0
        yield pd.DataFrame(out, columns=columns)


def pages_of(files: DataFrame) -> DataFrame:
    """(path, parser, page, text, error): the pages of files (path, content) of any known format; a file that can't be read is one row with its error."""
    small_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(_pages, PAGES)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, parser, page, text, language, error): cleaned pages; a file that can't be read, or reads like a binary one, is one row with its error."""
    found = pages_of(_files(spark, path)).withColumn("text", F.when(F.col("text").isNotNull(), clean_text(F.col("text"))))
    bad = garbage_reason(F.col("text"))
    found = found.withColumn("error", F.coalesce("error", F.when(bad.isNotNull(), F.concat(F.lit("binary: "), bad))))
    return found.withColumn("language", F.when(F.col("text").isNotNull(), detect_language(F.col("text")))).where("error IS NOT NULL OR text <> ''")


#: Rows of sheets that are handed on at once, and cells of them, but for the last row's; small files' rows go together.
SHEET_ROWS, SHEET_CELLS = 5000, 100_000


def tables_in(files: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Rows of every table in spreadsheet files (path, content), as :func:`read_tables` gives them."""
    return _table_rows(files.select("path", "content"), max_rows, max_columns)


def read_tables(spark: SparkSession, path: str, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Rows of every table in spreadsheet files, values as text by position; all rows and columns, unless the caller sets a limit (``truncated`` and ``notes`` say so then)."""
    return _table_rows(_files(spark, path), max_rows, max_columns)


def _table_rows(files: DataFrame, max_rows: int | None, max_columns: int | None) -> DataFrame:
    columns = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tarn.sources.formats import parser_for
        from tarn.sources.sheets import tables_of

        held, cells = [], 0
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                name, data = file.rsplit("/", 1)[-1], bytes(content)
                try:
                    for n, (told, rows) in enumerate(tables_of(parser_for(name, data), name, data, max_rows, max_columns)):
                        for i, r in enumerate(rows):
                            held.append((file, f"{name}#{n}", told.sheet, told.headers, told.notes, told.truncated, i, r, None))
                            cells += len(r)
                            if len(held) >= SHEET_ROWS or cells >= SHEET_CELLS:
                                yield pd.DataFrame(held, columns=columns, dtype=object)
                                held, cells = [], 0
                except Exception as e:  # a broken file must not stop the others
                    held.append((file, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(held, columns=columns, dtype=object)

    small_batches(files.sparkSession)
    return files.mapInPandas(run, ROWS)


def as_table(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Rows of one table as named columns beside ``row_index``."""
    return rows.select("row_index", *[F.element_at("values", i).alias(h) for i, h in enumerate(headers, 1)])


def sniffed(spark: SparkSession, path: str, size: int = 1 << 16) -> tuple[str, str]:
    """(separator, encoding) of delimited text, told by the first ``size`` bytes of the first file."""
    from tarn.sources.sheets import dialect_of, encoding_of

    files, at = hadoop_path(spark, path)
    if files.getFileStatus(at).isDirectory():
        at = min((f.getPath() for f in files.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=lambda p: p.getName())
    stream = files.open(at)
    head = bytes(stream.readNBytes(size))
    stream.close()
    cut = head[: head.rfind(b"\n") + 1] or head  # no character is cut in two
    encoding = encoding_of(cut)
    return dialect_of(cut.decode(encoding)).delimiter, {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "windows-1252"}.get(encoding, "ISO-8859-1")


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None) -> DataFrame:
    """Delimited files of any size through Spark's own splittable reader, all cells as text; separator and encoding are told by the head if they aren't given."""
    if separator is None or encoding is None:
        told = sniffed(spark, path)
        separator, encoding = separator or told[0], encoding or told[1]
    if encoding.lower().startswith("windows-"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark reads such texts only if it is told that it may
    return spark.read.option("header", "true").option("sep", separator).option("encoding", encoding).option("inferSchema", "false").csv(path)


def json_pages(df: DataFrame, raw: str) -> DataFrame:
    """(page, text, error) rows of JSON documents, read as files of that format are.

    Pages are objects with ``page`` and ``text``, or plain values; a document
    without pages is one page, printed with indents.  What is no JSON, null
    included, is one row with its error.
    """
    rows = df.select(*df.columns, F.explode(_json_pages(F.col(raw))).alias("__p"))
    return rows.select(*df.columns, "__p.page", F.when(F.col("__p.error").isNull(), clean_text(F.col("__p.text"))).alias("page_text"), F.col("__p.error").alias("page_error"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])))
def _json_pages(raw: pd.Series) -> pd.Series:
    from tarn.sources.parsers import Unreadable, parse_json

    def one(text: str | None) -> list[dict]:
        try:
            return [{"page": n, "text": t, "error": None} for n, t in parse_json((text or "").encode("utf-8", "surrogatepass"))]
        except Unreadable as e:
            return [{"page": None, "text": None, "error": str(e)}]

    return raw.map(one)


#: Fixed value: a line that numbers the page after it.
PAGE_LINE = r"(?im)^\s*\[page\s+(\d+)\]\s*$"


def text_pages(df: DataFrame, raw: str) -> DataFrame:
    """(page, text) rows of texts: parted by form feeds, else by ``[page N]`` lines (what stands before the first belongs to none), else one page."""
    numbers = F.regexp_extract_all(raw, F.lit(PAGE_LINE), F.lit(1))
    parts = F.split(F.col(raw), PAGE_LINE)
    page = lambda n, t: F.struct(n.cast("int").alias("page"), t.alias("text"))
    fed = F.transform(F.split(F.col(raw), "\f"), lambda t, i: page(i + 1, t))
    marked = F.transform(numbers, lambda n, i: page(n, F.element_at(parts, i + 2)))
    found = F.when(F.contains(F.col(raw), F.lit("\f")), fed).when(F.size(numbers) > 0, marked).otherwise(F.array(page(F.lit(1), F.col(raw))))
    rows = df.select(*df.columns, F.explode(found).alias("__p"))
    return rows.select(*df.columns, "__p.page", clean_text(F.col("__p.text")).alias("page_text"))


def log_summary(spark: SparkSession, path: str) -> DataFrame:
    """Counts by level and logger of JSON log lines, bare or wrapped by a container's log driver; other lines are ignored."""
    lines = spark.read.text(path)
    outer = F.get_json_object("value", "$.log")
    line = F.coalesce(outer, F.col("value"))
    level, logger = F.get_json_object(line, "$.level"), F.get_json_object(line, "$.logger")
    stamp = F.coalesce(F.get_json_object(line, "$.timestamp"), F.get_json_object(line, "$.time"), F.get_json_object("value", "$.time"))
    rows = lines.select(F.upper(level).alias("level"), logger.alias("logger"), stamp.alias("at")).where("level IS NOT NULL")
    return rows.groupBy("level", "logger").agg(F.count("*").alias("count"), F.min("at").alias("first"), F.max("at").alias("last"))


def write_snapshot(df: DataFrame, path: str, *partitions: str) -> None:
    """A new snapshot of a table; readers are pointed to it once it is whole."""
    df.write.partitionBy(*partitions).parquet(path)


def to_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def load_source(source: dict) -> tuple[str, bytes]:
    """(name, bytes) of an inline source that gives exactly one of ``text``, ``base64`` or ``json``."""
    import base64

    given = [k for k in ("text", "base64", "json") if source.get(k) is not None]
    if len(given) != 1:
        raise ValueError("exactly one of text, base64 and json is needed")
    kind, value = given[0], source[given[0]]
    data = {"text": lambda: value.encode(), "base64": lambda: base64.b64decode(value, validate=True), "json": lambda: json.dumps(value).encode()}[kind]()
    return source.get("name") or ("document.json" if kind == "json" else "document.txt"), data
