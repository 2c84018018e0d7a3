"""Table analytics over driver tables whose cells are turned to text, as a user's sheet would hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions.numbers import excel_serial, format_number, is_numeric_cell, numeric_ratio, parse_number
from tarn.operators import tables
from tarn.operators.tables import Plan, Where


def _items(spark, d):
    """Line items as a sheet: numbers with two decimals, one in seven blank, one in eleven not a number."""
    i = spark.read.parquet(f"{d}/lineitem.parquet")
    price = F.when(F.col("l_orderkey") % 7 == 0, "").when(F.col("l_orderkey") % 11 == 0, "n/a").otherwise(F.format_string("%.2f", "l_extendedprice"))
    return i.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_index"),
        F.concat(F.lit(" "), F.col("l_returnflag")).alias("Flag"),
        F.when(F.col("l_orderkey") % 13 == 0, " ").otherwise(F.col("l_linestatus")).alias("Status"),
        price.alias("Harga"),
        F.format_string("%.0f", "l_quantity").alias("Jumlah Barang"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Tanggal"),
    )


def _parts(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("row_index"), F.col("p_name").alias("Nama"), F.col("p_brand").alias("Merek"), F.col("p_size").cast("string").alias("Ukuran"))


def _query(table, plan, order="row_index"):
    return lambda spark, d: tables.run(plan, table(spark, d), order)


SHEET = """WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS row_index, ' ' || l_returnflag AS flag, CASE WHEN l_orderkey % 13 = 0 THEN ' ' ELSE l_linestatus END AS status,
  CASE WHEN l_orderkey % 7 = 0 THEN '' WHEN l_orderkey % 11 = 0 THEN 'n/a' ELSE printf('%.2f', l_extendedprice) END AS harga,
  printf('%.0f', l_quantity) AS jumlah, strftime(l_shipdate, '%Y-%m-%d') AS tanggal FROM lineitem),
n AS (SELECT *, try_cast(harga AS DOUBLE) AS v, try_cast(jumlah AS DOUBLE) AS q FROM t)
"""
#: An amount with grouping signs as the engine shows it.
SHOWN = "CASE WHEN v = floor(v) THEN replace(format('{{:,}}', v::BIGINT), ',', '.') ELSE rtrim(rtrim(translate(format('{{:,.2f}}', v), ',.', '.,'), '0'), ',') END".replace("{{", "{").replace("}}", "}")


#: SQL for a sum without rounding errors, which would depend on the order of rows, and for the number that an exact one is.
EXACT, AS_DOUBLE = "sum({}::DECIMAL(28, 10))", "{}::VARCHAR::DOUBLE"


def _number(metric, of, where="true"):
    value, told = "round(v, 4)", f"{of}({metric})"
    if of == "sum":
        value, told = AS_DOUBLE.format("round(exact, 4)"), f"{EXACT.format(metric)} AS exact, {AS_DOUBLE.format('exact')}"
    return SHEET + f"""SELECT {value} AS value, {SHOWN} AS text, n, rows_matched, rows_skipped FROM (
SELECT {told} AS v, count({metric}) AS n, count(*) AS rows_matched, count(*) FILTER (WHERE {metric} IS NULL AND trim({'harga' if metric == 'v' else 'jumlah'}) <> '') AS rows_skipped FROM n WHERE {where})"""


def number_parsing(spark, d):
    """Every distinct cell of a row, read where its row's cells meet: sheet rows are dealt once, and cells are not."""
    items = _items(spark, d).select("row_index", F.array_distinct(F.array("Harga", "Jumlah Barang", "Tanggal", "Flag")).alias("cells"))
    rows = items.repartition("row_index").select("row_index", F.explode("cells").alias("cell")).dropDuplicates(["row_index", "cell"])
    read = rows.select("row_index", "cell", parse_number(F.col("cell")).alias("number"))
    return read.select("*", is_numeric_cell(F.col("cell"), F.col("number")).alias("numeric"))


def number_ratio(spark, d):
    t = _items(spark, d)
    return t.groupBy("Flag").agg(F.round(numeric_ratio(F.col("Harga")), 6).alias("harga"), F.round(numeric_ratio(F.col("Status")), 6).alias("status"))


def number_format(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", format_number(F.round("o_totalprice", 2)).alias("shown"), format_number(F.floor("o_totalprice").cast("double")).alias("whole"))


def excel_dates(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    serial = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")).cast("double")
    return o.select("o_orderkey", excel_serial(serial).alias("day"), excel_serial(serial + 0.5).alias("noon"))


#: Cells as people write them, and the numbers they hold.
WRITTEN = {
    "18000": 18000, "18.000": 18000, "1.234,56": 1234.56, "1,234.56": 1234.56, "Rp 25.000": 25000, "(1.500)": -1500, "-12": -12, "15%": 15, "2026-08-02": None,
    "PRD-001": None, "": None, "tidak ada data": None, "30,5": 30.5, "1234.567": 1234567, "1,234,567": None, "Rp1.500": None, " 7 ": 7, "12.345.678": 12345678, "0,5": 0.5,
    "1,234": 1234, "USD 1,000.50": 1000.5, "-1.5": -1.5, "3 juta": None, "10:30": 1030, "12/05/2024": None,
}


def number_forms(spark, d):
    """Every form of number, beside every order."""
    forms = F.explode(F.array(*map(F.lit, WRITTEN))).alias("cell")
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", forms)
    return rows.groupBy("cell", parse_number(F.col("cell")).alias("number")).agg(F.count("*").alias("n"))


QUERIES = {
    "table_sum": _query(_items, Plan("sum", "harga")),
    "table_avg": _query(_items, Plan("avg", "Harga", where=Where("flag", "=", "R"))),
    "table_min": _query(_items, Plan("min", "HARGA")),
    "table_max": _query(_items, Plan("max", "jumlah barang", where=Where("Status", "!=", "F"))),
    "table_count": _query(_items, Plan("count")),
    "table_count_nonblank": _query(_items, Plan("count", "Harga", where=Where("Flag", "=", "a"))),
    "table_count_distinct": _query(_items, Plan("count_distinct", "Tanggal")),
    "table_top_n": _query(_items, Plan("top_n", "Jumlah_Barang", "Tanggal", limit=10)),
    "table_top_n_asc": _query(_items, Plan("top_n", "Harga", "Status", order="asc")),
    "table_list_rows": _query(_items, Plan("list_rows", where=Where("Flag", "contains", "n"), limit=7)),
    "table_where_contains": _query(_parts, Plan("count", where=Where("Nama", "contains", "al"))),
    "table_where_not_contains": _query(_parts, Plan("count", where=Where("Merek", "not_contains", "#1"))),
    "table_where_numeric": _query(_items, Plan("sum", "Jumlah Barang", where=Where("Jumlah Barang", ">=", "25"))),
    "table_where_text_order": _query(_parts, Plan("count", where=Where("Merek", ">", "Brand#12"))),
    "number_parsing": number_parsing,
    "number_ratio": number_ratio,
    "number_format": number_format,
    "excel_dates": excel_dates,
    "number_forms": number_forms,
}
ORACLE_SQL = {
    "table_sum": _number("v", "sum"),
    "table_avg": _number("v", "avg", "lower(trim(flag)) = 'r'"),
    "table_min": _number("v", "min"),
    "table_max": _number("q", "max", "lower(trim(status)) <> 'f'"),
    "table_count": SHEET + "SELECT count(*) AS rows_matched, count(*) AS value FROM n",
    "table_count_nonblank": SHEET + "SELECT count(*) AS rows_matched, count(*) FILTER (WHERE trim(harga) <> '') AS value FROM n WHERE lower(trim(flag)) = 'a'",
    "table_count_distinct": SHEET + "SELECT count(*) AS value, list(tanggal ORDER BY tanggal)[1:50] AS sample FROM (SELECT DISTINCT tanggal FROM n)",
    "table_top_n": SHEET + f"SELECT key, round(v, 4) AS value, {SHOWN} AS text FROM (SELECT tanggal AS key, sum(q) AS v, min(row_index) AS first FROM n GROUP BY 1 ORDER BY v DESC, first LIMIT 10)",
    "table_top_n_asc": SHEET
    + f"SELECT key, {AS_DOUBLE.format('round(exact, 4)')} AS value, {SHOWN} AS text FROM (SELECT CASE WHEN trim(status) = '' THEN '(kosong)' ELSE trim(status) END AS key, {EXACT.format('n.v')} AS exact, {AS_DOUBLE.format('exact')} AS v, min(row_index) AS first FROM n WHERE n.v IS NOT NULL GROUP BY 1 ORDER BY v, first LIMIT 5)",
    "table_list_rows": SHEET + "SELECT row_index, flag AS \"Flag\", status AS \"Status\", harga AS \"Harga\", jumlah AS \"Jumlah Barang\", tanggal AS \"Tanggal\" FROM n WHERE lower(flag) LIKE '%n%' ORDER BY row_index LIMIT 7",
    "table_where_contains": "SELECT count(*) AS rows_matched, count(*) AS value FROM part WHERE contains(lower(trim(p_name)), 'al')",
    "table_where_not_contains": "SELECT count(*) AS rows_matched, count(*) AS value FROM part WHERE NOT contains(lower(trim(p_brand)), '#1')",
    "table_where_numeric": _number("q", "sum", "q >= 25"),
    "table_where_text_order": "SELECT count(*) AS rows_matched, count(*) AS value FROM part WHERE lower(trim(p_brand)) = 'brand#12'",
    "number_parsing": SHEET
    + """SELECT DISTINCT row_index, cell, CASE WHEN regexp_matches(cell, '^[0-9]+([.][0-9]+)?$') THEN CASE WHEN regexp_matches(cell, '^[0-9]+[.][0-9]{3}$') THEN replace(cell, '.', '')::DOUBLE ELSE cell::DOUBLE END END AS number,
regexp_matches(cell, '^[0-9]+([.][0-9]+)?$') AS numeric FROM (SELECT row_index, unnest([harga, jumlah, tanggal, flag]) AS cell FROM t)""",
    "number_ratio": SHEET + "SELECT flag AS \"Flag\", round(avg(CASE WHEN trim(harga) <> '' THEN (v IS NOT NULL)::INT END), 6) AS harga, 0.0::DOUBLE AS status FROM n GROUP BY flag",
    "number_format": f"SELECT o_orderkey, (SELECT {SHOWN} FROM (SELECT round(o_totalprice, 2) AS v)) AS shown, (SELECT {SHOWN} FROM (SELECT floor(o_totalprice)::DOUBLE AS v)) AS whole FROM orders",
    "excel_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') || ' 12:00:00' AS noon FROM orders",
    "number_forms": "SELECT cell, number::DOUBLE AS number, (SELECT count(*) FROM orders) AS n FROM (VALUES " + ", ".join(f"('{c}', {'NULL' if v is None else v})" for c, v in WRITTEN.items()) + ") AS t(cell, number)",
}
