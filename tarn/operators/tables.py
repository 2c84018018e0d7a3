"""Table analytics: a validated plan over one table of text cells, compiled to a DataFrame.

A user table is rows of strings with headers found at run time.  A ``Plan`` is
bound to the headers on the driver, checked against the cells with one small
aggregate, and becomes a single scan: filter, parse, aggregate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.numbers import format_number, is_numeric_cell, numeric_ratio, parse_number
from tarn.functions.text import keywords

#: The operations, those that need numbers, and the limits of the plan language.
OPERATIONS = ("sum", "avg", "min", "max", "count", "count_distinct", "top_n", "list_rows", "none")
NUMERIC_OPERATIONS = ("sum", "avg", "min", "max", "top_n")
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "contains", "not_contains")
MAX_ROWS = 50
DEFAULT_ROWS = 5
LEAST_NUMERIC = 0.5
EMPTY_KEY = "(kosong)"


class PlanError(ValueError):
    """A plan that the table can't answer; carries the columns that there are."""

    def __init__(self, reason: str, columns: list[str] | None = None):
        super().__init__(reason)
        self.columns = columns or []


@dataclass(frozen=True)
class Where:
    column: str
    operator: str
    value: str


@dataclass(frozen=True)
class Plan:
    operation: str
    metric: str | None = None
    group_by: str | None = None
    where: Where | None = None
    order: str = "desc"
    limit: int = DEFAULT_ROWS


def safe_limit(value) -> int:
    try:
        return max(1, min(MAX_ROWS, int(value)))
    except (TypeError, ValueError):
        return DEFAULT_ROWS


def plan_from_json(raw: dict) -> Plan | None:
    """The plan that untrusted JSON asks for, everything unknown dropped; None for an operation that there isn't."""
    text = lambda v: v.strip() if isinstance(v, str) and v.strip() else None
    operation = str(raw.get("operation") or "").strip().lower()
    if operation not in OPERATIONS:
        return None
    where, found = raw.get("where"), None
    if isinstance(where, dict) and text(where.get("column")):
        operator = str(where.get("operator") or "=").strip().lower()
        found = Where(text(where["column"]), operator if operator in OPERATORS else "=", str(where.get("value") if where.get("value") is not None else ""))
    order = "asc" if str(raw.get("order") or "").lower() == "asc" else "desc"
    return Plan(operation, text(raw.get("metric")), text(raw.get("group_by")), found, order, safe_limit(raw.get("limit")))


def resolve_column(name: str | None, headers: list[str]) -> str | None:
    """The header meant: equal but for case, else equal in letters and digits."""
    squeeze = lambda s: re.sub("[^a-z0-9]+", "", s.strip().lower())
    for same in (lambda h: h.strip().lower() == name.strip().lower(), lambda h: squeeze(h) == squeeze(name)):
        for h in headers if name else []:
            if same(h):
                return h
    return None


def cell(column: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))


def bind(plan: Plan, table: DataFrame) -> Plan:
    """The plan with real headers, or PlanError. Looks at the cells only where the operation needs numbers."""
    headers = [h for h in table.columns if not h.startswith("__")]
    metric, group, where = resolve_column(plan.metric, headers), resolve_column(plan.group_by, headers), plan.where
    if where is not None:
        column = resolve_column(where.column, headers)
        if column is None:
            raise PlanError(f"no filter column {where.column!r}", headers)
        where = replace(where, column=column)
    if plan.operation in NUMERIC_OPERATIONS:
        if metric is None:
            raise PlanError(f"no number column {plan.metric!r}", headers)
        ratio = table.agg(numeric_ratio(F.col(f"`{metric}`"))).first()[0]
        if ratio < LEAST_NUMERIC:
            raise PlanError(f"{metric!r} is not a number column ({ratio:.0%})", headers)
    if plan.operation in ("count_distinct", "list_rows") and plan.metric is not None and metric is None:
        raise PlanError(f"no column {plan.metric!r}", headers)
    if plan.operation == "top_n" and group is None:
        raise PlanError(f"no group column {plan.group_by!r}", headers)
    return replace(plan, metric=metric, group_by=group, where=where)


def condition(where: Where | None) -> Column:
    """Cells compare as trimmed lower-case text; as numbers where both sides are numbers; otherwise only for equality, whatever the sign."""
    if where is None:
        return F.lit(True)
    have, want = F.lower(cell(where.column)), F.lower(F.trim(F.lit(where.value)))
    if where.operator == "contains":
        return F.contains(have, want)
    if where.operator == "not_contains":
        return ~F.contains(have, want)
    if where.operator == "!=":
        return have != want
    a, b = parse_number(have), parse_number(want)
    number = {"=": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[where.operator]
    return F.when(a.isNotNull() & b.isNotNull(), number).otherwise(have == want)


def exact_sum(number: Column) -> Column:
    """Aggregate: the sum of numbers, without rounding errors (which would depend on the order of rows) for those below 1e18 with ten decimals or fewer."""
    exact = number.try_cast("decimal(28,10)")
    fits = exact.isNotNull() & (exact.cast("double") == number)
    first, rest = F.sum(F.when(fits, exact)).cast("double"), F.sum(F.when(number.isNotNull() & ~fits, number))
    return F.coalesce(first + rest, first, rest)


def execute(plan: Plan, table: DataFrame, order: str) -> DataFrame:
    """The answer of a bound plan. ``order`` is the column that gives rows their order."""
    rows = table.where(condition(plan.where))
    if plan.operation in ("sum", "avg", "min", "max"):
        number = parse_number(cell(plan.metric))
        of = {"sum": exact_sum, "avg": F.avg, "min": F.min, "max": F.max}[plan.operation](number)
        skipped = F.sum((number.isNull() & (cell(plan.metric) != "")).cast("long"))
        out = rows.agg(of.alias("v"), F.count(number).alias("n"), F.coalesce(skipped, F.lit(0)).alias("rows_skipped"), F.count("*").alias("rows_matched"))
        return out.select(F.round("v", 4).alias("value"), format_number(F.col("v")).alias("text"), "n", "rows_matched", "rows_skipped")
    if plan.operation == "count":
        value = F.count("*") if plan.metric is None else F.sum((cell(plan.metric) != "").cast("long"))
        return rows.agg(F.count("*").alias("rows_matched"), F.coalesce(value, F.lit(0)).alias("value"))
    if plan.operation == "count_distinct":
        column = plan.metric or [h for h in table.columns if h != order][0]
        values = rows.select(cell(column).alias("v")).where("v <> ''").distinct()  # the sample is the least values only: never a set in one row
        sample = values.orderBy("v").limit(MAX_ROWS).agg(F.array_sort(F.collect_list("v")).alias("sample"))
        return values.agg(F.count("*").alias("value")).crossJoin(F.broadcast(sample))
    if plan.operation == "list_rows":
        return rows.orderBy(order).limit(plan.limit)
    if plan.operation == "top_n":
        number = parse_number(cell(plan.metric))
        key = F.when(cell(plan.group_by) == "", EMPTY_KEY).otherwise(cell(plan.group_by))
        sums = rows.where(number.isNotNull()).groupBy(key.alias("key")).agg(exact_sum(number).alias("v"), F.min(order).alias("first"))
        sign = F.desc("v") if plan.order == "desc" else F.asc("v")
        return sums.orderBy(sign, "first").limit(min(plan.limit, MAX_ROWS)).select("key", F.round("v", 4).alias("value"), format_number(F.col("v")).alias("text"))
    raise PlanError(f"operation {plan.operation!r} can't be run")


def run(plan: Plan, table: DataFrame, order: str) -> DataFrame:
    return execute(bind(plan, table), table, order)


def facts(plan: Plan, table: DataFrame, order: str, scope: str = "") -> dict:
    """The envelope of an answer that a narrator may quote; the result has MAX_ROWS rows at most."""
    bound = bind(plan, table)
    counts = table.agg(F.count("*").alias("all"), F.sum(condition(bound.where).cast("long")).alias("matched")).first()
    return {
        "operation": bound.operation,
        "metric": bound.metric,
        "group_by": bound.group_by,
        "scope": scope,
        "rows_total": counts["all"],
        "rows_scanned": counts["all"],
        "rows_matched": counts["matched"] or 0,
        "result": [r.asDict() for r in execute(bound, table, order).limit(MAX_ROWS).collect()],
    }


def header_names(cells: DataFrame, longest: int = 80) -> DataFrame:
    """(table_id, place, header) of header cells (table_id, place from 1, cell): trimmed, blank ones named by place, repeats numbered in order."""
    name = F.trim(F.regexp_replace(F.coalesce("cell", F.lit("")), r"\s+", " "))
    named = cells.select("table_id", "place", F.when(name == "", F.concat(F.lit("kolom_"), F.col("place").cast("string"))).otherwise(name).alias("name"))
    again = F.row_number().over(Window.partitionBy("table_id", "name").orderBy("place"))
    numbered = named.withColumn("n", again)
    shown = F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("n").cast("string")))
    return numbered.select("table_id", "place", F.substring(shown, 1, longest).alias("header"))


def choose(questions: DataFrame, tables: DataFrame, most: int = 1) -> DataFrame:
    """(query_id, table_id, overlap, place): for each question (query_id, query) the tables (table_id, document_name, sheet, headers) whose description shares most key words with it.

    Shared words are found by an equi-join; a question that shares none with
    any table gets the first tables by id, with an overlap of 0.
    """
    described = F.concat_ws(" ", "document_name", "sheet", F.array_join("headers", " "))
    words = lambda c: F.explode(F.array_distinct(keywords(c))).alias("word")
    asked = questions.select("query_id", words(F.col("query")))
    known = tables.select("table_id", words(described))
    shared = asked.join(known, "word").groupBy("query_id", "table_id").agg(F.count("*").alias("overlap"))
    first = tables.select("table_id").orderBy("table_id").limit(most)  # ``most`` rows
    default = questions.select("query_id").distinct().crossJoin(F.broadcast(first)).withColumn("overlap", F.lit(0).cast("long"))
    met = shared.unionByName(default).groupBy("query_id", "table_id").agg(F.max("overlap").alias("overlap"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "table_id"))
    return met.withColumn("place", place).where(F.col("place") <= most)


#: Words in the names of date columns, their form, and how many cells are looked at.
DATE_NAMES = ("tanggal", "tgl", "date", "waktu", "time", "periode")
DATE_FORM = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"
DATE_CELLS, DATE_SHARE = 50, 0.6


def date_columns(table: DataFrame, order: str) -> DataFrame:
    """(column, is_date): columns named like dates whose first cells, those not blank of fifty, mostly are."""
    headers = [h for h in table.columns if h != order]
    first = table.orderBy(order).limit(DATE_CELLS)
    filled = lambda h: F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("")) != ""
    share = lambda h: F.coalesce(F.avg(F.when(filled(h), F.col(f"`{h}`").rlike(DATE_FORM).cast("double"))), F.lit(0.0))
    named = {h: any(w in h.strip().lower() for w in DATE_NAMES) for h in headers}
    told = first.agg(*[(F.lit(named[h]) & (share(h) >= DATE_SHARE)).alias(f"c{i}") for i, h in enumerate(headers)])
    return told.select(F.explode(F.array(*[F.struct(F.lit(h).alias("column"), F.col(f"c{i}").alias("is_date")) for i, h in enumerate(headers)])).alias("x")).select("x.column", "x.is_date")


def clean_headers(headers: list[str], longest: int = 80) -> list[str]:
    """Headers trimmed, blank ones named by place, repeats numbered."""
    out: list[str] = []
    for i, h in enumerate(headers, 1):
        name = (" ".join(str(h or "").split()) or f"kolom_{i}")[:longest]
        same, n = name, 2
        while same.lower() in {x.lower() for x in out}:
            same, n = f"{name}_{n}", n + 1
        out.append(same)
    return out


__all__ = ["Plan", "PlanError", "Where", "bind", "choose", "clean_headers", "condition", "date_columns", "execute", "facts", "is_numeric_cell", "plan_from_json", "resolve_column", "run"]
