"""Markdown reports assembled by ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import general4


def joined(parts: DataFrame, key: str, order: str, text: str, sep: str = "\n\n", name: str = "report") -> DataFrame:
    """One text for each key from its parts in order."""
    return parts.groupBy(key).agg(F.concat_ws(sep, F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])).alias(name))


def section(number: Column, title: Column, body: Column) -> Column:
    """'## N. Title' and its body."""
    return F.concat_ws("\n\n", F.concat(F.lit("## "), number.cast("string"), F.lit(". "), title), body)


def number_text(value: Column, kind: str) -> Column:
    """A figure in a report: floating ones in four significant digits, others as they are."""
    return general4(value) if kind in ("float", "double") else value.cast("string")


def series_table(rows: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """A Markdown table of each key's series, years ascending."""
    line = F.concat(F.lit("| "), F.col(year).cast("string"), F.lit(" | "), number_text(F.col(value), rows.schema[value].dataType.simpleString()), F.lit(" |"))
    head = "| year | value |\n| --- | --- |\n"
    out = joined(rows.withColumn("_line", line), key, year, "_line", "\n", "table")
    return out.withColumn("table", F.concat(F.lit(head), "table"))


def metric_route(sources: Column) -> Column:
    """'worldbank' if there are sources and all are the indicator source, else 'researcher'."""
    return F.when((F.size(sources) > 0) & F.forall(sources, lambda s: s == "WorldBank"), "worldbank").otherwise("researcher")


def metric_section(name: Column, text: Column) -> Column:
    """(number, title, body) of a metric's file: its first '## N. Title' heading, hoisted to the front of all lines but document titles.

    A file without one is headed by the number in its name.
    """
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    lines = F.filter(F.split(F.regexp_replace(clean, r"^# [^\n]*\n(?:[^\S\n]*\n)*", ""), "\n"), lambda x: ~F.startswith(x, F.lit("# ")))
    heading = r"^##\s+(\d+)\.\s+(.*\S)\s*$"
    at = F.aggregate(lines, F.struct(F.lit(0).alias("i"), F.lit(0).alias("hit")), lambda s, x: F.struct((s["i"] + 1).alias("i"), F.when((s["hit"] == 0) & F.regexp_like(x, F.lit(heading)), s["i"] + 1).otherwise(s["hit"]).alias("hit")), lambda s: s["hit"])
    number = F.regexp_extract(name, r"(\d+)", 1).cast("int").cast("string")
    own = F.concat(F.lit("## "), number, F.lit(". Metric "), number)
    head = F.when(at > 0, F.get(lines, at - 1)).otherwise(own)
    rest = F.when(at > 0, F.concat(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(lines, F.greatest(at, F.lit(0)) + 1, F.size(lines)))).otherwise(lines)
    body = F.regexp_replace(F.array_join(F.concat(F.array(head), rest), "\n"), r"^\s+|\s+$", "")
    return F.struct(F.regexp_extract(head, heading, 1).cast("int").alias("number"), F.regexp_extract(head, heading, 2).alias("title"), body.alias("body"))


def parsed_sections(files: DataFrame, name: str, text: str) -> DataFrame:
    """(name, number, title, body) of each file that isn't blank."""
    some = files.where(F.regexp_like(F.col(text), F.lit(r"\S")))
    return some.select(name, metric_section(F.col(name), F.col(text)).alias("_s")).select(name, "_s.*")


def combined(files: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """(key, report): each key's files as one document, sections by number under the first file's title.

    Files come in the order of their names; without a title it is '# Research report'.  Keys whose
    files are all blank have no report.
    """
    some = files.where(F.regexp_like(F.col(text), F.lit(r"\S"))).withColumn("_s", metric_section(F.col(name), F.col(text)))
    first = F.nullif(F.regexp_extract(F.regexp_replace(text, r"^\s+", ""), r"^(# [^\n]*)", 1), F.lit(""))
    title = F.coalesce(F.min_by(F.rtrim(first), F.when(first.isNotNull(), F.col(name))), F.lit("# Research report"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_s.number", name, "_s.body"))), lambda x: x["body"])
    joined_ = F.regexp_replace(F.array_join(parts, "\n\n"), r"\s+$", "")
    return some.groupBy(key).agg(F.concat(title, F.lit("\n\n"), joined_, F.lit("\n")).alias("report"))


def route_counts(routes: DataFrame, key: str, route: str = "route") -> DataFrame:
    """(key, worldbank, researcher): how many metrics go which way."""
    return routes.groupBy(key).agg(F.count_if(F.col(route) == "worldbank").alias("worldbank"), F.count_if(F.col(route) != "worldbank").alias("researcher"))


def selected(metrics: DataFrame, key: str, ordinal: str, asked: DataFrame, strict: bool = True) -> DataFrame:
    """Metrics by position from 1, in the order asked for, repeats kept; asked: (key, i, n).

    A position that no metric has is an error, or with ``strict`` off a row of nulls.
    """
    met = asked.join(metrics.withColumnRenamed(ordinal, "n").withColumn("_there", F.lit(True)), [key, "n"], "left")
    if strict:
        fail = F.raise_error(F.concat(F.lit("no metric at position "), F.col("n").cast("string")))
        met = met.where(F.when(F.col("_there").isNull(), fail.cast("boolean")).otherwise(F.lit(True)))
    return met.drop("_there")
