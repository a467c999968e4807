"""Range sets and cardinalities: ARRAY<STRUCT<start BIGINT, end BIGINT>>, ends inclusive, a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPE = "array<struct<start:bigint,end:bigint>>"


def span(start, end) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(start).cast("bigint").alias("start"), as_column(end).cast("bigint").alias("end"))


def any_cardinality() -> Column:
    return F.array(span(0, None)).cast(TYPE)


def is_valid(r: Column) -> Column:
    return r["end"].isNull() | (r["start"] <= r["end"])


def in_range(v: Column, r: Column) -> Column:
    return (v >= r["start"]) & (r["end"].isNull() | (v <= r["end"]))


def overlaps(a: Column, b: Column) -> Column:
    """Inclusive at both ends."""
    return (b["end"].isNull() | (a["start"] <= b["end"])) & (a["end"].isNull() | (b["start"] <= a["end"]))


def covers(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (a["end"].isNull() | (b["end"].isNotNull() & (b["end"] <= a["end"])))


def neighbours(a: Column, b: Column) -> Column:
    return (a["end"] + 1 == b["start"]) | (b["end"] + 1 == a["start"])


def contains_value(ranges: Column, v: Column) -> Column:
    return F.exists(ranges, lambda r: in_range(v, r))


def contains_range(ranges: Column, other: Column) -> Column:
    return F.exists(ranges, lambda r: covers(r, other))


def lowest(ranges: Column) -> Column:
    """Smallest value; null for an empty set."""
    return F.array_min(F.transform(ranges, lambda r: r["start"]))


def highest(ranges: Column) -> Column:
    """Largest value; null if open or empty."""
    return F.when(~F.exists(ranges, lambda r: r["end"].isNull()), F.array_max(F.transform(ranges, lambda r: r["end"])))


def parse_cardinality(c: Column) -> Column:
    """{1}, {0-1}, {>0}, {<5}, {*}, lists by comma.  Null if malformed.  a-b needs b > a."""
    body = F.regexp_extract(c, r"\A\s*\{([^{}]*)\}\s*\z", 1)
    parts = F.transform(F.split(body, ","), lambda p: F.btrim(p, F.lit(" \t\r\n")))
    number = lambda p, k, pattern: F.regexp_extract(p, pattern, k).try_cast("bigint")

    def one(p):
        pair = r"\A(\d+)\s*-\s*(\d+)\z"
        return (
            F.when(p == "*", span(0, None))
            .when(p.rlike(r"\A\d+\z"), span(p.try_cast("bigint"), p.try_cast("bigint")))
            .when(p.rlike(pair) & (number(p, 2, pair) > number(p, 1, pair)), span(number(p, 1, pair), number(p, 2, pair)))
            .when(p.rlike(r"\A>\s*\d+\z"), span(number(p, 1, r"(\d+)") + 1, None))
            .when(p.rlike(r"\A<\s*\d+\z") & (number(p, 1, r"(\d+)") > 0), span(0, number(p, 1, r"(\d+)") - 1))
        )

    ranges = F.transform(parts, one)
    ok = c.rlike(r"\A\s*\{[^{}]+\}\s*\z") & ~F.exists(ranges, lambda r: r.isNull())
    return F.when(ok, F.array_sort(ranges))


def print_cardinality(ranges: Column) -> Column:
    def one(r):
        return (
            F.when(r["end"].isNull() & (r["start"] == 0), F.lit("*"))
            .when(r["end"].isNull(), F.concat(F.lit(">"), (r["start"] - 1).cast("string")))
            .when(r["start"] == r["end"], r["start"].cast("string"))
            .when(r["start"] == 0, F.concat(F.lit("<"), (r["end"] + 1).cast("string")))
            .otherwise(F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string")))
        )

    return F.concat(F.lit("{"), F.array_join(F.transform(ranges, one), ","), F.lit("}"))


def from_value(kind: Column, text: Column) -> Column:
    """Cardinality of a value: an int n >= 0 is {n}, a string is parsed, anything else is null."""
    n = text.try_cast("bigint")
    return F.when((kind == "int") & (n >= 0), F.array(span(n, n))).when(kind.isin("cardinality", "string"), parse_cardinality(text)).cast(TYPE)


def coalesce_spans(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans of each key merged where they overlap or touch (integers that differ by one touch): keys, start, end, n_merged.

    A null end is open.  A row without start has no place: it only counts, with its key's last span; where a key has
    no other rows, each is a span of nulls.
    """
    far = 2**62
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__s"), F.asc_nulls_last("__e"))
    s = F.col(start)
    x = df.select(*keys, s.alias("__s"), F.when(s.isNotNull(), F.coalesce(F.col(end), F.lit(far))).alias("__e"))
    x = x.withColumn("__reach", F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.col("__reach").isNull() | F.coalesce(F.col("__s") > F.col("__reach") + 1, F.lit(False))
    x = x.withColumn("__island", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = x.groupBy(*keys, "__island").agg(F.min("__s").alias(start), F.max("__e").alias(end), F.count("*").alias("n_merged"))
    return out.withColumn(end, F.when(F.col(end) < far, F.col(end))).drop("__island")
