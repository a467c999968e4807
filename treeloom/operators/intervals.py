"""Annotations as intervals: overlaps, pairing of starts and ends, overlap turned into nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping_pairs(spans: DataFrame, key: str, ident: str, start: str, end: str, width: int) -> DataFrame:
    """(key, a, b): pairs of spans of one key that share a point (ends inclusive), a < b.

    A span is dealt to the cells of ``width`` that it touches, so the join is an equi-join on (key, cell).  A pair
    comes out once, in the cell where the later of the two starts: no distinct is needed.
    """
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    a = cells.select(key, "cell", F.col(ident).alias("a"), F.col(start).alias("a_start"), F.col(end).alias("a_end"))
    b = cells.select(key, "cell", F.col(ident).alias("b"), F.col(start).alias("b_start"), F.col(end).alias("b_end"))
    both = a.join(b, [key, "cell"]).where("a < b and a_start <= b_end and b_start <= a_end")
    return both.where(F.col("cell") == F.floor(F.greatest("a_start", "b_start") / width)).select(key, "a", "b")


def pair_unique(events: DataFrame, key: list[str], order: list[str], ident: str, is_start: str) -> DataFrame:
    """(start_id, end_id): each end with the last start of its key before it, if that start has no earlier end."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(is_start), F.col(ident)), ignorenulls=True).over(w)
    ends = events.withColumn("start_id", last).where(~F.col(is_start) & F.col("start_id").isNotNull())
    first = Window.partitionBy("start_id").orderBy(*order)
    return ends.withColumn("r", F.row_number().over(first)).where("r = 1").select("start_id", F.col(ident).alias("end_id"))


def pair_stack(events: DataFrame, doc: str, position: str, name: str, is_start: str, scope: str | None = None) -> DataFrame:
    """(doc, start_at, end_at): each end closes the nearest unclosed start of its name, in a document (a bounded group).

    scope: a part of the document that pairs may not leave, such as the subtree field that holds the anchors; an end
    never closes a start of another part.  Events without a document pair with nothing and are left out.
    """

    def run(pdf):
        import pandas as pd

        open_, out = [], []
        for p, n, s in pdf.sort_values(position)[[position, name, is_start]].itertuples(index=False):
            if s:
                open_.append((p, n))
                continue
            for k in range(len(open_) - 1, -1, -1):
                if n in ("", None) or open_[k][1] == n:
                    out.append((pdf[doc].iloc[0], open_.pop(k)[0], p))
                    break
            else:
                out.append((pdf[doc].iloc[0], None, p))
        out += [(pdf[doc].iloc[0], p, None) for p, _ in open_]
        return pd.DataFrame(out, columns=["doc", "start_at", "end_at"]).astype({"start_at": "Int64", "end_at": "Int64"})

    groups = [doc, scope] if scope else [doc]
    return events.where(F.col(doc).isNotNull()).groupBy(*groups).applyInPandas(run, "doc bigint, start_at bigint, end_at bigint")


def segments(spans: DataFrame, key: str, ident: str, start: str, end: str, width: int) -> DataFrame:
    """(key, seg_start, seg_end, active): stretches between boundaries with the spans open over them.

    active lists span ids in order of start: the nesting order of elements over that stretch.  Boundaries come from a
    running window; a stretch lies in the cell of ``width`` of its start and meets the spans dealt to that cell.
    """
    bounds = spans.select(key, F.col(start).alias("at")).union(spans.select(key, F.col(end))).distinct()
    w = Window.partitionBy(key).orderBy("at")
    segs = bounds.select(key, F.col("at").alias("seg_start"), F.lead("at").over(w).alias("seg_end")).where("seg_end is not null")
    segs = segs.withColumn("cell", F.floor(F.col("seg_start") / width))
    s = spans.where(F.col(start) < F.col(end)).select(F.col(key), F.col(ident).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"))
    s = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    covered = segs.join(s, [key, "cell"]).where("s <= seg_start and seg_end <= e")
    out = covered.groupBy(key, "seg_start", "seg_end").agg(F.array_sort(F.collect_list(F.struct("s", "id"))).alias("open"))
    return out.select(key, "seg_start", "seg_end", F.transform("open", lambda x: x["id"]).alias("active"))
