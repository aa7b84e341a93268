"""Bytes to lines: the line and column of any number of places in any number of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a file that are looked at together.
SPAN = 1 << 16


def located(places: DataFrame, lines: DataFrame, span: int = SPAN) -> DataFrame:
    """``places`` (path, byte, and more) with line and col, from ``lines`` (path, line, start) of ``scan.line_starts``.

    An as-of join by union: within a span of a file places and lines stand in
    order, and the last line before a place is carried to it.  A place before
    the first line of its span takes the last one of the spans before, of which
    there is a row a span.  So a long file is as many groups as it has spans, and
    neither places nor lines are compared with one another.  Where there is no
    line before a place (line 1 begins at 0) both are null, as for a null byte;
    a null path is a path; repeated places each get theirs.
    """
    more = [c for c in places.columns if c not in ("path", "byte")]
    row = F.struct(*[F.col(c) for c in more]) if more else F.struct(F.lit(None).cast("int").alias("none"))
    asked = places.select("path", F.col("byte").cast("long").alias("at"), F.lit(True).alias("asks"), row.alias("more"), F.lit(None).cast("struct<start:bigint,line:bigint>").alias("here"))
    given = lines.select("path", F.col("start").cast("long").alias("at"), F.lit(False).alias("asks"), F.lit(None).cast(asked.schema["more"].dataType).alias("more"), F.struct(F.col("start").cast("long").alias("start"), F.col("line").cast("long").alias("line")).alias("here"))
    events = asked.unionByName(given).withColumn("span", F.floor(F.col("at") / span))
    within = W.partitionBy("path", "span").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, 0)
    met = events.withColumn("own", F.last("here", ignorenulls=True).over(within)).where("asks")
    # The last line of each span with any, carried over those without.
    spans = events.groupBy("path", "span").agg(F.max("here").alias("last"), F.bool_or("asks").alias("asked"))
    carried = spans.withColumn("carried", F.last("last", ignorenulls=True).over(W.partitionBy("path").orderBy("span").rowsBetween(W.unboundedPreceding, -1))).where("asked")
    carried = carried.select(F.col("path").alias("__path"), F.col("span").alias("__span"), "carried")
    both = met.join(carried, F.col("path").eqNullSafe(F.col("__path")) & F.col("span").eqNullSafe(F.col("__span")), "left")
    here = F.when(F.col("at").isNotNull(), F.coalesce("own", "carried"))
    return both.select("path", F.col("at").alias("byte"), *[F.col("more")[c].alias(c) for c in more], here["line"].alias("line"), (F.col("at") - here["start"]).alias("col"))
