"""Mixing sources to target weights, exact to the word.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the
corpus's words by weight; a target stops at MOST times its source's size and
the excess is shared again.  Documents of a source are put in the order of a
hash of their id; running totals of their sizes then tell which of them the
source's budget covers: whole epochs first, then documents until the budget is
spent, the last one in part.

Defined cases: a null text has size 0; a null source is a source; a source
without words has target 0; rows of equal id, source and size are decided on
one by one, in any order among equals; a text of any length counts whole; an
empty table gives an empty mix; other columns are ignored (plan) or kept
(applied).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import with_running_total
from .shared import WORD_PATTERN, broadcast_if_small, cut

MOST, WEIGHTS = 3, 3


def order_key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so one task suffices.

    With sources by the ratio of cap to weight, those whose share exceeds
    their cap come first; the level of the first one that keeps its share is
    the share per weight of all that follow.
    """
    ranked = sizes.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % WEIGHTS + 1)
    cap = F.lit(MOST) * F.col("source_size")
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    ranked = ranked.withColumn("ratio", cap.cast("double") / F.col("weight")).withColumn("place", F.row_number().over(by_ratio))
    every = W.partitionBy(F.lit(1))
    share = (F.sum("source_size").over(every) - (F.sum(cap).over(by_ratio) - cap)) / (F.sum("weight").over(every) - (F.sum("weight").over(by_ratio) - F.col("weight")))
    ranked = ranked.withColumn("share", share.cast("double"))
    first = F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("place", "share"))).over(every)
    return ranked.withColumn("level", F.coalesce(first["share"], F.lit(float("inf")))).select("source", "source_size", F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key, nth, equals, source_size, target, taken, copies, part: what the mix takes of each document.

    nth counts the ``equals`` rows of one place (source, key, doc_id, size) from 0.

    copies is whole epochs, plus one where the running budget covers the whole
    document; part is the words of a last partial copy.
    """
    sized = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"), order_key(F.col("doc_id")).alias("key"),
    )
    sized = cut(sized)
    sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    # Rows of one place differ in nothing here, so totals run over places and each row follows by its number.
    places = cut(sized.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("equals")).withColumn("sum", F.col("equals") * F.col("size")))
    placed = with_running_total(places, "source", ["key", "doc_id", "size"], "sum", places.count())
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("equals") - 1)))
    placed = placed.withColumn("before", F.col("before") + F.col("nth") * F.col("size"))
    s = broadcast_if_small(sources.select(F.col("source").alias("__source"), "source_size", "target"))
    planned = placed.join(s, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    budget, total = F.floor("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    planned = planned.withColumn("epochs", F.expr("cast(floor(target) as long) div greatest(source_size, 1L)"))
    rest = budget - F.col("epochs") * total
    planned = planned.withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long"))
    planned = planned.withColumn("whole", (F.col("last") == F.col("size")) & (F.col("size") > 0))
    return planned.select(
        "doc_id", "source", "size", "key", "nth", "equals", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("last")).alias("taken"),
        "epochs", (F.col("epochs") + F.col("whole").cast("long")).alias("copies"), F.when(F.col("whole"), 0).otherwise(F.col("last")).cast("long").alias("part"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (row, place, ...) with nth: their number from 0 among the rows of the same source and place."""
    held = cut(rows.withColumn("id", F.monotonically_increasing_id()))
    ids = held.select(F.struct(F.col("row")["source"].cast("string").alias("source"), "place").alias("group"), "id", F.md5(F.col("id").cast("string").cast("binary")).alias("key"), F.lit(1).cast("long").alias("one"))
    ids = with_running_total(ids, "group", ["key", "id"], "one", held.count(), "nth")
    return held.join(ids.select("id", F.col("nth").cast("long").alias("nth")), "id").drop("id")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents the mix takes, one row a copy; a partial copy ends with its last word taken.

    A source's decision is its epochs and the place in hash order where its
    budget ends, so texts meet a table of one row a source and are not shuffled;
    only rows that share that place with others are numbered.
    """
    plan = mix_plan(docs)
    place = F.struct("key", "doc_id", "size", "nth", "equals")
    ends = plan.groupBy("source").agg(
        F.max("epochs").alias("__epochs"), F.max(F.when(F.col("copies") > F.col("epochs"), place)).alias("__whole"),
        F.max(F.when(F.col("part") > 0, F.struct("key", "doc_id", "size", "nth", "equals", "part"))).alias("__part"),
    ).withColumnRenamed("source", "__source")
    ends = cut(ends)
    # The documents travel in one struct, so that no column name of theirs can clash.
    row = F.col("row")
    size = F.coalesce(F.regexp_count(row["text"], F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("place", F.struct(order_key(row["doc_id"]).alias("key"), row["doc_id"].cast("long").alias("doc_id"), size.alias("size")))
    rows = rows.join(broadcast_if_small(ends), row["source"].cast("string").eqNullSafe(F.col("__source")))
    at = lambda end, *more: F.struct(*[F.col(end)[c].alias(c) for c in ("key", "doc_id", "size", *more)])
    if ends.where("__whole.equals > 1 or __part.equals > 1").isEmpty():
        rows = rows.withColumn("nth", F.lit(0).cast("long"))
    else:
        shared = F.lit(False)
        for end in ("__whole", "__part"):
            shared |= F.coalesce(F.col(end)["equals"] > 1, F.lit(False)) & F.coalesce(F.col("place").eqNullSafe(at(end)), F.lit(False))
        rows = rows.where(~shared).withColumn("nth", F.lit(0).cast("long")).unionByName(numbered(rows.where(shared)))
    place = F.struct(*[F.col("place")[c].alias(c) for c in ("key", "doc_id", "size")], "nth")
    in_part = F.coalesce(F.col("__part").isNotNull() & place.eqNullSafe(at("__part", "nth")), F.lit(False))
    whole = F.coalesce(F.col("__whole").isNotNull() & (place <= at("__whole", "nth")) & (F.col("place.size") > 0), F.lit(False)) & ~in_part
    copies = F.col("__epochs") + whole.cast("long")
    none = F.array().cast("array<long>")
    # Negative numbers mark partial copies.
    numbers = F.concat(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(none), F.when(in_part, F.array(F.lit(-1).cast("long"))).otherwise(none))
    rows = rows.withColumn("copy", F.explode(numbers))
    pieces = F.split(row["text"], r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("copy") < 0, F.array_join(F.slice(pieces, F.lit(1), F.col("__part.part").cast("int")), "")).otherwise(row["text"])
    out = {c: row[c] for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("copy") < 0, F.length(text)).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(name) for name, c in out.items()])


#: The same mix in SQL, over whole texts.
MIX_SQL = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '')) as key
  from documents),
sources as (
  select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from sources),
ranked as (
  select *, (3 * source_size)::double / weight as ratio,
         row_number() over (order by (3 * source_size)::double / weight, source nulls last) as place from weighed),
shares as (
  select *, ((sum(source_size) over () - (sum(3 * source_size) over (order by place) - 3 * source_size))::double
          / (sum(weight) over () - (sum(weight) over (order by place) - weight))::double) as share from ranked),
levels as (
  select *, (select arg_min(share, place) from shares where share <= ratio) as level from shares),
targets as (
  select source, source_size, least((3 * source_size)::double, level * weight) as target from levels),
placed as (
  select d.*, t.source_size, t.target, floor(t.target)::bigint // greatest(t.source_size, 1) as epochs,
         (sum(size) over (partition by d.source order by key, doc_id, size rows unbounded preceding) - size)::bigint as before
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - before)))::bigint as taken
from placed
"""
