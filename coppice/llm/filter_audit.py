"""How filters interact: what each removes, alone and behind the others, in every order.

A document's failures are a mask of one bit a filter.  Spark counts masks within
each part: for every part three histograms of 32 numbers (all documents, good
ones, toxic ones) are stacked as rows, and integer matrices of 32 masks by 600
columns (120 orders of five steps) turn them into what is kept, removed,
redundant and unique at each step.  Whatever the corpus, a part is three rows.

Copies are found by digests: the smallest doc_id of each repeated text meets its
rows in a join, which adaptive execution may split where one text is hot.

Defined cases: a null text is empty, a null part the empty string; an empty text
has no words (it fails A, and E where another empty one has a smaller doc_id); a
null doc_id is a copy of nothing, nothing is a copy of it, and it has no labels;
rows that repeat a doc_id count each and are not copies of one another; a
document is good (toxic) if any of its label rows says 1; no documents give no
rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, mapped

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Every order of the filters, in the order of their letters.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parts a task multiplies at once.
BLOCK = 64
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column, words: Column) -> Column:
    """The mask of the first four filters; ``words`` is the array of a text's words."""
    n = F.size(words)
    failed = {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }
    mask = F.lit(0)
    for letter, fails in failed.items():
        mask = mask + F.when(fails, 1 << FILTERS.index(letter)).otherwise(0)
    return mask


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) of every document."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = given.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = cut(split.select("doc_id", "part", failures(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    met = rows.join(marked, "doc_id", "left").join(first, "digest", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return met.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def incidence() -> dict[str, np.ndarray]:
    """Matrices of 32 masks by 600 (order, step): 1 where a document of that mask has that outcome there."""
    mask = np.arange(MASKS)[:, None]
    bits = np.array([[1 << FILTERS.index(x) for x in order] for order in ORDERS])
    upto = np.cumsum(bits, axis=1)  # bits of one order are distinct, so their sum is their union
    bit, upto, earlier = bits.ravel(), upto.ravel(), (upto - bits).ravel()
    fails, passed = (mask & bit) != 0, (mask & earlier) == 0
    found = {"kept": (mask & upto) == 0, "removed": fails & passed, "redundant": fails & ~passed, "unique_fails": mask == bit}
    return {name: m.astype(np.int64) for name, m in found.items()}


def audit(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and MEASURES of (part, mask, n, good, toxic)."""
    rows = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 32 a part
    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    steps = len(FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = incidence()
        letter = np.array([FILTERS.index(x) for order in ORDERS for x in order])
        same = (letter[:, None] == letter[None, :]).astype(np.int64)  # sums a filter's columns over all orders
        order, step = np.repeat(ORDERS, steps), np.tile(np.arange(1, steps + 1, dtype=np.int32), len(ORDERS))
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK).to_pylist()
                stacked = np.zeros((3, len(batch), MASKS), np.int64)
                for row, r in enumerate(batch):
                    for c in r["counts"]:
                        stacked[:, row, c["mask"]] += c["n"], c["good"], c["toxic"]
                everything, good, toxic = stacked
                removed = everything @ matrix["removed"]
                out = [everything @ matrix["kept"], removed, everything @ matrix["redundant"], everything @ matrix["unique_fails"], good @ matrix["removed"], toxic @ matrix["removed"], removed @ same]
                parts = pa.array([r["part"] for r in batch], pa.string()).take(pa.array(np.repeat(np.arange(len(batch)), len(letter))))
                columns = [parts, pa.array(np.tile(order, len(batch)), pa.string()), pa.array(np.tile(step, len(batch)))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(m.ravel()) for m in out)], ["part", "filter_order", "step", *MEASURES])

    return mapped(rows, run, schema)


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """What every order of the filters does at each of its steps, within each part."""
    counted = masks(docs, labels, part).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return audit(counted)


AUDIT_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, min(doc_id) over (partition by t) as first from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int
         + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > first, false)::int as mask
  from w left join l on w.doc_id = l.doc_id),
h as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by 1, 2),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as f(x, bit)),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier from o, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (
  select part, filter_order, step, bit,
         sum(case when mask & (earlier | bit) = 0 then n else 0 end) as kept, sum(case when mask & bit <> 0 and mask & earlier = 0 then n else 0 end) as removed,
         sum(case when mask & bit <> 0 and mask & earlier <> 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when mask & bit <> 0 and mask & earlier = 0 then good else 0 end) as good_lost, sum(case when mask & bit <> 0 and mask & earlier = 0 then toxic else 0 end) as toxic_lost
  from h, s group by 1, 2, 3, 4)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from r
"""
