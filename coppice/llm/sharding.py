"""A uniform random shuffle into shards of exactly equal size.

Rows lie in logical partitions given by a hash of the document, so the result
does not depend on files or tasks.  A matrix of partition-to-shard counts is
drawn from the multivariate hypergeometric law with the shards' exact sizes as
margins; each partition permutes its rows by a hash and deals them out by its
row of the matrix; each shard permutes what it got by a second hash.

The matrix is drawn in two levels: the driver draws counts for groups of
partitions, a task for each group those of its partitions.  The law is the same,
and both groups and partitions a group grow as the square root of the table, so
a partition holds about PARTITION_ROWS rows at any size.

Defined cases: a null text has no bytes, so size 8 and the checksum of nothing;
a null doc_id is hashed as such; repeated rows are dealt each; ties of the hash
go by doc_id and checksum; a text of any length only counts by size and checksum;
an empty table gives no rows; equal texts are separate rows, as this law keeps
no groups together; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import with_running_total
from .shared import broadcast_if_small, cut

SHARDS, PARTITION_ROWS, SEED = 24, 4096, 20_250_101
#: Weights further than this many standard deviations (and 50) from the mean are below 1e-30 of the law.
REACH = 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of ``n`` draws from good + bad the good ones, by inversion, for populations of any size.

    Neighbouring probabilities have a simple ratio, so all that matter follow
    from one by products; only their sum is needed to draw.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    mean = n * good / total
    spread = (mean * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5
    low, high = max(low, int(mean - REACH * spread) - 50), min(high, int(mean + REACH * spread) + 50)
    k = np.arange(low, high, dtype=np.float64)
    ratios = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def communication_matrix(counts: list[int], room: list[int], rng: np.random.Generator) -> np.ndarray:
    """matrix[partition, shard] with row sums ``counts`` and column sums ``room``, whose totals are equal."""
    room = list(room)
    matrix = np.zeros((len(counts), len(room)), np.int64)
    for p, n in enumerate(counts):
        left = sum(room)
        for s, here in enumerate(room):
            left -= here
            matrix[p, s] = hypergeometric(rng, here, left, n) if n else 0
            n -= int(matrix[p, s])
        room = [r - int(x) for r, x in zip(room, matrix[p], strict=True)]
    return matrix


def dealt_ends(counted: DataFrame, n_parts: int, n_shards: int, seed: int) -> DataFrame:
    """(part, ends): how many of a partition's rows go to the first shard, the first two, and so on.

    ``counted`` has part and n, the rows of each partition that has any.
    """
    per_group = 1 << (n_parts.bit_length() - 1) // 2
    groups = counted.withColumn("group", F.expr(f"part div {per_group}"))
    sizes = dict(map(tuple, groups.groupBy("group").agg(F.sum("n")).collect()))  # about the square root of the partitions
    total, order = sum(sizes.values()), sorted(sizes)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    upper = communication_matrix([sizes[g] for g in order], room, np.random.default_rng(seed))
    rows_of = {g: r for g, r in zip(order, upper.tolist(), strict=True)}

    def lower(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        rng = np.random.default_rng([seed, int(key[0])])
        matrix = communication_matrix(pdf["n"].tolist(), rows_of[key[0]], rng)
        return pd.DataFrame({"part": pdf["part"].to_numpy(), "ends": list(np.cumsum(matrix, axis=1))})

    return groups.groupBy("group").applyInPandas(lower, "part long, ends array<long>")


def sharded(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    rows = cut(rows)
    n_rows = rows.count()
    n_parts = 1 << max(4, (n_rows // PARTITION_ROWS).bit_length())
    key = lambda step: F.md5(F.concat_ws(":", F.lit(f"{seed}:{step}"), "doc_id", "text_crc32").cast("binary"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), F.lit(n_parts)))
    ends = cut(dealt_ends(rows.groupBy("part").agg(F.count("*").alias("n")), n_parts, n_shards, seed))
    local = W.partitionBy("part").orderBy(key("deal"), "doc_id", "text_crc32")
    dealt = rows.withColumn("rank", F.row_number().over(local)).join(broadcast_if_small(ends), "part")
    dealt = dealt.withColumn("shard", F.expr("size(filter(ends, e -> e < rank))").cast("int"))
    dealt = cut(dealt.select("doc_id", "size", "text_crc32", "shard", key("permute").alias("key"), F.lit(1).cast("long").alias("one")))
    placed = with_running_total(dealt, "shard", ["key", "doc_id", "text_crc32"], "one", n_rows, "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
