"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a set of pivots.  It is
posted to the inverted files of its first ``posted`` pivots, with the first KEPT
of the order; a query probes the files of its nearest pivots.  In a file
candidates are ranked by the footrule distance of their orders to the query's,
and the best share is rescored by the inner product in double precision.

How many files a query probes and what share of each is rescored is measured,
not set: for a bounded sample of vectors (TUNED) the exact neighbours among all
rows are found by one scan, and each pair tells how many files its query must
probe to meet it, and how far down the ranking it stands among a bounded sample
of rows (COMPARED).  The cheapest probes and share that find TARGET of these
pairs are taken.  So recall holds at any size and for any spread of the vectors;
what follows the data is the work.  With all files probed and all rows rescored
the search is exact.

Inner products need no unit vectors: with one more coordinate, the root of the
largest squared norm less the vector's own (0 for a query), the nearest by angle
are the largest by inner product, and orders are taken in that space.

Files of a popular pivot are cut into blocks on both sides, so no task holds
one whole; pivots are a bounded sample (at most MOST_PIVOTS distinct vectors by
a hash of the id), every vector is indexed.

Defined cases: null and zero vectors, those of another length than most (of
equally frequent lengths the smallest), and those with null or non-finite
components take no part, as query or candidate; a null vec_id takes no part;
repeated rows of one id count once; equal scores go to the smaller vec_id; an
empty table gives no rows; other columns, long texts among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, mapped

POSTED, KEPT = 4, 128
MOST_PIVOTS, BLOCK_ROWS = 4096, 8192
#: Vectors whose exact neighbours are found, rows they are compared with, and the share of neighbours that must be met.
TUNED, COMPARED, TARGET = 160, 4096, 0.95
#: What a candidate's ranking costs beside its rescoring.
RANKING = 0.5


def usable(vectors: DataFrame) -> tuple[DataFrame, type]:
    """(vec_id, v binary, norm2), each id once, without vectors that take no part; and the number type of v.

    Vectors of floats stay floats, half the bytes to move; they are widened before any product.
    """
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if narrow else np.float64
    e = F.col("embedding") if narrow else F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long"), e.alias("e")).where("vec_id is not null and e is not null and size(e) > 0")
    kept = kept.where("forall(e, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(e, x -> x <> 0)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x, kind) for x in batch.column("e").to_pylist()]
            norms = [float((wide := x.astype(np.float64)) @ wide) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in rows], pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "v", "norm2"])

    return mapped(kept, run, "vec_id long, v binary, norm2 double").dropDuplicates(["vec_id"]), kind


def choose_pivots(vectors: DataFrame, n_rows: int, kind: type, seed: int = 7) -> np.ndarray:
    """Distinct vectors of the smallest id hashes, about twice the root of the table and MOST_PIVOTS at most."""
    n = min(MOST_PIVOTS, max(1, round(2 * n_rows**0.5)))
    sample = vectors.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(n).select("v").collect()
    return np.stack([np.frombuffer(r.v, kind) for r in sample]).astype(np.float64)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Unit vectors of one more coordinate, in which largest inner product is smallest angle."""
    rest = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], axis=1) / most**0.5


def order_type(n_pivots: int) -> type:
    return np.uint8 if n_pivots <= 256 else np.int16


def posted(vectors: DataFrame, kind: type, pivots: np.ndarray, most: float, first: int, query: bool) -> DataFrame:
    """(pivot, vec_id, v, seen): a row for each of the ``first`` pivots of every vector; seen is its order."""
    anchors, kept, small = lifted(pivots, most), min(KEPT, len(pivots)), order_type(len(pivots))
    given = vectors.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = given.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = np.frombuffer(b"".join(batch.column("v").to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.float64)
                order = orders(x, anchors, most, query)
                take = pa.array(np.repeat(np.arange(batch.num_rows), first))
                seen = [o.tobytes() for o in order[:, :kept].astype(small)]
                made = [pa.array(order[:, :first].ravel().astype(np.int32)), batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(seen, pa.binary()).take(take)]
                yield pa.RecordBatch.from_arrays(made, ["pivot", "vec_id", "v", "seen"])

    return mapped(vectors.select("vec_id", "v"), run, "pivot int, vec_id long, v binary, seen binary")


def nearest_in_block(queries: pd.DataFrame, data: pd.DataFrame, kind: type, n_pivots: int, k: int, reranked: float) -> pd.DataFrame:
    """The k best of ``data`` for each query, of those ranked first by footrule (2 * k at least)."""
    kept, small = min(KEPT, n_pivots), order_type(n_pivots)
    data = data.sort_values("vec_id", kind="stable")
    ids = data["vec_id"].to_numpy()
    x = np.frombuffer(b"".join(data["v"]), kind).reshape(len(data), -1).astype(np.float64)
    seen = np.frombuffer(b"".join(data["seen"]), small).reshape(len(data), kept)
    place = np.arange(kept, dtype=np.int16)
    take = min(len(data), max(2 * k, int(np.ceil(reranked * len(data)))))
    out: list[tuple] = []
    for query_id, v, order in zip(queries["vec_id"], queries["v"], queries["seen"], strict=True):
        if take < len(data):
            rank = np.full(n_pivots, kept, np.int16)
            rank[np.frombuffer(order, small)] = place
            footrule = np.abs(rank[seen] - place).sum(axis=1, dtype=np.int64)
            # Ties go by position, that is by vec_id.
            chosen = np.sort(np.argpartition(footrule * len(data) + np.arange(len(data)), take - 1)[:take])
        else:
            chosen = np.arange(len(data))
        chosen = chosen[ids[chosen] != query_id]
        score = (x[chosen] * np.frombuffer(v, kind).astype(np.float64)).sum(axis=1)
        best = np.lexsort((ids[chosen], -score))[:k]
        out += [(query_id, ids[chosen[i]], score[i]) for i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def orders(x: np.ndarray, anchors: np.ndarray, most: float, query: bool) -> np.ndarray:
    """The pivots of each vector, nearest first; of a query its own length plays no part."""
    near = (x / np.sqrt((x * x).sum(1))[:, None]) @ anchors[:, :-1].T if query else lifted(x, most) @ anchors.T
    return np.argsort(-near, axis=1, kind="stable")


def exact_neighbours(vectors: DataFrame, kind: type, asked: list, k: int) -> list:
    """Rows (n, v) of the k nearest of each of ``asked`` (vec_id, v), by one scan: a task keeps its k best of each."""
    spark = vectors.sparkSession
    given = spark.sparkContext.broadcast(([r.vec_id for r in asked], np.stack([np.frombuffer(r.v, kind) for r in asked]).astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = given.value
        best: list[list[tuple[float, int, bytes]]] = [[] for _ in own]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, raw = part.column("vec_id").to_pylist(), part.column("v").to_pylist()
                scores = queries @ np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64).T
                for n, row in enumerate(scores):
                    top = np.argsort(-row)[: k + 1]
                    met = best[n] + [(float(row[i]), -ids[i], raw[i]) for i in top if ids[i] != own[n]]
                    best[n] = sorted(met, reverse=True)[:k]
        rows = [(n, score, -less, v) for n, b in enumerate(best) for score, less, v in b]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.binary()))], ["n", "score", "vec_id", "v"])

    found = mapped(vectors.select("vec_id", "v"), run, "n int, score double, vec_id long, v binary")
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("n").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("n", "v").collect()  # TUNED times k at most


def tuned(vectors: DataFrame, kind: type, pivots: np.ndarray, most: float, n_posted: int, k: int, target: float) -> tuple[int, float]:
    """(files to probe, share to rescore) that meet ``target`` of the exact neighbours of a sample, at least cost."""
    draw = vectors.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id").limit(COMPARED).collect()
    asked, anchors, kept = draw[:TUNED], lifted(pivots, most), min(KEPT, len(pivots))
    array = lambda rows: np.stack([np.frombuffer(r.v, kind) for r in rows]).astype(np.float64)
    met = exact_neighbours(vectors, kind, asked, k)
    if not met:
        return len(pivots), 1.0
    seen, others, near = orders(array(asked), anchors, most, True), orders(array(draw), anchors, most, False), orders(array(met), anchors, most, False)
    needed, places = np.empty(len(met), np.int64), np.empty(len(met))
    for n in range(len(asked)):
        own = np.array([i for i, r in enumerate(met) if r.n == n], np.int64)
        if not len(own):
            continue
        rank = np.empty(len(pivots), np.int64)
        rank[seen[n]] = np.arange(len(pivots))
        needed[own] = rank[near[own, :n_posted]].min(axis=1) + 1
        footrule = lambda order: np.abs(np.minimum(rank[order[:, :kept]], kept) - np.arange(kept)).sum(axis=1)  # noqa: B023, E731
        # A file holds rows that share a pivot with the query: those of the sample that come to as few files, or the nearest.
        to, of = rank[others[:, :n_posted]].min(axis=1) + 1, footrule(others)
        few = np.sort(to)[min(len(to), 64) - 1]
        for i, f in zip(own, footrule(near[own]), strict=True):
            places[i] = (of[to <= max(needed[i], few)] <= f).mean()
    best = len(pivots), 1.0
    cost = float("inf")
    for probes in np.unique(np.quantile(needed, np.linspace(target, 1, 12), method="higher")):
        inside = np.sort(np.where(needed <= probes, places, 1.0))
        share = min(1.0, float(inside[min(len(inside) - 1, int(np.ceil(target * len(inside))))]) * 1.1 + 0.02)
        if probes * (RANKING + share) < cost:
            best, cost = (int(probes), share), probes * (RANKING + share)
    return best


def nearest(vectors: DataFrame, every: int, k: int, n_posted: int = POSTED, probes: int | None = None, reranked: float | None = None, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for vectors whose id is divisible by ``every`` their k nearest found.

    A vector stands in ``n_posted`` files; a query probes ``probes`` files and
    rescores the share ``reranked`` of each, both measured where they are not given.
    """
    spark = vectors.sparkSession
    given, kind = usable(vectors)
    given = cut(given)
    schema = "query_id long, rank int, vec_id long, score double"
    length = given.groupBy(F.octet_length("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if length is None:
        return spark.createDataFrame([], schema)
    held = given.where(F.octet_length("v") == length["length"])
    most = held.agg(F.max("norm2")).first()[0]
    pivots = choose_pivots(held, length["count"], kind)
    n_pivots = len(pivots)
    n_posted = min(n_posted, n_pivots)
    if probes is None or reranked is None:
        probes, reranked = tuned(held, kind, pivots, most, n_posted, k, target)
    probed = min(n_pivots, probes)
    data = posted(held, kind, pivots, most, n_posted, query=False)
    queries = posted(held.where(F.col("vec_id") % every == 0), kind, pivots, most, probed, query=True)
    # Sizes of the files on either side: one row a pivot, so at most MOST_PIVOTS.
    blocks = lambda df, name: df.groupBy("pivot").agg(F.expr(f"cast(ceil(count(*) / {BLOCK_ROWS}) as int)").alias(name))
    sizes = cut(blocks(data, "i_n").join(blocks(queries, "j_n"), "pivot"))
    of = lambda name: F.pmod(F.xxhash64("vec_id"), F.col(name)).cast("int")
    every_block = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    data = data.join(F.broadcast(sizes), "pivot").withColumn("i", of("i_n")).withColumn("j", every_block("j_n"))
    queries = queries.join(F.broadcast(sizes), "pivot").withColumn("j", of("j_n")).withColumn("i", every_block("i_n"))
    columns = ["pivot", "i", "j", "vec_id", "v", "seen"]
    left, right = queries.select(columns).groupBy("pivot", "i", "j"), data.select(columns).groupBy("pivot", "i", "j")
    found = left.cogroup(right).applyInPandas(
        lambda q, d: nearest_in_block(q, d, kind, n_pivots, k, reranked) if len(q) and len(d) else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")}),
        "query_id long, vec_id long, score double",
    )
    # A candidate met in several files has the same score in each.
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = distinct.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
