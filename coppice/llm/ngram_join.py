"""Exact self-join of documents on the Jaccard similarity of their word n-grams.

Candidates come from size-banded tiles.  Two sets with similarity t or more
differ in at most k elements, so if the hash range is cut into more than k
segments, some segment holds the same elements in both.  A band of sizes fixes
the number of segments, and a tile is (band, segment, elements of the segment):
every linked pair shares a tile.  A set posts its own band and, if a larger
partner can lie there, the next one; of its segments the first k + 1 + slack
are enough, k following from its own size.  Segments with very few elements
are common, so a set leaves them out unless it has more of them than the slack
allows for, which keeps the result exact.

Tiles with two sets or more are found by one exchange of packed postings (12
bytes each): a task sends, for every bucket of keys, one row of keys and sets.
Of sets that share a tile within one task only the first goes to the bucket;
the others are sent elsewhere, so no bucket grows with a group of near copies.

Inside a tile hashed bitmap signatures bound the overlap from above by a bit
count, and sorted arrays are intersected exactly for what is left.  A signature
is a bitmap of parities, so that each differing element changes one bit at most.
Tiles are settled in two steps: every member against one, then, between members
that are not yet connected, block by block; so a large group of near copies
costs a few comparisons a member, and no link between components is lost.

Defined cases: a null or wordless text has no elements, links with nothing and
is its own component; fewer words than the width make one element; equal sets
are one node of the join, whatever their doc_id, null included; rows that share
a doc_id stand for one document, but each of their texts is joined; a null
doc_id gets the smallest doc_id linked to it, or null; a text of any length is
taken whole; an empty table gives an empty result; other columns are ignored, or
kept by ``keep_first``, whatever their names.  Elements are 64-bit hashes and
nodes 64-bit hashes of sets; a wrong link needs a collision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, cut_in_round, mapped, release, slices, texts_of
from .words import Words, mix

#: Members of a block, postings a task gathers before it sends them, and postings of a bucket on average.
BLOCK, GATHERED, BUCKET = 256, 1 << 19, 1 << 17
LEAST_BUCKETS = 1024
_KEY = np.uint64(0x9FB21C651E98DF25)


class Bands:
    """Sizes cut into bands, and the segments each band uses, for a similarity of percent / 100."""

    def __init__(self, percent: int):
        t = percent / 100
        self.percent, ratio = percent, max(1.5, 1.05 / t)
        self.edges, self.segments, self.slack, self.weak = [1], [], [], []
        while self.edges[-1] < 1 << 40:
            low = self.edges[-1]
            high = max(low + 1, math.ceil(low / t), int(low * ratio))
            need = self.most(2 * (high - 1)) + 1
            self.edges.append(high)
            for weak in (3, 2, 1, 0):
                slack = 2
                for _ in range(20):
                    mean = low / (need + slack)
                    few = sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(weak + 1))
                    slack = 2 + math.ceil(1.2 * few * (need + slack))
                    if slack > 0.35 * need + 4:
                        break
                else:
                    break
            self.segments.append(need + slack)
            self.slack.append(slack)
            self.weak.append(weak)

    def most(self, total: int) -> int:
        """Elements in which two linked sets of ``total`` elements together may differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def keys(self, elements: np.ndarray) -> np.ndarray:
        """The tiles of a sorted set."""
        n = len(elements)
        own = int(np.searchsorted(self.edges, n, side="right")) - 1
        bands = [own] + [own + 1] * (n * 100 >= self.edges[own + 1] * self.percent)
        mixed = mix(elements)
        out = []
        for band in bands:
            slack, weak = self.slack[band], self.weak[band]
            posted = min((100 - self.percent) * n // self.percent + 1 + slack, self.segments[band])
            segment = ((elements >> np.uint64(32)) * np.uint64(self.segments[band])) >> np.uint64(32)
            used = int(np.searchsorted(segment, posted))
            sums, counts = np.zeros(posted, np.uint64), np.zeros(posted, np.int64)
            if used:
                begin = np.flatnonzero(np.concatenate([[True], segment[1:used] != segment[: used - 1]]))
                at = segment[begin].astype(np.int64)
                sums[at] = np.add.reduceat(mixed[:used], begin)
                counts[at] = np.diff(np.concatenate([begin, [used]]))
            strong = counts > weak
            if posted - strong.sum() > slack:
                strong[:] = True
            with np.errstate(over="ignore"):
                place = np.arange(posted, dtype=np.uint64) * _KEY + np.uint64(band + 1)
                out.append(mix(sums + mix(place))[strong])
        return np.concatenate(out)


def node_of(elements: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(elements).sum() + np.uint64(len(elements)) * _KEY], np.uint64)).view(np.int64)[0])


def signature(elements: np.ndarray) -> bytes:
    """A bitmap of parities of the elements' low bits, two bits an element or more, a power of two."""
    bits = 1 << min(16, max(7, (2 * len(elements) - 1).bit_length()))
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of uint64, all folded to the shortest length."""
    size = min(map(len, signatures)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size), axis=0) for s in signatures])


def may_link(total: np.ndarray, differing_bits: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bound on the overlap, (total - differing bits) / 2, still allows a link."""
    return (total - differing_bits) * (100 + percent) >= 2 * percent * total


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def row_key() -> Column:
    """What tells a row from others: rows that share it have the same doc_id and text."""
    return F.xxhash64(F.lit(17), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    for batch in slices(batches, "text"):
        yield batch, Words(texts_of(batch.column("text")), lower=True).shingle_sets(width)


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """(row_key, doc_id, n_shingles, node, held) a row; held is the signature, and both are null for an empty set."""

    def run(batches):
        for batch, sets in _sets(batches, width):
            made = [
                batch.column("row_key"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(made, ["row_key", "doc_id", "n_shingles", "node", "held"])

    given = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(given, run, "row_key long, doc_id long, n_shingles long, node long, held binary")


def packed_postings(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """(part, bucket, keys, nodes, centres): tiles of a bucket and the sets that post them, many a row.

    Within one row no tile occurs twice: further sets of a tile go, with the
    first one as their centre, into rows of their own whose part is any, and
    the first one is marked in the bucket's row by itself as its centre.
    """
    shift, mask = np.uint64(64 - buckets.bit_length() + 1), np.uint64(0xFFFFFFFF)

    def rows_of(keys: np.ndarray, nodes: np.ndarray) -> Iterator[tuple]:
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = np.cumsum(first) - 1
        centre = nodes[first][group]
        new = first.copy()
        new[1:] |= nodes[1:] != nodes[:-1]  # one posting of a set a tile
        several = np.bincount(group, weights=new) > 1
        bucket, low = (keys >> shift).astype(np.int64), (keys & mask).astype(np.uint32)
        for main, chosen in ((True, first), (False, new & ~first)):
            at = np.flatnonzero(chosen)
            for part in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1) if len(at) else ():
                b = int(bucket[part[0]])
                held = several[group[part]].tobytes() if main else centre[part].tobytes()
                yield (b if main else (b * 2654435761 + int(low[part[0]])) % buckets, b if main else -1 - b, low[part].tobytes(), nodes[part].tobytes(), held)

    def run(batches):
        bands = Bands(percent)
        keys, nodes, held = [], [], 0

        def flush() -> pa.RecordBatch:
            out = list(rows_of(np.concatenate(keys), np.concatenate(nodes)))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names)

        for _, sets in _sets(batches, width):
            for node, s in {node_of(s): s for s in sets if len(s)}.items():
                keys.append(bands.keys(s))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
                held += len(keys[-1])
            if held >= GATHERED:
                yield flush()
                keys, nodes, held = [], [], 0
        if held:
            yield flush()

    names = ["part", "bucket", "keys", "nodes", "held"]
    return mapped(docs.select(F.col("text").cast("string").alias("text")), run, "part long, bucket long, keys binary, nodes binary, held binary")


def tile_members(postings: DataFrame) -> DataFrame:
    """(key, node, centre) of the tiles that two sets or more post, from packed postings."""

    def settle(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
        nodes = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows])
        several = np.concatenate([np.frombuffer(r[4], bool) for r in rows])
        order = np.lexsort((nodes, keys))
        keys, nodes, several = keys[order], nodes[order], several[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        begin = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        last = np.concatenate([begin[1:], [len(keys)]]) - 1
        shared = (nodes[begin] != nodes[last]) | np.logical_or.reduceat(several, begin)
        new = shared[group]
        new[1:] &= first[1:] | (nodes[1:] != nodes[:-1])
        yield batch_of(bucket, keys[new], nodes[new], nodes[begin][group][new])

    def batch_of(bucket: int, keys: np.ndarray, nodes: np.ndarray, centres: np.ndarray) -> pa.RecordBatch:
        whole = (np.int64(bucket) << np.int64(32)) | keys.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(whole), pa.array(nodes), pa.array(centres)], ["key", "node", "centre"])

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if row[1] < 0:  # further sets of a task's tiles: certainly shared
                    yield batch_of(-1 - row[1], np.frombuffer(row[2], np.uint32), np.frombuffer(row[3], np.int64), np.frombuffer(row[4], np.int64))
                    continue
                if rows and rows[0][1] != row[1]:
                    yield from settle(rows[0][1], rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from settle(rows[0][1], rows)

    dealt = postings.repartition("part").sortWithinPartitions("bucket")
    return mapped(dealt, run, "key long, node long, centre long")


#: A Bloom filter has at most this many 64-bit words, so what it broadcasts is bounded (16 MB).
FILTER_WORDS = 1 << 20


def likely(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is in ``ids`` (one row an id, written before), and a few others.

    A Bloom filter of bounded size, built and probed by Spark, so the other rows
    are not worked on; once it is full it lets more rows pass.
    """
    words = 1 << min(FILTER_WORDS.bit_length() - 1, max(8, (ids.count() // 4).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(words * 64)).alias("p")
    bits = ids.select(place).groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    held = rows.select("*", place)
    held = held.join(F.broadcast(bits), F.expr("p div 64 = word")).where("shiftright(bits, cast(p % 64 as int)) & 1 = 1")
    return held.drop("p", "word", "bits")


def element_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, n, held) for ``wanted`` (node, row_key of one row that has the set); held is its sorted elements."""

    def run(batches):
        for batch, sets in _sets(batches, width):
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            held = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), nodes, pa.array([len(s) for s in sets], pa.int64()), held], ["row_key", "node", "n", "held"])

    some = likely(docs.select(row_key().alias("row_key"), F.col("text").cast("string").alias("text")), wanted.select("row_key"), "row_key")
    found = mapped(some, run, "row_key long, node long, n long, held binary").alias("f")
    # Both steps are by node, so the sets move once.
    right = wanted.select(F.col("node").alias("of"), F.col("row_key").alias("from"))
    exact = found.join(right, F.col("node") == F.col("of")).where("row_key = `from`")
    return exact.groupBy("node").agg(F.first("n").alias("n"), F.first("held").alias("held"))


def end_of(sets: DataFrame, x: str) -> DataFrame:
    return sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("held").alias(f"h{x}"))


def bounded(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that sizes and bit counts still allow to link."""

    def bound(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            bits = [int(np.bitwise_count(np.bitwise_xor(*folded(list(s)))).sum()) for s in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist())]
            ok = may_link(na + nb, np.array(bits, np.int64), percent) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    near = pairs.join(end_of(signatures, "a"), "a").join(end_of(signatures, "b"), "b")
    return cut(mapped(near.select("a", "b", "na", "nb", "ha", "hb"), bound, "a long, b long"))


def verified(near: DataFrame, docs: DataFrame, signatures: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, by exact intersection, of ``near``, those that passed the bound.

    Sets are made again from the texts of the few documents that have such a pair.
    """

    def exact(batches):
        for batch in slices(batches, "ha"):
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    needed = cut(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(signatures.select("node", "row_key"), "node"))
    sets = element_sets(docs, needed, width)
    full = near.join(end_of(sets, "a"), "a").join(end_of(sets, "b"), "b")
    return mapped(full.select("a", "b", "ha", "hb"), exact, "a long, b long")


def compare_blocks(rows: DataFrame, percent: int, best: int) -> DataFrame:
    """For every node its ``best`` nearest candidates of another label in each block pair.

    ``rows`` has key, bi, bj, node, label, second (whether the node is of block
    bj), n, signature; a block pair holds about 2 * BLOCK rows.  The result has
    a, b, and more: the tile, where the node had more candidates, else null.
    """
    names = ["key", "bi", "bj", "node", "label", "second", "n", "signature"]

    def pairs_of(group: list[tuple]) -> Iterator[tuple[int, int, int | None]]:
        node, label, second, n = (np.array([g[i] for g in group], np.int64) for i in (3, 4, 5, 6))
        if (label == label[0]).all():
            return
        bits = folded([g[7] for g in group])
        across = group[0][1] != group[0][2]
        for i in range(len(group)):
            ok = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            rest = np.flatnonzero(ok & (second != second[i])) if across else np.flatnonzero(ok)
            if not len(rest):
                continue
            differing = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
            able = may_link(n[rest] + n[i], differing, percent)
            rest, differing = rest[able], differing[able]
            more = group[0][0] if len(rest) > best else None
            if more is not None:
                rest = rest[np.lexsort((node[rest], differing))[:best]]
            for j in rest:
                yield min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j])), more

    def run(batches):
        group: list[tuple] = []
        found: set[tuple[int, int, int | None]] = set()

        def flush() -> pa.RecordBatch:
            out = list(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(3)], ["a", "b", "more"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if group and group[0][:3] != row[:3]:
                    found.update(pairs_of(group))
                    group = []
                    if len(found) >= 50_000:
                        yield flush()
                group.append(row)
        if group:
            found.update(pairs_of(group))
        yield flush()

    dealt = rows.select(names).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return mapped(dealt, run, "a long, b long, more long")


def open_blocks(members: DataFrame, labels: DataFrame, signatures: DataFrame) -> DataFrame:
    """Tiles whose members carry several labels, cut into pairs of blocks; equal tiles once.

    Members of the smallest label, in a large group nearly all, need no
    comparison among themselves: their blocks come last, and meet only those of
    the other members, which meet every block.
    """
    marked = members.select("key", "node").join(labels, "node")
    by_label = marked.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("content"))
    tiles = by_label.groupBy("key").agg(F.sum("n").alias("size"), F.sum("content").alias("content"), F.min(F.struct("label", "n")).alias("low"), F.max("label").alias("high")).where("low.label < high")
    tiles = tiles.groupBy("size", "content").agg(F.min(F.struct("key", "low")).alias("t"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    tiles = tiles.select("t.key", "t.low.label", blocks(F.col("size") - F.col("t.low.n")).alias("others"), blocks(F.col("t.low.n")).alias("lows")).withColumnRenamed("label", "low")
    rows = marked.join(tiles, "key").join(signatures.select("node", "n", F.col("held").alias("signature")), "node")
    is_low, hashed = F.col("label") == F.col("low"), F.xxhash64("node")
    rows = rows.withColumn("block", F.when(is_low, F.col("others") + F.pmod(hashed, F.col("lows"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_low, F.col("others")).otherwise(F.col("others") + F.col("lows")) - 1)))
    return rows.select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "node", "label", (F.col("block") > F.col("other")).cast("int").alias("second"), "n", "signature")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after joining the components that ``links`` (a, b) connect."""
    of = lambda end, name: labels.select(F.col("node").alias(end), F.col("label").alias(name))
    between = cut(links.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y").where("x <> y").distinct())
    if between.isEmpty():
        return labels
    new = components(between, "x", "y").select(F.col("id").alias("label"), F.col("label").alias("new"))
    return cut_in_round(labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")))


def linked_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(row_key, doc_id, n_shingles, label) for every row; equal labels are one component, null is an empty set."""
    rows = cut(set_rows(docs, width))
    shingles = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (shingles // (2 * BUCKET)).bit_length())
    members = cut(tile_members(packed_postings(docs, width, percent, buckets)))
    release(docs.sparkSession)
    used = members.select("node").distinct()
    each = rows.where("node is not null").groupBy("node").agg(F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n"), F.first("held").alias("held"))
    signatures = cut(each.join(used, "node", "left_semi"))
    labels = signatures.select("node", F.col("node").alias("label"))
    links = lambda near: cut(verified(near, docs, signatures, width, percent))

    # First every node against one centre, that with which it shares most tiles: this alone settles tight groups.
    stars = members.where("centre <> node").groupBy("node", "centre").count()
    stars = stars.groupBy("node").agg(F.max(F.struct("count", "centre")).alias("s")).select(F.least("node", "s.centre").alias("a"), F.greatest("node", "s.centre").alias("b")).distinct()
    tried = cut(stars)
    labels = merged(labels, links(bounded(tried, signatures, percent)))
    del stars
    release(docs.sparkSession)
    # Then, between components only, every node against its nearest candidates in each tile: the first round
    # joins what can be joined, and the later ones, with ever more candidates, see the tiles where some were left out.
    best = 1
    while True:
        found = cut(compare_blocks(open_blocks(members, labels, signatures), percent, best))
        new = cut(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        if not new.isEmpty():  # what comparing blocks found is within the bound already
            labels = merged(labels, links(new))
        left_out = cut(found.select(F.col("more").alias("key")).where("key is not null").distinct())
        if left_out.isEmpty():
            break
        members = cut(members.join(left_out, "key", "left_semi"))
        tried = cut(tried.union(new))
        del found, new, left_out
        release(docs.sparkSession)
        best *= 4
    rows = rows.drop("held")
    done = rows.where("node is not null").join(labels, "node", "left").select("row_key", "doc_id", "n_shingles", F.coalesce("label", "node").alias("label"))
    return done.union(rows.where("node is null").select("row_key", "doc_id", "n_shingles", F.col("node").alias("label")))


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    rows = cut(linked_rows(docs, width, percent))
    # Rows that share a doc_id are one document, so their components are one.
    several = rows.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
    if not several.isEmpty():
        pairs = rows.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("label").alias("b")).where("a <> b").distinct()
        joined = components(pairs).select(F.col("id").alias("label"), F.col("label").alias("joined"))
        rows = cut(rows.join(joined, "label", "left").withColumn("label", F.coalesce("joined", "label")).drop("joined"))
    linked_to = rows.where("label is not null")
    # Written, so that the join may split the rows of a large component.
    smallest = cut(linked_to.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    done = linked_to.join(smallest, "label").select("doc_id", "n_shingles", "component_id")
    return done.union(rows.where("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of each component one row, with its own columns: that of the smallest doc_id, rows without one last.

    Rows that share a doc_id are judged by their texts, each by itself; of rows
    equal in doc_id and text one stays.  Empty sets are no copies of anything.
    """
    name = "row_key"
    while name in docs.columns:
        name += "_"
    rows = cut(linked_rows(docs, width, percent))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    first = cut(rows.where("label is not null").groupBy("label").agg(F.min(place).alias("first")).select("label", F.col("first.row_key").alias("kept")))
    drop = rows.join(first, "label").where("row_key <> kept").select(F.col("row_key").alias(name)).distinct()
    keyed = docs.withColumn(name, row_key())
    kept = keyed.join(drop, name, "left_anti")
    repeated = cut(rows.where("label is not null").groupBy("row_key").count().where("count > 1").select(F.col("row_key").alias(name)))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    single = kept.join(repeated, name, "left_anti")
    return single.unionByName(kept.join(repeated, name, "left_semi").dropDuplicates([name])).select(docs.columns)


#: The same components in SQL, by counting common shingles and following links; for small tables.
NGRAM_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as l from documents),
s as (
  select distinct doc_id, unnest(case when len(l) = 0 then []::varchar[] when len(l) < {width} then [array_to_string(l, ' ')]
    else list_transform(range(1, len(l) - {width} + 2), lambda i: array_to_string(l[i : i + {width} - 1], ' ')) end) as shingle
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)),
both_ways as (select a, b from e union all select b, a from e),
reach as (select a, b from both_ways union select r.a, o.b from reach r join both_ways o on r.b = o.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id))::bigint as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select a, min(b) as b from reach group by a) m on m.a = d.doc_id
"""
