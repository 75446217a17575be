"""Comparing the members of buckets pair by pair, in blocks of bounded size, without emitting the pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .scratch import discard, is_empty, materialize


def compare_in_buckets(rows: DataFrame, key: str, member: str | list[str], compare, schema: str, block: int = 512, sizes: DataFrame | None = None) -> DataFrame:
    """Run compare on all members of each bucket, so that each pair of a bucket's members meets in exactly one call.

    rows has one row for each (bucket, member); member names a column or several. A bucket of more than `block` members is dealt into blocks by a hash
    of the member, and each two of its blocks meet in a task of their own: no task sees more than about two blocks of
    a bucket, whatever the bucket's size, and no member is left out. compare(table, own, first, last) gets sorted rows
    of many buckets: first and last hold each bucket task's row range, own the block of each row, or -1 where all
    pairs in the range count; pairs of one own block are skipped where the two blocks differ. It yields pyarrow tables.
    sizes (key, _n) has upper bounds for the members of the buckets that may have more than a block, if these are known.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")) if sizes is None else sizes
    many = materialize(sizes.filter(F.col("_n") > block), "buckets")
    if is_empty(many):
        discard(many)
        dealt = rows.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(0)).withColumn("_own", F.lit(-1))
    else:  # Spark broadcasts it where its measured size allows, and else splits the skewed join
        blocks = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")
        dealt = rows.join(many, key, "left").withColumn("_blocks", blocks)
        dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(*([member] if isinstance(member, str) else member)), F.col("_blocks")).cast("int"))
        dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        dealt = dealt.withColumn("_a", F.least("_own", "_other")).withColumn("_b", F.greatest("_own", "_other"))
        dealt = dealt.withColumn("_own", F.expr("if(_a = _b, -1, _own)")).drop("_n", "_blocks", "_other")
    # in the order of members too, so that a component's least row is the same member in most of its buckets, and links repeat
    dealt = dealt.repartition(key, "_a", "_b").sortWithinPartitions(key, "_a", "_b", *([member] if isinstance(member, str) else member))

    def run(batches):
        held = None
        for batch in _and_none(batches):
            t = held
            if batch is not None:
                b = pa.Table.from_batches([batch])
                t = b if held is None else pa.concat_tables([held, b])
            if t is None or not t.num_rows:
                continue
            ids = [t.column(c).to_numpy() for c in (key, "_a", "_b")]
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
            first = np.concatenate([[0], new])
            last = np.concatenate([new, [t.num_rows]])
            held = None
            if batch is not None:  # the last bucket may go on in the next batch
                held = t.slice(first[-1]).combine_chunks()
                first, last = first[:-1], last[:-1]
            full = last - first > 1
            if full.any():
                for out in compare(t, t.column("_own").to_numpy(), first[full], last[full]):
                    yield from out.to_batches()

    return map_arrow(dealt, run, schema)


def _and_none(batches):
    yield from batches
    yield None


def near_pairs(first: np.ndarray, last: np.ndarray, own: np.ndarray, most: int = 1 << 18):
    """Row index pairs (i, j), i < j, of all ranges, in portions of about `most`; ranges are [first, last)."""
    size = last - first
    big = size > 48
    for a, b in zip(first[big].tolist(), last[big].tolist(), strict=True):
        step = max(1, most // (b - a))
        for s in range(a, b, step):
            i = np.repeat(np.arange(s, min(b, s + step)), b - a)
            j = np.tile(np.arange(a, b), min(b, s + step) - s)
            keep = (i < j) & ((own[i] < 0) | (own[i] != own[j]))
            yield i[keep], j[keep]
    first, last = first[~big], last[~big]
    if not len(first):
        return
    rows = np.repeat(last, last - first)
    at = np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    shift = 1
    while len(at):
        ok = at + shift < rows
        at, rows = at[ok], rows[ok]
        for s in range(0, len(at), most):
            i = at[s : s + most]
            j = i + shift
            keep = (own[i] < 0) | (own[i] != own[j])
            yield i[keep], j[keep]
        shift += 1


def close_prints(keys: DataFrame, most_bits: int, block: int = 2048, sizes: DataFrame | None = None) -> DataFrame:
    """(a0, a1, b0, b1): links between 128-bit prints (key, w0, w1) of one bucket that join all pairs that differ in at most most_bits
    bits; of each compared block only a star for each of its components."""

    def compare(table, own, first, last):
        w0, w1 = (table.column(c).to_numpy().view(np.uint64) for c in ("w0", "w1"))
        for i, j in near_pairs(first, last, own):
            near = np.bitwise_count(w0[i] ^ w0[j]) + np.bitwise_count(w1[i] ^ w1[j]) <= most_bits
            if near.any():
                a, b = star_links(i[near], j[near])
                pair = np.unique(np.stack([w0[a], w1[a], w0[b], w1[b]], axis=1).view(np.int64), axis=0)
                yield pa.table({c: pair[:, k] for k, c in enumerate(("a0", "a1", "b0", "b1"))})

    return compare_in_buckets(keys, "key", ["w0", "w1"], compare, "a0 long, a1 long, b0 long, b1 long", block, sizes)


def thinned(links: DataFrame, portion: int = 500_000) -> DataFrame:
    """(a, b): links with the same components as links (a, b) of any orderable type. Each task takes about `portion` of them and gives a star for
    each of their components, so that what a group's buckets have found again and again is gone before any join."""
    tasks = max(1, -(-links.count() // portion))
    kind = links.schema["a"].dataType.simpleString()

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        both = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks().dictionary_encode()
        both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
        order = pc.sort_indices(both.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        place = rank[both.indices.to_numpy()]
        named = both.dictionary.take(pa.array(order))
        a, b = star_links(place[: table.num_rows], place[table.num_rows :])
        yield pa.RecordBatch.from_arrays([named.take(pa.array(a)), named.take(pa.array(b))], names=["a", "b"])

    kept = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    return map_arrow(kept.coalesce(tasks), run, f"a {kind}, b {kind}")


def star_links(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links i-j as a star for each of their components: every other node with the component's least node."""
    nodes, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = inverse[: len(i)], inverse[len(i) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]
