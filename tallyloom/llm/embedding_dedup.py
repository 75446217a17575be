"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe and verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .blocks import compare_in_buckets, near_pairs, star_links, thinned
from .components import connected_components
from .scratch import is_empty, materialize, tidy


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; its length is a power of two."""
    x = x.copy()
    n, d = x.shape
    step = 1
    while step < d:
        v = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x


def polytope_codes(x: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, probes) bucket codes. A table joins two cross-polytope hashes, each the signed axis nearest to the
    vector after three rounds of random signs and Hadamard transforms; the probes after the first replace either hash
    by its second nearest axis, the smaller loss first."""
    d = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 2, 3, d))
    rows = np.arange(len(x))
    out = np.empty((len(x), tables, probes), dtype=np.int64)
    for t in range(tables):
        best, loss = [], []
        for h in range(2):
            y = x
            for r in range(3):
                y = hadamard(y * signs[t, h, r]) / np.sqrt(d)
            a = np.abs(y)
            first = a.argmax(1)
            top = a[rows, first]
            a[rows, first] = -1
            second = a.argmax(1)
            loss.append(top - a[rows, second])
            best.append([2 * k + (y[rows, k] < 0) for k in (first, second)])
        pair = lambda p, q: best[0][p] * (2 * d) + best[1][q]
        other = loss[0] <= loss[1]
        choices = [pair(0, 0), np.where(other, pair(1, 0), pair(0, 1)), np.where(other, pair(0, 1), pair(1, 0)), pair(1, 1)]
        for p in range(probes):
            out[:, t, p] = choices[p] + t * (4 * d * d)
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in steps of a 127th of their largest component, as int8, and a bound for how far the rounded row lies from its own."""
    step = np.abs(x).max(axis=1) / 127
    return np.rint(x / step[:, None]).astype(np.int8), 0.5 * step * np.sqrt(x.shape[1])


def _by_width(column: pa.Array):
    """(rows, matrix) for each length of the vectors of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = column.value_lengths().to_numpy()
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield rows, _matrix(column.take(pa.array(rows)), width)


def with_codes(vectors: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """(at, w, q, step, codes) of vectors (at, embedding): the length, the rounded vector with its step, and the bucket codes."""

    def index(batches):
        for batch in batches:
            n = batch.num_rows
            width, step, codes, q = np.zeros(n, dtype=np.int32), np.zeros(n), np.zeros((n, tables * probes), dtype=np.int64), [b""] * n
            for rows, x in _by_width(batch.column("embedding")):
                x = _unit(x)
                width[rows], step[rows] = x.shape[1], np.abs(x).max(axis=1) / 127
                codes[rows] = polytope_codes(x, tables, probes, seed).reshape(len(x), -1)
                for row, y in zip(rows.tolist(), rounded(x)[0], strict=True):
                    q[row] = y.tobytes()
            lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * tables * probes, tables * probes, dtype=np.int32), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(width), pa.array(q, pa.binary()), pa.array(step), lists], names=["at", "w", "q", "step", "codes"])

    return map_arrow(vectors.select("at", "embedding"), index, "at long, w int, q binary, step double, codes array<long>")


def near_candidates(coded: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): links that join all pairs of one bucket whose cosine may reach the threshold, as far as the rounded vectors tell: no
    pair that reaches it is left out. Of each compared block a star for each of its components."""

    def compare(table, own, first, last):
        at, step, q = table.column("at").to_numpy(), table.column("step").to_numpy(), table.column("q").combine_chunks()
        widths = pc.binary_length(q).to_numpy()
        for width in np.unique(widths[first]).tolist():
            mine = widths[first] == width
            rows = np.flatnonzero(widths == width)
            place = np.zeros(len(widths), dtype=np.int64)
            place[rows] = np.arange(len(rows))
            x = np.frombuffer(b"".join(q.take(pa.array(rows)).to_pylist()), dtype=np.int8).reshape(-1, width) * step[rows, None].astype(np.float32)
            slack = 0.5 * step * np.sqrt(width)
            for i, j in near_pairs(first[mine], last[mine], own, 1 << 16):
                # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, unit vectors being at most `slack` longer when rounded
                off = slack[i] + slack[j] + slack[i] * slack[j] + 1e-5
                near = np.einsum("ij,ij->i", x[place[i]], x[place[j]]) >= threshold - off
                if near.any():
                    a, b = star_links(i[near], j[near])
                    yield pa.table({"a": at[a], "b": at[b]})

    key = F.shiftleft(F.col("w").cast("long"), 40).bitwiseOR(F.col("code")).alias("key")
    keyed = coded.select("at", "w", "q", "step", F.explode(F.array_distinct("codes")).alias("code")).select(key, "at", "q", "step")
    sizes = coded.select("w", F.explode(F.array_distinct("codes")).alias("code")).groupBy(key).agg(F.count("*").alias("_n"))
    return compare_in_buckets(keyed, "key", "at", compare, "a long, b long", block, sizes)


def verified_pairs(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(kind, a, b, n) over members (component, at, copies, embedding) of one length in each component: kind 0 tells that a has n links, counted by
    the copies of the other end, kind 1 links a and b, a star for each component of a block's links. All pairs of a component are
    compared in double precision, each once."""
    tile = 512

    def compare(table, own, first, last):
        at, copies = table.column("at").to_numpy(), table.column("copies").to_numpy()
        vectors = table.column("embedding").combine_chunks()
        offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
        for f, e in zip(first.tolist(), last.tolist(), strict=True):
            x = _unit(flat[offsets[f] : offsets[e]].reshape(e - f, -1))
            block_of, n, pairs = own[f:e], np.zeros(e - f, dtype=np.int64), []
            for p in range(0, e - f, tile):
                for q in range(p, e - f, tile):
                    near = x[p : p + tile] @ x[q : q + tile].T >= threshold
                    a, b = block_of[p : p + tile, None], block_of[None, q : q + tile]
                    near &= (a < 0) | (a != b)
                    if p == q:
                        near = np.triu(near, 1)
                    i, j = np.nonzero(near)
                    if len(i):
                        i, j = i + p, j + q
                        n += np.bincount(i, copies[f + j], e - f).astype(np.int64) + np.bincount(j, copies[f + i], e - f).astype(np.int64)
                        pairs.append(star_links(i, j))
            if pairs:
                a, b = star_links(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
                yield pa.table({"kind": np.ones(len(a), dtype=np.int32), "a": at[f + a], "b": at[f + b], "n": np.zeros(len(a), dtype=np.int64)})
                some = np.flatnonzero(n)
                yield pa.table({"kind": np.zeros(len(some), dtype=np.int32), "a": at[f + some], "b": at[f + some], "n": n[some]})

    return compare_in_buckets(members, "component", "at", compare, "kind int, a long, b long, n long", block)


@tidy
def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", threshold: float = 0.9, tables: int = 8, probes: int = 3, seed: int = 7, block: int = 512) -> DataFrame:
    """One row for each row of vectors: id_col, n_links, component_id, kept.

    Two vectors are linked where the cosine in double precision reaches the threshold. Candidates share a cross-polytope bucket and
    may reach the threshold by their components rounded to a byte each; the components of these links are compared pair by
    pair, so whole vectors travel only where they have a candidate, and once. Vectors that are null, empty,
    zero, or hold nulls or non-finite components link with nothing; vectors of unlike lengths are never compared.
    Equal vectors are compared once and counted as often as they occur, rows that repeat an id included. component_id
    is the smallest id reachable, kept tells whether it is the row's own. Null ids come after all others and are
    never a component's id unless it has no other. Other columns are ignored.
    """
    v = F.col(embedding_col)
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("embedding"))
    good = F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.withColumn("good", F.coalesce(good & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    # 128 bits stand for a vector, so that only its first copy moves
    some = rows.filter("good").select("id", F.xxhash64("embedding").alias("h0"), F.xxhash64(F.lit(1), "embedding").alias("h1"), "embedding")
    same = some.groupBy("h0", "h1").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    # a name of its own for each distinct vector: ids may be null or repeat between vectors
    names = materialize(same.withColumn("at", F.monotonically_increasing_id()), "vectors")
    coded = materialize(with_codes(names, tables, probes, seed), "codes")
    near = materialize(near_candidates(coded, threshold, block), "candidates")
    members = connected_components(thinned(near), "a", "b").select(F.col("node").alias("at"), "component")
    members = materialize(members, "members")
    if is_empty(members):
        found, links = None, None
    else:
        found = materialize(verified_pairs(members.join(names.select("at", "copies", "embedding"), "at"), threshold, block), "vectorlinks")
        links = found.filter("kind = 1")
    named = names.select("at", "id", "copies", "h0", "h1")
    if links is None or is_empty(links):
        placed = named.select("h0", "h1", (F.col("copies") - 1).alias("n_links"), F.col("id").alias("component_id"))
    else:
        counts = found.filter("kind = 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "at")
        roots = connected_components(thinned(links), "a", "b")
        placed = named.join(roots.withColumnRenamed("node", "at"), "at", "left").withColumn("root", F.coalesce("component", "at"))
        placed = materialize(placed, "placed")
        placed = placed.join(placed.groupBy("root").agg(F.min("id").alias("component_id")), "root").join(counts, "at", "left")
        placed = placed.select("h0", "h1", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    placed = materialize(placed, "groups", keep=True)
    linked = some.select("id", "h0", "h1").join(placed, ["h0", "h1"]).select("id", "n_links", "component_id")
    alone = rows.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
