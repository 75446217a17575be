"""SimHash near-duplicates: fingerprints of word shingles, linked by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit in one of their 32-bit halves. Each segment is
indexed under its variants with one bit left out, so such segments share a variant; equal variants are joined and the whole
fingerprints verified. For near copies by the similarity of shingle sets, wider fingerprints in more segments propose and the sets verify; what they miss is
found by shingles that similar sets must share.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship
from .blocks import close_prints, compare_in_buckets, near_pairs, star_links, thinned
from .components import connected_components
from .scratch import is_empty, materialize, temporary, tidy

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = 3, seed: int = 42, portion: int = 1 << 16) -> int:
    """The 64-bit fingerprint of a text's shingles, repeats included; 0 without words."""
    tokens = (text or "").encode().translate(_LOWER).split()  # bytes.split() cuts at x20 and x09 to x0D
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n], ends[min(words, len(tokens)) - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, portion):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + portion].tolist(), ends[k : k + portion].tolist(), strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64).reshape(64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """Column fp: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    ship(docs.sparkSession)
    return docs.withColumn("fp", fp(F.col(text_col)))


def segments(most_bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the segments, the fewest of which one differs by one bit at most."""
    m = most_bits // 2 + 1
    widths = [64 // m + (k < 64 % m) for k in range(m)]
    if widths[0] > 32:
        raise ValueError("two or more bits are needed for segments of 32 bits at most")
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def link_fingerprints(prints: DataFrame, most_bits: int = 3, block: int = 2048) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all pairs with at most most_bits differing bits.

    Every pair of that distance is compared, but of each compared block only a star for each of its components is
    returned, so the links stay in proportion to the fingerprints however many lie close together. How many
    fingerprints share a variant is bounded by how many share the two segments that it stands for, so that only two
    or three rows for each fingerprint are counted.
    """
    parts = [F.struct(F.lit(k).alias("s"), F.lit(w).alias("w"), F.shiftrightunsigned("fp", o).bitwiseAND((1 << w) - 1).alias("v")) for k, (o, w) in enumerate(segments(most_bits))]
    cut = prints.select("fp", F.explode(F.array(*parts)).alias("x")).select("fp", "x.s", "x.w", "x.v")
    # segment, place of the wildcard, and the segment with that bit cleared
    places = F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("p")
    key = ((F.col("s") * 32 + F.col("p")).cast("long") * (1 << 32) + F.expr("v & ~shiftleft(1L, p)")).alias("key")
    keys = cut.select("fp", "s", "v", places).select(key, "fp")
    crowded = cut.groupBy("s", "w", "v").agg(F.count("*").alias("n")).filter(F.col("n") > block // 2)
    sizes = crowded.select("s", "v", "n", places).groupBy(key).agg((F.sum("n") + block // 2).alias("_n"))

    def compare(table, own, first, last):
        fp = table.column("fp").to_numpy()
        bits = fp.view(np.uint64)
        for i, j in near_pairs(first, last, own):
            near = np.bitwise_count(bits[i] ^ bits[j]) <= most_bits
            if near.any():
                a, b = star_links(i[near], j[near])
                pair = np.unique(np.stack([fp[a], fp[b]], axis=1), axis=0)
                yield pa.table({"a": pair[:, 0], "b": pair[:, 1]})

    return compare_in_buckets(keys, "key", "fp", compare, "a long, b long", block, sizes)


@tidy
def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, most_bits: int) -> DataFrame:
    """(id, fp, root, component_id) for each row of docs."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(with_fingerprints(base, words=words).select("id", "fp"), "fingerprints", keep=True)
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    links = materialize(link_fingerprints(nodes.select("fp"), most_bits), "links")
    if is_empty(links):
        found = nodes.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    else:
        roots = connected_components(thinned(links), "a", "b")
        joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
        joined = materialize(joined, "joined")
        found = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.join(materialize(found, "groups", keep=True), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most_bits: int = 3) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other. component_id is the smallest id reachable
    by links of at most most_bits differing bits; ids that are null don't count, and it is null where a component has
    no other. Equal fingerprints are one node, so copies are never paired. Other columns are ignored.
    """
    rows = _grouped(docs, id_col, text_col, words, most_bits)
    return rows.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, ascending; a text of fewer words is one shingle, one without words none."""
    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(tokens) - words + 1)].tolist()
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64))


def word_digest(text: str | None) -> int:
    """A hash of the whole sequence of a text's words; 0 without words."""
    tokens = (text or "").encode().translate(_LOWER).split()
    return xxhash.xxh64_intdigest(b" ".join(tokens), 1) if tokens else 0


def wide_fingerprint(grams: np.ndarray, portion: int = 1 << 15) -> np.ndarray:
    """Two 64-bit words of a SimHash of 128 bits of a set of shingle hashes; zeros for an empty set."""
    ones = np.zeros(128, dtype=np.int64)
    for k in range(0, len(grams), portion):
        h = grams[k : k + portion]
        second = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)  # an independent second word from the first
        second ^= second >> np.uint64(29)
        both = np.stack([h, second], axis=1).astype(">u8")
        ones += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64)
    return np.frombuffer(np.packbits(ones * 2 > len(grams)).tobytes(), dtype=">u8").astype(np.uint64)


def _segment_columns(first: str, second: str) -> list[Column]:
    """Twelve segments of 16 bits of a 128-bit fingerprint: eight runs, and of four offsets each eighth bit."""
    runs = [F.shiftrightunsigned(w, o).bitwiseAND(0xFFFF) for w in (first, second) for o in (0, 16, 32, 48)]
    bit = lambda k: F.shiftleft(F.shiftrightunsigned(first if k < 64 else second, k % 64).bitwiseAND(1), k // 8)
    strides = []
    for o in (0, 2, 4, 6):
        joined = bit(o)
        for k in range(o + 8, 128, 8):
            joined = joined.bitwiseOR(bit(k))
        strides.append(joined)
    return [*runs, *strides]


def near_candidates(nodes: DataFrame, most_bits: int = 30, block: int = 2048) -> DataFrame:
    """(a, b): links between nodes (node, w0, w1) that join all pairs that share a one-wildcard variant of a segment and differ in
    at most most_bits of their 128 bits; of each compared block a star for each of its components."""
    parts = [F.struct(F.lit(k).alias("s"), c.alias("v")) for k, c in enumerate(_segment_columns("w0", "w1"))]
    cut = nodes.select("w0", "w1", F.explode(F.array(*parts)).alias("x")).select("w0", "w1", "x.s", "x.v")
    places = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p")
    key = ((F.col("s") * 16 + F.col("p")).cast("long") * (1 << 16) + F.expr("v & ~shiftleft(1L, p)")).alias("key")
    keys = cut.select("w0", "w1", "s", "v", places).select(key, "w0", "w1")
    crowded = cut.groupBy("s", "v").agg(F.count("*").alias("n")).filter(F.col("n") > block // 2)
    sizes = crowded.select("s", "v", "n", places).groupBy(key).agg((F.sum("n") + block // 2).alias("_n"))

    return close_prints(keys, most_bits, block, sizes)


def _similar(sets: list[np.ndarray], group: np.ndarray, own: np.ndarray, least: float):
    """Index pairs of sets of that similarity that join all such pairs; sets that already have one group, or one own block, aren't compared."""
    sizes = np.array([len(s) for s in sets])
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(place.max() + 1, dtype=np.int64)
    for i in range(len(sets) - 1):
        open_ = (group != group[i]) & ((own < 0) | (own != own[i]))
        open_[: i + 1] = False
        if not open_.any():
            continue
        mine = place[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[place], starts)
        mark[mine] = 0
        for j in np.flatnonzero(open_ & (shared >= least * (sizes + sizes[i] - shared))).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                yield i, j


def verified_links(members: DataFrame, sets: DataFrame, least: float, block: int = 512) -> DataFrame:
    """(a, b): links that join all pairs of members (node, w0, w1, component) of one component whose sets (node, grams) have a
    similarity of at least `least`. Each set is first compared with that of its component's hub, the member nearest to the
    bitwise majority; only components with a member unlike the hub go on, in blocks of bounded size."""
    bits = [F.sum(F.shiftrightunsigned(w, b).bitwiseAND(1)).alias(f"{w}_{b}") for w in ("w0", "w1") for b in range(64)]
    counted = members.groupBy("component").agg(F.count("*").alias("n"), *bits)
    word = lambda w: reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col(f"{w}_{b}") * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for b in range(64)])
    middle = materialize(counted.select("component", word("w0").alias("m0"), word("w1").alias("m1")), "middles")
    far = F.bit_count(F.col("w0").bitwiseXOR(F.col("m0"))) + F.bit_count(F.col("w1").bitwiseXOR(F.col("m1")))
    hubs = members.join(middle, "component").groupBy("component").agg(F.min(F.struct(far, "node"))["node"].alias("hub"))
    rows = materialize(members.select("node", "component").join(sets, "node"), "sets")
    hubs = materialize(rows.join(hubs, "component").filter("node = hub").select("component", "hub", F.col("grams").alias("hub_grams")), "hubs")
    shared = F.size(F.array_intersect("grams", "hub_grams"))
    alike = shared >= F.lit(least) * (F.size("grams") + F.size("hub_grams") - shared)
    judged = materialize(rows.join(hubs, "component").select("component", "node", "hub", alike.alias("alike")), "judged")
    links = judged.filter("alike and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    unlike = judged.filter("not alike").select("component").distinct()
    rest = rows.join(materialize(unlike, "unlike"), "component").join(judged.select("node", "alike"), "node")

    def compare(table, own, first, last):
        node, grams = table.column("node").to_numpy(), table.column("grams").combine_chunks()
        alike = table.column("alike").to_numpy()
        starts, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
        for f, n in zip(first.tolist(), last.tolist(), strict=True):
            group = np.arange(n - f)
            group[alike[f:n]] = -1  # these are joined by their hub
            found = list(_similar([flat[starts[k] : starts[k + 1]] for k in range(f, n)], group, own[f:n], least))
            if found:
                i, j = np.array(found).T + f
                yield pa.table({"a": node[i], "b": node[j]})

    return links.union(compare_in_buckets(rest, "component", "node", compare, "a long, b long", block))


def head_length(n, least: float):
    """How many of a set's n shingles, in one order for all sets, hold one at least of every set of that similarity."""
    return n - np.ceil(least * n - 1e-9).astype(np.int64) + 1


def odd_bits(grams: np.ndarray, bits: int = 2048) -> np.ndarray:
    """For each cell of a hash whether an odd number of the set's shingles falls into it, as longs: two sets differ in no fewer shingles than cells."""
    return np.packbits((np.bincount(grams & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def spare_length(size):
    """How many shingles a sketch lists beyond a head of that size, to stand in for crowded ones."""
    return size // 8 + 8


def other_candidates(sketches: DataFrame, nodes: DataFrame, sets_of, least: float, crowd: int = 64, block: int = 8192) -> DataFrame:
    """(a, b): rows of all pairs of nodes (row, node, t, group, n, size, listed) of different groups whose sets may have a similarity of at least `least`.

    Two such sets share a shingle of their heads, the first shingles of each in any one order. That is the order of hashes, but for shingles that more than `crowd`
    sketches (row, head, odd) list, which come last. A sketch lists some shingles more than its head has, which take the places of the crowded ones; only of
    nodes with too few of them are the whole sets put in order (by sets_of). Sizes, and what is left of both sets behind the shingle, rule most pairs out,
    and of shingles that many nodes still share the parities too.
    """
    listed = sketches.select("row", F.explode("head").alias("gram"))
    crowded = materialize(listed.groupBy("gram").agg(F.count("*").alias("_c")).filter(F.col("_c") > crowd).select("gram"), "crowded")
    moved = materialize(listed.join(crowded, "gram").groupBy("row").agg(F.collect_list("gram").alias("_bad")), "moved")  # of one document's list
    short = materialize(nodes.join(moved, "row").filter(F.col("listed") - F.size("_bad") < F.col("size")).drop("_bad"), "short")
    heads = sketches.select("row", "head").join(nodes.select("row", "group", "n", "size"), "row").join(moved, "row", "left")
    heads = heads.withColumn("head", F.when(F.col("_bad").isNull(), F.col("head")).otherwise(F.array_except("head", "_bad"))).filter(F.size("head") >= F.col("size"))
    rows = heads.select("row", "group", "n", F.posexplode(F.slice("head", F.lit(1), F.col("size"))).alias("place", "gram"))
    no_sizes, large = crowded.select("gram", F.lit(0).alias("_n")).limit(0), None  # no more than `crowd` of these rows have a shingle
    if not is_empty(short):
        whole = sets_of(short.select("t", "node")).select("node", F.explode("grams").alias("gram"))
        last = whole.join(crowded.withColumn("_last", F.lit(1)), "gram", "left").withColumn("_last", F.coalesce("_last", F.lit(0)))
        placed = last.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("_last", "gram")) - 1)  # one document's shingles
        again = placed.join(short.select("node", "row", "group", "n", "size"), "node").filter("place < size").select("row", "group", "n", "place", "gram")
        again = materialize(again, "again")
        sizes = materialize(again.groupBy("gram").agg((F.count("*") + crowd).alias("_n")).filter(F.col("_n") > 2 * crowd), "large")
        if is_empty(sizes):
            rows = rows.union(again)
        else:  # the few large buckets are compared by themselves, with parities and in blocks
            rows = rows.union(again.join(sizes.select("gram"), "gram", "left_anti").select(*again.columns))
            others = listed.join(sizes.select("gram").join(crowded, "gram", "left_anti"), "gram")  # at most `crowd` for each
            others = others.join(nodes.select("row", "group", "n"), "row").select("row", "group", "n", F.lit(0).alias("place"), "gram")
            large = again.join(sizes.select("gram"), "gram", "left_semi").select(*again.columns).union(others).join(sketches.select("row", "odd"), "row")

    def compare(table, own, first, last):
        row, group, n, place = (table.column(c).to_numpy() for c in ("row", "group", "n", "place"))
        odd = table.column("odd").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(row), -1) if "odd" in table.column_names else None
        for i, j in near_pairs(first, last, own):
            rest = np.minimum(n[i] - place[i], n[j] - place[j])  # what they can share at most, if this is the first
            near = (group[i] != group[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-6) & (rest * (1 + least) >= least * (n[i] + n[j]) - 1e-6)
            if odd is not None:
                at = np.flatnonzero(near)
                for k in range(0, len(at), 1 << 14):
                    x, y = i[at[k : k + (1 << 14)]], j[at[k : k + (1 << 14)]]
                    near[at[k : k + (1 << 14)]] = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64) * (1 + least) <= (n[x] + n[y]) * (1 - least) + 1e-6
            if near.any():
                pair = np.unique(np.sort(np.stack([row[i[near]], row[j[near]]], axis=1), axis=1), axis=0)
                yield pa.table({"a": pair[:, 0], "b": pair[:, 1]})

    found = compare_in_buckets(rows, "gram", "row", compare, "a long, b long", block, no_sizes)
    if large is not None:
        found = found.union(compare_in_buckets(large, "gram", "row", compare, "a long, b long", block, sizes))
    return found.distinct()


@tidy
def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, print_words: int = 3) -> DataFrame:
    """(id, t, node, root, component_id) for each row of docs: rows of one root are joined by links between texts whose sets of
    word shingles have a similarity (Jaccard) of at least `least`.

    Candidates are found by SimHash: 128 bits of the set of three-word shingles, of which near copies share more than of longer
    ones, cut into twelve segments of 16 bits, each indexed under its variants with one wildcard. Of 6,121 pairs of check_s at a similarity
    of 0.8 and more, 0.994 of those below 0.82 share a variant, and all others. The sets decide, so no less similar pair is linked. Between the groups that come of it,
    the shingles that similar sets must share propose the remaining pairs (see other_candidates), so none is missed.
    """
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, row long, t long, node long, w0 long, w1 long, n long, size long, listed long, head array<long>, odd array<long>"
    base = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.col(text_col).alias("text"))

    def sketched(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            prints = np.array([wide_fingerprint(shingle_hashes(t, print_words)) for t in texts], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            nodes = np.array([word_digest(t) for t in texts], dtype=np.uint64).view(np.int64)
            n, sizes, heads, odd = [], [], [], []
            for t in texts:
                grams = np.sort(shingle_hashes(t, words).view(np.int64))
                n.append(len(grams))
                odd.append(odd_bits(grams))
                sizes.append(int(head_length(len(grams), least)) if len(grams) else 0)
                heads.append(grams[: sizes[-1] + spare_length(sizes[-1])])
            numbers = [pa.array(c, pa.int64()) for c in (nodes, prints[:, 0].copy(), prints[:, 1].copy(), n, sizes, [len(h) for h in heads])]
            columns = [b.column("id"), b.column("row"), b.column("t"), *numbers, pa.array(heads, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "t", "node", "w0", "w1", "n", "size", "listed", "head", "odd"])

    def cut(batches):
        for b in batches:
            sets = pa.array([shingle_hashes(t, words).view(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), sets], names=["node", "grams"])

    def sets_of(members):
        """(node, grams) of members (t, node), of which each node is one."""
        texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.col(text_col).alias("text"))
        texts = texts.join(members.select("t"), "t", "left_semi").groupBy("t").agg(F.min("text").alias("text")).join(members.select("t", "node"), "t")
        return materialize(map_arrow(texts.select("node", "text"), cut, "node long, grams array<long>"), "shingles")

    about = ["row", "n", "size", "listed"]  # the rows of a node have the same sketch: the first one's stands for all
    rows = materialize(map_arrow(base, sketched, kind), "sketches", keep=True)
    nodes = materialize(rows.groupBy("node", "w0", "w1").agg(F.min("id").alias("least"), F.min("t").alias("t"), *(F.min(c).alias(c) for c in about)), "nodes")
    worded = nodes.filter("node <> 0")  # texts without words are like no others
    prints = materialize(worded.select("w0", "w1").distinct(), "prints")
    found = materialize(near_candidates(prints), "candidates")
    name = lambda a, b: F.concat(F.hex(a), F.lit("-"), F.hex(b))
    named = worded.withColumn("print", name("w0", "w1"))
    groups = connected_components(thinned(found.select(name("a0", "a1").alias("a"), name("b0", "b1").alias("b"))), "a", "b")
    members = named.join(groups.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    several = materialize(members.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component"), "several")
    members = materialize(members.join(several, "component").select("node", "t", "w0", "w1", "component"), "members")
    if is_empty(members):
        joined = nodes.select("node", "t", "least", *about, F.col("node").alias("root"))
    else:
        with temporary():
            links = materialize(verified_links(members.drop("t"), sets_of(members.select("t", "node")), least), "links", keep=True)
        roots = connected_components(thinned(links), "a", "b").withColumnRenamed("component", "root")
        joined = materialize(nodes.join(roots, "node", "left").select("node", "t", "least", *about, F.coalesce("root", "node").alias("root")), "joined")
    sketches = rows.filter("node <> 0")
    # rows number the nodes, and groups are the least of them: they travel smaller than hashes
    grouped = joined.filter("node <> 0").join(joined.groupBy("root").agg(F.min("row").alias("group")), "root").select("node", "t", "group", *about)
    with temporary():
        pairs = materialize(other_candidates(sketches.select("row", "head", "odd"), materialize(grouped, "grouped"), sets_of, least), "pairs", keep=True)
    some = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    odd = materialize(sketches.select("row", "n", "odd").join(some, "row", "left_semi"), "odd")
    bits = lambda c: odd.select(F.col("row").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}"))
    differing = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    close = differing * (1 + least) <= (F.col("na") + F.col("nb")) * (1 - least) + 1e-6
    pairs = materialize(pairs.join(bits("a"), "a").join(bits("b"), "b").filter(close).select("a", "b"), "close")
    if not is_empty(pairs):
        some = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
        wanted = materialize(joined.select("t", "node", "row", "root").join(some, "row", "left_semi"), "wanted")
        sets = sets_of(wanted.select("t", "node")).join(wanted, "node")
        side = lambda r, g: sets.select(F.col("row").alias(r), F.col("root").alias(f"r{r}"), F.col("grams").alias(g))
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        alike = materialize(both.filter(shared >= F.lit(least) * (F.size("x") + F.size("y") - shared)).select("ra", "rb"), "alike")
        meet = connected_components(alike, "ra", "rb").select(F.col("node").alias("root"), F.col("component").alias("_to"))
        joined = materialize(joined.join(meet, "root", "left").select("node", "least", F.coalesce("_to", "root").alias("root")), "joined")
    placed = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return rows.select("id", "t", "node").join(materialize(placed, "placed", keep=True), "node")


@tidy
def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs without near copies, see near_copy_groups: of each group the row with the smallest id stays, in all its columns.

    Of rows that repeat this id one stays; of a group without any id, one row stays. Null texts, and texts without words, are copies.
    """
    groups = materialize(near_copy_groups(docs, id_col, text_col, words, least), "groups", keep=True)
    named = groups.filter("id = component_id").select(F.col("id").alias(id_col)).distinct()
    kept = docs.join(named, id_col, "left_semi").dropDuplicates([id_col]).select(*docs.columns)
    nameless = groups.filter("component_id is null")
    if is_empty(nameless):
        return kept
    rest = docs.filter(F.col(id_col).isNull()).select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return kept.union(rest.join(nameless.select("t", "root").distinct(), "t").dropDuplicates(["root"]).select("row.*"))
