"""Resharding by minimum-cost flow: old shard sizes and new capacities give the block transfers that move fewest bytes."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize, running_totals, tidy


def minimum_cost_flow(supplies: list[int], capacities: list[int], cost=None) -> dict[tuple[int, int], int]:
    """{(old, new): bytes} that places all supplies within the capacities at least cost.

    cost(old, new) is the cost of a byte, by default 0 where it stays in the shard of the same number and else 1. Solved
    by successive shortest paths with potentials over the shards; the graph has one node for each shard, whatever the
    rows. Capacities must hold the supplies.
    """
    if sum(capacities) < sum(supplies):
        raise ValueError("the new shards can't hold the old ones")
    cost = cost or (lambda i, j: 0 if i == j else 1)
    n, m = len(supplies), len(capacities)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]  # edge: to, room, cost, index of its reverse

    def edge(a: int, b: int, room: int, c: float) -> None:
        graph[a].append([b, room, c, len(graph[b])])
        graph[b].append([a, 0, -c, len(graph[a]) - 1])

    for i, s in enumerate(supplies):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacities):
        edge(n + j, sink, c, 0)
    potential = [0.0] * len(graph)
    while True:
        distance, via = [float("inf")] * len(graph), [None] * len(graph)
        distance[source] = 0.0
        queue = [(0.0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > distance[a]:
                continue
            for e in graph[a]:
                if e[1] and (x := d + e[2] + potential[a] - potential[e[0]]) < distance[e[0]] - 1e-12:
                    distance[e[0]], via[e[0]] = x, (a, e)
                    heapq.heappush(queue, (x, e[0]))
        if via[sink] is None:
            break
        reached = max(d for d in distance if d < float("inf"))
        potential = [p + min(d, reached) for p, d in zip(potential, distance, strict=True)]
        path, b = [], sink
        while b != source:
            a, e = via[b]
            path.append(e)
            b = a
        room = min(e[1] for e in path)
        for e in path:
            e[1] -= room
            graph[e[0]][e[3]][1] += room
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1]}


def equal_capacities(total: int, shards: int) -> list[int]:
    """Capacities that hold the total and differ by one at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def transfers(flow: dict[tuple[int, int], int], stay_first: bool) -> list[tuple[int, int, int, int]]:
    """(old, new, from, to): the byte ranges of each old shard's rows, in order, that go to each new shard."""
    out = []
    for old in sorted({i for i, _ in flow}):
        parts = sorted((j for i, j in flow if i == old), key=lambda j: ((j != old) == stay_first, j))
        at = 0
        for j in parts:
            out.append((old, j, at, at + flow[old, j]))
            at += flow[old, j]
    return out


def _key(large_first: bool) -> Column:
    """What the rows of a shard are ordered by; `at` parts rows that are alike, so that they can be cut and dealt too."""
    return F.struct((-F.col("size") if large_first else F.col("size")).alias("size"), F.col("id").alias("id"), F.col("crc").alias("crc"), F.col("at").alias("at"))


def _cuts(rows: DataFrame, shards: int, capacities: list[int] | None, large_first: bool, old_shards: int) -> DataFrame:
    """(old, new, low, high) of one round of transfers: the range of keys of each old shard's rows that go to a new one, low being null
    in its first and high in its last. Rows are cut where a byte range of the flow ends, by their middle byte. One row for each
    pair of shards in the flow's basis at most."""
    sizes = dict(rows.groupBy("shard").agg(F.sum("size")).collect())  # one row for each shard
    supplies = [int(sizes.get(i, 0)) for i in range(max(old_shards, shards))]
    plan = transfers(minimum_cost_flow(supplies, capacities or equal_capacities(sum(supplies), shards)), stay_first=large_first)
    order = [F.col("size").desc() if large_first else F.col("size"), "id", "crc", "at"]
    totals = running_totals(rows, "shard", order, ["size"], "transfers")
    ranges = rows.sparkSession.createDataFrame(plan or [(0, 0, 0, 0)], "old int, new int, low long, high long")
    middle = F.col("size_before") + F.floor(F.col("size") / 2)
    placed = totals.join(F.broadcast(ranges), (F.col("shard") == F.col("old")) & (middle >= F.col("low")) & (middle < F.col("high")))
    found = materialize(placed.groupBy("old", "new").agg(F.min(_key(large_first)).alias("from")), "ranges")
    by = Window.partitionBy("old").orderBy("from")
    return materialize(found.select("old", "new", F.when(F.lag("from").over(by).isNotNull(), F.col("from")).alias("low"), F.lead("from").over(by).alias("high")), "cuts", keep=True)


def _transferred(rows: DataFrame, cuts: DataFrame, large_first: bool) -> DataFrame:
    """rows (size, id, crc, at, shard, ...) with shard after one round; each row goes to one shard, by its own key alone."""
    key = _key(large_first)
    here = (F.col("shard") == F.col("old")) & (F.col("low").isNull() | (key >= F.col("low"))) & (F.col("high").isNull() | (key < F.col("high")))
    joined = rows.join(F.broadcast(cuts), here, "left")  # bounded by the pairs of shards
    return joined.select(*(F.coalesce("new", "shard").alias("shard") if c == "shard" else F.col(c) for c in rows.columns))


def _measured(docs: DataFrame, old_shard: Column, id_col: str, text_col: str) -> list[Column]:
    text, origin = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(old_shard, F.lit(0)).cast("int")
    return [F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("at"), origin.alias("origin"), origin.alias("shard")]


def with_slots(rows: DataFrame) -> DataFrame:
    """rows (id, crc, size, shard, ...) with slot: places from 0 without gaps in each shard, in the order of ids."""
    one = rows.withColumn("_one", F.lit(1).cast("long"))
    return running_totals(one, "shard", [F.col("id"), F.col("crc"), F.col("size")], ["_one"], "slots", keep=True).withColumnRenamed("_one_before", "slot").drop("_one")


@dataclass
class Resharding:
    """Where rows go: two rounds of cuts, and which shards gain or lose rows. Both are as large as the pairs of shards."""

    cuts: tuple[DataFrame, DataFrame]
    affected: list[int]

    def apply(self, rows: DataFrame) -> DataFrame:
        return _transferred(_transferred(rows, self.cuts[0], True), self.cuts[1], False)


@tidy
def plan_resharding(docs: DataFrame, old_shard: Column, old_shards: int, shards: int, id_col: str = "doc_id", text_col: str = "text", capacities: list[int] | None = None) -> Resharding:
    """The transfers that move the fewest bytes. A first round places each shard's rows with the largest staying, a second one evens
    out with the smallest rows what whole rows left over."""
    rows = materialize(docs.select(*_measured(docs, old_shard, id_col, text_col)), "sizes")
    first = _cuts(rows, shards, capacities, True, old_shards)
    rows = materialize(_transferred(rows, first, True), "moved")
    plan = Resharding((first, _cuts(rows, shards, capacities, False, old_shards)), [])
    moved = _transferred(rows, plan.cuts[1], False).filter("origin <> shard").select(F.explode(F.array("origin", "shard")).alias("s")).distinct()
    plan.affected = sorted(r[0] for r in moved.collect())  # one row for each shard at most
    return plan


@tidy
def reshard(docs: DataFrame, old_shard: Column, old_shards: int, shards: int, id_col: str = "doc_id", text_col: str = "text", capacities: list[int] | None = None) -> DataFrame:
    """One row for each row of docs: id_col, size, text_crc32, old_shard, shard, slot.

    size is the text's UTF-8 bytes plus one, a null text having none; its crc is that of no bytes. old_shard tells
    where a row lies, null counting as 0. The flow decides how many bytes go from each old shard to each new one, by
    default to new shards of equal bytes; rows stay where they can, see plan_resharding. slot numbers a shard's
    rows without gaps in the order of ids. Rows that repeat an id, and null ids, are rows of their own. Other columns are ignored.
    """
    plan = plan_resharding(docs, old_shard, old_shards, shards, id_col, text_col, capacities)
    rows = plan.apply(docs.select(*_measured(docs, old_shard, id_col, text_col))).drop("at")
    rows = with_slots(rows)
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("origin").alias("old_shard"), "shard", "slot")


def rewrite_affected(docs: DataFrame, plan: Resharding, old_shard: Column, path: str, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 10_000) -> None:
    """Write the shards that gain or lose rows below path; the files of all other shards stay valid as they are.

    A shard is a folder _shard=N with files of about rows_per_file rows, sorted by id and text: all columns of docs but one of that name. Each
    row's shard follows from the row and the plan's cuts, so whole rows are dealt once. Where nothing moves nothing is written.
    """
    if not plan.affected:
        return
    whole = docs.select(*_measured(docs, old_shard, id_col, text_col), F.struct(*(c for c in docs.columns if c != "_shard")).alias("row"))
    rows = plan.apply(whole).filter(F.col("shard").isin(plan.affected))
    files = max(1, -(-docs.count() // rows_per_file))
    rows = rows.repartitionByRange(files, "shard", "id", "crc", "at").sortWithinPartitions("shard", "id", "crc", "size")
    rows.select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").mode("overwrite").parquet(path)


def resharded(docs: DataFrame, plan: Resharding, old_shard: Column, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _shard as they stand after the transfers: rows of the shards rewritten below path come from their files."""
    rewrite_affected(docs, plan, old_shard, path, id_col, text_col)
    kept = [c for c in docs.columns if c != "_shard"]
    origin = F.coalesce(old_shard, F.lit(0)).cast("int")
    stay = docs.select(*kept, origin.alias("_shard"))
    if not plan.affected:
        return stay
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("_shard", T.IntegerType())])
    out = docs.sparkSession.read.schema(schema).parquet(path).select(*kept, "_shard")
    return out.union(stay.filter(~F.col("_shard").isin(plan.affected)))
