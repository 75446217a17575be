"""Deduplication of repeated line runs by a suffix array over line-id sequences, built by distributed prefix doubling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .scratch import discard, is_empty, materialize, running_totals, tidy

_SPACE = r"[\x20\x09-\x0D]+"


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, i, line, weight) for each line feed separated line: the document's id, a hash that tells documents with one id
    apart, the line's number, the line without white space at its ends, and its words, at least one. Rows that repeat both
    id and text give their lines once."""
    text = F.col(text_col)
    rows = docs.filter(text.isNotNull()).select(F.col(id_col).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    more = materialize(rows.groupBy("d", "t").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("d").alias("_d"), F.col("t").alias("_t")), "repeats")
    if not is_empty(more):  # so that no other texts are dealt anew
        same = F.col("d").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))
        rows = rows.join(more, same, "left_anti").union(rows.join(more, same, "left_semi").dropDuplicates(["d", "t"]))
    rows = rows.select("d", "t", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    line = F.regexp_replace("raw", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    rows = rows.select("d", "t", "i", line.alias("line"))
    return rows.withColumn("weight", F.when(F.col("line") == "", 1).otherwise(F.size(F.split("line", _SPACE))).cast("long"))


def _ranked(pairs: DataFrame, columns: list[str], label: str) -> DataFrame:
    """The distinct repeated values of columns with their place in ascending order as `rank`, from 1."""
    counted = materialize(pairs.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1").select(*columns), f"{label}-repeated")
    ones = counted.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1).cast("long"))
    ranks = running_totals(ones, "_all", [F.col(c) for c in columns], ["_one"], label)
    return materialize(ranks.select(*columns, (F.col("_one_before") + 1).alias("rank")), f"{label}-ranks")


def suffix_ranks(lines: DataFrame, longest: int) -> tuple[DataFrame, list[int]]:
    """Prefix doubling: (d, t, i, weight, r1, r2, r4, ...) for all lines that occur more than once, and the lengths 1, 2, 4, ...

    rk is the rank of the line's suffix by its first k lines among all suffixes whose first k lines occur more than once;
    suffixes of equal rank are one interval of the suffix array with a common prefix of k lines at least. It is null where
    these lines occur once or run over the document's end: such suffixes are told apart and drop out. The rank by 2k lines
    is that of the pair of ranks by k lines at i and i + k. Lengths end where no pair repeats, or beyond `longest`.
    """
    # a line's id is a 128-bit part of its SHA-256, so that equal ids are equal lines
    keyed = lines.select("d", "t", "i", "weight", F.unhex(F.substring(F.sha2("line", 256), 1, 32)).alias("key"))
    keyed = materialize(keyed, "lines")
    ids = _ranked(keyed.select("key"), ["key"], "lineids")
    active = materialize(keyed.join(ids, "key").select("d", "t", "i", "weight", F.col("rank").alias("r1")), "suffixes")
    discard(keyed)
    lengths = [1]
    while lengths[-1] * 2 <= longest:
        k = lengths[-1]
        follow = Window.partitionBy("d", "t").orderBy("i")
        second = F.when(F.lead("i", k).over(follow) == F.col("i") + k, F.lead(f"r{k}", k).over(follow))
        paired = materialize(active.withColumn("_a", F.col(f"r{k}")).withColumn("_b", second), "pairs")
        both = paired.select("_a", "_b").filter("_a is not null and _b is not null")
        ranks = _ranked(both, ["_a", "_b"], f"suffix{2 * k}")
        if is_empty(ranks):
            discard(paired)
            break
        joined = paired.join(ranks, ["_a", "_b"], "left").drop("_a", "_b").withColumnRenamed("rank", f"r{2 * k}")
        longer = materialize(joined.select(*active.columns, f"r{2 * k}"), "suffixes")
        for table in (active, paired, ranks):
            discard(table)
        active = longer
        lengths.append(2 * k)
    return active, lengths


def repeated_runs(lines: DataFrame, min_words: int = 50) -> DataFrame:
    """(d, t, start, end): line ranges, which may overlap, that repeat an earlier range; their union in a document is that of all maximal
    repeated line runs of min_words words or more that have an earlier copy.

    Earlier means a smaller (id, hash, line) in this order, null ids first; a copy may overlap the earlier one. A blank
    line counts as one word. Of a maximal run, every line lies in a least range of min_words words that starts or ends at
    a line of the run and lies in the run, so least ranges suffice. Ranges of w lines are equal if they lie in one
    interval of the suffix array whose common prefix has w lines, which the ranks of their first and last k lines tell,
    k being the largest power of two up to w.
    """
    active, lengths = suffix_ranks(lines, min_words)
    one = Window.partitionBy("d", "t").orderBy("i")
    # lines that occur once separate the stretches in which ranges may lie
    stretch = active.withColumn("_s", F.col("i") - F.row_number().over(one))
    listed = F.sort_array(F.collect_list(F.struct("i", "weight", *(f"r{k}" for k in lengths)))).alias("x")
    stretches = stretch.groupBy("d", "t", "_s").agg(listed)

    def ranges(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            starts = batch.column("x").offsets.to_numpy()
            flat = batch.column("x").flatten()
            line = flat.field("i").to_numpy(zero_copy_only=False)
            weight = flat.field("weight").to_numpy(zero_copy_only=False)
            rank = {k: flat.field(f"r{k}").fill_null(0).to_numpy(zero_copy_only=False) for k in lengths}
            base = starts[0]
            for row, (a, b) in enumerate(zip((starts[:-1] - base).tolist(), (starts[1:] - base).tolist(), strict=True)):
                after = np.cumsum(weight[a:b])
                before = after - weight[a:b]
                n = b - a
                end = np.searchsorted(after, before + min_words) + 1
                first = np.flatnonzero(end <= n)
                start = np.searchsorted(before, after - min_words, side="right") - 1
                last = np.flatnonzero(start >= 0)
                both = np.unique(np.concatenate([np.stack([first, end[first]], 1), np.stack([start[last], last + 1], 1)]), axis=0)
                w = both[:, 1] - both[:, 0]
                k = 1 << np.int64(np.log2(np.maximum(w, 1)) + 1e-9)
                for length in lengths:
                    use = both[k == length]
                    if not len(use):
                        continue
                    x, y = rank[length][a + use[:, 0]], rank[length][a + use[:, 1] - length]
                    use, x, y = (v[(x > 0) & (y > 0)] for v in (use, x, y))
                    for o, v in zip(out, (np.full(len(use), row), line[a + use[:, 0]], use[:, 1] - use[:, 0], np.full(len(use), length), x, y), strict=True):
                        o.append(v.astype(np.int64))
            cols = [np.concatenate(o) if o else np.zeros(0, dtype=np.int64) for o in out]
            take = pa.array(cols[0])
            yield pa.RecordBatch.from_arrays([batch.column("d").take(take), batch.column("t").take(take), *(pa.array(c) for c in cols[1:])], names=["d", "t", "s", "w", "k", "x", "y"])

    kind = active.schema["d"].dataType.simpleString()
    found = materialize(map_arrow(stretches, ranges, f"d {kind}, t long, s long, w long, k long, x long, y long"), "ranges")
    groups = found.groupBy("w", "k", "x", "y").agg(F.min(F.struct("d", "t", "s")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    groups = materialize(groups, "intervals")  # so that both sides of the join are dealt anew and Spark can split a hot interval
    later = found.join(groups, ["w", "k", "x", "y"]).filter(~F.struct("d", "t", "s").eqNullSafe(F.col("first")))
    return later.select("d", "t", F.col("s").cast("int").alias("start"), (F.col("s") + F.col("w")).cast("int").alias("end"))


@tidy
def without_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, removed_col: str | None = None) -> DataFrame:
    """docs with text_col freed of the later copies of repeated line runs; see repeated_runs.

    The first copy stays, and every row stays, if only with an empty text; null texts stay null. removed_col names a
    column for the numbers of the lines removed, ascending. Rows that repeat both id and text count as one document
    and lose the same lines. Other columns are carried along.
    """
    runs = repeated_runs(document_lines(docs, id_col, text_col), min_words)
    gone = runs.select("d", "t", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"))
    gone = materialize(gone.groupBy("d", "t").agg(F.sort_array(F.collect_set("i")).alias("_gone")), "removed", keep=True)
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # no name of docs can clash
    own, text = F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")
    # the same plan at every size: both sides are dealt by document
    keyed = rows.join(gone.hint("merge"), own.eqNullSafe(F.col("d")) & (F.xxhash64(text) == F.col("t")), "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    shown = F.when(F.col("_gone").isNull(), text).otherwise(left).alias(text_col)
    removed = [F.coalesce("_gone", F.array().cast("array<int>")).alias(removed_col)] if removed_col else []
    return keyed.select(*(shown if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns), *removed)
