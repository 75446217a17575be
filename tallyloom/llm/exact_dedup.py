"""Exact deduplication of texts by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so, each chunk becomes a verified identifier, and texts are compared as
ordered lists of identifiers. Chunk bytes move once, after equal chunks of a task have been merged; whole texts never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, is_empty, materialize, tidy

#: Deleted before texts are compared.
IGNORED = r"[\x20\x09-\x0D]"


def normalise(text: Column, ignored: str = IGNORED) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ignored, "")


def chunks(text: Column, least: int = 1024, most: int = 4096) -> Column:
    """Content-defined chunks: each ends at the first punctuation mark after `least` code points, or after `most`.

    A change in one place moves the cuts up to the next such mark that both versions share, and no further.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?[.!?,;:]|.{{1,{most}}}"), F.lit(0))


@tidy
def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ignored: str = IGNORED, hash_bits: int = 64, least: int = 1024, most: int = 4096) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting `ignored`; null counts as empty. The row with the most code points
    in its original text stays, then the one with the smallest id; a null id comes last. Rows that repeat an id are
    rows of their own in group_size, and kept is true for all rows that bear the id that stays in their group.
    Other columns of docs are ignored, so their names can't clash. hash_bits shortens the chunk hash, for tests.

    Equal chunk hashes are trusted only after their bytes have been compared: hashes that stand for more than one
    content get an ordinal for each content, so identifiers are never shared by different chunks.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("points"), normalise(text, ignored).alias("norm")
    )
    hashed = (lambda c: F.xxhash64(c)) if hash_bits == 64 else (lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - hash_bits))
    cut = chunks(F.col("norm"), least, most)

    pieces = base.select(F.explode(cut).alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = pieces.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    shared = materialize(shared, "collisions")

    if is_empty(shared):  # every hash stands for one content
        discard(shared)
        recipe = F.transform(cut, hashed)
    else:
        from pyspark.sql import Window

        contents = pieces.join(shared, "h")
        ordinal = F.row_number().over(Window.partitionBy("h").orderBy("chunk")).cast("long")
        names = materialize(contents.select("h", "chunk", ordinal.alias("k")), "chunks")
        keyed = base.withColumn("row", F.monotonically_increasing_id())
        keyed = materialize(keyed.select("row", "id", "points", F.sha2("norm", 256).alias("text_sha256"), cut.alias("cut")), "cut")
        ids = keyed.select("row", F.posexplode("cut").alias("at", "chunk")).withColumn("h", hashed(F.col("chunk")))
        ids = ids.join(names, ["h", "chunk"], "left").select("row", F.struct("at", "h", F.coalesce("k", F.lit(0)).alias("k")).alias("x"))
        lists = ids.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("x"))
        lists = lists.select("row", F.flatten(F.transform("x", lambda x: F.array(x["h"], x["k"]))).alias("recipe"))
        base = keyed.drop("cut").join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<bigint>")))
        recipe = None

    if recipe is not None:
        base = base.select("id", "points", F.sha2("norm", 256).alias("text_sha256"), recipe.alias("recipe"))
    rows = materialize(base, "recipes", keep=True)
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("e"), F.col("id").alias("id"))).alias("best")
    # written, so that both sides of the join are dealt anew and Spark can split a hot group
    groups = materialize(rows.groupBy("recipe").agg(best, F.count("*").alias("group_size")), "groups", keep=True)
    out = rows.join(groups, "recipe")
    return out.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", F.col("id").eqNullSafe(F.col("best.id")).alias("kept"), "text_sha256"
    )
