"""The queries of this package, each over its whole table, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import alignment, bpe, embedding_dedup, exact_dedup, language_id, line_dedup, packing, pair_bpe, sharding, simhash, toxicity, url_filter, whitening
from .scratch import materialize, scratch_root

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) mod 4 is 2: their labels are never read."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = line_dedup.without_repeated_runs(docs.select("doc_id", "text"), removed_col="removed")
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages judged with redirects, which the tables lack: of each three pages in the order of ids, each redirects to the one before."""
    pages = _table(spark, sf_dir, "pages")
    three = lambda c: F.floor(c / 3)
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("target"), three(F.col("page_id")).alias("three"))
    redirects = pages.join(before, "page_id").filter(three(F.col("page_id")) == F.col("three")).select(F.col("url").alias("alias"), "target")
    return url_filter.judge_urls(pages, URL_RULES, redirects)


def old_shard(source: str = "source"):
    """Where a document lies before resharding: its source decides, so one shard holds a hot source."""
    return F.pmod(F.crc32(F.coalesce(F.col(source), F.lit("")).cast("binary")), F.lit(SHARDS)).cast("int")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the shards' files after the transfers, each shard's numbered."""
    docs = _table(spark, sf_dir, "documents")
    plan = sharding.plan_resharding(docs, old_shard(), SHARDS, SHARDS)
    out = sharding.resharded(docs, plan, old_shard(), f"{scratch_root(spark)}/shards-{uuid.uuid4().hex}")
    text = F.coalesce("text", F.lit(""))
    rows = out.select(F.col("doc_id").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), old_shard().alias("old_shard"), F.col("_shard").alias("shard"))
    rows = sharding.with_slots(rows)
    return rows.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_sharding promises, for each document: its text as it was, and a shard without gaps whose bytes lie off the mean by no
    more than one percent or the largest text."""
    docs = op3_sharding(spark, sf_dir).select("doc_id", "size", "shard", "slot")
    shards = docs.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.max("size").alias("most"), F.countDistinct("slot").alias("slots"))
    whole = Window.partitionBy()  # one row for each shard
    mean = F.sum("bytes").over(whole) / SHARDS
    even = F.abs(F.col("bytes") - mean) <= F.greatest(mean / 100, F.max("most").over(whole))
    shards = shards.select("shard", ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"), even.alias("even"))
    return docs.join(F.broadcast(shards), "shard").select("doc_id", "size", "gapless", "even")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit_lexicon(docs, _table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score_toxicity(docs, lexicon, score_col="score", columns=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by text, declared language and source as host, and pages by all four kinds of evidence: (doc_id or page_id, language, posterior, rejected)."""
    docs = language_id.identify(_table(spark, sf_dir, "documents"), host=F.col("source"), columns=["doc_id"])
    return docs.unionByName(page_language(spark, sf_dir), allowMissingColumns=True)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_pair_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bpe.round_trip_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return alignment.align_corpus(_table(spark, sf_dir, "documents"), a.read(), b.read())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def whitening_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_whitening's exact columns, which SQL can express."""
    return op13_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages with text (what shows), lang (the markup's), host, and address: the path's language segment, else the host's last label."""
    markup = F.regexp_extract("html", r"(?i)<html\b[^<>]*\slang=[\"']?([a-zA-Z-]+)", 1)
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " "), r"&[a-z]+;", " ")
    host = url_filter.url_host(F.col("url"))
    segment = F.regexp_extract(url_filter.url_path(F.col("url")), r"^/([a-z]{2})(?:/|$)", 1)
    address = F.when(segment != "", segment).otherwise(F.nullif(language_id.suffix_of(host), F.lit("")))
    return pages.select("page_id", visible.alias("text"), markup.alias("lang"), host.alias("host"), address.alias("address"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_evidence(_table(spark, sf_dir, "pages"))
    return language_id.identify(pages, host=F.col("host"), address=F.col("address"), columns=["page_id"])


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, component_id): the groups of the pipeline's SimHash stage, by five-word shingles of a similarity of 0.8 and more."""
    groups = simhash.near_copy_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "component_id")


def packing_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_packing promises, for each document: its pieces follow each other and hold all its tokens, in sequences of 2,048 at most without gaps."""
    # smaller portions and fewer remembered words than op4_packing's: a worker takes less memory and more time
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), remembered=250_000, portion=1 << 21)
    pieces = materialize(packed, "pieces")
    last = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("low"))
    pieces = pieces.join(last, "sequence_id").withColumn("fits", (F.col("n") <= 2048) & (F.col("n") == F.col("end")) & (F.col("low") == 0))
    whole = (F.sum("length") == F.max("doc_tokens")) & (F.max(F.col("start") + F.col("length")) == F.max("doc_tokens")) & (F.min("start") == 0) & (F.countDistinct("start") == F.count("*"))
    return pieces.groupBy("doc_id").agg(whole.alias("whole"), F.min("fits").alias("fits"))


def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_byte_bpe's decoded texts, which SQL can tell without the ids."""
    return op10_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256", (F.col("n_tokens") > 0).alias("has_tokens"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_url_filter, op3_sharding, op4_packing, op5_exact_dedup, op6_embedding_dedup, op7_simhash, op8_toxicity, op9_language_id, op10_byte_bpe, op11_pair_bpe, op12_alignment, op13_whitening, whitening_deviation, page_language, url_redirects, sharding_law, packing_law, near_copies, byte_bpe_round_trip)
}
