"""Language identification by fusing evidence: text likelihood, declared language, address suffix and host priors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from .scratch import materialize, tidy

LANGUAGES = ("de", "en", "es", "fr")
#: Hash buckets of the letter trigrams; a power of two.
BUCKETS = 1 << 14


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each trigram of letters in the lower-cased text, words being padded by one blank on either side."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype="<u4")
    if not len(points):
        return points.astype(np.int64)
    letter = _letters()[np.minimum(points, _LAST)]
    keep = letter | np.concatenate([[True], letter[:-1]])  # of what stands between words, one place remains
    c = np.where(letter, points, 32)[keep].astype(np.uint64)
    c = np.concatenate([[32], c, [32]]).astype(np.uint64)
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    mixed = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA6B) + c[2:] * np.uint64(0xC2B2AE35)) & np.uint64(0xFFFFFFFF)
    return ((mixed ^ (mixed >> np.uint64(15))) & np.uint64(BUCKETS - 1))[c[1:-1] != 32].astype(np.int64)


_LAST = 0x3FFFF
_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.array([not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(_LAST + 1)]))
    return _table[0]


@dataclass
class Model:
    """logs[language, bucket]: smoothed log probabilities, float32; typical: mean and deviation of a text's mean log
    probability under its own language, by which texts in none of the languages are told."""

    languages: tuple[str, ...]
    logs: np.ndarray
    typical: tuple[float, float]

    def means(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of trigrams, and their mean log probability under each language."""
        at = trigrams(text)
        if not len(at):
            return 0, np.zeros(len(self.languages))
        found, n = np.unique(at, return_counts=True)
        return len(at), (self.logs[:, found] @ n) / len(at)


def fit_model(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", languages: tuple[str, ...] = LANGUAGES, most_rows: int = 20_000) -> Model | None:
    """Trigram counts of about most_rows documents (a documented bound) that declare one of the languages, chosen by a
    hash of their text; None where none does. A few wrong declarations do little harm to the counts."""
    known = docs.select(F.col(text_col).alias("text"), F.lower(F.substring(F.col(declared_col), 1, 2)).alias("declared")).filter(F.col("declared").isin(*languages) & F.col("text").isNotNull())
    n = known.count()
    if not n:
        return None
    share = int(1_000_000 * min(1.0, most_rows / n))
    sample = known.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_000)) < share)

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, d in zip(batch.column("text").to_pylist(), batch.column("declared").to_pylist(), strict=True):
                total[languages.index(d)] += np.bincount(trigrams(text), minlength=BUCKETS)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b], pa.int64())], names=["l", "b", "n"])

    table = map_arrow(sample, count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    counts = np.zeros((len(languages), BUCKETS))
    counts[table["l"], table["b"]] = table["n"]
    logs = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32)
    model = Model(tuple(languages), logs, (0.0, 0.0))

    def typical(batches):
        for batch in batches:
            x = [model.means(t) for t in batch.column("text").to_pylist()]
            best = np.array([m.max() for k, m in x if k >= 50])
            yield pa.RecordBatch.from_arrays([pa.array([len(best)], pa.int64()), pa.array([best.sum()], pa.float64()), pa.array([(best**2).sum()], pa.float64())], names=["n", "s", "q"])

    n, s, q = map_arrow(sample, typical, "n long, s double, q double").agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
    if n:
        model.typical = (s / n, max(0.05, (q / n - (s / n) ** 2) ** 0.5))
    return model


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def host_priors(docs: DataFrame, host: Column, declared: Column, languages: tuple[str, ...], strength: float = 20.0) -> DataFrame:
    """(host, prior array<double>): shares of the declared languages for each host, smoothed towards those of its domain
    (its last two labels), these towards those of its top level, and these towards those of all documents, each by
    `strength` documents. A null host has the share of all documents that have a host."""
    n = len(languages)
    counted = docs.select(host.alias("host"), declared.alias("declared"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    domain = F.when(domain == "", F.col("host")).otherwise(domain)
    sums = [F.sum((F.col("declared") == x).cast("long")) for x in languages]
    hosts = counted.filter("host is not null").groupBy("host").agg(*(F.coalesce(s, F.lit(0)).alias(f"h{k}") for k, s in enumerate(sums)))
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix_of(F.col("host")))
    hosts = materialize(hosts, "hosts")
    of = lambda by, mark: hosts.groupBy(by).agg(*(F.sum(f"h{k}").alias(f"{mark}{k}") for k in range(n)))
    domains, suffixes = of("domain", "d"), of("suffix", "s")
    total = hosts.agg(*(F.coalesce(F.sum(f"h{k}"), F.lit(0)).alias(f"t{k}") for k in range(n))).first()
    top = [(total[k] + 1) / (sum(total) + n) for k in range(n)]

    def smooth(mark: str, above: list[Column]) -> list[Column]:
        size = sum((F.col(f"{mark}{k}") for k in range(1, n)), F.col(f"{mark}0"))
        return [(F.col(f"{mark}{k}") + strength * above[k]) / (size + strength) for k in range(n)]

    joined = hosts.join(domains, "domain").join(suffixes, "suffix")
    prior = smooth("h", smooth("d", smooth("s", [F.lit(x) for x in top])))
    out = joined.select("host", F.array(*prior).alias("prior"))
    return out.union(docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("host"), F.array(*map(F.lit, top)).alias("prior")))


def suffix_evidence(docs: DataFrame, suffix: Column, declared: Column, languages: tuple[str, ...]) -> DataFrame:
    """(suffix, mark array<double>): the logarithm of each suffix's smoothed share of the declarations of each language."""
    n = len(languages)
    known = docs.select(suffix.alias("suffix"), declared.alias("declared")).filter("suffix is not null and declared is not null")
    counts = materialize(known.groupBy("suffix").agg(*(F.sum((F.col("declared") == x).cast("long")).alias(f"n{k}") for k, x in enumerate(languages))), "suffixes", keep=True)
    total = counts.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"t{k}") for k in range(n))).first()
    return counts.select("suffix", F.array(*(F.log((F.col(f"n{k}") + 1) / (total[f"t{k}"] + total["n"] + 1)) for k in range(n))).alias("mark"))


@tidy
def identify(docs: DataFrame, text_col: str = "text", declared_col: str | None = "lang", host: Column | None = None, address: Column | None = None, languages: tuple[str, ...] = LANGUAGES, model: Model | None = None, trust: float = 0.9, weight: int = 60, least: float = 0.5, strange: float = 12.0, most_rows: int = 20_000, columns: list[str] | None = None) -> DataFrame:
    """docs (or its given columns) with language, posterior and rejected, which replace columns of these names.

    Log posterior of a language = host prior + text + declaration + address suffix. Text: the mean log probability
    of the letter trigrams, times their number or `weight`, whichever is less, since neighbours aren't independent. A
    declared language (its first two letters) has probability `trust` under itself, and what remains is shared by the
    others; an address suffix counts by its smoothed share of declarations under each language. What is null, empty
    or unknown is no evidence. rejected: the text has no letters, or the best language has a posterior below `least`,
    or a text of 50 trigrams or more lies `strange` deviations below the usual probability under every language. A
    text without letters is `und`, posterior 0. Without any model (no declaration in the table), texts with
    letters are und and none is rejected for it. Each row is judged by itself, repeated or not.
    """
    n = len(languages)
    null = F.lit(None).cast("string")
    declared = F.lower(F.substring(F.col(declared_col), 1, 2)) if declared_col else null
    declared = F.when(declared.isin(*languages), declared)
    host = null if host is None else F.when(host != "", host)
    suffix = null if address is None else F.lower(address)
    model = model or (fit_model(docs, text_col, declared_col, languages, most_rows) if declared_col else None)
    added = ["language", "posterior", "rejected"]
    kept = [c for c in (columns or docs.columns) if c not in added]
    if model is None:
        blank = F.coalesce(~F.col(text_col).rlike(r"\p{L}"), F.lit(True))
        return docs.select(*kept, F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), blank.alias("rejected"))
    priors = materialize(host_priors(docs, host, declared, languages), "priors", keep=True)
    rated = docs.select(F.struct(*kept).alias("row"), *([] if text_col in kept else [F.col(text_col).alias("text")]), host.alias("host"), declared.alias("declared"), suffix.alias("suffix"))
    off = np.log((1 - trust) / max(1, n - 1))
    of_declared = {x: np.where(np.arange(n) == k, np.log(trust), off) for k, x in enumerate(languages)}
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets
    schema = T.StructType([rated.schema["row"], rated.schema["host"], rated.schema["suffix"], T.StructField("n", T.LongType()), T.StructField("evidence", T.ArrayType(T.DoubleType())), T.StructField("best", T.DoubleType())])

    def run(batches):
        m = shipped.value
        for batch in batches:
            counts, evidence, best = [], [], []
            texts = batch.column("row").field(text_col) if text_col in kept else batch.column("text")
            for text, d in zip(texts, batch.column("declared").to_pylist(), strict=True):
                k, means = m.means(text.as_py())
                total = means * min(k, weight) + of_declared.get(d, 0.0)
                counts.append(k)
                evidence.append((total - total.max()).tolist())
                best.append(float(means.max()) if k else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), batch.column("suffix"), pa.array(counts, pa.int64()), pa.array(evidence, pa.list_(pa.float64())), pa.array(best, pa.float64())], names=[f.name for f in schema.fields])

    scored = map_arrow(rated, run, schema)
    # the hosts' table is broadcast only where its measured size allows; else the join is shuffled, and split where a host is hot
    joined = scored.join(priors.withColumnRenamed("host", "_host"), scored.host.eqNullSafe(F.col("_host")), "left")
    if address is not None:
        marks = suffix_evidence(docs, suffix, declared, languages)
        joined = joined.join(marks, "suffix", "left").withColumn("evidence", F.when(F.col("mark").isNull(), F.col("evidence")).otherwise(F.zip_with("evidence", "mark", lambda e, x: e + x)))
    mixed = F.zip_with("evidence", "prior", lambda e, p: F.exp(e + F.log(p)))
    joined = joined.withColumn("mass", mixed).withColumn("all", F.aggregate("mass", F.lit(0.0), lambda a, x: a + x))
    top = F.array_max("mass")
    language = F.element_at(F.array(*map(F.lit, languages)), F.array_position("mass", top).cast("int"))
    usual, spread = model.typical
    odd = (F.col("n") >= 50) & (F.col("best") < usual - strange * spread) if spread else F.lit(False)
    blank = F.col("n") == 0
    out = joined.select("row", F.when(blank, "und").otherwise(language).alias("language"), F.when(blank, 0.0).otherwise(top / F.col("all")).alias("posterior"), odd.alias("odd"))
    return out.select("row.*", "language", "posterior", ((F.col("posterior") < least) | F.col("odd")).alias("rejected"))
