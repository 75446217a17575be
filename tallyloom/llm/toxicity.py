"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding look-alike characters, normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from .scratch import discard, materialize

# Cyrillic, Greek and rare Latin letters that look like Latin ones, then digits and signs that stand for letters.
_LOOK_ALIKE = ("абвгеікмнорсԁтухѕјһԛԝѵα βγεικνορτυχıɑɡɩʟɴʀʏ", "abbreikmhopcdtyxsjhqwva byeikvoptuxiagilnry")
_SUBSTITUTES = ("0134578@$", "oieastbas")
_FOLD = str.maketrans("".join(x[0] for x in (_LOOK_ALIKE, _SUBSTITUTES)), "".join(x[1] for x in (_LOOK_ALIKE, _SUBSTITUTES)))
_FOLD |= dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_BETWEEN = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Words in one spelling, each between single blanks: compatibility forms, case, homoglyphs and digit substitutions folded."""
    folded = unicodedata.normalize("NFKC", text or "").lower().translate(_FOLD)
    return f" {_BETWEEN.sub(' ', folded).strip()} "


@dataclass
class Lexicon:
    """weights: of terms, ` idiot ` being a whole word and ` idio` any word with that beginning. score = logistic of
    bias + total * ln(1 + S) + density * S / sqrt(n), S being the weights matched and n the number of words."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    bias: float = -4.0
    total: float = 3.0
    density: float = 1.0
    setting: tuple | None = None  # support, lift and damping of the fit
    _machine: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    def matched(self, folded: str) -> float:
        """The sum of the weights of all matches outside exception phrases."""
        if self._machine is None:
            machine = ahocorasick.Automaton()
            for term, w in self.weights.items():
                machine.add_word(term, (len(term), w, False))
            for phrase in self.exceptions:
                term = fold(phrase)
                machine.add_word(term, (len(term), 0.0, True))
            if len(machine):
                machine.make_automaton()
            self._machine = machine
        if not len(self._machine):
            return 0.0
        hits = list(self._machine.iter(folded))
        if not any(x[2] for _, x in hits):
            return sum(x[1] for _, x in hits)
        spared = sorted((end - n + 1, end) for end, (n, _, exception) in hits if exception)
        starts, upto = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        # inside a phrase if, of all phrases that start no later, one ends no earlier
        inside = lambda a, b: (k := bisect_right(starts, a)) and upto[k - 1] >= b
        return sum(w for end, (n, w, exception) in hits if not exception and not inside(end - n + 1, end))

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        s = self.matched(folded)
        return math.log1p(s), s / math.sqrt(max(1, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + self.total * a + self.density * b))))


def _terms(folded: str, least: int, most: int) -> Counter:
    """How often each whole word, and each beginning of a word, occurs."""
    out: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        out[f" {w} "] += n
        for k in range(least, min(most, len(w)) + 1):
            out[f" {w[:k]}"] += n
    return out


def _phrases(folded: str, beginnings: set[str], words: set[str], longest: int) -> set[str]:
    """Each two words in a row of which one matches the lexicon."""
    listed = folded.split()
    hit = [w in words or any(w[:k] in beginnings for k in range(1, min(longest, len(w)) + 1)) for w in listed]
    return {f"{a} {b}" for a, b, x, y in zip(listed, listed[1:], hit, hit[1:], strict=False) if x or y}


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, y) of at most about `most` labelled documents, chosen by a hash of their ids, equal ones once; ids labelled both ways are left out."""
    known = labels.filter(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col)
    known = known.agg(F.min(label_col).alias("low"), F.max(label_col).alias("y")).filter("low = y").select(F.col(id_col).alias("id"), "y")
    n = known.count()
    share = min(1.0, most / max(1, n))
    known = known.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    # about `most` ids and labels at most, whatever the number of labels
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    return materialize(joined.groupBy("text", "y").agg(F.count("*").alias("copies")).drop("copies"), "labelled")


#: Parts of the training rows for cross-validation, and the settings that it chooses among: least toxic documents of a term, least lift, damped counts.
FOLDS = 10
SUPPORTS, LIFTS, DAMPED = (3, 5), (2.5, 4.0), (True, False)
_COUNTS = [f"{c}{f}" for c in ("neg", "pos", "dneg", "dpos") for f in range(FOLDS)]


def _wilson(pos: np.ndarray, n: np.ndarray, side: int, z: float = 1.96) -> np.ndarray:
    """The lower (side -1) or upper (1) bound of the shares pos / n."""
    n = np.maximum(n, 1e-9)
    p = pos / n
    return (p + z * z / (2 * n) + side * z * np.sqrt(np.maximum(p * (1 - p), 0.0) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _fold_of(text: str | None) -> int:
    return zlib.crc32((text or "").encode()) % FOLDS


class _Terms:
    """The terms of the training rows with their counts in each fold (terms x neg, pos, dneg, dpos x folds); dneg and dpos are damped, in thousandths."""

    def __init__(self, terms: list[str], counts: np.ndarray, rows: np.ndarray):
        order = sorted(range(len(terms)), key=lambda k: (len(terms[k]), terms[k]))
        self.terms, self.counts, self.rows = [terms[k] for k in order], counts[order], rows

    def lexicon(self, without: int | None, support: int, lift: float, damped: bool) -> dict[str, float]:
        """The terms that enter, learned from all folds but one, and their weights. Of nested terms the longest enters that has nine tenths of the shorter one's count."""
        use = [f for f in range(FOLDS) if f != without]
        neg, pos = (self.rows[y][use].sum() for y in (0, 1))
        if not neg or not pos:
            return {}
        base = pos / (neg + pos)
        totals = self.counts[:, :, use].sum(axis=2)
        toxic = totals[:, 1]
        no, yes = (totals[:, 2] / 1000, totals[:, 3] / 1000) if damped else (totals[:, 0].astype(float), toxic.astype(float))
        low = _wilson(yes, no + yes, -1)
        chosen: dict[str, float] = {}
        held: dict[str, float] = {}
        need = support if without is None else max(2, round(support * (FOLDS - 1) / FOLDS))  # the same share of the rows
        for k in np.flatnonzero((toxic >= need) & (low >= min(0.5, lift * base))).tolist():
            term = self.terms[k]
            covers = next((t for t in (term[:n] for n in range(2, len(term))) if t in chosen), None)
            if covers is not None:
                if yes[k] < 0.9 * held[covers]:
                    continue
                del chosen[covers]
            chosen[term] = math.log(low[k] / (1 - low[k])) - math.log(base / (1 - base))
            held[term] = yes[k]
        return chosen


def _validated(sample: DataFrame, terms: _Terms, settings: list[tuple]) -> tuple:
    """The first setting, the one with the most terms before others, whose loss on rows that its lexicon hasn't seen is within a standard error of the least; the first of all
    where a fold has all labels of one kind."""
    if len(settings) == 1 or any(not (terms.rows[y].sum() - terms.rows[y][f]) for y in (0, 1) for f in range(FOLDS)):
        return settings[0]
    tables = []
    for f in range(FOLDS):
        lexicons = [terms.lexicon(f, *x) for x in settings]
        union = sorted({t for x in lexicons for t in x})
        tables.append((union, np.array([[x.get(t, 0.0) for x in lexicons] for t in union], dtype=np.float32).reshape(-1, len(settings))))
    shared = sample.sparkSession.sparkContext.broadcast(tables)  # of the size of the lexicon, which the bounded sample bounds
    machines: dict[int, object] = {}

    def sums(batches):
        for f, (union, _) in enumerate(shared.value):
            machine = ahocorasick.Automaton()
            for k, term in enumerate(union):
                machine.add_word(term, k)
            if union:
                machine.make_automaton()
            machines[f] = machine
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                folded, f = fold(text), _fold_of(text)
                hits = [k for _, k in machines[f].iter(folded)] if len(machines[f]) else []
                out.append((max(1, folded.count(" ") - 1), shared.value[f][1][hits].sum(axis=0, dtype=np.float64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.float64())), batch.column("y").cast(pa.int64())], names=["n", "s", "y"])

    rows = map_arrow(sample, sums, "n long, s array<double>, y long").toPandas()  # a few numbers for each row of the bounded sample
    y, n = rows["y"].to_numpy(), rows["n"].to_numpy()
    matched = np.stack(rows["s"].to_list())
    losses = []
    for k in range(len(settings)):
        x = np.column_stack([np.log1p(matched[:, k]), matched[:, k] / np.sqrt(n)])
        w = _logistic(x, y)
        chance = 1 / (1 + np.exp(-np.clip(w[0] + x @ np.array(w[1:]), -30, 30)))
        losses.append(-np.where(y == 1, np.log(chance), np.log1p(-chance)))
    shared.unpersist()
    best = losses[int(np.argmin([x.mean() for x in losses]))]
    worse = [(x - best) for x in losses]
    return next(z for z, d in zip(settings, worse, strict=True) if d.mean() <= d.std() / np.sqrt(len(d)) + 1e-12)


def fit_lexicon(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", support: int | None = None, lift: float | None = None, damped: bool | None = None, prefix: tuple[int, int] = (4, 8), exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled documents: the fit reads about most_rows of them (a documented bound), chosen by hash.

    Terms are words and beginnings of words. A term that stands in `support` toxic documents or more enters if the lower Wilson bound of the toxic share of
    its counts reaches `lift` times the share of toxic documents, or one half; its weight is the log odds of that bound over those of
    the share, so that what was seen rarely weighs little. Damped counts have log2(1 + n) for a document in which a term occurs n times, others 1. Which of SUPPORTS, LIFTS and
    DAMPED hold, unless they are given, is chosen by cross-validation over FOLDS parts of the same labelled rows (dealt by a hash of the text), by the loss on the rows left out. Of nested terms the longest enters that has nine tenths of the shorter
    one's count. Two words in a row, one of which matches, are an exception
    if the upper bound of their toxic share lies below the share of toxic documents; `exceptions` adds phrases. The lexicon's size follows from most_rows. Without
    labels of both kinds it is empty.
    """
    sample = training_rows(docs, labels, usable if usable is not None else F.lit(True), most_rows, id_col, text_col, label_col)
    settings = [(a, b, c) for c in (DAMPED if damped is None else (damped,)) for b in (LIFTS if lift is None else (lift,)) for a in (SUPPORTS if support is None else (support,))]

    def count(batches):
        tally: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                text = text.as_py()
                f = _fold_of(text)
                for term, n in [("", 1), *_terms(fold(text), *prefix).items()]:
                    found = tally.setdefault((term, f), [0, 0, 0, 0])
                    found[y] += 1
                    found[2 + y] += round(1000 * math.log2(1 + n))
                if len(tally) > 100_000:
                    yield _fold_counts(tally)
                    tally = {}
        yield _fold_counts(tally)

    counts = map_arrow(sample, count, "term string, fold int, neg long, pos long, dneg long, dpos long").groupBy("term")
    counts = counts.agg(*(F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(f"{c}{f}") for c in ("neg", "pos", "dneg", "dpos") for f in range(FOLDS)))
    toxic = sum((F.col(f"pos{f}") for f in range(FOLDS)), F.lit(0))
    enough = counts.filter((F.col("term") == "") | (toxic >= min(x[0] for x in settings)))
    counts = materialize(enough, "terms")
    whole = next(iter(counts.filter("term = ''").collect()), None)
    rows = np.array([[whole[f"{c}{f}"] if whole else 0 for f in range(FOLDS)] for c in ("neg", "pos")])
    negatives, positives = rows.sum(axis=1).tolist()
    if not negatives or not positives:
        discard(sample)
        discard(counts)
        return Lexicon({}, exceptions)
    base = positives / (negatives + positives)
    # a term whose plain and damped shares are below the least lift in all folds, and without each, enters no lexicon
    listed = counts.filter("term <> ''")
    share = [sum((F.col(f"{d}pos{f}") for f in use), F.lit(0)) / sum((F.col(f"{d}{c}{f}") for c in ("neg", "pos") for f in use), F.lit(1e-9)) for d in ("", "d") for use in [[*range(FOLDS)], *([g for g in range(FOLDS) if g != f] for f in range(FOLDS))]]
    listed = listed.filter(F.greatest(*share) >= 0.5 * min(0.5, min(x[1] for x in settings) * base)).toPandas()
    discard(counts)
    terms = _Terms(listed["term"].tolist(), listed[_COUNTS].to_numpy(dtype=np.int64).reshape(len(listed), 4, FOLDS), rows)
    setting = _validated(sample, terms, settings)
    chosen = terms.lexicon(None, *setting)
    words, beginnings = {t.strip() for t in chosen if t.endswith(" ")}, {t.strip() for t in chosen if not t.endswith(" ")}

    def phrases(batches):
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for phrase in _phrases(fold(text), beginnings, words, prefix[1]):
                    found = tally.setdefault(phrase, [0, 0, 0])
                    found[y] += 1
                    found[2] += y
            yield _counts(tally)

    seen = map_arrow(sample, phrases, "term string, neg long, pos long, docs long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    # the upper bound of a share can't lie below it
    seen = seen.filter(F.col("pos") < base * (F.col("pos") + F.col("neg"))).orderBy(F.desc("neg"), "term").toPandas()
    low_enough = _wilson(seen["pos"].to_numpy(dtype=float), (seen["pos"] + seen["neg"]).to_numpy(dtype=float), 1) < base
    lexicon = Lexicon(chosen, (*exceptions, *seen["term"][low_enough].tolist()), setting=setting)

    def features(batches):
        for batch in batches:
            x = [lexicon.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column("y").cast(pa.int64())], names=["a", "b", "y"])

    rows = map_arrow(sample, features, "a double, b double, y long").toPandas()  # three numbers for each row of the bounded sample
    lexicon.bias, lexicon.total, lexicon.density = _logistic(rows[["a", "b"]].to_numpy(), rows["y"].to_numpy())
    lexicon._machine = None
    discard(sample)
    return lexicon


def _fold_counts(tally: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
    columns = zip(*tally.values(), strict=True) if tally else ([], [], [], [])
    keys = [pa.array([t for t, _ in tally], pa.string()), pa.array([f for _, f in tally], pa.int32())]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int64()) for c in columns)], names=["term", "fold", "neg", "pos", "dneg", "dpos"])


def _counts(tally: dict[str, list[int]]) -> pa.RecordBatch:
    columns = zip(*tally.values(), strict=True) if tally else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["term", "neg", "pos", "docs"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, float, float]:
    """Newton's method with a small ridge, on rows in a fixed order; coefficients of matches aren't negative."""
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    x, y = np.column_stack([np.ones(len(x)), x])[order], y[order]
    free = np.array([True, True, True])
    while True:
        w = np.zeros(3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (y - p) - ridge * w * [0.0, 1.0, 1.0]
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, ridge, ridge])
            step = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w[free] += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        bad = (w < 0) & free & [False, True, True]
        if not bad.any():
            return float(w[0]), float(w[1]), float(w[2])
        free &= ~bad


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "toxicity", columns: list[str] | None = None) -> DataFrame:
    """docs (or its given columns) with score_col, from 0 to 1, of each whole text; null counts as empty. A column of that name is replaced."""
    kept = [c for c in (columns or docs.columns) if c != score_col]
    docs = docs.select(*kept, *([] if text_col in kept else [text_col]))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for batch in batches:
            scores = pa.array([lexicon.score(t.as_py()) for t in batch.column(text_col)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores], names=[*kept, score_col])

    return map_arrow(docs, run, schema)
