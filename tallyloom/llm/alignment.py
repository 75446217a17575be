"""Alignment of two tokenizers: minimal groups of tokens that cover the same bytes, and how often tokens overlap in a corpus.

Two tokens are linked if their byte ranges overlap; the connected components of these links are the minimal groups, since a
place where tokens of both sides end is spanned by no link. Neither vocabulary joins a space to what stands before it,
so texts are cut before spaces, and each distinct word of a portion of texts is aligned once.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from .batches import array_of, decimal_text, gathered, portions, slices
from .bpe import ByteBPE
from .scratch import materialize, tidy

#: Cuts that neither vocabulary spans: before a space, after what is not white space.
_BREAK = re.compile(r"(?<=\S)(?= )")
#: Texts in which a space follows white space, or stands first, are not cut at each space.
_UNEVEN = r"^ |[\s\x0b\x1c-\x1f\x85\p{Z}] "


class UnionFind:
    """Disjoint sets of the numbers below n; a set's label is its least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        """Unite the sets of i[k] and j[k] for all k: roots are hooked to the least root that a link offers, and paths halved, until no
        link joins two sets."""
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of tokens whose ranges overlap, in order; the ends ascend and both reach the same place. Tokens i and j share one
    stretch without an end inside, so each stretch between neighbouring ends is one pair."""
    begins = np.union1d(a_ends, b_ends)
    begins = np.concatenate([[0], begins[:-1]]) if len(begins) else begins
    return np.searchsorted(a_ends, begins, side="right"), np.searchsorted(b_ends, begins, side="right")


def minimal_groups(n_a: int, n_b: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side, numbered in order, given the overlapping pairs (i, j)."""
    sets = UnionFind(n_a + n_b)
    sets.unite(i, n_a + j)
    _, number = np.unique(sets.label, return_inverse=True)
    return number[:n_a], number[n_a:]


class Aligner:
    """Aligns words by a byte-level vocabulary (A) and a sentencepiece model (B)."""

    def __init__(self, model_a: str, model_b: bytes):
        import sentencepiece

        spec = json.loads(model_a)
        spec["added_tokens"], spec["post_processor"] = [], None  # special tokens' strings are plain text
        self._a = ByteBPE(json.dumps(spec))
        self._a.forget()
        self._b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        pieces = [self._b.id_to_piece(k) for k in range(self._b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that hold a space after other characters aren't supported")
        self._space = self._b.piece_to_id("▁")
        b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(k) else b"" if self._b.is_control(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self._sides = []  # of A and B: each id's length, and its bytes in one array
        for table in (self._a.table, b_bytes):
            lengths = np.array([len(x) for x in table], dtype=np.int64)
            self._sides.append((lengths, np.frombuffer(b"".join(table), dtype=np.uint8), np.cumsum(lengths) - lengths))
        self.width = len(pieces)  # a pair's key is a * width + b

    def words(self, text: str) -> list[str]:
        return _BREAK.split(" " + text)

    def _encode(self, words: list[str], size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B the ids of all words, one after the other, and their numbers; each word starts with a space and is of `size` bytes."""
        ragged = [k for k, w in enumerate(words) if w[-1].isspace()]
        if ragged:  # what follows white space may join it
            single = [self._a.ids_of(w) for w in words]
            a = np.concatenate(single).astype(np.int64), np.array([len(x) for x in single], dtype=np.int64)
        else:  # one text, as no token spans two words; told apart by bytes
            ids = self._a.ids_of("".join(words)).astype(np.int64)
            stops = np.searchsorted(np.cumsum(self._sides[0][0][ids]), np.cumsum(size)) + 1
            a = ids, np.diff(stops, prepend=0)
        lists = self._b.encode([w[1:] for w in words], num_threads=1)
        for k in ragged:
            if words[k] == " ":  # the model adds the first space, but to an empty text
                lists[k] = [self._space]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return [a, (np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(counts.sum())), counts)]

    def align(self, words: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """For distinct words that start with a space: the numbers of A and B tokens, groups and links (words x 4), each one's groups as text, the keys of the
        links of all words in order, and whether both sides give the word's bytes."""
        portions_ = [self._align(words[s : s + 16384]) for s in range(0, len(words), 16384)]
        if not portions_:
            return np.zeros((0, 4), dtype=np.int64), [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        numbers, shown, keys, fine = zip(*portions_, strict=True)
        return np.concatenate(numbers), list(chain.from_iterable(shown)), np.concatenate(keys), np.concatenate(fine)

    def _align(self, words: list[str]):
        loose = [k for k, w in enumerate(words) if w[-1].isspace()]
        if loose and len(loose) < len(words):  # those that end in white space by themselves, so that the others are encoded as one text
            whole = sorted(set(range(len(words))) - set(loose))
            numbers, shown, fine = np.zeros((len(words), 4), dtype=np.int64), [b""] * len(words), np.zeros(len(words), dtype=bool)
            keys: list = [None] * len(words)
            for some in (whole, loose):
                n, text, k, good = self._align([words[x] for x in some])
                numbers[some], fine[some] = n, good
                for x, t, link in zip(some, text, np.split(k, np.cumsum(n[:, 3])[:-1]), strict=True):
                    shown[x], keys[x] = t, link
            return numbers, shown, np.concatenate(keys), fine
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        joined = np.frombuffer(b"".join(raw), dtype=np.uint8)
        owner = np.repeat(np.arange(len(words)), size)
        fine = np.ones(len(words), dtype=bool)
        encoded = self._encode(words, size)
        for (ids, counts), (lengths, flat, starts) in zip(encoded, self._sides, strict=True):
            total = np.concatenate([[0], np.cumsum(lengths[ids])])
            ends = np.cumsum(counts)
            same = total[ends] - total[ends - counts] == size
            fine &= same
            back = gathered(flat, starts[ids], lengths[ids])
            if same.all():
                fine[owner[back != joined]] = False
            else:
                cut = np.split(back, total[ends][:-1])
                fine &= [a.tobytes() == b for a, b in zip(cut, raw, strict=True)]
        (ids_a, n_a), (ids_b, n_b) = ((ids[np.repeat(fine, counts)], counts * fine) for ids, counts in encoded)
        i, j = overlaps(np.cumsum(self._sides[0][0][ids_a]), np.cumsum(self._sides[1][0][ids_b]))
        group_a, group_b = minimal_groups(len(ids_a), len(ids_b), i, j)
        word_a = np.repeat(np.arange(len(words)), n_a)
        first = np.flatnonzero(np.diff(group_a, prepend=-1))
        numbers = np.stack([n_a, n_b, np.bincount(word_a[first], minlength=len(words)), np.bincount(word_a[i], minlength=len(words))], axis=1)
        # the groups as text: the ids of both sides by group, each with what follows it
        place = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(place, kind="stable")
        place, ids = place[order], np.concatenate([ids_a, ids_b])[order]
        step = np.diff(place, append=-1)
        text, ends = decimal_text(ids, np.where(step == 0, ord(","), np.where((step == 1) & (place % 2 == 0), ord("|"), ord(";"))).astype(np.uint8))
        upto = np.cumsum(n_a + n_b)
        return numbers, slices(text, np.concatenate([[0], ends])[upto], 1), ids_a[i] * self.width + ids_b[j], fine


_loaded: dict[str, Aligner] = {}


def load(model_a: str, model_b: bytes) -> Aligner:
    key = hashlib.sha256(model_a.encode() + model_b).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(model_a, model_b)
    return _loaded[key]


def align_texts(aligner: Aligner, texts: pa.Array):
    """For each text of a string array (null as empty): numbers of A and B tokens, groups and links (n x 4), the groups as bytes, and the links' keys. A text that either side can't give back has none of them."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    numbers, groups, keys = np.zeros((n, 4), dtype=np.int64), [b""] * n, [np.zeros(0, dtype=np.int64)] * n
    uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
    lists: list[tuple[int, list[int]]] = []
    vocabulary: dict[str, int] = {}
    rows = np.flatnonzero(~uneven)
    if len(rows):
        cut = pc.split_pattern(texts.take(pa.array(rows)), " ")
        numbered = cut.flatten().dictionary_encode()
        vocabulary = {" " + w: k for k, w in enumerate(numbered.dictionary.to_pylist())}
        at, offsets = numbered.indices.to_numpy(zero_copy_only=False).tolist(), cut.offsets.to_numpy()
        offsets = (offsets - offsets[0]).tolist()
        lists = [(row, at[s:e]) for row, s, e in zip(rows.tolist(), offsets, offsets[1:], strict=False)]
    for row in np.flatnonzero(uneven).tolist():
        lists.append((row, [vocabulary.setdefault(w, len(vocabulary)) for w in aligner.words(texts[row].as_py())]))
    figures, shown, links, good = aligner.align(list(vocabulary))
    starts = np.cumsum(figures[:, 3]) - figures[:, 3]
    empty = (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0).tolist()
    for row, words in lists:
        at = np.array(words)
        if empty[row] or not good[at].all():
            continue
        numbers[row] = figures[at].sum(axis=0)
        groups[row] = b";".join([shown[k] for k in words])
        keys[row] = gathered(links, starts[at], figures[at, 3])
    return numbers, groups, keys


@tidy
def align_corpus(docs: DataFrame, model_a: str, model_b: bytes, id_col: str = "doc_id", text_col: str = "text", portion: int = 4 << 20) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for each row of docs.

    Side A encodes a space and the text, side B the text, to which its model adds the space; neither knows special tokens.
    Groups are cut where tokens of both sides end. A link is a pair of tokens of either side whose bytes overlap; a pair's count is how many rows of
    docs hold it linked. n_best counts the links whose count is the highest of all pairs of their A id (ties included), count_sum adds up all
    links' counts. groups_sha256 is the hash of the groups' ids as in 'a1,a2|b1;a3|b2'.

    Null and empty texts, and texts that either side's tokens don't give back byte by byte (such as those that hold U+2581), have zeros and ''. Rows that repeat,
    and null ids, are rows of their own and count each. A table without rows gives none. Other columns are ignored, so their names can't clash.

    A task aligns portions of texts. A portion's distinct pairs, with the number of its texts that hold each, are summed for the
    corpus, and its pairs' totals come back to it in one join: links don't travel one by one, and a pair has one row a portion at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model_a, model_b))  # fixed vocabularies
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    fields = [("portion", T.LongType()), ("pairs", longs), ("texts", ints), ("id", docs.schema[id_col].dataType), *((c, T.LongType()) for c in counts), ("groups_sha256", T.StringType()), ("steps", ints), ("times", ints)]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches):
        aligner = load(*shared.value)
        number = TaskContext.get().partitionId() << 32
        for k, table in enumerate(portions(batches, portion)):
            numbers, groups, keys = align_texts(aligner, array_of(table, "text"))
            rows = [np.unique(x, return_counts=True) for x in keys]
            ends = np.cumsum([0] + [len(r[0]) for r in rows]).astype(np.int32)
            pairs, place, held = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True, return_counts=True)
            place = place.astype(np.int32)
            steps = np.diff(place, prepend=np.int32(0)).astype(np.int32)  # a row's pairs ascend: small steps, which pack well
            begins = ends[:-1][np.diff(ends) > 0]
            steps[begins] = place[begins]
            times = np.concatenate([r[1] for r in rows]).astype(np.int32)
            n = table.num_rows
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (steps, times)]
            digests = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups])
            ids = array_of(table, "id")
            none = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number + k)), *none, ids, *(pa.array(numbers[:, c]) for c in range(4)), digests, *lists], names=schema.names)
            own = [pa.array([number + k]), pa.array([pairs], pa.list_(pa.int64())), pa.array([held.astype(np.int32)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(1, ids.type if c == "id" else f) for c, f in (("id", None), *((c, pa.int64()) for c in counts), ("g", pa.string()), ("s", pa.list_(pa.int32())), ("t", pa.list_(pa.int32()))))], names=schema.names)

    rows = materialize(map_arrow(base, run, schema), "aligned", keep=True)
    width = len(_pieces(model_b))
    held = rows.filter(F.col("pairs").isNotNull()).select(F.col("portion").alias("of"), F.posexplode(F.arrays_zip("pairs", "texts")).alias("at", "x")).select("of", "at", F.col("x.pairs").alias("pair"), F.col("x.texts").alias("texts"))
    totals = held.groupBy("pair").agg(F.sum("texts").alias("n")).withColumn("a", F.expr(f"pair div {width}"))
    # an A id has no more pairs than B has ids
    totals = totals.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).alias("best"))
    back = held.select("of", "at", "pair").join(totals, "pair").select("of", "at", "n", "best")

    def finish(key, ours, theirs):
        n = np.zeros(theirs.num_rows, dtype=np.int64)
        best = np.zeros(theirs.num_rows, dtype=np.int64)
        at = theirs.column("at").to_numpy()
        n[at] = theirs.column("n").to_numpy()
        best[at] = theirs.column("best").to_numpy()
        lists = array_of(ours, "steps")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        steps = lists.flatten().to_numpy().astype(np.int64)
        times = array_of(ours, "times").flatten().to_numpy()
        # running sums of the steps, beginning anew with each row
        run_ = np.cumsum(steps)
        before = np.concatenate([[0], run_])[ends[:-1]]
        place = run_ - np.repeat(before, np.diff(ends))
        made = []
        for value in (best, n):
            total = np.concatenate([[0], np.cumsum(value[place] * times)])
            made.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
        return pa.table([ours.column("id"), *(ours.column(c) for c in counts), *made, ours.column("groups_sha256")], names=out_names)

    out_names = [id_col, *counts, "n_best", "count_sum", "groups_sha256"]
    out = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in out_names[1:-1]), T.StructField("groups_sha256", T.StringType())])
    texts = rows.filter(F.col("pairs").isNull()).select("portion", "id", *counts, "groups_sha256", "steps", "times")
    return texts.groupBy("portion").cogroup(back.groupBy("of")).applyInArrow(finish, out)


def _pieces(model_b: bytes) -> range:
    import sentencepiece

    return range(sentencepiece.SentencePieceProcessor(model_proto=model_b).get_piece_size())
