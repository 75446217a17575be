"""Packing token streams into sequences, in document order, by dynamic programming over the places to cut."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..shipping import map_arrow

#: Letters that are one code point under Unicode normalisation and stay letters in lower case.
_LETTER = "A-Za-zªºÀ-ÖØ-öø-įı-ž"
#: Texts without other characters than these, ASCII signs and blanks, and without the <| of special tokens, are cut into words
#: and the tokenizer's own pieces here.
_OTHER = rf"[^\t-\r -~{_LETTER}]|<\|"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\t-\r {_LETTER}0-9]+")


class PieceEncoder:
    """Ids of whole texts by a lower-casing tokenizers vocabulary whose tokens never span white space, and whose pieces are
    contractions, runs of letters, single digits and runs of other signs. Arrow cuts texts into words and numbers the
    distinct ones; a word is encoded once and remembered, up to a bound. The ids are those of encoding the whole text."""

    def __init__(self, model: str, remembered: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_str(model)
        self._letters = Tokenizer.from_str(model)
        self._letters.normalizer = None
        self._letters.model._resize_cache(0)  # each run of letters comes once
        self._letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._remembered, self._known = remembered, {}
        vocab = self._tokenizer.get_vocab()
        self.sentence_ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self._word_ends = self.sentence_ends.copy()
        for token, i in vocab.items():
            word = token.removesuffix("</w>")
            self._word_ends[i] = word != token
            if word != token and word and set(word) <= set(".!?\"')") and set(word) & set(".!?"):
                self.sentence_ends[i] = True

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array; null counts as empty."""
        texts = pc.fill_null(texts, "")
        other = pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for rows, plain in ((np.flatnonzero(~other), True), (np.flatnonzero(other), False)):
            if not len(rows):
                continue
            words = pc.ascii_split_whitespace(texts if len(rows) == len(texts) else texts.take(pa.array(rows)))
            numbered = words.flatten().dictionary_encode()
            ids, lengths = self._ids_of(numbered.dictionary.to_pylist(), plain)
            starts = np.cumsum(lengths, dtype=np.int32) - lengths
            at = numbered.indices.to_numpy(zero_copy_only=False)
            counts = lengths[at]
            upto = np.zeros(len(at) + 1, dtype=np.int32)  # a portion has far fewer tokens than 2^31
            np.cumsum(counts, out=upto[1:])
            places = np.repeat(starts[at] - upto[:-1], counts)
            places += np.arange(len(places), dtype=np.int32)
            stream = ids[places]
            offsets = words.offsets.to_numpy()
            ends = upto[offsets - offsets[0]].tolist()
            for row, a, b in zip(rows.tolist(), ends, ends[1:], strict=False):
                out[row] = stream[a:b]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def _ids_of(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the number of each word's ids."""
        known = self._known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self._remembered:
            known.clear()
            new = words
        if new:
            self._learn(new, plain)
        found = [known[w] for w in words]
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int32, count=len(found)) >> 2

    def _learn(self, words: list[str], plain: bool) -> None:
        """Words of plain texts are cut into pieces. Runs of letters are encoded in one go: of their tokens, the last ones alone
        end a run. Other pieces, and the words of other texts, are encoded by themselves."""
        known = self._known
        if not plain:
            for w, e in zip(words, self._tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()
            return
        lower = [w.lower() for w in words]
        mixed = {w: _PIECES.findall(w) for w in lower if not w.isalpha()}
        pieces = {w for w in lower if w.isalpha()}.union(*mixed.values()).difference(known)
        letters = [p for p in pieces if p[0].isalpha()]
        ids = np.array(self._letters.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self._word_ends[ids]) + 1
        if len(ends) == len(letters):
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            known.update(zip(letters, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        rest = [p for p in pieces if p not in known]
        for p, e in zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[p] = np.array(e.ids, dtype="<u4").tobytes()
        find = known.__getitem__
        known.update([(w, b"".join(map(find, x))) for w, x in mixed.items()])
        known.update(zip(words, map(find, lower), strict=True))


def choose_cuts(places: np.ndarray, penalties: np.ndarray, total: int, window: int, inside: float) -> list[int]:
    """The cuts of a stream of `total` tokens, ascending, the last at total, into sequences of at most `window`, at least cost.

    places are the tokens before which a cut is natural (ascending, in (0, total)), penalties their costs. A sequence
    costs its padding up to the window, a cut at any other token costs `inside`. Between two chosen places i and j there are
    k = ceil((j - i) / window) sequences, all but the last full windows:
    best(j) = penalty(j) + min over all i < j of best(i) + k*window - (j - i) + (k-1)*inside.
    With i = q*window + r, k is q(j) - q(i), and one more where r(i) < r(j). With g(i) = best(i) + i - q(i)*(window + inside),
    g(j) = penalty(j) - inside + the least of g(i) over those with r(i) >= r(j), and of g(i) + window + inside over all. The
    former are kept in a monotone queue in the order of r: a place leaves it when one with r not below its own has no
    larger g, or when the least over all, a window added, is no larger; the first one from r(j) on is the least of its range.
    """
    at = np.concatenate([[0], places, [total]]).astype(np.int64)
    left = (at % window).tolist()
    cost = [0.0, *penalties.tolist(), 0.0]
    n, unit = len(cost), window + inside
    source = [0] * n
    rests, values, owners = [0], [0.0], [0]  # the queue: r ascending, and with it the values
    low, lowest = 0.0, 0
    for j in range(1, n):
        r = left[j]
        k = bisect_left(rests, r)
        if k < len(rests) and values[k] <= low + unit:
            least, source[j] = values[k], owners[k]
        else:
            least, source[j] = low + unit, lowest
        mine = least + cost[j] - inside
        if mine < low:
            low, lowest = mine, j
        if k < len(rests) and values[k] <= mine:
            continue
        stop = k + 1 if k < len(rests) and rests[k] == r else k
        while k and values[k - 1] >= mine:
            k -= 1
        rests[k:stop], values[k:stop], owners[k:stop] = [r], [mine], [j]
        while values[-1] >= low + unit:
            rests.pop(), values.pop(), owners.pop()
    cuts, j = [], n - 1
    at = at.tolist()
    while j:
        i = source[j]
        cuts += [at[j], *range(at[i] + window * ((at[j] - at[i] - 1) // window), at[i], -window)]
        j = i
    return cuts[::-1]


def split_tail(length: int) -> list[int]:
    """A last, short sequence as lengths that are powers of two, the largest first: these need no padding."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


_loaded: dict[tuple[str, int], PieceEncoder] = {}


def _encoder(model: str, remembered: int) -> PieceEncoder:
    """The worker's encoder, which goes on from task to task."""
    key = hashlib.sha256(model.encode()).hexdigest(), remembered
    if key not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded.clear()
        _loaded[key] = PieceEncoder(model, remembered)
    return _loaded[key]


def _portions(batch: pa.RecordBatch, most: int):
    """The batch in slices whose texts have about `most` bytes, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    number = (np.cumsum(size, dtype=np.int64) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def pack(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, sentence_cost: float = 8, inside_cost: float = 24, stretch: int = 1 << 21, remembered: int = 1_000_000, portion: int = 1 << 23, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids too with with_ids.

    A document's ids are those of the tokenizers vocabulary at model_path, then end_id; null counts as empty. The
    documents of an input partition are taken in their order as one stream, cut at the end of a document (free), of a
    sentence, or inside one, at a cost in tokens, so that padding and these costs are least; see choose_cuts. A long
    stream is solved in stretches of at least `stretch` tokens, the last open sequence of one going on in the next,
    which bounds memory. What is left at a partition's end is split into powers of two. Each input partition is a
    stream of its own, so nothing is shuffled, and a task that runs again gives the same pieces. sequence_id has the
    partition in its upper bits. A Python worker keeps the ids of up to `remembered` words, some 200 bytes each, to encode
    them once, and takes texts of `portion` bytes at a time, at some twenty times their size: less of either needs less memory
    and more time. Rows that repeat an id, and null ids, are documents of their own; other columns are ignored.
    """
    with_text = docs.select(id_col, text_col)
    with open(model_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed vocabulary
    long = T.LongType()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, long) for c in names), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches):
        encoder = _encoder(model.value, remembered)
        flags = np.zeros(max(len(encoder.sentence_ends), end_id + 1), dtype=bool)
        flags[: len(encoder.sentence_ends)] = encoder.sentence_ends
        sequence = (TaskContext.get().partitionId() << 40) - 1
        held: list = []  # (id, start, doc_tokens, ids) not yet placed
        kind = None  # the ids' own type

        def solve(last: bool):
            nonlocal sequence, held
            stream = np.concatenate([h[3] for h in held])
            total = len(stream)
            ends = np.cumsum([len(h[3]) for h in held])
            places = np.union1d(np.flatnonzero(flags[stream]) + 1, ends)[:-1]  # the last one is the total
            costs = np.where(np.isin(places, ends, assume_unique=True), 0.0, sentence_cost)
            cuts = choose_cuts(places, costs, total, window, inside_cost)
            if len(cuts) > 1 and not last or cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0) < window:
                tail = cuts[-2] if len(cuts) > 1 else 0
                cuts = cuts[:-1]
                if last:
                    for n in split_tail(total - tail):
                        tail += n
                        cuts.append(tail)
            out, rest, c, begun = [], [], 0, 0
            place = 0
            for (doc, start, tokens, ids), end in zip(held, ends.tolist(), strict=True):
                while place < end and c < len(cuts):
                    stop = min(end, cuts[c])
                    if place == begun:
                        sequence += 1
                    if stop > place:
                        a = len(ids) - (end - place)
                        piece = ids[a : a + stop - place]
                        out.append((doc, start + a, stop - place, zlib.crc32(piece.tobytes()), tokens, sequence, place - begun, piece.astype(np.int32) if with_ids else None))
                    place = stop
                    if place == cuts[c]:
                        begun, c = place, c + 1
                if place < end:
                    a = len(ids) - (end - place)
                    rest.append((doc, start + a, tokens, ids[a:]))
                    place = end
            held = rest
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            arrays = [pa.array(columns[0], type=kind), *(pa.array(x, type=pa.int64()) for x in columns[1:7])]
            if with_ids:
                arrays.append(pa.array(columns[7], type=pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        size, last_id = 0, np.array([end_id], dtype="<u4")
        for batch in batches:
            kind = batch.column(0).type
            for part in _portions(batch, portion):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode_all(part.column(1)), strict=True):
                    ids = np.concatenate([ids, last_id])
                    held.append((doc, 0, len(ids), ids))
                    size += len(ids)
                if size >= stretch:
                    yield solve(False)
                    size = sum(len(h[3]) for h in held)
        if held:
            yield solve(True)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return map_arrow(with_text, run, schema)
