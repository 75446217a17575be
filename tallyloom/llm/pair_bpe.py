"""BPE by an index from each pair of symbols to all its places in a portion of a partition.

The distinct pieces of a portion are laid out as one list of symbols. Ranks are applied in ascending order, each to all its places at once; the
lists of the pairs that a merge makes or ends are updated, and the next rank is the least that has a place.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..shipping import map_arrow
from .batches import array_of, decimal_text, gathered, portions, slices
from .bpe import byte_characters
from .packing import _OTHER, _PIECES


class PairIndex:
    """Merges the symbols of many pieces by the ranks of a vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self._size = max(vocab.values(), default=-1) + 1
        chars = byte_characters()
        named = lambda end: np.array([vocab.get(c + end, -1) for c in chars], dtype=np.int64)
        self._inner, self._last = named(""), named(suffix)
        rank_of, made = {}, {}
        for rank, (a, b) in enumerate(merges):
            rank_of[vocab[a] * self._size + vocab[b]] = rank
            made[a + b] = rank
        for rank, pair in enumerate(merges):
            if any(made.get(x, -1) >= rank for x in pair):
                raise ValueError("a merge of a symbol that only a later merge makes isn't supported")
        self._pairs = np.array(sorted(rank_of), dtype=np.int64)
        self._ranks = np.array([rank_of[p] for p in self._pairs.tolist()], dtype=np.int64)
        self._left, self._right, self._whole = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], dtype=np.int64).reshape(-1, 3).T

    def _rank(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        if not len(self._pairs):
            return np.full(len(pairs), -1)
        at = np.minimum(np.searchsorted(self._pairs, pairs), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pairs, self._ranks[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, none of them empty, one after the other, and the number of each piece's ids. Bytes without a symbol are left out."""
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        owner = np.repeat(np.arange(len(pieces)), lengths)
        symbol = self._inner[raw]
        ends = np.cumsum(lengths) - 1
        symbol[ends] = self._last[raw[ends]]
        if (symbol < 0).any():
            there = symbol >= 0
            symbol, owner = symbol[there], owner[there]
        n = len(symbol)
        # neighbours; n stands for none, and holds a symbol of no pair
        joined = np.concatenate([owner[1:] == owner[:-1], [False]]) if n else np.zeros(0, dtype=bool)
        after = np.where(joined, np.arange(1, n + 1), n)
        before = np.full(n, n)
        before[1:][joined[:-1]] = np.flatnonzero(joined[:-1])
        symbol, after, before = (np.concatenate([x, [e]]) for x, e in ((symbol, -1), (after, n), (before, n)))
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Add places, which ascend, to the lists of their pairs."""
            ranks = self._rank(symbol[places] * self._size + symbol[after[places]])
            some = ranks >= 0
            places, ranks = places[some], ranks[some]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            firsts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            for rank, s, e in zip(ranks[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(ranks)], strict=True):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(places[s:e])

        enter(np.flatnonzero(after[:n] < n))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, whole = int(self._left[rank]), int(self._right[rank]), int(self._whole[rank])
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]  # those that an earlier merge took are gone
            if a == b and len(at) > 1:  # of places that follow each other, every second
                new = np.concatenate([[True], after[at[:-1]] != at[1:]])
                firsts = np.flatnonzero(new)
                at = at[(np.arange(len(at)) - firsts[np.cumsum(new) - 1]) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = whole, -1
            beyond = after[gone]
            after[at] = beyond
            before[beyond] = at
            before[n], after[n] = n, n
            left = before[at]
            enter(np.unique(np.concatenate([left[left < n], at[beyond < n]])))
        there = symbol[:n] >= 0
        return symbol[:n][there].astype("<u4"), np.bincount(owner[there], minlength=len(pieces))


class PairEncoder:
    """Ids of whole texts by a lower-casing tokenizers vocabulary of words with ends, and back: as the library gives them, merged by the pair index.

    Texts of common letters and signs are cut into pieces by Arrow, others word by word by the library's normalizer and pre-tokenizer. A portion's
    distinct pieces are merged together; what they give is remembered, up to a bound.
    """

    def __init__(self, model: str, remembered: int = 150_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(model)
        self._remembered = remembered
        self._known: dict[bytes, bytes] = {}
        spec = json.loads(model)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self._index = PairIndex(spec["model"]["vocab"], merges, spec["model"]["end_of_word_suffix"] or "")
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._byte = {c: b for b, c in enumerate(byte_characters())}
        vocab = self._tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        table = [t.encode() + b" " for t in self.tokens]
        self._lengths = np.array([len(t) for t in table], dtype=np.int64)
        self._bytes, self._starts = np.frombuffer(b"".join(table), dtype=np.uint8), np.cumsum(self._lengths) - self._lengths

    def _cut(self, word: str) -> list[bytes | int]:
        """A word's pieces as bytes, and the ids of the special tokens in it, in order."""
        found: list[bytes | int] = []
        while word:
            at, special = min(((word.find(s), s) for s in self._special if s in word), default=(len(word), ""))
            shown = self._tokenizer.normalizer.normalize_str(word[:at])
            found += [bytes(self._byte[c] for c in p) for p, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(shown)] if shown else []
            if special:
                found.append(self._special[special])
            word = word[at + len(special) :]
        return found

    def pieces(self, texts: pa.Array) -> tuple[list[bytes | int], list[list[int]]]:
        """The distinct pieces of all texts (special tokens as their ids), and each text's pieces by number. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        other = pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False)
        number: dict[bytes | int, int] = {}
        out: list[list[int]] = [[] for _ in range(len(texts))]
        for rows, plain in ((np.flatnonzero(~other), True), (np.flatnonzero(other), False)):
            if not len(rows):
                continue
            some = texts.take(pa.array(rows))
            if plain:
                some = pc.replace_substring_regex(pc.utf8_lower(some), f"({_PIECES.pattern})", r"\1 ")
            words = pc.ascii_split_whitespace(some)
            numbered = words.flatten().dictionary_encode()
            places = numbered.indices.to_numpy(zero_copy_only=False).tolist()
            offsets = words.offsets.to_numpy()
            offsets = (offsets - offsets[0]).tolist()
            if plain:
                own = [number.setdefault(p.encode(), len(number)) for p in numbered.dictionary.to_pylist() if p]
                blank = len(own) < len(numbered.dictionary)  # the library's own end of a text that ends in white space
                if blank:
                    gap = numbered.dictionary.to_pylist().index("")
                    own.insert(gap, -1)
                for row, s, e in zip(rows.tolist(), offsets, offsets[1:], strict=False):
                    mine = [own[k] for k in places[s:e]]
                    out[row] = [k for k in mine if k >= 0] if blank else mine
            else:
                own_ = [[number.setdefault(p, len(number)) for p in self._cut(w)] for w in numbered.dictionary.to_pylist()]
                for row, s, e in zip(rows.tolist(), offsets, offsets[1:], strict=False):
                    out[row] = [p for k in places[s:e] for p in own_[k]]
        return list(number), out

    def ids_of(self, pieces: list[bytes | int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and the number of each piece's ids."""
        known = self._known
        new = [p for p in pieces if isinstance(p, bytes) and p not in known]
        if len(known) + len(new) > self._remembered:
            known.clear()
            new = [p for p in pieces if isinstance(p, bytes)]
        if new:
            ids, counts = self._index.encode(new)
            known.update(zip(new, slices(ids.tobytes(), 4 * np.cumsum(counts)), strict=True))
        found = [known[p] if isinstance(p, bytes) else np.array([p], dtype="<u4").tobytes() for p in pieces]
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array; null counts as empty."""
        pieces, places = self.pieces(texts)
        ids, counts = self.ids_of(pieces)
        starts = np.cumsum(counts) - counts
        return [gathered(ids, starts[mine], counts[mine]) if mine else ids[:0] for mine in places]

    def decode(self, ids) -> str:
        """The tokens joined by spaces, special ones too, as a vocabulary without a decoder gives them back."""
        return " ".join([self.tokens[i] for i in ids])

    def digest_all(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """For each text: the number of its ids, the hash of the decimal ids joined by spaces, and that of the decoded text. The ids and tokens of
        each distinct piece are written once."""
        pieces, places = self.pieces(texts)
        ids, counts = self.ids_of(pieces)
        upto = np.cumsum(counts)
        text, ends = decimal_text(ids.astype(np.int64), np.full(len(ids), ord(" "), dtype=np.uint8))
        numbers = slices(text, np.concatenate([[0], ends])[upto], 1)
        lengths = self._lengths[ids]
        back = gathered(self._bytes, self._starts[ids], lengths).tobytes()
        backs = slices(back, np.concatenate([[0], np.cumsum(lengths)])[upto], 1)
        out, some = [], counts.all()
        for mine in places:
            if not some:  # pieces that give no token
                mine = [k for k in mine if counts[k]]
            n = int(counts[mine].sum()) if mine else 0
            out.append((n, hashlib.sha256(b" ".join([numbers[k] for k in mine])).hexdigest(), hashlib.sha256(b" ".join([backs[k] for k in mine])).hexdigest()))
        return out


_loaded: dict[str, PairEncoder] = {}


def load(model: str) -> PairEncoder:
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PairEncoder(model)
    return _loaded[key]


def _model(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", portion: int = 4 << 20) -> DataFrame:
    """docs with ids_col array<int>: the ids of whole texts, as the library gives them without special tokens added; their strings in a text are one id each.

    Null counts as empty; both give no ids. Rows that repeat are rows of their own, and a table without rows gives none. ids_col
    replaces a column of its name. The vocabulary is read on the driver and shipped, so executors need no file.
    """
    model = docs.sparkSession.sparkContext.broadcast(_model(model_path))  # a fixed vocabulary
    kept = [c for c in docs.columns if c != ids_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = load(model.value)
        for table in portions(batches, portion):
            lists = encoder.encode_all(array_of(table, text_col).cast(pa.string()))
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists).astype(np.int32)))
            yield from table.select(kept).append_column(ids_col, made).to_batches()

    return map_arrow(docs, run, schema)


def decode_ids(docs: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with out_col string: the ids' tokens joined by spaces, special tokens too, as the library's decode gives for a vocabulary without a
    decoder. Null and empty ids give '', ids beyond the vocabulary and null ids nothing. out_col replaces a column of its name; rows that
    repeat are rows of their own, and a table without rows gives none."""
    model = docs.sparkSession.sparkContext.broadcast(_model(model_path))
    kept = [c for c in docs.columns if c != out_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out_col, T.StringType())])

    def run(batches):
        encoder = load(model.value)
        for batch in batches:
            made = [encoder.decode([i for i in ids or [] if i is not None and 0 <= i < len(encoder.tokens)]) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.string())], names=[*kept, out_col])

    return map_arrow(docs, run, schema)


def round_trip_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", portion: int = 4 << 20) -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 for each row of docs; ids are encoded and decoded in one pass.

    Null and empty texts, and texts of white space only, have no tokens, and the hashes of no bytes. Rows that repeat an id, and null ids, are rows of their own; a
    table without rows gives none; other columns are ignored, so their names can't clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(_model(model_path))
    base = docs.select(id_col, text_col)
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        encoder = load(model.value)
        for table in portions(batches, portion):
            found = encoder.digest_all(array_of(table, text_col).cast(pa.string()))
            n, ids, backs = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([array_of(table, id_col), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(backs, pa.string())], names=schema.names)

    return map_arrow(base, run, schema)
