"""Byte-level BPE with the tokenizers library over Arrow batches, with byte and character offsets, and its reverse."""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..shipping import map_arrow

#: Splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A break that no match of PATTERN spans: after what is not white space, before a space or line feed.
_BREAK = re.compile(r"(?<=\S)(?=[ \n])")


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _parts(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The token after all merges of ranks below its own."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def tokenizer_json(ranks: dict[bytes, int], pattern: str = PATTERN) -> str:
    """The ranks as a tokenizers model: a token's merge joins the two parts that lower ranks leave of it."""
    chars = byte_characters()
    shown = lambda t: "".join(chars[b] for b in t)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and len(parts := _parts(token, ranks, rank)) == 2:
            merges.append([shown(p) for p in parts])
    model = {"type": "BPE", "vocab": {shown(t): r for t, r in ranks.items()}, "merges": merges}
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None, "decoder": None, "model": model})


class ByteBPE:
    """Encodes and decodes with one vocabulary. Pieces between safe breaks are encoded once and remembered, up to a bound."""

    def __init__(self, model: str, remembered: int = 240_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(model)
        self._remembered, self._known = remembered, {}
        byte = {c: b for b, c in enumerate(byte_characters())}
        vocab = self._tokenizer.get_vocab()
        self.table = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.table[i] = bytes(byte[c] for c in token)
        self._lengths = np.array([len(t) for t in self.table], dtype=np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        pieces = _BREAK.split(text) if text else []
        known = self._known
        new = list({p for p in pieces if p not in known})
        if len(known) + len(new) > self._remembered:
            known.clear()
            new = list(set(pieces))
        # pieces with a break at both ends are encoded in one go, and their ids told apart by their bytes
        joined = [p for p in new if p[0] in " \n" and not p[-1].isspace()]
        for s in range(0, len(joined), 4096):
            self._learn_joined(joined[s : s + 4096])
        for piece in new:
            if piece not in known:
                known[piece] = self.ids_of(piece).tobytes()
        return np.frombuffer(b"".join([known[p] for p in pieces]), dtype="<u4")

    def forget(self) -> None:
        """Let the library keep no words of its own, for callers that encode each word once."""
        self._tokenizer.model._resize_cache(0)

    def ids_of(self, text: str) -> np.ndarray:
        """The ids of a text, nothing remembered."""
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn_joined(self, pieces: list[str]) -> None:
        ids = self.ids_of("".join(pieces))
        ends = np.cumsum([len(p.encode()) for p in pieces])
        cuts = np.searchsorted(self.byte_offsets(ids), ends).tolist()
        raw, start = ids.tobytes(), 0
        for piece, cut in zip(pieces, cuts, strict=True):
            self._known[piece] = raw[4 * start : 4 * cut]
            start = cut

    def decode_bytes(self, ids) -> bytes:
        table = self.table
        return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])

    def decode(self, ids) -> str:
        """The text of the ids; a character cut at either end, or bytes that are no UTF-8, become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def byte_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id starts, and after the last the end, in the bytes of the text."""
        return np.concatenate([[0], np.cumsum(self._lengths[ids.astype(np.int64)])])

    def char_offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each id; an id that holds part of a character covers the whole of it."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        lead = np.cumsum((raw & 0xC0) != 0x80)  # character number, from 1, of each byte
        at = self.byte_offsets(ids)
        return (lead[at[:-1]] - 1, lead[at[1:] - 1]) if len(ids) else (at[:0], at[:0])


_loaded: dict[str, ByteBPE] = {}


def load(model: str) -> ByteBPE:
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(model)
    return _loaded[key]


def encode_texts(docs: DataFrame, ranks_path: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """docs with ids array<int> and, with offsets, starts and ends array<int>: the characters that each id covers.

    Null counts as empty; both give no ids. Special tokens' strings are ordinary text. The vocabulary is read on the
    driver and shipped, so executors need no file. The new columns replace any of their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))  # a fixed vocabulary
    added = ["ids", "starts", "ends"][: 3 if offsets else 1]
    kept = [c for c in docs.columns if c not in added]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in added)])

    def run(batches):
        bpe = load(model.value)
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                lists = [[], [], []]
                for text in part.column(text_col).to_pylist():
                    ids = bpe.encode(text)
                    lists[0].append(ids.astype(np.int32))
                    if offsets:
                        first, end = bpe.char_offsets(text or "", ids)
                        lists[1].append(first.astype(np.int32))
                        lists[2].append(end.astype(np.int32))
                made = [pa.array(x, type=pa.list_(pa.int32())) for x in lists[: len(added)]]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, *added])

    return map_arrow(docs, run, schema)


def decode_ids(docs: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with out_col binary: the bytes of the ids; null ids give no bytes. Whole ids lists give back the text's bytes."""
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))
    kept = [c for c in docs.columns if c != out_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out_col, T.BinaryType())])

    def run(batches):
        bpe = load(model.value)
        for batch in batches:
            made = pa.array([bpe.decode_bytes(x or []) for x in batch.column(ids_col).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, out_col])

    return map_arrow(docs, run, schema)


def round_trip_digest(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 for each row of docs; ids are encoded and decoded in one pass, so they never leave their task.

    Null and empty texts have no tokens, and the hashes of no bytes. Rows that repeat an id, and null ids, are rows of
    their own; a table without rows gives none; other columns are ignored, so their names can't clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))
    base = docs.select(id_col, text_col)
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        bpe = load(model.value)
        for batch in batches:
            counts, digests, backs = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                counts.append(len(ids))
                digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                backs.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64()), pa.array(digests, type=pa.string()), pa.array(backs, type=pa.string())], names=schema.names)

    return map_arrow(base, run, schema)
