"""Arrow batches of texts, portion by portion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def portions(batches, most: int):
    """Tables of whole rows of about `most` bytes, in order; a row that is larger comes with few others."""
    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * most // (4 * max(1, batch.nbytes)))
        for s in range(0, batch.num_rows, step):
            held.append(batch.slice(s, step))
            size += held[-1].nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def array_of(table: pa.Table, column: str) -> pa.Array:
    """A table's column as one array."""
    whole = table.column(column).combine_chunks()
    if not isinstance(whole, pa.ChunkedArray):
        return whole
    return pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], whole.type)


def decimal_text(values: np.ndarray, separators: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers below 10^9 in decimal, each followed by its separator (a byte), as one text, and where each number's part ends."""
    places = 10 ** np.arange(max(1, len(str(int(values.max(initial=0))))) - 1, -1, -1, dtype=np.int64)
    shown = np.empty((len(values), len(places) + 1), dtype=np.uint8)
    shown[:, :-1] = values[:, None] // places % 10 + 48
    shown[:, -1] = separators
    kept = np.ones(shown.shape, dtype=bool)
    kept[:, :-1] = values[:, None] >= places
    kept[:, -2] = True
    return shown[kept].tobytes(), np.cumsum(kept.sum(axis=1))


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges [start, start + length) of flat, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def slices(raw: bytes, ends: np.ndarray, less: int = 0) -> list[bytes]:
    """raw cut at the ends, without the last `less` bytes of each part that has any."""
    stops = ends.tolist()
    return [raw[a : max(a, b - less)] for a, b in zip([0, *stops[:-1]], stops, strict=True)] if stops else []
