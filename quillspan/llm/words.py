"""Words of an Arrow column of texts, cut at byte level by numpy.

A word is a maximal run of bytes of a class.  Every byte of a character beyond ASCII belongs to the class, so runs of
bytes are runs of characters.  A-Z are lower-cased, nothing else is.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

#: Bytes that are cut at once, unless one word is longer.
BLOCK = 4 << 20


def byte_class(letters: str):
    """A table by byte: whether it belongs to a word; ``letters``, and all beyond ASCII, do."""
    import numpy as np

    inside = np.zeros(256, bool)
    inside[128:] = True
    inside[list(letters.encode())] = True
    return inside


def letters_only():
    return byte_class(string.ascii_letters)


def letters_and_digits():
    return byte_class(string.ascii_letters + string.digits)


def text_bytes(column) -> tuple:
    """(bytes, offsets): text i is bytes[offsets[i] : offsets[i + 1]], a null an empty one."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def cuts(data, offsets, inside, block: int) -> Iterator[tuple[int, int]]:
    """Stretches that follow each other and cut no word, of at most ``block`` bytes where no word is longer."""
    import numpy as np

    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + block, end)
        gaps = np.flatnonzero(~inside[data[at:stop]]) if stop < end else []
        edge = int(offsets[np.searchsorted(offsets, stop, "right") - 1])  # the last one that isn't beyond
        last = max(edge, at + int(gaps[-1]) + 1 if len(gaps) else at)
        if last > at:
            stop = last
        else:  # one word fills the stretch: on to its end
            edge = int(offsets[np.searchsorted(offsets, stop, "left")])
            gaps = (k + np.flatnonzero(~inside[data[k : min(k + block, edge)]]) for k in range(stop, edge, block))
            stop = next((int(g[0]) for g in gaps if len(g)), edge)
        yield at, stop
        at = stop


def split(column, inside, block: int = BLOCK) -> Iterator[tuple]:
    """(row of each word, words as an Arrow array of bytes) for stretches of a column of texts, in order."""
    import numpy as np
    import pyarrow as pa

    data, offsets = text_bytes(column)
    lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    for at, stop in cuts(data, offsets, inside, block):
        part = lower[data[at:stop]]
        within = inside[part]
        first = within.copy()
        first[1:] &= ~within[:-1]
        edges = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, stop, "left")] - at
        first[edges] = within[edges]
        rows = np.searchsorted(offsets, np.flatnonzero(first) + at, "right") - 1
        if len(rows):
            kept = part[within]
            starts = np.append(np.flatnonzero(first[within]), len(kept)).astype(np.int64)
            yield rows, pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(starts), pa.py_buffer(kept)])
