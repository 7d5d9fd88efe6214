"""Words of texts as numbers, cut in numpy: exact, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .batches import spans

PIECE = 1 << 20

#: Bytes of words between the white space of ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Bytes of words of letters: A-Z, a-z and all that is not ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of texts laid end to end: their bytes without gaps, and where words and texts begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = False):
        part, at = data[offsets[0]: offsets[-1]], offsets - offsets[0]
        mask = inside[part]
        cut = at[(at > 0) & (at < len(part))]
        starts = mask.copy()
        starts[1:] &= ~mask[:-1]
        starts[cut] = mask[cut]
        ends = mask.copy()
        ends[:-1] &= ~mask[1:]
        ends[cut - 1] = mask[cut - 1]
        first = np.flatnonzero(starts)
        self.chars = LOWER[part[mask]] if lower else part[mask]
        self.at = np.zeros(len(first) + 1, np.int64)
        np.cumsum(np.flatnonzero(ends) + 1 - first, out=self.at[1:])
        #: Number of the first word of each text, and of all words at the end.
        self.texts = np.searchsorted(first, at)

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words only, and the word of each number."""
        n = len(self.at) - 1
        words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(self.at), pa.py_buffer(self.chars)])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary

    def joined(self, chosen: np.ndarray) -> bytes:
        """The chosen words, one space between them."""
        out = []
        size = np.cumsum(self.at[chosen + 1] - self.at[chosen] + 1)
        a = 0
        while a < len(chosen):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + PIECE, side="right")))
            own = chosen[a:b]
            length = self.at[own + 1] - self.at[own]
            text = np.full(int(length.sum()) + len(own), 32, np.uint8)
            text[spans(np.cumsum(length + 1) - length - 1, length)] = self.chars[spans(self.at[own], length)]
            out.append(text.tobytes())
            a = b
        return b"".join(out)[:-1]
