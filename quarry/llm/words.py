"""Words of many texts at once: white space cuts words, never the end of a text
alone, and equal words of a slice have equal numbers."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20    # texts numbered together; a longer text is a slice of its own
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    codes: np.ndarray        # number of each word
    ends: np.ndarray         # per text, the words up to its end
    words: pa.Array          # the words, binary
    kinds: pa.Array          # the distinct words, by number

    def doc(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def joined(self, keep: np.ndarray) -> pa.Array:
        """The kept words of each text, joined by one space."""
        kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], self.ends])]
        lists = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), self.words.filter(pa.array(keep)).cast(pa.large_string()))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def split_words(texts: list[bytes | None]) -> Words:
    """The words of some texts (null: none)."""
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b" ".join([b"", *[t or b"" for t in texts]]), dtype=np.uint8)   # a space before each text
    inside = ~SPACE[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begin, end = edges[::2], edges[1::2]
    ends = np.searchsorted(begin, np.cumsum(sizes))
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), ends, words, coded.dictionary)


def slices(texts: list[bytes | None], size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    begin, total = 0, 0
    for at, text in enumerate(texts):
        n = len(text) if text else 0
        if at > begin and total + n > size:
            yield begin, at
            begin, total = at, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)
