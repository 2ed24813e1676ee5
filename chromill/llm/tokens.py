"""Words of Arrow string arrays as hashes, in bulk: every distinct word of a batch is hashed once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_EMPTY = xxhash.xxh64_intdigest(b"")
_ODD = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of text that are taken apart at once; what is made of them takes some twenty times as much memory.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", times: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in batches of about times SLICE_BYTES of text, or of one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES * times, side="right")))
            # copied out, as some string kernels misread arrays that begin inside a buffer
            yield batch.take(pa.array(np.arange(at, to)))
            at = to
        pa.default_memory_pool().release_unused()


#: Distinct words whose properties a worker remembers before it starts anew; some 250 bytes each.
REMEMBERED = 100_000


def remembered(words: pa.DictionaryArray, memory: dict, make: Callable[[str], tuple]) -> list[tuple]:
    """make(word) of each distinct word, from memory where it has been made before."""
    if len(memory) > REMEMBERED:
        memory.clear()
    out = []
    for w in words.dictionary.to_pylist():
        if (found := memory.get(w)) is None:
            found = memory[w] = make(w)
        out.append(found)
    return out


def split_words(texts: pa.Array, lower: bool) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts as one dictionary-encoded array, empty strings included, and each text's offsets into it."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy()
    return lists.flatten().dictionary_encode(), offsets - offsets[0]


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """uint64 hashes of the words of all texts in order, and each text's offsets into them; null has no words.

    Words are runs of characters other than ASCII white space; lower maps A-Z only.
    """
    words, offsets = split_words(texts, lower)
    table = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
    if not len(table):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    hashes = table[words.indices.to_numpy()]
    real = hashes != np.uint64(_EMPTY)
    before = np.concatenate([[0], np.cumsum(real)])
    return hashes[real], before[offsets]


def fold(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One step of an order-dependent hash over uint64 arrays."""
    y = (x ^ h) * _ODD
    return y ^ (y >> np.uint64(29))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries; entry i covers i to i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = fold(x, hashes[j : j + n])
    return x


def shingle_sets(texts: pa.Array, k: int, lower: bool = True) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted uint64 hashes; a shorter text's whole sequence is one; no words, none."""
    hashes, offsets = word_hashes(texts, lower)
    all_windows, out = windows(hashes, k), []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(all_windows[a : b - k + 1]))
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out
