"""Whole batches of text as arrays of 64-bit word hashes.

Words are hashed eight bytes at a time with numpy over the joined batch, so the
cost per word is some tens of nanoseconds and memory follows the batch.
"""

from __future__ import annotations

import numpy as np

_SPACE_BYTES = b" \t\n\x0b\x0c\r"


def _byte_table(is_word) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        if is_word(byte):
            table[byte] = byte + 32 if 65 <= byte <= 90 else byte
    return table


#: Words are what stands between white space; A-Z become lower case.
SPACED = _byte_table(lambda b: b != 0 and b not in _SPACE_BYTES)
#: Words are runs of letters and digits; every byte beyond ASCII counts as a letter.
ALNUM = _byte_table(lambda b: b >= 128 or chr(b).isalnum())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes], rule: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (n + 1 offsets)."""
    joined = b"\n" + b"\n".join(texts) + b"\n" * 9
    norm = rule[np.frombuffer(joined, np.uint8)]
    edge = np.flatnonzero(np.diff((norm != 0).view(np.int8)))
    starts, ends = edge[0::2] + 1, edge[1::2] + 1
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    offsets = np.searchsorted(starts, begins).astype(np.int64)
    eight = np.ndarray((norm.size - 7,), "<u8", buffer=norm.data, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    active, at = np.arange(starts.size), 0
    while active.size:
        left = length[active] - at
        chunk = eight[starts[active] + at]
        short = np.flatnonzero(left < 8)
        chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[active] = mix(h[active] ^ chunk) + np.uint64(0x632BE59BD9B4E019)
        active, at = active[left > 8], at + 8
    return mix(h), offsets


_FACTORS = (mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each text, and the offsets per text.

    A text with fewer words, but at least one, has one shingle of all its words.
    """
    counts = np.diff(offsets)
    n = words.size
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        full += words[k : k + full.size] * _FACTORS[k]
    full = mix(full) if full.size else full
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(per_text)])
    out = np.zeros(out_offsets[-1], np.uint64)
    inside = np.repeat(offsets[:-1] - out_offsets[:-1], per_text) + np.arange(out.size)
    whole = np.repeat(counts >= size, per_text)
    out[whole] = full[inside[whole]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[offsets[i] : offsets[i + 1]]
        value = (own * _FACTORS[: own.size]).sum(dtype=np.uint64) + np.uint64(own.size)
        out[out_offsets[i]] = mix(np.array([value], np.uint64))[0]
    return out, out_offsets


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each word or shingle the index of its text."""
    return np.repeat(np.arange(offsets.size - 1), np.diff(offsets))
