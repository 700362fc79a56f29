"""Hashes of the words of many texts at once: distinct words are hashed once for each batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import mix64

#: ASCII letters to lower case, digits kept, other ASCII to a space; bytes of other characters are word bytes.
WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def hashed(texts: list[bytes], signs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text begins (one more than there are texts).

    ``signs``: words end at ASCII white space only and keep their other signs; else at every ASCII sign that is no letter or digit.
    """
    parts = [t.lower().split() if signs else t.translate(WORD).split() for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    joined = pa.array([b" ".join(p) for p in parts if p], pa.large_binary())
    if not len(joined):
        return np.empty(0, np.uint64), offsets
    coded = pc.list_flatten(pc.split_pattern(joined, b" ")).dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy()], offsets


def pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of each word with the one before it; the first one's is with nothing."""
    before = np.concatenate([np.zeros(1, np.uint64), words[:-1]]) if len(words) else words
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + words)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` words in a row; of all words if there are fewer; none if there is none."""
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total = mix64(total + words[i : i + len(total)] + np.uint64(0x9E3779B97F4A7C15))
    return total
