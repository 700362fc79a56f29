"""Token ids of whole texts.

Words recur, so texts are cut where the tokenizer's own pattern always cuts (around single spaces), the cut is
dictionary-encoded, only distinct words are looked up in a bounded table, and only new ones are given to the tokenizers
library, many in one text. Ids of texts are then gathered from those of their words. Texts with other arrangements
of white space are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space beside space and line feed, and signs that some pattern engines take for it.
_ODD = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]"
#: Where a text can't be cut at each space: runs of white space, or white space at an end.
_UNEVEN = r"[ \n][ \n]|^[ \n]|[ \n]$|" + _ODD
#: Signs behind a word of letters; patterns of both kinds cut before them. Words joined for one call of the library.
_SIGNS, JOINED = ".,;:!?%&$#*", 512


def ragged(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices ``values[begin : begin + length]``, joined."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begin - (ends - length), length) + np.arange(total)]


class _Table:
    """Ids of the words met so far, as flat arrays; ``encode`` gives the ids of new ones and their counts."""

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.string())
        self.values, self.begin, self.length = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def size(self) -> int:
        return self.keys.nbytes + self.values.nbytes + self.begin.nbytes + self.length.nbytes

    def find(self, words: pa.Array) -> np.ndarray:
        """Places of ``words`` in the table."""
        at = pc.index_in(words, value_set=self.keys)
        lacking = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if lacking.any():
            missing = words.filter(pa.array(lacking))
            new = missing.unique()
            ids, counts = self.encode(new)
            at[lacking] = len(self.keys) + pc.index_in(missing, value_set=new).to_numpy()
            self.begin = np.concatenate([self.begin, len(self.values) + np.cumsum(counts) - counts])
            self.length = np.concatenate([self.length, counts])
            self.values = np.concatenate([self.values, ids])
            self.keys = pa.concat_arrays([self.keys, new])
        return at


class TextTokenizer:
    """Encodes texts. ``cache`` bounds the bytes of the words and ids that each table keeps between batches."""

    def __init__(self, path: str, cache: int = 20_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        normal = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("type") for p in pre.get("pretokenizers", [])]
        vocabulary = self.tokenizer.get_vocab()
        self.vocab = len(vocabulary)
        #: a space belongs to the word behind it
        self.leading = bool(pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["normalizer"] is None)
        #: white space only separates
        self.spaceless = normal == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>"
        #: ids that begin with a space or end a word
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.edge[[i for token, i in vocabulary.items() if (token.startswith("\u0120") if self.leading else token.endswith("</w>"))]] = True
        self.feed = vocabulary.get("\u010a", -1)
        self.most = cache
        self.spaced, self.bare, self.other = _Table(self.joined_spaced), _Table(self.joined_bare), _Table(self.singly)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def singly(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.library(words.to_pylist())
        return np.concatenate([np.empty(0, "<u4"), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _joined(self, words: pa.Array, sign: str, before: str) -> tuple[np.ndarray, np.ndarray]:
        """Many words in one text for the library. Where its ids don't show each word's edge, the words are encoded one by one."""
        ids, counts = [], []
        for i in range(0, len(words), JOINED):
            part = words.slice(i, JOINED)
            found = self.library([before + sign.join(part.to_pylist())])[0]
            if before:
                at = np.flatnonzero(self.edge[found])
                own = np.diff(np.append(at, len(found)))
            elif self.spaceless:
                own = np.diff(np.flatnonzero(self.edge[found]), prepend=-1)
            else:
                at = np.flatnonzero(found == self.feed)
                own = np.diff(np.concatenate([[-1], at, [len(found)]])) - 1
                found = np.delete(found, at)
            if len(own) != len(part) or int(own.sum()) != len(found) or int(own.min()) < 1:
                spaced = pc.binary_join_element_wise(pa.scalar(before), part, "") if before else part
                found, own = self.singly(spaced)
            ids.append(found)
            counts.append(own)
        return np.concatenate(ids), np.concatenate(counts)

    def joined_spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._joined(words, " ", " ")

    def joined_bare(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._joined(words, " " if self.spaceless else "\n", "")

    def words(self, words: pa.Array, table: _Table) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words``, joined, and the number of each. Letters and the signs behind them are looked up apart."""
        stem = pc.ascii_rtrim(words, _SIGNS)
        split = pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False)
        if self.spaceless:  # letters that the normalizer turns into a letter and a mark, which goes with the signs behind it
            split = split.copy()
            wide = np.flatnonzero(split & ~pc.string_is_ascii(stem).to_numpy(zero_copy_only=False))
            split[wide] = [is_normalized("NFC", w) and "\u0130" not in w for w in stem.take(pa.array(wide)).to_pylist()]
        tail = np.where(split, pc.binary_length(words).to_numpy() - pc.binary_length(stem).to_numpy(), 0)
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        ended = tail > 0
        places = np.concatenate([[0], np.cumsum(tail[ended])]).astype(np.int32)
        tails = pa.StringArray.from_buffers(int(ended.sum()), pa.py_buffer(places), pa.py_buffer(ragged(data, at[1:][ended] - tail[ended], tail[ended])))
        whole = words.filter(pa.array(~split))
        if table is self.spaced:
            whole = pc.binary_join_element_wise(pa.scalar(" "), whole, "")
        found = [(split, table, table.find(stem.filter(pa.array(split)))), (~split, self.other, self.other.find(whole))]
        length, begin = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        tail_at = self.other.find(tails)
        for mask, source, place in found:
            length[mask, 0], begin[mask, 0] = source.length[place], source.begin[place]
        length[ended, 1], begin[ended, 1] = self.other.length[tail_at], self.other.begin[tail_at]
        base = len(self.other.values)
        begin[split, 0] += base
        return ragged(np.concatenate([self.other.values, table.values]), begin.reshape(-1), length.reshape(-1)), length.sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined, and the number of ids of each. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        for table in (self.spaced, self.bare, self.other):
            if table.size() > self.most:
                table.clear()
        plain = pc.invert(pc.match_substring_regex(texts, _UNEVEN)).to_numpy(zero_copy_only=False) if self.leading or self.spaceless else np.zeros(len(texts), bool)
        even = texts.filter(pa.array(plain))
        if len(even):
            cut = pc.split_pattern(pc.replace_substring(even, "\n", " \n " if self.leading else " "), " ")
            offsets = cut.offsets.to_numpy()
            coded = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            offsets = offsets - offsets[0]
            index = coded.indices.to_numpy()
            ids, lengths = self.words(coded.dictionary, self.spaced if self.leading else self.bare)
            if self.leading:  # no space before the first word of a text, a line feed and the word behind it
                feed = pc.index(coded.dictionary, "\n").as_py()
                alone = index == feed
                alone[1:] |= alone[:-1]
                alone[offsets[:-1]] = True
                own, back = np.unique(index[alone], return_inverse=True)
                more, counts = self.words(coded.dictionary.take(pa.array(own)), self.bare)
                index = index.copy()
                index[alone] = len(lengths) + back
                ids, lengths = np.concatenate([ids, more]), np.concatenate([lengths, counts])
            begin = np.cumsum(lengths) - lengths
            ids = ragged(ids, begin[index], lengths[index])
            counted = np.add.reduceat(np.append(lengths[index], 0), offsets[:-1])
        else:
            ids, counted = np.empty(0, "<u4"), np.empty(0, np.int64)
        rest = self.library(texts.filter(pa.array(~plain)).to_pylist())
        if not rest:
            return ids, counted
        counts = np.empty(len(texts), np.int64)
        counts[plain], counts[~plain] = counted, [len(x) for x in rest]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), "<u4")
        spot = np.repeat(plain, counts)
        out[spot], out[~spot] = ids, np.concatenate(rest)
        return out, counts


_made: dict[str, TextTokenizer] = {}


def tokenizer(path: str) -> TextTokenizer:
    """One for each Python worker, of the file asked for last."""
    if path not in _made:
        _made.clear()
        _made[path] = TextTokenizer(path)
    return _made[path]


def release() -> None:
    """Drop the tokenizers and their tables: workers are reused, and later stages don't need them."""
    _made.clear()
    common.release()
