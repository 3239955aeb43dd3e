"""Encoding of many texts by way of their distinct words.

Arrow cuts the texts of a slice at spaces and numbers the distinct words; each of
those is looked up in a table of the worker process, and encoded by a backend when
it is new. Cutting at a space is exact for both vocabularies: no pre-token of either
crosses from a non-space character into a space. A word that is empty or starts with
white space shows that a space belongs to a longer run; texts with one are encoded
whole where spaces matter. A comma or full stop after a letter (one whose lower case is a letter) is a pre-token of its
own, so such a word's ids are those of its stem and of the mark.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of distinct words kept per worker process before the table starts anew.
TABLE_CHARS = 12_000_000
#: Text encoded at a time, in bytes (a longer text is a slice by itself).
SLICE_BYTES = 6_000_000
#: Words strung together for one call of the library.
STRUNG = 20_000

#: A comma or full stop after a letter that is one in lower case too.
MARKED = r"(?s).[^\PLİ][,.]$"

#: Words to all their ids one after another, and how many each word has.
Backend = Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]


def one_by_one(encode: Callable[[str], list[int]]) -> Backend:
    def run(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [encode(w) for w in words]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int32, len(found))

    return run


class _Index(dict):
    """word -> row; an unseen word gets the next row and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class _Pool:
    """A growing array."""

    def __init__(self):
        self.data, self.n = np.zeros(1 << 16, np.int32), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.append(self.data[: self.n], np.zeros(max(self.n, len(more)), np.int32))
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


def pieces(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every piece, one piece after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordEncoder:
    """``spaced``: a word's ids include the space before it (byte-level vocabularies)."""

    def __init__(self, backend: Backend, spaced: bool):
        self.backend, self.spaced = backend, spaced
        self._reset()

    def _reset(self) -> None:
        self.index, self.chars = _Index(), 0
        self.starts, self.lengths, self.odd, self.pool = _Pool(), _Pool(), _Pool(), _Pool()

    def _form(self, word: str) -> str:
        # a word with a leading space is one that has no space before it in its text
        return (word[1:] if word[:1] == " " else " " + word) if self.spaced else word

    def _learn(self) -> None:
        """Encode the words that wait, then what consists of a stem and a mark."""
        known, new = self.index, self.index.new
        if not new:
            return
        column = pa.array(new, pa.string())
        marked = column.filter(pc.match_substring_regex(column, MARKED)).to_pylist()
        stems = np.fromiter((known[w[:-1]] for w in marked), np.int64, len(marked))  # new stems join the list
        if len(new) > len(column):
            column = pa.array(new, pa.string())
        known.new, base = [], self.lengths.n
        self.chars += sum(map(len, new))
        at = np.fromiter(map(known.__getitem__, marked), np.int64, len(marked)) - base
        plain = np.ones(len(new), bool)
        plain[at] = False
        form = self._form
        flat, sizes = self.backend([form(w) for w, p in zip(new, plain.tolist()) if p])
        starts, lengths = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32)
        starts[plain], lengths[plain] = np.cumsum(sizes) - sizes + self.pool.n, sizes
        self.pool.add(flat)
        self.starts.add(starts), self.lengths.add(lengths)
        if len(marked):
            marks, size = self.backend([",", "."])
            which = np.fromiter((w[-1] == "." for w in marked), np.int64, len(marked))
            own, more = self.lengths.data[stems].astype(np.int64), size[which].astype(np.int64)
            total = own + more
            begin = np.cumsum(total) - total
            ids = np.zeros(int(total.sum()), np.int32)
            ids[pieces(begin, own)] = self.pool.data[pieces(self.starts.data[stems].astype(np.int64), own)]
            ids[pieces(begin + own, more)] = marks[pieces((np.cumsum(size) - size)[which], more)]
            self.starts.data[base + at], self.lengths.data[base + at] = begin + self.pool.n, total
            self.pool.add(ids)
        head = pc.utf8_slice_codeunits(column, 0, 1)
        odd = pc.or_(pc.equal(head, ""), pc.and_(pc.utf8_is_space(head), pc.not_equal(head, " ")))
        self.odd.add(odd.to_numpy(zero_copy_only=False).astype(np.int32))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has. No text is null."""
        if self.chars > TABLE_CHARS:
            self._reset()
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        row_of = np.fromiter(map(self.index.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(words.dictionary))
        rows = row_of[words.indices.to_numpy(zero_copy_only=False)]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(counts) - counts
        if self.spaced:
            heads = pc.list_element(split, 0).to_pylist() if len(split) else []
            rows[first] = np.fromiter((self.index[" " + w] for w in heads), np.int64, len(heads))
        self._learn()
        lengths = self.lengths.data[rows].astype(np.int64)
        flat = self.pool.data[pieces(self.starts.data[rows].astype(np.int64), lengths)]
        ends = np.cumsum(lengths)
        sizes = ends[first + counts - 1] - ends[first] + lengths[first]
        if not self.spaced:
            return flat, sizes
        odd = np.flatnonzero(np.add.reduceat(self.odd.data[rows], first)) if len(first) else first
        if not len(odd):
            return flat, sizes
        cuts = np.cumsum(sizes)
        parts = np.split(flat, cuts[:-1])
        ids, many = self.backend([texts[int(k)].as_py() for k in odd])
        for k, own in zip(odd, np.split(ids, np.cumsum(many)[:-1])):
            parts[k], sizes[k] = own, len(own)
        return np.concatenate(parts), sizes

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, flat ids, counts), a slice of the texts at a time."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield (at, *self.encode(texts.slice(at, end - at)))
            at = end


def strung(tokenizer, apart: Backend) -> Backend:
    """Words of a byte-level vocabulary encoded as long strings, cut again by the tokens' bytes.

    Only words that start with one space and go on with another character than white
    space are strung together, where each begins a pre-token; ``apart`` encodes the others.
    """
    width = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, k in tokenizer.get_vocab(with_added_tokens=False).items():
        width[k] = len(token)  # one character of a byte-level token stands for one byte
    for k, token in tokenizer.get_added_tokens_decoder().items():
        width[k] = len(token.content.encode())

    def run(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array(words, pa.string())
        second = pc.utf8_slice_codeunits(column, 1, 2)
        is_fit = pc.and_(pc.starts_with(column, " "), pc.and_(pc.not_equal(second, ""), pc.invert(pc.utf8_is_space(second))))
        fit = is_fit.to_numpy(zero_copy_only=False)
        plain, lengths = column.filter(is_fit).to_pylist(), pc.binary_length(column).to_numpy(zero_copy_only=False)[fit].astype(np.int64)
        other_ids, other_sizes = apart(column.filter(pc.invert(is_fit)).to_pylist())
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(plain), STRUNG):
            part = plain[at : at + STRUNG]
            found = np.array(tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(lengths[at : at + STRUNG])
            own = np.cumsum(width[found])
            last = np.searchsorted(own, ends)  # of each word, its last token
            if (own[last] != ends).any():
                raise ValueError("a token reaches across two words")
            ids.append(found), sizes.append(np.diff(last + 1, prepend=0))
        if not len(other_sizes):
            return np.concatenate(ids), np.concatenate(sizes)
        total = np.zeros(len(words), np.int64)
        total[fit], total[~fit] = np.concatenate(sizes), other_sizes
        begin = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), np.int32)
        out[pieces(begin[fit], total[fit])] = np.concatenate(ids)
        out[pieces(begin[~fit], total[~fit])] = other_ids
        return out, total

    return run


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def library_encoder(path: str, spaced: bool) -> WordEncoder:
    """This process's encoder over a vocabulary file of the tokenizers library."""
    if (path, spaced) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def apart(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
            ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for at in range(0, len(words), 20_000):
                part = list(words[at : at + 20_000])
                found = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(found.ids, np.int32))
                sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)).astype(np.int32))
            return np.concatenate(ids), np.concatenate(sizes)

        _ENCODERS[path, spaced] = WordEncoder(strung(tokenizer, apart) if spaced else apart, spaced)
    return _ENCODERS[path, spaced]
