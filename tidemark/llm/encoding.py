"""Token ids of whole texts, for tasks that encode many texts with one vocabulary."""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A plain word, with or without punctuation behind it, never has a token over the place between the two.
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_LETTERS = "".join(c for c in map(chr, range(256)) if re.match(_PLAIN, c))

# Texts are taken together up to this many characters, so that unknown words go to the library in one call.
TOGETHER = 4_000_000


class Encoder:
    """Encodes texts with a ``tokenizers`` file and remembers the ids of repeated words.

    A text is cut before every single space between two visible characters.  With
    vocabularies whose pre-tokenizer never lets a token run over that place
    (byte-level and white-space-dropping BPE) the parts can be encoded by
    themselves, and repeated parts only once; so can a plain word and the
    punctuation behind it.  A text with other white space beside a space, or with
    what looks like a special token, is encoded whole.  A vocabulary that drops
    white space lets texts be cut at all that is ASCII, and with one that lowers plain
    letters words are remembered in lower case; encoding a few characters shows both.
    Memory of parts and of words is emptied when it holds ``remember`` of them (about
    200 bytes each).
    """

    def __init__(self, path: str, dtype: str = "<u4", remember: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.remember = remember
        # ids of parts and plain words that follow a space, of parts that begin a text, and of punctuation; None: the text is not cut
        self.later: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}
        self.first: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        # the ids that begin a word after a space, or end one: each plain word has exactly one of them
        self.begins, self.ends = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        apart = [" a b", *(f"{c}a{c}{c}b{c}" for c in " \t\n\v\f\r")]
        self.dropping = len(set(self._ids(apart))) == 1
        self.lowers = len(set(self._ids([_LETTERS, _LETTERS.lower()]))) == 1
        if self.tokenizer.get_vocab_size() > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"Ids of {path} do not fit {dtype}")

    def _ids(self, parts: list[str]) -> Iterator[bytes]:
        for found in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False):
            yield array(self.code, found.ids).tobytes()

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of plain words after a space; many are encoded as one text, which the library does faster."""
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            text = "".join([f" {w}" for w in some])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1 if self.ends.any() else np.append(np.flatnonzero(self.begins[ids])[1:], len(ids))
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                packed = ids.tobytes()
                places = [0, *(cuts * self.dtype.itemsize).tolist()]
                yield from (packed[a:b] for a, b in zip(places, places[1:], strict=False))
            else:
                yield from self._ids([f" {w}" for w in some])

    def _parts(self, parts: list[str], known: dict[str, bytes | None], before: str) -> list[bytes | None]:
        new = [p for p in parts if p not in known]
        torn = [] if self.dropping else [p for p in new if not p or p[0].isspace() or p[-1].isspace()]
        known.update(dict.fromkeys([*torn, *(p for p in new if "<|" in p)]))
        new = [before + p for p in new if p not in known]
        known.update(zip((p[len(before) :] for p in new), self._ids(new), strict=True))
        return [known[p] for p in parts]

    def _plain(self, words: pa.Array) -> pa.Array:
        coded = (pc.utf8_lower(words) if self.lowers else words).dictionary_encode()
        some = coded.dictionary.to_pylist()
        ids = list(map(self.words.get, some))
        new = [i for i, known in enumerate(ids) if known is None]
        words = [some[i] for i in new]
        for i, word, found in zip(new, words, self._words(words), strict=True):
            ids[i] = self.words[word] = found
        return pa.array(ids, pa.large_binary()).take(coded.indices)

    def _later(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct parts that follow a space, null where the text must not be cut."""
        words = pc.ascii_rtrim(parts, string.punctuation)
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(parts, "<|"))
        other = pc.invert(plain)
        parts, words, rest = parts.filter(plain), words.filter(plain), parts.filter(other).to_pylist()
        closed = pc.greater(pc.binary_length(parts), pc.binary_length(words))
        some = zip(parts.filter(closed).to_pylist(), words.filter(closed).to_pylist(), strict=True)
        tails = pa.array(self._parts([p[len(w) :] for p, w in some], self.tails, ""), pa.large_binary())
        ids = self._plain(words)
        ended = pc.binary_join_element_wise(ids.filter(closed), tails, pa.scalar(b"", pa.large_binary()))
        ids = pc.replace_with_mask(ids, closed, ended)
        others = pa.array(self._parts(rest, self.later, " "), pa.large_binary())
        order = np.concatenate([np.flatnonzero(kind.to_numpy(zero_copy_only=False)) for kind in (plain, other)])
        return pa.concat_arrays([ids, others]).take(pa.array(np.argsort(order)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed integers of ``dtype``."""
        if not texts:
            return []
        for memory in (self.later, self.words, self.first, self.tails):
            if len(memory) > self.remember:
                memory.clear()
        column = pa.array(texts, pa.large_string())
        cut = pc.ascii_split_whitespace(column) if self.dropping else pc.split_pattern(column, " ")
        coded = cut.values.dictionary_encode()
        packed = self._later(coded.dictionary).take(coded.indices)
        starts = cut.offsets.to_numpy()
        whole = np.add.reduceat(packed.is_null().to_numpy(zero_copy_only=False).astype(int), starts[:-1]) > 0
        _, places, ids = packed.buffers()
        places, ids = np.frombuffer(places, np.int64), memoryview(ids or b"")
        heads = [b""] * len(texts)
        if not self.dropping:  # a text's first part follows no space
            heads = self._parts(coded.dictionary.take(coded.indices.take(pa.array(starts[:-1]))).to_pylist(), self.first, "")
            starts = np.append(starts[:-1] + 1, starts[1:])
        else:
            starts = np.append(starts[:-1], starts[1:])
        begin, end = places[starts].reshape(2, -1).tolist()
        return [
            next(self._ids([text])) if alone else head + ids[a:b]
            for text, alone, head, a, b in zip(texts, whole.tolist(), heads, begin, end, strict=True)
        ]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def shared_encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder per Python worker, which keeps its memory from task to task."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]


def portions(rows: Iterable[tuple[int | None, str]]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts in lists of a bounded number of characters (one text may be longer)."""
    ids, texts, size = [], [], 0
    for doc_id, text in rows:
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
