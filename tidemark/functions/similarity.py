"""Token-sort similarity: a ratio of insertions and deletions, 0 to 100."""

from __future__ import annotations

from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import token_sort


# pairs are folded together in columns of characters while the shorter text has a bit for each of its own
_WORD = 64
_LONGEST = 512
_ROWS = 4_096


def _code_points(texts: list[str], width: int, filler: int) -> np.ndarray:
    """One row per text, its characters as numbers, filled up to ``width``."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), width), filler, np.uint32)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), lengths)
    out[rows, np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = points
    return out


def _common_many(short: list[str], long: list[str]) -> np.ndarray:
    """Longest common subsequences of many pairs at once: a step per character of the longer texts.

    Bit ``i`` of a row is cleared when the first ``i + 1`` characters of the
    shorter text gain a match; characters beyond a text's end match nothing.
    """
    own = _code_points(short, _WORD, 0xFFFFFFFF)
    other = _code_points(long, max(map(len, long)), 0xFFFFFFFE)
    row = np.full(len(short), ~np.uint64(0))
    for step in other.T:
        match = np.packbits(own == step[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        hit = row & match
        row = (row + hit) | (row - hit)
    return np.bitwise_count(~row).astype(np.int64)


def common_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Longest common subsequences of each text on the left with each on the right.

    As ``_common_many``, with as many words per row as the longest left text
    needs; additions carry from word to word.
    """
    words = max(1, -(-max(map(len, left)) // _WORD))
    own = _code_points(left, words * _WORD, 0xFFFFFFFF)
    other = _code_points(right, max(1, *map(len, right)), 0xFFFFFFFE)
    known, place = np.unique(other, return_inverse=True)
    place = place.reshape(other.shape)
    masks = np.stack([np.packbits(own == c, axis=1, bitorder="little").view(np.uint64) for c in known])
    row = np.full((words, len(left), len(right)), ~np.uint64(0))
    for step in place.T:
        match, carry = masks[step], None
        for w in range(words):
            now = row[w]
            hit = now & match[:, :, w].T
            total = now + hit
            over = total < now
            if carry is not None:
                total = total + carry
                over |= total < carry
            carry = over.astype(np.uint64) if w + 1 < words else None
            row[w] = total | (now - hit)
    return np.bitwise_count(~row).sum(axis=0, dtype=np.int64)


def _common_one(a: str, b: str) -> int:
    """The same for one pair of any length, bit-parallel on whole ints."""
    masks: dict[str, int] = {}
    for bit, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << bit)
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def common_length(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common subsequence."""
    out: list[int | None] = [None] * len(left)
    many = []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if a is None or b is None:
            continue
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if len(short) <= _WORD and 0 < len(long) <= _LONGEST:
            many.append((len(long), i, short, long))
        else:
            out[i] = _common_one(short, long)
    many.sort(key=itemgetter(0))  # so that a block's texts are of about one length
    for at in range(0, len(many), _ROWS):
        _, places, short, long = zip(*many[at : at + _ROWS], strict=True)
        for place, common in zip(places, _common_many(list(short), list(long)).tolist(), strict=True):
            out[place] = common
    return pd.Series(out, dtype="Int32")


def ratio_from_common(common: Column, left_len: Column, right_len: Column) -> Column:
    """Score of two texts given their lengths and longest common subsequence."""
    total = (left_len + right_len).cast("double")
    edits = total - 2 * common
    return F.when(total == 0, F.lit(100.0)).otherwise((F.lit(1.0) - edits / total) * 100.0)


def ratio_sorted(left: Column, right: Column) -> Column:
    """Score of two texts whose tokens are already sorted."""
    return ratio_from_common(common_length(left, right), F.length(left), F.length(right))


def token_sort_ratio(left: Column, right: Column) -> Column:
    return ratio_sorted(token_sort(left), token_sort(right))
