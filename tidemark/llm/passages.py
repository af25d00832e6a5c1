"""Passages that repeat across documents, by collinear chaining of shared word seeds."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import texts
from tidemark.sources.scratch import discard, freeze, spread

SEED = 5
WINDOW = 10
LEAST = 2
GAP_COST = 0.1
MAX_GAP = 40
MARGIN = 64
# So many matches in reach of one are tried in turn.
FEW = 128
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and where each text's begin and the last one's end.

    Words are in lower case A-Z and cut at ASCII white space.
    """
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = cut.flatten().dictionary_encode()
    words, ends = _bytes(coded.dictionary)
    cuts = ends.tolist()
    known = np.array([xxhash.xxh3_64_intdigest(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], np.uint64)
    at = coded.indices.to_numpy()
    # white space around a text leaves empty words
    real = (np.diff(ends) > 0)[at]
    before = np.concatenate([[0], np.cumsum(real)])
    offsets = cut.offsets.to_numpy()
    return known[at[real]], before[offsets - offsets[0]]


def _bytes(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of strings one after the other, and where each begins and the last one ends."""
    values = values.cast(pa.large_binary())
    _, ends, held = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return memoryview(held) if held else memoryview(b""), ends


def _portions(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of a batch together up to so many bytes of text (one text may be longer)."""
    size = np.cumsum(pc.binary_length(batch["text"]).to_numpy().astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def minimizers(words: np.ndarray, size: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the seeds of a text: the smallest in every window of runs of ``size`` words.

    Two texts that share ``size + window - 1`` words in a row share a seed there.
    """
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = _mixed(words, size)
    width = min(window, n)
    places = np.unique(np.lib.stride_tricks.sliding_window_view(mixed, width).argmin(axis=1) + np.arange(n - width + 1))
    return mixed[places], places


def _mixed(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(words) - size + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX + words[i : i + n]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return mixed ^ (mixed >> np.uint64(32))


def all_minimizers(words: np.ndarray, starts: np.ndarray, size: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``minimizers`` of all texts of ``word_hashes``: number of the text, hash and position in it."""
    counts, reach = np.diff(starts), size + window - 1
    found = []
    for i in np.flatnonzero((counts >= size) & (counts < reach)).tolist():
        seeds, places = minimizers(words[starts[i] : starts[i + 1]], size, window)
        found.append((np.full(len(places), i), seeds, places))
    n = len(words) - reach + 1
    if n > 0:
        of = np.repeat(np.arange(len(counts)), counts)
        mixed = _mixed(words, size)
        least, at = mixed[:n].copy(), np.zeros(n, np.int64)
        for i in range(1, window):
            smaller = mixed[i : i + n] < least
            least[smaller], at[smaller] = mixed[i : i + n][smaller], i
        # windows within one text; their smallest seeds never move back
        places = (np.arange(n) + at)[of[:n] == of[reach - 1 :]]
        if len(places):
            places = places[np.concatenate([[True], places[1:] != places[:-1]])]
            found.append((of[places], mixed[places], places - starts[of[places]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def scattered_runs(
    seeds: np.ndarray, pos: np.ndarray, ref_ids: np.ndarray, ref_pos: np.ndarray, min_piece: int, size: int = SEED, window: int = WINDOW
) -> Iterator[tuple[int, int, int]]:
    """Runs of neighbouring seeds whose first occurrences do not lie side by side: key, position, distance of the last seed.

    From each seed the run of two, and the shortest of at least ``min_piece``
    words.  Runs with first occurrences side by side were first seen there, as a
    whole, so they need no key of their own; which runs those are depends on the
    seeds alone, not on the document.
    """
    new = np.ones(len(pos), bool)
    new[1:] = pos[1:] != pos[:-1]
    seeds, pos, ref_ids, ref_pos = seeds[new].view(np.uint64), pos[new].astype(np.int64), ref_ids[new], ref_pos[new]
    if len(pos) < 2:
        return
    step = np.diff(pos)
    # numbers of the stretches without a wide step, and of those with all first occurrences side by side
    stretch = np.concatenate([[0], np.cumsum(step > window)])
    apart = np.concatenate([[0], np.cumsum((np.diff(ref_ids) != 0) | (np.diff(ref_pos.astype(np.int64)) != step))])
    here = np.arange(len(pos))
    long = np.searchsorted(pos, pos + min_piece - size, side="left")
    raw, steps = seeds.tobytes(), step.tobytes()
    for ends in (np.minimum(here + 1, len(pos)), np.where(long == here + 1, len(pos), long)):
        inside = np.flatnonzero((ends > here) & (ends < len(pos)))
        to = ends[inside]
        picked = (stretch[inside] == stretch[to]) & (apart[inside] != apart[to])
        inside, to = inside[picked], to[picked]
        far = pos[to] - pos[inside]
        for i, j, at, by in zip(inside.tolist(), to.tolist(), pos[inside].tolist(), far.tolist(), strict=True):
            key = xxhash.xxh3_64_intdigest(raw[8 * i : 8 * (j + 1)] + steps[8 * i : 8 * j])
            yield key - 2**64 if key >> 63 else key, at, by


class WindowMax:
    """A segment tree: the best value, and whose it is, among a range of positions.

    Values come with rising times, and those before a time can be dropped.
    """

    def __init__(self, size: int):
        self.size = size
        self.best_of: list[tuple[float, int]] = [(-np.inf, -1)] * (2 * size)
        self.held: list[deque[tuple[int, float, int]]] = [deque() for _ in range(size)]
        self.order: deque[tuple[int, int]] = deque()

    def _set(self, at: int) -> None:
        held = self.held[at]
        at += self.size
        self.best_of[at] = held[0][1:] if held else (-np.inf, -1)
        while at > 1:
            at //= 2
            self.best_of[at] = max(self.best_of[2 * at], self.best_of[2 * at + 1])

    def add(self, at: int, time: int, value: float, owner: int) -> None:
        held = self.held[at]
        while held and held[-1][1] <= value:
            held.pop()
        held.append((time, value, owner))
        self.order.append((time, at))
        self._set(at)

    def drop(self, before: int) -> None:
        while self.order and self.order[0][0] < before:
            at = self.order.popleft()[1]
            held = self.held[at]
            if held and held[0][0] < before:
                held.popleft()
                self._set(at)

    def best(self, first: int, stop: int) -> tuple[float, int]:
        found = (-np.inf, -1)
        first, stop = first + self.size, stop + self.size
        while first < stop:
            if first & 1:
                found = max(found, self.best_of[first])
                first += 1
            if stop & 1:
                stop -= 1
                found = max(found, self.best_of[stop])
            first, stop = first // 2, stop // 2
        return found


def _best_few(left: np.ndarray, right: np.ndarray, size: int, reach: int) -> tuple[list[float], list[int]]:
    """The best score and predecessor of each match, by trying all in reach."""
    at, to = left.tolist(), right.tolist()
    score, back, value = [float(size)] * len(at), [-1] * len(at), []
    low = same = 0
    for j, (x, y) in enumerate(zip(at, to, strict=True)):
        if x != at[same]:
            same = j  # matches at one place must not follow each other
        while at[low] < x - reach:
            low += 1
        best, owner, least = -np.inf, -1, y - reach
        for k in range(low, same):
            if least <= to[k] < y and value[k] >= best:
                best, owner = value[k], k
        gained = best - GAP_COST * (x + y)
        if gained > 0:
            score[j], back[j] = size + gained, owner
        value.append(score[j] + GAP_COST * (x + y))
    return score, back


def _best_many(left: np.ndarray, right: np.ndarray, size: int, reach: int) -> tuple[list[float], list[int]]:
    """The same by a segment tree, for many matches in reach of each other."""
    n = len(left)
    distinct, ranks = np.unique(right, return_inverse=True)
    lows, ranks = np.searchsorted(distinct, right - reach).tolist(), ranks.tolist()
    tree = WindowMax(len(distinct))
    at, to = left.tolist(), right.tolist()
    score, back = [float(size)] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        tree.drop(at[i] - reach)
        while j < n and at[j] == at[i]:  # matches at one place must not follow each other
            value, owner = tree.best(lows[j], ranks[j])
            gained = value - GAP_COST * (at[j] + to[j])
            if gained > 0:
                score[j], back[j] = size + gained, owner
            j += 1
        for k in range(i, j):
            tree.add(ranks[k], at[k], score[k] + GAP_COST * (at[k] + to[k]), k)
        i = j
    return score, back


def chains(left: np.ndarray, right: np.ndarray, size: int = SEED, least: int = LEAST) -> list[np.ndarray]:
    """Ordered lists of matches that rise in both texts, best first, none in two lists.

    A match is worth its length, and a gap costs ``GAP_COST`` per word skipped in
    either text.  That cost splits into a part of each match, so the best
    predecessor is a maximum over the right positions in reach, found by trying all or, if
    they are many, kept in a segment tree that matches out of reach on the left have been dropped from: a good chain
    that ended too far away hides nothing.  Matches must be sorted by the left position.
    """
    n = len(left)
    reach = MAX_GAP + size
    near = np.arange(n) - np.searchsorted(left, left - reach)
    score, back = (_best_few if n and near.max() <= FEW else _best_many)(left, right, size, reach)
    used, found = [False] * n, []
    for end in sorted(range(n), key=lambda k: (-score[k], k)):
        way, k = [], end
        while k >= 0 and not used[k]:
            used[k] = True
            way.append(k)
            k = back[k]
        if len(way) >= least:
            found.append(np.array(way[::-1]))
    return found


def _edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """By Myers' bits: a column of differences in two integers, a bit for each word of ``a``."""
    a, b = a.tolist(), b.tolist()
    low, m, n = 0, len(a), len(b)
    while low < m and low < n and a[low] == b[low]:
        low += 1
    while m > low and n > low and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[low:m], b[low:n]
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    distance, last = len(a), 1 << len(a) - 1
    every = 2 * last - 1
    up, down = every, 0
    for y in b:
        same = places.get(y, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | every & ~(across | up), up & across
        distance += bool(more & last) - bool(less & last)
        more, same = more << 1 | 1, same | down
        up, down = every & (less << 1 | ~(same | more)), more & same
    return distance


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far both begin alike, over single differing words: length and differences."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = (a[:n] == b[:n]).tobytes()
    at = score = best = length = wrong = missed = 0
    while True:  # from each differing word to the next
        stop = same.find(0, at)
        score += (stop if stop >= 0 else n) - at
        if score > best:
            best, length, wrong = score, stop if stop >= 0 else n, missed
        score, missed, at = score - 4, missed + 1, stop + 1
        if stop < 0 or best - score > 8:
            return length, wrong


def _walk(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> tuple[list[int], list[int], list[int]] | None:
    """Along the matches of a chain: where both sides end after each, and the edits so far.

    None if a match is not one (positions of another text).
    """
    edits, x, y = 0, int(left[0]), int(right[0])
    xs, ys, costs = [], [], []
    wide, raw_a, raw_b = a.itemsize, a.tobytes(), b.tobytes()
    x_end, y_end = int(left[-1]) + size, int(right[-1]) + size
    # most are equal from end to end
    if x_end - x == y_end - y and x_end <= len(a) and y_end <= len(b) and raw_a[wide * x : wide * x_end] == raw_b[wide * y : wide * y_end]:
        if (left - right == x - y).all():
            return (left + size).tolist(), (right + size).tolist(), [0] * len(left)
    for p, q in zip(left.tolist(), right.tolist(), strict=True):
        if p + size > len(a) or q + size > len(b) or raw_a[wide * p : wide * (p + size)] != raw_b[wide * q : wide * (q + size)]:
            return None
        skip = max(x - p, y - q, 0)  # overlaps the match before it
        p, q = p + skip, q + skip
        if (p > x or q > y) and raw_a[wide * x : wide * p] != raw_b[wide * y : wide * q]:
            edits += _edit_distance(a[x:p], b[y:q])
        x, y = max(x, p + size - skip), max(y, q + size - skip)
        xs.append(x)
        ys.append(y)
        costs.append(edits)
    return xs, ys, costs


def align(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, size: int = SEED) -> tuple[int, int, int, int, int] | None:
    """Spans in both texts and the number of edits between them, along the matches of a chain.

    Gaps between matches are aligned by edit distance, the ends are extended
    without gaps.  None if a match is not one (positions of another text).
    """
    walked = _walk(a, b, left, right, size)
    return None if walked is None else _whole(a, b, left, right, walked)


def _whole(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, walked: tuple[list[int], list[int], list[int]]) -> tuple[int, int, int, int, int]:
    x, y, edits = (v[-1] for v in walked)
    more, wrong = _extend(a[x:], b[y:])
    x, y, edits = x + more, y + more, edits + wrong
    first, other = int(left[0]), int(right[0])
    more, wrong = _extend(a[:first][::-1], b[:other][::-1])
    return first - more, x, other - more, y, edits + wrong


def _long_runs(starts: Sequence[int], ends: Sequence[int], costs: Sequence[int], percent: int) -> list[tuple[int, int]]:
    """From each match of a chain to the farthest one that leaves few enough edits per word in between, none inside another."""
    # edits above the limit up to the end and up to the start of each match, so a run is good if they do not rise over it
    least = [100 * c - (100 - percent) * e for c, e in zip(costs, ends, strict=True)]
    over_start = [100 * c - (100 - percent) * e for c, e in zip(costs, starts, strict=True)]
    for i in range(len(least) - 2, -1, -1):  # the smallest that still follows
        least[i] = min(least[i], least[i + 1])
    found, last = [], -1
    for i, over in enumerate(over_start):
        # least rises, so this is the last match at or below the value
        j = bisect_right(least, over) - 1
        if j > last and j >= i:
            found.append((i, j))
            last = j
    return found


def good_parts(
    a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, min_piece: int, percent: int, size: int = SEED
) -> list[tuple[int, int, int, int, int]]:
    """What ``align`` gives for a chain, or, if it has too many edits, for the longest parts of it that have not."""

    def good(spans: tuple[int, int, int, int, int]) -> bool:
        longer = max(spans[1] - spans[0], spans[3] - spans[2])
        return longer >= min_piece and 100 * spans[4] <= (100 - percent) * longer

    walked = _walk(a, b, left, right, size)
    if walked is None:
        return []
    whole = _whole(a, b, left, right, walked)
    if good(whole):
        return [whole]
    xs, ys, costs = walked
    left, right, end = left.tolist(), right.tolist(), len(xs) - 1
    if not costs[end]:  # the chain is the only run
        bare = (left[0], xs[end], right[0], ys[end], 0)
        return [bare] if good(bare) else []
    runs = {r for starts, ends in ((left, xs), (right, ys)) for r in _long_runs(starts, ends, costs, percent)}
    found = []
    for i, j in sorted(runs):
        bare = (left[i], xs[j], right[i], ys[j], costs[j] - costs[i])
        if (i, j) == (0, end):  # extended, it is the whole
            found += [bare] if good(bare) else []
            continue
        # no farther than the next match, so that many parts of a chain stay cheap
        after = len(a) if j == end else MAX_GAP + size
        before = len(a) if not i else MAX_GAP + size
        more, wrong = _extend(a[bare[1] :][:after], b[bare[3] :][:after])
        less, amiss = _extend(a[: bare[0]][::-1][:before], b[: bare[2]][::-1][:before])
        wide = (bare[0] - less, bare[1] + more, bare[2] - less, bare[3] + more, bare[4] + wrong + amiss)
        found += [wide] if good(wide) else [bare] if good(bare) else []
    return found


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each key with at least ``least`` of them, from batches that are sorted by the keys."""
    held: list[dict[str, np.ndarray]] = []
    last = None

    def whole() -> Iterator[dict[str, np.ndarray]]:
        if held and sum(len(h[keys[0]]) for h in held) >= least:
            yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}
        new = np.zeros(batch.num_rows, bool)
        for v in (columns[k] for k in keys):
            new[1:] |= v[1:] != v[:-1]
        new[0] = last is None or any(columns[k][0] != old for k, old in zip(keys, last, strict=True))
        last = [columns[k][-1] for k in keys]
        starts = np.flatnonzero(new)
        if not len(starts) or starts[0]:
            held.append({c: v[: starts[0] if len(starts) else None] for c, v in columns.items()})
        if not len(starts):
            continue
        yield from whole()
        enough = np.diff(starts) >= least
        for a, b in zip(starts[:-1][enough].tolist(), starts[1:][enough].tolist(), strict=True):
            yield {c: v[a:b] for c, v in columns.items()}
        held = [{c: v[starts[-1] :] for c, v in columns.items()}]
    yield from whole()


def _words(values: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes in each of some binary values."""
    held, ends = _bytes(values)
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        yield np.frombuffer(held[a:b], np.uint32)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


_INT, _LIST = pa.int64(), pa.list_(pa.int32())


def repeated_passages(
    docs: DataFrame, *, min_words: int = 50, min_piece: int = 20, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per repeated passage of a document: ``doc_id, start_word, n_words, ref_doc_id, ref_start, identity, ref_doc_ids``.

    A passage of at least ``min_words`` words (A-Z lowered, cut at white space)
    that occurs in documents with smaller ids too, word edits up to ``100 -
    percent`` hundredths allowed.  ``ref_doc_id`` holds the longest piece of it, and
    ``ref_doc_ids`` all documents that pieces of it were found in.  The first
    document that has a passage is named by the others and has no row for it.

    Seeds (minimizers of five-word runs, two in eleven words) are joined with
    their first occurrence in the table, never with each other, so a passage in a
    third of all documents gives one match per occurrence.  Neighbouring seeds that
    were first seen apart are joined once more, two together and as runs of
    ``min_piece`` words, with the first document that holds the run: a passage made
    of phrases that are each known from elsewhere is found too.  Matches of a document
    with one other are chained, chains are aligned word by word on both texts and extended, and
    pieces of ``min_piece`` words or more are merged per document: a chain with
    too many edits gives the longest parts of it that have few enough, and a passage
    whose parts were first seen in different documents is found as a whole.
    Documents with chains are read again, and 32-bit word hashes of the windows around chains are aligned.

    A passage shows if two seeds of it in reach of each other survive its edits and were
    first seen side by side, alone or as a run; 25 words without an edit always hold two seeds.

    Defined cases: null, empty and short texts have no passages; rows with a null
    id are left out; rows with equal ids count as one document; a document is
    never compared with itself; an empty table gives an empty result; other columns are ignored.
    """
    rows = spread(texts(docs, id_col, text_col).where("doc_id is not null"))

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tells the texts of rows with equal ids apart
        row = TaskContext.get().partitionId() << 40
        for batch in (some for whole in batches for some in _portions(whole)):
            of, found, pos = all_minimizers(*word_hashes(batch["text"]))
            if len(of):
                columns = [batch["doc_id"].to_numpy()[of], row + of, found.view(np.int64), pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "part", "seed", "pos"])
            row += batch.num_rows

    seeds = freeze(rows.mapInArrow(sow, "doc_id long, part long, seed long, pos int"), "seeds", compression="zstd")

    def firsts(keys: DataFrame, key: str) -> DataFrame:
        """Of each key that several documents have, the first place."""
        first = keys.groupBy(key).agg(F.min(F.struct("doc_id", "pos")).alias("ref"), F.max("doc_id").alias("other"))
        return first.where("ref.doc_id < other").select(key, F.col("ref.doc_id").alias("ref_id"), F.col("ref.pos").alias("ref_pos"))

    # both sides come from tables, so a popular seed's partition can be split
    shared = freeze(firsts(seeds, "seed"), "shared-seeds")
    held = freeze(seeds.join(shared, "seed"), "held-seeds", compression="zstd")
    discard(seeds, shared)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for group in _groups(batches, ["doc_id", "part"]):
                doc_id = int(group["doc_id"][0])
                values = (group[c] for c in ("seed", "pos", "ref_id", "ref_pos"))
                for key, pos, far in scattered_runs(*values, min_piece):
                    yield doc_id, key, pos, far

        return _batches(found(), ["doc_id", "run", "pos", "far"], [_INT, _INT, pa.int32(), pa.int32()])

    # seeds that follow each other but were first seen apart are looked up again together
    ordered = held.repartition("doc_id").sortWithinPartitions("doc_id", "part", "pos")
    runs = freeze(ordered.mapInArrow(tie, "doc_id long, run long, pos int, far int"), "seed-runs")
    shared = freeze(firsts(runs, "run"), "shared-runs")
    again = runs.join(shared, "run").where("doc_id > ref_id")
    ends = F.explode(F.array(F.lit(0), F.col("far"))).alias("by")
    again = again.select("doc_id", "pos", "ref_id", "ref_pos", ends)
    again = again.select("doc_id", "ref_id", (F.col("pos") + F.col("by")).alias("pos"), (F.col("ref_pos") + F.col("by")).alias("ref_pos"))
    matches = held.where("doc_id > ref_id").select("doc_id", "ref_id", "pos", "ref_pos").unionByName(again)
    matches = matches.repartition("doc_id", "ref_id").sortWithinPartitions("doc_id", "ref_id", "pos", "ref_pos")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for group in _groups(batches, ["doc_id", "ref_id"], LEAST):
                left, right = group["pos"], group["ref_pos"]
                new = np.ones(len(left), bool)  # runs give the matches of their seeds again
                new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
                left, right = left[new], right[new]
                ids, at, to = (int(group["doc_id"][0]), int(group["ref_id"][0])), left.tolist(), right.tolist()
                for way in chains(left, right):
                    way = way.tolist()
                    a, b = [at[k] for k in way], [to[k] for k in way]
                    windows = [x for c in (a, b) for x in (max(0, c[0] // MARGIN - 1), (c[-1] + SEED) // MARGIN + 2)]
                    yield *ids, *windows, a, b

        names = ["doc_id", "ref_id", "d_from", "d_to", "r_from", "r_to", "left", "right"]
        return _batches(found(), names, [_INT] * 6 + [_LIST] * 2)

    linked = matches.mapInArrow(link, "doc_id long, ref_id long, d_from long, d_to long, r_from long, r_to long, left array<int>, right array<int>")
    linked = freeze(linked, "chains")
    discard(held, runs, shared)

    # the words around each chain, in steps of MARGIN words so that a popular passage is cut out once
    sides = linked.select("doc_id", F.col("d_from").alias("lo"), F.col("d_to").alias("hi")).unionByName(
        linked.select(F.col("ref_id").alias("doc_id"), F.col("r_from").alias("lo"), F.col("r_to").alias("hi"))
    )
    # lots of windows that lie together, so that a text is seldom copied and no list is long
    lot = [F.floor(F.col(c) / MARGIN).alias(f"{c}_lot") for c in ("lo", "hi")]
    asked = sides.distinct().groupBy("doc_id", *lot).agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    asked = freeze(asked.select("doc_id", "cuts"), "asked-windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in (some for whole in batches for some in _portions(whole)):
                words, starts = word_hashes(batch["text"])
                words = words.astype(np.uint32)
                starts = zip(starts.tolist(), starts[1:].tolist(), strict=False)
                for doc_id, (a, b), cuts in zip(batch["doc_id"].to_pylist(), starts, batch["cuts"].to_pylist(), strict=True):
                    own = words[a:b]
                    for c in cuts:
                        yield doc_id, c["lo"], c["hi"], own[c["lo"] * MARGIN : c["hi"] * MARGIN].tobytes()

        return _batches(found(), ["doc_id", "lo", "hi", "words"], [_INT] * 3 + [pa.binary()], 500)

    # documents are shuffled at any size of the table, so that disk grows no faster than it
    pieces = rows.join(asked.hint("merge"), "doc_id").mapInArrow(cut, "doc_id long, lo long, hi long, words binary")
    pieces = freeze(pieces, "windows", compression="zstd")
    discard(asked)
    of_doc = pieces.select("doc_id", F.col("lo").alias("d_from"), F.col("hi").alias("d_to"), F.col("words").alias("d_words"))
    of_ref = pieces.select(F.col("doc_id").alias("ref_id"), F.col("lo").alias("r_from"), F.col("hi").alias("r_to"), F.col("words").alias("r_words"))
    both = linked.join(of_doc, ["doc_id", "d_from", "d_to"]).join(of_ref, ["ref_id", "r_from", "r_to"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in batches:
                places = batch["left"].offsets.to_numpy()
                left, right = (batch[c].flatten().to_numpy() for c in ("left", "right"))
                each = zip(*(batch[c].to_numpy().tolist() for c in ("doc_id", "d_from", "ref_id", "r_from")), strict=True)
                places = (places - places[0]).tolist()
                spans = zip(places, places[1:], strict=False)
                for (doc_id, d, ref_id, e), (i, j), a, b in zip(each, spans, _words(batch["d_words"]), _words(batch["r_words"]), strict=True):
                    d, e = d * MARGIN, e * MARGIN
                    for x, x_end, y, _, edits in good_parts(a, b, left[i:j] - d, right[i:j] - e, min_piece, percent):
                        yield doc_id, x + d, x_end + d, ref_id, y + e, edits

        return _batches(found(), ["doc_id", "start", "stop", "ref_id", "ref_start", "edits"], [_INT] * 6)

    verified = both.mapInArrow(check, "doc_id long, start long, stop long, ref_id long, ref_start long, edits long").distinct()
    verified = freeze(verified, "verified-chains")
    discard(linked, pieces)
    verified = verified.repartition("doc_id").sortWithinPartitions("doc_id", "start", F.desc("stop"), "ref_id", "ref_start")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for group in _groups(batches, ["doc_id"]):
                doc_id, run = int(group["doc_id"][0]), []
                rows = list(zip(*[group[c].tolist() for c in ("start", "stop", "ref_id", "ref_start", "edits")], strict=True))
                for row in [*rows, None]:
                    if run and (row is None or row[0] > stop + 2):
                        if stop - run[0][0] >= min_words:
                            best = min(run, key=lambda r: (r[0] - r[1], r[2], r[3]))
                            identity = 1 - best[4] / (best[1] - best[0])
                            yield doc_id, run[0][0], stop - run[0][0], best[2], best[3], max(identity, 0.0), sorted({r[2] for r in run})
                        run = []
                    if row is not None:
                        stop = max(stop, row[1]) if run else row[1]
                        run.append(row)

        names = ["doc_id", "start_word", "n_words", "ref_doc_id", "ref_start", "identity", "ref_doc_ids"]
        return _batches(found(), names, [_INT] * 5 + [pa.float64(), pa.list_(_INT)])

    return verified.mapInArrow(merge, "doc_id long, start_word long, n_words long, ref_doc_id long, ref_start long, identity double, ref_doc_ids array<long>")
