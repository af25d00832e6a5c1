"""Ranked lexical search: accumulators of short lists meet skipping over long ones."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import freeze, spread

# Items searched in one pass have at most about this many different terms each, summed up.
BLOCK_TERMS = 200_000
# A segment of the index holds this many documents (or one that has more postings by itself).
SEGMENT_DOCS = 4_096
SEGMENT_POSTINGS = 1_000_000

_WORD = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b >= 0x80 or b in _WORD else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """The runs of ASCII letters, digits and all characters beyond ASCII; only A-Z is lowered."""
    return text.translate(_TABLE).split()


def weight(documents: int, holding: int) -> int:
    """A term's weight from the number of documents and of those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, term, times`` for every row of ``items``; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, item_id, text in zip(batch["item"].to_pylist(), batch["item_id"], batch["text"].to_pylist(), strict=True):
                out += [(item, item_id.as_py(), t, n) for t, n in Counter(terms(text or b"")).items()]
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
            types = [pa.int64(), batch["item_id"].type, pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item", "item_id", "term", "times"])

    kind = dict(items.dtypes)["item_id"]
    return items.mapInArrow(run, f"item long, item_id {kind}, term binary, times long")


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, found, tf``: every document's number of terms, and those of the vocabulary with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            sizes, found, counts = [], [], []
            for text in batch["text"]:
                own = terms(text.as_py() or b"")
                tally = Counter([i for i in map(vocabulary.get, own) if i is not None])
                sizes.append(len(own))
                found.append(list(tally.keys()))
                counts.append(list(tally.values()))
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(found, lists[0]), pa.array(counts, lists[1])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "found", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, found array<int>, tf array<long>")


class Segment:
    """Inverted lists over some documents: per term the documents in ascending order and its impact in each.

    A posting's impact is what it adds to a score for a weight of one; it does not
    depend on the item, so it is computed once for all of them.
    """

    def __init__(self, sizes: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int, total: int):
        self.size = len(sizes)
        norm = 100 - 25 + np.array([(25 * int(n) * documents) // total for n in sizes], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * norm[owner])
        order = np.lexsort((owner, term))
        self.docs, self.impact = owner[order], impact[order]
        self.names, starts = np.unique(term[order], return_index=True)
        self.starts = np.append(starts, len(term))
        self.top = np.maximum.reduceat(self.impact, starts) if len(starts) else np.zeros(0, np.int64)

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of sorted ``wanted`` terms lie, and which of them exist here."""
        if not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.names, wanted), len(self.names) - 1)
        here = np.flatnonzero(self.names[at] == wanted)
        return at[here], here

    def slice(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[at], self.starts[at + 1])
        return self.docs[part], self.impact[part]


def search_segment(segment: Segment, wanted: np.ndarray, factors: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment, ascending, that may score above ``floor``, and their exact scores.

    ``factors`` are weight times repeats of the ``wanted`` terms.  Lists that are
    short beside the segment are summed term at a time into accumulators.
    From there on these count as one list with one bound, among the long ones.  Lists whose
    bounds together cannot pass the floor propose no documents; those that
    others propose are looked up in them by search, the strongest list first, and a document
    leaves as soon as what is left cannot lift it above the floor.
    """
    none = np.zeros(0, np.int64)
    at, here = segment.lists(wanted)
    at, factor = at[factors[here] > 0], factors[here][factors[here] > 0]
    if not len(at):
        return none, none
    length = segment.starts[at + 1] - segment.starts[at]
    short = length * 16 <= segment.size
    lists = []
    if short.any():
        parts = [(segment.slice(i), f) for i, f in zip(at[short], factor[short], strict=True)]
        touched = np.concatenate([docs for (docs, _), _ in parts])
        docs, place = np.unique(touched, return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, place, np.concatenate([impact * f for (_, impact), f in parts]))
        lists.append((int(sums.max()), docs, sums))
    for i, f in zip(at[~short], factor[~short], strict=True):
        docs, impact = segment.slice(i)
        lists.append((int(segment.top[i]) * int(f), docs, (impact, int(f))))
    lists.sort(key=lambda entry: -entry[0])
    bounds = [bound for bound, *_ in lists]
    left = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what lists from here on can add at most

    # the lists that propose: without them no document passes the floor
    proposing = max(1, int(np.searchsorted(-left, -floor, side="left")))
    if left[0] <= floor:
        return none, none
    proposed = lists[0][1] if proposing == 1 else np.unique(np.concatenate([docs for _, docs, _ in lists[:proposing]]))
    scores = np.zeros(len(proposed), np.int64)
    for number, (_, docs, values) in enumerate(lists):
        keep = scores + left[number] > floor
        if not keep.all():
            proposed, scores = proposed[keep], scores[keep]
        if not len(proposed):
            return none, none
        where = np.minimum(np.searchsorted(docs, proposed), len(docs) - 1)
        hit = np.flatnonzero(docs[where] == proposed)
        gained = values[0][where[hit]] * values[1] if isinstance(values, tuple) else values[where[hit]]
        scores[hit] += gained
    keep = scores > floor
    return proposed[keep], scores[keep]


def _segments(batches: Iterator[pa.RecordBatch], documents: int, total: int) -> Iterator[tuple[list, Segment]]:
    """Documents in segments of bounded size, with their ids."""
    held: list[pa.RecordBatch] = []
    rows = postings = 0

    def close() -> tuple[list, Segment]:
        table = pa.Table.from_batches(held).combine_chunks()
        found, tf = table["found"].combine_chunks(), table["tf"].combine_chunks()
        owner = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
        sizes = table["n"].to_numpy()
        return table["doc_id"].to_pylist(), Segment(sizes, owner, found.flatten().to_numpy(), tf.flatten().to_numpy(), documents, total)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held.append(part)
            rows += part.num_rows
            postings += len(part["found"].flatten())
            if rows >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                yield close()
                held, rows, postings = [], 0, 0
    if held:
        yield close()


def _best(postings: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], documents: int, total: int, top: int) -> DataFrame:
    """``item, doc_id, score``: the best documents of every task's share of the index for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a heap of (score, -row) per item; the row number stands for the order of ids
        heaps: list[list] = [[] for _ in queries]
        for ids, segment in _segments(batches, documents, total):
            for (_, wanted, factors), heap in zip(queries, heaps, strict=True):
                # an equal score can still win by its id, so the floor is one below the weakest kept
                floor = heap[0][0] - 1 if len(heap) == top else 0
                docs, scores = search_segment(segment, wanted, factors, floor)
                if len(docs) > top:
                    # ties at the edge are kept whole: ids decide among them
                    edge = np.partition(scores, len(scores) - top)[len(scores) - top]
                    docs, scores = docs[scores >= edge], scores[scores >= edge]
                for doc, score in zip(docs.tolist(), scores.tolist(), strict=True):
                    own = ids[doc]
                    entry = (score, own is None, 0 if own is None else -own)
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        rows = [(item, None if none else -negative, score) for (item, *_), heap in zip(queries, heaps, strict=True) for score, none, negative in heap]
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    *,
    top: int = 20,
    block_terms: int = BLOCK_TERMS,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``top`` documents of each item: ``item_id, rank, doc_id, score``, equal scores by ascending id.

    The score of a document is the sum over the item's terms, repeats
    included, of ``weight`` times the term's saturated and length-normalised
    frequency, in 64-bit integers; documents with score 0 are not ranked.

    One pass over the texts keeps, per document, its length and the counts of the
    terms that items ask for; document frequencies, the number of documents with a
    term and their total length are sums over all of it.  The index is partitioned by
    document: every task takes segments of bounded size, searches them for all items
    (``search_segment``) with the weakest score it holds so far as the floor, and returns its best
    documents, of which a window keeps the best of all.  No list of documents of a
    term, however frequent, and no group of copies ever meets in one task.  Items come in
    blocks of about ``block_terms`` terms, so that what a task holds of them is bounded.

    Defined cases: null and empty texts have no terms and are never found, items without
    terms give no row; rows of items with equal or null ids are items of their own;
    rows of documents with equal ids are documents of their own, a null id comes
    first among equal scores; empty tables give an empty result; other columns are ignored.
    """
    rows = spread(docs.select(docs[doc_id].cast("bigint").alias("doc_id"), docs[doc_text].cast("string").cast("binary").alias("text")))
    asked = items.select(F.monotonically_increasing_id().alias("item"), items[item_id].alias("item_id"), items[item_text].cast("string").cast("binary").alias("text"))
    asked = freeze(_item_terms(asked), "item-terms")
    blocks = max(1, -(-asked.count() // block_terms))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    names = asked.select("item", "item_id").distinct()
    found = None
    for number in range(blocks):
        here = _search_block(rows, asked.where(block == number), top)
        found = here if found is None else found.unionByName(here)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _search_block(rows: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """The best documents for the items of one block, whose terms the driver holds."""
    spark = rows.sparkSession
    held = asked.select("item", "term", "times").collect()
    vocabulary = {bytes(t): i for i, t in enumerate(sorted({bytes(r["term"]) for r in held}))}
    nothing = spark.createDataFrame([], "item long, doc_id long, score long")
    if not vocabulary:
        return nothing
    postings = freeze(_postings(rows, vocabulary), "postings", compression="zstd")
    documents, total = postings.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return nothing
    counted = postings.select(F.explode("found").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = {r["term"]: weight(documents, r["df"]) for r in counted.collect()}
    wanted: dict[int, list[tuple[int, int]]] = {}
    for r in held:
        term = vocabulary[bytes(r["term"])]
        if term in weights:
            wanted.setdefault(r["item"], []).append((term, weights[term] * r["times"]))
    queries = []
    for item, pairs in sorted(wanted.items()):
        pairs.sort()
        queries.append((item, np.array([t for t, _ in pairs], np.int32), np.array([f for _, f in pairs], np.int64)))
    return freeze(_best(postings, queries, documents, total, top), "ranked")
