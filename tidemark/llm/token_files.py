"""Token ids in Arrow files of equal-length sequences."""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.encoding import portions, shared_encoder
from tidemark.llm.tables import texts
from tidemark.sources.scratch import scratch_path

_MANIFEST = "shard long, file string, n_docs long, n_tokens long, n_sequences long"


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def file_schema(length: int, wide: bool) -> pa.Schema:
    """One row per sequence: ids, a mask (false on padding), and the documents that begin in it."""
    ids = pa.uint32() if wide else pa.uint16()
    return pa.schema([
        ("input_ids", pa.list_(pa.field("item", ids, False), length)),
        ("mask", pa.list_(pa.field("item", pa.bool_(), False), length)),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_starts", pa.list_(pa.int32())),
    ])


class _Writer:
    """Cuts a stream of documents into sequences and writes batches of equally many."""

    def __init__(self, sink, schema: pa.Schema, length: int, rows: int):
        self.schema, self.length, self.rows = schema, length, rows
        self.ids = schema.field("input_ids").type.value_type.to_pandas_dtype()
        self.out = pa.ipc.new_file(sink, schema)
        self.tokens = np.zeros(length * rows, self.ids)
        self.used = self.sequences = 0
        self.marks: list[tuple[int, int | None]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.used == len(self.tokens):
            self._flush()
        self.marks.append((self.used, doc_id))
        while len(ids):
            if self.used == len(self.tokens):
                self._flush()
            part = ids[: len(self.tokens) - self.used]
            self.tokens[self.used : self.used + len(part)] = part
            self.used += len(part)
            ids = ids[len(part) :]

    def _flush(self) -> None:
        n = -(-self.used // self.length)
        if not n:
            return
        self.tokens[self.used :] = 0
        at = np.array([m for m, _ in self.marks], np.int64)
        bounds = np.searchsorted(at, np.arange(n + 1) * self.length).astype(np.int32)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))
        end = n * self.length
        self.out.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(self.tokens[:end].copy()), type=self.schema.field("input_ids").type),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(end) < self.used), type=self.schema.field("mask").type),
            lists([d for _, d in self.marks], pa.int64()),
            lists(at % self.length, pa.int32()),
        ], schema=self.schema))
        self.sequences += n
        self.used, self.marks = 0, []

    def close(self) -> None:
        self._flush()
        self.out.close()


@dataclass(frozen=True)
class TokenFiles:
    """What ``write_token_files`` wrote: a folder of Arrow files and the list of them."""

    folder: str
    length: int
    rows_per_batch: int

    def manifest(self, spark: SparkSession) -> DataFrame:
        """One row per file, in document order, with the number of real ids before it."""
        files = spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return files.withColumn("tokens_before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    *,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    length: int = 2048,
    rows_per_batch: int = 64,
) -> TokenFiles:
    """Write the ids of all texts, in ascending id order, as sequences of ``length`` ids.

    Documents follow each other without gaps, each closed by ``end_id``.  A file
    holds one range of document ids; only its last sequence is padded, and the
    mask is false there.  All batches of a file but the last have
    ``rows_per_batch`` sequences and nothing is compressed, so sequence ``i`` lies
    at a known place of a memory-mapped file (see ``sequence``).  Ids take 16
    bits where the vocabulary allows it, else 32.

    A task that is run again writes a new file; only files named in the manifest
    count.  Memory per task: one Arrow batch of texts and one batch of sequences.

    Defined cases: null and empty texts are the end id alone; a null document id
    sorts first and stays null; rows with equal ids keep an order by content;
    an empty table gives an empty manifest; other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    wide = max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) > 0xFFFF
    schema = file_schema(length, wide)
    dtype = "<u4" if wide else "<u2"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        n_docs = n_tokens = 0
        for batch in batches:
            if batch.num_rows and out is None:
                encoder, end = shared_encoder(tokenizer, dtype), np.array([end_id], dtype).tobytes()
                system, inner = _open(folder)
                system.create_dir(inner, recursive=True)
                shard = TaskContext.get().partitionId()
                name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}.arrow"
                sink = system.open_output_stream(posixpath.join(inner, name))
                out = _Writer(sink, schema, length, rows_per_batch)
            rows = zip(batch["doc_id"].to_pylist(), (t.as_py() for t in batch["text"]), strict=True)
            for doc_ids, some in portions(rows):
                for doc_id, packed in zip(doc_ids, encoder.encode(some), strict=True):
                    ids = np.frombuffer(packed + end, dtype)
                    out.add(doc_id, ids)
                    n_docs += 1
                    n_tokens += len(ids)
        if out is not None:
            out.close()
            sink.close()
            row = [[shard], [name], [n_docs], [n_tokens], [out.sequences]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in row], names=["shard", "file", "n_docs", "n_tokens", "n_sequences"]
            )

    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return TokenFiles(folder, length, rows_per_batch)


def sequence(path: str, index: int, rows_per_batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a local file; the ids are a view of the mapped file."""
    with pa.memory_map(path) as source:
        batch = pa.ipc.open_file(source).get_batch(index // rows_per_batch)
        row = index % rows_per_batch
        ids = batch["input_ids"]
        length = ids.type.list_size
        values = ids.values.to_numpy(zero_copy_only=True)[(ids.offset + row) * length :][:length]
        return values, np.asarray(batch["mask"][row].values)


def read_documents(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it.  Files are read batch by
    batch, each by one task; a document is never held whole.
    """
    folder = files.folder

    def finished(found: list) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
        return out.astype({"doc_id": "Int64"})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, at in zip(frame["file"], frame["tokens_before"], strict=True):
                system, inner = _open(folder)
                with system.open_input_file(posixpath.join(inner, name)) as source:
                    reader = pa.ipc.open_file(source)
                    current, size, crc = None, -1, 0
                    for k in range(reader.num_record_batches):
                        batch = reader.get_batch(k)
                        length = batch["input_ids"].type.list_size
                        real = int(np.count_nonzero(np.asarray(batch["mask"].values)))
                        ids = batch["input_ids"].values.to_numpy()[:real].astype("<u4")
                        per = np.diff(np.asarray(batch["doc_ids"].offsets))
                        starts = np.repeat(np.arange(batch.num_rows) * length, per) + np.asarray(batch["doc_starts"].values)
                        found, last = [], 0
                        for doc_id, where in zip(batch["doc_ids"].values.to_pylist(), starts.tolist(), strict=True):
                            if size >= 0:
                                crc, size = zlib.crc32(ids[last:where], crc), size + where - last
                                found.append((current, at, size, crc))
                                at += size
                            current, size, crc, last = doc_id, 0, 0, where
                        crc, size = zlib.crc32(ids[last:], crc), size + real - last
                        if found:
                            yield finished(found)
                    if size >= 0:
                        yield finished([(current, at, size, crc)])

    listed = files.manifest(spark).select("shard", "file", "tokens_before")
    spread = listed.repartition(spark.sparkContext.defaultParallelism * 4, "shard")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
