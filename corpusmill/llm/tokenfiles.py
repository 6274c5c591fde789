"""Token ids in Arrow files of equal-length sequences.

A shard holds a range of doc_id as one Arrow file: record batches whose ``ids`` and ``mask``
columns are fixed-size lists, uncompressed, so row r of a memory-mapped batch lies at r times
the length, with no copy. ``docs`` lists the documents of a sequence (doc_id, place, tokens,
whether the document begins there). Only a shard's last sequence is padded; its mask says so.
A task writes under a name of its own and then renames, so a repeated task replaces its file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import shuffle_parts, text_of
from corpusmill.llm.tokenizing import ids_of
from corpusmill.session import materialise, shared_folder

LENGTH, ROWS_A_BATCH = 2048, 64
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_sequences long"
_DOC = pa.struct([("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("first", pa.bool_())])


class ShardWriter:
    """One file: documents in, batches out as soon as they are full."""

    def __init__(self, path: str, shard: int, vocab: int, length: int):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part, self.length = f"{self.path}.{uuid.uuid4().hex}", length
        self.kind = pa.uint16() if vocab <= 1 << 16 else pa.uint32()
        schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("docs", pa.list_(_DOC))], {"shard": str(shard), "length": str(length)})
        self.out = self.fs.open_output_stream(self.part)
        self.file = pa.ipc.new_file(self.out, schema)
        self.held: list[np.ndarray] = []
        self.count, self.n_docs, self.n_tokens, self.n_rows = 0, 0, 0, 0
        self.docs: list[list[tuple]] = [[]]

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        left, first, at = len(ids), True, self.n_tokens % self.length
        while left:
            n = min(left, self.length - at)
            self.docs[-1].append((doc, at, n, first))
            left, first, at = left - n, False, at + n
            if at == self.length:
                self.docs.append([])
                at = 0
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.count += len(ids)
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + len(ids)
        if self.count >= self.length * ROWS_A_BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.kind.to_pandas_dtype())
        rows = -(-len(flat) // self.length) if last else len(flat) // self.length
        own = flat[: rows * self.length]
        rest = flat[len(own) :]
        mask = np.zeros(rows * self.length, bool)
        mask[: len(own)] = True
        own = np.concatenate([own, np.zeros(rows * self.length - len(own), own.dtype)])
        for i in range(0, rows, ROWS_A_BATCH):
            a, b = i * self.length, min(rows, i + ROWS_A_BATCH) * self.length
            lists = self.docs[i : min(rows, i + ROWS_A_BATCH)]
            flat_docs = pa.array([dict(zip(("doc_id", "at", "n", "first"), d, strict=True)) for x in lists for d in x], _DOC)
            offsets = np.cumsum([0, *map(len, lists)]).astype("int32")
            self.file.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(own[a:b]), self.length),
                pa.FixedSizeListArray.from_arrays(pa.array(mask[a:b]), self.length),
                pa.ListArray.from_arrays(pa.array(offsets), flat_docs),
            ], names=["ids", "mask", "docs"]))
        self.n_rows += rows
        self.held, self.count, self.docs = [rest], len(rest), self.docs[rows:]

    def close(self) -> None:
        if self.docs and not self.docs[-1]:
            self.docs.pop()
        self._flush(True)
        self.file.close()
        self.out.close()
        self.fs.move(self.part, self.path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, length: int = LENGTH, shards: int | None = None) -> DataFrame:
    """Writes ``folder``/shard-N.arrow and returns the manifest, a row a shard, with its first token's place.

    Documents are dealt by ranges of doc_id and sorted in each; a null text is the end id
    alone, null ids come first, repeated rows are written each, an empty table writes nothing.
    """
    spark = docs.sparkSession
    n = shards or max(2 * shuffle_parts(spark), 8)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out = TaskContext.get().partitionId(), None
        encode = ids_of(tokenizer)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = out or ShardWriter(f"{folder}/shard-{shard:06d}.arrow", shard, encode.size, length)
                out.add(doc, np.frombuffer(encode(text.as_py()) + end, "<u4"))
        if out:
            out.close()
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{folder}/shard-{shard:06d}.arrow"]), *[pa.array([x], pa.int64()) for x in (out.n_docs, out.n_tokens, out.n_rows)]], names=["shard", "path", "n_docs", "n_tokens", "n_sequences"])

    dealt = docs.select("doc_id", text_of().alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = materialise(dealt.mapInArrow(write, MANIFEST), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")  # a row a file
    return manifest.withColumn("first_token", before.cast("long"))


def read_file(data: bytes) -> tuple[int, np.ndarray, list, np.ndarray]:
    """(shard, its tokens, doc_ids, token count of each document)."""
    file = pa.ipc.open_file(pa.py_buffer(data))
    ids, docs, n, first = [], [], [], []
    for i in range(file.num_record_batches):
        b = file.get_batch(i)
        ids.append(b.column("ids").flatten().to_numpy()[b.column("mask").flatten().to_numpy(zero_copy_only=False)])
        d = b.column("docs").flatten()
        docs += d.field("doc_id").to_pylist()
        n.append(d.field("n").to_numpy())
        first.append(d.field("first").to_numpy(zero_copy_only=False))
    starts = np.flatnonzero(np.concatenate(first))
    return int(file.schema.metadata[b"shard"]), np.concatenate(ids), [docs[i] for i in starts], np.add.reduceat(np.concatenate(n), starts)


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a manifest."""
    schema = "shard int, doc_id long, at long, n_tokens long, ids_crc32 long"
    paths = [r["path"] for r in manifest.select("path").collect()]  # a row a file
    if not paths:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard, ids, docs, n = read_file(data.as_buffer())
                wide, at = ids.astype("<u4"), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.record_batch([pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(at[:-1]), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = spark.read.format("binaryFile").load(paths).select("content").mapInArrow(read, schema)
    return rows.join(F.broadcast(manifest.select("shard", "first_token")), "shard").select("doc_id", (F.col("first_token") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Writes the files under the shared folder and reads every document back from them."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return read_documents(spark, write_token_files(docs, folder, tokenizer, end_id, length))
