"""Token-id output: flat unsigned integer files with 64-bit document offsets, written for memory mapping.

Format, in one folder: `tokens-00007.bin` holds the ids of a partition's documents one after another, little-endian
unsigned 16-bit if every id fits, else 32-bit; `offsets-00007.bin` holds, as little-endian unsigned 64-bit integers, the place of
each of its documents in the whole corpus and, last, the place where the partition ends. Offsets count ids, not bytes. Partition numbers
follow ascending document ids, so the files one after another are the corpus. A file is written under another name
and renamed when complete, so a repeated or speculative task leaves the same file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, is_empty, new_path, row_parts
from .tokens import encoder

#: Words whose ids a task remembers, in each of two generations.
WORDS = 400_000
#: Documents of one token file, about.
DOCS_A_FILE = 100_000


@dataclass(frozen=True)
class TokenFiles:
    """What write() has made: the folder, its files (part, n_docs, n_tokens, base) and its documents (part, at, doc_id)."""

    path: str
    width: int
    files: DataFrame
    doc_ids: DataFrame


def _store(uri: str):
    """The file system of a shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(uri: str, name: str, chunks: Iterator[bytes]) -> None:
    store, path = _store(uri)
    store.create_dir(path, recursive=True)
    own = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for chunk in chunks:
            f.write(chunk)
    store.move(own, f"{path}/{name}")


def _get(uri: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is local to the machine, else read."""
    from pyarrow import fs

    store, path = _store(uri)
    if not store.get_file_info(f"{path}/{name}").size:
        return np.empty(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype, "r")
    with store.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes of an id: 2 if the whole vocabulary and end_id fit, else 4."""
    with open(tokenizer, encoding="utf-8") as f:
        file = json.load(f)
    largest = max(end_id, *file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"]))
    return 2 if largest < 1 << 16 else 4


def write(docs: DataFrame, tokenizer: str, end_id: int, width: int | None = None, spaces: str = "dropped", id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every text, append end_id, and write the files in ascending id order.

    Null texts count as empty and still get end_id. Rows with a null id come first; rows with equal ids
    follow one another in the order of their texts. An empty table gives a folder without documents. Other columns are not read.
    Partitions are ranges of ids, dealt by a sample; each task holds one Arrow batch and one file's lengths.
    width: bytes of an id, by default as few as the vocabulary needs; ValueError if that is more.
    """
    need = id_width(tokenizer, end_id)
    width = width or need
    if width < need:
        raise ValueError("the vocabulary does not fit into this width")
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dtype = f"<u{width}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, lengths, ids = TaskContext.get().partitionId(), [], []

        def chunks() -> Iterator[bytes]:
            enc, end = encoder(tokenizer, spaces, WORDS), np.asarray([end_id], "<u4").tobytes()
            for b in batches:
                ids.append(b.column(0))
                for a in range(0, b.num_rows, 1024):
                    out = [x + end for x in enc.encode(b.column(1).slice(a, 1024).to_pylist())]
                    lengths.extend(len(x) // 4 for x in out)
                    yield np.frombuffer(b"".join(out), "<u4").astype(dtype).tobytes()

        _put(folder, f"tokens-{part:05d}.bin", chunks())
        if lengths:
            n = pa.array(lengths, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(range(len(n)), pa.int64()), pa.concat_arrays(ids), n], ["part", "at", "doc_id", "n_tokens"])

    many = row_parts(spark, docs.count(), DOCS_A_FILE)
    dealt = rows.repartitionByRange(many, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    lengths = cut(dealt.mapInArrow(encode, "part int, at long, doc_id long, n_tokens long"), "token-lengths")
    return TokenFiles(folder, width, _offsets(folder, lengths), lengths.select("part", "at", "doc_id"))


def _offsets(folder: str, lengths: DataFrame) -> DataFrame:
    """Write the offset files. Partition bases are prefix sums over one row a partition."""
    from pyspark.sql import Window as W

    totals = lengths.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = cut(totals.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-files")

    def put(key: tuple, batch: pa.Table) -> pa.Table:
        t = batch.sort_by("at")
        n = t.column("n_tokens").to_numpy()
        base = t.column("base")[0].as_py()
        out = np.concatenate([[0], np.cumsum(n)]).astype("<u8") + np.uint64(base)
        _put(folder, f"offsets-{key[0].as_py():05d}.bin", iter([out.tobytes()]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32())})

    # A file is as many rows as DOCS_A_FILE says, so a group is bounded.
    lengths.join(files.select("part", "base"), "part").groupBy("part").applyInArrow(put, "part int").count()
    return files


def read(files: TokenFiles, spark: SparkSession) -> DataFrame:
    """Read the files back: a row a document in corpus order: part, at, start, n_tokens, ids_crc32.

    ids_crc32 is the crc32 of the document's ids as little-endian unsigned 32-bit integers.
    """
    folder, dtype = files.path, f"<u{files.width}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                ids, at = _get(folder, f"tokens-{part:05d}.bin", dtype), _get(folder, f"offsets-{part:05d}.bin", "<u8")
                base = int(at[0])
                for a in range(0, len(at) - 1, 5000):
                    own = at[a : a + 5001].astype(np.int64)
                    crc = [zlib.crc32(ids[s - base : e - base].astype("<u4").tobytes()) for s, e in zip(own[:-1], own[1:], strict=True)]
                    k = len(crc)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(range(a, a + k), pa.int64()), pa.array(own[:-1]), pa.array(np.diff(own)), pa.array(crc, pa.int64())], ["part", "at", "start", "n_tokens", "ids_crc32"])

    schema = "part int, at long, start long, n_tokens long, ids_crc32 long"
    if is_empty(files.files):
        return spark.createDataFrame([], schema)
    parts = files.files.select("part")
    return parts.repartition(max(1, parts.count()), "part").mapInArrow(scan, schema)
