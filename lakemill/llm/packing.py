"""Best-fit packing of tokenised documents into sequences under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import encoder

#: Words whose ids a task remembers, in each of two generations of about 200 bytes a word.
WORDS = 300_000
#: Pieces that one task packs, about. A task's partly filled last sequence is under a thousandth of its own, so few pieces go to one task.
PIECES_A_TASK = 100_000


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold: tokens, documents, and attention cost (the sum of squared piece lengths).

    With every document masked to itself the cost of a full sequence is at most tokens squared; lower values keep very long
    pieces apart from others.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, size: int, spaces: str = "leading", id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Cut each document's ids (its text's, then end_id) into pieces of at most `size`: doc_id, piece, start, length, ids_crc32.

    Only documents longer than `size` are cut: every piece but the first has exactly `size` ids. Null texts count as
    empty. Rows are handled one by one: null or repeated ids stay as they are.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, spaces, words), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    out += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, cap: Capacity, score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.2)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack pieces, longest first. Returns (bin, order in which they were placed, offset) by piece.

    A bin's residual is a vector: tokens, documents and attention cost left, each as a share of its capacity. Only bins that can take
    the piece under every constraint are candidates. 'norm' takes the one whose weighted residual is smallest afterwards,
    'dot' the one with the largest weighted dot product of demand and residual. Bins with equal residuals are interchangeable
    and share one stack, so a step looks at distinct residuals and not at every bin.
    """
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    caps = np.asarray([cap.tokens, cap.documents, cap.attention], float)
    w = np.asarray(weights)
    stacks: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(cap.tokens + 1)]
    filled = np.zeros(cap.tokens + 1, bool)  # by residual tokens: is there any bin
    bins = 0
    for i in order:
        size = int(lengths[i])
        cost = size * size
        best = None
        r = size + int(filled[size:].argmax()) if size <= cap.tokens else cap.tokens + 1
        while r <= cap.tokens and filled[r]:
            for (d, a), _ in stacks[r].items():
                if d < 1 or a < cost:
                    continue
                left = np.asarray([r - size, d - 1, a - cost]) / caps
                value = -float(w @ (left * left)) if score == "norm" else float(w @ (np.asarray([size, 1, cost]) / caps * (np.asarray([r, d, a]) / caps)))
                if best is None or value > best[0]:
                    best = (value, r, (d, a))
            # With 'norm' more residual tokens than the best value allows can't win; with 'dot' all are looked at.
            if best is not None and score == "norm" and w[0] * ((r + 1 - size) / caps[0]) ** 2 >= -best[0]:
                break
            step = int(filled[r + 1 :].argmax()) if r < cap.tokens else 0
            r = r + 1 + step if r < cap.tokens and filled[r + 1 + step] else cap.tokens + 1
        if best is None:
            b, r, (d, a) = bins, cap.tokens, (cap.documents, cap.attention)
            bins += 1
        else:
            _, r, key = best
            stack = stacks[r][key]
            b, (d, a) = stack.pop(), key
            if not stack:
                del stacks[r][key]
                filled[r] = bool(stacks[r])
        where[i], offset[i] = b, cap.tokens - r
        if r - size > 0:
            stacks[r - size].setdefault((d - 1, a - cost), []).append(b)
            filled[r - size] = True
    return where, order, offset


def pack(pieces: DataFrame, cap: Capacity = Capacity(), score: str = "norm") -> DataFrame:
    """Pieces with sequence_id and offset added. Pieces are dealt to tasks at random by their own hash; each task packs its own.

    A piece longer than cap.tokens or costlier than cap.attention fits nowhere and raises ValueError. No pieces give no rows.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = cut(pieces.select(*names), "pieces")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = list(batches)
        if own:
            t = pa.Table.from_batches(own).combine_chunks().sort_by([(c, "ascending") for c in names])
            n = t.column("length").to_numpy()
            if n.max(initial=0) > cap.tokens or int(n.max(initial=0)) ** 2 > cap.attention or cap.documents < 1:
                raise ValueError("a piece exceeds a sequence's capacity")
            where, _, offset = best_fit(n, cap, score)
            base = TaskContext.get().partitionId() << 40
            yield from t.append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset)).to_batches(50_000)

    many = max(1, -(-rows.count() // PIECES_A_TASK))
    return rows.repartition(many, F.xxhash64(*names)).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, cap: Capacity = Capacity(), spaces: str = "leading", words: int = WORDS) -> DataFrame:
    """Tokenise, cut and pack whole documents. words: how many words a task remembers."""
    return pack(tokenize(docs, tokenizer, end_id, cap.tokens, spaces, words=words), cap)
