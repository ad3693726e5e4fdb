"""Near-duplicate vectors by randomised-rotation binary codes.

Every vector is scaled to length one, rotated by a seeded random rotation and kept as its signs, with a correction factor: the
inner product of the rotated vector and its scaled sign vector. Signs and factor give an unbiased estimate of
the inner product with any other vector, and a bound on its error; only pairs whose upper bound reaches the threshold are
computed again from the vectors, in double precision. Vectors meet in pairs of blocks within their group, so that a
group of any size is many tasks; a block pair reports counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, uncut

#: Vectors of one block.
BLOCK = 1024
#: Standard deviations of the estimate that the bound allows: of true pairs, about one in 10**9 is beyond it and lost.
BOUND = 6.0
SEED = 20240521
#: Pairs that are computed again at once.
AT_ONCE = 100_000


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and correction factors of unit vectors (rows)."""
    turned = unit @ rotation(unit.shape[1]).T
    factor = np.abs(turned).sum(1) / np.sqrt(unit.shape[1])
    return np.packbits(turned > 0, axis=1), factor


def estimate(unit: np.ndarray, bits: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of unit vectors (rows) with coded ones (columns), and the error bound by column."""
    dim = unit.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (unit @ rotation(dim).T).astype(np.float32)
    est = (turned @ signs.T) / (np.sqrt(dim) * factor)
    err = BOUND * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1)) + 1e-5
    return est, err


def linked(a: np.ndarray, b: np.ndarray, bits: np.ndarray, factor: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b (raw vectors) with cosine >= least, in double precision. same: a is b, each pair once."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(a), 256):
        est, err = estimate(a[s : s + 256] / na[s : s + 256, None], bits, factor)
        i, j = np.nonzero(est + err >= least)
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), AT_ONCE):
            x, y = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
            cos = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
            out.append((x[cos >= least], y[cos >= least]))
    return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (np.empty(0, int), np.empty(0, int))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component under the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def encode(rows: DataFrame, id_col: str, vector_col: str, group_col: str) -> DataFrame:
    """id, group, dim, digest, vector, bits, factor. digest is null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups, n = b.column(1).to_pylist(), b.num_rows
            out: dict[str, list] = {k: [None] * n for k in ("dim", "digest", "vector", "bits", "factor")}
            by: dict[int, list[tuple[int, np.ndarray]]] = {}
            for k, v in enumerate(b.column(2).to_pylist()):
                x = None if groups[k] is None or not v or None in v else np.asarray(v, np.float64)
                if x is not None and np.isfinite(x).all() and x.any():
                    by.setdefault(len(x), []).append((k, x))
            for dim, own in by.items():
                x = np.stack([v for _, v in own])
                # A power of two changes no cosine, and keeps squares from over- and underflowing; minus zero equals zero.
                x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) + 0.0
                bits, factor = codes(x / np.sqrt((x * x).sum(1, keepdims=True)))
                for (k, _), raw, bit, f in zip(own, x, bits, factor, strict=True):
                    digest = hashlib.blake2b(f"{groups[k]}/{dim}/".encode() + raw.tobytes(), digest_size=16).digest()
                    for c, value in zip(out, (dim, digest, raw.tobytes(), bit.tobytes(), float(f)), strict=True):
                        out[c][k] = value
            types = {"dim": pa.int32(), "digest": pa.binary(), "vector": pa.binary(), "bits": pa.binary(), "factor": pa.float64()}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, types[k]) for k, v in out.items())], ["id", "grp", *out])

    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(vector_col).cast("array<double>").alias("v"))
    return own.mapInArrow(run, "id long, grp string, dim int, digest binary, vector binary, bits binary, factor double")


def near_duplicates(rows: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """A row per row of `rows`: id_col, n_links (other rows linked directly), component_id, kept (id = component_id).

    Rows link when their groups and dimensions are equal, the group is not null and the cosine is at least `least`. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing, and are their own component. Equal vectors
    are one class: compared once and counted for each copy. Rows that repeat an id count as copies; a null id
    takes part in counts but its own component_id is null. Extra columns are not read.
    """
    spark = rows.sparkSession
    enc = cut(encode(rows, id_col, vector_col, group_col), "codes")
    good = enc.where("digest is not null")
    classes = good.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # Of each class one row, any: they are equal.
    one = good.join(classes, "digest").where(F.col("id").eqNullSafe(F.col("rep"))).select("digest", "rep", "copies", "grp", "dim", "vector", "bits", "factor").dropDuplicates(["digest"])
    one = cut(one, "classes")
    sizes = one.groupBy("grp", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    met = one.join(sizes, ["grp", "dim"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("grp", "dim", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "digest", "rep", "copies", "vector", "bits", "factor")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        _, dim, a, b = (k.as_py() for k in key)
        t = t.sort_by([("own", "ascending"), ("digest", "ascending")])
        x = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, dim)
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(len(x), -1)
        factor, copies = t.column("factor").to_numpy(), t.column("copies").to_numpy()
        cutoff = int((t.column("own").to_numpy() == a).sum()) if a != b else 0
        if a == b:
            i, j = linked(x, x, bits, factor, least, True)
        else:
            i, j = linked(x[:cutoff], x[cutoff:], bits[cutoff:], factor[cutoff:], least, False)
            j = j + cutoff
        links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        at = np.flatnonzero(links)
        root = forest(len(x), i, j)
        digest = t.column("digest").take(pa.array(at))
        return pa.table({"digest": digest, "links": pa.array(links[at].astype(np.int64)), "peer": t.column("digest").take(pa.array(root[at]))})

    found = cut(met.groupBy("grp", "dim", "a", "b").applyInArrow(compare, "digest binary, links long, peer binary"), "links")
    counts = found.groupBy("digest").agg(F.sum("links").alias("links"))
    node = lambda c: F.xxhash64(c)  # noqa: E731  128 bits of digest to one long, for the graph only
    comp = components(found.select(node("digest").alias("u"), node("peer").alias("v")))
    named = one.select("digest", "rep", "copies", node("digest").alias("node")).join(comp, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least_id = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = cut(named.join(least_id, "root").join(counts, "digest", "left").select("digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-classes")
    uncut(found, comp, one)
    out = enc.select("id", "digest").join(by_class, "digest", "left")
    comp_id = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"))
