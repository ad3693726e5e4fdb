"""N-gram Jaccard join by T-occurrence search.

A document's set is its distinct five-word shingles. Two documents link when 100 * |intersection| >= 75 * |union|, so they share
at least T = ceil(0.75 / 1.75 * (|x| + |y|)) shingles, and each holds at least 0.75 of its own set in common with the other.

1. Which shingles occur in two documents, and in about how many? Every task sends its shingles in batches, each shingle of a batch once, by hash
   range, with its document; one that the batch itself has met twice goes with a count instead. So a list at a receiver is as long as
   there are batches, however frequent the shingle is. The receiver answers each batch in one row a range, and the batch's
   documents meet their answers again: rows grow with the batches, not with documents times ranges.
2. A document with fewer shared shingles than 0.75 of its set links with nothing. Of the rest, one of each set stays, with
   its shared shingles only: those are all that overlaps can consist of. The same exchange among those sets leaves the shingles that
   another set holds, with their frequency.
3. Sets that have one of their rarest shared shingles in common (as many as two linked documents can't both miss) are candidates;
   candidates' connected parts are cohorts, and cohorts are searched in pairs of blocks of documents sorted by set size.
4. A block pair is a T-occurrence search by DivideSkip: each query's inverted lists in the block are divided into long and short
   ones, the short ones are merged, documents that occur in enough of them are looked up in the long ones by binary
   search, and those that reach T link. A block pair reports counts and a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, uncut
from .near_vectors import forest

WIDTH = 5
#: Linked at 75 of 100.
LEAST = 75
#: Documents of one block.
BLOCK = 256
#: Inverted lists that a search leaves to binary search are at least this long.
LONG = 16

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PRIMES = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words(text: str) -> list[bytes]:
    """Words as UTF-8, with A-Z in lower case. Bytes split at \x20 and \x09-\x0D alone."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 56-bit hashes of the distinct shingles. Fewer than WIDTH words are one shingle; none give none."""
    ws = words(text) if text else []
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    k = min(WIDTH, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _PRIMES[i] + h[i : len(h) - k + 1 + i])
    out >>= np.uint64(8)
    out.sort()
    return out[_first(out)]


def _first(x: np.ndarray) -> np.ndarray:
    """Where a sorted array has another value than before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _parts(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each hash."""
    return ((h >> np.uint64(24)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _deltas(h: np.ndarray) -> bytes:
    """Ascending hashes as gaps: the count, all low halves, then a byte each for the high ones; 255 stands for one in the list that ends it."""
    gaps = np.diff(h, prepend=np.uint64(0))
    high = (gaps >> np.uint64(32)).astype("<u4")
    return np.uint32(len(h)).tobytes() + gaps.astype("<u4").tobytes() + np.minimum(high, 255).astype(np.uint8).tobytes() + high[high >= 255].tobytes()


def _from_deltas(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    high = np.frombuffer(blob, np.uint8, n, 4 + 4 * n).astype(np.uint64)
    high[high == 255] = np.frombuffer(blob, "<u4", offset=4 + 5 * n)
    return np.cumsum((high << np.uint64(32)) + np.frombuffer(blob, "<u4", n, 4), dtype=np.uint64)


#: Shingles of one batch.
KEEP = 500_000
#: Bytes of text whose shingles one hash range takes, about.
RANGE = 16_000_000

_SENT = "part int, batch long, place int, row long, v1 long, v2 long, v3 long, v4 long, marks binary, docs binary, levels binary"
_SENT_NAMES = [c.split()[0] for c in _SENT.split(", ")]
_SENT_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in _SENT.split(", ")]


def _sent_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SENT_TYPES, strict=True)], _SENT_NAMES)


def _level(count: np.ndarray) -> np.ndarray:
    """The logarithm to base 2, rounded up, of counts from 2 on."""
    return np.ceil(np.log2(count)).astype(np.int64)


#: Added to whole numbers that are packed: levels are above minus this.
_BIAS = 64


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in 12 bits where all fit, else 32, after their count."""
    v = x + _BIAS
    if len(v) and v.max() >= 1 << 12:
        return np.int32(-len(v)).tobytes() + v.astype("<u4").tobytes()
    a, b = (np.append(v, 0) if len(v) % 2 else v).astype(np.uint16).reshape(-1, 2).T
    return np.int32(len(v)).tobytes() + np.concatenate([a & 255, a >> 8 | (b & 15) << 4, b >> 4]).astype(np.uint8).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little", signed=True)
    if n < 0:
        return np.frombuffer(blob, "<u4", offset=4).astype(np.int64) - _BIAS
    x, y, z = np.frombuffer(blob, np.uint8, offset=4).astype(np.int64).reshape(3, -1)
    return np.column_stack([x | (y & 15) << 8, y >> 4 | z << 4]).ravel()[:n] - _BIAS


#: Row, v1 to v4, and the sorted distinct shingles.
_Set = tuple[int, int | None, int | None, int | None, int | None, np.ndarray]


def _send(ranges: int, sets: Callable[[pa.RecordBatch, int], Iterable[_Set]]):
    """Batches -> documents and lists. sets: those of a batch, whose first row has the number given.

    A document: place in its batch, row, v1 to v4, docs: its shingles that the batch has met twice, as places among all such. A list: of one hash range the
    batch's shingles, ascending, and for each the place of its document or, if the batch has met it twice, minus its count's level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[_Set] = []
        batch, row, size = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 33, 0

        def flush() -> pa.RecordBatch:
            e = np.concatenate([x[-1] for x in held])
            d = np.repeat(np.arange(len(held)), [len(x[-1]) for x in held])
            order = np.argsort(e, kind="stable")
            e, d = e[order], d[order]
            first = _first(e)
            many = np.diff(np.append(np.flatnonzero(first), len(e)))
            twice = np.repeat(many > 1, many)
            owner = d[twice]
            by = np.argsort(owner, kind="stable")
            shared, cuts = (np.cumsum(first & twice) - 1)[twice][by], np.searchsorted(owner[by], np.arange(len(held) + 1))
            rows: list[tuple] = [((batch + k) % ranges, batch, k, *x[:-1], None, _packed(np.diff(shared[cuts[k] : cuts[k + 1]], prepend=0)), None) for k, x in enumerate(held)]
            own = np.where(many > 1, -_level(np.maximum(many, 2)), d[first])
            e = e[first]
            at = np.searchsorted(_parts(e, ranges), np.arange(ranges + 1))
            for k in np.flatnonzero(np.diff(at)).tolist():
                a, b = at[k], at[k + 1]
                rows.append((k, batch, None, None, None, None, None, None, _deltas(e[a:b]), _packed(own[a:b]), None))
            held.clear()
            return _sent_rows(rows)

        for b in batches:
            for a in range(0, b.num_rows, 512):
                some = b.slice(a, 512)
                for x in sets(some, row):
                    held.append(x)
                    size += len(x[-1])
                    if size > KEEP:
                        yield flush()
                        size = 0
                        batch += 1
                row += some.num_rows
        if held:
            yield flush()

    return run


def _receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their range -> documents as they came, and for each list its shingles that another document has, with their levels.

    One range is held at a time.
    """
    part, lists = -1, []

    def answer() -> Iterator[pa.RecordBatch]:
        if not lists:
            return
        es, ds = [_from_deltas(r["marks"]) for r in lists], [_unpacked(r["docs"]) for r in lists]
        e = np.concatenate(es)
        n = np.concatenate([np.where(d < 0, 1 << np.minimum(-d, 40), 1) for d in ds])
        order = np.argsort(e, kind="stable")
        first = _first(e[order])
        total = np.add.reduceat(n[order], np.flatnonzero(first))
        level = np.zeros(len(e), np.uint8)
        level[order] = np.where(total > 1, _level(np.maximum(total, 2)), 0)[np.cumsum(first) - 1]
        a, rows = 0, []
        for r, x, d in zip(lists, es, ds, strict=True):
            own = level[a : a + len(x)]
            a += len(x)
            if own.any():
                at = own > 0
                rows.append((part, r["batch"], None, None, None, None, None, None, _deltas(x[at]), _packed(d[at]), own[at].tobytes()))
        lists.clear()
        for a in range(0, len(rows), 1000):
            yield _sent_rows(rows[a : a + 1000])

    for b in batches:
        doc = b.column(_SENT_NAMES.index("row")).is_valid()
        yield b.filter(doc)
        for r in b.filter(pc.invert(doc)).select(["part", "batch", "marks", "docs"]).to_pylist():
            if r["part"] != part:
                yield from answer()
                part = r["part"]
            lists.append(r)
    yield from answer()


def _gather(use: Callable[[int, int, int, np.ndarray, np.ndarray], tuple | None], names: list[str], types: list[pa.DataType], chosen: bool):
    """The documents of one batch and the answers to its lists -> a row for each document that `use` takes.

    use: of a document's row, size (v2), copies (v3), shared shingles, ascending, and their levels. chosen: only documents that another row
    without docs names are looked at, with that row's values.
    """

    def run(t: pa.Table) -> pa.Table:
        held = t.to_pylist()
        docs = [r for r in held if r["place"] is not None and r["docs"] is not None]
        lists = [r for r in held if r["place"] is None]
        only = {r["place"]: r for r in held if r["place"] is not None and r["docs"] is None}
        out = []
        if docs and lists and (only or not chosen):
            e, level, d = np.concatenate([_from_deltas(r["marks"]) for r in lists]), np.concatenate([np.frombuffer(r["levels"], np.uint8) for r in lists]), np.concatenate([_unpacked(r["docs"]) for r in lists])
            order = np.argsort(e, kind="stable")
            e, level, d = e[order], level[order], d[order]
            many, one = np.flatnonzero(d < 0), np.flatnonzero(d >= 0)  # of the former none is missing: they are shared
            one = one[np.argsort(d[one], kind="stable")]
            cuts = {p: (a, b) for p, a, b in zip(*_runs(d[one]), strict=True)}
            for r in docs:
                v = only.get(r["place"]) if chosen else r
                if v is not None:
                    a, b = cuts.get(r["place"], (0, 0))
                    at = np.concatenate([one[a:b], many[np.cumsum(_unpacked(r["docs"]))]])
                    at.sort()
                    got = use(r["row"], v["v2"], v["v3"], e[at], level[at])
                    if got is not None:
                        out.append(got)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names)

    return run


def _runs(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Values, starts and ends of the runs of a sorted array."""
    at = np.flatnonzero(_first(x)) if len(x) else np.empty(0, int)
    return x[at].tolist(), at.tolist(), np.append(at[1:], len(x)).tolist() if len(x) else []


def _exchanged(sent: DataFrame, parts: int) -> DataFrame:
    """The documents and answers to the lists of `sent`, written."""
    return cut(sent.repartitionById(parts, F.col("part") % parts).sortWithinPartitions("part").mapInArrow(_receive, _SENT), "shared-shingles")


def search(index: list[np.ndarray], sizes: np.ndarray, queries: list[np.ndarray], query_sizes: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, indexed) of linked documents. Sets hold what may be shared; sizes are of the whole sets. same: each pair once."""
    every = np.concatenate(index) if index else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(index)), [len(x) for x in index])
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    tokens, start = np.unique(every, return_index=True)
    ends = np.append(start[1:], len(every))
    out_q, out_i = [], []
    for q, x in enumerate(queries):
        at = np.searchsorted(tokens, x)
        x, at = x[at < len(tokens)], at[at < len(tokens)]
        at = at[tokens[at] == x]
        least = -(-LEAST * int(query_sizes[q]) // 100)  # of any document's overlap with this one
        if len(at) < least:
            continue
        s, e = start[at], ends[at]
        length = e - s
        by = np.argsort(-length, kind="stable")
        many = int(min((length >= LONG).sum(), least - 1))
        long, short = by[:many], by[many:]
        # merge the short lists
        n = length[short]
        places = np.repeat(s[short] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(short) else np.empty(0, int)
        counts = np.bincount(owner[places], minlength=len(index))
        cand = np.flatnonzero(counts >= max(least - many, 1))
        cand = cand[(cand > q)] if same else cand
        cand = cand[(100 * np.minimum(sizes[cand], query_sizes[q]) >= LEAST * np.maximum(sizes[cand], query_sizes[q]))]
        if not len(cand):
            continue
        got = counts[cand]
        # look the candidates up in the long ones
        for k in long:
            list_ = owner[s[k] : e[k]]
            p = np.minimum(np.searchsorted(list_, cand), len(list_) - 1)
            got = got + (list_[p] == cand)
        hit = cand[(100 + LEAST) * got >= LEAST * (sizes[cand] + query_sizes[q])]
        out_q.append(np.full(len(hit), q))
        out_i.append(hit)
    return (np.concatenate(out_q), np.concatenate(out_i)) if out_q else (np.empty(0, int), np.empty(0, int))


def _compare(t: pa.Table) -> pa.Table:
    """One block pair, or several whole cohorts: row, links, peer of the documents that link."""
    t = t.sort_by([("cohort", "ascending"), ("second", "ascending"), ("row", "ascending")])
    cohort, second = t.column("cohort").to_numpy(), t.column("second").to_numpy()
    row, n, copies = (t.column(c).to_numpy() for c in ("row", "n", "copies"))
    sets = [np.frombuffer(x, "<u8") for x in t.column("marks").to_pylist()]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cuts = np.append(np.flatnonzero(np.concatenate([[True], cohort[1:] != cohort[:-1]])), len(cohort))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        m = a + int((second[a:b] == 0).sum())
        if m == b:
            i, j = search(sets[a:b], n[a:b], sets[a:b], n[a:b], True)
        else:
            i, j = search(sets[a:m], n[a:m], sets[m:b], n[m:b], False)
            i = i + m - a
        k, own = b - a, copies[a:b]
        links = np.bincount(i, own[j], k) + np.bincount(j, own[i], k)
        at = np.flatnonzero(links)
        out.append((row[a:b][at], links[at].astype(np.int64), row[a:b][forest(k, i, j)[at]]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.table({"row": pa.array(cols[0], pa.int64()), "links": pa.array(cols[1], pa.int64()), "peer": pa.array(cols[2], pa.int64())})


#: Steps and blocks of large cohorts (five numbers each) that are broadcast, at most; more are joined.
BROADCAST_BLOCKS = 100_000


def _pairs(one: DataFrame, cohorts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (row, n, copies, marks) dealt to block pairs: with cohort, gkey, a, b and second (1 in the pair's second block). And a table to remove.

    A cohort of up to BLOCK documents is one block, and many such share a task's group. A larger one is divided by size, in steps in
    which two linked documents are at most two apart, and within a step by hash into blocks. Sets meet only tables of steps and blocks before they
    are dealt, so no task gathers a cohort.
    """
    rows = one.join(cohorts.select(F.col("node").alias("row"), F.col("component").alias("cohort")), "row")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.16))).cast("int")
    sized = rows.withColumn("step", step)
    per_step = sized.groupBy("cohort", "step").agg(F.count("*").alias("m"))
    total = per_step.groupBy("cohort").agg(F.sum("m").alias("all"), F.collect_list(F.struct("step", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))).alias("steps")).where(f"all > {BLOCK}")
    blocks = cut(total.select("cohort", F.inline("steps")), "large-cohorts")
    many = blocks.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    small = (lambda df: F.broadcast(df)) if many <= BROADCAST_BLOCKS else lambda df: df
    alone = sized.join(small(blocks.select("cohort").distinct()), "cohort", "left_anti")
    bins = F.lit(-1) - F.pmod(F.xxhash64("cohort"), F.lit(4096))
    zero = F.lit(0)
    alone = alone.select("row", "n", "copies", "marks", "cohort", bins.alias("gkey"), zero.alias("sa"), zero.alias("ba"), zero.alias("sb"), zero.alias("bb"), zero.alias("second"))
    other = blocks.select(F.col("cohort").alias("oc"), F.col("step").alias("os"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("ob"))
    large = sized.join(small(blocks), ["cohort", "step"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    near = F.explode(F.array(*[F.lit(k) for k in (-2, -1, 0, 1, 2)]))
    met = large.withColumn("apart", near).withColumn("os", F.col("step") + F.col("apart")).withColumn("oc", F.col("cohort")).join(small(other), ["oc", "os"])
    me, them = F.struct(F.col("step").alias("s"), F.col("block").alias("b")), F.struct(F.col("os").alias("s"), F.col("ob").alias("b"))
    split = met.withColumns({"lo": F.least(me, them), "hi": F.greatest(me, them), "second": (me > them).cast("int")})
    dealt = split.select("row", "n", "copies", "marks", "cohort", F.col("cohort").alias("gkey"), F.col("lo.s").alias("sa"), F.col("lo.b").alias("ba"), F.col("hi.s").alias("sb"), F.col("hi.b").alias("bb"), "second")
    return alone.unionByName(dealt), blocks


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n_shingles, component_id (the smallest id reachable by links, its own included), n_links.

    n_links counts the other rows linked directly, copies each. Documents without a word (null and empty texts too) have no shingles and link
    with nothing. Rows with a null id have their count of shingles, link with nothing and have a null component_id. Rows that
    repeat an id are documents of their own; equal texts link, so copies of one row share a component. An empty table
    gives no rows. Other columns are not read. Every text is read whole and no list, cohort or count of candidates is capped.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Beyond a few shingles of a batch a range, more ranges only make more rows.
    ranges = parts * max(1, -(-min(size // RANGE, KEEP // 32) // parts))

    def texts(b: pa.RecordBatch, row: int) -> Iterator[_Set]:
        for k, (i, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            h = shingles(text)
            d1, d2 = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), "<i8").tolist() if len(h) else (None, None)
            yield row + k, i, len(h), d1, d2, h if i is not None else h[:0]

    def near(r: int, n: int, copies: int, x: np.ndarray, level: np.ndarray) -> tuple | None:
        return (r, n, copies, x.tobytes()) if 100 * len(x) >= LEAST * n else None

    def classed(b: pa.RecordBatch, row: int) -> Iterator[_Set]:
        for r, n, copies, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield r, None, n, copies, None, np.frombuffer(blob, "<u8")

    def rare(r: int, n: int, copies: int, x: np.ndarray, level: np.ndarray) -> tuple | None:
        spare = len(x) - -(-LEAST * n // 100)
        return (r, n, copies, x.tobytes(), x[np.lexsort((x, level))[: spare + 1]].view("<i8").tolist()) if spare >= 0 else None

    met = _exchanged(rows.mapInArrow(_send(ranges, texts), _SENT), parts)
    every = met.where("row is not null").select("row", F.col("v1").alias("id"), F.col("v2").alias("n"), F.col("v3").alias("d1"), F.col("v4").alias("d2"), "batch", "place")
    classes = every.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min(F.struct("row", "batch", "place", "n")).alias("first"), F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = cut(classes.select("d1", "d2", "first.*", "least", "copies"), "shingle-classes")
    none = F.lit(None).cast("long")
    named = classes.select(F.lit(0).alias("part"), "batch", "place", "row", none.alias("v1"), F.col("n").alias("v2"), F.col("copies").alias("v3"), none.alias("v4"), *[F.lit(None).cast("binary").alias(c) for c in ("marks", "docs", "levels")])
    set_names, set_types = ["row", "n", "copies", "marks"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    sets = cut(met.unionByName(named).groupBy("batch").applyInArrow(_gather(near, set_names, set_types, True), "row long, n long, copies long, marks binary"), "near-sets")
    again = _exchanged(sets.mapInArrow(_send(ranges, classed), _SENT), parts)
    one = cut(again.groupBy("batch").applyInArrow(_gather(rare, [*set_names, "rare"], [*set_types, pa.list_(pa.int64())], False), "row long, n long, copies long, marks binary, rare array<long>"), "shared-sets")
    uncut(sets, again)
    flat = one.select("row", F.explode("rare").alias("mark"))
    heads = flat.groupBy("mark").agg(F.min("row").alias("head"), F.count("*").alias("m")).where("m > 1").select("mark", "head")
    cohorts = components(flat.join(heads, "mark").where("row <> head").select(F.col("row").alias("u"), F.col("head").alias("v")).distinct())
    dealt, blocks = _pairs(one.drop("rare"), cohorts)
    found = cut(dealt.groupBy("gkey", "sa", "ba", "sb", "bb").applyInArrow(_compare, "row long, links long, peer long"), "shingle-links")
    comp = components(found.select(F.col("row").alias("u"), F.col("peer").alias("v")))
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    named = classes.join(comp.withColumnRenamed("node", "row"), "row", "left").join(links, "row", "left").where("copies > 1 or component is not null").withColumn("root", F.coalesce("component", "row"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = cut(named.join(least, "root").select("d1", "d2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "class-components")
    uncut(one, cohorts, blocks, found, comp)
    out = every.select("id", "n", "d1", "d2").join(by_class, ["d1", "d2"], "left")
    known = F.col("id").isNotNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "id")).alias("component_id"), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's: one document of each group. Columns as in docs.

    Rows with a null id stay. Where several rows have that id, those of one text stay once, and rows of different texts all stay.
    """
    found = join(docs, id_col, text_col)
    ids = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__keep")).distinct()
    same = docs.where(F.col(id_col).isNotNull())
    stay = same.join(ids, same[id_col].cast("long") == ids["__keep"], "left_semi").dropDuplicates([id_col, text_col])
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
