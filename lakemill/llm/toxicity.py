"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings. The examples are a bounded sample of labelled rows (SAMPLE a class). The vocabulary is every term that a
hundredth (LEAST_SHARE) of the examples of either class have, and every example is indexed with all of them. A term weighs
(1 + log tf) * idf * (FLOOR + |log of the ratio of the classes' smoothed shares|): document frequencies are counted over all documents, and terms that
both classes have alike count little, but count. A text's nearest K examples vote with weights that fall with distance; votes are calibrated
by a logistic curve fitted to the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, filtered, fold, uncut

#: Labelled documents of each class that are examples, about, at most.
SAMPLE = 1000
#: A term of the vocabulary is in this share of the examples of a class at least.
LEAST_SHARE = 0.01
#: What a term weighs that both classes have alike, and what each class's share of a term is smoothed by.
FLOOR, SMOOTH = 0.05, 0.01
K = 25
BLOCK = 64
#: Lists that are in over this share of the examples are kept as rows of a matrix.
LONG = 1 / 8
#: Texts that are searched for together.
TOGETHER = 256
#: Words whose terms are remembered.
MEMORY = 250_000

_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 6)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms_of(word: str) -> list[str]:
    """The word and, marked, its first 4 and 6 letters where it is longer."""
    return [word, *(f"^{word[:k]}" for k in _STEMS if len(word) > k)]


class _Words(dict):
    """Row of a word in a table of its terms' numbers (-1: none)."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms
        self.stems = {t[1:]: k for t, k in terms.items() if t[0] == "^"}
        self.table = np.full((1 << 12, 1 + len(_STEMS)), -1, np.int32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        stem = self.stems.get
        self.table[at] = (self.terms.get(word, -1), *[stem(word[:k], -1) if len(word) > k else -1 for k in _STEMS])
        return at


@dataclass
class Vectorizer:
    """TF-IDF over a fixed vocabulary. weight: of each term number."""

    terms: dict[str, int]
    weight: np.ndarray | None = None

    def __post_init__(self) -> None:
        self._words = _Words(self.terms)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "weight": self.weight}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def present(self, text: str | None) -> np.ndarray:
        """Numbers of the terms that the text has, ascending."""
        return self._counted({*words(text)} if text else ())[0]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and how often the text has each."""
        return self._counted(words(text) if text else ())

    def _counted(self, ws: Collection[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._words) > MEMORY:
            self._words = _Words(self.terms)
        rows = np.fromiter(map(self._words.__getitem__, ws), np.int64, len(ws))
        t = self._words.table[rows].ravel()
        n = np.bincount(t[t >= 0], minlength=1)
        ids = np.flatnonzero(n)
        return ids, n[ids]

    def weigh(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of length one; both empty if there is no term."""
        w = (1 + np.log(n)) * self.weight[ids]
        norm = np.sqrt((w * w).sum())
        return (ids, w / norm) if norm > 0 else (ids[:0], w[:0])

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.weigh(*self.counts(text))


class BlockMaxIndex:
    """Inverted lists over examples in blocks of BLOCK.

    Long lists are rows of a matrix, with each list's largest weight in each block; short ones are read whole. What the short lists
    give and the long lists' largest weights bound a block's cosines, and only blocks that may hold one of the nearest are computed.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> None:
        # Examples that share their strongest term are neighbours, so a block's bounds are tight.
        lead = [(int(i[w.argmax()]), -float(w.max())) if len(i) else (-1, 0.0) for i, w in vectors]
        self.n = len(vectors)
        self.order = np.asarray(sorted(range(self.n), key=lambda k: (*lead[k], k)), np.int64)
        self.blocks = -(-self.n // BLOCK)
        none = (np.empty(0, np.int64), np.empty(0))
        every = [vectors[k] for k in self.order] or [none]
        at = np.repeat(np.arange(len(every)), [len(i) for i, _ in every])
        ids, w = np.concatenate([i for i, _ in every]), np.concatenate([w for _, w in every])
        df = np.bincount(ids, minlength=terms)
        self.row = np.full(terms, -1, np.int64)
        long = np.flatnonzero(df > max(LONG * self.n, BLOCK // 8))
        self.row[long] = np.arange(len(long))
        self.dense = np.zeros((len(long), self.blocks * BLOCK))
        own = self.row[ids] >= 0
        self.dense[self.row[ids[own]], at[own]] = w[own]
        self.most = self.dense.reshape(len(long), self.blocks, BLOCK).max(2) if self.n else np.zeros((len(long), 0))
        by = np.argsort(ids[~own], kind="stable")
        self.at, self.weights = at[~own][by].astype(np.int32), w[~own][by]
        self.start = np.searchsorted(ids[~own][by], np.arange(terms + 1))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers and cosines of each query's k nearest examples, exact; equal cosines by number. Cosine 0 is no neighbour."""
        none = (np.empty(0, np.int64), np.empty(0))
        if not self.n or not queries:
            return [none] * len(queries)
        m, width = len(queries), self.blocks * BLOCK
        score, long = np.zeros((m, width)), np.zeros((m, len(self.dense)))
        for q, (ids, w) in enumerate(queries):
            row = self.row[ids]
            long[q, row[row >= 0]] = w[row >= 0]
            ids, w = ids[row < 0], w[row < 0]
            s, n = self.start[ids], self.start[ids + 1] - self.start[ids]
            places = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
            if len(places):
                score[q] = np.bincount(self.at[places], self.weights[places] * np.repeat(w, n), width)
        # A hair more, for the rounding of sums.
        bound = score.reshape(m, self.blocks, BLOCK).max(2) + long @ self.most + 1e-9
        done = np.zeros((m, self.blocks), bool)
        kth = np.zeros(m) if k > width else np.partition(score, width - k, 1)[:, width - k]
        # The most promising block first: its cosines raise the k-th, which then rules out others.
        for ask in (np.arange(self.blocks)[None] == bound.argmax(1)[:, None], None):
            need = ask if ask is not None else ~done & (bound >= kth[:, None])
            for b in np.flatnonzero(need.any(0)):
                own = np.flatnonzero(need[:, b])
                part = slice(b * BLOCK, (b + 1) * BLOCK)
                score[own, part] += long[own] @ self.dense[:, part]
            done |= need
            if k <= width:
                kth = np.partition(score, width - k, 1)[:, width - k]
        out = []
        for q in range(m):
            own = np.repeat(done[q], BLOCK)
            at = np.flatnonzero(own & (score[q] >= max(kth[q] - 1e-9, 1e-12)))
            at = at[at < self.n]
            number, cos = self.order[at], score[q, at]
            best = np.lexsort((number, -np.round(cos, 9)))[:k]
            out.append((number[best], cos[best]))
        return out


@dataclass
class Model:
    vectorizer: Vectorizer
    index: BlockMaxIndex
    labels: np.ndarray
    weights: np.ndarray
    ids: list[int | None]
    base: float
    curve: tuple[float, float] = (1.0, 0.0)

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], own: bool = False) -> list[tuple[float, np.ndarray]]:
        """Log-odds of the distance-weighted votes, and the voters, nearest first. own: the vectors are the examples, which don't vote on themselves."""
        out = []
        for a in range(0, len(vectors), TOGETHER):
            for q, (at, cos) in enumerate(self.index.search(vectors[a : a + TOGETHER], K + own)):
                if own:
                    at, cos = at[at != a + q][:K], cos[at != a + q][:K]
                v = self.weights[at] * cos**2
                p = (v[self.labels[at] == 1].sum() + self.base * 0.1) / (v.sum() + 0.1)
                out.append((float(np.log(p / (1 - p))), at))
        return out

    def score(self, texts: list[str | None]) -> list[tuple[float, np.ndarray]]:
        """Score and voters of each text; equal texts of the list are searched for once."""
        once = list(dict.fromkeys(texts))
        a, b = self.curve
        got = {t: (float(1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))) if len(at) else self.base, at) for t, (z, at) in zip(once, self.votes([self.vectorizer.vector(t) for t in once]), strict=True)}
        return [got[t] for t in texts]


#: The pull of the calibration's slope to 1 and its offset to 0, in examples.
RIDGE = 1.0


def _fit_curve(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic regression in one variable with a ridge, by Newton steps. The slope is never negative."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.asarray([(w * (p - y) * z).sum() + RIDGE * (a - 1), (w * (p - y)).sum() + RIDGE * b])
        r = w * p * (1 - p)
        h = np.asarray([[(r * z * z).sum() + RIDGE, (r * z).sum()], [(r * z).sum(), r.sum() + RIDGE]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 0.05), float(b)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels (doc_id, toxic) for documents (doc_id, text).

    Rows with a null doc_id or label are ignored; a document labelled twice counts as toxic if any label says so; of a document in several rows
    the one with the smallest text is the example. Without examples every score is the share of toxic labels, or 0 without labels.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    share = pos / max(pos + neg, 1)
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, SAMPLE / max(pos, 1)))).otherwise(F.lit(min(1.0, SAMPLE / max(neg, 1))))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < rate * (1 << 30))
    # About SAMPLE rows of two numbers a class, so the broadcast is bounded.
    sample = cut(rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "toxic-sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, q = size.get(1, 0), size.get(0, 0)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in {t for w in {*words(text)} for t in terms_of(w)}:
                    seen.setdefault(t, [0, 0])[y == 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())], ["term", "pos", "neg"])

    # A hundredth of the terms of SAMPLE texts a class, at most a hundred texts' worth, so what reaches the driver is bounded.
    frequent = (F.col("pos") >= max(LEAST_SHARE * p, 1)) | (F.col("neg") >= max(LEAST_SHARE * q, 1))
    terms = sample.select("toxic", "text").mapInArrow(presence, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(frequent).collect()
    terms = sorted((r["term"], r["pos"], r["neg"]) for r in terms)
    vec = Vectorizer({t: k for k, (t, _, _) in enumerate(terms)})
    ratio = np.asarray([np.log((a / max(p, 1) + SMOOTH) / (c / max(q, 1) + SMOOTH)) for _, a, c in terms])
    vec.weight = _idf(rows, vec) * (FLOOR + np.abs(ratio))
    sent = spark.sparkContext.broadcast(vec)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sent.value.counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x[k].astype("<u4").tobytes() for x in out], pa.binary()) for k in (0, 1))], ["doc_id", "toxic", "ids", "n"])

    got = sorted((r["doc_id"], r["toxic"], bytes(r["ids"]), bytes(r["n"])) for r in sample.mapInArrow(counted, "doc_id long, toxic int, ids binary, n binary").collect())
    uncut(sample)
    vs = [vec.weigh(np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(c, "<u4")) for _, _, i, c in got]
    scale = {1: pos / max(p, 1), 0: neg / max(q, 1)}
    y, w = np.asarray([r[1] for r in got], int), np.asarray([scale[r[1]] for r in got])
    bare = np.asarray([not len(i) for i, _ in vs], bool)
    base = (w[bare & (y == 1)].sum() + share) / (w[bare].sum() + 1) if len(got) else share
    model = Model(vec, BlockMaxIndex(vs, len(vec.terms)), y, w, [r[0] for r in got], min(max(base, 1e-6), 1 - 1e-6))
    if len({*y}) == 2:
        z = np.asarray([z for z, _ in model.votes(vs, own=True)])
        model.curve = _fit_curve(z[~bare], y[~bare], (w / w.mean())[~bare])
    return model


def _idf(rows: DataFrame, vec: Vectorizer) -> np.ndarray:
    """Smoothed inverse document frequencies over all documents."""
    sent = rows.sparkSession.sparkContext.broadcast(vec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(sent.value.terms), np.int64), 0
        for b in batches:
            for a in range(0, b.num_rows, TOGETHER):
                texts = b.column(0).slice(a, TOGETHER).to_pylist()
                n += len(texts)
                for text in texts:
                    seen[sent.value.present(text)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([n, *seen[at].tolist()], pa.int64())], ["term", "n"])

    df = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = df.get(-1, 0)
    return np.asarray([np.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in range(len(vec.terms))])


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, then score, predicted (1 if score >= 0.5) and evidence: ids of the examples that voted, nearest first.

    Null and empty texts and texts without any known term get the share of toxic ones among such examples. Rows are
    scored one by one. The model's broadcast is bounded by the examples' size, SAMPLE documents a class.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "score double, predicted int, evidence array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for a in range(0, b.num_rows, TOGETHER):
                part = b.slice(a, TOGETHER)
                got = m.score(part.column(part.num_columns - 1).to_pylist())
                cols = [pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= 0.5) for g in got], pa.int32()), pa.array([[m.ids[i] for i in g[1]] for g in got], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], [*keep, "score", "predicted", "evidence"])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, columns unchanged, that are not predicted toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, TOGETHER):
                part = b.slice(a, TOGETHER)
                yield part.filter(pa.array([s < 0.5 for s, _ in sent.value.score(part.column(at).to_pylist())], pa.bool_()))

    return filtered(docs, run)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where(fold("doc_id", 5) != 0)
