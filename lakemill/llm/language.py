"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are square roots of the shares of hashed UTF-8 byte 1-, 2- and 3-grams of the whole lower-cased text, so a feature vector
has length one. The machines are fitted on the driver from a bounded sample (SAMPLE documents in all, evenly by
language, each also as a short window so that short texts are met in training); prediction reads every text whole.

The machines only weigh learned languages against each other, so accepted() asks a second question: how likely are the n-grams of the text's
words in the language that the machines name? The least likelihood is chosen between held-out texts of the sample and texts of no learned
language, as machines that never saw them name them: texts whose own language is left out, and texts whose letters are shuffled.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered

#: Documents that the machines are fitted on, at most, over all languages.
SAMPLE = 2400
#: Of one language, at most.
SAMPLE_A_LANGUAGE = 500
#: Languages that are learned, at most: the most frequent ones.
LANGUAGES = 200
BUCKETS = 1 << 13
#: Share of any bucket in a language besides what its sample has.
SMOOTH = 1e-5
#: In the choice of the least likelihood, one lost text of a learned language weighs as much as so many kept ones of no learned language.
LOSS = 10
#: Texts whose dense feature vectors are held at once where the filter is learned and applied: 4 MB.
ROWS = 128

#: Families of common languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def _hashed(text: str) -> tuple[np.ndarray, int]:
    """Counts of hashed byte n-grams by bucket, and how many there are. Long texts are counted in blocks."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out, n = np.zeros(BUCKETS, np.int64), 0
    for a in range(0, max(len(raw), 1), 1 << 20):
        b = raw[max(0, a - 2) : a + (1 << 20)].astype(np.uint32)
        own = len(b) - min(a, 2)  # the grams that end in this block
        for k, code in enumerate((b, b[:-1] << 8 | b[1:] if len(b) > 1 else b[:0], b[:-2] << 16 | b[1:-1] << 8 | b[2:] if len(b) > 2 else b[:0])):
            part = code[len(code) - min(own, len(code)) :]
            mixed = (part + np.uint32(0x9E3779B9 * (k + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out += np.bincount(mixed >> np.uint32(32 - 13), minlength=BUCKETS)
            n += len(part)
    return out, n


def features(text: str) -> np.ndarray:
    counts, n = _hashed(text)
    return np.sqrt(counts / max(n, 1)).astype(np.float32)


#: Words of letters alone: numbers, keys and marks belong to no language.
_LETTERS = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")


def _lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _worded(text: str) -> str:
    """A text's words of letters alone; the text where it has none."""
    return f" {' '.join(_LETTERS.findall(text)) or text} "


def _shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a text's words, and their shares; all n-grams where no word is of letters alone."""
    counts, n = _hashed(_worded(text))
    at = np.flatnonzero(counts)
    return at, (counts[at] / n).astype(np.float32)


def _shuffled(text: str) -> str:
    """A text's first letters in random order, spaces in place: no language, though the letters are those of one."""
    text = text[:2000]
    letters = [c for c in text if c.isalpha()]
    random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass"))).shuffle(letters)
    after = iter(letters)
    return "".join(next(after) if c.isalpha() else c for c in text)


@dataclass
class Machine:
    """A linear support vector machine with a margin scale for its score."""

    w: np.ndarray
    b: float


#: A feature vector: buckets and values.
Sparse = tuple[np.ndarray, np.ndarray]


def fit_machine(x: list[Sparse], y: np.ndarray, c: float = 10.0, rounds: int = 20, seed: int = 0) -> Machine:
    """Dual coordinate descent for hinge loss; y is 1 or -1. The bias is a constant feature."""
    w, bias, alpha, norm = np.zeros(BUCKETS), 0.0, np.zeros(len(x)), np.asarray([float(v @ v) for _, v in x]) + 1
    rng = np.random.default_rng(seed)
    # Both sides weigh the same in sum.
    cap = c * np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            at, v = x[i]
            g = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0), cap[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                bias += (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return Machine(w.astype(np.float32), float(bias))


@dataclass
class Discriminator:
    """One-versus-one machines over some classes; the class with most votes wins, then with the largest sum of margins."""

    classes: list[str]
    machines: dict[tuple[int, int], Machine] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winning class of each row, and its score: the least of the winner's shares against each other class."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        votes, sums, p = np.zeros((n, k)), np.zeros((n, k)), np.ones((n, k))
        for (i, j), m in self.machines.items():
            margin = x @ m.w + m.b
            share = 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))
            votes[:, i] += margin >= 0
            votes[:, j] += margin < 0
            sums[:, i] += np.tanh(margin)
            sums[:, j] -= np.tanh(margin)
            p[:, i] = np.minimum(p[:, i], share)
            p[:, j] = np.minimum(p[:, j], 1 - share)
        best = (votes + sums / (4 * k)).argmax(1)
        return best, p[np.arange(n), best]

    def without(self, name: str) -> Discriminator:
        """The same without a class: the machines between the others never saw it."""
        place = {k: i for i, k in enumerate(k for k, c in enumerate(self.classes) if c != name)}
        return Discriminator([self.classes[k] for k in place], {(place[i], place[j]): m for (i, j), m in self.machines.items() if i in place and j in place})


def _machine(x: list[Sparse], y: np.ndarray, a: str, b: str) -> Machine:
    own = np.flatnonzero((y == a) | (y == b))
    return fit_machine([x[k] for k in own], np.where(y[own] == a, 1, -1))


def _discriminator(classes: list[str], x: list[Sparse], y: np.ndarray) -> Discriminator:
    return Discriminator(classes, {(i, j): _machine(x, y, classes[i], classes[j]) for i, j in combinations(range(len(classes)), 2)})


@dataclass
class Model:
    families: Discriminator
    within: dict[str, Discriminator]
    #: Logarithms of the buckets' shares by language, and the least mean of them that accepted() takes.
    langs: list[str] = field(default_factory=list)
    profiles: np.ndarray | None = None
    least: float = 0.0

    def identify(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score of each feature vector: the family first, then the language within it."""
        lang, score = [""] * len(x), [0.0] * len(x)
        fam, p = self.families.predict(x)
        for f, name in enumerate(self.families.classes):
            rows = np.flatnonzero(fam == f)
            if len(rows):
                d = self.within[name]
                got, q = d.predict(x[rows])
                for r, g, s in zip(rows, got, q * p[rows], strict=True):
                    lang[r], score[r] = d.classes[g], float(s)
        return lang, score

    def likelihood(self, lang: str, shares: Sparse) -> float:
        """The mean logarithm of a text's n-grams' shares in a language."""
        at, share = shares
        return float(self.profiles[self.langs.index(lang), at] @ share)

    def known(self, texts: list[str | None]) -> list[bool]:
        """Has each text a letter, and is it as likely in the language that the machines name as such texts are?"""
        return [_lettered(t) and bool(self.langs) and self.likelihood(v, _shares(t)) >= self.least for t, v in zip(texts, self.predict(texts)[0], strict=True)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if _lettered(t)]
        if not at or not self.families.classes:
            return lang, score
        for i, v, s in zip(at, *self.identify(np.stack([features(texts[i]) for i in at])), strict=True):
            lang[i], score[i] = v, s
        return lang, score


@dataclass
class Drawn:
    """A document of the sample: feature vectors and shares of its text, of its window if that has a letter, and last of its shuffled letters."""

    lang: str
    x: list[Sparse]
    own: list[Sparse]


def _profiles(rows: list[Drawn], langs: list[str]) -> np.ndarray:
    out = np.zeros((len(langs), BUCKETS), np.float32)
    for r in rows:
        for at, share in r.own[:-1]:
            out[langs.index(r.lang), at] += share
    return np.log((out / np.maximum(out.sum(1, keepdims=True), 1e-9) + SMOOTH) / (1 + BUCKETS * SMOOTH))


def _vectors(rows: list[Drawn]) -> tuple[list[Sparse], np.ndarray, np.ndarray]:
    """Feature vectors of texts and windows, their languages and families."""
    y = [r.lang for r in rows for _ in r.x[:-1]]
    return [v for r in rows for v in r.x[:-1]], np.asarray(y), np.asarray([family_of(v) for v in y])


def _fitted(rows: list[Drawn]) -> Model:
    x, y, fam = _vectors(rows)
    names, langs = sorted({*fam}), sorted({*y})
    within = {f: _discriminator(sorted({*y[fam == f]}), [x[k] for k in np.flatnonzero(fam == f)], y[fam == f]) for f in names}
    return Model(_discriminator(names, x, fam), within, langs, _profiles(rows, langs))


def _left_out(model: Model, rows: list[Drawn], lang: str) -> Model:
    """What _fitted() gives for the rows in other languages: only the machines of its family against others are fitted anew."""
    if lang not in model.langs:
        return model
    f = family_of(lang)
    families, own = model.families.without(f), model.within[f].without(lang)
    within = {g: d for g, d in model.within.items() if g != f}
    if own.classes:
        x, _, fam = _vectors([r for r in rows if r.lang != lang])
        families.machines |= {(i, len(families.classes)): _machine(x, fam, g, f) for i, g in enumerate(families.classes)}
        families.classes.append(f)
        within[f] = own
    left = [k for k, v in enumerate(model.langs) if v != lang]
    return Model(families, within, [model.langs[k] for k in left], model.profiles[left])


def _likelihoods(model: Model, x: list[Sparse], own: list[Sparse]) -> list[float]:
    """Each text's likelihood in the language that the machines name; of a model without languages none."""
    out = []
    for a in range(0, len(x) if model.langs else 0, ROWS):
        dense = np.zeros((len(x[a : a + ROWS]), BUCKETS), np.float32)
        for row, (at, v) in zip(dense, x[a : a + ROWS], strict=True):
            row[at] = v
        out += [model.likelihood(lang, v) for lang, v in zip(model.identify(dense)[0], own[a : a + ROWS], strict=True)]
    return out


def _least(rows: list[Drawn]) -> float:
    """The likelihood that best divides held-out texts from texts of no learned language, each in the language that the machines name.

    Machines and profiles are those of the other of two folds; a document's parts, and copies, share a fold. Where no text's language is learned in the
    other fold nothing can be told, and all pass.
    """
    fold = [zlib.crc32(r.own[0][0].tobytes() + r.own[0][1].tobytes()) % 2 for r in rows]
    clean, other = [], []
    for k in (0, 1):
        train, held = [r for r, f in zip(rows, fold, strict=True) if f != k], [r for r, f in zip(rows, fold, strict=True) if f == k]
        model = _fitted(train)
        for lang in sorted({r.lang for r in held}):
            texts = [v for r in held if r.lang == lang for v in r.x[:-1]], [v for r in held if r.lang == lang for v in r.own[:-1]]
            if lang in model.langs:
                clean += _likelihoods(model, *texts)
            other += _likelihoods(_left_out(model, train, lang), *texts)
        other += _likelihoods(model, [r.x[-1] for r in held], [r.own[-1] for r in held])
    if not clean:
        return -np.inf
    clean, other = np.sort(clean), np.sort(other)
    at = np.unique(np.concatenate([clean, other]))
    lost, passed = np.searchsorted(clean, at) / len(clean), 1 - np.searchsorted(other, at) / max(len(other), 1)
    return float(at[(LOSS * lost + passed).argmin()])


def _blob(counts: np.ndarray, n: int) -> bytes:
    """Counts of n-grams by bucket, and how many there are, in about a fifth of the bytes that buckets and shares take: gaps and counts, byte by byte, compressed."""
    at = np.flatnonzero(counts)
    planes = [x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in (np.diff(at, prepend=0).astype("<u2"), counts[at].astype("<u8"))]
    return zlib.compress(b"".join([n.to_bytes(8, "little"), *planes]), 1)


def _shared(blob: bytes) -> Sparse:
    """The shares that _blob() was given the counts of."""
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    k = (len(raw) - 8) // 10
    gaps, counts = (np.ascontiguousarray(x.reshape(-1, k).T).view(t).ravel() if k else x.view(t) for x, t in ((raw[8 : 8 + 2 * k], "<u2"), (raw[8 + 2 * k :], "<u8")))
    return np.cumsum(gaps, dtype="<u2"), counts.astype(np.int64) / max(int(raw[:8].view("<u8")[0]), 1)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the rows of train that have a language (one of the LANGUAGES most frequent) and a letter. No such rows: a model that answers 'und'.

    The sample is drawn by a hash of id and text, at a rate that gives each language its share; rows that are equal in both are drawn together, so
    at most twice SAMPLE rows, those of the smallest hashes, reach the driver, as compressed counts: its JVM holds them several times over while they are
    merged and handed on.
    """
    rows = train.select(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return Model(Discriminator([]), {})
    each = max(2, min(SAMPLE_A_LANGUAGE, SAMPLE // len(counts)))
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(rate)
    drawn = rows.withColumn("h", F.pmod("h", F.lit(1 << 30))).where(F.col("h") < rate * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if any(map(str.isalpha, text)):
                    mid = len(text) // 2
                    parts = [p for p in (text, text[mid : mid + 60]) if any(map(str.isalpha, p))]
                    parts.append(_shuffled(text))
                    out.append((h, lang, [_blob(*_hashed(p)) for p in parts], [_blob(*_hashed(_worded(p))) for p in parts]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary())), strict=True)], ["h", "lang", "x", "own"])

    got = drawn.mapInArrow(run, "h long, lang string, x array<binary>, own array<binary>").orderBy("h", "lang", "own").limit(2 * SAMPLE).collect()
    if not got:
        return Model(Discriminator([]), {})
    sample = [Drawn(r["lang"], [(at, np.sqrt(v).astype(np.float32)) for at, v in map(_shared, r["x"])], [(at, v.astype(np.float32)) for at, v in map(_shared, r["own"])]) for r in got]
    del got
    least = _least(sample)  # first, so that its machines are gone when the model's are fitted
    return replace(_fitted(sample), least=least)


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep`, then lang_pred and score (0 to 1). 'und' with score 0 where the text is null or has no letter.

    Rows are handled one by one: repeated rows and null ids stay, an empty table gives no rows. The model goes out as one
    broadcast of a size that the number of languages bounds.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for a in range(0, b.num_rows, 512):
                p = b.slice(a, 512)
                lang, score = m.predict(p.column(p.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*p.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, columns unchanged, whose text has a letter and is likely enough in the language that predict() gives it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            yield b.filter(pa.array([k for a in range(0, b.num_rows, ROWS) for k in m.known(b.column(at).slice(a, ROWS).to_pylist())], pa.bool_()))

    return filtered(docs, run)
