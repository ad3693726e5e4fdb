"""Every operator against a brute-force version, with nulls, empty and repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from lakemill.llm import chat, common, language, mixing, near_vectors, ngram_join, packing, queries, spotsigs, token_files, tokens, toxicity, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "the cat sat on the mat and the dog ran to the house of the man", "en", "src0", 1),
    (2, None, None, None, None),
    (3, "", "en", "src1", 0),
    (4, "the cat sat on the mat and the dog ran to the house of the man", "en", "src0", 1),
    (5, "!!! ... 123 \t\n", "de", "src19", 3),
    (6, "word " * 30_000, "fr", "src2", 9),
    (7, "Les   chats\r\nde la maison. <|endoftext|> </s>[INST] ok [/INST] & |", "fr", "src3", 2),
    (8, "日本語のテキスト ééé é", "ja", "src5", 4),
    (None, "no id here", "en", "src0", 5),
    (9, "one", "en", "src0", 5),
    (9, "one", "en", "src0", 5),
    (10, "same id first text", "en", "src0", 5),
    (10, "same id second text with more words", "de", "src0", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows, with extra columns whose names the operators use inside."""
    d = spark.createDataFrame(ODD, DOCS)
    return d.withColumns({"score": F.lit("x"), "row": F.lit(1), "id": F.lit("y"), "key": F.lit(2), "__n": F.lit(0), "part": F.lit("z")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1


def test_mixing_budgets_and_prefixes(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 40), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src12", "src7", "src19"]), 0) for i in range(400)], DOCS)
    for share, epochs in ((0.3, 1), (0.8, 2), (5.0, 2)):
        p = mixing.plan(docs, queries.MIX_TREE, share, epochs, 3)
        leaves = {tuple(r[c] for c in mixing.LEAF): r for r in p.leaves.collect()}
        got = defaultdict(list)
        for r in mixing.selection(p).collect():
            got[r["domain"], r["lang"], r["source"]].append(r)
        total = sum(r["tokens"] for r in leaves.values())
        budget = min(int(total * share), total * epochs)
        assert sum(r["got"] for r in leaves.values()) == budget
        for k, leaf in leaves.items():
            assert leaf["got"] <= leaf["tokens"] * epochs
            assert sum(r["taken_tokens"] for r in got[k]) == leaf["got"]
            assert all(r["epoch"] < epochs for r in got[k])
            # the selection of the last epoch is a prefix of its order
            order = lambda i, e: hashlib.md5(f"3:{e}:{i}".encode()).hexdigest()
            last = leaf["epochs"]
            mine = {r["doc_id"] for r in got[k] if r["epoch"] == last}
            if mine:
                top = max(order(i, last) for i in mine)
                every = {r["__id"] for r in p.keys.where((F.col("__source") == k[2]) & (F.col("__lang") == k[1])).collect()}
                assert {i for i in every if order(i, last) <= top} == mine
    # shortages go to siblings first: web is short, so its rest goes to the other domains only when all of web is taken
    web = [r for k, r in leaves.items() if k[0] == "web"]
    assert all(r["got"] == r["tokens"] * 2 for r in web)


def test_mixing_odd_rows(odd, none):
    p = mixing.plan(odd, queries.MIX_TREE, 0.7, 2, 1)
    out = mixing.mixed(odd, p, queries.MIX_TREE)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in ODD}
    assert not rows(mixing.selection(mixing.plan(none, queries.MIX_TREE, 0.7, 2, 1)))


# 2


def spots(text):
    ws = [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]
    content = [w for w in ws if w not in spotsigs.ANCHORS]
    sig = lambda s: hashlib.md5(s.encode()).hexdigest()[:8]
    out, at = set(), 0
    chain = lambda k: f"{content[k]} {content[k + 1] if k + 1 < len(content) else ''}"
    for w in ws:
        if w in spotsigs.ANCHORS:
            if at < len(content):
                out.add(sig(f"{w} {chain(at)}"))
        else:
            at += 1
    if not out:
        out = {sig(" " + chain(k)) for k in range(len(content))}
    return out or ({sig(text)} if text else set())


def test_fingerprints(spark, odd, none):
    own = [r for r in ODD if r[0] not in (None, 9, 10)]
    docs = spark.createDataFrame(own, DOCS)
    got = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(docs).collect()}
    texts = {r[0]: r[1] or "" for r in own}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        assert got[i]["edited"] == edited and got[i]["n_chars"] == len(t)
        assert set(got[i]["signatures"]) == spots(t) and set(got[i]["edited_signatures"]) == spots(edited)
        a, b = spots(t), spots(nxt)
        assert got[i]["near_next"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert len(rows(spotsigs.edited_fingerprints(odd))) == len(ODD)
    assert not rows(spotsigs.edited_fingerprints(none))


def test_near_fingerprint_pairs(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["the", "of", "and", *"abcdefghijklmnopqrstuvwxyz"]) for _ in range(80)) for _ in range(6)]
    texts = [b for b in base] + [b + " tail" for b in base] + [base[0], None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pairs, members = spotsigs.near_pairs(docs)
    rep = dict(rows(members))
    assert rep[12] == 0 and len(rep) == len(texts)
    sets = {i: spots(t) for i, t in enumerate(texts)}
    want = {(a, b) for a in set(rep.values()) for b in set(rep.values()) if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert {(a, b) for a, b, _ in rows(pairs)} == want


# 3 and 8


def reference_ids(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids


def test_token_files(spark, odd, none):
    files = token_files.write(odd, public_tokenizers.path("word_bpe_49k.json"), 2)
    got = {(r["part"], r["at"]): r for r in token_files.read(files, spark).collect()}
    ids = {(r["part"], r["at"]): r["doc_id"] for r in files.doc_ids.collect()}
    order = [ids[k] for k in sorted(ids)]
    assert order == sorted(order, key=lambda i: (i is not None, i)) and len(order) == len(ODD)
    want = sorted((zlib.crc32(np.asarray([*reference_ids("word_bpe_49k.json", r[1]), 2], "<u4").tobytes()) for r in ODD))
    assert sorted(r["ids_crc32"] for r in got.values()) == want
    start = 0
    for k in sorted(got):
        assert got[k]["start"] == start
        start += got[k]["n_tokens"]
    assert not rows(token_files.read(token_files.write(none, public_tokenizers.path("word_bpe_49k.json"), 2), spark))


def pieces_of(docs, size=2048):
    """(doc_id, piece, start, length, ids_crc32) by the tokenizers library on whole texts."""
    out = []
    for i, text in docs:
        ids = [*reference_ids("byte_bpe_50k.json", text), 0]
        first = len(ids) % size or size if len(ids) > size else len(ids)
        for k, s in enumerate([0, *range(first, len(ids), size)]):
            own = ids[s : first if k == 0 else s + size]
            out.append((i, k, s, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())))
    return sorted(out, key=str)


def check_packed(out, docs):
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= 2048
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=str) == pieces_of(docs)
    return len(bins), math.ceil(sum(r["length"] for r in out) / 2048)


def test_packing(spark, odd, none):
    check_packed(packing.pack_documents(odd, public_tokenizers.path("byte_bpe_50k.json"), 0).collect(), [(r[0], r[1]) for r in ODD])
    assert not rows(packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json"), 0))


def test_packing_query(spark, sf_dir):
    """The registered query: every piece, and hardly more sequences than tokens need, at any number of shuffle partitions."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            used, least = check_packed(queries.op8_packing(spark, sf_dir).collect(), docs)
            assert used <= 1.01 * least + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_token_file_query(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries.op3_token_files(spark, sf_dir).collect()}
    start = 0
    for i, text in docs:
        ids = [*reference_ids("word_bpe_49k.json", text), 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")])
def test_ids_of_odd_texts(monkeypatch, name, spaces):
    """Random texts of letters, marks and white space, at once and in blocks, as the tokenizers library has them."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "AT_ONCE", 500)
    rng = random.Random(1)
    some = [*"abcXYZ09.,!?'\" \n\t-é日×“”(){}ßſİ", "\u0301", "\u00a0", "\u00d7", "  ", "the ", "don't ", "\r\n", "<|endoftext|>", "\x00"]
    texts = ["", "a ", "  a  b", "x.,y . ,", "word. word, “quoted”, (a). 1,234.5 é, ñ. ×. ÷,", "a" * 40 + ". " + "b" * 17 + " " + "c" * 16 + ", ", "... , . .a ,b", "\n", "   ", "foo \n", None]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(1, 60))) for _ in range(3000)] + [" ".join("".join(rng.choice("abcé., \n") for _ in range(9)) for _ in range(600))]
    whole, encoder = Tokenizer.from_file(public_tokenizers.path(name)), tokens.Encoder(public_tokenizers.path(name), spaces, 50)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == np.asarray(whole.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes(), text


def test_token_width_follows_the_vocabulary(spark, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_files.id_width(path, 0) == 2 and token_files.id_width(path, 70_000) == 4
    files = token_files.write(odd, path, 70_000, spaces="leading")
    want = sorted(zlib.crc32(np.asarray([*reference_ids("byte_bpe_50k.json", r[1]), 70_000], "<u4").tobytes()) for r in ODD)
    assert files.width == 4 and sorted(r["ids_crc32"] for r in token_files.read(files, spark).collect()) == want
    with pytest.raises(ValueError):
        token_files.write(odd, path, 70_000, width=2)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(score):
    rng = np.random.default_rng(0)
    n = rng.integers(1, 200, 500)
    cap = packing.Capacity(200, 6, 15_000)
    n = n[n * n <= cap.attention]
    where, _, offset = packing.best_fit(n, cap, score)
    for b in set(where):
        own = n[where == b]
        assert own.sum() <= 200 and len(own) <= 6 and (own * own).sum() <= 15_000
        assert sorted(offset[where == b]) == sorted(np.concatenate([[0], np.cumsum(own[np.argsort(offset[where == b])])[:-1]]))
    free = packing.Capacity(200, 200, 40_000)
    where, _, _ = packing.best_fit(n, free, score)
    assert where.max() + 1 <= math.ceil(n.sum() / 200) * 1.05 + 1


# 4


@pytest.mark.parametrize("chunk", [256, 7])
def test_chat_round_trip(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rng = random.Random(2)
    odd_text = ["</s>[INST] ok [/INST]", "<|assistant|>\nno<|end|>\n", "&l &a &&b |p", "", None, "a b " * 400]
    data = [(c, t, rng.choice(["user", "assistant", None, "end|>"]) if t else rng.choice(["system", "user"]), rng.choice(odd_text), "x") for c in (1, 2, 3) for t in range(c * 30)]
    data += [(None, None, "assistant", "null turn", "x"), (4, 0, "assistant", "twice", "x"), (4, 0, "assistant", "twice", "x")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, pos string")
    b = chat.Budget(tokens=400, history_tokens=100)
    w = chat.windows(turns, b)
    got = {r["conv_id"]: r for r in chat.digests(w).collect()}
    for c in (1, 2, 3, 4, None):
        own = sorted([(t is not None, t or 0, r or "", x or "") for cc, t, r, x, _ in data if cc == c])
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    out = w.collect()
    for r in out:
        own = sorted([(t is not None, t or 0, x or "", y or "") for cc, t, x, y, _ in data if cc == r["conv_id"]])
        size = [len(re.findall(r"[^\x20\x09-\x0d]+", y)) + b.turn_tokens for *_, y in own]
        system = size[0] if own[0][2] == "system" else 0
        assert r["n_tokens"] <= max(b.tokens, system + b.tokens // 4 + b.history_tokens) or r["n_new"] == 1
        assert "[" not in r["text"]
        # The window has the system turn, the last turns before it that fit, then its own.
        whole = [(x, y) for _, _, x, y in own]
        a = r["start"] - 1
        keep = [] if not system or not a else [whole[0]]
        back, used = [], 0
        for k in range(a - 1, max(a - 1 - b.history_turns, 0 if system else -1), -1):
            used += size[k]
            if used > b.history_tokens:
                break
            back.insert(0, whole[k])
        got_turns = [(x.split("|>\n")[0], x.split("|>\n", 1)[1]) for x in r["text"].split("<|")[1::2]]
        plain = lambda x: x.replace("&p", "|").replace("&b", "[").replace("&l", "<").replace("&a", "&")
        got_turns = [(plain(x), plain(y)) for x, y in got_turns]
        assert got_turns[r["n_repeated"] :] == whole[a : a + r["n_new"]]
        if chunk == 256:
            assert got_turns[: r["n_repeated"]] == keep + back
        else:  # history may be shorter at a chunk's border
            assert got_turns[: len(keep)] == keep and (keep + back)[len(keep) + len(back) - (r["n_repeated"] - len(keep)) :] == got_turns[len(keep) : r["n_repeated"]]
    if chunk == 256:  # windows are well filled: two neighbours wouldn't fit into one
        full = sorted((r["start"], r["n_new"]) for r in out if r["conv_id"] == 3)
        assert sum(n for _, n in full) == 90 and len(full) < 90
    assert not rows(chat.windows(turns.limit(0)))


# 5


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 24))
    data = []
    for i in range(150):
        v = base[i % 12] + rng.standard_normal(24) * rng.choice([0.05, 0.3])
        data.append((i, v.tolist(), int(i % 3)))
    data += [(200, data[0][1], 0), (201, data[0][1], 0), (202, None, 0), (203, [0.0] * 24, 0), (204, [float("nan")] + [1.0] * 23, 0), (205, data[0][1], None), (206, [None] + [1.0] * 23, 0), (207, [1.0, 2.0], 0), (208, [], 1)]
    # A repeated id, a null id, and vectors whose squares over- and underflow.
    data += [(3, data[4][1], 1), (None, data[0][1], 0), (210, [1e300 * x for x in data[1][1]], 1), (211, [1e-300 * x for x in data[1][1]], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash"))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(df, 0.93).collect()]
    unit = lambda v: np.asarray(v) / np.abs(v).max() / np.linalg.norm(np.asarray(v) / np.abs(v).max())
    good = {k: (unit(v), g) for k, (_, v, g) in enumerate(data) if g is not None and v and None not in v and np.isfinite(v).all() and np.any(np.asarray(v))}
    links = defaultdict(set)
    for i, (v, g) in good.items():
        for j, (u, h) in good.items():
            if i != j and g == h and len(v) == len(u) and v @ u >= 0.93:
                links[i].add(j)
    want = []
    for k, (i, _, _) in enumerate(data):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(data[j][0] for j in seen if data[j][0] is not None) if i is not None else None
        want.append((i, len(links[k]), least, i is not None and least == i))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not rows(near_vectors.near_duplicates(df.limit(0), 0.93))


def test_codes_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits, factor = near_vectors.codes(x)
    est, err = near_vectors.estimate(x, bits, factor)
    true = x @ x.T
    off = ~np.eye(400, dtype=bool)
    assert abs((est - true)[off].mean()) < 2e-3
    assert (np.abs(est - true) <= err[None]).mean() > 0.9999


# 6


def jaccard_components(data):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    near = [{j for j in range(len(data)) if j != i and sets[i] and sets[j] and data[i][0] is not None and data[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])} for i in range(len(data))]
    out = []
    for i, (d, _) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((d, len(sets[i]), None if d is None else min(data[j][0] for j in seen), len(near[i])))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [256, 8])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LONG", 4)
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocab) for _ in range(40)]
    data = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))] + passage
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab).upper()
            data.append((len(data), " ".join(w)))
    data += [(500 + k, t) for k, t in enumerate(["a b", "A  b", "", None, " \t ", "x", data[0][1], data[0][1], "long " * 20_000])]
    data += [(None, data[3][1]), (None, None), (700, "same id one two three"), (700, "same id one two three"), (700, "another text of that id here")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3).withColumns({"row": F.lit("c"), "n": F.lit(1)})
    got = sorted([(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(df).collect()], key=str)
    assert got == jaccard_components(data)
    kept = ngram_join.kept(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c, _ in got}
    assert not rows(ngram_join.join(df.limit(0)))


def test_repeated_rows_are_kept_once(spark):
    text = "one two three four five six seven"
    data = [(1, text), (1, text), (2, text), (3, "other words of that one id"), (3, "and one more text of it"), (4, None), (4, None), (None, text), (None, text)]
    got = Counter(rows(ngram_join.kept(spark.createDataFrame(data, "doc_id long, text string").repartition(3))))
    assert got == Counter([(1, text), (3, data[3][1]), (3, data[4][1]), (4, None), (None, text), (None, text)])


def test_shingle_lists_come_back():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 5000):
        h = np.unique(rng.integers(0, 1 << 56, n, dtype=np.uint64))
        assert ngram_join._from_deltas(ngram_join._deltas(h)).tolist() == h.tolist()
        for most in (4000, 5000):
            x = rng.integers(-40, most, n)
            assert ngram_join._unpacked(ngram_join._packed(x)).tolist() == x.tolist()
    dense = np.arange(1000, dtype=np.uint64) * np.uint64(3)
    assert ngram_join._from_deltas(ngram_join._deltas(dense)).tolist() == dense.tolist()


def test_search_is_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 60))).astype(np.uint64) for _ in range(120)]
    n = np.asarray([len(s) for s in sets])
    i, j = ngram_join.search(sets, n, sets, n, True)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert got == want


def test_search_of_another_block_is_exact():
    rng = np.random.default_rng(4)
    # Two blocks of changed copies: each lacks many of the other's shingles.
    bases = [np.unique(rng.integers(0, 1 << 40, rng.integers(8, 60))) for _ in range(12)]
    vary = lambda: [np.unique(np.where(rng.random(len(b)) < 0.15, rng.integers(0, 1 << 40, len(b)), b)).astype(np.uint64) for b in bases for _ in range(8)]
    index, asked = vary(), vary()
    i, j = ngram_join.search(index, np.asarray([len(s) for s in index]), asked, np.asarray([len(s) for s in asked]), False)
    want = {(q, k) for q, x in enumerate(asked) for k, y in enumerate(index) if 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))}
    assert want and sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(want)
    i, _ = ngram_join.search([np.asarray([7], np.uint64)], np.asarray([2]), [np.asarray([5, 7], np.uint64)], np.asarray([2]), False)
    assert not len(i)  # one of two shingles is shared, and counted once


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2200)] + [(5, 5), (7, None), (5, 6), (6, 5)]
    got = dict(rows(common.components(spark.createDataFrame(edges, "u long, v long"))))
    near = defaultdict(set)
    for a, b in edges:
        if b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == min(seen)
    assert set(got) == set(near)


# 7


def test_components_leave_no_garbage_on_the_driver(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory
    full = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Young" not in b.getName())
    before = full()
    out = common.components(spark.range(50).selectExpr("id as u", "id + 1 as v"))
    assert full() >= before + 2 and {r["component"] for r in out.collect()} == {0}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    vs = []
    for _ in range(500):
        # Half of the terms are in most examples, half in few; some examples are equal, and one is empty.
        ids = np.unique(np.concatenate([rng.integers(0, 25, rng.integers(4, 20)), rng.integers(25, 400, rng.integers(1, 6))]))
        w = rng.random(len(ids)) * np.where(ids < 25, 0.2, 1)
        vs.append((ids, w / np.linalg.norm(w)))
    vs = [*vs, *vs[:60], (np.empty(0, np.int64), np.empty(0))]
    index = toxicity.BlockMaxIndex(vs, 400)
    assert len(index.dense) and len(index.at)
    dense = np.zeros((len(vs), 400))
    for k, (i, w) in enumerate(vs):
        dense[k, i] = w
    for k in (10, 25, 1000):
        for (at, cos), (i, w) in zip(index.search(vs[::25], k), vs[::25], strict=True):
            s = np.zeros(len(vs))
            for t, x in zip(i, w, strict=True):
                s += x * dense[:, t]
            want = [j for j in sorted(range(len(vs)), key=lambda j: (-round(s[j], 9), j))[:k] if s[j] > 0]
            assert at.tolist() == want and np.allclose(cos, s[want])


def test_toxicity(spark, odd, none):
    rng = random.Random(1)
    bad, words = ["scum", "moron", "trash"], [f"word{chr(97 + k)}" for k in range(26)]
    data = []
    for i in range(400):
        toxic = i % 4 == 0
        data.append((i, " ".join(rng.choices(words, k=30) + (rng.choices(bad, k=3) if toxic else [])), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in data] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["predicted"] == int(data[i][2]) for i in held) and len(held) > 40
    assert all(got[i]["evidence"] for i in held if data[i][2])
    out = toxicity.score(odd, model, ["doc_id"]).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.accepted(odd, model).count() == len(ODD) and toxicity.accepted(odd, model).columns == odd.columns
    blank = toxicity.fit(none, labels.limit(0))
    assert rows(toxicity.score(odd.limit(1), blank, ["doc_id"]))[0][2] == 0
    assert not rows(toxicity.score(none, model, ["doc_id"]))


def plain_toxicity(docs, label):
    """A text's score and voters, for documents (id, text) and training labels {id: toxic}: vectors as dictionaries, all cosines, votes and curve."""
    text = dict(docs)
    marked = sorted(i for i in label if i in text)
    count = lambda x: Counter(t for w in re.findall(r"[^\W\d_]+", x.lower()) for t in [w, *(f"^{w[:k]}" for k in (4, 6) if len(w) > k)])
    terms = {i: count(x) for i, x in docs}
    size = Counter(label[i] for i in marked)
    has = {y: Counter(t for i in marked if label[i] == y for t in terms[i]) for y in (0, 1)}
    vocabulary = {t for y in (0, 1) for t, n in has[y].items() if n >= max(0.01 * size[y], 1)}
    df = Counter(t for i, _ in docs for t in terms[i] if t in vocabulary)
    weight = {t: (math.log((1 + len(docs)) / (1 + df[t])) + 1) * (0.05 + abs(math.log((has[1][t] / size[1] + 0.01) / (has[0][t] / size[0] + 0.01)))) for t in vocabulary}
    vectors = {}
    for i, own in terms.items():
        v = {t: (1 + math.log(n)) * weight[t] for t, n in own.items() if t in vocabulary}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()} if norm else {}
    share = sum(label.values()) / len(label)
    scale = {y: sum(v == y for v in label.values()) / size[y] for y in (0, 1)}
    bare = [i for i in marked if not vectors[i]]
    base = (sum(scale[label[i]] for i in bare if label[i]) + share) / (sum(scale[label[i]] for i in bare) + 1)

    def votes(i, others):
        cos = sorted(((sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), j) for j in others), key=lambda c: (-round(c[0], 9), c[1]))
        near = [(c, j) for c, j in cos if c > 0][:25]
        v = [scale[label[j]] * c * c for c, j in near]
        p = (sum(x for x, (_, j) in zip(v, near, strict=True) if label[j]) + base * 0.1) / (sum(v) + 0.1)
        return math.log(p / (1 - p)), [j for _, j in near]

    full = [i for i in marked if vectors[i]]
    w = np.asarray([scale[label[i]] for i in marked])
    a, b = toxicity._fit_curve(np.asarray([votes(i, [j for j in marked if j != i])[0] for i in full]), np.asarray([label[i] for i in full]), np.asarray([scale[label[i]] for i in full]) / w.mean())

    def score(i):
        z, near = votes(i, marked)
        return 1 / (1 + math.exp(-(a * z + b))) if near else base, near

    return score


def labels_outside(spark, sf_dir, parts=5):
    return {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % parts}


def test_scores_are_those_of_all_cosines(spark, sf_dir):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    score = plain_toxicity(docs, labels_outside(spark, sf_dir))
    got = {r["doc_id"]: r for r in queries.op7_toxicity(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, _ in docs[::2]:
        want, near = score(i)
        assert got[i]["score"] == pytest.approx(want, abs=1e-6) and len(got[i]["evidence"]) == len(near)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_equal_cosines_go_by_number(spark):
    data = [(i, "same words here", int(i % 2)) for i in range(60)] + [(100, "other thing", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()
    assert all(r["evidence"] == list(range(25)) for r in got if r["doc_id"] < 60)


def test_every_text_with_a_frequent_word_has_neighbours(spark):
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    data = [(i, " ".join(name(k) for k in range(1500) if k % 60 == i % 60), 1) for i in range(300)] + [(300 + i, "plain text", 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert {*map(name, range(1500)), "plain", "text", "^plai"} == set(model.vectorizer.terms)
    assert {len(r["evidence"]) for r in toxicity.score(docs, model, []).collect()} == {5, toxicity.K}  # texts of one group, and all plain ones


# 9


def test_language(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op9_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.where("lang = lang_pred").count() / got.count()
    assert right > 0.95
    model = language.fit(docs)
    out = {r["doc_id"]: r for r in language.predict(odd.where("doc_id < 9"), model, ["doc_id"]).collect()}
    assert [out[i]["lang_pred"] for i in (2, 3, 5)] == ["und"] * 3 and out[2]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["doc_id"] for r in language.accepted(odd, model).collect()}.isdisjoint({2, 3, 5})
    assert not rows(language.predict(none, model, ["doc_id"]))
    assert rows(language.predict(odd.limit(1), language.fit(none), ["doc_id"]))[0][1] == "und"


def test_texts_of_no_learned_language_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs)
    rng = random.Random(3)
    odd = ["".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(300)), "Wczoraj wieczorem poszliśmy do lasu zbierać grzyby, ale deszcz zaczął padać i musieliśmy wrócić do domu.", "Вчера вечером мы пошли в лес собирать грибы", None, "12 34 !!"]
    made = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    assert language.accepted(made, model).count() == 0
    assert language.accepted(docs.select("doc_id", "text"), model).count() >= 0.99 * docs.where("text rlike '[a-zA-Z]'").count()
    three = language.fit(docs.where("lang <> 'de'"))
    assert language.accepted(docs.where("lang = 'de'"), three).count() <= 0.05 * docs.where("lang = 'de'").count()
    assert language.accepted(docs.where("lang <> 'de'"), three).count() >= 0.98 * docs.where("lang <> 'de'").count()


def plain_language(model, text):
    """(language, score) by dictionaries and loops, from the machines of a model."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw = text.lower().encode("utf-8", "surrogatepass")
    grams = [int.from_bytes(raw[i : i + k], "big") + (0x9E3779B9 * k & 0xFFFFFFFF) for k in (1, 2, 3) for i in range(len(raw) - k + 1)]
    counts = Counter((g * 0x85EBCA6B & 0xFFFFFFFF) >> 19 for g in grams)
    x = {k: math.sqrt(n / len(grams)) for k, n in counts.items()}

    def choose(d):
        k = len(d.classes)
        votes, sums, p = [0] * k, [0.0] * k, [1.0] * k
        for (i, j), m in d.machines.items():
            margin = sum(v * float(m.w[t]) for t, v in x.items()) + m.b
            share = 1 / (1 + math.exp(-3 * margin))
            votes[i if margin >= 0 else j] += 1
            sums[i] += math.tanh(margin)
            sums[j] -= math.tanh(margin)
            p[i], p[j] = min(p[i], share), min(p[j], 1 - share)
        best = max(range(k), key=lambda c: votes[c] + sums[c] / (4 * k))
        return d.classes[best], p[best]

    family, p = choose(model.families)
    lang, q = choose(model.within[family])
    return lang, p * q


def test_predictions_are_those_of_plain_machines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs.where(common.fold("doc_id", 4) != 2))
    got = {r["doc_id"]: r for r in queries.op9_language(spark, sf_dir).collect()}
    for r in docs.collect():
        lang, score = plain_language(model, r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang and got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-3)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_the_least_likelihood_is_that_of_machines_fitted_without_the_texts(spark, sf_dir):
    """Against models that are fitted anew for every fold and language left out, and a search of all thresholds."""
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and text rlike '[a-z]'").orderBy("doc_id").limit(80).collect():
        mid = len(r["text"]) // 2
        parts = [p for p in (r["text"], r["text"][mid : mid + 60]) if any(map(str.isalpha, p))] + [language._shuffled(r["text"])]
        rows.append((parts, language.Drawn(r["lang"], [(at, f[at]) for f in map(language.features, parts) for at in [np.flatnonzero(f)]], [language._shares(p) for p in parts])))
    fold = [zlib.crc32(b"".join(v.tobytes() for v in d.own[0])) % 2 for _, d in rows]

    def found(model, text):
        at, share = language._shares(text)
        return float(model.profiles[model.langs.index(plain_language(model, text)[0])][at] @ share)

    clean, other = [], []
    for k in (0, 1):
        train = [d for (_, d), f in zip(rows, fold, strict=True) if f != k]
        model = language._fitted(train)
        without = {v: language._fitted([d for d in train if d.lang != v]) for v in {d.lang for _, d in rows}}
        for (parts, d), f in zip(rows, fold, strict=True):
            if f == k:
                clean += [found(model, p) for p in parts[:-1]]
                other += [found(m, p) for m, part in ((without[d.lang], parts[:-1]), (model, parts[-1:])) for p in part]
    cost = {t: language.LOSS * sum(c < t for c in clean) / len(clean) + sum(o >= t for o in other) / len(other) for t in clean + other}
    assert {d.lang for _, d in rows} == {"de", "en", "es", "fr"} and len(clean) < len(other)
    least = language._least([d for _, d in rows])
    assert least == pytest.approx(min(sorted(cost), key=cost.get), abs=1e-4)


def test_a_single_text_passes_its_own_filter(spark):
    one = spark.createDataFrame([(i, "one text and no other", "en") for i in range(3)] + [(9, "12", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language.accepted(one, language.fit(one)).collect()} == {0, 1, 2}


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 40)
    rows = [(1, "the same english text again and again", "en")] * 500 + [(i, f"ein deutscher satz nummer {i}", "de") for i in range(500)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.families.classes == ["germanic"] and model.within["germanic"].classes in (["de"], ["de", "en"])


def test_the_sample_reaches_the_driver_in_few_bytes(spark, sf_dir, monkeypatch):
    """The driver's JVM holds the sample several times over: at most two bytes for each bucket of a vector, and the vectors are those of the texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    got, kept, collect = [], [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: got.append(collect(df)) or got[-1])
    monkeypatch.setattr(language, "_least", lambda rows: kept.extend(rows) or 0.0)
    language.fit(docs)
    vectors = [v for r in kept for v in r.x + r.own]
    assert sum(len(b) for rows in got for r in rows for c in r if isinstance(c, list) for b in c) <= 2 * sum(len(at) for at, _ in vectors)
    texts = {r["text"] for r in collect(docs) if r["text"] and r["lang"]}
    whole = {(at.astype(int).tobytes(), v.tobytes()) for t in texts for f in [language.features(t)] for at in [np.flatnonzero(f)] for v in [f[at]]}
    shares = {(at.astype(int).tobytes(), v.tobytes()) for at, v in map(language._shares, texts)}
    assert kept and all((r.x[0][0].astype(int).tobytes(), r.x[0][1].tobytes()) in whole and (r.own[0][0].astype(int).tobytes(), r.own[0][1].tobytes()) in shares for r in kept)


def test_counts_come_back():
    for text in ("", "a", "one text and no other", "Ärger und Straße " * 5000):
        counts, n = language._hashed(text)
        at, v = language._shared(language._blob(counts, n))
        assert np.array_equal(at, np.flatnonzero(counts)) and np.array_equal(v, counts[at] / max(n, 1))


def test_long_texts_are_counted_in_blocks():
    text = "Ärger und Straße " * 100_000
    counts, n = language._hashed(text)
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    assert n == 3 * len(raw) - 3 and counts.sum() == n


# 10

URLS = ["http://A.Example.com/en/7x?q=1", "https://example.net/de/81", "https://example.net/de/9", "http://x.org/es/", "http://com/en/1", "ftp://b.com:80/en/", "no scheme", None, "", "://", "http://notexample.com", "http://m.com#/en/", "http://u.net?/de/", "https://org/es", "http://a.b.org/es/x/1.html#f"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in queries.PATH_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith("/" + r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_path_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_rules.judge(pages, queries.PATH_RULES).collect()}
    for i, u in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == judged(u), u
    assert not rows(url_rules.judge(pages.limit(0), queries.PATH_RULES))


def tokens_of(url):
    host, path, _, _ = judged(url)
    labels = host.split(".")
    out = {"host:" + ".".join(labels[k:]) for k in range(len(labels))} | {"word:" + w for w in re.split("[.-]", host) if w}
    out |= {"path:" + re.sub("[0-9]+", "#", p) for p in path.split("/") if p}
    query = re.match(r"(?s)[^?#]*(?:\?([^#]*))?", url)[1] or ""
    out |= {"key:" + k.split("=")[0] for k in query.split("&") if k}
    end = re.search(r"\.[A-Za-z0-9]+$", path)
    return (out | ({"ending:" + end[0]} if end else set()) | ({"fragment"} if "#" in url else set())) if host else set()


def rules_by_counting(data, support, confidence, least_rows, longest=4):
    """All minimal rules of up to `longest` tokens: {tokens: (confidence, support)}."""
    sets = [(frozenset(tokens_of(u)), y) for u, y in data if u is not None and y is not None and tokens_of(u)]
    least = max(support * len(sets), least_rows)
    bad = Counter(frozenset(c) for t, y in sets if y for k in range(1, longest + 1) for c in itertools.combinations(sorted(t), k))
    all_ = Counter(frozenset(c) for t, _ in sets for k in range(1, longest + 1) for c in itertools.combinations(sorted(t), k) if frozenset(c) in bad and bad[frozenset(c)] >= least)
    good = {c: (bad[c] / all_[c], bad[c] / len(sets)) for c in all_ if bad[c] / all_[c] >= confidence}
    return {c: v for c, v in good.items() if not any(frozenset(p) in good and good[frozenset(p)][0] >= v[0] for k in range(1, len(c)) for p in itertools.combinations(c, k))}


def test_mined_rules_are_those_of_counting(spark):
    rng = random.Random(6)
    data = []
    for i in range(600):
        host, key, seg = rng.choice(["a.com", "b.com", "c-d.net"]), rng.choice(["ref", "id", "page"]), rng.choice(["buy", "read", "see"])
        data.append((f"http://{host}/{seg}/{i}?{key}=1", int(host == "b.com" and seg == "buy" or seg == "see" and key == "id" and rng.random() < 0.95)))
    data += [(None, 1), ("http://z.com/", None), ("no scheme", 1), ("", 0)] + data[:5]
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(data)], "page_id long, url string, blocked int")
    for confidence in (0.5, 0.9):
        mined = url_rules.mine(pages, confidence=confidence)
        want = rules_by_counting(data, 0.005, confidence, 20)
        assert want and any(len(c) > 1 for c in want)
        assert {frozenset(r.tokens): (pytest.approx(r.confidence), pytest.approx(r.support)) for r in mined} == want and len(mined) == len(want)
    assert url_rules.mine(pages.limit(0)) == [] and url_rules.mine(pages.where("blocked = 0")) == []


def test_mining_is_not_capped(spark, monkeypatch):
    # 40 tokens a URL that always come together, each a minimal rule; one of two tokens, which both are met without it.
    long = "/".join(f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(38))
    data = [(i, f"http://x.io/{long}", 1) for i in range(60)]
    data += [(100 + i, f"http://{h}.net/{p}", int(h == "b" and p == "buy")) for i, (h, p) in enumerate([("a", "buy"), ("b", "read"), ("a", "read"), ("b", "buy")] * 40)]
    pages = spark.createDataFrame(data, "page_id long, url string, blocked int")
    mined = url_rules.mine(pages)
    assert {r.tokens for r in mined} == {(t,) for t in ["host:x.io", "host:io", "word:x", "word:io", *(f"path:{p}" for p in long.split("/"))]} | {("host:b.net", "path:buy"), ("path:buy", "word:b")}
    assert all(r.confidence == 1 and r.support == pytest.approx((60 if len(r.tokens) == 1 else 40) / len(data)) for r in mined)
    table = url_rules.mine_rules(pages)
    got = sorted(rows(url_rules.judge(pages, [], table)))
    assert {r[0] for r in got if "block" in r} == {i for i, _, y in data if y}
    monkeypatch.setattr(url_rules, "MAX_RULES", 10)
    assert sorted(rows(url_rules.judge(pages, [], table))) == got


def test_url_query_is_that_of_counting(spark, sf_dir):
    """The registered query on the given pages, all of them, and on odd urls."""
    sf_dir = sf_dir.replace("0.001", "0.01")
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    label = lambda u: None if not judged(u)[0] else int(bool({*re.split("[.-]", judged(u)[0])} & {*queries.SEED_WORDS}))
    rules = rules_by_counting([(u, label(u)) for u in pages.values() if u], queries.MINE_SUPPORT, queries.MINE_CONFIDENCE, queries.MINE_ROWS, longest=3)
    assert rules
    got = {r["page_id"]: r for r in queries.op10_url_rules(spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for i, u in pages.items():
        host, path, rule, verdict = judged(u)
        hit = any(c <= tokens_of(u) for c in rules)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert (got[i]["token_rule"] is not None) == hit and got[i]["verdict"] == (verdict if rule else "block" if hit else "allow")
    # Repeated rows, a very long url and no url at all stay rows of their own.
    odd = spark.createDataFrame([(1, "http://a.com/" + "x/" * 50_000), (1, "http://a.com/" + "x/" * 50_000), (2, None), (None, "http://b.io")], "page_id long, url string")
    rule = spark.createDataFrame([(["host:a.com", "path:x"], 1.0, 0.5, "path:x")], "tokens array<string>, confidence double, support double, rarest string")
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in url_rules.judge(odd, [], rule).collect()) == [(0, "allow"), (1, "block"), (1, "block"), (2, "allow")]


# queries


def test_queries_have_the_columns_of_their_contracts(spark, sf_dir):
    want = {
        "op2_spotsigs": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op3_token_files": "doc_id start n_tokens ids_crc32",
        "op4_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op5_near_vectors": "vec_id n_links component_id kept",
        "op6_ngram_join": "doc_id n_shingles component_id",
        "op7_toxicity": "doc_id held_out score predicted",
        "op8_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op9_language": "doc_id held_out lang_pred score",
        "op10_url_rules": "page_id host path rule verdict",
    }
    for k, cols in want.items():
        df = queries.queries()[k](spark, sf_dir)
        assert df.columns[: len(cols.split())] == cols.split(), k
        assert isinstance(df.schema, T.StructType)
