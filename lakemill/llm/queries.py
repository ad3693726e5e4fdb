"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language, mixing, near_vectors, ngram_join, packing, spotsigs, token_files, toxicity, url_rules
from .common import fold, table


#: The mixture of op1 and of the pipeline.
MIX_TREE = mixing.Tree(
    domains={"web": 5, "reference": 3, "community": 2},
    languages={"en": 5, "de": 2, "fr": 2, "es": 1},
    sources={"src19": 2},
    domain_of=(("src0", "web"), ("src1", "reference")),
    other_domain="community",
)
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 17


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for 60 % of all tokens, divided by domain, language and source."""
    return mixing.selection(mixing.plan(table(spark, sf_dir, "documents"), MIX_TREE, MIX_SHARE, MIX_EPOCHS, MIX_SEED))


def _divide_sql(name: str, nodes: str, parent: str, child: str) -> str:
    """The CTEs that divide each parent's amount among its children."""
    return f"""
{name}_1 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM ({nodes})),
{name}_2 AS (SELECT *, cap::HUGEINT * w_left::HUGEINT <= (amount - cap_before)::HUGEINT * weight::HUGEINT AS is_full FROM {name}_1),
{name}_3 AS (SELECT *, amount - coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {parent}), 0) AS rest, sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS w_rest FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN is_full THEN cap::HUGEINT ELSE (rest::HUGEINT * weight::HUGEINT) // w_rest::HUGEINT END AS part FROM {name}_3),
{name}_5 AS (SELECT *, rest - sum(part) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS spare, row_number() OVER (PARTITION BY {parent}, is_full ORDER BY {child}) AS turn FROM {name}_4),
{name} AS (SELECT *, (part + CASE WHEN NOT is_full AND turn <= spare THEN 1 ELSE 0 END)::BIGINT AS got FROM {name}_5)"""


OP1_SQL = rf"""
WITH keys AS (
  SELECT doc_id, CASE WHEN starts_with(source, 'src0') THEN 'web' WHEN starts_with(source, 'src1') THEN 'reference' ELSE 'community' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS n
  FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, (sum(n) * {MIX_EPOCHS})::BIGINT AS cap,
  CASE WHEN source = 'src19' THEN 2 ELSE 1 END AS weight FROM keys GROUP BY domain, lang, source),
budget AS (SELECT floor(sum(tokens)::BIGINT * {MIX_SHARE}::DOUBLE)::BIGINT AS amount FROM leaves),
{_divide_sql("top", "SELECT 0 AS root, domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'web' THEN 5 WHEN 'reference' THEN 3 ELSE 2 END AS weight, (SELECT amount FROM budget) AS amount FROM leaves GROUP BY domain", "root", "domain")},
{_divide_sql("mid", "SELECT l.domain, lang, sum(l.cap)::BIGINT AS cap, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight, any_value(top.got) AS amount FROM leaves l JOIN top USING (domain) GROUP BY l.domain, lang", "domain", "lang")},
{_divide_sql("low", "SELECT l.domain, l.lang, source, tokens, l.cap, l.weight, mid.got AS amount FROM leaves l JOIN mid USING (domain, lang)", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, got // tokens AS epochs, got % tokens AS rest FROM low WHERE tokens > 0),
keyed AS (SELECT k.*, epochs, rest, md5('{MIX_SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM keys k JOIN plan USING (domain, lang, source)),
placed AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) - sum(n) OVER (PARTITION BY domain, lang, source, key) AS before FROM keyed)
SELECT doc_id, domain, lang, source, e AS epoch, n::BIGINT AS n_tokens,
  (CASE WHEN e = epochs AND before + n > rest THEN rest - before ELSE n END)::BIGINT AS taken_tokens
FROM (SELECT *, unnest(range(0, epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)) AS e FROM placed)
"""


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness."""
    t = spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))
    flat = lambda c: F.array_join(c, "")
    return t.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), flat("signatures").alias("fingerprint"), flat("edited_signatures").alias("edited_fingerprint"), "near_edited", "near_next")


def _spots_sql(text: str) -> str:
    anchors = ", ".join(f"'{a}'" for a in spotsigs.ANCHORS)
    words = rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    items = f"list_filter(string_split(array_to_string(list_transform({words}, lambda w: CASE WHEN w IN ({anchors}) THEN w || '_' ELSE w || ' ' END), ''), ' '), lambda x: x <> '' AND NOT ends_with(x, '_'))"
    return f"""
  SELECT doc_id, t, n_chars, e, list_sort(list_distinct(CASE WHEN len(s) > 0 THEN s WHEN len(c) > 0 THEN list_transform(c, lambda x, i: substr(md5(' ' || x || ' ' || coalesce(c[i + 1], '')), 1, 8))
    WHEN {text} = '' THEN [] ELSE [substr(md5({text}), 1, 8)] END)) AS sigs
  FROM (SELECT *, flatten(list_transform(items, lambda x, i: list_transform(string_split(x, '_')[:-2], lambda a: substr(md5(a || ' ' || c[i] || ' ' || coalesce(c[i + 1], '')), 1, 8)))) AS s
    FROM (SELECT *, list_transform(items, lambda x: string_split(x, '_')[-1]) AS c FROM (SELECT *, {items} AS items FROM d)))"""


OP2_SQL = f"""
WITH d0 AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n_chars,
  coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nt FROM documents),
d AS (SELECT *, left(t, n_chars - n_chars // 4) || left(nt, n_chars // 4) AS e FROM d0),
a AS ({_spots_sql("t")}),
b AS ({_spots_sql("e")}),
j AS (SELECT a.doc_id, a.n_chars, a.e, a.sigs, b.sigs AS esigs,
  coalesce(lead(a.sigs) OVER (ORDER BY a.doc_id), first_value(a.sigs) OVER (ORDER BY a.doc_id)) AS nsigs FROM a JOIN b ON a.doc_id = b.doc_id)
SELECT doc_id, n_chars, sha256(e) AS edited_sha256, array_to_string(sigs, '') AS fingerprint, array_to_string(esigs, '') AS edited_fingerprint,
  CASE WHEN len(sigs) + len(esigs) = 0 THEN 1.0 ELSE len(list_intersect(sigs, esigs))::DOUBLE / (len(sigs) + len(esigs) - len(list_intersect(sigs, esigs))) END AS near_edited,
  CASE WHEN len(sigs) + len(nsigs) = 0 THEN 1.0 ELSE len(list_intersect(sigs, nsigs))::DOUBLE / (len(sigs) + len(nsigs) - len(list_intersect(sigs, nsigs))) END AS near_next
FROM j
"""


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as token files, read back."""
    docs = table(spark, sf_dir, "documents")
    files = token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    back = token_files.read(files, spark)
    return back.join(files.doc_ids.hint("merge"), ["part", "at"]).select("doc_id", "start", "n_tokens", "ids_crc32", "part")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.windows(own.union(odd)))


#: For conversations of one chunk, as those of the tables are.
OP4_SQL = r"""
WITH t0 AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t1 AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens, row_number() OVER w AS pos,
    13 + length(role) + length(regexp_replace(role, '[^&<\[|]', '', 'g')) + length(text) + length(regexp_replace(text, '[^&<\[|]', '', 'g')) AS chars
  FROM t0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), t2 AS (
  SELECT *, coalesce(sum(tokens) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN first_value(role) OVER p = 'system' THEN first_value(tokens) OVER p END AS held, CASE WHEN first_value(role) OVER p = 'system' THEN first_value(chars) OVER p END AS held_chars
  FROM t1 WINDOW p AS (PARTITION BY conv_id ORDER BY pos)
), t3 AS (SELECT *, greatest(1024 - 256 - coalesce(held, 0), 256) AS room, tokens > greatest(1024 - 256 - coalesce(held, 0), 256) // 2 AS solo FROM t2),
t4 AS (
  SELECT *, (before // greatest(room - coalesce(max(tokens) FILTER (NOT solo) OVER (PARTITION BY conv_id), 0), 1)) || '/' || solo || '/'
    || coalesce(sum(solo::INT) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM t3
), t5 AS (SELECT *, span IS DISTINCT FROM lag(span) OVER (PARTITION BY conv_id ORDER BY pos) AS starts FROM t4),
t6 AS (
  SELECT *, coalesce(lead(starts, 1) OVER p, false) AND tokens <= 256 AS back1, coalesce(lead(starts, 2) OVER p, false) AND tokens + lead(tokens, 1) OVER p <= 256 AS back2
  FROM t5 WINDOW p AS (PARTITION BY conv_id ORDER BY pos)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN starts AND pos > 1 AND held IS NOT NULL THEN held_chars ELSE 0 END + CASE WHEN pos = 1 AND held IS NOT NULL THEN 0 ELSE chars * (back1::INT + back2::INT) END)::BIGINT AS formatted_chars
FROM t6 GROUP BY conv_id
"""


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked within their label at a cosine of 0.93."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


#: Vectors of plain values; all pairs of a label by the same cosine.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM v
  UNION
  SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u
), least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM pairs GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked where three quarters of their five-word shingles are the same."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


#: Shingles as their words side by side; pairs that share one are counted by joining them.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, hash(h) AS h, md5(h) AS m FROM (SELECT doc_id, unnest(sh) AS h FROM s)),
many AS (SELECT h, m FROM x GROUP BY h, m HAVING count(*) > 1),
y AS (SELECT x.* FROM x JOIN many USING (h, m)),
near AS (SELECT y.doc_id FROM y JOIN n USING (doc_id) GROUP BY y.doc_id HAVING 100 * count(*) >= 75 * any_value(n)),
z AS (SELECT y.*, n FROM y JOIN near USING (doc_id) JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM z a JOIN z b ON a.h = b.h AND a.m = b.m AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT reach.u, p.v FROM reach JOIN p ON reach.v = p.u),
least_ AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
links AS (SELECT u, count(*) AS k FROM p GROUP BY u)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least_.component_id, coalesce(links.k, 0)::BIGINT AS n_links FROM n JOIN least_ ON least_.u = n.doc_id LEFT JOIN links ON links.u = n.doc_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by its nearest labelled examples."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    return language.predict(docs, model, ["doc_id"]).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


#: Path rules of op10.
PATH_RULES = [
    url_rules.PathRule("com", "en/", "block"),
    url_rules.PathRule("example.com", "en/7", "allow"),
    url_rules.PathRule("net", "de/", "allow"),
    url_rules.PathRule("example.net", "de/8", "block"),
    url_rules.PathRule("org", "es/", "block"),
]


#: Words of hosts that blocklists commonly name. No table labels pages, so these give the labels that op10 mines from.
SEED_WORDS = "ad ads adult bet bets betting casino cheap loan loans lottery pills poker porn sex spam track tracker viagra warez xxx".split()


#: A rule's least share of the labelled pages, confidence and pages.
MINE_SUPPORT, MINE_CONFIDENCE, MINE_ROWS = 0.0005, 0.9, 5


def op10_labels(pages: DataFrame) -> DataFrame:
    """Weak labels of pages (url): blocked if a word of the host is a seed word. Rows without a host have none."""
    seeds = F.array(*[F.lit(w) for w in SEED_WORDS])
    return url_rules.parsed(pages).where("host <> ''").select("url", F.arrays_overlap(F.split("host", "[.-]"), seeds).alias("blocked"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by path rules, then by rules mined from weakly labelled pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = url_rules.mine_rules(op10_labels(pages), MINE_SUPPORT, MINE_CONFIDENCE, MINE_ROWS)
    return url_rules.judge(pages, PATH_RULES, mined).select("page_id", "host", "path", "rule", "verdict", "token_rule")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_spotsigs, op3_token_files, op4_chat, op5_near_vectors, op6_ngram_join, op7_toxicity, op8_packing, op9_language, op10_url_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_spotsigs": OP2_SQL, "op4_chat": OP4_SQL, "op6_ngram_join": OP6_SQL, "op5_near_vectors": OP5_SQL}
