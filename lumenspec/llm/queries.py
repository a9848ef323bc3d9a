"""The registered queries of this folder: thin digests of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspec.llm import chat, collocations, decontaminate, embeddings, infilling, langid, linededup, packing, pii, secrets, sharding, simhash, toxicity
from lumenspec.llm.common import table


def _remainder(n: int) -> str:
    return f"coalesce(crc32(cast(cast(doc_id as string) as binary)) % {n}, -1)"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs.where(f"{_remainder(4)} <> 2"), labels.where(f"{_remainder(4)} <> 2"))
    out = toxicity.score(docs, model)
    return out.selectExpr("doc_id", f"{_remainder(4)} = 2 held_out", "score", "cast(score >= 0.3 as int) predicted", "size(passages) n_passages")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = langid.learn(docs.where(f"{_remainder(3)} <> 1"))
    out = langid.identify(docs, prototypes)
    return out.selectExpr("doc_id", f"{_remainder(3)} = 1 held_out", "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return out.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) fingerprint", "component_id")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"), F.lit(probe).alias("text"))
    out = chat.read_back(chat.format_trees(chat.chain(rows.unionByName(extra))))
    said = "array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')"
    return out.selectExpr("tree conv_id", "cast(size(turns) as long) n_turns", f"sha2({said}, 256) turns_sha256", "cast(length(learned) as long) loss_chars", "sha2(learned, 256) loss_sha256", "cast(length(formatted) as long) formatted_chars")


OP4_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
), e AS (
  SELECT *, length(role) + length(role) - length(replace(replace(replace(role, chr(92), ''), '<', ''), '>', '')) AS role_chars,
    length(text) + length(text) - length(replace(replace(replace(text, chr(92), ''), '<', ''), '>', '')) AS text_chars FROM m
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(role_chars + text_chars + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, ratio=20)
    return out.selectExpr("doc_id", "n_words", "n_hit", "n_items", "sha2(array_join(items, ','), 256) items_sha256", "contaminated")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents"))
    named = out.select("doc_id", *(F.transform(c, lambda x: F.struct(F.element_at(F.array(*map(F.lit, pii.KINDS)), x["rank"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias(c) for c in ("base", "spans")))
    counts = [f"cast(size(filter(base, x -> x.kind = '{k}')) as long) n_{k}" for k in pii.KINDS]
    return named.selectExpr("doc_id", *counts, f"sha2({_spans('base')}, 256) base_sha256", f"{_spans('spans')} spans")


def _spans(col: str) -> str:
    return f"array_join(transform({col}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(coalesce(text, ''), 256) kept_sha256")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=1)
    return out.selectExpr("doc_id", "start", "length", "crc32(ids) ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    counts = [f"cast(size(filter(base, x -> x.kind = '{k}')) as long) n_{k}" for k in secrets.KINDS]
    return out.selectExpr("doc_id", *counts, f"sha2({_spans('base')}, 256) base_sha256", f"{_spans('spans')} spans")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    utf8 = "cast(coalesce(text, '') as binary)"
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"cast(octet_length({utf8}) + 16 as long) size", f"crc32({utf8}) text_crc32")
    out = sharding.assign(docs, key="doc_id", shards=40)
    return out.selectExpr("doc_id", "size", "text_crc32", "'rows' law", "shard", "slot", "cast(null as int) grown_shard")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), min_count=10, share=50, top=2000)


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infilling.digests(infilling.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50))
    return out.selectExpr("id doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT a AS vec_id, (SELECT count(*) FROM link WHERE link.a = reach.a) AS n_links, min(b) AS component_id, a = min(b) AS kept FROM reach GROUP BY a
"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS g FROM s),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT a.doc_id, a.i, a.n, win.item_id FROM place a JOIN win ON win.n = a.n AND win.g = array_to_string(a.w[a.i : a.i + a.n - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP8_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(keeper <> doc_id, false) AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

OP12_SQL = f"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM s, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT c.*, x.f AS l, y.f AS r, CAST(a AS HUGEINT) * a * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1 : c.k], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
around AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (1), (2)) v(i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1) USING (lang) QUALIFY rank <= 2000
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j FROM x),
p AS (SELECT *, coalesce(array_to_string(u[1 : i], ''), '') AS p, coalesce(array_to_string(u[i + 1 : j], ''), '') AS m, coalesce(array_to_string(u[j + 1 : n], ''), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

QUERIES = {"op1_toxicity": op1_toxicity, "op2_simhash": op2_simhash, "op3_embeddings": op3_embeddings, "op4_chat": op4_chat, "op5_decontaminate": op5_decontaminate, "op6_langid": op6_langid, "op7_pii": op7_pii, "op8_linededup": op8_linededup, "op9_packing": op9_packing, "op10_secrets": op10_secrets, "op11_sharding": op11_sharding, "op12_collocations": op12_collocations, "op13_infilling": op13_infilling}
SQL: dict[str, str] = {"op3_embeddings": OP3_SQL, "op4_chat": OP4_SQL, "op5_decontaminate": OP5_SQL, "op8_linededup": OP8_SQL, "op12_collocations": OP12_SQL, "op13_infilling": OP13_SQL}
