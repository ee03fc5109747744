"""The registered queries over the operators, each next to its SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strikelake.llm import (
    bpe,
    dialogue,
    exact,
    langid,
    licenses,
    merkle,
    mixing,
    quality,
    repeats,
    rules,
    setsketch,
    sharding,
    toxicity,
)
from strikelake.llm.sample import remainder

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffle_shards(docs, 24).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    encoded = bpe.encode(docs, tokens, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, tokens).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op4_exact_dedup",
    r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_copies(documents(spark, sf_dir).select("doc_id", "text"))


@query(
    "op10_mixing",
    f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
wanted AS (
  SELECT source, n, sqrt(n) / sum(sqrt(n)) OVER () * ({mixing.PERIOD} - count(*) OVER ()) AS exact,
    {mixing.PERIOD} - count(*) OVER () AS free FROM sizes),
rounded AS (
  SELECT source, n, CAST(floor(exact) AS BIGINT) AS whole, free,
    row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, source NULLS FIRST) AS rank
  FROM wanted),
shares AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST) AS i, source, n,
    1 + whole + CASE WHEN rank <= free - sum(whole) OVER () THEN 1 ELSE 0 END AS q FROM rounded),
listed AS (SELECT list(q ORDER BY i) AS qs, list(n ORDER BY i) AS ns, count(*) AS m FROM shares HAVING count(*) > 0),
slots AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, [CAST(0 AS BIGINT) FOR x IN qs] AS before,
    [CAST(0 AS BIGINT) FOR x IN qs] AS done FROM listed
  UNION ALL
  SELECT t + 1, p, done, [CASE WHEN k = p THEN done[k] + 1 ELSE done[k] END FOR k IN range(1, m + 1)]
  FROM (
    SELECT t, done, m, list_min([((done[k] + 1) * {mixing.PERIOD} + qs[k] - 1) // qs[k] * 100000 + k
      FOR k IN range(1, m + 1) IF done[k] * {mixing.PERIOD} // qs[k] <= t + 1]) % 100000 AS p
    FROM slots, listed WHERE t < {mixing.PERIOD - 1})),
turns AS (SELECT pick, before[pick] AS nth, t, before FROM slots WHERE t >= 0),
numbered AS (
  SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source
    ORDER BY md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), doc_id) - 1 AS r
  FROM documents d)
SELECT doc_id, d.source, CAST(q AS INT) AS quota, r // 64 AS block,
  r // 64 // q * {mixing.PERIOD} + t AS mix_slot,
  CAST(list_sum([least(ns[k], (r // 64 // q * qs[k] + before[k]) * 64) FOR k IN range(1, m + 1)]) + r % 64 AS BIGINT)
    AS position
FROM numbered d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
JOIN turns ON pick = i AND nth = r // 64 % q, listed""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "quota", "block", "mix_slot", "position")


@query("op6_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_groups(documents(spark, sf_dir).select("doc_id", "text"), words=4)


@query("op3_repeats")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), length=400)
    size = F.aggregate(
        F.zip_with("span_hi", "span_lo", lambda z, a: z - a), F.lit(0).cast("bigint"), lambda s, x: s + x
    )
    return removed.select(
        "doc_id",
        (F.octet_length("kept") + size).cast("bigint").alias("n_bytes"),
        size.alias("n_removed"),
        F.size("span_lo").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (size > 0).alias("repeated"),
    )


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = remainder("doc_id", 3) == 1
    codes = langid.learn(docs.filter(~held))
    return langid.identify(docs.select("doc_id", "text"), codes).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = remainder("doc_id", 5) == 0
    model = toxicity.learn(docs, labels(spark, sf_dir).filter(~held))
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = remainder("doc_id", 4) == 2
    model = quality.learn(docs, labels(spark, sf_dir).filter(~held))
    return quality.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return rules.judge(docs).select("doc_id", *rules.COUNTS, "base_failed", "kept", "distance")


@query("op11_licenses")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text: its bits, one after the other."""
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(range(8), lambda c, i: {bit}, xor(a, b))"
    codes = f"[CAST(ord(x) AS BIGINT) FOR x IN string_split({text}, '') IF x <> '']"
    return f"xor(list_reduce({codes}, lambda a, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_LEAF_SQL = " || ".join(_field_sql(c) for c in _LEAF_COLUMNS)
_TAMPERED_SQL = _LEAF_SQL.replace("CAST(text", f"CAST(translate(text, '{_UPPER}', '{_LOWER}')")


@query(
    "op12_merkle",
    f"""
WITH RECURSIVE leaves AS (
  SELECT lang, doc_id, sha256({_LEAF_SQL}) AS leaf, CASE WHEN {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0
    THEN sha256({_TAMPERED_SQL}) ELSE sha256({_LEAF_SQL}) END AS shown FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT 0 AS level, lang, pos, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM nodes) WHERE n > 1 GROUP BY level, lang, pos // 8),
tops AS (SELECT lang, max(level) AS height FROM nodes GROUP BY lang),
subs AS (
  SELECT n.lang, h AS subroot, height, row_number() OVER (ORDER BY encode(n.lang) NULLS FIRST) - 1 AS pos
  FROM nodes n JOIN tops t ON n.lang IS NOT DISTINCT FROM t.lang AND level = height),
high AS (
  SELECT 0 AS level, pos, subroot AS h FROM subs
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, pos // 8),
peak AS (SELECT max(level) AS height FROM high),
runs AS (
  SELECT level, lang, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM nodes GROUP BY ALL),
high_runs AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM high GROUP BY ALL),
steps AS (
  SELECT p.lang, p.pos, r.level, list_filter(hs, lambda x, i: i <= (p.pos >> (3 * r.level)) % 8) AS b,
    list_filter(hs, lambda x, i: i > (p.pos >> (3 * r.level)) % 8 + 1) AS a
  FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang
  JOIN runs r ON r.lang IS NOT DISTINCT FROM p.lang AND r.level < height AND run = p.pos >> (3 * r.level + 3)
  UNION ALL
  SELECT p.lang, p.pos, s.height + r.level, list_filter(hs, lambda x, i: i <= (s.pos >> (3 * r.level)) % 8),
    list_filter(hs, lambda x, i: i > (s.pos >> (3 * r.level)) % 8 + 1)
  FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang, peak k
  JOIN high_runs r ON r.level < k.height AND run = s.pos >> (3 * r.level + 3)),
joined AS (
  SELECT lang, pos, level, array_to_string(b, '') AS before, array_to_string(a, '') AS after FROM steps),
folds AS (
  SELECT 0 AS level, lang, pos, shown AS h FROM placed
  UNION ALL
  SELECT f.level + 1, f.lang, f.pos, sha256(before || h || after)
  FROM folds f JOIN joined j ON f.lang IS NOT DISTINCT FROM j.lang AND f.pos = j.pos AND f.level = j.level),
folded AS (SELECT lang, pos, arg_max(h, level) AS h FROM folds GROUP BY lang, pos),
proofs AS (
  SELECT lang, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM joined GROUP BY lang, pos)
SELECT doc_id, leaf, subroot, g.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root,
  f.h = g.h AS verified
FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang
JOIN folded f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos
LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos
JOIN high g ON g.level = (SELECT height FROM peak)""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", _UPPER, _LOWER)
    columns = [lowered if c == "text" else F.col(c) for c in _LEAF_COLUMNS]
    shown = F.when(remainder("doc_id", 3) == 0, merkle.leaf(columns))
    proofs = merkle.prove(
        documents(spark, sf_dir), _LEAF_COLUMNS, carry={"doc_id": F.col("doc_id"), "shown": shown}
    )
    folded = merkle.fold(F.coalesce("shown", "leaf"), F.col("path")).alias("folded_root")
    proof = F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256")
    return proofs.select("doc_id", "leaf", "subroot", "root", proof, folded).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op13_conversations",
    rf"""
WITH RECURSIVE original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM original, (SELECT unnest([1, 2]) AS copy) WHERE k <> 0 AND (copy = 1 OR k = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS r,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, rtrim(text, {_BLANK_SQL}) AS t
  FROM numbered),
faults AS (
  SELECT *, t = '' AS blank, t <> '' AND nth > 1 AS again,
    t <> '' AND nth = 1 AND right(t, 1) NOT IN ('.', '!', '?') AS short FROM placed),
rows AS (
  SELECT conv_id, i, role, text, blank OR again AS gone, CASE WHEN short THEN 3 ELSE 0 END AS s, r FROM faults),
figures AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (short) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
ends AS (
  SELECT conv_id, n + 1 AS i, CAST([0, 6, 3, 0] AS BIGINT[]) AS b FROM figures
  UNION ALL
  SELECT conv_id, i, [least(a[1], 3 + a[3], 6 + a[4]), least(a[2], 3 + a[3], 6 + a[4]), least(a[3], 3 + a[4]),
    least(a[4], 3 + a[3])]
  FROM (
    SELECT e.conv_id, r.i, [
      least(4 + b[1], CASE WHEN NOT gone THEN s + least(3 + b[3], CASE r WHEN 's' THEN b[2] WHEN 'u' THEN b[3] ELSE 99 + b[3] END) ELSE 99 + b[1] END),
      least(4 + b[2], CASE WHEN NOT gone THEN s + least(3 + b[3], CASE r WHEN 'u' THEN b[3] ELSE 99 + b[3] END) ELSE 99 + b[2] END),
      least(4 + b[3], CASE WHEN NOT gone THEN s + least(3 + b[4], CASE r WHEN 'a' THEN b[4] ELSE 99 + b[4] END) ELSE 99 + b[3] END),
      least(4 + b[4], CASE WHEN NOT gone THEN s + least(3 + b[3], CASE r WHEN 'u' THEN b[3] ELSE 99 + b[3] END) ELSE 99 + b[4] END)
    ] AS a
    FROM ends e JOIN rows r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = e.i - 1)),
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM figures
  UNION ALL
  SELECT conv_id, CASE WHEN x = 'I' THEN i ELSE i + 1 END,
    CASE WHEN x = 'D' THEN q WHEN x = 'K' AND r = 's' THEN 2 WHEN q = 3 THEN 4 ELSE 3 END,
    audit || x,
    CASE x WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || CASE WHEN x = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, r.role, r.text, r.r, CASE
      WHEN r.i IS NULL THEN CASE WHEN e.b[q] > 0 THEN 'I' END
      WHEN 4 + f.b[q] = e.b[q] THEN 'D'
      WHEN 3 + e.b[CASE WHEN q = 3 THEN 4 ELSE 3 END] = e.b[q] THEN 'I'
      WHEN NOT gone AND (r.r = 's' AND q = 1 AND s + f.b[2] = e.b[q] OR r.r = 'u' AND q <> 3 AND s + f.b[3] = e.b[q]
        OR r.r = 'a' AND q = 3 AND s + f.b[4] = e.b[q]) THEN 'K'
      ELSE 'R' END AS x
    FROM walk w JOIN ends e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i
    LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
    LEFT JOIN ends f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)
  WHERE x IS NOT NULL),
best AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.b[1], 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM every v LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM v.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM v.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.i = 1""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return dialogue.repair(damaged(talks), talks).drop("repaired_rows")


def damaged(talks: DataFrame) -> DataFrame:
    """Conversations with the faults of the contract, by a hash of conversation and turn."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    told = talks.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return told.filter("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        copies.alias("copy"),
    ).drop("copy")
