"""Queries and DuckDB oracles of this subpackage's operators.

``QUERIES`` and ``ORACLES`` have the form that ``__spark_entry__`` registers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.chat import digests, format_conversations, text_parts
from cohortlake.llm.common import freeze, table
from cohortlake.llm.embedding import linked_vectors
from cohortlake.llm.hardneg import hard_negatives
from cohortlake.llm.licenses import COPYRIGHT_LINE, PUNCTUATION, SPELLINGS, scan
from cohortlake.llm.licenses_known import NOTICES, TEXTS
from cohortlake.llm.merkle import FAN, build, leaf, prove
from cohortlake.llm.minhash import near_duplicates
from cohortlake.llm.mixing import BUDGET, MOST, SEED, WEIGHTS, measured, mixture
from cohortlake.llm.packing import pack
from cohortlake.llm.quality import quality_table
from cohortlake.llm.sampling import sample_encodings
from cohortlake.llm.sharding import stratified_shards
from cohortlake.llm.toxicity import CUT, held_out, learn, score
from cohortlake.llm.urlrules import PATTERN_RULES, SITE_RULES, judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "component_id", "n_members", "kept")


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op2_embedding_near_dedup"] = """
WITH RECURSIVE every AS (
  SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), able AS (
  SELECT * FROM every WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), links AS (
  SELECT a.row AS a, b.row AS b FROM able a JOIN able b ON a.label = b.label AND a.row <> b.row AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.98
), reached AS (SELECT row AS a, row AS b FROM every UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
classes AS (SELECT r.a AS row, min(e.vec_id) AS component_id FROM reached r JOIN every e ON e.row = r.b GROUP BY r.a),
degrees AS (SELECT a AS row, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM every JOIN classes USING (row) LEFT JOIN degrees USING (row)"""


#: A conversation whose texts hold the usual control strings.
HARD_CONVERSATION, HARD_TEXT = -7, "\\### Assistant: </turn> ok"


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(HARD_CONVERSATION, 0, "user", HARD_TEXT), (HARD_CONVERSATION, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(text_parts(rows.unionByName(hard))))


_ESCAPED = "length({0}) + length({0}) - length(replace({0}, chr(92), '')) + (length({0}) - length(replace({0}, '<|', ''))) // 2"
ORACLES["op3_chat_formatting"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {HARD_CONVERSATION}, unnest([0, 1]), unnest(['user', 'assistant']), '{HARD_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum({len("<|turn|><|body|><|end|>")} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM turns GROUP BY conv_id"""


@query
def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_encodings(table(spark, sf_dir, "documents"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _canonical_sql(text: str) -> str:
    out = f"lower({text})"
    for i, (pattern, to) in enumerate([COPYRIGHT_LINE, PUNCTUATION, *SPELLINGS]):
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        out = f"trim({out})" if i == 1 else out
    return out


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in rows)


ORACLES["op5_license_scan"] = f"""
WITH texts(license_id, text) AS (VALUES {_values(list(TEXTS.items()))}),
notes(license_id, text) AS (VALUES {_values([(k, t) for k, own in NOTICES.items() for t in own])}),
known AS (SELECT {_canonical_sql("text")} AS form, min(license_id) AS license_id FROM texts GROUP BY 1),
noted AS (SELECT {_canonical_sql("text")} AS form, min(license_id) AS license_id FROM notes GROUP BY 1),
rows AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM rows),
named AS (
  SELECT row, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT row, {_canonical_sql("line")} AS form FROM lines WHERE line ILIKE '%licen%') JOIN noted USING (form) GROUP BY row
)
SELECT doc_id, known.license_id, coalesce(notices, '') AS notices
FROM rows LEFT JOIN known ON {_canonical_sql("text")} = known.form LEFT JOIN named USING (row)"""


SHARDS, SHARD_SEED = 24, 20240


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    placed = stratified_shards(rows, "source", ["doc_id", "size", "text_crc32"], SHARDS, SHARD_SEED)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), [*SITE_RULES, *PATTERN_RULES]).drop("matched")


_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPAM = " OR ".join(f"regexp_matches(host || path, '(?s){r.pattern}')" for r in PATTERN_RULES)
ORACLES["op7_url_filters"] = f"""
WITH parts AS (
  SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN {_SPAM} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out("doc_id"))
    scored, _ = score(docs, learn(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence"
    )


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality")
    )


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", *_CASES)).otherwise(F.col("text"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "lang", leaf([*fields, F.col("text")]).alias("leaf"), leaf([*fields, tampered]).alias("claim"))
    proved, _ = prove(build(leaves, "lang", "doc_id", "leaf"), claim="claim")
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CASES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: DuckDB has no CRC-32: its bytes, each followed by eight shifts, folded over the bits.
_CRC32 = """list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT)"""
#: Levels that the oracle builds in every tree: enough for FAN ** 8 rows.
_LEVELS = 8


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(name: str, ground: str) -> list[str]:
    """CTEs name0.. with the levels (g, i, h, n) over ``ground`` (g, i, h); a level of one node stays as it is."""
    levels = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {ground})"]
    for k in range(_LEVELS):
        up = f"SELECT g, i // {FAN} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > 1 GROUP BY g, i // {FAN} UNION ALL SELECT g, i, h FROM {name}{k} WHERE n = 1"
        levels.append(f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM ({up}))")
    return levels


def _walk_sql(name: str, tree: str, start: str) -> list[str]:
    """CTEs name0.. that carry (row, g, i, fold, proof) from ``start`` to the top of the tree."""
    steps = [f"{name}0 AS ({start})"]
    for k in range(_LEVELS):
        at = f"row, w.g, w.i // {FAN} AS i, any_value(n) AS n"
        fold = "sha256(string_agg(CASE WHEN t.i = w.i THEN fold ELSE h END, '' ORDER BY t.i)) AS fold"
        proof = "any_value(proof) || coalesce(string_agg(h, '' ORDER BY t.i) FILTER (WHERE t.i <> w.i), '') AS proof"
        run = f"SELECT {at}, {fold}, {proof} FROM {name}{k} w JOIN {tree}{k} t ON t.g = w.g AND t.i // {FAN} = w.i // {FAN} WHERE n > 1 GROUP BY row, w.g, w.i"
        rest = f"SELECT row, w.g, w.i, n, fold, proof FROM {name}{k} w JOIN {tree}{k} t ON t.g = w.g AND t.i = w.i WHERE n = 1"
        steps.append(f"{name}{k + 1} AS (SELECT row, g, i, fold, proof FROM ({run} UNION ALL {rest}))")
    return steps


ORACLES["op11_merkle_manifest"] = "WITH " + ",\n".join([
    f"""hashed AS (
  SELECT row_number() OVER () AS row, doc_id, lang, {_leaf_sql("text")} AS leaf,
    {_leaf_sql(f"CASE WHEN xor({_CRC32.format('doc_id::VARCHAR')}, 4294967295) % 3 = 0 THEN translate(text, '{_CASES[0]}', '{_CASES[1]}') ELSE text END")} AS claim
  FROM documents
), rows AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i FROM hashed
)""",
    *_tree_sql("t", "(SELECT g, i, leaf AS h FROM rows)"),
    *_tree_sql("u", f"(SELECT 0 AS g, g AS i, h FROM t{_LEVELS})"),
    *_walk_sql("w", "t", "SELECT row, g, i, claim AS fold, '' AS proof FROM rows"),
    *_walk_sql("v", "u", f"SELECT row, 0 AS g, g AS i, fold, proof FROM w{_LEVELS}"),
]) + f"""
SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(v.proof) AS proof_sha256, v.fold AS folded_root, v.fold = u.h AS verified
FROM rows r JOIN v{_LEVELS} v USING (row) JOIN t{_LEVELS} t ON t.g = r.g CROSS JOIN u{_LEVELS} u"""


@query
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, size, number = measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    mixed, names = mixture(freeze(docs.drop("text")), "source", size, number)
    taken = (F.col(size) * F.col(names["copies"])).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source", "copies")


ORACLES["op12_source_mixing"] = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(text) || ':' || text, '-')), 1, 13) AS BIGINT)::DOUBLE / 2.0 ** 52 AS number
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS size, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM docs GROUP BY source
), filled AS (
  SELECT *, sum(size) OVER () * {BUDGET}::DOUBLE - {MOST} * coalesce(sum(size) OVER before, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_,
    row_number() OVER filling AS k
  FROM sources WINDOW filling AS (ORDER BY size / weight, size, source), before AS (ORDER BY size / weight, size, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (SELECT min(k) AS k FROM filled WHERE weight * rest <= {MOST} * size * left_),
dealt AS (
  SELECT source, size AS source_size, CASE WHEN filled.k < level.k THEN {MOST}::DOUBLE * size
    ELSE least({MOST}::DOUBLE * size, weight * (SELECT rest FROM filled f WHERE f.k = level.k) / (SELECT left_ FROM filled f WHERE f.k = level.k)::DOUBLE) END AS target
  FROM filled, level
), rated AS (SELECT source, source_size, target, target / nullif(source_size, 0) AS rate FROM dealt)
SELECT doc_id, size, source_size, target, coalesce(floor(rate) + (number < rate - floor(rate))::INT, 0)::BIGINT AS copies, size * copies AS taken, docs.source
FROM docs JOIN rated ON docs.source IS NOT DISTINCT FROM rated.source"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)::BIGINT) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS own, list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.row <> b.row AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE own QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id NULLS LAST, n.row))::INTEGER AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.own AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10"""
