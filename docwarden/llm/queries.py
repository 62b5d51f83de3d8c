"""One query for each operator, with production parameters, over whole tables; and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docwarden.llm.common import table


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docwarden.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docwarden.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docwarden.llm.decontamination import decontaminated

    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docwarden.llm.urlfilter import filtered

    return filtered(table(spark, sf_dir, "pages"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docwarden.llm.pii import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_replaced", "kinds")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docwarden.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docwarden.llm.licenses import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op8_chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docwarden.llm.chat import formatted

    return formatted(table(spark, sf_dir, "conversations"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docwarden.llm.passages import repeated

    return repeated(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docwarden.llm.digest import fingerprints

    return fingerprints(table(spark, sf_dir, "documents")).drop("text_key")


def op1_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the mix: sizes and targets, and how many words it takes of each source, to the next block."""
    rows = op1_mix_sources(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    near = F.abs(F.sum("taken") - F.max("target")) <= 17
    return rows.groupBy("source").agg(F.sum("size").alias("size"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target"), near.alias("near_target"), (F.max(F.col("taken") - 3 * F.col("size")) <= 0).alias("within_passes"))


def op6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def op9_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def tool_talk(conversations: DataFrame) -> DataFrame:
    """Conversations with tool calls: of each message a call that names its turn, from the second one on with the result of the one before as an
    argument, and a result a thousand turns later. Every fifth call names an unknown tool, every seventh has no result."""
    turn, before = F.col("turn").cast("string"), F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")).cast("string")
    query = F.when(before.isNotNull(), F.concat(F.lit('{"$result": "c'), before, F.lit('"}'))).otherwise(F.lit('"first"'))
    name = F.when(F.col("turn") % 5 == 4, "unknown").otherwise("search")
    call = F.concat(F.lit('<tool_call>{"id": "c'), turn, F.lit('", "name": "'), name, F.lit('", "arguments": {"query": '), query, F.lit("}}</tool_call>"))
    calls = conversations.select("conv_id", "turn", F.lit("assistant").alias("role"), call.alias("text"))
    results = conversations.where("turn % 7 <> 6").select("conv_id", (F.col("turn") + 1000).alias("turn"), F.lit("tool").alias("role"), F.concat(F.lit('{"tool_call_id": "c'), turn, F.lit('", "content": '), turn, F.lit("}")).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").union(calls).union(results)


def op8_tool_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linking, checking and ordering of the calls in tool_talk over all conversations."""
    from docwarden.llm.chat import formatted

    return formatted(tool_talk(table(spark, sf_dir, "conversations"))).select("conv_id", "turn", "kind", "call_id", "valid", "linked", "cyclic", "after", "depth", F.when(F.col("kind") != "message", F.col("json")).alias("json"))


QUERIES = {f.__name__: f for name, f in sorted(globals().items()) if name.startswith("op")}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED, _PLAIN = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES: dict[str, str] = {
    "op1_exact": f"""WITH s AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s GROUP BY source),
o AS (SELECT *, 3 * size AS cap, sum(size) OVER () - coalesce(sum(3 * size) OVER w, 0) AS room, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights FROM p WINDOW w AS (ORDER BY 3.0 * size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap <= weight * room::DOUBLE / weights AS capped, room::DOUBLE / weights AS level FROM o),
l AS (SELECT arg_min(level, 1.0 * cap / weight) AS level FROM c WHERE NOT capped)
SELECT source, size, size AS source_size, round(CASE WHEN capped THEN cap::DOUBLE ELSE weight * (SELECT level FROM l) END, 3) AS target, TRUE AS near_target, TRUE AS within_passes FROM c""",
    "op2_minhash_neardup": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id""",
    "op5_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_PLAIN}) AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({_LOW}, {_PLAIN}) AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.i, x.n, s.item_id FROM x JOIN s ON x.n = s.n AND x.g = s.g),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op6_phrases": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_PLAIN}) AS w FROM documents), f(phrase, label) AS (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')),
q AS (SELECT label, string_split(phrase, ' ') AS v FROM f),
h AS (SELECT doc_id, i - 1 AS k, label FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0), q WHERE w[i] = v[1] AND list_slice(w, i, i + len(v) - 1) = v),
g AS (SELECT doc_id, count(*) AS n, min(k) AS a, max(k) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op7_rules": r"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
k AS (SELECT *, split_part(rule, '/', 1) AS site, substr(rule, position('/' IN rule)) AS start FROM r)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u LEFT JOIN k ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page_id, host, path""",
    "op8_tool_order": """WITH m AS (SELECT conv_id, turn, lag(turn) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT *, 'c' || turn AS id, turn % 7 <> 6 AS linked, before IS NOT NULL AND before % 7 <> 6 AS waits FROM m)
SELECT conv_id, turn, 'message' AS kind, NULL AS call_id, TRUE AS valid, FALSE AS linked, FALSE AS cyclic, turn AS after, 0 AS depth, NULL AS json FROM conversations
UNION ALL SELECT conv_id, turn, 'call', id, turn % 5 <> 4, linked, FALSE, CASE WHEN waits THEN before + 1000 ELSE turn END, CASE WHEN waits THEN 1 ELSE 0 END, '{"arguments":{"query":' || CASE WHEN before IS NULL THEN '"first"' ELSE '{"$result":"c' || before || '"}' END || '},"id":"' || id || '","name":"' || CASE WHEN turn % 5 = 4 THEN 'unknown' ELSE 'search' END || '","type":"tool_call"}' FROM c
UNION ALL SELECT conv_id, turn + 1000, 'result', id, TRUE, TRUE, FALSE, turn + 1000, 0, '{"content":' || turn || ',"role":"tool","tool_call_id":"' || id || '"}' FROM c WHERE linked""",
    "op9_edited_texts": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following FROM t WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 3) || left(following, length(text) // 3)) AS edited_sha256 FROM n""",
}
