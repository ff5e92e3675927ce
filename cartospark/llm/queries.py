"""The thin contract queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_overlaps
from .hmm_lm import score_documents
from .html_wrapper import extract_main_text
from .jaccard_join import jaccard_join
from .quality_classifier import GOOD, GOOD_PROB, LEVELS, grade, label_grades, train
from .quality_rules import quality_rules
from .segmentation import sample_segmentations
from .sharding import shard_by_slots
from .store import Scratch
from .token_file import read_token_file, write_token_file
from .tool_calls import SCHEMA_DDL, link_tool_calls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=90)


def segmentation_digest(docs: DataFrame, **options) -> DataFrame:
    """Three distinct sampled segmentations of every document; ids as their number and checksum."""
    found = sample_segmentations(docs, _tokenizer("piece_bpe_32k.model"), k=3, **options)
    digest = [(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")]
    return found.select("doc_id", "sample", "log_prob", "perturbed", "log_inclusion", *digest, "round_trip")


def op2_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation_digest(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_by_slots(_table(spark, sf_dir, "documents"), 8, Scratch(spark, "slot-map").path("map"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op4_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "token-file").path("files")
    write_token_file(_table(spark, sf_dir, "documents"), folder, _tokenizer("byte_bpe_50k.json"), end_id=0)
    return read_token_file(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, thresholds = train(docs, label_grades(_table(spark, sf_dir, "labels")), LEVELS)
    return grade(docs, weights, thresholds, GOOD, GOOD_PROB).drop("text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("overlaps", lambda o: o["item_id"])))
    matched = F.aggregate("overlaps", F.lit(0).cast("long"), lambda a, o: F.greatest(a, o["matched"]))
    return found.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), items.alias("item_ids"), F.size("overlaps").cast("long").alias("n_overlaps"), matched.alias("most_matched"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool traffic: a turn of the user calls the tool `reply`, the assistant's turn after it answers.

    Every turn of the table is an event: those of the system call the tool `configure`.  A user's turn needs the
    answer to the user's turn two before it.  The log is out of order (a turn's place in it is turn * 37 modulo 101), so that the
    links alone say what comes first.
    """
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.expr("turn * 37 % 101").cast("long").alias("pos"))
    arguments = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("text"), F.col("role").alias("role")))
    tool = F.when(F.col("role") == "user", "reply").otherwise("configure")
    calls = turns.where("role is null or role != 'assistant'").select("conv_id", "pos", F.col("turn").cast("string").alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), F.when(F.col("role") == "user", (F.col("turn") - 2).cast("string")).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", "pos", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content"))
    kinds = (("turn", "integer", None, 0.0), ("text", "string", None, None), ("role", "string", ['"user"', '"system"'], None))
    parameters = [(tool, key, kind, key != "role", allowed, least) for tool in ("reply", "configure") for key, kind, allowed, least in kinds]
    return link_tool_calls(calls, results, spark.createDataFrame(parameters, f"{SCHEMA_DDL}, allowed array<string>, least double"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 counts, which SQL can say too."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def hmm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 counts, and its base score to six digits, which SQL can say too."""
    return op4_hmm_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_jaccard_join, op2_segmentations, op3_sharding, op4_hmm_lm, op5_token_file, op6_quality_rules, op7_quality_classifier, op8_decontamination, op9_main_text, op10_tool_calls, quality_counts, hmm_base_scores)
}

_WORD = r"'[^ \t\n\x0b\f\r]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32_sql(blob: str) -> str:
    """The checksum of a blob, byte by byte over the polynomial's table."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    byte = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(([{', '.join(map(str, table))}]::BIGINT[])[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295::BIGINT)"


_OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p), r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u, least(u, min(v)) AS component_id FROM r GROUP BY u), k AS (SELECT component_id, count(*) AS class_size FROM c GROUP BY component_id), d AS (SELECT u, count(*) AS links FROM e GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c.component_id, doc_id) AS component_id, coalesce(class_size, 1) AS class_size, coalesce(links, 0) AS links
FROM s LEFT JOIN c ON c.u = doc_id LEFT JOIN k ON k.component_id = c.component_id LEFT JOIN d ON d.u = doc_id"""

_OP3 = f"""WITH RECURSIVE m AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {_crc32_sql("encode(coalesce(text, ''))")} AS text_crc32 FROM documents),
r AS (SELECT *, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(text_crc32 AS VARCHAR)), 1, 8) AS BIGINT) % 4096 AS INTEGER) AS virtual_slot FROM m),
u AS (SELECT virtual_slot, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS rows, virtual_slot % 8 AS old FROM r GROUP BY virtual_slot),
f AS (SELECT *, sum(bytes) OVER (PARTITION BY old ORDER BY bytes DESC, virtual_slot ROWS UNBOUNDED PRECEDING) AS run, (SELECT sum(bytes) / 8.0 FROM u) AS fair FROM u),
moved AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, rows DESC, virtual_slot DESC) AS k FROM f WHERE run > fair),
start AS (SELECT list(coalesce(load, 0) ORDER BY shard) AS loads FROM (SELECT unnest(range(8)) AS shard) LEFT JOIN (SELECT old AS shard, CAST(sum(bytes) AS BIGINT) AS load FROM f WHERE run <= fair GROUP BY old) USING (shard)),
walk AS (SELECT 0::BIGINT AS k, -1 AS virtual_slot, 0::BIGINT AS shard, loads FROM start
    UNION ALL SELECT m.k, m.virtual_slot, list_position(w.loads, list_min(w.loads)) - 1, list_transform(w.loads, lambda v, i: CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN v + m.bytes ELSE v END) FROM walk w JOIN moved m ON m.k = w.k + 1),
map AS (SELECT virtual_slot, CAST(old AS INTEGER) AS shard, rows FROM f WHERE run <= fair UNION ALL SELECT w.virtual_slot, CAST(w.shard AS INTEGER), u.rows FROM walk w JOIN u ON u.virtual_slot = w.virtual_slot),
o AS (SELECT virtual_slot, shard, coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM map)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(before + row_number() OVER (PARTITION BY r.virtual_slot ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, r.virtual_slot, 2 AS map_version
FROM r JOIN o ON o.virtual_slot = r.virtual_slot"""

_OP10 = """WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS r, role, text, CAST(turn * 37 % 101 AS BIGINT) AS pos FROM conversations),
e AS (SELECT a.*, b.pos AS parent_pos, b.turn IS NOT NULL AS has_parent, c.turn IS NOT NULL AS answered FROM t a
    LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND (a.r = 'assistant' AND b.r != 'assistant' OR a.r = 'user' AND b.r = 'assistant')
    LEFT JOIN t c ON c.conv_id = a.conv_id AND c.turn = a.turn + 1 AND a.r != 'assistant' AND c.r = 'assistant'),
late AS (SELECT DISTINCT conv_id FROM e WHERE parent_pos >= pos),
o AS (SELECT conv_id, turn, pos AS top, 0::BIGINT AS depth FROM e WHERE NOT has_parent UNION ALL SELECT e.conv_id, e.turn, greatest(o.top, e.pos), o.depth + 1 FROM o JOIN e ON e.conv_id = o.conv_id AND e.turn = o.turn + 1 AND e.has_parent)
SELECT e.conv_id, CASE WHEN r = 'assistant' THEN 'result' ELSE 'call' END AS kind, CAST(CASE WHEN r = 'assistant' THEN e.turn - 1 ELSE e.turn END AS VARCHAR) AS call_id, pos,
CASE WHEN late.conv_id IS NULL THEN pos ELSE top END AS order_pos, CASE WHEN late.conv_id IS NULL THEN 0 ELSE depth END AS depth,
CASE WHEN r = 'assistant' THEN CASE WHEN has_parent THEN 'linked' ELSE 'no call' END WHEN answered THEN 'linked' ELSE 'no result' END AS status, []::VARCHAR[] AS errors,
CASE WHEN r = 'assistant' THEN '{"content":' || to_json(text)::VARCHAR || ',"id":"' || (e.turn - 1) || '","type":"result"}'
ELSE '{"arguments":{"role":' || to_json(role)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || ',"turn":' || e.turn || '},"id":"' || e.turn || '","name":"' || CASE WHEN r = 'user' THEN 'reply' ELSE 'configure' END || '","type":"call"}' END AS json
FROM e JOIN o ON o.conv_id = e.conv_id AND o.turn = e.turn LEFT JOIN late ON late.conv_id = e.conv_id"""

_COUNTS = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, hash(w[i:i + 7]) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM win SEMI JOIN (SELECT doc_id, x FROM win GROUP BY doc_id, x HAVING count(*) > 1) t ON t.doc_id = win.doc_id AND t.x = win.x) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {_WORD}))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {_WORD})))) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c"""

_BASE = f"""WITH d AS (SELECT doc_id, {_crc32_sql("encode(CAST(doc_id AS VARCHAR))")} % 10 = 0 AS held_out, list_append(regexp_extract_all({_LOWER}, {_WORD}), ' ') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS t FROM d), c AS (SELECT t, count(*) AS c FROM t WHERE NOT held_out GROUP BY t), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 6) AS base_score FROM t LEFT JOIN c USING (t) CROSS JOIN n GROUP BY doc_id, held_out"""

ORACLE_SQL: dict[str, str] = {"op1_jaccard_join": _OP1, "op3_sharding": _OP3, "op10_tool_calls": _OP10, "quality_counts": _COUNTS, "hmm_base_scores": _BASE}
