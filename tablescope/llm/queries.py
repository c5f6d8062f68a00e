"""Registered queries of this package, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.catalog import read

Query = Callable[[SparkSession, str], DataFrame]

QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM windows),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.text, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(range(2, len(w.w) + 1), lambda i: w.w[i] = w.w[i - 1]))::BIGINT AS n_stutter
      FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_stutter > 30 * n_words
    OR regexp_matches(text, '(?:\p{Lu}{2,}\P{L}+){12}')
    OR regexp_matches(text, '(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D]{1000}')) AS kept
FROM v
"""


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.quality import quality_cascade

    return quality_cascade(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
        length(role) + length(text) + length(regexp_replace(text, '[^~<#]', '', 'g')) + length(regexp_replace(role, '[^~<#:]', '', 'g'))
        + length('### ') + length(': ') + length('</turn>') + 1 AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.chat import chains, format_trees, loss_text, read_turns

    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    done = format_trees(chains(rows)).withColumns({
        "turns": read_turns(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_mask"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree.id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: Bytes per shard.
SHARD_LIMIT = 32 << 20

SHARDS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS b,
             CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS BIGINT) AS h FROM documents),
nodes AS (SELECT k AS depth, h >> (60 - k) AS prefix, sum(b)::BIGINT AS bytes FROM d, range(0, 61) t(k) GROUP BY ALL),
shards AS (SELECT n.* FROM nodes n LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.prefix = n.prefix >> 1
           WHERE n.bytes <= {SHARD_LIMIT} AND (n.depth = 0 OR up.bytes > {SHARD_LIMIT}))
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
  depth::INT AS shard_depth, bytes AS shard_bytes
FROM d JOIN shards s ON h >> (60 - s.depth) = s.prefix
"""


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.shards import assign_shards

    sized = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return assign_shards(sized, SHARD_LIMIT, size=F.col("n_bytes")).select("doc_id", "shard", "shard_depth", "shard_bytes")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.secret_scan import find_secrets, span_text

    def count(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.packing import pack

    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.decontaminate import find_leaks, split_item

    question, answer = split_item(F.col("text"))
    found = find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), question, answer)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", "leak.score", F.col("leak.question").alias("question_overlap"), F.col("leak.answer").alias("answer_overlap"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON reach.r = ways.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.jaccard import jaccard_groups

    return jaccard_groups(read(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.columns import crc_mod4, held_out
    from tablescope.llm.language import identify, train

    docs = read(spark, sf_dir, "documents")
    model = train(docs.filter(crc_mod4(F.col("doc_id")) != 2).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.columns import crc_mod4, held_out
    from tablescope.llm.toxicity import class_totals, draw_labels, score_toxicity, train

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(crc_mod4(F.col("doc_id")) != 2).select("doc_id", "toxic")
    drawn = docs.join(F.broadcast(draw_labels(labels)), "doc_id").select("text", "toxic")
    model = train(drawn, texts=docs.select("text"), totals=class_totals(labels))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.url_model import Rule, filter_urls

    rules = [Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False),
             Rule("com", "/fr/", True), Rule("com", "/de/", False)]
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict", "score")


_VECTORS_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE {label}embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS asked, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"""

NEGATIVES_SQL = _VECTORS_SQL.format(label="label IS NOT NULL AND ") + """,
p AS (SELECT asked, other AS positive_id, score AS positive_score FROM (
  SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, other) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.asked, positive_id, positive_score, other, score,
    row_number() OVER (PARTITION BY p.asked, positive_id ORDER BY score DESC, other) AS r
  FROM p JOIN s ON s.asked = p.asked AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT asked AS anchor_id, positive_id, r::INT AS rank, other AS negative_id, positive_score, score AS negative_score FROM n WHERE r <= 3
"""

TOP_SQL = _VECTORS_SQL.format(label="") + """
SELECT asked AS query_id, r::INT AS rank, other AS vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, other) AS r FROM s) WHERE r <= 5
"""


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.negatives import mine_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.threshold import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.merkle import digest, fold, manifest

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, digest(
        [*map(F.col, fields[:-1]), F.replace("text", F.lit("\n"), F.lit(""))]))
    done = manifest(read(spark, sf_dir, "documents"), fields, carry={"changed": changed})
    siblings = F.flatten(F.transform("proof", lambda s: s["others"]))
    folded = done.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_language_id": (language, None),
    "op2_toxicity": (toxicity, None),
    "op3_packing": (packing, None),
    "op4_chat_formatting": (chat, CHAT_SQL),
    "op5_benchmark_decontamination": (decontamination, None),
    "op6_sharding": (shards, SHARDS_SQL),
    "op7_ngram_jaccard_join": (jaccard, JACCARD_SQL),
    "op8_quality_rules": (quality, QUALITY_SQL),
    "op9_url_filters": (urls, None),
    "op10_secret_scans": (secrets, None),
    "op11_hard_negatives": (negatives, NEGATIVES_SQL),
    "op12_exact_top_k": (top_rows, TOP_SQL),
    "op13_merkle_manifest": (merkle, None),
}
