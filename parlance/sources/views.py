"""The conversation model over the given tables: one function for each view, and the same view as SQL.

Each view reads only the columns it needs; times are UTC without a zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The moment that relative cutoffs, leases and sweeps are computed for.
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as timed segments: 400 ms a word, pauses of 300, 700, 1100 and 1500 ms in turn."""
    c = table(spark, sf_dir, "conversations")
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("bigint")
    rows = c.select(
        F.col("conv_id").alias("call_id"),
        F.col("turn").alias("sequence"),
        F.expr("CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'customer' ELSE 'supervisor' END").alias("speaker_role"),
        F.expr("CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END").alias("speaker_id"),
        F.col("text").alias("raw_text"),
        n.alias("n_words"),
        (300 + 400 * (F.col("turn") % 4)).alias("gap"),
    )
    so_far = Window.partitionBy("call_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + 400 * F.col("n_words")).over(so_far)
    return rows.withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - 400 * F.col("n_words")).drop("gap")


SEGMENTS = r"""segments AS (
  SELECT *, end_ms - 400 * n_words AS start_ms FROM (
    SELECT conv_id AS call_id, turn AS sequence,
      CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'customer' ELSE 'supervisor' END AS speaker_role,
      CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS speaker_id,
      text AS raw_text, len(regexp_extract_all(text, '\S+')) AS n_words,
      sum(300 + 400 * (turn % 4) + 400 * len(regexp_extract_all(text, '\S+'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS end_ms
    FROM conversations))"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each word, 400 ms long, with 1,600 ms more after every 25 words of a segment."""
    s = segments(spark, sf_dir)
    w = s.select("call_id", "sequence", "speaker_id", "start_ms", F.posexplode(F.regexp_extract_all("raw_text", F.lit(r"\S+"), F.lit(0))).alias("pos", "word"))
    start = F.col("start_ms") + 400 * F.col("pos") + 1600 * F.floor(F.col("pos") / 25)
    return w.select("call_id", "sequence", "pos", "word", "speaker_id", start.alias("start_ms"), (start + 400).alias("end_ms"))


WORDS = r"""words AS (
  SELECT call_id, sequence, pos, word, speaker_id, s + 400 * pos + 1600 * (pos // 25) AS start_ms, s + 400 * pos + 1600 * (pos // 25) + 400 AS end_ms
  FROM (SELECT call_id, sequence, speaker_id, start_ms AS s, unnest(w) AS word, unnest(range(len(w))) AS pos
        FROM (SELECT *, regexp_extract_all(raw_text, '\S+') AS w FROM segments)))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns: segments moved by 200 ms, later if even, earlier if odd; every seventh is missing."""
    s = segments(spark, sf_dir).where((F.col("call_id") + F.col("sequence")) % 7 != 0)
    by = F.when(F.col("sequence") % 2 == 0, 200).otherwise(-200)
    return s.select("call_id", F.col("sequence").alias("turn"), "speaker_id", F.greatest(F.col("start_ms") + by, F.lit(0)).alias("start_ms"), (F.col("end_ms") + by).alias("end_ms"))


TURNS = """turns AS (
  SELECT call_id, sequence AS turn, speaker_id,
    greatest(start_ms + CASE WHEN sequence % 2 = 0 THEN 200 ELSE -200 END, 0) AS start_ms,
    end_ms + CASE WHEN sequence % 2 = 0 THEN 200 ELSE -200 END AS end_ms
  FROM segments WHERE (call_id + sequence) % 7 <> 0)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 5).alias("organization_id"),
        F.concat(F.lit("call-"), F.col("o_orderkey").cast("string")).alias("external_id"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'incoming' WHEN 1 THEN 'outgoing' ELSE 'unknown' END").alias("direction"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END").alias("status"),
        F.when(F.col("o_orderkey") % 13 != 0, F.floor("o_totalprice")).alias("duration_ms"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_favorite"),
        F.col("o_orderdate").alias("created_at"),
    )


CALLS = """calls AS (
  SELECT o_orderkey AS id, o_custkey % 5 AS organization_id, 'call-' || o_orderkey AS external_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'incoming' WHEN 1 THEN 'outgoing' ELSE 'unknown' END AS direction,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status,
    CASE WHEN o_orderkey % 13 <> 0 THEN floor(o_totalprice)::BIGINT END AS duration_ms,
    o_orderpriority = '1-URGENT' AS is_favorite, o_orderdate AS created_at
  FROM orders)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queue entries; every 97th belongs to no call."""
    e = table(spark, sf_dir, "events")
    status = "CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'cancelled' END"
    return e.select(
        F.col("event_id").alias("id"),
        F.expr("CASE WHEN event_id % 97 <> 0 THEN user_id END").alias("call_id"),
        F.col("event_type").alias("kind"),
        F.expr(status).alias("status"),
        F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)).alias("priority"),
        (F.col("event_id") % 4).alias("attempt"),
        F.lit(3).cast("bigint").alias("max_attempts"),
        (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 3).cast("int"))).alias("run_after"),
        F.expr("CASE WHEN event_id % 5 = 1 THEN ts END").alias("locked_at"),
        F.expr("CASE WHEN event_id % 5 = 1 THEN concat('w', event_id % 4) END").alias("locked_by"),
        F.expr("CASE WHEN event_id % 5 = 3 THEN concat('error ', event_type) END").alias("last_error"),
        F.col("ts").alias("created_at"),
    )


JOBS = """jobs AS (
  SELECT event_id AS id, CASE WHEN event_id % 97 <> 0 THEN user_id END AS call_id, event_type AS kind,
    CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS status,
    coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS priority, event_id % 4 AS attempt, 3::BIGINT AS max_attempts,
    ts + to_hours((event_id % 3)::INTEGER) AS run_after, CASE WHEN event_id % 5 = 1 THEN ts END AS locked_at,
    CASE WHEN event_id % 5 = 1 THEN 'w' || (event_id % 4) END AS locked_by,
    CASE WHEN event_id % 5 = 3 THEN 'error ' || event_type END AS last_error, ts AS created_at
  FROM events)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored transcripts: language and first line, also as JSON."""
    d = table(spark, sf_dir, "documents")
    lang = F.when(F.col("doc_id") % 50 != 0, F.col("lang"))
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    nested = F.struct(F.array(F.struct(F.upper(lang).alias("language"))).alias("languages"), F.array(F.struct(first.alias("normalized_text"))).alias("segments"))
    return d.select(F.col("doc_id").alias("call_id"), lang.alias("primary_language"), first.alias("sample_text"), F.to_json(nested).alias("transcript_json"))


TRANSCRIPTS = """transcripts AS (
  SELECT doc_id AS call_id, CASE WHEN doc_id % 50 <> 0 THEN lang END AS primary_language,
    string_split(coalesce(text, ''), chr(10))[1] AS sample_text
  FROM documents)"""


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as call analyses."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    d = d.join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(
        F.col("doc_id").alias("call_id"),
        F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 8), " ").alias("title"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 <> 0 THEN source END").alias("customer_intent"),
        (F.col("quality") == 1).alias("resolved"),
        (0.5 * F.col("quality") - F.col("toxic")).alias("sentiment_score"),
    )


ANALYSES = r"""analyses AS (
  SELECT doc_id AS call_id, array_to_string(regexp_extract_all(text, '\S+')[1:8], ' ') AS title,
    CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 <> 0 THEN source END AS customer_intent,
    quality = 1 AS resolved, 0.5 * quality - toxic AS sentiment_score
  FROM documents JOIN labels USING (doc_id))"""


def voice_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as voice prints, two to a call; every tenth has a name."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.floor(F.col("vec_id") / 2).alias("call_id"),
        (F.col("vec_id") % 2).cast("int").alias("speaker_id"),
        F.expr("CASE WHEN vec_id % 10 = 0 THEN concat('spk_', label) END").alias("name"),
        "label",
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


VOICE_PRINTS = """voice_prints AS (
  SELECT vec_id AS id, vec_id // 2 AS call_id, (vec_id % 2)::INTEGER AS speaker_id,
    CASE WHEN vec_id % 10 = 0 THEN 'spk_' || label END AS name, label, embedding::DOUBLE[] AS embedding
  FROM embeddings)"""


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the text index's entries."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("call_id"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 8), " ").alias("title"), F.col("text").alias("transcript"), F.col("source").alias("topics"), "lang")


SEARCH = r"""search_documents AS (
  SELECT doc_id AS call_id, array_to_string(regexp_extract_all(text, '\S+')[1:8], ' ') AS title, text AS transcript, source AS topics, lang FROM documents)"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as recordings; a third have no duration yet."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("call_id"),
        F.expr("concat('calls/', l_orderkey, '/', l_linenumber, '.wav')").alias("object_key"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'audio/wav' ELSE 'audio/mpeg' END").alias("mime_type"),
        F.when(F.col("l_linenumber") % 3 != 0, F.floor("l_extendedprice")).alias("duration_ms"),
    )


RECORDINGS = """recordings AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS call_id, concat('calls/', l_orderkey, '/', l_linenumber, '.wav') AS object_key,
    CASE WHEN l_linenumber % 2 = 0 THEN 'audio/wav' ELSE 'audio/mpeg' END AS mime_type,
    CASE WHEN l_linenumber % 3 <> 0 THEN floor(l_extendedprice)::BIGINT END AS duration_ms
  FROM lineitem)"""


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as what a call's index entry is made of, with lists and missing texts."""
    d = table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(F.regexp_extract("text", r"^(?:\s*+\S++){1,16}", 0), F.lit(r"\S+"), F.lit(0))  # the first 16 are asked for
    return d.select(
        F.col("doc_id").alias("call_id"),
        (F.col("doc_id") % 5).alias("organization_id"),
        F.array_join(F.slice(words, 1, 8), " ").alias("title"),
        F.array_join(F.slice(words, 9, 8), " ").alias("summary"),
        F.col("text").alias("transcript"),
        F.array("source", "lang").alias("topics"),
        F.array(F.concat(F.lit("place"), (F.col("doc_id") % 20).cast("string"))).alias("entities"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN 'Café visit' END").alias("reason"),
        F.lit(None).cast("string").alias("resolution"),
    )


INDEX_ROWS = r"""index_rows AS (
  SELECT doc_id AS call_id, array_to_string(w[1:8], ' ') AS title, array_to_string(w[9:16], ' ') AS summary, coalesce(text, '') AS transcript,
    concat_ws(' ', source, lang) AS topics, 'place' || (doc_id % 20) AS entities, CASE WHEN doc_id % 3 = 0 THEN 'Café visit' ELSE '' END AS reason, '' AS resolution
  FROM (SELECT *, regexp_extract_all(text, '\S+') AS w FROM documents))"""


def sql(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
