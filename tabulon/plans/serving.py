"""Packing, requests and the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import packing as pk
from ..operators import reuse as ru
from ..operators import serving as sv
from ..sources import fixtures as fx
from ..streaming import rolling
from .registry import plan
from .selection import sequence_tokens
from .session import prepared

_LENGTHS = "q AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, least(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')), 128) + 5 AS len FROM conversations)"


@plan(f"""WITH RECURSIVE {_LENGTHS}, p AS (
SELECT conv_id, turn, k, len, 0 AS seq, 0 AS start, len AS used, 1 AS n FROM q WHERE k = 1
UNION ALL SELECT q.conv_id, q.turn, q.k, q.len, CASE WHEN p.used + q.len > 320 OR p.n >= 4 THEN p.seq + 1 ELSE p.seq END, CASE WHEN p.used + q.len > 320 OR p.n >= 4 THEN 0 ELSE p.used END,
CASE WHEN p.used + q.len > 320 OR p.n >= 4 THEN q.len ELSE p.used + q.len END, CASE WHEN p.used + q.len > 320 OR p.n >= 4 THEN 1 ELSE p.n + 1 END FROM p JOIN q ON q.conv_id = p.conv_id AND q.k = p.k + 1)
SELECT conv_id AS image, turn AS ord, CAST(len AS INTEGER) AS length, seq, CAST(start AS INTEGER) AS "offset" FROM p""")
def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as questions with two one-word candidates."""
    c = fx.read(prepared(spark), sf_dir, "conversations")
    length = pk.encoded_length(F.col("text"), F.array(F.lit("yes"), F.lit("no")))
    return pk.pack(c.select(F.col("conv_id").alias("image"), F.col("turn").alias("ord"), length.alias("length")))


@plan(f"""WITH RECURSIVE {_LENGTHS.replace("conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)", "role, conv_id * 1000 + turn AS ord, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn)")}, p AS (
SELECT role, ord, k, len, 0 AS seq, 0 AS start, len AS used, 1 AS n FROM q WHERE k = 1
UNION ALL SELECT q.role, q.ord, q.k, q.len, CASE WHEN p.used + q.len > 320 OR p.n >= 9 THEN p.seq + 1 ELSE p.seq END, CASE WHEN p.used + q.len > 320 OR p.n >= 9 THEN 0 ELSE p.used END,
CASE WHEN p.used + q.len > 320 OR p.n >= 9 THEN q.len ELSE p.used + q.len END, CASE WHEN p.used + q.len > 320 OR p.n >= 9 THEN 1 ELSE p.n + 1 END FROM p JOIN q ON q.role = p.role AND q.k = p.k + 1)
SELECT role AS image, ord, CAST(len AS INTEGER) AS length, seq, CAST(start AS INTEGER) AS "offset" FROM p""")
def pack_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of a role as the questions of one image: few images with very many questions, which pointers pack."""
    c = fx.read(prepared(spark), sf_dir, "conversations")
    length = pk.encoded_length(F.col("text"), F.array(F.lit("yes"), F.lit("no")))
    return pk.pack(c.select(F.col("role").alias("image"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), length.alias("length")), max_questions=9, folded=16)


@plan("""WITH c AS (SELECT conv_id AS seq, turn + 1 AS block, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) AS n FROM conversations),
t AS (SELECT *, row_number() OVER () AS id FROM (SELECT seq, block, -1 AS cand FROM c, range(0, 100000) r(i) WHERE i < n UNION ALL SELECT seq, block, k FROM c, (VALUES (0), (1)) v(k)
UNION ALL SELECT seq, 0, -1 FROM (SELECT DISTINCT seq FROM c), range(0, 2) r(i) UNION ALL SELECT DISTINCT seq, -1, -1 FROM c))
SELECT a.block, a.cand, CAST(count(*) AS BIGINT) AS sees FROM t a JOIN t b ON a.seq = b.seq AND ((b.block = 0 AND a.block >= 0) OR (a.block > 0 AND a.block = b.block AND (a.cand < 0 OR b.cand < 0 OR a.cand = b.cand)) OR a.id = b.id) GROUP BY 1, 2""")
def visibility_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens the tokens of each place see: every word of every turn, two candidates a turn, two image tokens and one of
    padding a conversation.  Counted from the sizes of blocks, without the pairs."""
    v = pk.seen_by_block(sequence_tokens(spark, sf_dir))
    return v.groupBy(F.col("block").cast("long").alias("block"), "cand").agg(F.sum("sees").alias("sees"))


@plan(f"""WITH {_LENGTHS}, s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q)
SELECT conv_id, turn, CAST(i AS INTEGER) AS at, CAST(start + i AS BIGINT) AS pos FROM (SELECT conv_id, turn, start, unnest(range(0, len)) AS i FROM s)""")
def collate_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: the place of each question's every token in its conversation's sequence."""
    c = fx.read(spark, sf_dir, "conversations")
    length = pk.encoded_length(F.col("text"), F.array(F.lit("yes"), F.lit("no")))
    start = F.coalesce(F.sum(length.cast("long")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = c.select("conv_id", "turn", start.alias("start"), length.alias("n"))
    return placed.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("conv_id", "turn", "at", (F.col("start") + F.col("at")).alias("pos"))


@plan("""SELECT event_id, CASE WHEN k % 7 = 0 THEN 'text' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'kind' WHEN event_type = 'view' AND k < 2 THEN 'options' WHEN event_type = 'purchase' AND (k < 2 OR k > 10) THEN 'levels' END AS problem
FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from events: the type gives the kind, k the number of options; every seventh has no text."""
    e = fx.read(spark, sf_dir, "events", "event_id", "event_type", "props").withColumn("k", F.from_json("props", "k int")["k"])
    kind = F.when(F.col("event_type") == "view", "choice").when(F.col("event_type") == "click", "noul").when(F.col("event_type") == "purchase", "score").otherwise(F.col("event_type"))
    options = F.array_repeat(F.lit("x"), F.col("k"))
    return e.select("event_id", sv.question_problem(kind, F.when(F.col("k") % 7 != 0, "what?"), options).alias("problem"))


@plan("""WITH e AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events)
SELECT event_id, coalesce((SELECT count(DISTINCT b.user_id) FROM events b WHERE b.event_id > e.last AND b.event_id < e.event_id) < 64, false) AND last IS NOT NULL AS hit FROM e""")
def lru_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.read(prepared(spark), sf_dir, "events", "event_id", "user_id")
    return ru.cache_hits(e, key="user_id", order="event_id").select("event_id", "hit")


@plan("""WITH e AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events),
d AS (SELECT (SELECT count(DISTINCT b.user_id) FROM events b WHERE b.event_id > e.last AND b.event_id < e.event_id) + 1 AS capacity FROM e WHERE last IS NOT NULL)
SELECT capacity, CAST(sum(count(*)) OVER (ORDER BY capacity) AS BIGINT) AS hits FROM d GROUP BY capacity""")
def lru_hit_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of image caches of every capacity, from one pass over the log."""
    e = fx.read(prepared(spark), sf_dir, "events", "event_id", "user_id")
    return ru.hit_curve(ru.reuse_distances(e, key="user_id", order="event_id"), [])


@plan("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(avg(CAST(value > 200 AS DOUBLE)), 6) AS slow FROM events GROUP BY 1, 2""")
def rolling_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's windows over a batch of events."""
    e = fx.read(spark, sf_dir, "events")
    r = rolling.rolling_latency(e, window="1 day", slide="1 day")
    return r.select("start", "event_type", "n", F.round("mean", 6).alias("mean"), F.round("slow", 6).alias("slow"))
