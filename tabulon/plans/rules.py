"""Queries of label rules, samples and per-row functions that no other query uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import probability as pr
from ..functions import strings as st
from ..operators import labels as lb
from ..operators import sampling as sm
from ..operators import serving as sv
from ..sources import fixtures as fx
from .registry import plan, sql_number, sql_uniform


def _r(c, digits: int = 6):
    return F.round(c, digits)


@plan("SELECT event_id, event_id % 2 = 0 AS flag FROM events")
def tri_state_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as 1, 1.0, 0 and 0.0."""
    i = F.col("event_id") % 4
    return fx.read(spark, sf_dir, "events", "event_id").select("event_id", lb.tri_state_flag(F.when(i == 0, "1").when(i == 2, "1.0").when(i == 1, "0").otherwise("0.0")).alias("flag"))


@plan("SELECT doc_id, quality = 0 OR toxic = 0 AS clear FROM labels")
def unclear_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("toxic") == 0, "good").otherwise("unclear")
    return fx.read(spark, sf_dir, "labels").select("doc_id", lb.keep_clear(F.col("quality") == 0, tag).alias("clear"))


@plan("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 > 0 OR event_type = 'click' AS hand FROM events")
def part_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that count flaws of a hand, or have a tag that names it."""
    e = fx.read(spark, sf_dir, "events", "event_id", "event_type", "props").withColumn("k", F.from_json("props", "k int")["k"] % 3)
    parts = F.create_map(F.lit("foot"), F.lit(1), F.lit("hand"), F.col("k"))
    tags = F.when(F.col("event_type") == "click", F.array(F.lit("bad hands"))).otherwise(F.array(F.lit("blur"), F.lit("eyes")))
    return e.select("event_id", lb.part_named(parts, tags, "hand").alias("hand"))


@plan("SELECT user_id, round(a / CAST(n AS DOUBLE), 6) AS a, round(b / CAST(n AS DOUBLE), 6) AS b, round((n - a - b) / CAST(n AS DOUBLE), 6) AS c FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b, count(*) AS n FROM events GROUP BY user_id)")
def rater_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "click"), F.count_if(~F.col("event_type").isin("view", "click"))]
    x = fx.read(spark, sf_dir, "events", "user_id", "event_type").groupBy("user_id").agg(F.array(*own).alias("n"))
    t = pr.histogram_target(F.col("n"))
    return x.select("user_id", *[_r(F.get(t, F.lit(i))).alias(c) for i, c in enumerate("abc")])


@plan("""SELECT event_id, CASE WHEN k % 3 = 0 THEN 'a|b' WHEN k % 3 = 1 THEN 'a|c' ELSE 'a|b|c' END AS options, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 2 END AS gold FROM (SELECT event_id, event_id AS k FROM events)""")
def padded_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of which some are padding, and the gold one's new place (here the third of three)."""
    k = F.col("event_id") % 3
    options = F.when(k == 0, F.array(F.lit("a"), F.lit("b"), F.lit("nan"))).when(k == 1, F.array(F.lit("a"), F.lit("NaN"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    o = lb.without_padding(options, F.lit(2))
    return fx.read(spark, sf_dir, "events", "event_id").select("event_id", F.array_join(o["options"], "|").alias("options"), o["gold"].alias("gold"))


@plan("SELECT conv_id, turn, n = 1 AS once FROM (SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda w: trim(w) = 'the')) AS n FROM conversations)")
def gold_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "conversations").select("conv_id", "turn", lb.matched_once(F.split("text", " "), F.lit(" the ")).alias("once"))


@plan("SELECT p_partkey, abs(CAST(w AS DOUBLE) / 100 - CAST(v AS DOUBLE) / 100) <= 0.02 * (CAST(v AS DOUBLE) / 100) AS agrees FROM (SELECT p_partkey, 100 + p_size AS w, 100 + p_size + p_partkey % 5 AS v FROM part)")
def aspect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = 100 + F.col("p_size"), 100 + F.col("p_size") + F.col("p_partkey") % 5
    return fx.read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", lb.aspect_agrees(w.cast("double"), F.lit(100.0), v.cast("double"), F.lit(100.0)).alias("agrees"))


_BOXES = "b AS (SELECT l_orderkey AS image_id, l_linenumber AS k, (l_partkey % 40) / CAST(100 AS DOUBLE) AS x0, (l_suppkey % 30) / CAST(100 AS DOUBLE) AS y0, l_quantity / CAST(100 AS DOUBLE) AS side, l_returnflag = 'R' AS grp, l_linestatus = 'F' AND l_returnflag = 'A' AS draw FROM lineitem)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx.read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    x0, y0, side = F.col("l_partkey") % 40 / F.lit(100.0), F.col("l_suppkey") % 30 / F.lit(100.0), F.col("l_quantity") / F.lit(100.0)
    return x.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("box"), x0.alias("x0"), y0.alias("y0"), (x0 + side).alias("x1"), (y0 + side).alias("y1"), (F.col("l_returnflag") == "R").alias("is_group"), ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")).alias("is_depiction"), F.lit(400).alias("w"), F.lit(300).alias("h"))


@plan(f"""WITH {_BOXES} SELECT image_id, k AS box FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ((x0 + side) - x0) * ((y0 + side) - y0) DESC, x0, y0) AS n FROM b WHERE (x0 + side) - x0 >= CAST(0.15 AS DOUBLE) AND NOT grp AND NOT draw) WHERE n <= 2 AND least(((x0 + side) - x0) * 400, ((y0 + side) - y0) * 300) >= 64""")
def face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest boxes of each image (order) that are faces of their own, then those of some size; of boxes alike in place and size,
    which the SQL leaves open, those of the smallest numbers."""
    return lb.face_boxes(_boxes(spark, sf_dir), ties=("box",)).select("image_id", "box")


@plan(f"""WITH {_BOXES}, p AS (SELECT image_id, k, x0 * 400 AS a, y0 * 300 AS b, (x0 + side) * 400 AS c, (y0 + side) * 300 AS d FROM b), s AS (SELECT *, greatest(c - a, d - b) * CAST(2.2 AS DOUBLE) / 2 AS half FROM p)
SELECT image_id, k AS box, round_even(greatest(0, (a + c) / 2 - half), 0) AS x0, round_even(greatest(0, (b + d) / 2 - half), 0) AS y0, round_even(least(400, (a + c) / 2 + half), 0) AS x1, round_even(least(300, (b + d) / 2 + half), 0) AS y1 FROM s""")
def context_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of context around each box, in pixels, within the image."""
    b = _boxes(spark, sf_dir)
    box = lb.context_box(F.col("x0") * 400, F.col("y0") * 300, F.col("x1") * 400, F.col("y1") * 300, F.lit(400.0), F.lit(300.0))
    return b.select("image_id", "box", *[box[c].alias(c) for c in ("x0", "y0", "x1", "y1")])


@plan(f"SELECT doc_id, row_number() OVER (ORDER BY {sql_uniform('sample', 'doc_id')}, doc_id) AS place FROM documents QUALIFY place <= 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents (the sample's size is the feature), in the order in which they were drawn."""
    s = sm.sample(fx.read(spark, sf_dir, "documents", "doc_id"), 50, 0, "doc_id")
    u = hs.keyed_uniform(0, "sample", F.col("doc_id"))
    return s.agg(F.array_sort(F.collect_list(F.struct(u.alias("u"), "doc_id"))).alias("all")).select(F.posexplode("all").alias("i", "x")).select("x.doc_id", (F.col("i") + 1).cast("long").alias("place"))


@plan(f"SELECT doc_id, lag(doc_id) OVER (ORDER BY {sql_uniform('shuffle', 'doc_id', seed=3)}, doc_id) AS after FROM documents")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document each one comes after in a shuffled order: the order is global, so partitions hand on their last ones."""
    from ..operators.ranking import numbered
    from .session import prepared

    d = fx.read(prepared(spark), sf_dir, "documents", "doc_id").withColumn("u", sm.shuffle_key(3, "doc_id"))
    p = numbered(d, ["u", "doc_id"]).select("doc_id", "place").checkpoint()
    return p.join(p.select(F.col("doc_id").alias("after"), (F.col("place") + 1).alias("place")), "place", "left").select("doc_id", "after")


@plan("SELECT doc_id, 'sha1:' || left(sha1(text), 16) AS id FROM documents")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", hs.content_id(F.col("text")).alias("id"))


@plan(f"SELECT vec_id, {sql_number("'vec:' || vec_id")} % 10 < 3 AS test, {sql_number("'vec:' || vec_id", 9)} % 5 = 0 AS inner FROM embeddings".replace("AS inner", 'AS "inner"'))
def probe_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("vec:"), F.col("vec_id").cast("string"))
    return fx.read(spark, sf_dir, "embeddings", "vec_id").select("vec_id", (hs.digest_number(key) % 10 < 3).alias("test"), (hs.digest_number(key, 9) % 5 == 0).alias("inner"))


@plan("""SELECT p_partkey, CASE WHEN substr(w, 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END || ' ' || w AS noun, rtrim(w, 's') AS one, rtrim(w, 's') = rtrim(v, 's') AS clash, w || CASE WHEN p_size % 2 = 0 THEN ': ' || v ELSE '' END AS candidate,
CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'tin') THEN 'tin' ELSE 'other' END AS maker FROM (SELECT *, lower(split_part(p_name, ' ', 1)) AS w, lower(split_part(p_name, ' ', 1)) || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE 'x' END AS v FROM part)""")
def noun_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, plurals, clashes with plurals, candidate texts, and the first listed name in a text."""
    p = fx.read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_type").withColumn("w", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))).withColumn("v", F.concat("w", F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("x")))
    value = F.when(F.col("p_size") % 2 == 0, F.col("v")).otherwise("")
    return p.select("p_partkey", F.concat(st.article(F.col("w")), F.lit(" "), "w").alias("noun"), st.singular(F.col("w")).alias("one"), st.clashes(F.col("w"), F.col("v")).alias("clash"), st.candidate_text(F.col("w"), value).alias("candidate"), st.first_listed(F.lower("p_type"), ["steel", "tin"]).alias("maker"))


@plan("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE octet_length(encode(left(text, 40))) END AS bytes FROM documents")
def decoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 with a data URL's header, without one, and text that is none."""
    raw = F.base64(F.encode(F.substring("text", 1, 40), "UTF-8"))
    i = F.col("doc_id") % 3
    data = F.when(i == 0, raw).when(i == 1, F.concat(F.lit("data:image/png;base64,"), raw)).otherwise("not base64!")
    return fx.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.octet_length(sv.decodable(data)).cast("long").alias("bytes"))


@plan("""SELECT vec_id, round(ln(exp(a) + exp(b) + exp(c)), 5) AS lse, CAST(label % 3 = 1 AS DOUBLE) AS hot, round(b - a, 5) AS antonym, CASE WHEN label = 0 THEN round(0.7 / 0.85, 6) WHEN label = 4 THEN 0.7 WHEN label < 4 THEN 0.7 END AS soft, 5 AS wide, round((a + b) / 2, 5) AS turned
FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of summed exponentials, one-hot and soft ordinal targets, antonym levels, padding, and the average over cyclic orders."""
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    a, b = F.get(v, F.lit(0)), F.get(v, F.lit(1))
    label = F.col("label")
    turned = pr.rotation_average(F.array(F.array(a, b), F.array(F.lit(0.0), b)))
    soft = F.when(label < 5, F.get(pr.soft_level(label), label))
    return fx.read(spark, sf_dir, "embeddings").select("vec_id", _r(pr.log_sum_exp(v), 5).alias("lse"), F.get(pr.one_hot(label % 3, F.lit(3)), F.lit(1)).alias("hot"), _r(F.get(pr.antonym_score(F.array(b, a), F.lit(3)), F.lit(1)), 5).alias("antonym"), _r(soft).alias("soft"), F.size(pr.padded(v, 5, 0.0)).alias("wide"), _r(F.get(turned, F.lit(0)), 5).alias("turned"))
