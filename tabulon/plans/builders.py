"""Builders of decisions over the fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import probability as pr
from ..functions import strings as st
from ..operators import builders as bd
from ..operators import calibration as cal
from ..operators import labels as lb
from ..operators import metrics as mt
from ..operators import reports as rp
from ..operators import sampling as sm
from ..operators import similarity as sim
from ..sources import files
from ..sources import fixtures as fx
from .evaluation import _scored
from .registry import SQL_P, plan, sql_items, sql_number, sql_uniform


@plan(f"""WITH v AS (SELECT user_id, user_id % 3 AS kind, props, event_id FROM events),
c AS (SELECT user_id, kind, props, count(*) AS n, min(event_id) AS f FROM v GROUP BY ALL),
g AS (SELECT user_id, kind, props AS gold FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1 AND n >= 2),
p AS (SELECT kind, props, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, f) AS k FROM (SELECT kind, props, count(*) AS n, min(event_id) AS f FROM v GROUP BY ALL)) WHERE k <= 200),
d AS (SELECT g.user_id, p.props, row_number() OVER (PARTITION BY g.user_id ORDER BY -ln(greatest({sql_uniform('distractor', 'g.user_id', 'p.props')}, 1e-12)) / p.n, p.props) AS k
  FROM g JOIN p ON p.kind = g.kind WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = g.user_id AND c.props = p.props)),
x AS (SELECT user_id, gold AS a FROM g UNION ALL SELECT user_id, props FROM d WHERE k <= 3)
SELECT x.user_id, any_value(g.kind) AS kind, any_value(g.gold) AS gold, string_agg(a, '|' ORDER BY {sql_uniform('order', 'x.user_id', 'a')}) AS candidates FROM x JOIN g ON g.user_id = x.user_id GROUP BY x.user_id HAVING count(*) = 4""")
def choice_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.read(spark, sf_dir, "events", "user_id", "props", "event_id").withColumn("kind", F.col("user_id") % 3)
    return bd.choice_questions(v, question="user_id", kind="kind", answer="props", order="event_id").select("user_id", "kind", "gold", F.array_join("candidates", "|").alias("candidates"))


@plan(f"""WITH s AS (SELECT doc_id, {sql_uniform('source', 'doc_id')} AS u, {sql_uniform('source-pick', 'doc_id')} AS v, doc_id % 4 = 0 AS none FROM documents)
SELECT doc_id, CASE WHEN u < 0.5 AND NOT none THEN 'a' || CAST(least(floor(v * 2), 1) AS INTEGER) WHEN u < 0.5 THEN 'p' || CAST(least(floor(v * 3), 2) AS INTEGER) WHEN u < 0.8 THEN 'p' || CAST(least(floor(v * 3), 2) AS INTEGER) ELSE 'r0' END AS picked
FROM s WHERE NOT (none AND u < 0.5) UNION ALL SELECT doc_id, 'p' || CAST(least(floor(v * 3), 2) AS INTEGER) FROM s WHERE none AND u < 0.5""")
def mixture_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half adversarial, three in ten popular, the rest random; a quarter of the documents has no adversarial pool."""
    d = fx.read(spark, sf_dir, "documents", "doc_id")
    adversarial = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a0"), F.lit("a1")))
    drawn = bd.mixture_draw([(0.5, adversarial), (0.3, F.array(F.lit("p0"), F.lit("p1"), F.lit("p2"))), (0.2, F.array(F.lit("r0")))], 0, "source", F.col("doc_id"))
    return d.select("doc_id", drawn.alias("picked"))


def presence_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images, with the classes (parts modulo 40) that are present and that are verified as absent."""
    lines = fx.read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 40).alias("c"))
    x = lines.groupBy("image").agg(F.collect_set("c").alias("seen"))
    x = x.select("image", F.filter("seen", lambda c: c % 2 == 0).alias("present"), F.filter("seen", lambda c: c % 2 == 1).alias("absent"))
    # Odd classes stand for verified-absent ones; they are asked about as the even ones before them.
    x = x.select("image", "present", F.transform("absent", lambda c: c - 1).alias("absent"))
    return x.select("image", "present", F.array_except("absent", "present").alias("absent"))


@plan()
def balanced_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.balanced_presence(presence_images(spark, sf_dir))


@plan(f"SELECT doc_id, CAST(least(floor({sql_uniform('level', 'doc_id')} * 5), 4) AS INTEGER) AS level, CASE WHEN least(floor({sql_uniform('level', 'doc_id')} * 5), 4) = 4 THEN 'none' WHEN {sql_uniform('damage', 'doc_id')} < 0.5 THEN 'drop' ELSE 'repeat' END AS damage FROM documents")
def damaged_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.damaged_texts(fx.read(spark, sf_dir, "documents", "doc_id", "text"), key="doc_id", text="text").select("doc_id", "level", "damage")


@plan()
def damaged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.damaged_texts(fx.read(spark, sf_dir, "documents", "doc_id", "text"), key="doc_id", text="text")


@plan(f"""SELECT user_id, category, CAST(state AS DOUBLE) AS yes, CAST(least(floor({sql_uniform('wording', 'user_id', 'category')} * 3), 2) AS INTEGER) AS wording FROM
(SELECT user_id, category, CASE WHEN n >= 2 THEN 1 WHEN n = 0 THEN 0 END AS state FROM
(SELECT u.user_id, c.category, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('error'), ('purchase')) c(category) LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = c.category AND e.value > 300 GROUP BY 1, 2)) WHERE state IS NOT NULL""")
def fidelity_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yes/no question per image and category whose raters agree, in one of three wordings."""
    e = fx.read(spark, sf_dir, "events", "user_id", "event_type", "value")
    n = e.groupBy("user_id").agg(*[F.count_if((F.col("event_type") == t) & (F.col("value") > 300)).alias(t) for t in ("error", "purchase")])
    x = n.select("user_id", F.explode(F.array(*[F.struct(F.lit(t).alias("category"), lb.group_state(F.array(F.col(t))).alias("state")) for t in ("error", "purchase")])).alias("q")).select("user_id", "q.category", "q.state").where("state is not null")
    return x.select("user_id", "category", F.col("state").cast("double").alias("yes"), sm.pick(F.array(F.lit(0), F.lit(1), F.lit(2)), 0, "wording", F.col("user_id"), F.col("category")).alias("wording"))


@plan("""SELECT event_id, rating, CASE rating WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 4 END AS level, CASE WHEN rating < 1 THEN NULL WHEN rating <= 3 THEN true WHEN rating >= 6 THEN false END AS bad FROM (SELECT event_id, CAST(event_id % 9 AS INTEGER) AS rating FROM events)""")
def rating_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rating")
    return fx.read(spark, sf_dir, "events", "event_id").select("event_id", (F.col("event_id") % 9).cast("int").alias("rating")).select("event_id", "rating", lb.rating_level(r).alias("level"), lb.rating_is_bad(r).alias("bad"))


@plan("""SELECT 'doc:' || doc_id || '#' || role AS uid, h10 = 0 AS test, yes FROM (SELECT doc_id, (6 * list_sum(list_transform(range(1, 40), lambda i: strpos('0123456789abcdef', h[i]) - 1)) + strpos('0123456789abcdef', h[40]) - 1) % 10 AS h10 FROM (SELECT doc_id, sha1('doc:' || doc_id) AS h FROM documents)), (VALUES ('flawed', CAST(1 AS DOUBLE)), ('control', CAST(0 AS DOUBLE))) r(role, yes)""")
def anomaly_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.read(spark, sf_dir, "documents", "doc_id").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("image_id"))
    return bd.matched_pairs(d, key="image_id").select("uid", "test", "yes")


@plan(f"""WITH {sql_items()}, s AS (SELECT *, {SQL_P} AS p0, CAST({sql_number("'dev:doc:' || doc_id")} AS DOUBLE) / 4294967295 < CAST(0.02 AS DOUBLE) AS dev FROM items WHERE doc_id % 10 <> 7 AND doc_id % 11 <> 3)
SELECT uid, dev, round(CASE WHEN NOT dev AND doc_id % 3 = 0 THEN CAST(0.7 AS DOUBLE) * quality + CAST(0.3 AS DOUBLE) * p0 ELSE quality END, 6) AS target0 FROM s""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scored(spark, sf_dir).withColumn("candidates", F.when(F.col("doc_id") % 11 == 3, F.array(F.lit("yes"), F.lit(" yes"))).otherwise(F.array(F.lit("yes"), F.lit("no"))))
    teacher = x.where("doc_id % 3 = 0").select("uid", "p", F.col("candidates").alias("c"))
    rows = bd.training_rows(x.select("uid", "image_id", "candidates", "target"), x.where("doc_id % 10 = 7"), teacher)
    return rows.select("uid", "dev", F.round(F.get("target", F.lit(0)), 6).alias("target0"))


@plan()
def teacher_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A teacher's scaling, fitted on calibration items with gold answers and applied to the others."""
    x = fx.items(spark, sf_dir)
    fits = F.broadcast(cal.fit(x.where("split = 'calib'"), ["kind"]))
    return x.where("split <> 'calib'").join(fits, "kind").select("uid", cal.calibrated(F.col("kind"), F.col("logits"), F.col("temperature"), F.col("a"), F.col("b")).alias("p"))


@plan("""WITH vb AS (SELECT vec_id, label, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > embedding[i % 64 + 1] THEN '1' ELSE '0' END), '') AS bits FROM embeddings)
SELECT b.vec_id AS id, q AS question FROM vb b, (VALUES ('face'), ('hand')) t(q) WHERE b.label > 1 AND NOT EXISTS (SELECT 1 FROM vb a WHERE a.label < 2 AND list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.bits[i] <> b.bits[i] THEN 1 ELSE 0 END)) <= 12)""")
def face_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions per crop (vector) that isn't near either of two reference sets."""
    v = fx.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", hs.adjacent_bits(F.col("embedding")).alias("bits"))
    crops, first, second = v.where("label > 1").select("id", "bits"), v.where("label = 0").select("id", "bits"), v.where("label = 1").select("id", "bits")
    near = sim.near_any(crops, first, distance=12).unionByName(sim.near_any(crops, second, distance=12)).distinct()
    return crops.join(near, "id", "left_anti").select("id", F.explode(F.array(F.lit("face"), F.lit("hand"))).alias("question"))


@plan("""SELECT e.vec_id, n.name FROM embeddings e JOIN (VALUES (0, 'zero'), (1, 'one'), (2, 'two')) n(label, name) ON n.label = e.label""")
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "embeddings", "vec_id", "label").join(F.broadcast(files.class_names(spark, ["zero", "one", "two"])), "label").select("vec_id", "name")


@plan(f"""WITH {sql_items()}, w AS (SELECT lang, doc_id % 3 AS wording, avg(CAST((gap >= 0) = (quality = 1) AS DOUBLE)) AS acc FROM items GROUP BY 1, 2) SELECT lang, round(avg(acc), 6) AS mean, round(min(acc), 6) AS worst FROM w GROUP BY lang""")
def wording_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scored(spark, sf_dir).groupBy("lang", (F.col("doc_id") % 3).alias("wording")).agg(mt.accuracy(F.col("p"), F.col("y")).alias("acc"))
    return x.groupBy("lang").agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.min("acc"), 6).alias("worst"))


@plan("SELECT conv_id AS image, round(max(s), 6) AS score FROM (SELECT conv_id, length(text) / CAST(1000 AS DOUBLE) AS s FROM conversations) GROUP BY conv_id")
def max_over_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "conversations", "conv_id", "text").groupBy(F.col("conv_id").alias("image")).agg(F.round(F.max(F.length("text") / F.lit(1000.0)), 6).alias("score"))


@plan(f"""WITH {sql_items()} SELECT lang, count(*) AS n FROM (SELECT lang, split, bool_or(split = 'report') OVER (PARTITION BY source, lang) AS any_report FROM items) WHERE split = 'report' OR NOT any_report GROUP BY lang""")
def split_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.report_items(fx.items(spark, sf_dir), ["source", "lang"]).groupBy("lang").agg(F.count("*").alias("n"))


@plan("""SELECT p_partkey AS id, 'C' || p_partkey % 7 || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE '' END AS cand, CASE WHEN p_partkey % 3 = 0 THEN 'ep' || p_size ELSE p_size || 'e+15' END AS budget, 'lr' || substr('ABC', 1 + p_partkey % 3, 1) AS lr, CAST(p_size AS VARCHAR) AS seed, CASE WHEN p_partkey % 4 = 0 THEN 'labels' END AS sanity FROM part""")
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of runs put together from parts, and taken apart."""
    x, k = fx.read(spark, sf_dir, "part", "p_partkey", "p_size"), F.col("p_partkey")
    budget = F.when(k % 3 == 0, F.concat(F.lit("ep"), F.col("p_size"))).otherwise(F.concat(F.col("p_size"), F.lit("e+15")))
    name = F.concat(F.lit("C"), k % 7, F.when(k % 2 == 0, "b").otherwise(""), F.lit("_"), budget, F.lit("_lr"), F.substring(F.lit("ABC"), (k % 3 + 1).cast("int"), F.lit(1)), F.lit("_s"), F.col("p_size"), F.when(k % 4 == 0, "_labels").otherwise(""))
    return x.select(k.alias("id"), files.run_name(name).alias("r")).select("id", "r.*")


@plan("""SELECT conv_id, turn, CASE WHEN len(w) > 1 AND (turn % 3 < 2 OR len(w) < 6) THEN array_to_string(w[1:6], '|') WHEN len(w) > 1 THEN array_to_string(w[1:4], '|') || ', H: ' || w[5] END AS options, CASE WHEN len(w) > 1 THEN 'Which one?' END AS stem
FROM (SELECT conv_id, turn, regexp_extract_all(text, '[a-z]{2,}') AS w FROM conversations)""")
def option_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in the three forms of a layout, with the first words of each turn as options; one form has an option with a false head."""
    w = F.regexp_extract_all("text", F.lit("([a-z]{2,})"), F.lit(1))
    c = fx.read(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", w.alias("w"))
    letter = lambda i: F.substring(F.lit("ABCDEF"), i + 1, F.lit(1))
    own = F.slice("w", 1, 6)
    inline = F.concat(F.lit("Which one?\nOptions: "), F.array_join(F.transform(own, lambda x, i: F.concat(letter(i), F.lit(": "), x)), ", "))
    block = F.concat(F.lit("Hint: a letter.\nQuestion: Which one?\nChoices:\n"), F.array_join(F.transform(own, lambda x, i: F.concat(F.lit("("), letter(i), F.lit(") "), x)), "\n"))
    false = F.concat(F.lit("Which one?\nOptions: "), F.array_join(F.transform(F.slice("w", 1, 4), lambda x, i: F.concat(letter(i), F.lit(". "), x)), "\n"), F.lit(", H: "), F.get("w", F.lit(4)))
    question = F.when((F.col("turn") % 3 == 2) & (F.size("w") > 5), false).when(F.col("turn") % 3 == 1, block).otherwise(inline)
    o = st.parse_options(question)
    return c.select("conv_id", "turn", F.array_join(o["options"], "|").alias("options"), o["stem"].alias("stem"))


@plan("""SELECT source, count(*) AS n FROM (SELECT 'documents' AS source, doc_id AS id FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'conversations', conv_id FROM conversations WHERE turn = 0 UNION ALL SELECT 'events', event_id FROM events WHERE event_type = 'view') GROUP BY source""")
def union_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources put together, without excluded ids, and counted."""
    d = fx.read(spark, sf_dir, "documents", "doc_id")
    docs = d.join(d.where("doc_id % 7 = 0"), "doc_id", "left_anti").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"))
    turns = fx.read(spark, sf_dir, "conversations", "conv_id", "turn").where("turn = 0").select(F.lit("conversations").alias("source"), F.col("conv_id").alias("id"))
    views = fx.read(spark, sf_dir, "events", "event_id", "event_type").where("event_type = 'view'").select(F.lit("events").alias("source"), F.col("event_id").alias("id"))
    return docs.unionByName(turns).unionByName(views).groupBy("source").agg(F.count("*").alias("n"))
