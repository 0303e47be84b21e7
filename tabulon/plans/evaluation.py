"""Evaluation: scoring, metrics, intervals, fits, breakdowns, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import probability as pr
from ..functions import strings as st
from ..operators import calibration as cal
from ..operators import metrics as mt
from ..operators import reports as rp
from ..operators import resampling as rs
from ..operators import serving as sv
from ..operators.ranking import quantiles
from ..sources import fixtures as fx
from .registry import SQL_P, plan, sql_items, sql_uniform
from .session import prepared

_ITEMS = f"WITH {sql_items()}"
_SCORED = f"{_ITEMS}, s AS (SELECT *, {SQL_P} AS p0, CAST(quality AS DOUBLE) AS y0, greatest({SQL_P}, 1 - {SQL_P}) AS conf, CASE WHEN (gap >= 0) = (quality = 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS correct FROM items)"


def _scored(spark: SparkSession, sf_dir: str, slot: str = "noise") -> DataFrame:
    x = fx.items(prepared(spark), sf_dir, slot).withColumn("p", pr.softmax(F.col("logits")))
    return x.withColumn("y", F.col("target")).withColumn("conf", pr.confidence(F.col("p"))).withColumn("correct", pr.correctness(F.col("p"), F.col("target"))).withColumn("positive", F.col("quality") == 1)


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


_SQL_ECE = "SELECT lang, sum(n * abs(a - c)) / sum(n) AS ece FROM (SELECT lang, bin, count(*) AS n, avg(conf) AS c, avg(correct) AS a FROM (SELECT *, len(list_filter(range(1, 15), lambda i: i / CAST(15 AS DOUBLE) <= conf)) AS bin FROM s {where}) GROUP BY 1, 2) GROUP BY lang"
_SQL_AUROC = "SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(won) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) ELSE CAST('NaN' AS DOUBLE) END AS auroc FROM (SELECT {by}, pos, neg, pos * (coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CAST(0.5 AS DOUBLE) * neg) AS won FROM (SELECT {by}, {score}, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM s {where} GROUP BY {by}, {score})) GROUP BY {by}"


@plan(f"""{_SCORED}, a AS (SELECT lang, count(*) AS n, avg(correct) AS accuracy FROM s WHERE split = 'report' GROUP BY lang), e AS ({_SQL_ECE.format(where="WHERE split = 'report'")}), u AS ({_SQL_AUROC.format(by='lang', score='gap', where="WHERE split = 'report'")})
SELECT a.lang, n, round(accuracy, 6) AS accuracy, round(auroc, 6) AS auroc, round(ece, 6) AS ece FROM a JOIN e ON a.lang = e.lang JOIN u ON a.lang = u.lang""")
def scorer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, AUROC and calibration error on the report split, per language."""
    x = _scored(spark, sf_dir).where("split = 'report'")
    a = x.groupBy("lang").agg(F.count("*").alias("n"), _r(mt.accuracy(F.col("p"), F.col("y"))).alias("accuracy"))
    u = mt.auroc(x, ["lang"], score="gap").select("lang", _r(F.col("auroc")).alias("auroc"))
    e = mt.calibration_error(x, ["lang"]).select("lang", _r(F.col("ece")).alias("ece"))
    return a.join(u, "lang").join(e, "lang")


@plan(f"{_SCORED} SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 THEN 1 / (1 + exp(-(CAST(1.5 AS DOUBLE) * gap + CAST(0.25 AS DOUBLE)))) ELSE 1 / (1 + exp(-gap / 2)) END, 6) AS p_yes FROM s")
def softmax_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platt scaling where it was fitted, a temperature elsewhere."""
    x = fx.items(spark, sf_dir)
    a = F.when(F.col("doc_id") % 2 == 0, 1.5)
    return x.select("doc_id", _r(F.get(cal.calibrated(F.col("kind"), F.col("logits"), F.lit(2.0), a, F.when(a.isNotNull(), 0.25)), F.lit(0))).alias("p_yes"))


@plan(f"{_SCORED} SELECT doc_id, round_even(p0, 4) AS value, round_even(conf, 4) AS confidence FROM s")
def answer_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scored(spark, sf_dir).withColumn("a", sv.answer(F.col("kind"), F.col("p"), F.array(F.lit("yes"), F.lit("no"))))
    return x.select("doc_id", F.col("a.value").alias("value"), F.col("a.confidence").alias("confidence"))


@plan(f"{_SCORED} SELECT lang, round(avg(correct), 6) AS accuracy, round(avg(correct) FILTER (doc_id % 9 <> 0), 6) AS without_ties FROM s GROUP BY lang")
def accuracy_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose target is split evenly count as the first option, or are left out."""
    x = _scored(spark, sf_dir)
    y = F.when(F.col("doc_id") % 9 == 0, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.col("y"))
    return x.groupBy("lang").agg(_r(mt.accuracy(F.col("p"), F.col("y"))).alias("accuracy"), _r(mt.accuracy_without_ties(F.col("p"), y)).alias("without_ties"))


@plan(f"{_SCORED} SELECT lang, round(avg(-ln(greatest(CASE WHEN quality = 1 THEN p0 ELSE 1 - p0 END, 1e-12))), 6) AS nll, round(avg(2 * (p0 - y0) * (p0 - y0)), 6) AS brier FROM s GROUP BY lang")
def nll_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("lang").agg(_r(F.avg(pr.nll(F.col("p"), F.col("y")))).alias("nll"), _r(F.avg(pr.brier(F.col("p"), F.col("y")))).alias("brier"))


_ORDINAL = f"""o AS (SELECT doc_id, lang, CAST(least(4, round_even(4 * {sql_uniform('level', 'doc_id')}, 0)) AS INTEGER) AS level, round(4 * {sql_uniform('level', 'doc_id')}, 6) AS mos,
round(4 * (CAST(0.7 AS DOUBLE) * {sql_uniform('level', 'doc_id')} + CAST(0.3 AS DOUBLE) * {sql_uniform('guess', 'doc_id')}), 6) AS guess FROM documents),
op AS (SELECT *, list_transform(range(0, 5), lambda i: exp(-abs(i - guess)) / list_sum(list_transform(range(0, 5), lambda j: exp(-abs(j - guess))))) AS p FROM o)"""


def _ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.ordinal_items(spark, sf_dir).withColumn("p", pr.softmax(F.col("logits")))


@plan(f"""WITH {_ORDINAL} SELECT lang, round(avg(list_sum(list_transform(range(1, 6), lambda i: (list_sum(p[1:i]) - CASE WHEN level < i THEN 1 ELSE 0 END) ** 2)) - CAST(0.3 AS DOUBLE) * ln(p[level + 1])), 6) AS loss FROM op GROUP BY lang""")
def rps_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordinal(spark, sf_dir).groupBy("lang").agg(_r(F.avg(pr.proper_loss(F.col("p"), F.col("target"), F.lit("score")))).alias("loss"))


@plan(f"""WITH {_ORDINAL}, e AS (SELECT *, round(p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5], 6) AS x FROM op),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / CAST(2 AS DOUBLE) AS rx, rank() OVER (PARTITION BY lang ORDER BY mos) + (count(*) OVER (PARTITION BY lang, mos) - 1) / CAST(2 AS DOUBLE) AS ry FROM e)
SELECT lang, round(corr(rx, ry), 6) AS srcc, round(corr(x, mos), 6) AS plcc FROM r GROUP BY lang""")
def spearman_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _ordinal(spark, sf_dir).withColumn("x", F.round(pr.expected_level(F.col("p")), 6))
    return mt.correlations(x, ["lang"], "x", "mos").select("lang", _r(F.col("srcc")).alias("srcc"), _r(F.col("plcc")).alias("plcc"))


@plan(f"{_SCORED} SELECT lang, round(ece, 6) AS ece FROM ({_SQL_ECE.format(where='')})")
def ece15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.calibration_error(_scored(spark, sf_dir), ["lang"]).select("lang", _r(F.col("ece")).alias("ece"))


@plan()
def smooth_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.smooth_calibration_error(_scored(spark, sf_dir), ["lang"])


@plan(f"{_SCORED} SELECT lang, round(avg(risk), 6) AS aurc FROM (SELECT lang, avg(1 - correct) OVER (PARTITION BY lang ORDER BY round(conf, 9) DESC, uid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk FROM s) GROUP BY lang")
def aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.risk_coverage(_scored(spark, sf_dir).withColumn("conf", F.round("conf", 9)), ["lang"], "uid").select("lang", _r(F.col("aurc")).alias("aurc"))


@plan(f"{_SCORED} SELECT source, round(auroc, 6) AS auroc FROM ({_SQL_AUROC.format(by='source', score='gap', where='')})")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.auroc(_scored(spark, sf_dir), ["source"], score="gap").select("source", _r(F.col("auroc")).alias("auroc"))


@plan(f"""{_SCORED}, c AS (SELECT lang, count(*) FILTER (gap >= 0 AND quality = 1) AS tp, count(*) FILTER (gap >= 0 AND quality = 0) AS fp, count(*) FILTER (gap < 0 AND quality = 1) AS fn, count(*) FILTER (gap < 0 AND quality = 0) AS tn FROM s GROUP BY lang)
SELECT lang, round((CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END + CASE WHEN tn = 0 THEN 0 ELSE 2 * tn / CAST(2 * tn + fp + fn AS DOUBLE) END) / 2, 6) AS macro_f1 FROM c""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scored(spark, sf_dir).withColumn("predicted", pr.first_max(F.col("p")) == 0).withColumn("gold", F.col("positive"))
    return mt.macro_f1(x, ["lang"]).select("lang", _r(F.col("macro_f1")).alias("macro_f1"))


@plan(f"""{_SCORED} SELECT lang, round(avg(CAST(p0 >= 0.5 AS DOUBLE)) FILTER (quality = 1), 6) AS recall_yes, round(avg(CAST(p0 < 0.5 AS DOUBLE)) FILTER (quality = 0), 6) AS specificity, round(avg(CAST(gap >= 0 AS DOUBLE)), 6) AS said_yes FROM s GROUP BY lang""")
def recall_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.get("p", F.lit(0))
    return _scored(spark, sf_dir).groupBy("lang").agg(_r(F.avg(F.when(F.col("positive"), (p >= 0.5).cast("double")))).alias("recall_yes"), _r(F.avg(F.when(~F.col("positive"), (p < 0.5).cast("double")))).alias("specificity"), _r(F.avg((pr.first_max(F.col("p")) == 0).cast("double"))).alias("said_yes"))


_WILSON = "round((k / CAST(n AS DOUBLE) + CAST(1.9208 AS DOUBLE) / n {s} CAST(1.96 AS DOUBLE) * sqrt(k / CAST(n AS DOUBLE) * (1 - k / CAST(n AS DOUBLE)) / n + CAST(3.8416 AS DOUBLE) / (4 * CAST(n AS DOUBLE) * n))) / (1 + CAST(3.8416 AS DOUBLE) / n), 6)"


@plan(f"{_SCORED} SELECT lang, n, {_WILSON.format(s='-')} AS low, {_WILSON.format(s='+')} AS high FROM (SELECT lang, count(*) AS n, CAST(sum(correct) AS BIGINT) AS k FROM s GROUP BY lang)")
def wilson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scored(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    low, high = pr.wilson(F.col("k"), F.col("n"))
    return x.select("lang", "n", _r(low).alias("low"), _r(high).alias("high"))


@plan(f"""{_SCORED} SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS attribute, CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source ELSE 'all' END AS value, count(*) AS n, round(avg(CAST(p0 >= 0.5 AS DOUBLE)), 6) AS flagged FROM s GROUP BY GROUPING SETS ((lang), (source), ())""")
def fairness_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.get("p", F.lit(0))
    x = _scored(spark, sf_dir).groupingSets([[F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count("*").alias("n"), _r(F.avg((p >= 0.5).cast("double"))).alias("flagged"), F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"))
    return x.select(F.when(F.col("gl") == 0, "lang").when(F.col("gs") == 0, "source").otherwise("all").alias("attribute"), F.when(F.col("gl") == 0, F.col("lang")).when(F.col("gs") == 0, F.col("source")).otherwise("all").alias("value"), "n", "flagged")


@plan(f"""{_SCORED}, t AS (SELECT quantile_cont(gap, CAST(0.55 AS DOUBLE)) AS t FROM s WHERE quality = 0)
SELECT lang, round(t, 6) AS threshold, round(avg(CAST(gap >= t AS DOUBLE)), 6) AS flagged FROM s, t WHERE quality = 1 GROUP BY lang, t""")
def matched_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap that 45% of the bad items reach, and how many good ones of each language do."""
    x = _scored(spark, sf_dir)
    t = quantiles(x.where("quality = 0"), [], "gap", {"t": 0.55}).select("t")
    return x.where("quality = 1").crossJoin(F.broadcast(t)).groupBy("lang", "t").agg(_r(F.avg((F.col("gap") >= F.col("t")).cast("double"))).alias("flagged")).select("lang", _r(F.col("t")).alias("threshold"), "flagged")


@plan()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.grouped_bootstrap(_scored(spark, sf_dir), ["lang"], "source", "correct")


@plan()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _scored(spark, sf_dir).select("uid", "lang", "source", F.col("correct").alias("a"))
    b = _scored(spark, sf_dir, "other").select("uid", F.col("correct").alias("b"))
    return rs.paired_bootstrap(a.join(b, "uid"), ["lang"], "source", "a", "b", repeats=2000)


@plan()
def paired_auroc_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much better one run tells good from bad documents than another, with an interval from resampled sources."""
    a = _scored(spark, sf_dir).select("uid", "lang", "source", "positive", F.col("gap").alias("a"))
    b = _scored(spark, sf_dir, "other").select("uid", F.col("gap").alias("b"))
    return rs.auroc_difference(a.join(b, "uid"), ["lang"], "source", "positive", "a", "b", repeats=500)


_PAIRS = f"""{_SCORED}, pairs AS (SELECT lang, source, max(gap) FILTER (quality = 1) AS good, max(gap) FILTER (quality = 0) AS bad FROM s GROUP BY lang, source HAVING bad IS NOT NULL AND good IS NOT NULL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scored(spark, sf_dir).groupBy("lang", "source").agg(F.max(F.when(F.col("positive"), F.col("gap"))).alias("good"), F.max(F.when(~F.col("positive"), F.col("gap"))).alias("bad"))
    return x.where("good is not null and bad is not null")


@plan(f"{_PAIRS} SELECT lang, n, round(k / CAST(n AS DOUBLE), 6) AS win_rate, {_WILSON.format(s='-')} AS low, {_WILSON.format(s='+')} AS high FROM (SELECT lang, count(*) AS n, count(*) FILTER (good > bad) AS k FROM pairs GROUP BY lang)")
def pair_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _pairs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("good") > F.col("bad")).alias("k"))
    low, high = pr.wilson(F.col("k"), F.col("n"))
    return x.select("lang", "n", _r(F.col("k") / F.col("n")).alias("win_rate"), _r(low).alias("low"), _r(high).alias("high"))


@plan(f"{_PAIRS} SELECT a.lang, round(avg(CASE WHEN a.good > b.bad THEN 1.0 WHEN a.good = b.bad THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS auroc FROM pairs a JOIN pairs b ON a.lang = b.lang GROUP BY a.lang")
def pair_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _pairs(spark, sf_dir)
    both = x.select("lang", F.col("good").alias("score"), F.lit(True).alias("positive")).unionByName(x.select("lang", F.col("bad").alias("score"), F.lit(False).alias("positive")))
    return mt.auroc(both, ["lang"]).select("lang", _r(F.col("auroc")).alias("auroc"))


@plan()
def pair_auroc_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.auroc_bootstrap(_pairs(spark, sf_dir), ["lang"], "source", "good", "bad", repeats=300)


@plan(f"""{_SCORED} SELECT lang, source, bool_and(correct = 1) AND count(*) >= 4 AS all_right, bool_or(correct = 0) AS flagged FROM s GROUP BY lang, source""")
def all_questions_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("lang", "source").agg((F.bool_and(F.col("correct") == 1) & (F.count("*") >= 4)).alias("all_right"), F.bool_or(F.col("correct") == 0).alias("flagged"))


_SEEDS = "WITH " + ", ".join(sql_items(f"seed{i}").replace("items AS", f"i{i} AS") for i in range(3)) + ", runs AS (" + " UNION ALL ".join(f"SELECT lang, {i} AS seed, avg(CAST((gap >= 0) = (quality = 1) AS DOUBLE)) AS acc FROM i{i} GROUP BY lang" for i in range(3)) + ")"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for i in range(3):
        run = _scored(spark, sf_dir, f"seed{i}").groupBy("lang").agg(mt.accuracy(F.col("p"), F.col("y")).alias("acc")).withColumn("seed", F.lit(i))
        out = run if out is None else out.unionByName(run)
    return out


@plan(f"{_SEEDS} SELECT lang, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS sd, string_agg(printf('%.4f', acc), ',' ORDER BY seed) AS each FROM runs GROUP BY lang")
def seed_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rp.over_seeds(_runs(spark, sf_dir), ["lang"], "acc")
    return x.select("lang", _r(F.col("mean")).alias("mean"), _r(F.col("sd")).alias("sd"), F.array_join(F.transform("each", lambda v: F.format_string("%.4f", v)), ",").alias("each"))


@plan(f"{_SEEDS} SELECT lang, seed, round(acc, 6) AS acc FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY acc DESC, seed) AS k FROM runs) WHERE k = 1")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.best_run(_runs(spark, sf_dir), ["lang"], "acc", "seed", largest=True).select("lang", "seed", _r(F.col("acc")).alias("acc"))


@plan(f"{_SEEDS} SELECT lang, round(max(acc) FILTER (seed = 0), 6) AS s0, round(max(acc) FILTER (seed = 1), 6) AS s1, round(max(acc) FILTER (seed = 2), 6) AS s2 FROM runs GROUP BY lang")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rp.pivoted(_runs(spark, sf_dir).withColumn("run", F.concat(F.lit("s"), F.col("seed").cast("string"))).withColumn("acc", _r(F.col("acc"))), "lang", "run", ["s0", "s1", "s2"], "acc")
    return x.select("lang", "s0", "s1", "s2")


@plan("WITH " + ", ".join(sql_items(f"seed{i}").replace("items AS", f"i{i} AS") for i in range(3)) + ", v AS (" + " UNION ALL ".join(f"SELECT uid, 'm{i}' AS rater, gap >= 0 AS c FROM i{i}" for i in range(3)) + ") SELECT x.rater AS a, y.rater AS b, round(avg(CAST(x.c = y.c AS DOUBLE)), 6) AS share, count(*) AS n FROM v x JOIN v y ON x.uid = y.uid AND x.rater < y.rater GROUP BY 1, 2")
def agreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = None
    for i in range(3):
        v = fx.items(spark, sf_dir, f"seed{i}").select("uid", F.lit(f"m{i}").alias("rater"), (F.col("gap") >= 0).alias("c"))
        votes = v if votes is None else votes.unionByName(v)
    return rp.agreement(votes, "uid", "rater", "c").select("a", "b", _r(F.col("share")).alias("share"), "n")


@plan(f"{_ITEMS}, s AS (SELECT CAST(doc_id % 4 AS BIGINT) AS wording, CASE WHEN doc_id % 2 = 0 THEN gap ELSE -gap END AS adj, quality FROM items) SELECT wording, round(auroc, 6) AS auroc FROM ({_SQL_AUROC.format(by='wording', score='adj', where='')})")
def polarity_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC per wording, of the score turned around for wordings of negative polarity."""
    x = fx.items(spark, sf_dir).withColumn("wording", F.col("doc_id") % 4).withColumn("adj", F.when(F.col("doc_id") % 2 == 0, F.col("gap")).otherwise(-F.col("gap"))).withColumn("positive", F.col("quality") == 1)
    return mt.auroc(x, ["wording"], score="adj").select("wording", _r(F.col("auroc")).alias("auroc"))


@plan(f"""WITH {sql_items('noise')}, {sql_items('other').replace('items AS', 'b AS')}, j AS (SELECT items.lang, items.gap AS ga, b.gap AS gb, CAST(1 AS DOUBLE) / (1 + exp(-items.gap)) AS pa, CAST(1 AS DOUBLE) / (1 + exp(-b.gap)) AS pb FROM items JOIN b ON b.uid = items.uid)
SELECT lang, round(avg(abs(pa - pb)), 6) AS mean_change, round(max(abs(pa - pb)), 6) AS max_change, count(*) FILTER ((ga >= 0) <> (gb >= 0) AND abs(pb - CAST(0.5 AS DOUBLE)) > CAST(0.05 AS DOUBLE)) AS flips FROM j GROUP BY lang""")
def fidelity_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a variant's probabilities are from the baseline's, and how many clear answers turned."""
    a = _scored(spark, sf_dir).select("uid", "lang", F.col("gap").alias("ga"), F.get("p", F.lit(0)).alias("pa"))
    b = _scored(spark, sf_dir, "other").select("uid", F.col("gap").alias("gb"), F.get("p", F.lit(0)).alias("pb"))
    flip = ((F.col("ga") >= 0) != (F.col("gb") >= 0)) & (F.abs(F.col("pb") - 0.5) > 0.05)
    d = F.abs(F.col("pa") - F.col("pb"))
    return a.join(b, "uid").groupBy("lang").agg(_r(F.avg(d)).alias("mean_change"), _r(F.max(d)).alias("max_change"), F.count_if(flip).alias("flips"))


@plan(f"{_SCORED} SELECT lang, round(avg(CASE WHEN doc_id % 9 = 0 OR correct = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS tie_aware, round(avg(correct) FILTER (doc_id % 4 = 0), 6) AS trap FROM s GROUP BY lang")
def tie_aware_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer counts if it is one of the acceptable ones; and accuracy on trap items alone."""
    x = _scored(spark, sf_dir)
    good = F.when(F.col("doc_id") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(F.col("positive"), 0).otherwise(1)))
    return x.groupBy("lang").agg(_r(F.avg(F.array_contains(good, pr.first_max(F.col("p"))).cast("double"))).alias("tie_aware"), _r(F.avg(F.when(F.col("doc_id") % 4 == 0, F.col("correct")))).alias("trap"))


@plan(f"{_SCORED} SELECT uid, round(CASE WHEN split <> 'calib' AND doc_id % 3 = 0 THEN CAST(0.7 AS DOUBLE) * y0 + CAST(0.3 AS DOUBLE) * p0 ELSE y0 END, 6) AS target0 FROM s")
def teacher_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training targets move towards a teacher's, where it has the same candidates."""
    x = _scored(spark, sf_dir)
    teacher = x.where("doc_id % 3 = 0").select("uid", F.col("p").alias("t"), F.array(F.lit("yes"), F.lit("no")).alias("c"))
    j = x.withColumn("candidates", F.array(F.lit("yes"), F.lit("no"))).join(teacher, "uid", "left")
    use = (F.col("c") == F.col("candidates")) & (F.size("t") == F.size("y")) & (F.col("split") != "calib")
    mixed = F.zip_with("y", "t", lambda a, b: 0.7 * a + 0.3 * b)
    blend = F.when(F.coalesce(use, F.lit(False)), F.transform(mixed, lambda v: v / pr.total(mixed))).otherwise(F.col("y"))
    return j.select("uid", _r(F.get(blend, F.lit(0))).alias("target0"))


@plan()
def fit_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature and Platt scaling of the calibration split, per language."""
    return cal.fit(fx.items(spark, sf_dir).where("split = 'calib'"), ["lang"])


@plan()
def fit_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.fit(_ordinal(spark, sf_dir).select(F.lit("score").alias("kind"), "logits", "target"), ["kind"]).select("kind", "n", "temperature")


@plan()
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's variants (raw, temperature, Platt), fitted on the calibration and measured on the report split."""
    x = fx.items(prepared(spark), sf_dir)
    calib = x.where("split = 'calib'")
    # A row per kind of question, of which there are three.
    fits = F.broadcast(cal.fit(calib, ["kind"]))

    def variants(rows: DataFrame) -> DataFrame:
        raw = F.struct(F.lit("raw").alias("variant"), pr.softmax(F.col("logits")).alias("p"))
        scaled = F.struct(F.lit("temperature").alias("variant"), pr.softmax(F.col("logits"), F.col("temperature")).alias("p"))
        platt = F.struct(F.lit("platt").alias("variant"), pr.platt(F.col("logits"), F.col("a"), F.col("b")).alias("p"))
        v = rows.join(fits, "kind").withColumn("v", F.explode(F.array(raw, scaled, platt))).select("uid", "source", F.col("v.variant").alias("variant"), F.col("v.p").alias("p"), F.col("target").alias("y"), (F.col("quality") == 1).alias("positive"))
        return v.withColumn("conf", pr.confidence(F.col("p"))).withColumn("correct", pr.correctness(F.col("p"), F.col("y"))).withColumn("score", F.get("p", F.lit(0)))

    nll = F.avg(pr.nll(F.col("p"), F.col("y")))
    # All measures read the scored rows; they are derived once.
    v = variants(rp.report_items(x, ["kind"])).checkpoint()
    base = v.groupBy("variant").agg(F.count("*").alias("n"), mt.accuracy(F.col("p"), F.col("y")).alias("acc"), nll.alias("nll"), F.avg(pr.brier(F.col("p"), F.col("y"))).alias("brier"), F.avg("conf").alias("mean_conf"))
    base = base.join(variants(calib).groupBy("variant").agg(nll.alias("calib_nll")), "variant", "left")
    smooth = mt.smooth_calibration_error(v, ["variant"]).drop("n")
    return base.join(mt.calibration_error(v, ["variant"]), "variant").join(smooth, "variant").join(mt.risk_coverage(v, ["variant"], "uid"), "variant").join(mt.auroc(v, ["variant"]), "variant").join(rs.grouped_bootstrap(v, ["variant"], "source", "correct").drop("mean"), "variant")


@plan()
def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.read(spark, sf_dir, "embeddings")
    key = F.concat(F.lit("vec:"), F.col("vec_id").cast("string"))
    rows = e.select("embedding", (F.col("label") < 5).cast("int").alias("y"), (hs.digest_number(key) % 10 < 3).alias("test"), (hs.digest_number(key, 9) % 5 == 0).alias("inner"))
    return rp.linear_probe(rows, "embedding", "y", test="test")


@plan("SELECT event_type, round(quantile_cont(value, CAST(0.5 AS DOUBLE)), 6) AS p50, round(quantile_cont(value, CAST(0.95 AS DOUBLE)), 6) AS p95, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.latency(fx.read(prepared(spark), sf_dir, "events", "event_type", "value"), ["event_type"], "value").select("event_type", *[_r(F.col(c)).alias(c) for c in ("p50", "p95", "mean")], "n")


@plan("SELECT event_type, v[1 + least(n - 1, CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT))] AS p95, n FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY event_type)")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.nearest_rank(fx.read(prepared(spark), sf_dir, "events", "event_type", "value"), ["event_type"], "value")


@plan("""WITH x AS (SELECT CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 17 AS DOUBLE) AS b, p_retailprice AS y FROM part),
m AS (SELECT avg(a) AS u, avg(b) AS v, avg(y) AS w FROM x), c AS (SELECT sum((a - u) ** 2) AS pp, sum((a - u) * (b - v)) AS pq, sum((b - v) ** 2) AS qq, sum((a - u) * (y - w)) AS pr, sum((b - v) * (y - w)) AS qr FROM x, m),
f AS (SELECT (pr * qq - qr * pq) / (pp * qq - pq * pq) AS fa, (qr * pp - pr * pq) / (pp * qq - pq * pq) AS fb, u, v, w FROM c, m)
SELECT round(w - fa * u - fb * v, 6) AS c, round(fa, 6) AS a, round(fb, 6) AS b, round(1 - sum((y - (w - fa * u - fb * v) - fa * a - fb * b) ** 2) / sum((y - w) ** 2), 6) AS r2, round(avg(abs((y - (w - fa * u - fb * v) - fa * a - fb * b) / y)), 6) AS mape, count(*) AS n FROM x, f GROUP BY fa, fb, u, v, w""")
def latency_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx.read(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x1"), (F.col("p_partkey") % 17).cast("double").alias("x2"), F.col("p_retailprice").alias("y"))
    return rp.cost_fit(x, "x1", "x2", "y").select(*[_r(F.col(c)).alias(c) for c in ("c", "a", "b", "r2", "mape")], "n")


@plan("SELECT p_partkey, round(CAST(0.15 AS DOUBLE) + CAST(0.036 AS DOUBLE) * p_size + greatest(p_retailprice * 1e6 / 250e9, p_size * 1e9 / 50e12) * 1000, 6) AS ms FROM part")
def hardware_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "part").select("p_partkey", _r(rp.projected_ms(F.col("p_size"), F.col("p_size") * 1e9, F.col("p_retailprice") * 1e6)).alias("ms"))


@plan("""WITH g AS (SELECT event_type, user_id, count(*) AS m, avg(CAST(value < 100 AS DOUBLE)) AS legal, avg(CAST(value < 50 AS DOUBLE)) AS agrees, quantile_cont(value, CAST(0.5 AS DOUBLE)) AS ms FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS games, round(avg(m), 6) AS moves_mean, quantile_cont(CAST(m AS DOUBLE), CAST(0.5 AS DOUBLE)) AS moves_median, max(m) AS moves_max, round(avg(legal), 6) AS legal, round(avg(agrees), 6) AS agrees, round(avg(ms), 6) AS ms FROM g GROUP BY event_type""")
def game_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.read(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("game"), (F.col("value") < 100).alias("legal"), (F.col("value") < 50).alias("agrees"), F.col("value").alias("ms"))
    return rp.game_protocol(e, ["event_type"]).select("event_type", "games", "moves_median", "moves_max", *[_r(F.col(c)).alias(c) for c in ("moves_mean", "legal", "agrees", "ms")])


@plan("""WITH p AS (SELECT a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)
SELECT round(quantile_cont(list_cosine_similarity(CAST(x AS DOUBLE[]), CAST(y AS DOUBLE[])), CAST(0.5 AS DOUBLE)), 6) AS cosine, round(quantile_cont(list_distance(CAST(x AS DOUBLE[]), CAST(y AS DOUBLE[])) / sqrt(list_dot_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[]))), CAST(0.5 AS DOUBLE)), 6) AS change, count(*) AS n FROM p""")
def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    p = e.where("vec_id % 2 = 0").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after")), "vec_id")
    return rp.vector_change(p, "embedding", "after").agg(_r(F.percentile("cosine", F.lit(0.5))).alias("cosine"), _r(F.percentile("change", F.lit(0.5))).alias("change"), F.count("*").alias("n"))


@plan("""WITH g AS (SELECT conv_id, turn, unnest(list_filter(['all', CASE WHEN length(text) < 60 THEN 'short' END, CASE WHEN contains(text, ',') THEN 'comma' END, CASE WHEN regexp_matches(text, '(?i)^th') THEN 'th' END], lambda x: x IS NOT NULL)) AS grp, length(text) AS k FROM conversations)
SELECT grp, count(*) AS n, round(avg(k), 6) AS mean FROM g GROUP BY grp""")
def phrasing_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = rp.overlapping_groups({"all": F.lit(True), "short": F.length("text") < 60, "comma": F.contains("text", F.lit(",")), "th": F.rlike("text", F.lit("(?i)^th"))})
    return fx.read(spark, sf_dir, "conversations").select(F.explode(groups).alias("grp"), F.length("text").alias("k")).groupBy("grp").agg(F.count("*").alias("n"), _r(F.avg("k")).alias("mean"))


@plan("""SELECT conv_id, turn, len(regexp_extract_all(lower(text), '([a-z\\-'']+)')) AS n_tokens FROM conversations""")
def question_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(st.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@plan()
def nearest_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each held-out wording the least word edit distance to a training wording (two short fixed lists)."""
    from .curation import templated_wordings

    train = templated_wordings(spark, sf_dir).select("question")
    fresh = spark.createDataFrame([("Is there any glitch in this image?",), ("Does this picture contain flaws?",)], "fresh string")
    return fresh.crossJoin(F.broadcast(train)).groupBy("fresh").agg(F.min(st.word_edit_distance(st.tokens(F.col("fresh")), st.tokens(F.col("question")))).alias("distance"))


@plan("SELECT label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM embeddings GROUP BY label")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.read(spark, sf_dir, "embeddings", "label").groupBy("label").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("label", "n", _r(F.col("n") / F.col("all")).alias("share"))
