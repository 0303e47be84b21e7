"""Builders that turn labelled sources into decisions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import probability as pr
from ..functions import strings as st
from . import labels as lb
from . import sampling as sm


def choice_questions(votes: DataFrame, *, question: str, kind: str, answer: str, order: str, seed: int = 0, pool: int = 200, distractors: int = 3, least: int = 2) -> DataFrame:
    """A choice per question: its most common answer among distractors that no one gave.

    Distractors come from the ``pool`` most common answers to questions of its kind, drawn in proportion to
    their counts.  Questions whose best answer has fewer than ``least`` votes, or without enough distractors, drop out.
    The pool is a short array per kind, so each question meets it in one broadcast join.
    """
    gold = lb.top_answers(votes, [question, kind], answer, order, 1).where(F.col("n") >= least).select(question, kind, F.col(answer).alias("gold"))
    given = votes.groupBy(question).agg(F.collect_set(answer).alias("given"))
    common = lb.top_answers(votes, [kind], answer, order, pool).groupBy(kind).agg(F.array_sort(F.collect_list(F.struct(F.col(answer).alias("a"), F.col("n")))).alias("pool"))
    rows = gold.join(given, question).join(F.broadcast(common), kind)
    free = F.filter("pool", lambda x: ~F.array_contains("given", x["a"]))
    drawn = F.slice(F.array_sort(F.transform(free, lambda x: F.struct(sm.weighted_order(x["n"], seed, "distractor", F.col(question), x["a"]).alias("o"), x["a"].alias("a")))), 1, distractors)
    mixed = F.array_sort(F.transform(F.concat(F.array("gold"), F.transform(drawn, lambda x: x["a"])), lambda a: F.struct(hs.keyed_uniform(seed, "order", F.col(question), a).alias("u"), a.alias("a"))))
    candidates = F.transform(mixed, lambda x: x["a"])
    rows = rows.select(question, kind, "gold", candidates.alias("candidates")).where(F.size("candidates") == distractors + 1)
    return rows.withColumn("target", F.transform("candidates", lambda c: F.when(c == F.col("gold"), 1.0).otherwise(0.0)))


def clean_questions(questions: DataFrame, vocabulary: DataFrame, known: DataFrame | None = None, *, seed: int = 0, per_image: int = 8, options: int = 4, pool: int = 200) -> DataFrame:
    """At most ``per_image`` questions of each image as decisions.

    Questions: qid, image, question, answer, kind, choose (is it an "X or Y?" question).  Yes and no stay two options; every other
    answer stands among distractors of its kind's ``pool`` most common answers (kind, answer, n), drawn in proportion to n, none
    of which clashes with it; an "X or Y?" question offers the other one first.  Too few distractors, no decision.
    ``known`` (answer): alternatives that aren't among these are no options.
    """
    place = F.row_number().over(Window.partitionBy("image").orderBy(hs.keyed_uniform(seed, "question", F.col("qid")), "qid"))
    rows = questions.withColumn("answer", F.lower(F.trim("answer"))).withColumn("_k", place).where(F.col("_k") <= per_image)
    rows = rows.withColumn("other", F.when(F.col("choose"), st.named_alternative(F.col("question"), F.col("answer"))))
    if known is not None:
        listed = known.select(F.lower(F.trim("answer")).alias("other")).distinct()
        rows = rows.join(listed.withColumn("_known", F.lit(True)), "other", "left").withColumn("other", F.when(F.col("_known"), F.col("other"))).drop("_known")
    top = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "answer"))
    pools = vocabulary.withColumn("_k", top).where(F.col("_k") <= pool).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.col("answer").alias("a"), "n"))).alias("pool"))
    plain = rows.where(F.col("answer").isin("yes", "no"))
    binary = plain.select("qid", "image", "question", F.lit("noul").alias("form"), F.array(F.lit("yes"), F.lit("no")).alias("candidates"), "answer")
    rest = rows.where(~F.col("answer").isin("yes", "no")).join(F.broadcast(pools), "kind", "left")
    given = F.array_compact(F.array("answer", "other"))
    fit = F.filter(F.coalesce("pool", F.array().cast("array<struct<a:string,n:bigint>>")), lambda x: ~st.clashes(x["a"], F.col("answer")) & ~F.array_contains(given, F.lower(F.trim(x["a"]))))
    drawn = F.transform(F.array_sort(F.transform(fit, lambda x: F.struct(sm.weighted_order(x["n"], seed, "distractor", F.col("qid"), x["a"]).alias("o"), F.lower(F.trim(x["a"])).alias("a")))), lambda x: x["a"])
    chosen = F.concat(given, F.slice(drawn, F.lit(1), options - F.size(given)))
    mixed = F.transform(F.array_sort(F.transform(chosen, lambda a: F.struct(hs.keyed_uniform(seed, "order", F.col("qid"), a).alias("u"), a.alias("a")))), lambda x: x["a"])
    several = rest.select("qid", "image", "question", F.lit("choice").alias("form"), mixed.alias("candidates"), "answer").where(F.size("candidates") == options)
    return binary.unionByName(several).withColumn("target", F.transform("candidates", lambda c: F.when(c == F.col("answer"), 1.0).otherwise(0.0)))


def which_of(images: DataFrame, counts: DataFrame, *, seed: int = 0, others: int = 3) -> DataFrame:
    """"Which of these is in the image?": image, present (a class), absent (array) -> candidates, the present one among ``others`` absent
    ones drawn in proportion to how often each is present elsewhere (class, n); images with fewer drop out.  Classes are few, so
    their counts are one map."""
    every = counts.agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("n"))
    drawn = F.array_sort(F.transform("absent", lambda c: F.struct(sm.weighted_order(F.coalesce(F.try_element_at("n", c), F.lit(0)), seed, "which", F.col("image"), c).alias("o"), c.alias("c"))))
    rows = images.where(F.size("absent") >= others).join(F.broadcast(every))
    candidates = F.concat(F.array("present"), F.transform(F.slice(drawn, 1, others), lambda x: x["c"]))
    mixed = F.array_sort(F.transform(candidates, lambda c: F.struct(hs.keyed_uniform(seed, "which-order", F.col("image"), c).alias("u"), c.alias("c"))))
    return rows.select("image", "present", F.transform(mixed, lambda x: x["c"]).alias("candidates"))


def skew_capped(answers: DataFrame, *, skew: float = 1.5, order: str = "o") -> DataFrame:
    """image, class, yes -> those left when each class keeps, of either answer, at most ``skew`` times as many as it has of the rarer one."""
    cap = answers.groupBy("class").agg(F.floor(skew * F.greatest(F.lit(1), F.least(F.count_if("yes"), F.count_if(~F.col("yes"))))).alias("cap"))
    return sm.capped_balance(answers.join(F.broadcast(cap), "class"), F.col("cap"), F.col(order), ["class", "yes"])


def mixture_draw(pools: list[tuple[float, Column]], seed: int, operator: str, *keys: Column) -> Column:
    """One entry from one of several pools: each has its share of draws, and an empty one hands its own to the next that isn't."""
    u, bound, out = hs.keyed_uniform(seed, operator, *keys), 0.0, None
    arrays = [a for _, a in pools]
    fallback = F.coalesce(*[F.when(F.size(a) > 0, sm.pick(a, seed, operator + "-pick", *keys)) for a in arrays])
    for share, a in pools:
        bound += share
        own = (u < bound) & (F.size(a) > 0)
        value = sm.pick(a, seed, operator + "-pick", *keys)
        out = F.when(own, value) if out is None else out.when(own, value)
    return out.otherwise(fallback)


#: Shards of images that keep running counts of their own.
SHARDS = 64


def balanced_presence(images: DataFrame, *, seed: int = 0, shards: int = SHARDS) -> DataFrame:
    """image, present (array), absent (array) -> a present class at random, and the absent class that was so far asked with
    "yes" most often more than with "no".

    The running counts make this a fold over the images in the order of their draws.  With one shard it is the fold over all
    of them; with more, each shard of images keeps counts of its own, which balances as well and has no single task.  The
    number of shards is part of the operator, not of the session: the answer is the same on any cluster.
    """
    order = hs.keyed_uniform(seed, "fold", F.col("image"))
    n = shards
    rows = images.where((F.size("present") > 0) & (F.size("absent") > 0)).withColumn("o", order).withColumn("shard", F.pmod(F.xxhash64("image"), F.lit(n)))
    rows = rows.withColumn("yes", sm.pick(F.array_sort("present"), seed, "present", F.col("image")))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[int, Counter] = {}
        for batch in batches:
            out = []
            for shard, image, yes, absent in zip(batch["shard"], batch["image"], batch["yes"], batch["absent"], strict=True):
                lead = asked.setdefault(shard, Counter())
                no = max(sorted(absent), key=lambda c: lead[c])
                lead[yes] += 1
                lead[no] -= 1
                out.append((image, yes, no))
            yield pd.DataFrame(out, columns=["image", "yes", "no"])

    types = dict(rows.dtypes)
    return rows.repartition(n, "shard").sortWithinPartitions("shard", "o", "image").select("shard", "image", "yes", "absent").mapInPandas(fold, f"image {types['image']}, yes {types['yes']}, no {types['yes']}")


def damaged_texts(docs: DataFrame, *, key: str, text: str, seed: int = 0) -> DataFrame:
    """A stand-in for damaged images: words go missing or come twice, the more the lower the level; with the level's soft target."""
    level = F.least(F.floor(hs.keyed_uniform(seed, "level", F.col(key)) * 5), F.lit(4)).cast("int")
    rows = docs.withColumn("level", level).withColumn("damage", F.when(F.col("level") == 4, "none").when(hs.keyed_uniform(seed, "damage", F.col(key)) < 0.5, "drop").otherwise("repeat"))
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    hit = lambda w, i: F.pmod(F.xxhash64(F.col(key), w, i), F.lit(20)) < (4 - F.col("level")) * 2
    dropped, doubled = F.filter(words, lambda w, i: ~hit(w, i)), F.flatten(F.transform(words, lambda w, i: F.when(hit(w, i), F.array(w, w)).otherwise(F.array(w))))
    made = F.when(F.col("damage") == "drop", dropped).when(F.col("damage") == "repeat", doubled).otherwise(words)
    return rows.select(key, "level", "damage", F.array_join(made, " ").alias("text"), pr.soft_level(F.col("level")).alias("target"))


def matched_pairs(images: DataFrame, *, key: str, seed: int = 0) -> DataFrame:
    """A flawed and a control row for each image; one pair in ten (by digest) is held out for tests."""
    test = hs.digest_mod10(F.col(key)) == 0
    return images.select(key, test.alias("test"), F.explode(F.array(F.struct(F.lit("flawed").alias("role"), F.lit(1.0).alias("yes")), F.struct(F.lit("control").alias("role"), F.lit(0.0).alias("yes")))).alias("r")).select(F.concat(key, F.lit("#"), F.col("r.role")).alias("uid"), key, "test", F.col("r.role").alias("role"), F.col("r.yes").alias("yes"))


def training_rows(decisions: DataFrame, excluded: DataFrame, teacher: DataFrame | None = None, *, weight: float = 0.3) -> DataFrame:
    """What a training run reads: without audited exclusions and decisions with repeated or blank candidates, split into train and
    dev, and (in train) with targets moved towards a teacher's wherever it answered the same candidates."""
    trimmed = F.transform("candidates", lambda c: F.trim(c))
    ok = ~F.exists(trimmed, lambda c: c == "") & (F.size(F.array_distinct(trimmed)) == F.size(trimmed))
    rows = decisions.join(excluded.select("uid").distinct(), "uid", "left_anti").where(ok).withColumn("dev", hs.in_development(hs.group_key(F.col("image_id"))))
    if teacher is None:
        return rows
    rows = rows.join(teacher.select("uid", F.col("p").alias("_p"), F.col("c").alias("_c")), "uid", "left")
    mixed = F.zip_with("target", "_p", lambda a, b: (1 - weight) * a + weight * b)
    use = F.coalesce(~F.col("dev") & (F.col("_c") == F.col("candidates")) & (F.size("_p") == F.size("target")), F.lit(False))
    return rows.withColumn("target", F.when(use, F.transform(mixed, lambda v: v / pr.total(mixed))).otherwise(F.col("target"))).drop("_p", "_c")
