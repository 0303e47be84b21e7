"""Packing of questions that share an image into bounded sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import last_not_beyond, overlaps
from .ranking import running

MAX_LENGTH, MAX_QUESTIONS = 320, 4
QUESTION_TOKENS, CANDIDATE_TOKENS = 128, 63


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def encoded_length(question: Column, candidates: Column) -> Column:
    """[CLS] and the question's tokens, then each candidate's tokens and its end."""
    own = F.least(F.size(words(question)), F.lit(QUESTION_TOKENS)) + 1
    return own + F.aggregate(candidates, F.lit(0), lambda a, c: a + F.least(F.size(words(c)), F.lit(CANDIDATE_TOKENS)) + 1)


def encoded(question: Column, candidates: Column) -> Column:
    """ids (words as tokens), pos and cand of a question with its candidates: a start, the question, then each candidate with its end.
    All candidates begin at the place after the question; cand is -1 in the question."""
    own = F.concat(F.array(F.lit("CLS")), F.slice(words(question), 1, QUESTION_TOKENS))
    parts = F.transform(candidates, lambda c: F.concat(F.slice(words(c), 1, CANDIDATE_TOKENS), F.array(F.lit("SEP"))))
    places = lambda a, first: F.transform(a, lambda x, i: i + first)
    return F.struct(
        F.concat(own, F.flatten(parts)).alias("ids"),
        F.concat(places(own, F.lit(0)), F.flatten(F.transform(parts, lambda p: places(p, F.size(own))))).alias("pos"),
        F.concat(F.transform(own, lambda x: F.lit(-1)), F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda x: k)))).alias("cand"),
    )


#: Up to so many questions of an image are folded in one go.
FOLDED = 4096


def pack(questions: DataFrame, *, max_length: int = MAX_LENGTH, max_questions: int = MAX_QUESTIONS, folded: int = FOLDED) -> DataFrame:
    """image, ord, length -> also seq (sequence number within the image) and offset.

    A sequence ends before a question that would exceed either limit; a question alone is always taken.  Images of up to ``folded`` questions are folded
    in one go; of larger ones the sequences are found by pointers, with the same result, and no list of an image's questions.  Orders of an image differ.
    """
    rows = questions.select("image", F.col("ord").cast("bigint"), F.col("length").cast("int"))
    large = rows.groupBy("image").agg(F.count("*").alias("_n")).where(F.col("_n") > folded).select(F.struct("image").alias("_image"))
    own = F.struct("image") == F.col("_image")
    if large.isEmpty():
        return _folded(rows, max_length, max_questions)
    return _folded(rows.join(large, own, "left_anti"), max_length, max_questions).unionByName(_linked(rows.join(large, own, "left_semi"), max_length, max_questions))


def _linked(rows: DataFrame, max_length: int, max_questions: int) -> DataFrame:
    """Packing by pointers.  Each question knows, from the running sum of lengths, where a sequence that began with it would end; the sequences of an image are
    those that are reached from its first question, and pointers of 1, 2, 4, ... steps reach them all, with their numbers, in a logarithmic number of joins."""
    # A null image is one like any other: a struct of it can be joined.
    items = rows.withColumn("image", F.struct("image"))
    placed = running(items, ["image"], ["ord"], {"i": F.lit(1).cast("long"), "at": F.col("length").cast("long")}).checkpoint()
    ends = placed.groupBy("image").agg((F.max("i") + 1).alias("i"), F.sum("length").cast("long").alias("at"))
    # The last place whose running sum is within the limit (of equal sums, as empty questions have, the last).
    sums = placed.select("image", "i", "at").unionByName(ends).groupBy("image", "at").agg(F.max("i").alias("last")).withColumnRenamed("at", "start")
    reach = last_not_beyond(placed.select("image", "i", (F.col("at") + max_length).alias("at")), sums.select("image", "start"), ["image"]).select("image", "i", "start")
    after = reach.join(sums, ["image", "start"]).select("image", "i", F.greatest(F.col("i") + 1, F.least("last", F.col("i") + max_questions)).alias("to")).checkpoint()
    steps = [after.join(placed.select("image", F.col("i").alias("to")), ["image", "to"], "left_semi").select("image", "i", "to").checkpoint()]
    while not steps[-1].isEmpty():
        a, b = steps[-1].alias("a"), steps[-1].alias("b")
        steps.append(a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.to") == F.col("b.i"))).select("a.image", "a.i", "b.to").checkpoint())
    begun = placed.select("image").distinct().select("image", F.lit(0).cast("long").alias("i"), F.lit(0).alias("seq"))
    for k in reversed(range(len(steps) - 1)):
        further = begun.join(steps[k], ["image", "i"]).select("image", F.col("to").alias("i"), (F.col("seq") + 2**k).alias("seq"))
        begun = begun.unionByName(further).checkpoint()
    held = begun.join(after, ["image", "i"]).join(placed.select("image", "i", F.col("at").alias("_from")), ["image", "i"]).select("image", F.col("i").alias("low"), F.col("to").alias("high"), "seq", "_from")
    found = overlaps(placed.withColumns({"start": F.col("i"), "stop": F.col("i") + 1}), held, ["image"])
    return found.select("image.image", "ord", "length", "seq", (F.col("at") - F.col("_from")).cast("int").alias("offset"))


def _folded(rows: DataFrame, max_length: int, max_questions: int) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("ord", "length")))
    start = F.struct(F.lit(0).alias("seq"), F.lit(0).alias("used"), F.lit(0).alias("n"), F.array().cast("array<struct<ord:bigint,length:int,seq:int,offset:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        over = (a["n"] > 0) & ((a["used"] + x["length"] > max_length) | (a["n"] >= max_questions))
        seq, used, n = F.when(over, a["seq"] + 1).otherwise(a["seq"]), F.when(over, 0).otherwise(a["used"]), F.when(over, 0).otherwise(a["n"])
        row = F.struct(x["ord"].alias("ord"), x["length"].alias("length"), seq.alias("seq"), used.alias("offset"))
        return F.struct(seq.alias("seq"), (used + x["length"]).alias("used"), (n + 1).alias("n"), F.concat(a["out"], F.array(row)).alias("out"))

    packed = rows.groupBy("image").agg(F.aggregate(items, start, step, lambda a: a["out"]).alias("p"))
    return packed.select("image", F.explode("p").alias("x")).select("image", "x.ord", "x.length", "x.seq", "x.offset")


def visible(tokens: DataFrame) -> DataFrame:
    """Pairs of tokens of a sequence (seq, pos, block, cand) in which the first may look at the second: block 0 is the image,
    -1 padding, which sees only itself; cand is -1 for a question's own tokens, and candidates don't see each other."""
    a, b = tokens.alias("a"), tokens.alias("b")
    image = (F.col("b.block") == 0) & (F.col("a.block") >= 0)
    same = (F.col("a.block") > 0) & (F.col("a.block") == F.col("b.block")) & ((F.col("a.cand") < 0) | (F.col("b.cand") < 0) | (F.col("a.cand") == F.col("b.cand")))
    see = image | same | (F.col("a.pos") == F.col("b.pos"))
    return a.join(b, F.col("a.seq") == F.col("b.seq")).where(see).select(F.col("a.seq").alias("seq"), F.col("a.pos").alias("pos"), F.col("b.pos").alias("sees"))


def padded_batch(sequences: DataFrame, pad: int = 0, *, batch: str = "batch", seq: str = "seq") -> DataFrame:
    """batch, seq, ids, pos, block, cand (arrays) -> the same, filled up to the longest sequence of the batch: ids with ``pad``, places with 0,
    blocks and candidates with -1."""
    longest = sequences.groupBy(batch).agg(F.max(F.size("ids")).alias("_t"))
    fill = {"ids": pad, "pos": 0, "block": -1, "cand": -1}
    out = sequences.join(longest, batch)
    for name, value in fill.items():
        out = out.withColumn(name, F.concat(F.col(name), F.array_repeat(F.lit(value).cast("int"), F.col("_t") - F.size(name))))
    return out.drop("_t")


def seen_by_block(tokens: DataFrame) -> DataFrame:
    """How many tokens each (seq, block, cand) looks at in all: what counting the pairs of ``visible`` gives, from the sizes of the
    groups.  Candidates of a question see the image, the question's own tokens and themselves."""
    groups = tokens.groupBy("seq", "block", "cand").agg(F.count("*").alias("n"))
    sizes = groups.groupBy("seq").agg(F.sum(F.when(F.col("block") == 0, F.col("n")).otherwise(0)).alias("image"))
    blocks = groups.where("block > 0").groupBy("seq", "block").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("cand") < 0, F.col("n")).otherwise(0)).alias("own"))
    rows = groups.join(sizes, "seq").join(blocks, ["seq", "block"], "left")
    # An image token sees the image; padding itself; a question token the image and its block; a candidate the image, the question and its like.
    each = F.when(F.col("block") < 0, F.lit(1)).when(F.col("block") == 0, F.col("image")).when(F.col("cand") < 0, F.col("image") + F.col("all")).otherwise(F.col("image") + F.col("own") + F.col("n"))
    return rows.select("seq", "block", "cand", (F.col("n") * each).alias("sees"))


def within_window(distance: Column, window: int) -> Column:
    """Local layers look at most half a window far."""
    return F.abs(distance) <= window // 2


def seen_in_window(length: Column, window: int) -> Column:
    """How many tokens the tokens of a block of so many in a row see in all: what counting the pairs ``within_window`` gives, from the
    length.  Each sees itself, and at each distance within reach that the block is longer than, the length less that distance look either way."""
    n, reach = length.cast("long"), F.greatest(F.least(length - 1, F.lit(window // 2)), F.lit(0)).cast("long")
    return n + reach * (2 * n - reach - 1)


def used_tokens(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Tokens that count as input: all but padding."""
    return tokens.groupBy(*by).agg(F.count_if(F.col("block") >= 0).alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
