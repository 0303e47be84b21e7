"""Requests: validation and answers (for the hits of the image cache see ``reuse``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability as pr


def question_problem(kind: Column, text: Column, options: Column) -> Column:
    """Why a question can't be answered, or null: choices have 2 to 255 options, scores 2 to 10 levels."""
    n = F.when(options.isNull(), 0).otherwise(F.size(options))
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "text")
        .when(~F.coalesce(kind.isin("choice", "noul", "score"), F.lit(False)), "kind")
        .when((kind == "choice") & ~n.between(2, 255), "options")
        .when((kind == "score") & ~n.between(2, 10), "levels")
    )


def decodable(data: Column) -> Column:
    """Bytes of base64 text, with or without a data URL's header, or null."""
    return F.try_to_binary(F.when(F.contains(data, F.lit(",")), F.split_part(data, F.lit(","), F.lit(2))).otherwise(data), F.lit("base64"))


def answer(kind: Column, p: Column, keys: Column) -> Column:
    """The most probable option, P(yes), or the expected level; with the largest probability as confidence."""
    return F.struct(
        F.when(kind == "choice", F.get(keys, pr.first_max(p))).alias("choice"),
        F.when(kind == "noul", F.bround(F.get(p, F.lit(0)), 4)).when(kind == "score", F.bround(pr.expected_level(p), 4)).alias("value"),
        F.bround(F.array_max(p), 4).alias("confidence"),
    )


def assembled(answers: DataFrame) -> DataFrame:
    """One row per request, its answers in the order of its questions."""
    return answers.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "answer"))), lambda x: x["answer"]).alias("answers"))


_SCORERS: dict[str, Callable[[pd.DataFrame], list]] = {}


def register_scorer(name: str, logits: Callable[[pd.DataFrame], list]) -> None:
    """``logits(batch of decisions) -> a list of floats per row`` becomes a scorer that ``score`` knows by name."""
    _SCORERS[name] = logits


def score(decisions: DataFrame, name: str) -> DataFrame:
    """Adds ``logits`` with a registered scorer, a batch at a time."""
    scorer = _SCORERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(logits=[[float(v) for v in x] for x in scorer(batch)])

    return decisions.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in decisions.schema) + ", logits array<double>")
