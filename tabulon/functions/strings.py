"""Question and identifier text."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name people, the form of an "is there" question, and answers that mean the same.
PEOPLE = ["man", "men", "woman", "women", "boy", "boys", "girl", "girls", "child", "children", "kid", "kids", "person", "people", "guy", "guys", "lady", "ladies", "player", "players", "baby", "adult", "adults", "someone", "anyone", "he", "she"]
IS_THERE = r"(?is)^(is|are) there (a |an |any )?(.*?)( in (the|this) (image|picture|photo))?\??$"
SAME = [("gray", "grey"), ("black", "dark"), ("man", "guy"), ("woman", "lady"), ("men", "people"), ("man", "person"), ("woman", "person"), ("tv", "television"), ("cellphone", "phone"), ("shirt", "t-shirt")]

_ARTICLES = ("the", "a", "an")


def article(noun: Column) -> Column:
    return F.when(F.substring(noun, 1, 1).isin(*"aeiou"), "an").otherwise("a")


def photo_id(url: Column) -> Column:
    """The photo's id: before the first `_` of a file name, or else the last part of the path."""
    last = F.element_at(F.filter(F.split(url, "/"), lambda p: p != ""), -1)
    return F.when(F.contains(last, F.lit(".")), F.split_part(last, F.lit("_"), F.lit(1))).otherwise(last)


def names_people(question: Column, people: Iterable[str] = PEOPLE) -> Column:
    # A dotted capital I becomes a plain i, as in SQL, not an i and a combining dot that ends the word.
    return F.arrays_overlap(F.regexp_extract_all(F.lower(F.translate(question, "\u0130", "i")), F.lit(r"(\w+)"), F.lit(1)), F.array(*map(F.lit, people)))


def asked_object(question: Column) -> Column:
    """What an "is there" question asks for, on however many lines (empty, if it names nothing), else null."""
    return F.when(F.rlike(question, F.lit(IS_THERE)), F.regexp_extract(question, IS_THERE, 3))


def _from_noun(words: Column) -> Column:
    """Words without the articles before them."""
    skip = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, w: F.struct((s["n"] + F.when(s["on"] & w.isin(*_ARTICLES), 1).otherwise(0)).alias("n"), (s["on"] & w.isin(*_ARTICLES)).alias("on")), lambda s: s["n"])
    return F.slice(words, skip + 1, F.greatest(F.size(words), F.lit(1)))


def named_alternative(question: Column, answer: Column, known: Column | None = None) -> Column:
    """The other option of an "X or Y?" question whose answer is one of the two, else null; with ``known`` (an array) only
    an alternative that is one of these.

    The question's words are cut at the last "or".  The answer's words end the left side, then the right side is the
    alternative; or they begin the right side, then it is as many words at the end of the left one.
    """
    words = F.split(F.lower(F.regexp_replace(question, r"\?+$", "")), " ")
    place = F.size(words) - F.array_position(F.reverse(words), "or").cast("int") + 1
    left, right = F.slice(words, F.lit(1), F.greatest(place - 1, F.lit(0))), _from_noun(F.slice(words, F.least(place + 1, F.size(words) + 1), F.size(words)))
    own = F.split(answer, " ")
    n = F.size(own)
    tail = F.slice(left, F.greatest(F.size(left) - n + 1, F.lit(1)), n)
    other = F.when((F.size(left) > n) & (tail == own), right).when(F.slice(right, F.lit(1), n) == own, _from_noun(tail))
    text = F.nullif(F.trim(F.array_join(other, " ")), F.lit(""))
    found = F.when(F.array_contains(words, "or") & (place > 1), text)
    return found if known is None else F.when(F.array_contains(known, found), found)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z\-']+)"), F.lit(1))


def singular(noun: Column) -> Column:
    """Without any trailing s, to recognise plurals."""
    return F.regexp_replace(noun, "s+$", "")


def clashes(answer: Column, gold: Column) -> Column:
    """Is an answer no fit distractor of the gold one: the same, its plural or singular, or listed as the same thing?"""
    a, g = F.lower(F.trim(answer)), F.lower(F.trim(gold))
    listed = F.lit(False)
    for x, y in SAME:
        listed = listed | ((a == x) & (g == y)) | ((a == y) & (g == x))
    return (a == g) | (singular(a) == singular(g)) | listed


def candidate_text(key: Column, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat_ws(": ", key, value)).otherwise(key)


def with_state(state: Column, question: Column) -> Column:
    """The question after the state's text, on a line of its own; no state, no line."""
    s = F.trim(F.coalesce(state, F.lit("")))
    return F.when(s == "", question).otherwise(F.concat(s, F.lit("\n"), question))


def json_text(**fields: Column) -> Column:
    """A JSON object with a space after each colon and comma, keys in the order given."""
    value = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))
    parts = [F.concat(F.lit(f'"{k}": '), F.when(c.isNull(), F.lit("null")).otherwise(value(c))) for k, c in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def board_rows(width: int, height: int, head: Column, food: Column, body: Column) -> Column:
    """A board as lines of text, top row first: H the head, F food, o the body, . nothing.  Places are structs of x and y, whole
    numbers."""
    cell = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    at = lambda c: cell(c["x"], c["y"])
    mark = lambda p: F.when(p == at(head), "H").when(p == at(food), "F").when(F.exists(body, lambda b: at(b) == p), "o").otherwise(".")
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: mark(cell(x, y))), ""))
    return F.array_join(rows, "\n")


def first_listed(text: Column, names: list[str], other: str = "other") -> Column:
    """The first name of the list that occurs in the text."""
    out = F.lit(other)
    for name in reversed(names):
        out = F.when(F.contains(text, F.lit(name)), name).otherwise(out)
    return out


def edit_distances(left: list, right: list) -> np.ndarray:
    """Edit distances of pairs of word lists, all pairs at once.

    Words become numbers in two padded matrices.  One step takes the next left word of every pair: substitutions and
    deletions are element-wise, and a run of insertions is a running minimum of costs that fall by one per place.
    """
    names = {w: i + 1 for i, w in enumerate({w for words in (*left, *right) for w in words})}
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    matrix = lambda rows, width, pad: np.array([[names[w] for w in x] + [pad] * (width - len(x)) for x in rows], np.int64).reshape(len(rows), width)
    a, b = matrix(left, int(n.max(initial=0)), 0), matrix(right, int(m.max(initial=0)), -1)
    place = np.arange(b.shape[1] + 1)
    row = np.tile(place, (len(left), 1))
    out = m.copy()
    for i in range(a.shape[1]):
        best = row + 1
        best[:, 1:] = np.minimum(best[:, 1:], row[:, :-1] + (a[:, i, None] != b))
        row = np.minimum.accumulate(best - place, axis=1) + place
        done = n == i + 1
        out[done] = row[done, m[done]]
    return out


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    some = a.notna() & b.notna()
    out = pd.Series(np.nan, index=a.index, dtype="Int32")
    if some.any():
        out[some] = edit_distances([list(x) for x in a[some]], [list(x) for x in b[some]])
    return out


def word_edit_distance(a: Column, b: Column) -> Column:
    """Edit distance in words (the built-in function counts characters), a batch at a time; null if either is."""
    return F.pandas_udf(_distances, "int")(a, b)


_LETTERS = "ABCDEF"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _tidy(option: Column) -> Column:
    return _stripped(F.regexp_replace(_stripped(option), ",+$", ""))


def parse_options(text: Column) -> Column:
    """Stem and options of a multiple-choice question in one of two layouts; null where it has neither.

    Inline: "stem Options: A: x, B: y"; an option begins at the start, after a comma or on a new line, and only with the
    letter that is next.  Block: "Question: stem", "Choices:" and a line "(A) x" for each option, all in order.

    Inline text is split before everything that looks like an option's head; a fold then takes each piece as a new option
    if its letter is the next one, and otherwise gives it back to the option before.
    """
    tail = _stripped(F.element_at(F.split(text, "Options:"), -1))
    cut = F.split(F.regexp_replace(tail, r"(^|,\s*|\n\s*)([A-F])([:.]\s)", "\u0001$1\u0002$2\u0003$3\u0004"), "\u0001")
    pieces = F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1)))

    def add(found: Column, piece: Column) -> Column:
        letter = F.regexp_extract(piece, "\u0002(.)\u0003", 1)
        fits = letter == F.substring(F.lit(_LETTERS), F.size(found) + 1, F.lit(1))
        own = F.regexp_extract(piece, "(?s)\u0004(.*)$", 1)
        back = F.concat(F.element_at(found, -1), F.regexp_replace(piece, "[\u0002\u0003\u0004]", ""))
        return F.when(fits & (F.size(found) < len(_LETTERS)), F.array_append(found, own)).when(F.size(found) > 0, F.array_append(F.slice(found, F.lit(1), F.size(found) - 1), back)).otherwise(found)

    inline = F.transform(F.aggregate(pieces, F.array().cast("array<string>"), add), lambda o: _tidy(o))
    before = _stripped(F.regexp_extract(text, r"(?s)^(.*)Options:", 1))
    head, body = F.split_part(text, F.lit("\nChoices:"), F.lit(1)), F.regexp_extract(text, r"(?s)^.*?\nChoices:(.*)$", 1)
    line = r"(?m)^\(([A-F])\)[^\S\n]*(.*)$"
    letters, options = (F.regexp_extract_all(body, F.lit(line), F.lit(i)) for i in (1, 2))
    in_order = F.array_join(letters, "") == F.substring(F.lit(_LETTERS), F.lit(1), F.size(letters))
    stem = _stripped(F.when(F.contains(head, F.lit("Question:")), F.regexp_extract(head, r"(?s)^.*?Question:(.*)$", 1)).otherwise(head))
    block = F.when(in_order & (F.size(letters) > 1), F.struct(stem.alias("stem"), F.transform(options, lambda o: _stripped(o)).alias("options")))
    flat = F.when(F.contains(text, F.lit("Options:")) & (F.size(inline) > 1), F.struct(before.alias("stem"), inline.alias("options")))
    return F.when(F.contains(text, F.lit("\nChoices:")), block).otherwise(flat)
