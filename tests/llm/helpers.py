"""Small tables with every awkward case, and plain versions of the operators to hold results against."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, key string, values string"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def texts(n=60, seed=0, words=400):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(words)] + ["É", "日本", "don't", "A1", "x" * 90]
    made = [None, "", " \t\n\x0b", "one", "One", "ONE two", "%%% !!!", "two  words\n"]
    passage = " ".join(r.choices(vocabulary, k=40))
    while len(made) < n:
        kind = r.random()
        if kind < 0.4 or len(made) < 14:
            made.append(" ".join(r.choices(vocabulary, k=r.randint(1, 90))))
        elif kind < 0.55:
            made.append(r.choice(made))
        elif kind < 0.8:
            own = spaced(r.choice(made)) or ["a"]
            for _ in range(r.randint(1, 2)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            made.append("\n ".join(own).upper() if r.random() < 0.3 else " ".join(own))
        else:
            made.append(" ".join(r.choices(vocabulary, k=10)) + "\t" + passage + " " + " ".join(r.choices(vocabulary, k=r.randint(0, 30))))
    made.append(" ".join(r.choices(vocabulary, k=6000)))
    return made


def table(spark, rows, parts=3):
    """(doc_id, text) rows with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z") for i, t in rows], DOCS).repartition(parts)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
