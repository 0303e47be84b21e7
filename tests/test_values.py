"""Queries that SQL can't express, against plain versions over the same rows."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tabulon.operators import resampling as rs
from tabulon.plans import catalogue, curation
from tabulon.sources import fixtures as fx

from . import plain
from .compare import SF


@pytest.fixture(scope="module")
def items(spark):
    return [r.asDict() for r in fx.items(spark, SF).collect()]


def rows(spark, name):
    return [r.asDict(recursive=True) for r in catalogue.PLANS[name](spark, SF).collect()]


def softmax(z, t=1.0):
    e = np.exp((np.array(z) - max(z)) / t)
    return e / e.sum()


def correct(p, y):
    return float(np.argmax(p) == np.argmax(y))


def groups(items, *keys):
    out = {}
    for x in items:
        out.setdefault(tuple(x[k] for k in keys), []).append(x)
    return out


def test_smooth_ece(spark, items):
    found = {r["lang"]: r for r in rows(spark, "smooth_ece")}
    chosen = [x for x in items if len(found) and x["lang"] in found]
    for (lang,), own in groups(chosen, "lang").items():
        for part in (own, [x for x in own if x["split"] == "report"]):
            conf = np.array([softmax(x["logits"]).max() for x in part])
            hit = np.array([correct(x["logits"], x["target"]) for x in part])
            if len(part) == found[lang].get("n", len(part)):
                assert abs(found[lang]["smece"] - plain.smooth_error(conf, hit - conf)) < 1e-5
                break
        else:
            raise AssertionError(lang)


def drawn(spark, items, repeats):
    """The resamples' counts of each source, by lang, as the library draws them (their law is tested apart)."""
    df = spark.createDataFrame([(x["lang"], x["source"]) for x in items], "lang string, source string")
    return {(r.lang, r.source): np.frombuffer(r.counts, np.uint32)[1:].astype(int) for r in rs.resample_counts(df, ["lang"], "source", repeats=repeats).collect()}


def interval(own, lang, value, counts):
    by = groups(own, "source")
    s = sum(sum(map(value, x)) * counts[lang, k[0]] for k, x in by.items())
    n = sum(len(x) * counts[lang, k[0]] for k, x in by.items())
    return (np.mean([value(x) for x in own]), *np.percentile(s / n, [2.5, 97.5]))


def area(score, positive, weight):
    """Of weighted items, by all pairs."""
    p, n = positive, ~positive
    won = (score[p][:, None] > score[n][None, :]) + 0.5 * (score[p][:, None] == score[n][None, :])
    total = weight[p].sum() * weight[n].sum()
    return weight[p] @ won @ weight[n] / total if total else np.nan


def test_bootstrap_ci(spark, items):
    counts = drawn(spark, items, 1000)
    for r in rows(spark, "bootstrap_ci"):
        want = interval([x for x in items if x["lang"] == r["lang"]], r["lang"], lambda x: correct(x["logits"], x["target"]), counts)
        assert np.allclose((r["mean"], r["low"], r["high"]), want)


def test_paired_bootstrap(spark, items):
    other, counts = {r["uid"]: r for r in fx.items(spark, SF, "other").collect()}, drawn(spark, items, 2000)
    for r in rows(spark, "paired_bootstrap"):
        want = interval([x for x in items if x["lang"] == r["lang"]], r["lang"], lambda x: correct(x["logits"], x["target"]) - correct(other[x["uid"]]["logits"], x["target"]), counts)
        assert np.allclose((r["mean"], r["low"], r["high"]), want)


def test_paired_auroc_difference(spark, items):
    other, counts = {r["uid"]: r["gap"] for r in fx.items(spark, SF, "other").collect()}, drawn(spark, items, 500)
    found = rows(spark, "paired_auroc_difference")
    assert len(found) == len({x["lang"] for x in items})
    for r in found:
        own = [x for x in items if x["lang"] == r["lang"]]
        a, b, y = np.array([x["gap"] for x in own]), np.array([other[x["uid"]] for x in own]), np.array([x["quality"] == 1 for x in own])
        w = np.array([counts[r["lang"], x["source"]] for x in own])
        d = np.array([area(a, y, w[:, k]) - area(b, y, w[:, k]) for k in range(500)])
        ones = np.ones(len(own))
        if np.isnan(d).all():
            assert r["low"] is None and (np.isnan(area(a, y, ones)) == (r["difference"] is None))
            continue
        assert np.allclose((r["difference"], r["low"], r["high"]), (area(a, y, ones) - area(b, y, ones), *np.percentile(d[~np.isnan(d)], [2.5, 97.5])))


def test_pair_auroc_interval(spark, items):
    for r in rows(spark, "pair_auroc_interval"):
        pairs = []
        for (_, source), own in sorted(groups([x for x in items if x["lang"] == r["lang"]], "lang", "source").items()):
            good, bad = ([x["gap"] for x in own if x["quality"] == q] for q in (1, 0))
            if good and bad:
                pairs.append((source, max(good), max(bad)))
        counts = drawn(spark, [{"lang": r["lang"], "source": p[0]} for p in pairs], 300)
        score, y = np.array([x for p in pairs for x in p[1:]]), np.array([True, False] * len(pairs))
        w = np.array([counts[r["lang"], p[0]] for p in pairs for _ in range(2)])
        found = [area(score, y, w[:, k]) for k in range(300)]
        assert np.allclose((r["auroc"], r["low"], r["high"]), (area(score, y, np.ones(len(y))), *np.percentile(found, [2.5, 97.5])))


def fitted(own):
    z, y = np.array([x["logits"] for x in own]), np.array([x["target"] for x in own])
    a, b = plain.best_platt(z[:, 0] - z[:, 1], y[:, 0])
    if a < 0:
        a, b = 0.0, math.log(y[:, 0].mean() / (1 - y[:, 0].mean()))
    return plain.best_temperature(z, y), a, b


def test_fit_calibration(spark, items):
    found = {r["lang"]: r for r in rows(spark, "fit_calibration")}
    for (lang,), own in groups([x for x in items if x["split"] == "calib"], "lang").items():
        z, y = np.array([x["logits"] for x in own]), np.array([x["target"] for x in own])
        r = found[lang]
        assert r["n"] == len(own) and plain.nll(z, y, r["temperature"]) <= plain.nll(z, y, plain.best_temperature(z, y)) + 1e-7
        loss = lambda a, b: float(np.mean(np.logaddexp(0, a * (z[:, 0] - z[:, 1]) + b) - y[:, 0] * (a * (z[:, 0] - z[:, 1]) + b)))
        a, b = plain.best_platt(z[:, 0] - z[:, 1], y[:, 0])
        assert loss(r["a"], r["b"]) <= (loss(a, b) if a >= 0 else math.inf) + 1e-7


def test_fit_temperature(spark):
    own = [r for r in fx.ordinal_items(spark, SF).collect()]
    z, y = np.array([x["logits"] for x in own]), np.array([x["target"] for x in own])
    (r,) = rows(spark, "fit_temperature")
    assert r["n"] == len(own) and plain.nll(z, y, r["temperature"]) <= plain.nll(z, y, plain.best_temperature(z, y)) + 1e-7


def test_teacher_calibration(spark, items):
    found = {r["uid"]: r["p"] for r in rows(spark, "teacher_calibration")}
    _, a, b = fitted([x for x in items if x["split"] == "calib"])
    rest = [x for x in items if x["split"] != "calib"]
    assert len(found) == len(rest)
    for x in rest:
        assert abs(found[x["uid"]][0] - 1 / (1 + math.exp(-(a * (x["logits"][0] - x["logits"][1]) + b)))) < 1e-4


def test_run_summary(spark, items):
    t, a, b = fitted([x for x in items if x["split"] == "calib"])
    report = [x for x in items if x["split"] == "report"]
    variants = {"raw": lambda x: softmax(x["logits"]), "temperature": lambda x: softmax(x["logits"], t), "platt": lambda x: softmax([a * (x["logits"][0] - x["logits"][1]) + b, 0.0])}
    found = {r["variant"]: r for r in rows(spark, "run_summary")}
    assert set(found) == set(variants)
    for name, score in variants.items():
        p, y = np.array([score(x) for x in report]), np.array([x["target"] for x in report])
        conf, hit = p.max(axis=1), np.array([correct(*v) for v in zip(p, y, strict=True)])
        r = found[name]
        assert r["n"] == len(report) and abs(r["acc"] - hit.mean()) < 1e-9
        assert abs(r["nll"] + np.log((p * y).sum(axis=1)).mean()) < 1e-4 and abs(r["brier"] - ((p - y) ** 2).sum(axis=1).mean()) < 1e-4
        bins = np.minimum((conf * 15 + 1e-12).astype(int), 14)
        assert abs(r["ece"] - sum(abs((hit - conf)[bins == k].sum()) for k in range(15)) / len(conf)) < 2e-3
        order = sorted(range(len(conf)), key=lambda i: (-conf[i], report[i]["uid"]))
        risk = np.cumsum(1 - hit[order]) / np.arange(1, len(conf) + 1)
        assert abs(r["aurc"] - risk.mean()) < 2e-3 and abs(r["smece"] - plain.smooth_error(conf, hit - conf)) < 1e-3
        good, bad = p[y[:, 0] == 1, 0], p[y[:, 0] != 1, 0]
        assert abs(r["auroc"] - np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good])) < 1e-9
        lead = {x["uid"]: h for x, h in zip(report, hit, strict=True)}
        counts = drawn(spark, [{"lang": name, "source": x["source"]} for x in report], 1000)
        assert np.allclose((r["low"], r["high"]), interval(report, name, lambda x, lead=lead: lead[x["uid"]], counts)[1:])
        own = [x for x in items if x["split"] == "calib"]
        assert abs(r["mean_conf"] - conf.mean()) < 1e-4 and abs(r["calib_nll"] + np.mean([np.log((score(x) * np.array(x["target"])).sum()) for x in own])) < 1e-4


def test_linear_probe(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    number = lambda i, first: int(hashlib.sha1(f"vec:{i}".encode()).hexdigest()[first : first + 8], 16)
    x, y = np.array([r["embedding"] for r in t], float), np.array([float(r["label"] < 5) for r in t])
    test, inner = (np.array([f(r["vec_id"]) for r in t]) for f in (lambda i: number(i, 0) % 10 < 3, lambda i: number(i, 8) % 5 == 0))

    def area(at, fit, c):
        mean, sd = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-9
        z, w = np.c_[(x - mean) / sd, np.ones(len(x))], np.zeros(x.shape[1] + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-(z[fit] @ w)))
            w -= np.linalg.solve((z[fit].T * (p * (1 - p))) @ z[fit] + np.eye(len(w)) / c, z[fit].T @ (p - y[fit]) + w / c)
        s = z @ w
        return float(np.mean([(g > s[at & (y == 0)]).mean() + (g == s[at & (y == 0)]).mean() / 2 for g in s[at & (y == 1)]]))

    best = max((0.01, 0.1, 1.0), key=lambda c: area(~test & inner, ~test & ~inner, c))
    (r,) = rows(spark, "linear_probe")
    assert r["strength"] == best and r["n"] == test.sum() and abs(r["auroc"] - area(test, ~test, best)) < 1e-6


def test_nearest_wording(spark):
    import re

    words = lambda s: re.findall(r"[a-z\-']+", s.lower())
    train = [words(r.question) for r in curation.templated_wordings(spark, SF).collect()]
    for r in rows(spark, "nearest_wording"):
        assert r["distance"] == min(plain.edit_distance(words(r["fresh"]), t) for t in train)


def test_balanced_presence(spark):
    from tabulon.functions import hashing as hs
    from tabulon.operators import builders as bd
    from tabulon.operators import sampling as sm
    from tabulon.plans import builders

    x = builders.presence_images(spark, SF)
    x = x.where((F.size("present") > 0) & (F.size("absent") > 0)).select("image", "absent", sm.pick(F.array_sort("present"), 0, "present", F.col("image")).alias("yes"), hs.keyed_uniform(0, "fold", F.col("image")).alias("o"), F.pmod(F.xxhash64("image"), F.lit(bd.SHARDS)).alias("shard"))
    lead, want = {}, {}
    for r in sorted(x.collect(), key=lambda r: (r.shard, r.o, r.image)):
        own = lead.setdefault(r.shard, Counter())
        no = max(sorted(r.absent), key=lambda c: own[c])
        own[r.yes] += 1
        own[no] -= 1
        want[r.image] = (r.yes, no)
    assert {r["image"]: (r["yes"], r["no"]) for r in rows(spark, "balanced_presence")} == want and want


def test_damaged_texts(spark):
    number = lambda *k: int(hashlib.sha1("|".join(map(str, k)).encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}

    def hit(key, word, i, level):
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)
        h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(word.encode(), h))
        return (h - (h >> 63 << 64)) % 20 < (4 - level) * 2

    for r in rows(spark, "damaged_texts"):
        i = r["doc_id"]
        level = min(int(number(0, "level", i) * 5), 4)
        damage = "none" if level == 4 else "drop" if number(0, "damage", i) < 0.5 else "repeat"
        words = [w for w in __import__("re").split(r"[ \t\n\x0b\f\r]+", texts[i] or "") if w]
        if damage == "drop":
            words = [w for k, w in enumerate(words) if not hit(i, w, k, level)]
        elif damage == "repeat":
            words = [w for k, w in enumerate(words) for _ in range(1 + hit(i, w, k, level))]
        assert (r["level"], r["damage"], r["text"]) == (level, damage, " ".join(words))


def test_eval_exclusion(spark):
    docs = [r for r in curation._text_bits(fx.read(spark, SF, "documents", "doc_id", "text"), "doc_id").collect()]
    items = {r.bits for r in curation._text_bits(fx.read(spark, SF, "benchmark"), "item_id").collect()}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    causes, kept = Counter(), []
    for r in sorted(docs, key=lambda r: r.id):
        if any(near(r.bits, b) for b in items):
            causes["near"] += 1
        elif any(near(r.bits, b) or r.id % 997 == p for b, p in kept):
            causes["twin"] += 1
        else:
            kept.append((r.bits, r.id % 997))
            causes[None] += 1
    assert {r["cause"]: r["n"] for r in rows(spark, "eval_exclusion")} == dict(causes)
