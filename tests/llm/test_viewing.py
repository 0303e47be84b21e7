import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from tabulon.llm import viewing

NATION = [(i, i % 3) for i in range(6)] + [(6, None)]
VENDORS = [(i, i % 7) for i in range(9)] + [(9, None), (None, 1), (3, 4)]


def cents(amount, discount):
    return None if discount is None else math.floor(100 * amount + 0.5) * (100 - math.floor(100 * discount + 0.5))


def plain(lines, sales, clients):
    """The view of what is there: Counters of rows."""
    region = dict(NATION)
    out = defaultdict(list)
    for (sale, vendor, item, amount, discount), n in lines.items():
        for (sid, client, at), m in sales.items():
            if None in (sale, amount, client, at) or sid != sale:
                continue
            for (cid, nation), k in clients.items():
                for v, vn in VENDORS:
                    if cid == client and v == vendor and v is not None and region.get(nation) is not None and region.get(nation) == region.get(vn):
                        out[region[nation], (at - datetime(1970, 1, 1)).days] += [(cents(amount, discount), client, item)] * (n * m * k)
    rows = []
    for (r, p), found in out.items():
        money = [x[0] for x in found if x[0] is not None]
        if found:
            rows.append((r, p, len(found), sum(money) if money else None, min(money, default=None), len({x[1] for x in found}), len({x[2] for x in found} - {None})))
    return rows


def frames(spark, step):
    """Signed rows of a step's batches, {batch: its three tables}."""
    types = ("sale_id long, vendor_id long, item_id long, amount double, discount double", "sale_id long, client_id long, sold_at timestamp_ntz", "client_id long, nation_id int")
    return [spark.createDataFrame([(*k, b, m) for b, tables in step.items() for k, m in tables[i].items() if m], t + ", at int, m int") for i, t in enumerate(types)]


def changes(seed, batches):
    """Signed rows of each batch, and the rows that are then there; the crowd moves from key to key."""
    r = random.Random(seed)
    there = [Counter(), Counter(), Counter()]
    for b in range(batches):
        signed = [Counter(), Counter(), Counter()]
        for _ in range(90):
            crowd = r.random() < (0.6 if b % 2 == 0 else 0.1)
            sale = None if r.random() < 0.05 else b // 2 if crowd else r.randrange(12)
            signed[0][sale, r.choice([*range(10), None]), r.choice([1, 2, 3, None]), r.choice([1.005, 2.0, 7.25, None]), r.choice([0.0, 0.05, None])] += r.choice([1, 1, 2])
        for _ in range(12):
            signed[1][r.choice([*range(12), None]), r.choice([b // 2] * 4 + [*range(8), None]), r.choice([datetime(2024, 1, 1) + timedelta(hours=30 * r.randrange(3)), None, datetime(1969, 12, 31, 23)])] += 1
        for _ in range(8):
            signed[2][r.choice([*range(8), None]), r.choice([*range(7), None, 99])] += 1
        for now, new in zip(there, signed, strict=True):
            for k in sorted(now, key=str):
                if now[k] and r.random() < (0.6 if k[0] == b // 2 - 1 else 0.3):
                    new[k] -= now[k]
            for k, m in new.items():
                now[k] += m
        yield signed, [Counter({k: m for k, m in now.items() if m}) for now in there]


@pytest.mark.parametrize(("share", "steps"), [(0.15, [[0], [1], [2], [3], [4]]), (0.15, [[0, 1], [2, 3], [4]]), (2.0, [[0, 1, 2], [3, 4]])])
def test_each_batch_equals_the_view_of_what_is_there(spark, share, steps):
    nation = spark.createDataFrame(NATION, "n_nationkey int, n_regionkey int")
    view = viewing.SalesView(spark, spark.createDataFrame(VENDORS, "vendor_id long, nation_id int"), nation, share=share)
    all_changes = dict(enumerate(changes(5, 5)))
    want, crossed = {b: plain(*there) for b, (_, there) in all_changes.items()}, Counter()
    for step in steps:
        view.apply(*frames(spark, {b: all_changes[b][0] for b in step}))
        crossed.update(up=len(view.to_heavy), down=len(view.to_light), client_up=len(view.clients_to_heavy), client_down=len(view.clients_to_light))
    got = defaultdict(list)
    for r in view.report(range(5)).collect():
        got[r.batch].append((r.region, r.part, r.n_lines, r.revenue, r.min_revenue, r.n_clients, r.n_items))
    for b, rows in want.items():
        assert sorted(got[b], key=str) == sorted(rows, key=str), b
    assert sum(map(len, want.values())) > 20
    # Keys of both kinds crossed the threshold (in both directions, if batches come one by one), or none did.
    assert (all(crossed.values()) if len(steps) == 5 else crossed["up"] and crossed["client_up"]) if share < 1 else not any(crossed.values()), crossed


def test_empty(spark):
    nation = spark.createDataFrame([], "n_nationkey int, n_regionkey int")
    view = viewing.SalesView(spark, spark.createDataFrame([], "vendor_id long, nation_id int"), nation)
    for b in range(2):
        view.apply(*frames(spark, {b: [{}, {}, {}]}))
    assert view.report([0, 1]).collect() == []
