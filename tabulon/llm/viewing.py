"""Incremental maintenance of a view over sales, by heavy and light keys.

The view joins lines, sales, clients and vendors where client and vendor lie in one region, and reports per (region, part): lines, revenue, least
revenue, clients and items.  It is kept as signed counts of (region, part, kind, value), where kind is a line's revenue, an item or a client; all of
these add up, so that a batch of signed rows is answered by

    d(lines (x) sales) = dLines (x) sales_new + lines_old (x) dSales,     d(sales (x) clients) likewise,

and what is not linear (least value, distinct values) is read off the counts.  State is a set of logs to which every step only appends; joins are linear in the
signs, so no row is ever looked up or changed.  A step takes one batch or several: every signed row carries its batch, and a pair of rows belongs to
the later of its two, so that the view is known after each batch of a step.

- A *light* sale's lines, and what is known of the sale, lie in logs bucketed by sale, and a light client's sales in a log bucketed by client: a batch is joined
  with them bucket by bucket, and only the batch is shuffled.
- A *heavy* sale's lines are kept merged in a log of their own, are counted by (region, kind, value) before they are joined, and the join is salted by value.
- A *heavy* client's sales meet the lines without the client; the outcome is counted by (client, region, part, kind, value) in an auxiliary view, so
  that a change of the client costs a lookup in that view instead of a join with all its sales.
- A key is heavy from ``share`` of the rows on, until it falls below half of it.  A sketch of fixed size finds the few cells of keys where one could be,
  and these are counted exactly.  What a key that crosses the threshold has is moved by signed rows: taken from one log, put into the other.

Keys with a null take no part, nor do lines whose amount is null or whose vendor has no region, and sales without a date.  Repeated rows count as often as they
occur.  Counts may pass through negative values; groups whose lines add up to nothing aren't reported.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import prepare

CELLS, SALTS = 4096, 16
REVENUE, ITEM, CLIENT = 0, 1, 2


class Log:
    """An append-only table of signed rows in the shared folder, a partition per step; bucketed by ``key``, if it has one."""

    def __init__(self, spark: SparkSession, folder: str, name: str, columns: str, key: str | None = None, parts: int = 1):
        self.spark, self.key, self.parts = spark, key, parts
        self.name, self.path = f"{name}_{uuid.uuid4().hex}", f"{folder}/{name}"
        self.columns = [c.split()[0] for c in columns.split(", ")]
        self.empty = spark.createDataFrame([], columns)
        self.made = False

    def append(self, step: int, rows: DataFrame) -> None:
        rows = rows.select(*self.columns)
        out = (rows.repartition(self.parts, self.key) if self.key else rows).withColumn("step", F.lit(step)).write.mode("append").format("parquet").option("path", self.path).option("compression", "zstd").partitionBy("step")
        (out.bucketBy(self.parts, self.key) if self.key else out).saveAsTable(self.name)
        self.made = True

    def rows(self, before: int | None = None, at: int | None = None) -> DataFrame:
        if not self.made:
            return self.empty
        df = self.spark.table(self.name)
        df = df if before is None else df.where(F.col("step") < before)
        return (df if at is None else df.where(F.col("step") == at)).select(*self.columns)


class Heavy:
    """Which keys hold more than a share of the signed rows so far."""

    def __init__(self, share: float):
        self.share, self.cells, self.keys = share, np.zeros(CELLS, np.int64), frozenset()

    @staticmethod
    def cell(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")

    def moved(self, key: str, new: DataFrame, old: list[DataFrame]) -> tuple[list[int], list[int]]:
        """Takes the batch's rows (key, m) in, and gives the keys that become heavy and those that become light.  ``old``: what the logs hold of them."""
        for r in new.where(F.col(key).isNotNull()).groupBy(self.cell(F.col(key)).alias("cell")).agg(F.sum("m").alias("m")).collect():
            self.cells[r["cell"]] += r["m"]
        least = max(2.0, self.share * float(self.cells.sum()))
        # At most 2 / share cells can hold so much, and as many keys.
        crowded = np.flatnonzero(self.cells >= least / 2).tolist()
        before, now = self.keys, frozenset()
        if crowded:
            some = [df.select(key, "m").where(F.col(key).isNotNull() & self.cell(F.col(key)).isin(crowded)) for df in [new, *old]]
            every = some[0]
            for df in some[1:]:
                every = every.unionByName(df)
            found = every.groupBy(key).agg(F.sum("m").alias("m")).where(F.col("m") >= least / 2).collect()
            now = frozenset(r[key] for r in found if r["m"] >= (least / 2 if r[key] in before else least))
        self.keys = now
        return sorted(now - before), sorted(before - now)


def _among(key: str, keys) -> Column:
    return F.col(key).isin(sorted(keys)) if keys else F.lit(False)


def _negative(rows: DataFrame) -> DataFrame:
    return rows.withColumn("m", -F.col("m"))


def _added(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("m").alias("m")).where("m <> 0")


def _product(a: str, b: str) -> list[Column]:
    """A pair's batch and count."""
    return [F.greatest(f"{a}.at", f"{b}.at").alias("at"), (F.col(f"{a}.m") * F.col(f"{b}.m")).alias("m")]


def _union(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


class SalesView:
    """The view with its state.  ``vendors`` (vendor_id, nation_id) and ``nation`` (n_nationkey, n_regionkey; as small as the world) don't change."""

    def __init__(self, spark: SparkSession, vendors: DataFrame, nation: DataFrame, *, share: float = 1 / 64):
        sc = prepare(spark).sparkContext
        self.spark, self.step = spark, 0
        folder = f"{sc.getCheckpointDir()}/view-{uuid.uuid4().hex}"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.regions = F.broadcast(nation.where("n_regionkey IS NOT NULL").select(F.col("n_nationkey").alias("nation_id"), F.col("n_regionkey").cast("int").alias("region")))
        self.vendors = vendors.select("vendor_id", "nation_id").join(self.regions, "nation_id").select("vendor_id", "region", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        log = lambda name, columns, key=None: Log(spark, folder, name, columns, key, parts)
        lines, known = "sale_id long, region int, item_id long, revenue long, at int, m long", "sale_id long, region int, part long, client_id long, apart boolean, at int, m long"
        self.lines, self.heavy_lines = log("lines", lines, "sale_id"), log("heavy_lines", lines)
        self.known, self.heavy_known = log("known", known, "sale_id"), log("heavy_known", known)
        self.sales, self.heavy_sales = (log(n, "sale_id long, client_id long, part long, at int, m long", k) for n, k in (("sales", "client_id"), ("heavy_sales", None)))
        self.clients = log("clients", "client_id long, region int, at int, m long", "client_id")
        # client_id is set in rows of the auxiliary view of heavy clients.
        self.counts = log("counts", "client_id long, region int, part long, kind int, value long, at int, m long")
        self.of_clients = log("of_clients", "region int, part long, kind int, value long, at int, m long")
        self.by_sale, self.by_client = Heavy(share), Heavy(share)

    def _lines(self, rows: DataFrame) -> DataFrame:
        """Lines with their vendor's region and their revenue.  A vendor may have a third of all lines: the join is salted."""
        cents = F.floor(100 * F.col("amount") + 0.5) * (100 - F.floor(100 * F.col("discount") + 0.5))
        rows = rows.where("sale_id IS NOT NULL AND amount IS NOT NULL AND vendor_id IS NOT NULL").select("sale_id", "vendor_id", "item_id", cents.cast("long").alias("revenue"), "at", F.col("m").cast("long").alias("m"))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("sale_id", "item_id", "revenue"), F.lit(SALTS)).cast("int"))
        return salted.join(self.vendors.hint("shuffle_hash"), ["vendor_id", "salt"]).select("sale_id", "region", "item_id", "revenue", "at", "m")

    def apply(self, lines: DataFrame, sales: DataFrame, clients: DataFrame) -> None:
        """A step: takes in signed rows of one or more batches (at: the batch's number; m: 1 or -1, or a count): lines (sale_id, vendor_id, item_id, amount,
        discount), sales (sale_id, client_id, sold_at) and clients (client_id, nation_id).  Later steps bring later batches."""
        s = self.step
        sales = sales.where("sale_id IS NOT NULL AND client_id IS NOT NULL AND sold_at IS NOT NULL").select("sale_id", "client_id", F.unix_date(F.to_date("sold_at")).cast("long").alias("part"), "at", F.col("m").cast("long").alias("m"))
        clients = clients.where("client_id IS NOT NULL").join(self.regions, "nation_id").select("client_id", "region", "at", F.col("m").cast("long").alias("m"))
        self._regroup_sales(s, lines)
        self._regroup_clients(s, sales)
        self.clients.append(s, clients)
        self._add_sales(s, sales)
        self._add_lines(s, lines)
        self.counts.append(s, self._pairs(s))
        self._add_heavy_clients(s)
        self.step += 1

    def _regroup_sales(self, s: int, lines: DataFrame) -> None:
        """Decides which sales are heavy from now on; ``self.to_heavy`` and ``self.to_light`` are those that change."""
        self.to_heavy, self.to_light = self.by_sale.moved("sale_id", lines.where("amount IS NOT NULL"), [self.lines.rows(), self.heavy_lines.rows()])

    def _regroup_clients(self, s: int, sales: DataFrame) -> None:
        self.clients_to_heavy, self.clients_to_light = self.by_client.moved("client_id", sales, [self.sales.rows(), self.heavy_sales.rows()])

    def _swapped(self, key: str, new: DataFrame | None, light: DataFrame, heavy: DataFrame, is_heavy: frozenset, up: list, down: list) -> tuple[DataFrame, DataFrame | None]:
        """What the logs of light and of heavy keys have to append: new rows by their key's kind, and the rows of keys that change it."""
        to_light, to_heavy = [new.where(~_among(key, is_heavy))], []
        if is_heavy:
            to_heavy.append(new.where(_among(key, is_heavy)))
        if up:
            rows = light.where(_among(key, up))
            to_light.append(_negative(rows))
            to_heavy.append(rows)
        if down:
            rows = heavy.where(_among(key, down))
            to_light.append(rows)
            to_heavy.append(_negative(rows))
        return _union(*to_light), _union(*to_heavy) if to_heavy else None

    def _add_sales(self, s: int, sales: DataFrame) -> None:
        """Sales by client, and then what is known of a sale, by sale: its part and client, and the client's region unless the client is heavy (``apart``)."""
        light, heavy = self._swapped("client_id", sales, self.sales.rows(before=s), self.heavy_sales.rows(before=s), self.by_client.keys, self.clients_to_heavy, self.clients_to_light)
        self.sales.append(s, light)
        if heavy is not None:
            self.heavy_sales.append(s, _added(heavy, ["sale_id", "client_id", "part", "at"]))
        new = [self._located(self.sales.rows(at=s), self.clients.rows())]
        if s:
            new.append(self._located(self.sales.rows(before=s), self.clients.rows(at=s)))
        if heavy is not None:
            new.append(self.heavy_sales.rows(at=s).select("sale_id", F.lit(None).cast("int").alias("region"), "part", "client_id", F.lit(True).alias("apart"), "at", "m"))
        known = _union(*new)
        light, heavy = self._swapped("sale_id", known, self.known.rows(before=s), self.heavy_known.rows(before=s), self.by_sale.keys, self.to_heavy, self.to_light)
        self.known.append(s, light)
        if heavy is not None:
            self.heavy_known.append(s, _added(heavy, ["sale_id", "region", "part", "client_id", "apart", "at"]))

    @staticmethod
    def _located(sales: DataFrame, clients: DataFrame) -> DataFrame:
        a, b = sales.alias("a"), clients.hint("shuffle_hash").alias("b")
        return a.join(b, F.col("a.client_id") == F.col("b.client_id")).select("sale_id", "region", "part", "a.client_id", F.lit(False).alias("apart"), *_product("a", "b"))

    def _add_lines(self, s: int, lines: DataFrame) -> None:
        light, heavy = self._swapped("sale_id", lines, self.lines.empty, self.lines.empty, self.by_sale.keys, [], [])
        old_light, old_heavy = self._swapped("sale_id", self.lines.empty, self.lines.rows(before=s), self.heavy_lines.rows(before=s), frozenset(), self.to_heavy, self.to_light)
        self.lines.append(s, _union(self._lines(light), old_light) if self.to_heavy or self.to_light else self._lines(light))
        kept = [*([self._lines(heavy)] if heavy is not None else []), *([old_heavy] if old_heavy is not None else [])]
        if kept:
            self.heavy_lines.append(s, _added(_union(*kept), ["sale_id", "region", "item_id", "revenue", "at"]))

    def _pairs(self, s: int) -> DataFrame:
        """What the batch adds to the counts."""
        light = [(self.lines.rows(at=s), self.known.rows())]
        if s:
            light.append((self.lines.rows(before=s), self.known.rows(at=s)))
        pairs = [self._light(a, b) for a, b in light]
        if self.heavy_lines.made and self.heavy_known.made:
            heavy = [(self.heavy_lines.rows(at=s), self.heavy_known.rows()), (self.heavy_lines.rows(before=s), self.heavy_known.rows(at=s))]
            pairs += [x for a, b in heavy for x in self._heavy(a, b)]
        return _added(_union(*pairs), ["client_id", "region", "part", "kind", "value", "at"])

    @staticmethod
    def _of_pair() -> Column:
        entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.col(value).alias("value"))
        return F.array(entry(REVENUE, "revenue"), entry(ITEM, "item_id"), entry(CLIENT, "client"))

    def _light(self, lines: DataFrame, known: DataFrame) -> DataFrame:
        a, b = lines.alias("a"), known.hint("shuffle_hash").alias("b")
        # A heavy client's region isn't asked for yet.
        pairs = a.join(b, F.col("a.sale_id") == F.col("b.sale_id")).where(F.col("apart") | (F.col("a.region") == F.col("b.region")))
        pairs = pairs.select(F.when(F.col("apart"), F.col("client_id")).alias("client_id"), F.col("a.region").alias("region"), "part", "revenue", "item_id", F.col("client_id").alias("client"), *_product("a", "b"))
        return pairs.select("client_id", "region", "part", F.explode(self._of_pair()).alias("e"), "at", "m").select("client_id", "region", "part", "e.kind", "e.value", "at", "m")

    def _heavy(self, lines: DataFrame, known: DataFrame) -> list[DataFrame]:
        """Both sides are counted first: lines by value for each way a sale is known, and clients for the number of lines."""
        whose = F.when(F.col("apart"), F.col("client_id"))
        entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.col(value).alias("value"))
        values = _added(lines.select("sale_id", F.col("region").alias("where"), F.explode(F.array(entry(REVENUE, "revenue"), entry(ITEM, "item_id"))).alias("e"), "at", "m").select("sale_id", "where", "e.kind", "e.value", "at", "m"), ["sale_id", "where", "kind", "value", "at"])
        ways = _added(known.select("sale_id", "region", "part", whose.alias("client_id"), "at", "m"), ["sale_id", "region", "part", "client_id", "at"])
        number = _added(lines.select("sale_id", F.col("region").alias("where"), "at", "m"), ["sale_id", "where", "at"])
        names = _added(known.select("sale_id", "region", "part", whose.alias("client_id"), F.col("client_id").alias("value"), "at", "m"), ["sale_id", "region", "part", "client_id", "value", "at"]).withColumn("kind", F.lit(CLIENT))
        return [self._salted(values, ways), self._salted(names, number)]

    @staticmethod
    def _salted(many: DataFrame, few: DataFrame) -> DataFrame:
        a = many.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")).alias("a")
        b = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge").alias("b")
        joined = a.join(b, (F.col("a.sale_id") == F.col("b.sale_id")) & (F.col("a.salt") == F.col("b.salt")))
        return joined.where(F.col("region").isNull() | (F.col("region") == F.col("where"))).select("client_id", F.col("where").alias("region"), "part", "kind", "value", *_product("a", "b"))

    def _add_heavy_clients(self, s: int) -> None:
        """The auxiliary view's share in the view.  It has the clients that are or were heavy, and a row or a few for each of them is all that is joined."""
        ever = self.by_client.keys | set(self.clients_to_light)
        if not ever or not self.heavy_sales.made:
            return
        rows = lambda **which: self.counts.rows(**which).where(_among("client_id", ever)).alias("a")
        few = lambda **which: F.broadcast(_added(self.clients.rows(**which).where(_among("client_id", ever)), ["client_id", "region", "at"])).alias("b")
        meet = lambda a, b: a.join(b, (F.col("a.client_id") == F.col("b.client_id")) & (F.col("a.region") == F.col("b.region"))).select("a.region", "part", "kind", "value", *_product("a", "b"))
        joined = [meet(rows(at=s), few())] + ([meet(rows(before=s), few(at=s))] if s else [])
        self.of_clients.append(s, _added(_union(*joined), ["region", "part", "kind", "value", "at"]))

    def report(self, batches: list[int]) -> DataFrame:
        """The view after each of the batches: batch, region, part, n_lines, revenue, min_revenue, n_clients, n_items."""
        logs = [log for log in (self.counts, self.of_clients) if log.made]
        rows = _union(*[self.spark.table(log.name).where(F.col("client_id").isNull() if "client_id" in log.columns else F.lit(True)).select("region", "part", "kind", "value", "at", "m") for log in logs])
        until = [F.sum(F.when(F.col("at") <= b, F.col("m")).otherwise(F.lit(0))).alias(f"_{i}") for i, b in enumerate(batches)]
        values = rows.groupBy("region", "part", "kind", "value").agg(*until)
        each = F.array(*[F.struct(F.lit(b).alias("batch"), F.col(f"_{i}").alias("n")) for i, b in enumerate(batches)])
        held = values.select("region", "part", "kind", "value", F.explode(each).alias("e")).where("e.n > 0").select("e.batch", "region", "part", "kind", "value", "e.n")
        line = F.col("kind") == REVENUE
        known = F.col("value").isNotNull()
        out = held.groupBy("batch", "region", "part").agg(
            F.sum(F.when(line, F.col("n"))).alias("n_lines"),
            F.sum(F.when(line, F.col("n") * F.col("value"))).alias("revenue"),
            F.min(F.when(line, F.col("value"))).alias("min_revenue"),
            F.count_if((F.col("kind") == CLIENT) & known).alias("n_clients"),
            F.count_if((F.col("kind") == ITEM) & known).alias("n_items"),
        )
        return out.where("n_lines > 0")


def changes(rows: DataFrame, key: Column, period: int) -> DataFrame:
    """Signed rows (at, m): each comes and goes in the batches that the crc32 of its key says, or is there from the start, before batch 0."""
    h = F.crc32(key.cast("binary"))
    a, d = (h % period).cast("int"), (F.floor(h / period) % period).cast("int")
    entry = lambda at, m: F.struct(at.alias("at"), F.lit(m).alias("m"))
    lived = rows.withColumns({"_a": a, "_d": d})
    return lived.withColumn("_e", F.explode(F.when(F.col("_a") < F.col("_d"), F.array(entry(F.col("_a"), 1), entry(F.col("_d"), -1))).otherwise(F.array(entry(F.lit(-1), 1))))).select(*rows.columns, "_e.at", "_e.m")


def maintained(spark: SparkSession, lines: DataFrame, sales: DataFrame, clients: DataFrame, vendors: DataFrame, nation: DataFrame, *, period: int = 7, batches: int = 4, share: float = 1 / 64) -> DataFrame:
    """The view after each of ``period`` batches, in which rows come and go by the crc32 of their keys; a step takes ``batches`` of them.  The first step
    loads what is there from the start.  Signed rows are written once, by step, as a source of changes would hand them over."""
    feed = f"{prepare(spark).sparkContext.getCheckpointDir()}/changes-{uuid.uuid4().hex}"
    text = lambda c: F.col(c).cast("string")
    tables = {
        "lines": changes(lines.select("sale_id", "line_no", "vendor_id", "item_id", "amount", "discount"), F.concat(F.lit("l"), text("sale_id"), F.lit(":"), text("line_no")), period).drop("line_no"),
        "sales": changes(sales.select("sale_id", "client_id", "sold_at"), F.concat(F.lit("s"), text("sale_id")), period),
        "clients": changes(clients.select("client_id", "nation_id"), F.concat(F.lit("c"), text("client_id")), period),
    }
    written = []
    for name, rows in tables.items():
        rows.withColumn("step", F.floor((F.col("at") + batches) / batches).cast("int")).write.partitionBy("step").parquet(f"{feed}/{name}")
        written.append(spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, step int").parquet(f"{feed}/{name}"))
    view = SalesView(spark, vendors, nation, share=share)
    for step in range(1 + -(-period // batches)):
        view.apply(*[df.where(F.col("step") == step).drop("step") for df in written])
    return view.report(list(range(period)))
