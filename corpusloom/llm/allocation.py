"""Problem 1: a sample whose cells follow target shares, with floors, by min-cost flow on cell counts.

Counts of the cross-classified cells are aggregated in Spark; the flow runs on the driver over the target
cells.  One network carries the margins of both categories, floors and targets of the cells, their
availability and slack.  Units run from a row's margin either through a cell's need (its floor, then its
target, the last unit of a fractional target at a random price) or past it, at a higher price; both end in
the cell's stock, an arc as wide as what is available, on the way to the column's margin.  A slack arc
leads from each need around the stock.  Sending all needs shows in the slack arcs what each cell lacks; with
the slack arcs shut, sending the sample's size gives the quotas, drawn by the random prices.  Rows are then
taken by a seeded hash: whole hash buckets below each cell's quota and a ranking only inside the bucket the
quota ends in, so no task holds a cell.

Defined cases: rows with a null key are no rows; null, empty or unknown categories belong to no cell; of
several deliveries of a key the latest counts, ties by the greatest values; target rows that are equal
after folding are one cell with their shares and floors added, under the first spelling; an empty target
table gives empty results; an empty pool leaves every cell short of what it needs.
"""

from __future__ import annotations

import heapq
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets at least, and rows of the largest cell in each; the bucket a quota ends in is sorted.
BUCKETS, BUCKET_ROWS = 4_096, 20_000
#: Everything that folding drops: blanks of all kinds, hyphens, dashes, underscores, invisible characters.
FOLDED_AWAY = r"[\s\u0085 ­  -―    ⁠−　﻿_-]+"


def fold(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), FOLDED_AWAY, "")


class Flow:
    """Successive cheapest paths on a small network with convex parallel arcs."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []
        self.at: dict[object, list[int]] = {}
        self.names: dict[object, int] = {}
        self.nodes: list[list[int]] = []

    def node(self, name: object) -> int:
        if name not in self.names:
            self.names[name] = len(self.nodes)
            self.nodes.append([])
        return self.names[name]

    def arc(self, a: object, b: object, room: int, cost: float) -> int:
        u, v = self.node(a), self.node(b)
        for x, y, r, c in ((u, v, room, cost), (v, u, 0, -cost)):
            self.nodes[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def reset(self, shut: list[int]) -> None:
        """Takes all flow back and shuts some arcs."""
        for e in range(0, len(self.room), 2):
            self.room[e], self.room[e + 1] = self.room[e] + self.room[e + 1], 0
        for e in shut:
            self.room[e] = 0

    def run(self, source: object, sink: object, amount: int) -> int:
        """Sends up to amount; costs of arcs must not be negative."""
        s, t = self.node(source), self.node(sink)
        level = [0.0] * len(self.nodes)
        sent = 0
        while sent < amount:
            far = [math.inf] * len(self.nodes)
            came = [-1] * len(self.nodes)
            far[s] = 0.0
            heap = [(0.0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for e in self.nodes[u]:
                    if self.room[e] > 0:
                        v = self.to[e]
                        x = d + max(0.0, self.cost[e] + level[u] - level[v])
                        if x < far[v] - 1e-12:
                            far[v], came[v] = x, e
                            heapq.heappush(heap, (x, v))
            if far[t] == math.inf:
                break
            for i, d in enumerate(far):
                if d < math.inf:
                    level[i] += d
            push, v = amount - sent, t
            while v != s:
                push = min(push, self.room[came[v]])
                v = self.to[came[v] ^ 1]
            v = t
            while v != s:
                self.room[came[v]] -= push
                self.room[came[v] ^ 1] += push
                v = self.to[came[v] ^ 1]
            sent += push
        return sent


@dataclass
class Cell:
    row: str
    column: str
    share: float
    floor: int
    available: int
    quota: int = 0
    shortfall: int = 0


def _whole(x: float) -> int:
    """The least integer not under x, forgiving the last bits of a product."""
    return math.ceil(x - 1e-9 * max(1.0, abs(x)))


#: Prices of a unit: of slack, of a target's unit, and past the need.  A margin's unit costs under 1,000, so no
#: saving at the margins outweighs a unit of a need, nor a target's unit one of a floor.
SLACK, TARGET, PAST = 1.0, 2_000.0, 6_000.0


def solve(cells: list[Cell], size: int, seed: int) -> None:
    """Sets each cell's shortfall, what it lacks of the greater of floor and target, and its quota.

    Quotas add up to size, or to all that is available.
    """
    rng = random.Random(seed)
    amount = min(size, sum(c.available for c in cells))
    flow = Flow()
    margins: dict[tuple[str, str], float] = {}
    for c in cells:
        for side in (("row", c.row), ("column", c.column)):
            margins[side] = margins.get(side, 0.0) + c.share * size
    needs = [_whole(max(c.floor, c.share * size)) for c in cells]
    widest = max(size, sum(needs))
    for side, target in sorted(margins.items()):
        ends = ("pool", side) if side[0] == "row" else (side, "sample")
        low = math.floor(target + 1e-9)
        flow.arc(*ends, low, 0.0)
        if target - low > 1e-9:
            flow.arc(*ends, 1, min(20.0, rng.expovariate(1.0) / (target - low)) / 10)
        for k in range(12):  # a margin that cannot be met spills over, ever more dearly
            flow.arc(*ends, max(1, widest * 2**k // 2**11), 50.0 * (k + 1))
    slack, stock = [], []
    for i, c in enumerate(cells):
        a, b, need, held = ("row", c.row), ("column", c.column), ("need", i), ("stock", i)
        target = c.share * size
        whole = math.floor(target + 1e-9)
        flow.arc(a, need, c.floor, 0.0)
        if whole > c.floor:
            flow.arc(a, need, whole - c.floor, TARGET)
        if target - whole > 1e-9 and whole >= c.floor:
            flow.arc(a, need, 1, TARGET + min(100.0, 5 * rng.expovariate(1.0) / (target - whole)))
        flow.arc(need, held, needs[i], 0.0)
        slack.append(flow.arc(need, b, needs[i], SLACK))
        past, step, price = c.available, max(1, math.ceil(target / 8)), PAST
        while past > 0:
            flow.arc(a, held, min(step, past), price + rng.random())
            past, step, price = past - step, step * 2, price + 20.0
        stock.append(flow.arc(held, b, c.available, 0.0))
    flow.run("pool", "sample", sum(needs))
    for c, arc in zip(cells, slack):
        c.shortfall = flow.used(arc)
    flow.reset(slack)
    flow.run("pool", "sample", amount)
    for c, arc in zip(cells, stock):
        c.quota = flow.used(arc)


def latest(pool: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """One row a key: the values of its latest delivery."""
    rows = pool.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(time).alias("at"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    last = rows.groupBy("key").agg(F.max(F.struct("at", *[f"v{i}" for i in range(len(values))])).alias("last"))
    return last.select(F.col("key").alias(key), *[F.col(f"last.v{i}").alias(v) for i, v in enumerate(values)])


def _cells(pool: DataFrame, targets: DataFrame, row: str, column: str) -> tuple[list[Cell], int, dict[tuple[str, str], int], DataFrame]:
    goals = targets.select(row, column, "target_share", "min_rows", "sample_size", fold(F.col(row)).alias("r"), fold(F.col(column)).alias("c")).collect()
    cells: list[Cell] = []
    where: dict[tuple[str, str], int] = {}
    for g in goals:
        k = (g.r or "", g.c or "")
        if k in where:
            cells[where[k]].share += g.target_share or 0.0
            cells[where[k]].floor += g.min_rows or 0
        else:
            where[k] = len(cells)
            cells.append(Cell(g[0], g[1], g.target_share or 0.0, g.min_rows or 0, 0))
    spark = pool.sparkSession
    index = spark.createDataFrame([(r, c, i) for (r, c), i in where.items()], "r string, c string, cell int")
    placed = pool.withColumns({"r": F.coalesce(fold(F.col(row)), F.lit("")), "c": F.coalesce(fold(F.col(column)), F.lit(""))}).join(index, ["r", "c"])
    for x in placed.groupBy("cell").agg(F.count("*").alias("rows")).collect():
        cells[x.cell].available = x.rows
    return cells, max([g.sample_size or 0 for g in goals], default=0), where, placed


def allocate(pool: DataFrame, targets: DataFrame, row: str = "question_type", column: str = "difficulty", seed: int = 7) -> tuple[list[Cell], DataFrame]:
    """The cells with quotas and shortfalls, and the pool's rows with their cell number; pool has one row a key."""
    cells, size, _, placed = _cells(pool, targets, row, column)
    if cells:
        solve(cells, size, seed)
    return cells, placed


def allocation_report(pool: DataFrame, targets: DataFrame, row: str = "question_type", column: str = "difficulty", seed: int = 7) -> DataFrame:
    """Columns (row, column, target_share, min_rows, available, quota, shortfall), one row a target cell."""
    cells, _ = allocate(pool, targets, row, column, seed)
    rows = [(c.row, c.column, c.share, c.floor, c.available, c.quota, c.shortfall) for c in cells]
    return pool.sparkSession.createDataFrame(rows, f"{row} string, {column} string, target_share double, min_rows bigint, available bigint, quota bigint, shortfall bigint")


def draw_sample(pool: DataFrame, targets: DataFrame, key: str, row: str = "question_type", column: str = "difficulty", seed: int = 7, buckets: int | None = None) -> DataFrame:
    """Columns (key, row, column) of the sampled rows, categories spelled as in targets."""
    cells, placed = allocate(pool, targets, row, column, seed)
    spark = pool.sparkSession
    buckets = buckets or max(BUCKETS, max((c.available for c in cells), default=0) // BUCKET_ROWS)
    quotas = spark.createDataFrame([(i, c.row, c.column, c.quota) for i, c in enumerate(cells)], f"cell int, {row} string, {column} string, quota bigint")
    hashed = placed.select(F.col(key).alias("key"), "cell", F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = hashed.groupBy("cell", "bucket").agg(F.count("*").alias("rows"))
    up = Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counts.withColumn("upto", F.sum("rows").over(up)).join(quotas, "cell").withColumn("left", F.col("quota") - F.col("upto") + F.col("rows")).filter("left > 0")
    kept = hashed.join(ends, ["cell", "bucket"])
    rank = F.row_number().over(Window.partitionBy("cell", "bucket").orderBy("h", "key"))
    edge = kept.filter("left < rows").withColumn("rank", rank).filter("rank <= left").drop("rank")
    return kept.filter("left >= rows").unionByName(edge).select(F.col("key").alias(key), row, column)
