"""Samples with target category proportions: controlled rounding by max-flow, then exact random-key quotas (p2).

The wanted fractional table (error type by source) is the target proportions scaled so that every category keeps its minimum, none
exceeds what there is, and the sum is the sample size. Flow through rows, cells and columns, each between its floor and its
ceiling, makes the table integer while both margins stay within one of their fractional sums. Each cell then takes exactly its
quota of smallest random keys: a histogram of the keys' leading bits finds the boundary, and only rows of the boundary bin are
ranked.

Defined results: records with a null type or source belong to no category but count in the size; names of sources are compared
without outer blanks and without case; null targets count as 0; a target category without records gets quota 0 and is short unless it
wants nothing; ties of random keys are broken by the record. Empty tables give an empty sample and the report of the targets.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Categories; the table of targets is held by the driver and broadcast.
MAX_CATEGORIES = 20_000
_BIN_BITS = 12


def plain(column: str) -> Column:
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def scaled_table(size: int, share: Sequence[int], least: Sequence[int], there: Sequence[int]) -> list[Fraction]:
    """Cells in proportion to ``share``, each at least ``least`` and at most ``there``, that sum to ``size`` as far as there are rows."""
    lo = [min(a, b) for a, b in zip(least, there)]
    want = max(min(size, sum(b for b, s in zip(there, share) if s > 0) + sum(a for a, s in zip(lo, share) if not s)), sum(lo))
    # the sum of all cells grows with the factor along a broken line that bends where a cell leaves its lower bound or meets its upper one; walk the
    # bends in order with running sums of what is fixed and of what grows
    bends = sorted([(Fraction(a, s), s, -a) for a, s in zip(lo, share) if s] + [(Fraction(b, s), -s, b) for b, s in zip(there, share) if s], key=lambda x: x[0])
    fixed, slope, factor = sum(lo), 0, Fraction(0)
    for bend, rise, change in bends:
        if fixed + slope * bend >= want:
            factor = Fraction(want - fixed, slope) if slope else factor
            break
        fixed, slope, factor = fixed + change, slope + rise, bend
    return [min(Fraction(b), max(Fraction(a), factor * s)) for a, b, s in zip(lo, there, share)]


def controlled_rounding(rows: Sequence[object], columns: Sequence[object], cells: Sequence[Fraction]) -> list[int]:
    """Integer cells, each the floor or ceiling of its own, whose row, column and total sums are the floor or ceiling of theirs."""
    floors = [math.floor(c) for c in cells]
    part = [c - f for c, f in zip(cells, floors)]
    names = {("r", r): Fraction(0) for r in rows} | {("c", c): Fraction(0) for c in columns}
    for r, c, p in zip(rows, columns, part):
        names["r", r] += p
        names["c", c] += p
    node = {name: i + 4 for i, name in enumerate(names)}
    s, t, ss, tt = 0, 1, 2, 3
    graph: list[list[list[int]]] = [[] for _ in range(len(node) + 4)]

    def edge(a: int, b: int, cap: int) -> list[int]:
        forth, back = [b, cap, len(graph[b])], [a, 0, len(graph[a])]
        graph[a].append(forth)
        graph[b].append(back)
        return forth

    owed = 0

    def bounded(a: int, b: int, value: Fraction) -> None:
        nonlocal owed
        lo, hi = math.floor(value), math.ceil(value)
        edge(a, b, hi - lo)
        if lo:  # what must flow is sent through the super source and sink
            edge(ss, b, lo)
            edge(a, tt, lo)
            owed += lo

    for (side, name), value in names.items():
        bounded(*((s, node[side, name]) if side == "r" else (node[side, name], t)), value)
    taken = [edge(node["r", r], node["c", c], int(p > 0)) for r, c, p in zip(rows, columns, part)]
    bounded(t, s, sum(part, Fraction(0)))
    while owed:  # Dinic: a blocking flow through the levels of the residual graph at a time
        level = {ss: 0}
        queue = deque([ss])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if e[1] > 0 and e[0] not in level:
                    level[e[0]] = level[a] + 1
                    queue.append(e[0])
        if tt not in level:
            raise AssertionError("the fractional table itself is such a flow")
        following = [0] * len(graph)
        path: list[list[int]] = []
        at = ss
        while True:
            if at == tt:
                flow = min(e[1] for e in path)
                for e in path:
                    e[1] -= flow
                    graph[e[0]][e[2]][1] += flow
                owed -= flow
                first = next(i for i, e in enumerate(path) if not e[1])  # go on from where the path is used up
                at = graph[path[first][0]][path[first][2]][0]
                path = path[:first]
                continue
            while following[at] < len(graph[at]):
                e = graph[at][following[at]]
                if e[1] > 0 and level.get(e[0]) == level[at] + 1:
                    break
                following[at] += 1
            else:
                if at == ss:
                    break
                back = path.pop()
                at = graph[back[0]][back[2]][0]
                following[at] += 1
                continue
            path.append(e)
            at = e[0]
    return [f + (1 - e[1] if p > 0 else 0) for f, e, p in zip(floors, taken, part)]


def quotas(records: DataFrame, targets: DataFrame, part: int = 5) -> DataFrame:
    """The report: for each target category ``error_type``, ``source`` (as in the targets), ``n_records``, ``quota``, ``wanted`` (the larger of
    the minimum and the share of the sample, rounded up), ``short`` and the plain name ``source_key``.

    :param records: one row per record with ``error_type`` and ``source``; the sample takes one in ``part`` of them."""
    spark = records.sparkSession
    rows = targets.select("error_type", "source", plain("source").alias("key"), F.coalesce("target_permille", F.lit(0)).alias("permille"), F.coalesce("min_rows", F.lit(0)).alias("least")).where("error_type is not null and source is not null").limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} target categories")
    wanted = spark.createDataFrame([(r.error_type, r.key) for r in rows] or [("", "")], "error_type STRING, key STRING").distinct()
    by_category = records.select("error_type", plain("source").alias("key")).groupBy("error_type", "key").agg(F.count(F.lit(1)).alias("n"))
    # the total and the listed categories from one pass; all other categories are summed up before they leave the executors
    known = by_category.join(F.broadcast(wanted.withColumn("listed", F.lit(True))), ["error_type", "key"], "left")
    sums = known.groupBy(F.when(F.col("listed"), F.col("error_type")).alias("error_type"), F.when(F.col("listed"), F.col("key")).alias("key")).agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in sums)
    have = {(r.error_type, r.key): int(r.n) for r in sums if r.error_type is not None}
    size = total // part
    there = [have.get((r.error_type, r.key), 0) for r in rows]
    cells = scaled_table(size, [r.permille for r in rows], [r.least for r in rows], there) if rows else []
    taken = controlled_rounding([r.error_type for r in rows], [r.key for r in rows], cells) if rows else []
    out = []
    for r, n, q in zip(rows, there, taken):
        want = max(int(r.least), -(-int(r.permille) * size // 1000))
        out.append((r.error_type, r.source, r.key, n, q, want, n < want))
    return spark.createDataFrame(out, "error_type STRING, source STRING, source_key STRING, n_records BIGINT, quota BIGINT, wanted BIGINT, short BOOLEAN")


def sample(records: DataFrame, report: DataFrame, key: str = "record", seed: int = 42) -> DataFrame:
    """The rows of ``records`` that fill each category's quota exactly, chosen by smallest random key."""
    quota = F.broadcast(report.select(F.col("error_type").alias("q_type"), "source_key", "quota"))  # at most MAX_CATEGORIES rows
    keyed = records.withColumn("_key", plain("source")).join(quota, (F.col("error_type") == F.col("q_type")) & (F.col("_key") == F.col("source_key"))).where("quota > 0")
    keyed = keyed.withColumn("_draw", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_bin", F.shiftright("_draw", 64 - _BIN_BITS))
    bins = keyed.groupBy("q_type", "source_key", "quota", "_bin").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("q_type", "source_key").orderBy("_bin"))
    edge = bins.withColumn("upto", upto).where("upto >= quota").groupBy("q_type", "source_key").agg(F.min_by(F.struct("_bin", (F.col("quota") - (F.col("upto") - F.col("n"))).alias("left")), "_bin").alias("edge"))
    edge = F.broadcast(edge.select(F.col("q_type").alias("e_type"), F.col("source_key").alias("e_key"), F.col("edge._bin").alias("e_bin"), F.col("edge.left").alias("e_left")))  # a row per category
    at = keyed.join(edge, (F.col("q_type") == F.col("e_type")) & (F.col("source_key") == F.col("e_key")), "left")
    whole = at.where("e_bin is null or _bin < e_bin")
    ranked = at.where("_bin = e_bin").withColumn("_rank", F.row_number().over(W.partitionBy("q_type", "source_key").orderBy("_draw", key))).where("_rank <= e_left").drop("_rank")
    return whole.unionByName(ranked).select(*records.columns)
