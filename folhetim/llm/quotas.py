"""Samples that meet target shares, with minimums and a report of what can't be met (problem 5).

Method: min-cost flow over the counts of cells, report by length of text. Flow goes from the source over
a report's arcs (its floor, its target, its surplus), the report's cells (what there is) and the length
classes (their share of all units) to the sink; what no arc takes flows over a slack arc of the report
and is its shortfall. A first flow, with the unrounded targets rounded up, tells which reports fall short. Fractional targets are rounded at random, seeded, so that they add up to the
draw's size; the flow then gives whole cell quotas.

Only counts are solved, a draw per task: as many rows as the plan has reports times classes. Units of a
cell are drawn by the least seeded hashes, cut before the shuffle at the largest quota.
"""

from __future__ import annotations

import heapq
import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Length classes, from so many characters on.
CLASSES = ((0, "curta"), (80, "media"), (240, "longa"))
# Costs: a shortfall stays a shortfall (slack is cheaper than surplus), so shares keep to their targets.
FLOOR, TARGET, SURPLUS, SLACK, OFF_MARGIN = -1000, 0, 200, 100, 7


def length_class(text: F.Column) -> F.Column:
    out = F.lit(CLASSES[0][1])
    for least, name in CLASSES[1:]:
        out = F.when(F.length(text) >= least, F.lit(name)).otherwise(out)
    return out


def available(units: DataFrame) -> DataFrame:
    """``relatorio, classe, sentenca_id``: the distinct units with a text; a unit with several texts is in the class of the longest."""
    return units.where("texto is not null and sentenca_id is not null").groupBy("relatorio", "sentenca_id").agg(F.max(F.struct(F.length("texto").alias("l"), length_class(F.col("texto")).alias("c")))["c"].alias("classe"))


class Flow:
    """Successive shortest paths on a small network with whole capacities."""

    def __init__(self) -> None:
        self.arcs: list[list] = []
        self.out: dict[str, list[int]] = {}

    def arc(self, a: str, b: str, capacity: int, cost: float) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.arcs.append([y, c, w])
        return len(self.arcs) - 2

    def used(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]

    def send(self, source: str, sink: str, amount: int) -> int:
        potential = dict.fromkeys(self.out, 0.0)
        for _ in self.out:  # first potentials, as costs may be negative
            for x, ids in self.out.items():
                for i in ids:
                    y, c, w = self.arcs[i]
                    if c and potential[x] + w < potential[y] - 1e-9:
                        potential[y] = potential[x] + w
        sent = 0
        while sent < amount:
            far, via, heap = {source: 0.0}, {}, [(0.0, source)]
            while heap:
                dist, x = heapq.heappop(heap)
                if dist > far[x] + 1e-9:
                    continue
                for i in self.out[x]:
                    y, c, w = self.arcs[i]
                    if c and (new := dist + w + potential[x] - potential[y]) < far.get(y, math.inf) - 1e-9:
                        far[y], via[y] = new, i
                        heapq.heappush(heap, (new, y))
            if sink not in far:
                break
            top = max(far.values())
            for x in potential:
                potential[x] += far.get(x, top)
            step, x = amount - sent, sink
            while x != source:
                step = min(step, self.arcs[via[x]][1])
                x = self.arcs[via[x] ^ 1][0]
            x = sink
            while x != source:
                self.arcs[via[x]][1] -= step
                self.arcs[via[x] ^ 1][1] += step
                x = self.arcs[via[x] ^ 1][0]
            sent += step
        return sent


def rounded_at_random(parts: list[float], total: int, rng: random.Random) -> list[int]:
    """Whole numbers next to ``parts`` that add up to ``total``; each is rounded up with its fraction's probability."""
    scale = total / s if (s := sum(parts)) else 0.0
    u, run, out = rng.random(), 0.0, []
    for p in parts:
        a = math.floor(run + u + 1e-12)
        run += p * scale
        out.append(math.floor(run + u + 1e-12) - a)
    out[-1] += total - sum(out)
    return out


def shortfalls(need: dict[str, float], cells: dict[tuple[str, str], int]) -> dict[str, int]:
    """What flows over each report's slack arc if every report is to send its need, rounded up, through its cells."""
    flow, slack, demand = Flow(), {}, {r: math.ceil(x) for r, x in need.items()}
    for r, k in demand.items():
        flow.arc("fonte", f"r{r}", k, TARGET)
        slack[r] = flow.arc(f"r{r}", "fim", k, SLACK)
    for (r, c), k in sorted(cells.items()):
        flow.arc(f"r{r}", f"x{r} {c}", k, 0)
        flow.arc(f"x{r} {c}", "fim", k, 0)
    flow.send("fonte", "fim", sum(demand.values()))
    return {r: flow.used(a) for r, a in slack.items()}


def solve(g: pd.DataFrame) -> pd.DataFrame:
    """Quotas of one draw: ``seed, relatorio, classe, disponivel, quota, alvo, minimo, falta, carencia``."""
    seed, n = int(g["seed"].iloc[0]), int(g["n"].max())
    rng = random.Random(seed)
    strata = g.drop_duplicates("relatorio").sort_values("relatorio")
    names = strata["relatorio"].tolist()
    target = dict(zip(names, rounded_at_random([p if p == p else 0.0 for p in strata["proporcao_alvo"]], n, rng)))
    floor = {r: 0 if m != m else int(m) for r, m in zip(names, strata["minimo"])}
    cells = {(r, c): int(k) for r, c, k in zip(g["relatorio"], g["classe"], g["disponivel"]) if isinstance(c, str)}
    need = {r: max(float(floor[r]), p * n if p == p else 0.0) for r, p in zip(names, strata["proporcao_alvo"])}
    lacking = shortfalls(need, cells)
    classes = sorted({c for _, c in cells})
    stock = {c: g["total_classe"][g["classe"] == c].iloc[0] for c in classes}
    margin = dict(zip(classes, rounded_at_random([float(stock[c]) for c in classes], n, rng))) if classes else {}
    flow, slack, arcs = Flow(), {}, {}
    for r in names:
        have = sum(k for (x, _), k in cells.items() if x == r)
        low = min(floor[r], n)
        flow.arc("fonte", f"r{r}", low, FLOOR)
        flow.arc("fonte", f"r{r}", max(0, target[r] - low), TARGET)
        flow.arc("fonte", f"r{r}", have, SURPLUS + rng.random())
        slack[r] = flow.arc(f"r{r}", "fim", max(low, target[r]), SLACK)
    for (r, c), k in sorted(cells.items()):
        arcs[r, c] = flow.arc(f"r{r}", f"c{c}", k, rng.random())
    for c in classes:
        flow.arc(f"c{c}", "fim", margin[c], 0)
        flow.arc(f"c{c}", "fim", n + sum(floor.values()), OFF_MARGIN)
    # floors come first even if they add up to more than the draw
    flow.send("fonte", "fim", max(n, sum(min(f, n) for f in floor.values())))
    rows = []
    for r in names:
        own = [c for c in classes if (r, c) in cells] or [None]
        for c in own:
            rows.append((seed, r, c, cells.get((r, c), 0), flow.used(arcs[r, c]) if c else 0, target[r], floor[r], flow.used(slack[r]), lacking[r]))
    return pd.DataFrame(rows, columns=["seed", "relatorio", "classe", "disponivel", "quota", "alvo", "minimo", "falta", "carencia"])


def cell_quotas(units: DataFrame, plan: DataFrame) -> DataFrame:
    """``seed, relatorio, classe, disponivel, quota, alvo, minimo, falta, carencia``: each draw's quotas, and the shortfall per report.

    ``falta`` is what the draw lacks of the report's rounded target or minimum, ``carencia`` what the
    report lacks of the greater of its minimum and its unrounded target: the flow over its slack arc.
    Repeated plan rows of a draw and report count once; a report without units has one row of no class.
    A draw without a size asks for minimums alone; rows without seed or report are left out.
    """
    cells = available(units).groupBy("relatorio", "classe").agg(F.count("*").alias("disponivel"))
    cells = cells.withColumn("total_classe", F.sum("disponivel").over(Window.partitionBy("classe")))
    asked = plan.where("seed is not null and relatorio is not null").groupBy("seed", "relatorio").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("proporcao_alvo").alias("proporcao_alvo"), F.max("minimo").alias("minimo"))
    joined = asked.join(cells, "relatorio", "left")
    return joined.groupBy("seed").applyInPandas(solve, "seed int, relatorio string, classe string, disponivel long, quota long, alvo long, minimo long, falta long, carencia long")


def short_strata(quotas: DataFrame) -> DataFrame:
    """``seed, relatorio`` of ``cell_quotas`` whose slack arc is used: reports that can't give what the plan asks for."""
    return quotas.where("carencia > 0").select("seed", "relatorio").distinct()


def sample(units: DataFrame, plan: DataFrame, quotas: DataFrame | None = None) -> DataFrame:
    """``seed, relatorio, classe, sentenca_id``: the units drawn, by quota, seeded and without replacement."""
    quotas = (cell_quotas(units, plan) if quotas is None else quotas).where("quota > 0").select("seed", "relatorio", "classe", "quota")
    most = plan.agg(F.max("n")).first()[0] or 0
    pool = available(units).join(quotas, ["relatorio", "classe"])
    by = Window.partitionBy("seed", "relatorio", "classe").orderBy(F.xxhash64("seed", "sentenca_id"), "sentenca_id")
    return pool.withColumn("k", F.row_number().over(by)).where(F.col("k") <= int(most)).where("k <= quota").select("seed", "relatorio", "classe", "sentenca_id")
