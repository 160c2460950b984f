"""Linear programs for production plans, one for each group of rows.

A plan's matrix is made by joins (recipe inputs and outputs as signed coefficients) and solved
inside `applyInArrow`, one small dense problem a group; many scenarios are many groups. The
solver is a two-phase primal simplex with a raised right side against cycling, in standard form,
and stages are lexicographic: each stage's optimum is pinned within a relative 1e-9 before the
next one starts. Infeasible and unbounded problems are named results, not failures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOL = 1e-9
#: Pivots after which a tableau is made anew.
FRESH = 40


def simplex(c: np.ndarray, a_ub: np.ndarray, b_ub: np.ndarray, a_eq: np.ndarray, b_eq: np.ndarray) -> tuple[str, np.ndarray, float]:
    """Minimises c x subject to a_ub x <= b_ub, a_eq x = b_eq, x >= 0: (status, x, value)."""
    return priced(c, a_ub, b_ub, a_eq, b_eq)[:3]


def priced(c: np.ndarray, a_ub: np.ndarray, b_ub: np.ndarray, a_eq: np.ndarray, b_eq: np.ndarray) -> tuple[str, np.ndarray, float, np.ndarray]:
    """As `simplex`, with the change of the value for one more unit of each of b_ub: the last cost
    row at the slacks."""
    n, m_ub, m_eq = len(c), len(b_ub), len(b_eq)
    a = np.zeros((m_ub + m_eq, n + m_ub))
    a[:m_ub, :n], a[m_ub:, :n] = a_ub.reshape(m_ub, n), a_eq.reshape(m_eq, n)
    a[:m_ub, n:] = np.eye(m_ub)
    b = np.concatenate([b_ub, b_eq]).astype(float)
    flip = b < 0
    a[flip], b[flip] = -a[flip], -b[flip]
    rows, cols = a.shape
    tableau = np.zeros((rows + 1, cols + rows + 1))
    tableau[:rows, :cols], tableau[:rows, cols : cols + rows], tableau[:rows, -1] = a, np.eye(rows), b
    basis = np.arange(cols, cols + rows)
    tableau[-1, :cols], tableau[-1, -1] = -a.sum(axis=0), -b.sum()
    if not _pivoted(tableau, basis, cols):
        return "unbounded", np.zeros(n), 0.0, np.zeros(m_ub)
    if tableau[-1, -1] < -1e-7 * max(1.0, np.abs(b).max(initial=0.0)):
        return "infeasible", np.zeros(n), 0.0, np.zeros(m_ub)
    for r in np.flatnonzero(basis >= cols):  # artificial variables at zero leave where they can
        at = np.flatnonzero(np.abs(tableau[r, :cols]) > TOL)
        if len(at):
            _pivot(tableau, basis, r, at[0])
    keep = basis < cols
    tableau = np.delete(np.vstack([tableau[:-1][keep], np.zeros(tableau.shape[1])]), np.s_[cols : cols + rows], axis=1)
    basis = basis[keep]
    tableau[-1, :n] = c
    for r, at in enumerate(basis):
        tableau[-1] -= tableau[-1, at] * tableau[r]
    if not _pivoted(tableau, basis, cols):
        return "unbounded", np.zeros(n), 0.0, np.zeros(m_ub)
    x = np.zeros(cols)
    x[basis] = tableau[:-1, -1]
    return "optimal", x[:n], float(c @ x[:n]), -tableau[-1, n : n + m_ub]


def _pivot(t: np.ndarray, basis: np.ndarray, r: int, at: int) -> None:
    t[r] /= t[r, at]
    others = np.flatnonzero(np.abs(t[:, at]) > 0)
    others = others[others != r]
    t[others] -= np.outer(t[others, at], t[r])
    basis[r] = at


def _pivoted(t: np.ndarray, basis: np.ndarray, cols: int) -> bool:
    """Pivots until no cost is negative; False if the objective has no bound.

    Most caps are zero, so many rows tie and pivots need not lower the cost. Rows to leave are
    therefore chosen by a second right side, each row of which is raised by another tiny amount. In
    the end it is dropped, and rows that the true right side leaves negative are mended by dual
    pivots, which keep the costs. Every `FRESH` pivots the tableau is made anew from the first one,
    as rounding errors of pivots add up."""
    raised = np.append(np.maximum(t[:-1, -1], 0.0) + 1e-8 * (1 + np.random.default_rng(0).random(len(basis))), 0.0)
    first = np.hstack([t, raised[:, None]])
    wide, settled, least = first.copy(), False, 1e-9
    for step in range(1, 50_000):
        if step % FRESH == 0 or settled:
            wide[:-1] = np.linalg.solve(first[:-1, basis], first[:-1])
            wide[-1] = first[-1] - first[-1, basis] @ wide[:-1]
        at = int(np.argmin(wide[-1, :cols]))
        if not settled and wide[-1, at] >= -least:
            settled = True
            continue
        if not settled:
            up = np.flatnonzero(wide[:-1, at] > 1e-8)
            if not len(up):
                t[:] = wide[:, :-1]
                return False
            ratio = np.maximum(wide[up, -1], 0.0) / wide[up, at]
            best = up[ratio <= ratio.min() + 1e-13]
            _pivot(wide, basis, best[np.argmax(wide[best, at])], at)
            continue
        r = int(np.argmin(wide[:-1, -2]))
        down = np.flatnonzero(wide[r, :cols] < -1e-8)
        if wide[r, -2] >= -1e-10 or not len(down):
            t[:] = wide[:, :-1]
            return True
        ratio = np.maximum(wide[-1, down], 0.0) / -wide[r, down]
        best = down[ratio <= ratio.min() + 1e-13]
        _pivot(wide, basis, r, best[np.argmin(wide[r, best])])
    raise ArithmeticError("the simplex did not settle")


def lexicographic(stages: list[np.ndarray], a_ub: np.ndarray, b_ub: np.ndarray, a_eq: np.ndarray, b_eq: np.ndarray) -> tuple[str, np.ndarray, list[float]]:
    """Minimises the stages one after the other, each pinned within 1e-9 before the next."""
    values: list[float] = []
    x = np.zeros(a_ub.shape[1] if len(b_ub) else a_eq.shape[1])
    for c in stages:
        status, x_new, value = simplex(c, a_ub, b_ub, a_eq, b_eq)
        if status != "optimal":  # a later stage keeps the earlier ones' plan, and says so
            return (status if not values else f"optimal to stage {len(values)}"), x, values
        x = x_new
        values.append(value)
        a_ub, b_ub = np.vstack([a_ub.reshape(-1, len(c)), c]), np.append(b_ub, value + max(abs(value), 1.0) * 1e-9)
    return "optimal", x, values


def _matrix(t: pa.Table) -> tuple[list, list, np.ndarray]:
    """Recipes, items and the net coefficient of each recipe on each item."""
    recipe, item, coef = (t[k].to_pylist() for k in ("recipe", "item", "coef"))
    recipes, items = sorted({r for r in recipe if r is not None}), sorted(set(item))
    at_r, at_i = {r: k for k, r in enumerate(recipes)}, {i: k for k, i in enumerate(items)}
    net = np.zeros((len(items), len(recipes)))
    for r, i, q in zip(recipe, item, coef, strict=True):
        if r is not None:
            net[at_i[i], at_r[r]] += q
    return recipes, items, net


SOLUTION = "run long, recipe long, activity double, scale double, status string"


def solve_supply(rows: DataFrame) -> DataFrame:
    """One plan for each run: the largest common scale of the targets that the caps allow, then
    least cost, then least activity.

    `rows` has run, recipe, item, coef (made less taken for one unit of activity), cap (what
    may be taken of the item from outside; null: unlimited, 0: none), target (units wanted at
    scale one) and cost of the recipe. Rows without a recipe only state an item's cap."""

    def plan(t: pa.Table) -> pa.Table:
        run = t["run"][0].as_py()
        recipes, items, net = _matrix(t)
        n, facts = len(recipes), {}
        for i, cap, want in zip(t["item"].to_pylist(), t["cap"].to_pylist(), t["target"].to_pylist(), strict=True):
            facts[i] = (cap, want or 0.0)
        price = dict(zip(t["recipe"].to_pylist(), t["cost"].to_pylist(), strict=True))
        want = np.array([facts[i][1] for i in items])
        bounded = np.array([facts[i][0] is not None for i in items])
        cap = np.array([facts[i][0] or 0.0 for i in items])
        a = np.hstack([-net, want[:, None]])[bounded]  # taken + scale * wanted <= made + cap
        limit = np.concatenate([np.zeros(n), [1.0]])  # a scale nobody limits is no plan
        cost = np.append([price[r] or 0.0 for r in recipes], 0.0)
        status, x, _ = lexicographic([-limit, cost, np.append(np.ones(n), 0.0)], a, cap[bounded], np.zeros((0, n + 1)), np.zeros(0))
        return pa.table({"run": [run] * n, "recipe": recipes, "activity": [float(v) for v in x[:n]], "scale": [float(x[n])] * n, "status": [status] * n}, schema=pa.schema([("run", pa.int64()), ("recipe", pa.int64()), ("activity", pa.float64()), ("scale", pa.float64()), ("status", pa.string())]))

    return rows.groupBy("run").applyInArrow(plan, SOLUTION)


def solve_demand(rows: DataFrame) -> DataFrame:
    """One plan for each run that makes at least `target` of every item at least cost, then
    least activity. `rows` as for `solve_supply`; caps bound what comes from outside."""

    def plan(t: pa.Table) -> pa.Table:
        run = t["run"][0].as_py()
        recipes, items, net = _matrix(t)
        facts = {i: (c, w or 0.0) for i, c, w in zip(t["item"].to_pylist(), t["cap"].to_pylist(), t["target"].to_pylist(), strict=True)}
        price = dict(zip(t["recipe"].to_pylist(), t["cost"].to_pylist(), strict=True))
        bounded = np.array([facts[i][0] is not None for i in items])
        room = np.array([(facts[i][0] or 0.0) - facts[i][1] for i in items])
        cost = np.array([price[r] or 0.0 for r in recipes])
        status, x, _ = lexicographic([cost, np.ones(len(recipes))], -net[bounded], room[bounded], np.zeros((0, len(recipes))), np.zeros(0))
        k = len(recipes)
        return pa.table({"run": [run] * k, "recipe": recipes, "activity": [float(v) for v in x], "scale": [1.0] * k, "status": [status] * k}, schema=pa.schema([("run", pa.int64()), ("recipe", pa.int64()), ("activity", pa.float64()), ("scale", pa.float64()), ("status", pa.string())]))

    return rows.groupBy("run").applyInArrow(plan, SOLUTION)


DISTRICT = "run long, kind string, key long, value double, price double, note string"


def _district(t: pa.Table, grid: float | None) -> list[tuple]:
    """Rows of DISTRICT for one run."""
    run = t["run"][0].as_py()
    recipes, items, net = _matrix(t)
    facts: dict = {}
    for i, cap, want, floor, weight in zip(*(t[k].to_pylist() for k in ("item", "cap", "target", "floor", "weight")), strict=True):
        facts[i] = (cap, want or 0.0, floor or 0.0, weight or 0.0)
    own = {r: (c or 0.0, p or 0.0) for r, c, p in zip(*(t[k].to_pylist() for k in ("recipe", "cost", "power")), strict=True) if r is not None}
    n = len(recipes)
    bounded = np.array([facts[i][0] is not None for i in items])
    cap, want, floor, weight = (np.array([facts[i][k] or 0.0 for i in items]) for k in range(4))
    power = np.array([own[r][1] for r in recipes])
    held = [i for i, b in zip(items, bounded, strict=True) if b]
    a = np.hstack([-net, want[:, None]])[bounded]
    b = (cap - floor)[bounded]
    if grid is not None:
        a, b = np.vstack([a, np.append(power, 0.0)]), np.append(b, grid)
    none = (np.zeros((0, n + 1)), np.zeros(0))
    scale = np.append(np.zeros(n), -1.0)
    status, x, _, price = priced(scale, a, b, *none)
    if status == "infeasible":
        return _floors(run, a, b, floor[bounded], held, n)
    if status != "optimal":
        return [(run, "run", 0, 0.0, None, status)]
    extra = np.append(-(weight @ net), weight @ want)  # the weighted surplus of what is made over what is wanted
    stages = [scale, extra, np.append([own[r][0] for r in recipes], 0.0), np.append(np.ones(n), 0.0)]
    if not weight.any():
        stages.pop(1)
    status, x, _ = lexicographic(stages, a, b, *none)
    left = b - a @ x
    out = [(run, "run", 0, float(x[n]), None, status)]
    out += [(run, "recipe", r, float(v), None, "") for r, v in zip(recipes, x[:n], strict=True)]
    out += [(run, "item", i, float(c - f - r), float(-y), "binding" if r <= 1e-6 * max(1.0, c) else "") for i, c, f, r, y in zip(held, cap[bounded], floor[bounded], left, price, strict=False)]
    if grid is not None:
        out.append((run, "power", 0, float(power @ x[:n]), float(-price[-1]), "binding" if left[-1] <= 1e-6 * max(1.0, grid) else ""))
    return out


def _floors(run: int, a: np.ndarray, b: np.ndarray, floor: np.ndarray, held: list, n: int) -> list[tuple]:
    """Which floors fail alone, and the largest share of all that can be met together, as one more
    program: the share is a variable."""
    room = b.copy()
    room[: len(floor)] += floor
    out = []
    for k in np.flatnonzero(floor):
        alone = room.copy()
        alone[k] -= floor[k]
        ok = simplex(np.zeros(n + 1), a, alone, np.zeros((0, n + 1)), np.zeros(0))[0] == "optimal"
        out.append((run, "floor", held[k], float(floor[k]), None, "" if ok else "fails alone"))
    column = np.zeros(len(b))
    column[: len(floor)] = floor
    wide = np.vstack([np.hstack([a, column[:, None]]), np.append(np.zeros(n + 1), 1.0)])
    status, x, _ = simplex(np.append(np.zeros(n + 1), -1.0), wide, np.append(room, 1.0), np.zeros((0, n + 2)), np.zeros(0))
    return [(run, "run", 0, float(x[-1]) if status == "optimal" else 0.0, None, "floors not met"), *out]


def solve_district(rows: DataFrame, grid: float | None = None) -> DataFrame:
    """One plan for each run under caps, floors and a grid, in four stages: the largest common scale
    of the targets, then the greatest weighted surplus, least cost, least activity.

    `rows` as for `solve_supply`, with `floor` (units an item must have left), `weight` (what a unit
    of surplus counts) and the recipe's `power`. Gives (run, kind, key, value, price, note): the run's
    scale and status, each recipe's activity, each capped item's draw with what one more unit of cap
    adds to the scale and whether it binds, the power drawn. A run whose floors cannot be met gives
    the largest share of them that can, and which fail alone."""

    def plan(t: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in DISTRICT.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
        return pa.table({k: pa.array(c, kind) for k, c, kind in zip(names, zip(*_district(t, grid), strict=True), kinds, strict=True)})

    return rows.groupBy("run").applyInArrow(plan, DISTRICT)


#: Numbers of one site's items and recipes lie this far from the next one's.
SITE = 1 << 32


def with_transfers(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of a run with several sites (column site) as rows of one, for the solvers: items and
    recipes are told apart by site, and a link (run, a, b, item, cost) is one more recipe that takes
    the item at one site and gives it at the other."""
    at = lambda site, c: F.col(site) * SITE + F.col(c)
    own = rows.withColumn("recipe", at("site", "recipe")).withColumn("item", at("site", "item")).drop("site")
    link = F.xxhash64("a", "b", "item").bitwiseOR(F.lit(-(1 << 63)))  # negative, so no site's recipe
    ends = F.explode(F.array(*(F.struct(at(e, "item").alias("item"), F.lit(q).alias("coef")) for e, q in (("a", -1.0), ("b", 1.0)))))
    sent = links.select("run", link.alias("recipe"), ends.alias("e"), F.col("cost").alias("price")).select("run", "recipe", "e.*", "price")
    facts = own.groupBy("run", "item").agg(*(F.max(c).alias(c) for c in ("cap", "target")), (F.count("*") > F.count("cap")).alias("free"))
    sent = sent.join(facts, ["run", "item"]).select("run", "recipe", "item", "coef", F.when(~F.col("free"), F.col("cap")).alias("cap"), "target", F.col("price").alias("cost"))
    return own.select(*sent.columns).unionByName(sent)
