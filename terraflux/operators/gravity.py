"""Gravity estimators: fixed-effects OLS, Poisson pseudo-maximum likelihood, clustered errors, sweeps.

No task holds a panel. Origin-year and destination-year effects never cross a year, so a
year's rows are a block (``blocks``): given the coefficients, a block's effects are solved
in its task, and what leaves it are sums of the size of the normal equations. Those are
added up by Spark, and the driver takes a Newton step on the likelihood with the effects
concentrated out. A step is one pass over packed blocks without a shuffle; the
specifications of a sweep take their steps in the same pass. Effects that cross years
(pairs) make one block of a specification. Whatever the effects, a block has at most
``BLOCK_ROWS`` rows; larger ones are absorbed row by row instead (``projections``):
weighted group means by key as aggregations and joins, two sweeps at a time, with an
extrapolation between. Regressors that the effects explain are dropped and
reported as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import written
from .panel import drop_singletons

#: Rows of a block that a task may hold, and levels of an effect whose means are broadcast.
BLOCK_ROWS, BROADCAST_LEVELS = 1 << 21, 1 << 17


@dataclass(frozen=True)
class GravitySpec:
    """What is estimated: the flow, the regressors, and which fixed effects are on."""

    flow: str = "X_ij_usd"
    regressors: tuple[str, ...] = ("log_d", "home")
    origin_year: bool = True
    destination_year: bool = True
    pair: bool = False
    within: tuple[str, ...] = ("year",)

    def effects(self) -> tuple[str, ...]:
        on = ((self.origin_year, "oy"), (self.destination_year, "dy"), (self.pair, "pair_id"))
        return tuple(name for flag, name in on if flag)


def absorb(x: np.ndarray, groups: list[np.ndarray], w: np.ndarray, tol: float = 1e-10, rounds: int = 100_000) -> np.ndarray:
    """Columns less their weighted group means, by alternating projections; an error if they don't settle."""
    x = x.copy()
    totals = [np.maximum(np.bincount(g, w), 1e-300) for g in groups]
    scale = np.maximum(np.sqrt((w[:, None] * x * x).sum(axis=0)), 1e-300)
    for _ in range(rounds if groups else 0):
        moved = 0.0
        for g, total in zip(groups, totals, strict=True):
            for k in range(x.shape[1]):
                mean = np.bincount(g, w * x[:, k]) / total
                x[:, k] -= mean[g]
                moved = max(moved, math.sqrt(float((total * mean * mean).sum())) / scale[k])
        if moved < tol or len(groups) == 1:
            return x
    if groups:
        raise RuntimeError(f"projections did not settle in {rounds} rounds")
    return x


def independent(gram: np.ndarray, before: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Which columns the fixed effects and the columns before leave something of."""
    keep: list[int] = []
    for k in range(len(gram)):
        rest = gram[k, k]
        if keep:
            rest -= gram[k, keep] @ np.linalg.solve(gram[np.ix_(keep, keep)], gram[keep, k])
        if rest > tol * max(before[k], 1e-300):
            keep.append(k)
    return np.array(keep, int)


def codes(frame: pd.DataFrame, effects: Sequence[str]) -> list[np.ndarray]:
    return [pd.factorize(frame[e], sort=True)[0] for e in effects]


def separated(y: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Rows whose group has no positive flow, found repeatedly."""
    out = np.zeros(len(y), bool)
    while True:
        new = out.copy()
        for g in groups:
            new |= (np.bincount(g, np.where(out, 0.0, y)) <= 0)[g]
        if (new == out).all():
            return out
        out = new


def solve_effects(y: np.ndarray, offset: np.ndarray, groups: list[np.ndarray], tol: float = 1e-13, rounds: int = 100_000) -> np.ndarray:
    """Means ``exp(offset + effects)`` whose sums by each group are those of ``y``, by proportional fitting."""
    mu = np.exp(offset - offset.max())
    totals = [np.bincount(g, y) for g in groups]
    for _ in range(rounds if groups else 0):
        moved = 0.0
        for g, total in zip(groups, totals, strict=True):
            ratio = total / np.bincount(g, mu)
            mu *= ratio[g]
            moved = max(moved, float(np.abs(np.log(ratio)).max()))
        if moved < tol or len(groups) == 1:
            return mu
    if not groups:
        return np.exp(offset)
    raise RuntimeError(f"effects did not settle in {rounds} rounds")


class Block:
    """The rows of one block: flow, regressors (a column each), codes of the effects, clusters."""

    def __init__(self, row: dict, k: int, effects: int):
        self.n, self.dropped = row["n_obs"], row["n_dropped"]
        self.y = np.frombuffer(row["y"])
        self.x = np.frombuffer(row["x"]).reshape(k, self.n).T
        self.groups = list(np.frombuffer(row["codes"], np.int32).reshape(effects, self.n))
        self.cluster = row["cluster"]

    def poisson(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights, regressors less their effects, and residuals, given the coefficients."""
        mu = solve_effects(self.y, self.x @ beta, self.groups) if self.n else self.y
        return mu, absorb(self.x, self.groups, mu, tol=1e-12), self.y - mu

    def linear(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = np.ones(self.n)
        both = absorb(np.column_stack([self.y, self.x]), self.groups, w, tol=1e-12)
        return w, both[:, 1:], both[:, 0] - both[:, 1:] @ beta


def packed(rows: DataFrame, flow: str, names: Sequence[str], effects: Sequence[str], cluster: str | None, keys: Sequence[str], drop: bool) -> DataFrame:
    """One row a block with its columns packed; ``drop``: without rows that the effects separate."""
    schema = pa.schema([("n_obs", pa.int64()), ("n_dropped", pa.int64()), ("y", pa.binary()), ("x", pa.binary()), ("codes", pa.binary()), ("cluster", pa.list_(pa.string()))])
    kinds = dict(rows.dtypes)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values([*effects, *names, flow], kind="stable")
        y = frame[flow].to_numpy(float)
        gone = separated(y, codes(frame, effects)) if drop else np.zeros(len(y), bool)
        frame = frame[~gone]
        one = {
            "n_obs": len(frame), "n_dropped": int(gone.sum()), "y": frame[flow].to_numpy(float).tobytes(), "x": frame[list(names)].to_numpy(float).T.tobytes(),
            "codes": np.array(codes(frame, effects), np.int32).tobytes(), "cluster": frame[cluster].astype(str).tolist() if cluster else None,
        }
        out = pa.Table.from_pylist([one], schema)
        for at, (name, value) in enumerate(zip(keys, key, strict=True)):
            out = out.add_column(at, name, pa.array([value.as_py()], value.type))
        return out

    ddl = [f"`{c}` {kinds[c]}" for c in keys] + ["n_obs long, n_dropped long, y binary, x binary, codes binary, cluster array<string>"]
    return rows.groupBy(*keys).applyInArrow(pack, ", ".join(ddl))


def _block_sums(blocks: DataFrame, by: Sequence[str], betas: dict[tuple, np.ndarray], k: int, effects: int, method: str) -> dict[tuple, dict]:
    """The normal equations of each specification at its coefficients: one pass, sums of blocks by Spark."""
    size = k * k + 2 * k + 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[b] for b in by)
                if key not in betas:
                    continue
                b = Block(row, k, effects)
                w, x, residual = getattr(b, method)(betas[key])
                with np.errstate(divide="ignore", invalid="ignore"):
                    gap = 2 * float(np.where(b.y > 0, b.y * np.log(np.where(b.y > 0, b.y, 1) / w) - residual, w).sum()) if method == "poisson" else float(residual @ residual)
                sums = np.concatenate([(x.T @ (w[:, None] * x)).ravel(), x.T @ residual, (w[:, None] * b.x * b.x).sum(axis=0), [gap, b.n, b.dropped, b.y.sum(), (b.y * b.y).sum(), sum(int(g.max()) + 1 for g in b.groups) - max(0, effects - 1) if b.n else 0]])
                out.append({"key": list(map(str, key)), "sums": sums.tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.list_(pa.string())), ("sums", pa.list_(pa.float64()))]))

    parts = blocks.mapInArrow(run, "key array<string>, sums array<double>")
    added = parts.groupBy("key").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]).collect()  # a row a specification
    found = {}
    for r in added:
        s = np.array([r[f"s{i}"] for i in range(size)])
        gap, n, dropped, total, squares, absorbed = s[k * k + 2 * k :]
        found[tuple(r.key)] = {"gram": s[: k * k].reshape(k, k), "score": s[k * k : k * k + k], "before": s[k * k + k : k * k + 2 * k], "gap": gap, "n": int(n), "dropped": int(dropped), "total": total, "squares": squares, "absorbed": int(absorbed)}
    return {key: found.get(tuple(map(str, key))) for key in betas}


def _newton_step(sums: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """The kept regressors, the step, and what the likelihood gains by it."""
    kept = independent(sums["gram"], sums["before"])
    step = np.zeros(len(sums["score"]))
    if len(kept):
        step[kept] = np.linalg.solve(sums["gram"][np.ix_(kept, kept)], sums["score"][kept])
    return kept, step, float(step @ sums["score"])


def _fit_blocks(blocks: DataFrame, by: Sequence[str], keys: list[tuple], k: int, effects: int, method: str, tol: float, rounds: int = 100) -> dict[tuple, dict]:
    """Newton steps on the sums of blocks, for all specifications at once; a step that makes the deviance worse is halved."""
    betas, out, best, null = {key: np.zeros(k) for key in keys}, {}, {}, {}
    for step_no in range(1, rounds + 1):
        sums = _block_sums(blocks, by, betas, k, effects, method)
        after = {}
        for key, s in sums.items():
            if s is None:
                continue
            if key in best and s["gap"] > best[key][0] * (1 + 1e-9) + 1e-12:
                beta, move, gap = best[key][1], best[key][2] / 2, best[key][0]
                best[key] = gap, beta, move
                after[key] = beta + move
                continue
            kept, move, gain = _newton_step(s)
            settled = abs(gain) <= tol * (abs(s["gap"]) + 0.1)
            out[key] = s | {"null": null.setdefault(key, s["gap"]), "beta": betas[key], "kept": kept, "iterations": step_no, "converged": settled}
            if not settled:
                best[key] = s["gap"], betas[key], move
                after[key] = betas[key] + move
        betas = after
        if not betas:
            break
    return out


def _scores(blocks: DataFrame, by: Sequence[str], fits: dict[tuple, dict], names: Sequence[str], effects: int, method: str, fitted: bool = False) -> DataFrame:
    """Rows of ``by``, ``cluster`` and a score a regressor; ``fitted``: with flow, regressors and fitted value, too."""
    betas = {tuple(map(str, key)): f["beta"] for key, f in fits.items()}
    own = [f"score_{c}" for c in names] + (["y", "fitted", *[f"x_{c}" for c in names]] if fitted else [])
    schema = pa.schema([("key", pa.list_(pa.string())), ("cluster", pa.string()), *[(c, pa.float64()) for c in own]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(str(row[b]) for b in by)
                b = Block(row, len(names), effects)
                if key not in betas or not b.n:
                    continue
                _, x, residual = getattr(b, method)(betas[key])
                columns = list((x * residual[:, None]).T) + ([b.y, b.y - residual, *b.x.T] if fitted else [])
                cluster = pa.array(b.cluster, pa.string()) if b.cluster is not None else pa.nulls(b.n, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([list(key)] * b.n, schema.field(0).type), cluster, *map(pa.array, columns)], schema=schema)

    return blocks.mapInArrow(run, "key array<string>, cluster string, " + ", ".join(f"`{c}` double" for c in own))


def meat(scores: DataFrame, names: Sequence[str], clustered: bool) -> dict[tuple, tuple[np.ndarray, int]]:
    """Sums of outer products of the clusters' (or rows') scores, and their number, by specification."""
    if clustered:
        scores = scores.groupBy("key", "cluster").agg(*[F.sum(f"score_{c}").alias(f"score_{c}") for c in names])
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names))]
    got = scores.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(F.col(f"score_{names[i]}") * F.col(f"score_{names[j]}")).alias(f"m{i}_{j}") for i, j in pairs]).collect()
    return {tuple(r.key): (np.array([r[f"m{i}_{j}"] for i, j in pairs]).reshape(len(names), len(names)), r.n) for r in got}


def _swept(rows: DataFrame, effects: Sequence[str], columns: Sequence[str], weight: str, small: bool = False) -> DataFrame:
    """The columns less their weighted means by each effect in turn.

    Means are written, so that a plan holds each of them once; ``small`` ones (of a
    counted number of levels) are broadcast, and the rows are not moved at all.
    """
    for e in effects:
        means = rows.groupBy(e).agg(*[(F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(f"_m_{c}") for c in columns])
        means = written(means, "means")
        rows = rows.join(F.broadcast(means) if small else means, e).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])
    return rows


def projections(rows: DataFrame, effects: Sequence[str], columns: dict[str, Column], weight: str, tol: float, rounds: int = 500) -> DataFrame:
    """``rows`` with each column less its effects' weighted means, written out.

    A round is two sweeps over the effects. Their changes are compared as weighted sums
    of squares, and the next round starts where the last two changes, taken as a
    geometric series, end. It is over when the second change is below ``tol`` of the column.
    """
    names = list(columns)
    rows = written(rows.withColumns(columns), "projections")
    levels = rows.agg(*[F.approx_count_distinct(e).alias(e) for e in effects]).first() if effects else []
    small = max([0, *levels]) <= BROADCAST_LEVELS
    if len(effects) == 1:
        return written(_swept(rows, effects, names, weight, small), "projections")
    for _ in range(rounds):
        first = _swept(rows.withColumns({f"_a_{c}": F.col(c) for c in names}), effects, names, weight, small)
        second = _swept(first.withColumns({f"_b_{c}": F.col(c) for c in names}), effects, names, weight, small)
        rows = written(second, "projections")
        inner = {}
        for c in names:
            one, two = F.col(f"_b_{c}") - F.col(f"_a_{c}"), F.col(c) - F.col(f"_b_{c}")
            inner |= {f"t_{c}": F.sum(F.col(weight) * two * (two - one)), f"d_{c}": F.sum(F.col(weight) * (two - one) * (two - one)), f"s_{c}": F.sum(F.col(weight) * two * two), f"n_{c}": F.sum(F.col(weight) * F.col(c) * F.col(c))}
        got = rows.agg(*[v.alias(k) for k, v in inner.items()]).first()
        if all((got[f"s_{c}"] or 0) <= tol * tol * max(got[f"n_{c}"] or 0, 1e-300) for c in names):
            return rows.drop(*[f"_{x}_{c}" for x in "ab" for c in names])
        ahead = {c: F.col(c) - F.lit(got[f"t_{c}"] / got[f"d_{c}"] if got[f"d_{c}"] else 0.0) * (F.col(c) - F.col(f"_b_{c}")) for c in names}
        rows = rows.withColumns(ahead).drop(*[f"_{x}_{c}" for x in "ab" for c in names])
    raise RuntimeError(f"projections did not settle in {rounds} rounds")


def _fit_rows(rows: DataFrame, flow: str, names: Sequence[str], effects: Sequence[str], method: str, tol: float, rounds: int = 100) -> tuple[dict, DataFrame]:
    """A fit by projections of the rows: reweighted steps, each with its own tolerance; and the rows with weights, ``_v_`` columns and residuals."""
    k = len(names)
    base = rows.select(F.col(flow).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x_{c}") for c in names], *dict.fromkeys([*effects, *[c for c in rows.columns if c == "_cluster"]]))
    total = base.agg(F.count("*").alias("n"), F.sum("_y").alias("total"), F.sum(F.col("_y") * F.col("_y")).alias("squares")).first()
    poisson = method == "poisson"
    eta = F.log((F.col("_y") + F.lit(total.total / total.n)) / 2) if poisson else F.lit(0.0)
    state, out, before, near = base.withColumn("_eta", eta), {}, None, 1e-3
    for step in range(1, rounds + 1):
        state = state.withColumn("_w", F.exp("_eta") if poisson else F.lit(1.0)).withColumn("_z", F.col("_eta") + (F.col("_y") - F.col("_w")) / F.col("_w") if poisson else F.col("_y"))
        state = projections(state, effects, {"_v": F.col("_z"), **{f"_v_{c}": F.col(f"_x_{c}") for c in names}}, "_w", near if poisson else 1e-11)
        v = [F.col(f"_v_{c}") for c in names]
        sums = {f"g{i}_{j}": F.sum(F.col("_w") * v[i] * v[j]) for i in range(k) for j in range(k)} | {f"r{i}": F.sum(F.col("_w") * v[i] * F.col("_v")) for i in range(k)} | {f"b{i}": F.sum(F.col("_w") * F.col(f"_x_{names[i]}") * F.col(f"_x_{names[i]}")) for i in range(k)}
        got = state.agg(*[c.alias(n) for n, c in sums.items()]).first()
        gram, right = np.array([[got[f"g{i}_{j}"] for j in range(k)] for i in range(k)]), np.array([got[f"r{i}"] for i in range(k)])
        kept, beta = independent(gram, np.array([got[f"b{i}"] for i in range(k)])), np.zeros(k)
        if len(kept):
            beta[kept] = np.linalg.solve(gram[np.ix_(kept, kept)], right[kept])
        residual = F.col("_v")
        for c, b in zip(v, beta, strict=True):
            residual = residual - c * float(b)
        state = state.withColumn("_rest", residual)
        mean = F.exp(F.col("_z") - F.col("_rest")) if poisson else F.lit(1.0)
        gap = F.sum(F.when(F.col("_y") > 0, F.col("_y") * F.log(F.col("_y") / mean) - (F.col("_y") - mean)).otherwise(mean)) * 2 if poisson else F.sum(F.col("_rest") * F.col("_rest"))
        gap = state.agg(gap.alias("gap")).first().gap
        out = {"beta": beta, "kept": kept, "gram": gram, "gap": gap, "n": total.n, "dropped": 0, "total": total.total, "squares": total.squares, "iterations": step, "converged": not poisson}
        if not poisson:
            break
        close = before is not None and abs(before - gap) < tol * (abs(gap) + 0.1)
        if close and near <= 1e-9:
            out["converged"] = True
            break
        near, before = max(1e-10, min(near * 0.05, abs(before - gap) / (abs(gap) + 0.1) if before is not None else near)), gap
        state = state.select("_y", *[f"_x_{c}" for c in names], *dict.fromkeys([*effects, *[c for c in rows.columns if c == "_cluster"]]), (F.col("_z") - F.col("_rest")).alias("_eta"))
    return out, state


def tail(t: float, dof: float | None = None) -> float:
    """Two-sided tail of Student's t, or of the normal law without ``dof``; by the continued fraction of the incomplete beta function."""
    if dof is None:
        return math.erfc(abs(t) / math.sqrt(2))
    a, b, x = dof / 2, 0.5, dof / (dof + t * t)
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    if x <= 0:
        return float(flip)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for m in range(1000):
        for odd in (False, True):
            if odd:
                term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            else:
                term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if m else 1.0
            d = 1 / (1 + term * d) if m or odd else 1.0
            c = 1 + term / c if m else 1.0
            value *= c * d
        if m and abs(c * d - 1) < 1e-15:
            break
    got = front * value
    return 1 - got if flip else got


def quantile(p: float, dof: float | None = None) -> float:
    """The t with a two-sided tail of ``p``, by bisection."""
    lo, hi = 0.0, 1.0
    while tail(hi, dof) > p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid, dof) > p else (lo, mid)
    return hi


def _row(fit: dict | None, spread: tuple[np.ndarray, int] | None, names: Sequence[str], effects: int, cluster: str | None, method: str, level: float) -> dict:
    """One row of estimates from a fit and its scores."""
    out = {"n_obs": 0, "n_dropped": 0, "converged": False, "iterations": 0, "fit": math.nan, "pseudo_r2": math.nan, "aic": math.nan} | {f"{s}_{c}": math.nan for c in names for s in ("coef", "se", "p", "lo", "hi")}
    if fit is None or not fit["n"]:
        return out | {"n_dropped": fit["dropped"] if fit else 0}
    kept, n, k = fit["kept"], fit["n"], len(fit["kept"])
    bread = np.linalg.pinv(fit["gram"][np.ix_(kept, kept)])
    poisson, absorbed = method == "poisson", fit.get("absorbed", 0)
    if cluster or poisson:
        outer, g = spread
        factor = g / max(1, g - 1) * (n - 1) / max(1, n - k) if cluster else n / max(1, n - k)
        errors, dof = np.sqrt(np.diag(bread @ outer[np.ix_(kept, kept)] @ bread) * factor), g - 1 if cluster else None
    else:
        dof = max(1, n - k - absorbed)
        errors = np.sqrt(np.diag(bread) * fit["gap"] / dof)
    reach = quantile(1 - level, dof)
    for at, se in zip(kept, errors, strict=True):
        c, b = names[at], float(fit["beta"][at])
        out |= {f"coef_{c}": b, f"se_{c}": float(se), f"p_{c}": tail(b / se, dof) if se else math.nan, f"lo_{c}": b - reach * se, f"hi_{c}": b + reach * se}
    centred = fit["squares"] - fit["total"] ** 2 / n
    out |= {"n_obs": n, "n_dropped": fit["dropped"], "converged": bool(fit["converged"]), "iterations": fit["iterations"]}
    if poisson:
        return out | {"fit": fit["gap"], "pseudo_r2": 1 - fit["gap"] / fit["null"] if fit.get("null") else math.nan, "aic": fit["gap"] + 2 * (k + absorbed) if absorbed else math.nan}
    return out | {"fit": 1 - fit["gap"] / centred if centred else math.nan, "aic": n * math.log(fit["gap"] / n) + 2 * (k + absorbed) if fit["gap"] > 0 and absorbed else math.nan}


def _prepared(panel: DataFrame, spec: GravitySpec, cluster: str | None, by: Sequence[str]) -> DataFrame:
    """The sample: finite flows and regressors, effects, and the cluster's key as ``_cluster``."""
    known = {None: None, "pair": F.col("pair_id").cast("string"), "exp-imp-time": F.concat_ws("|", "oy", "dy")}
    if cluster not in known:
        raise ValueError(f"unknown cluster {cluster!r}")
    need = dict.fromkeys([*by, *spec.within, spec.flow, *spec.regressors, *spec.effects()])
    rows = panel.select(*need, *([known[cluster].alias("_cluster")] if cluster else [])).dropna(subset=[spec.flow, *spec.regressors])
    for c in (spec.flow, *spec.regressors):
        rows = rows.where(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")))
    return rows


def _nested(rows: DataFrame, effects: Sequence[str], by: Sequence[str], keys: Sequence[str]) -> bool:
    """Whether no effect's level crosses a block, and no block is too large for a task; one job."""
    block = F.struct(F.lit(0), *keys).alias("block")
    largest = rows.groupBy(*keys).count().agg((F.max("count") > BLOCK_ROWS).alias("no"))
    if len(keys) > len(by):
        levels = F.explode(F.array(*[F.struct(F.lit(k).alias("effect"), F.col(e).cast("string").alias("level")) for k, e in enumerate(effects)])).alias("at")
        spans = rows.select(*by, block, levels).groupBy(*by, "at").agg(F.min("block").alias("a"), F.max("block").alias("b"))
        largest = largest.union(spans.agg(F.max(F.col("a") != F.col("b")).alias("no")))
    return not any(r.no for r in largest.collect())


def estimate(panel: DataFrame, spec: GravitySpec, cluster: str | None = "pair", method: str = "ppml", by: tuple[str, ...] = (), level: float = 0.95, tol: float = 1e-12) -> DataFrame:
    """One row of estimates for each group of ``by`` (a sweep), or for the whole panel.

    ``cluster``: None, ``pair`` or ``exp-imp-time`` (origin-year by destination-year);
    with ``home`` among the regressors its multiplier exp(coef) is added. Columns:
    ``n_obs, n_dropped, converged, iterations, fit`` (deviance, or R squared), ``pseudo_r2``
    (deviance against that of effects alone), ``aic`` (up to a constant of the sample) and for each regressor
    ``coef, se, p, lo, hi``. ``spec.within`` names the columns that make a block.
    """
    if method not in ("ppml", "ols"):
        raise ValueError(f"unknown method {method!r}")
    names, effects, how = list(spec.regressors), spec.effects(), "poisson" if method == "ppml" else "linear"
    rows = written(_prepared(panel, spec, cluster, by), "sample")
    fits, spreads = _estimates(rows, spec, cluster, how, by, tol)
    out = []
    for key in sorted(fits, key=str):
        found = _row(fits[key], spreads.get(tuple(map(str, key))), names, len(effects), cluster, how, level)
        if "home" in names:
            found["home_multiplier"] = math.exp(found["coef_home"])
        out.append((*key, *(None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, float) else v for v in found.values())))
    kinds = dict(rows.dtypes)
    ddl = [f"`{b}` {kinds[b]}" for b in by] + ["n_obs long, n_dropped long, converged boolean, iterations long, fit double, pseudo_r2 double, aic double"] + [f"{s}_{c} double" for c in names for s in ("coef", "se", "p", "lo", "hi")] + (["home_multiplier double"] if "home" in names else [])
    return rows.sparkSession.createDataFrame(out, ", ".join(ddl))


def _estimates(rows: DataFrame, spec: GravitySpec, cluster: str | None, how: str, by: tuple[str, ...], tol: float) -> tuple[dict, dict]:
    names, effects = list(spec.regressors), spec.effects()
    keys = [tuple(r) for r in rows.select(*by).distinct().collect()] if by else [()]  # specifications
    years = [*by, *[c for c in spec.within if c not in by]]
    blocks = next((keys for keys in (years, list(by)) if _nested(rows, effects, by, keys)), None) if effects else None
    if blocks is not None:
        table = written(packed(rows, spec.flow, names, effects, "_cluster" if cluster else None, blocks, how == "poisson"), "blocks")
        fits = _fit_blocks(table, by, keys, len(names), len(effects), how, tol)
        spreads = meat(_scores(table, by, fits, names, len(effects), how), names, bool(cluster)) if cluster or how == "poisson" else {}
        return {key: fits.get(key) for key in keys}, spreads
    fits, spreads = {}, {}
    for key in keys:  # a specification of a sweep at a time
        part = rows
        for b, value in zip(by, key, strict=True):
            part = part.where(F.col(b).eqNullSafe(F.lit(value)))
        n = part.count()
        if how == "poisson" and effects:
            part = separated_rows(part, spec.flow, effects)
        held = tuple(effects)
        if not held:
            part, held = part.withColumn("_one", F.lit(0)), ("_one",) if how == "linear" else ()
        if not part.limit(1).count():
            fits[key] = {"n": 0, "dropped": n}
            continue
        fit, state = _fit_rows(part, spec.flow, names, held, how, max(tol, 1e-10))
        fits[key] = fit | {"dropped": n - fit["n"]} | {"absorbed": sum(state.select(e).distinct().count() for e in held) - max(0, len(held) - 1)}
        score = {f"score_{c}": F.col("_w") * F.col(f"_v_{c}") * F.col("_rest") for c in names}
        scores = state.select(F.array(*[F.lit(str(x)) for x in key]).cast("array<string>").alias("key"), F.col("_cluster").alias("cluster") if cluster else F.lit(None).cast("string").alias("cluster"), *[v.alias(c) for c, v in score.items()])
        spreads |= meat(scores, names, bool(cluster))
    return fits, spreads


def margins(panel: DataFrame, spec: GravitySpec, method: str = "ppml", tol: float = 1e-14) -> DataFrame:
    """First-order conditions of a fit: ``kind, observed, fitted``, parts of the total flow by level of an effect and by regressor.

    At the estimates the fitted values have the flows' totals in each level of each effect
    and against each regressor; for a concave likelihood nothing else has.
    """
    names, effects, how = list(spec.regressors), spec.effects(), "poisson" if method == "ppml" else "linear"
    rows = written(_prepared(panel, spec, None, ()), "sample")
    parts = []
    for e in effects:  # the effect's level takes the cluster's place in the packed rows
        table = written(packed(rows.withColumn("_level", F.col(e)), spec.flow, names, effects, "_level", spec.within, how == "poisson"), "blocks")
        fits = _fit_blocks(table, (), [()], len(names), len(effects), how, tol)
        values = _scores(table, (), fits, names, len(effects), how, fitted=True)
        parts.append(values.groupBy(F.concat(F.lit(f"{e}:"), "cluster").alias("kind")).agg(F.sum("y").alias("observed"), F.sum("fitted").alias("fitted")))
    for c in names:
        parts.append(values.agg(F.sum(F.col("y") * F.col(f"x_{c}")).alias("observed"), F.sum(F.col("fitted") * F.col(f"x_{c}")).alias("fitted")).select(F.lit(c).alias("kind"), "observed", "fitted"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = rows.agg(F.sum(spec.flow)).first()[0]
    return out.select("kind", *[(F.col(c) / total).alias(c) for c in ("observed", "fitted")])


def sweep(panel: DataFrame, grid: list[dict], spec: GravitySpec, cluster: str | None = "pair", method: str = "ppml") -> DataFrame:
    """One estimate for each row of a grid ``{spec, distance, intra}``.

    ``distance`` names the distance column; ``intra`` False leaves domestic rows out. The
    grid is joined to the panel in one plan, and its rows are fitted side by side.
    """
    stacked = None
    for g in grid:
        rows = panel if g.get("intra", True) else panel.where("home = 0")
        one = rows.where(F.col(g["distance"]) > 0).withColumn("log_d", F.log(F.col(g["distance"]))).withColumn("spec", F.lit(g["spec"]))
        stacked = one if stacked is None else stacked.unionByName(one)
    return estimate(stacked, spec, cluster, method, ("spec",))


def benchmark(panel: DataFrame, distances: list[str], spec: GravitySpec) -> DataFrame:
    """The same specification with each distance variant."""
    return sweep(panel, [{"spec": d, "distance": d} for d in distances], spec)


def choose_spec(max_sd: float, spec: GravitySpec) -> GravitySpec:
    """Drops the pair effect where a distance doesn't vary within pairs."""
    return spec if max_sd >= 1e-6 else replace(spec, pair=False)


def separated_rows(panel: DataFrame, flow: str, effects: Sequence[str]) -> DataFrame:
    """The panel without rows whose fixed-effect group has no positive flow, as a relational filter, repeated until it drops none."""
    n = panel.count()
    while True:
        for e in effects:
            live = panel.groupBy(e).agg(F.sum(flow).alias("_s")).where("_s > 0").select(e)
            panel = panel.join(live, e, "left_semi")
        panel = written(panel, "separated")
        now = panel.count()
        if now == n:
            return panel
        n = now


def two_way_balanced(panel: DataFrame, y: str, x: str, row: str, column: str) -> DataFrame:
    """Slope of two-way fixed-effects OLS on a balanced panel, in closed form and in SQL alone."""
    means = panel
    for key, suffix in (((row,), "r"), ((column,), "c")):
        means = means.join(panel.groupBy(*key).agg(F.avg(y).alias(f"y_{suffix}"), F.avg(x).alias(f"x_{suffix}")), list(key))
    grand = panel.agg(F.avg(y).alias("y_g"), F.avg(x).alias("x_g"))
    means = means.join(F.broadcast(grand))  # one row
    ty = F.col(y) - F.col("y_r") - F.col("y_c") + F.col("y_g")
    tx = F.col(x) - F.col("x_r") - F.col("x_c") + F.col("x_g")
    return means.agg((F.sum(tx * ty) / F.sum(tx * tx)).alias("slope"), F.count("*").alias("n_obs"))


def pruned(panel: DataFrame) -> DataFrame:
    """Drops origin-years, then destination-years, of one row."""
    return drop_singletons(panel, "oy", "dy")
