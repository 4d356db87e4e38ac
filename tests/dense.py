"""Whole-panel estimators in plain numpy, which the distributed ones are held against."""

from collections.abc import Sequence

import numpy as np
import pandas as pd

from terraflux.operators.gravity import absorb, codes, independent, separated


def clustered(x: np.ndarray, w: np.ndarray, residual: np.ndarray, bread: np.ndarray, cluster: np.ndarray | None, dof: int) -> np.ndarray:
    """Standard errors: by cluster with the factor G/(G-1) (N-1)/(N-k), or by row (HC1) without one."""
    n = len(x)
    score = x * (w * residual)[:, None]
    if cluster is None:
        factor = n / max(1, n - dof)
    else:
        code = np.unique(cluster, return_inverse=True)[1]
        score = np.stack([np.bincount(code, score[:, k]) for k in range(x.shape[1])], axis=1)
        g = len(score)
        factor = g / max(1, g - 1) * (n - 1) / max(1, n - dof)
    return np.sqrt(np.diag(bread @ (score.T @ score) @ bread) * factor)


def _empty(names: Sequence[str]) -> dict:
    return {"n_obs": 0, "n_dropped": 0, "converged": False, "iterations": 0, "fit": float("nan")} | {f"{s}_{c}": float("nan") for c in names for s in ("coef", "se")}


def ppml(frame: pd.DataFrame, flow: str, names: Sequence[str], effects: Sequence[str], cluster: str | None, tol: float = 1e-8, rounds: int = 50) -> dict:
    """One Poisson fit; ``fit`` is the deviance."""
    frame = frame.sort_values([*effects, *names, flow], kind="stable")
    y = frame[flow].to_numpy(float)
    gone = separated(y, codes(frame, effects))
    frame, y = frame[~gone], y[~gone]
    out = _empty(names) | {"n_obs": len(y), "n_dropped": int(gone.sum())}
    if not len(y):
        return out
    groups, x = codes(frame, effects), frame[list(names)].to_numpy(float)
    unit = y.mean()
    y = y / unit
    mu = (y + y.mean()) / 2
    eta, deviance = np.log(mu), np.inf
    kept, beta, demeaned = np.arange(len(names)), np.zeros(len(names)), x
    for step in range(1, rounds + 1):
        z = eta + (y - mu) / mu
        both = absorb(np.column_stack([z, x]), groups, mu, tol=1e-11)
        zt, demeaned = both[:, 0], both[:, 1:]
        gram = demeaned.T @ (mu[:, None] * demeaned)
        kept = independent(gram, (mu[:, None] * x * x).sum(axis=0))
        beta = np.linalg.solve(gram[np.ix_(kept, kept)], demeaned[:, kept].T @ (mu * zt)) if len(kept) else np.empty(0)
        residual = zt - demeaned[:, kept] @ beta
        eta = z - residual
        mu = np.exp(np.clip(eta, -700, 700))
        with np.errstate(divide="ignore", invalid="ignore"):
            now = 2 * float(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu) - (y - mu), mu).sum())
        out["iterations"] = step
        if abs(deviance - now) < tol * (abs(now) + 0.1):
            out["converged"] = True
            break
        deviance = now
    demeaned = absorb(x, groups, mu, tol=1e-11)[:, kept]
    bread = np.linalg.pinv(demeaned.T @ (mu[:, None] * demeaned))
    se = clustered(demeaned, mu, (y - mu) / mu, bread, frame[cluster].to_numpy() if cluster else None, len(kept))
    for k, b, s in zip(kept, beta, se, strict=True):
        out |= {f"coef_{names[k]}": float(b), f"se_{names[k]}": float(s)}
    return out | {"fit": now * unit}


def ols(frame: pd.DataFrame, flow: str, names: Sequence[str], effects: Sequence[str], cluster: str | None) -> dict:
    """One least-squares fit; ``fit`` is R squared. Collinear columns are dropped."""
    frame = frame.sort_values([*effects, *names, flow], kind="stable")
    y, x, groups = frame[flow].to_numpy(float), frame[list(names)].to_numpy(float), codes(frame, effects)
    out = _empty(names) | {"n_obs": len(y), "converged": True, "iterations": 1}
    if not len(y):
        return out
    w = np.ones(len(y))
    both = absorb(np.column_stack([y, x]), groups, w) if groups else np.column_stack([y, x]) - np.column_stack([y, x]).mean(axis=0)
    gram = both[:, 1:].T @ both[:, 1:]
    kept = independent(gram, (x * x).sum(axis=0))
    xt = both[:, 1:][:, kept]
    beta = np.linalg.solve(gram[np.ix_(kept, kept)], xt.T @ both[:, 0]) if len(kept) else np.empty(0)
    residual = both[:, 0] - xt @ beta
    bread = np.linalg.pinv(xt.T @ xt)
    absorbed = sum(int(g.max()) + 1 for g in groups) - max(0, len(groups) - 1) if groups else 1
    if cluster:
        se = clustered(xt, w, residual, bread, frame[cluster].to_numpy(), len(kept))
    else:
        se = np.sqrt(np.diag(bread) * float(residual @ residual) / max(1, len(y) - len(kept) - absorbed))
    for k, b, s in zip(kept, beta, se, strict=True):
        out |= {f"coef_{names[k]}": float(b), f"se_{names[k]}": float(s)}
    spread = float(((y - y.mean()) ** 2).sum())
    return out | {"fit": 1 - float(residual @ residual) / spread if spread else float("nan")}
