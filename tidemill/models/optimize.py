"""Minimisers for objectives of a few parameters; the objective may be an aggregate over a distributed table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def gradient(f: Callable, x: np.ndarray) -> np.ndarray:
    """Five-point numerical gradient."""
    x = np.asarray(x, float)
    out = np.empty(len(x))
    for i in range(len(x)):
        h = 1e-4 * max(1.0, abs(x[i]))
        e = np.zeros(len(x))
        e[i] = h
        out[i] = (f(x - 2 * e) - 8 * f(x - e) + 8 * f(x + e) - f(x + 2 * e)) / (12 * h)
    return out


def jacobian(f: Callable, x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    columns = []
    for i in range(len(x)):
        h = 1e-5 * max(1.0, abs(x[i]))
        e = np.zeros(len(x))
        e[i] = h
        columns.append((np.asarray(f(x + e)) - np.asarray(f(x - e))) / (2 * h))
    return np.column_stack(columns)


def hessian(f: Callable, x: np.ndarray) -> np.ndarray:
    h = jacobian(lambda v: gradient(f, v), x)
    return (h + h.T) / 2


def _result(par, value, converged, iterations, message="") -> dict:
    return dict(par=np.asarray(par, float), value=float(value), converged=bool(converged), iterations=iterations, message=message or ("converged" if converged else "iteration limit"))


def _bfgs(f, x, max_iter, tol, lower, upper, grad) -> dict:
    """BFGS; with bounds, steps are projected and variables held at a bound leave the quasi-Newton model."""
    lower = np.full(len(x), -np.inf) if lower is None else np.broadcast_to(np.asarray(lower, float), x.shape)
    upper = np.full(len(x), np.inf) if upper is None else np.broadcast_to(np.asarray(upper, float), x.shape)
    grad = grad or (lambda v: gradient(f, v))
    x = np.clip(x, lower, upper)
    inverse, value, g = np.eye(len(x)), f(x), grad(x)
    for it in range(1, max_iter + 1):
        held = (x <= lower) & (g > 0) | (x >= upper) & (g < 0)
        if np.abs(np.where(held, 0, g)).max(initial=0) < tol:
            return _result(x, value, True, it)
        step = np.where(held, 0, -inverse @ np.where(held, 0, g))
        if step @ g >= 0:
            inverse, step = np.eye(len(x)), np.where(held, 0, -g)
        rate = 1.0
        while rate > 1e-14:
            new = np.clip(x + rate * step, lower, upper)
            new_value = f(new)
            if new_value <= value + 1e-4 * g @ (new - x) and np.isfinite(new_value):
                break
            rate /= 2
        else:
            return _result(x, value, np.abs(np.where(held, 0, g)).max() < np.sqrt(tol), it, "no descent")
        new_g = grad(new)
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            rho = 1 / (s @ y)
            a = np.eye(len(x)) - rho * np.outer(s, y)
            inverse = a @ inverse @ a.T + rho * np.outer(s, s)
        if abs(value - new_value) < 1e-14 * max(1.0, abs(value)) and np.abs(s).max() < 1e-10:
            return _result(new, new_value, True, it)
        x, value, g = new, new_value, new_g
    return _result(x, value, False, max_iter)


def _nelder_mead(f, x, max_iter, tol) -> dict:
    n = len(x)
    points = [x] + [x + np.eye(n)[i] * (0.1 * abs(x[i]) or 0.1) for i in range(n)]
    values = [f(p) for p in points]
    for it in range(1, max_iter + 1):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tol * max(1.0, abs(values[0])) and max(np.abs(p - points[0]).max() for p in points) < np.sqrt(tol):
            return _result(points[0], values[0], True, it)
        centre, worst = np.mean(points[:-1], axis=0), points[-1]
        tried = centre + (centre - worst)
        v = f(tried)
        if v < values[0]:
            far = centre + 2 * (centre - worst)
            fv = f(far)
            points[-1], values[-1] = (far, fv) if fv < v else (tried, v)
        elif v < values[-2]:
            points[-1], values[-1] = tried, v
        else:
            near = centre + 0.5 * ((tried if v < values[-1] else worst) - centre)
            nv = f(near)
            if nv < min(v, values[-1]):
                points[-1], values[-1] = near, nv
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    i = int(np.argmin(values))
    return _result(points[i], values[i], False, max_iter)


def minimize(f: Callable, start, method: str = "bfgs", max_iter: int = 500, tol: float = 1e-8, lower=None, upper=None, grad: Callable | None = None) -> dict:
    """``bfgs``, ``l-bfgs-b`` (with bounds) or ``nelder-mead``."""
    x = np.asarray(start, float)
    if method.lower() == "nelder-mead":
        return _nelder_mead(f, x, max_iter, tol)
    if method.lower() not in ("bfgs", "l-bfgs-b"):
        raise ValueError(f"no method {method}")
    return _bfgs(f, x, max_iter, max(tol, 1e-7), lower, upper, grad)


def least_squares(residuals: Callable, start, max_iter: int = 200, tol: float = 1e-10) -> dict:
    """Nonlinear least squares by Levenberg-Marquardt, with standard errors."""
    x, damp = np.asarray(start, float), 1e-3
    r = np.asarray(residuals(x))
    value, converged = r @ r, False
    for it in range(1, max_iter + 1):
        j = jacobian(residuals, x)
        a, g = j.T @ j, j.T @ r
        step = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g)
        new_r = np.asarray(residuals(x + step))
        if new_r @ new_r < value:
            done = value - new_r @ new_r <= tol * value
            x, r, value, damp = x + step, new_r, new_r @ new_r, damp / 10
            if done:
                converged = True
                break
        else:
            damp *= 10
            if damp > 1e12:
                converged = True
                break
    j = jacobian(residuals, x)
    dof = max(len(r) - len(x), 1)
    out = _result(x, value, converged, it)
    return out | dict(std_error=np.sqrt(np.diag(np.linalg.pinv(j.T @ j) * value / dof)))


def maximum_likelihood(negative_log_lik: Callable, start, **options) -> dict:
    """Estimates with standard errors from the numerical Hessian."""
    out = minimize(negative_log_lik, start, **options)
    cov = np.linalg.pinv(hessian(negative_log_lik, out["par"]))
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    return out | dict(std_error=se, log_lik=-out["value"], aic=2 * out["value"] + 2 * len(se))
