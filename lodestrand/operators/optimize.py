"""Minimisers in numpy: downhill simplex for one function or for many at once, and bounded search in one dimension."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def simplex(f: Callable[[np.ndarray], float], start: list[float], max_iter: int = 50_000, xtol: float = 1e-4, ftol: float = 1e-4) -> tuple[np.ndarray, float]:
    """The point that the downhill simplex method ends at, and f there.

    First steps are five percent of each coordinate (0.00025 for zero ones).
    """
    x0 = np.asarray(start, dtype=float)
    points = [x0]
    for i in range(len(x0)):
        y = x0.copy()
        y[i] = y[i] * 1.05 if y[i] else 0.00025
        points.append(y)
    pts = np.array(points)
    val = np.array([f(p) for p in pts])
    for _ in range(max_iter):
        order = np.argsort(val, kind="stable")
        pts, val = pts[order], val[order]
        if np.abs(pts[1:] - pts[0]).max() <= xtol and np.abs(val[1:] - val[0]).max() <= ftol:
            break
        centre = pts[:-1].mean(axis=0)
        away = centre - pts[-1]
        r = centre + away
        fr = f(r)
        if fr < val[0]:
            e = centre + 2 * away
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = centre + (0.5 if fr < val[-1] else -0.5) * away
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                val[1:] = [f(p) for p in pts[1:]]
    best = int(val.argmin())
    return pts[best], float(val[best])


def bounded(f: Callable[[float], float], low: float, high: float, tol: float = 1e-5, max_iter: int = 500) -> tuple[float, float]:
    """The least point of f between bounds, by golden sections and parabolas (Brent)."""
    golden = (3 - math.sqrt(5)) / 2
    a, b = low, high
    x = w = v = a + golden * (b - a)
    fx = fw = fv = f(x)
    step = before = 0.0
    for _ in range(max_iter):
        mid = 0.5 * (a + b)
        small = 1.5e-8 * abs(x) + tol / 3
        if abs(x - mid) <= 2 * small - 0.5 * (b - a):
            break
        plain = True
        if abs(before) > small:
            r = (x - w) * (fx - fv)
            q = (x - v) * (fx - fw)
            p = (x - v) * q - (x - w) * r
            q = 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(0.5 * q * before) and q * (a - x) < p < q * (b - x):
                before, step = step, p / q
                if min(x + step - a, b - x - step) < 2 * small:
                    step = math.copysign(small, mid - x)
                plain = False
        if plain:
            before = (a if x >= mid else b) - x
            step = golden * before
        u = x + (step if abs(step) >= small else math.copysign(small, step or 1))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, w, x, fv, fw, fx = w, x, u, fw, fx, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, w, fv, fw = w, u, fw, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx


def simplex_many(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, max_iter: int = 50_000, xtol: float = 1e-4, ftol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """simplex() for as many functions as start has rows, all worked on together.

    f gets numbers of functions and a point for each, and gives their values.
    """
    n, d = start.shape
    pts = np.repeat(start[:, None, :].astype(float), d + 1, axis=1)
    for i in range(d):
        pts[:, i + 1, i] = np.where(start[:, i] != 0, start[:, i] * 1.05, 0.00025)
    every = np.arange(n)
    val = np.stack([f(every, pts[:, i]) for i in range(d + 1)], axis=1)
    left = every
    for _ in range(max_iter):
        order = np.argsort(val[left], axis=1, kind="stable")
        pts[left], val[left] = np.take_along_axis(pts[left], order[:, :, None], axis=1), np.take_along_axis(val[left], order, axis=1)
        p, v = pts[left], val[left]
        done = (np.abs(p[:, 1:] - p[:, :1]).max(axis=(1, 2)) <= xtol) & (np.abs(v[:, 1:] - v[:, :1]).max(axis=1) <= ftol)
        left, p, v = left[~done], p[~done], v[~done]
        if not len(left):
            break
        centre = p[:, :-1].mean(axis=1)
        away = centre - p[:, -1]
        r = centre + away
        fr = f(left, r)
        better, fair = fr < v[:, 0], (fr >= v[:, 0]) & (fr < v[:, -2])
        # a second point: twice as far where the first was best, half as far on the better side where it was bad
        t = np.where(better, 2.0, np.where(fr < v[:, -1], 0.5, -0.5))
        second = centre + t[:, None] * away
        fs = np.full(len(left), np.inf)
        ask = np.flatnonzero(~fair)
        fs[ask] = f(left[ask], second[ask])
        use = np.where(better, fs < fr, ~fair & (fs < np.minimum(fr, v[:, -1])))
        shrink = ~better & ~fair & ~use
        new, fn = np.where(use[:, None], second, r), np.where(use, fs, fr)
        keep = np.flatnonzero(~shrink)
        pts[left[keep], -1], val[left[keep], -1] = new[keep], fn[keep]
        if shrink.any():
            k = left[shrink]
            pts[k, 1:] = pts[k, :1] + 0.5 * (pts[k, 1:] - pts[k, :1])
            for i in range(1, d + 1):
                val[k, i] = f(k, pts[k, i])
    best = val.argmin(axis=1)
    return pts[every, best], val[every, best]
