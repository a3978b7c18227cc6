"""Distances of blocks of queries to Arrow batches of vectors in NumPy, with the sums in the order of the column functions.

A rough score of all pairs (a matrix product, or a sum over the dimensions) leaves out what can't be among the k nearest;
what is left is scored exactly, term by term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Numbers of a tile of scores, and pairs that are scored exactly at a time.
TILE, EXACT = 1 << 15, 1 << 16
#: How far a rough score may be off, against the largest term that went into it.
ROUGH = 1e-9

Terms = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _js(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = (a + b) / 2
    return np.where(a > 0, a * np.log(a / m), 0.0) + np.where(b > 0, b * np.log(b / m), 0.0)


def _power(p: float) -> Terms:
    def term(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = np.abs(a - b)
        return x * x * x if p == 3 else x**p

    return term


_L2: Terms = lambda a, b: (a - b) * (a - b)
_L1: Terms = lambda a, b: np.abs(a - b)
_MIN: Terms = lambda a, b: np.minimum(a, b)
_IP: Terms = lambda a, b: a * b

#: Metrics that are a sum of terms, and those that are the quotient of two such sums.
_SUMS: dict[str, Terms] = {"l2": _L2, "ip": _IP, "l1": _L1, "jensen_shannon": _js, "canberra": lambda a, b: np.abs(a - b) / (np.abs(a) + np.abs(b))}
_QUOTIENTS: dict[str, tuple[Terms, Terms]] = {"bray_curtis": (_L1, lambda a, b: np.abs(a + b)), "jaccard": (_MIN, lambda a, b: np.maximum(a, b))}


def known(name: str) -> bool:
    return name in _SUMS or name in _QUOTIENTS or name in ("lp", "linf", "nan_euclidean")


def exact(name: str, q: np.ndarray, x: np.ndarray, arg: float = 2.0, cuts: list[int] | None = None) -> np.ndarray:
    """The metric over the first axis, of arrays (d, ...) that broadcast: terms are added in index order, as
    functions.vectors does. cuts: where slices of the dimensions begin and end, whose sums are added."""
    if name == "lp":
        term = _power(arg)
    elif name in _SUMS:
        term = _SUMS[name]
    elif name in _QUOTIENTS:
        above, below = (_sum(t, q, x) for t in _QUOTIENTS[name])
        return above / np.where(below == 0, np.nan, below)
    elif name == "linf":
        out = np.abs(q[0] - x[0])
        for a, b in zip(q[1:], x[1:], strict=True):
            np.maximum(out, np.abs(a - b), out=out)
        return out
    else:  # nan_euclidean
        n = _sum(lambda a, b: (~(np.isnan(a) | np.isnan(b))).astype(np.float64), q, x)
        return len(q) / np.where(n == 0, np.nan, n) * _sum(lambda a, b: np.where(np.isnan(a) | np.isnan(b), 0.0, (a - b) * (a - b)), q, x)
    total = sum((_sum(term, q[a:b], x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b), 0.0) if cuts else _sum(term, q, x)
    return total / 2 if name == "jensen_shannon" else total


def _sum(term: Terms, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(np.broadcast_shapes(q.shape[1:], x.shape[1:]))
    for a, b in zip(q, x, strict=True):
        out += term(a, b)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1.0))


def rough(name: str, q: np.ndarray, x: np.ndarray, arg: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(scores of all queries (n, d) against all rows (m, d), how far each query's may be off)."""
    if name in ("l2", "ip"):
        d = q @ x.T
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        if name == "l2":
            d *= -2
            d += qq[:, None]
            d += xx[None]
        return d, ROUGH * (qq + (np.nanmax(xx) if len(xx) else 0.0))
    qt, xt = np.ascontiguousarray(q.T)[:, :, None], np.ascontiguousarray(x.T)[:, None, :]
    if name in ("jaccard", "jensen_shannon") and not (q.min(initial=0.0) >= 0 and x.min(initial=0.0) >= 0):
        return exact(name, qt, xt, arg), np.zeros(len(q))
    if name == "jaccard":
        low = _sum(_MIN, qt, xt)
        d = low / (q.sum(1)[:, None] + x.sum(1)[None] - low)
        return d, np.full(len(q), ROUGH)
    if name == "jensen_shannon":
        own = _xlogx(q).sum(1)[:, None] + _xlogx(x).sum(1)[None]

        def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            s = a + b
            return s * np.log(np.where(s > 0, s, 2.0) / 2)

        d = (own - _sum(both, qt, xt)) / 2
        return d, ROUGH * (1 + np.abs(q).sum(1) + (np.nanmax(np.abs(x).sum(1)) if len(x) else 0.0))
    return exact(name, qt, xt, arg), np.zeros(len(q))


def rounded(d: np.ndarray, digits: int | None) -> np.ndarray:
    """Half up, as Spark and SQL round."""
    if digits is None:
        return d
    return np.sign(d) * np.floor(np.abs(d) * 10.0**digits + 0.5) / 10.0**digits


def within(q: np.ndarray, x: np.ndarray, radius: float, name: str, greater: bool, arg: float = 2.0, digits: int | None = 6) -> Iterator:
    """(queries, rows, distances) of all pairs that may be inside the radius once they are rounded, some EXACT at a time:
    what a rough score doesn't leave out, by its exact distance."""
    fast = name in ("l2", "ip")
    wide = 4096 if fast else max(1, TILE // 16)
    slack = 0.0 if digits is None else 10.0**-digits
    with np.errstate(all="ignore"):
        for lo in range(0, len(x), wide):
            rows = x[lo : lo + wide]
            tall = max(1, ((1 << 20) if fast else TILE) // len(rows))
            for a in range(0, len(q), tall):
                d, off = rough(name, q[a : a + tall], rows, arg)
                edge = (slack + 2 * off)[:, None]
                # what is no number is decided by the exact distance
                i, j = np.nonzero(~(d < radius - edge if greater else d > radius + edge))
                for b in range(0, len(i), EXACT):
                    own, at = a + i[b : b + EXACT], j[b : b + EXACT]
                    yield own, lo + at, exact(name, q[own].T, rows[at].T, arg)


class Nearest:
    """The k best of every query among the batches met so far: by rounded distance, then id."""

    def __init__(self, q: np.ndarray, k: int, name: str, greater: bool, arg: float = 2.0, digits: int | None = 6, cuts: list[int] | None = None) -> None:
        self.q, self.k, self.name, self.greater, self.arg, self.digits, self.cuts = q, k, name, greater, arg, digits, cuts
        self.at, self.ids, self.d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        #: What a pair may score at most; for greater metrics, scores are negated.
        self.bound = np.full(len(q), np.inf)

    def meet(self, ids: np.ndarray, x: np.ndarray, own: np.ndarray | None = None, admit: Callable | None = None) -> None:
        """own: the queries that the rows are for, all if None. admit(queries, rows): which pairs may be results."""
        own = np.arange(len(self.q)) if own is None else own
        wide = max(1, TILE // 16) if self.name not in ("l2", "ip") else 4096
        for lo in range(0, len(ids), wide):
            self._tile(np.arange(lo, min(lo + wide, len(ids))), ids, x, own, admit)

    def _tile(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, admit: Callable | None) -> None:
        ids, x = ids[rows], x[rows]
        tall = max(1, (TILE if self.name not in ("l2", "ip") else 1 << 20) // len(ids))
        slack = 0.0 if self.digits is None else 10.0**-self.digits
        new, held = [], 0
        with np.errstate(all="ignore"):
            for lo in range(0, len(own), tall):
                at = own[lo : lo + tall]
                d, off = rough(self.name, self.q[at], x, self.arg)
                if self.greater:
                    d = -d
                ok = None if admit is None else admit(at, rows)
                if ok is not None:
                    d[~ok] = np.inf
                bound = self.bound[at]
                open_ = np.flatnonzero(np.isinf(bound)) if len(ids) > self.k else []
                if len(open_):
                    # this tile's own k-th is a bound; scores that aren't numbers come last
                    bound[open_] = np.nan_to_num(np.partition(d[open_], self.k - 1, axis=1)[:, self.k - 1], nan=np.inf)
                near = ~(d > (bound + slack + 2 * off)[:, None])
                i, j = np.nonzero(near if ok is None else near & ok)
                for a in range(0, len(i), EXACT):
                    new.append(self._exact(at[i[a : a + EXACT]], j[a : a + EXACT], ids, x))
                    held += len(new[-1][0])
                    if held > 4 * EXACT:
                        self._keep(new)
                        new, held = [], 0
        self._keep(new)

    def _exact(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        d = exact(self.name, self.q[i].T, x[j].T, self.arg, self.cuts)
        ok = ~np.isnan(d)
        return i[ok], ids[j[ok]], d[ok]

    def _keep(self, new: list) -> None:
        if not new:
            return
        at, ids, d = (np.concatenate(c) for c in zip((self.at, self.ids, self.d), *new, strict=True))
        key = rounded(d, self.digits)
        order = np.lexsort((ids, -key if self.greater else key, at))
        at, ids, d = at[order], ids[order], d[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        own = place < self.k
        self.at, self.ids, self.d = at[own], ids[own], d[own]
        full = place[own] == self.k - 1
        self.bound[self.at[full]] = -self.d[full] if self.greater else self.d[full]
