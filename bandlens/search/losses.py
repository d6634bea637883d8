"""The metrics on numpy arrays, for candidates inside Python workers; they agree with the columns'."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CLIP = 1e-9


def _mean(loss: np.ndarray, w: np.ndarray | None) -> float:
    if w is None:
        return float(loss.mean()) if len(loss) else 0.0
    total = w.sum()
    return float((w * loss).sum() / total) if total else 0.0


def mae(y, p, w=None):
    return _mean(np.abs(p - y), w)


def mse(y, p, w=None):
    return _mean((p - y) ** 2, w)


def rmse(y, p, w=None):
    return float(np.sqrt(mse(y, p, w)))


def _own(p, y):
    return p[np.arange(len(y)), y.astype(int)]


def cross_entropy(y, p, w=None):
    if p.ndim == 2:
        return _mean(-np.log(np.clip(_own(p, y), CLIP, 1 - CLIP)), w)
    q = np.clip(p, CLIP, 1 - CLIP)
    return _mean(-(y * np.log(q) + (1 - y) * np.log(1 - q)), w)


def nll_loss(y, p, w=None):
    if p.ndim == 2:
        return _mean(-_own(p, y), w)
    q = np.minimum(p, 0.0)
    with np.errstate(all="ignore"):
        return _mean(np.where(y == 1, -q, -np.log1p(-np.exp(q))), w)


def focal_loss(y, p, w=None, gamma: float = 2.0, alpha=None):
    if p.ndim == 2:
        pt = np.clip(_own(p, y), CLIP, 1 - CLIP)
        a = 1.0 if alpha is None else np.asarray(alpha)[y.astype(int)]
    else:
        q = np.clip(p, CLIP, 1 - CLIP)
        pt = np.where(y == 1, q, 1 - q)
        a = 1.0 if alpha is None else np.where(y == 1, alpha, 1 - alpha)
    return _mean(-a * (1 - pt) ** gamma * np.log(pt), w)


def hinge_loss(y, s, w=None):
    if s.ndim == 2:
        own = _own(s, y)
        m = np.maximum(0, 1 - (own[:, None] - s))
        m[np.arange(len(y)), y.astype(int)] = 0
        return _mean(m.sum(1) / (s.shape[1] - 1), w)
    return _mean(np.maximum(0, 1 - (2 * y - 1) * s), w)


def accuracy(y, p, w=None):
    got = p.argmax(1) if p.ndim == 2 else (p >= 0.5).astype(int)
    return _mean((got == y).astype(float), w)


def pearson(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    if p.ndim != 1 or not len(y) or w.sum() == 0 or np.ptp(p) == 0 or np.ptp(y) == 0:
        return 0.0
    dp, dy = p - np.average(p, weights=w), y - np.average(y, weights=w)
    with np.errstate(all="ignore"):
        r = (w * dp * dy).sum() / np.sqrt((w * dp * dp).sum() * (w * dy * dy).sum())
    return float(abs(r)) if np.isfinite(r) else 0.0


def ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[inverse]


def spearman(y, p, w=None):
    return pearson(ranks(y), ranks(p), w)


def _two(measure: Callable) -> Callable:
    """A measure of two classes on the scaled prediction; -inf where it is not defined."""

    def run(y, p, w=None):
        p = np.asarray(p, float).ravel()
        if not len(p) or not np.isfinite(p).all() or np.ptp(p) == 0 or not set(np.unique(y)) == {0, 1}:
            return -np.inf
        z = (p - p.min()) / np.ptp(p)
        a, b = z[y == 0], z[y == 1]
        auc = (ranks(z)[y == 1].sum() - len(b) * (len(b) + 1) / 2) / (len(a) * len(b))
        with np.errstate(all="ignore"):
            return float(measure(a, b, z, 2 * (auc - 0.5)))

    return run


def _var(x: np.ndarray) -> float:
    return float(x.var(ddof=1)) if len(x) > 1 else 0.0


def _bhattacharyya(a, b, z, s):
    va, vb = _var(a), _var(b)
    if va <= 0 or vb <= 0:
        return -np.inf
    d = 0.25 * (a.mean() - b.mean()) ** 2 / (va + vb) + 0.25 * np.log(0.25 * (va / vb + vb / va + 2))
    return d * s if d > 0 else -np.inf


def _hellinger(a, b, z, s):
    va, vb = _var(a), _var(b)
    if va + vb <= 0:
        return -np.inf
    return np.sqrt(max(0.0, 1 - np.sqrt(2 * np.sqrt(va * vb) / (va + vb)) * np.exp(-0.25 * (a.mean() - b.mean()) ** 2 / (va + vb)))) * s


def _js(a, b, z, s, bins: int = 50):
    p, q = (np.histogram(x, bins, (0, 1))[0] / len(x) + 1e-10 for x in (a, b))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return np.clip(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2, 0, 1) * s


def _emd(a, b, z, s):
    v = np.unique(z)
    fa, fb = (np.searchsorted(np.sort(x), v[:-1], side="right") / len(x) for x in (a, b))
    return (np.abs(fa - fb) * np.diff(v)).sum() * s


def _scatter(a, b, z):
    return len(a) * (a.mean() - z.mean()) ** 2 + len(b) * (b.mean() - z.mean()) ** 2, ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()


def _fisher(a, b, z, s):
    between, within = _scatter(a, b, z)
    return between / within * s if within > 0 else (np.inf if between > 0 else -np.inf)


def _f_statistic(a, b, z, s):
    between, within = _scatter(a, b, z)
    return between * (len(z) - 2) / within * s if within > 0 and len(z) > 2 else -np.inf


def _compactness(a, b, z, s):
    spread = 0.5 * (np.sqrt(_var(a)) + np.sqrt(_var(b)))
    return (np.sqrt(_var(z)) / spread if spread else np.inf) * s


def _eta(a, b, z, s):
    if len(a) < 2 or len(b) < 2 or z.var() <= 0:
        return -np.inf
    return np.clip(len(a) * len(b) * (a.mean() - b.mean()) ** 2 / len(z) ** 2 / z.var(), 0, 1)


def _separability(a, b, z, s):
    eta = _eta(a, b, z, s)
    return s * eta if np.isfinite(eta) else eta


def _scaled(p):
    p = np.asarray(p, float).ravel()
    return (p - p.min()) / np.ptp(p) if len(p) and np.ptp(p) > 0 else np.zeros(len(p))


def calinski_harabasz(y, p, w=None):
    z = _scaled(p)
    classes = np.unique(y)
    between = sum((y == k).sum() * (z[y == k].mean() - z.mean()) ** 2 for k in classes)
    within = sum(((z[y == k] - z[y == k].mean()) ** 2).sum() for k in classes)
    return 1.0 if within == 0 else float(between * (len(z) - len(classes)) / (within * (len(classes) - 1)))


def davies_bouldin(y, p, w=None):
    z = _scaled(p)
    classes = np.unique(y)
    c = np.array([z[y == k].mean() for k in classes])
    s = np.array([np.abs(z[y == k] - m).mean() for k, m in zip(classes, c, strict=True)])
    worst = []
    for i in range(len(classes)):
        r = [(s[i] + s[j]) / abs(c[i] - c[j]) if c[i] != c[j] else 0.0 for j in range(len(classes)) if j != i]
        worst.append(max(r, default=0.0))
    return float(np.mean(worst))


def silhouette(y, p, w=None):
    z = _scaled(p)
    classes, total = np.unique(y), 0.0
    dist = {}
    for k in classes:
        v = np.sort(z[y == k])
        sums = np.concatenate([[0], np.cumsum(v)])
        at = np.searchsorted(v, z)
        dist[k] = z * at - sums[at] + (sums[-1] - sums[at]) - z * (len(v) - at)
    n = {k: int((y == k).sum()) for k in classes}
    for k in classes:
        own = y == k
        if n[k] < 2:
            continue
        a = dist[k][own] / (n[k] - 1)
        b = np.min([dist[j][own] / n[j] for j in classes if j != k], axis=0)
        top = np.maximum(a, b)
        total += np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0).sum()
    return float(total / len(z))


LOSSES: dict[str, Callable] = {
    "mae": mae, "mse": mse, "rmse": rmse, "cross_entropy": cross_entropy, "nll_loss": nll_loss, "focal_loss": focal_loss, "hinge_loss": hinge_loss, "accuracy": accuracy,
    "pearson": pearson, "spearman": spearman, "silhouette": silhouette, "davies_bouldin": davies_bouldin, "calinski_harabasz": calinski_harabasz,
    "bhattacharyya": _two(_bhattacharyya), "hellinger": _two(_hellinger), "js_divergence": _two(_js), "wasserstein": _two(_emd), "earth_movers": _two(_emd), "fisher": _two(_fisher),
    "f_statistic": _two(_f_statistic), "compactness": _two(_compactness), "separability": _two(_separability), "eta_separability": _two(_eta),
}
