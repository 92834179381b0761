"""Pairwise statistics of many series at once, in numpy over Arrow batches.

A series of n values has n (n - 1) / 2 pairs. Spark's array functions call an interpreted lambda for each; here a block of
series is handled by whole-array operations with at most ``PAIRS`` numbers in memory. Short series (up to ``SHORT`` layers for scores,
``PAIRS`` / 4 pairs for slopes) are compared pair by pair. Longer ones are not: scores count inversions by merge levels, and
slopes are selected among all pairs by counting the pairs below two cuts until few are left between them, so memory grows
with the length of a series and time a little faster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAIRS = 2_000_000
SHORT = 128
SAMPLE = 20_000


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def merge_levels(x: np.ndarray):
    """(rows x columns of small integers) level by level of a merge sort: (left, right, below, width), where left and right are the sorted
    halves (rows, blocks, width) and below counts, for each of left, the elements of right that are smaller.

    The columns are a power of two.
    """
    rows, n = x.shape
    width, top = 1, int(x.max(initial=0)) + 1
    x = x.astype(np.int64)
    while width < n:
        halves = x.reshape(rows, n // (2 * width), 2, width)
        left, right = halves[:, :, 0], halves[:, :, 1]
        block = np.arange(rows * (n // (2 * width))).reshape(rows, -1, 1)
        flat = (right + block * top).ravel()  # ascending, since blocks are
        below = np.searchsorted(flat, (left + block * top).ravel(), "left").reshape(left.shape) - block * width
        yield left, right, below, width
        x = np.sort(x.reshape(rows, -1, 2 * width), axis=2, kind="stable").reshape(rows, n)
        width *= 2


def padded(x: np.ndarray, fill: int) -> np.ndarray:
    """Columns up to a power of two, the new ones with ``fill`` (as large as any, so that they are below nothing)."""
    n = 1 << max(0, int(x.shape[1] - 1).bit_length())
    return np.concatenate([x, np.full((len(x), n - x.shape[1]), fill, x.dtype)], 1)


def dense_ranks(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, ordered) of each row: equal values share a rank."""
    order = np.argsort(y, axis=1, kind="stable")
    ordered = np.take_along_axis(y, order, 1)
    steps = np.concatenate([np.zeros((len(y), 1), np.int64), (ordered[:, 1:] != ordered[:, :-1]).cumsum(1)], 1)
    ranks = np.empty_like(steps)
    np.put_along_axis(ranks, order, steps, 1)
    return ranks, steps


def inversions(ranks: np.ndarray) -> np.ndarray:
    """How many pairs of each row stand in falling order."""
    out = np.zeros(len(ranks), np.int64)
    for _, _, below, _ in merge_levels(padded(ranks, ranks.shape[1])):
        out += below.sum((1, 2))
    return out


def kendall_scores(y: np.ndarray, ties: bool) -> tuple[np.ndarray, np.ndarray]:
    """(S, VarS) of each row."""
    n = y.shape[1]
    if n > SHORT:
        step = max(1, PAIRS // n)
        parts = [_long_scores(y[k : k + step], ties) for k in range(0, len(y), step)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0), np.zeros(0))
    score, equal = np.zeros(len(y)), np.ones(y.shape)
    for k in range(1, n):
        later, before = y[:, k:], y[:, :-k]
        score += np.sign(later - before).sum(1)
        if ties:
            same = later == before
            equal[:, k:] += same
            equal[:, :-k] += same
    # each of g equal values adds (g - 1) (2 g + 5)
    tied = ((equal - 1) * (2 * equal + 5)).sum(1)
    return score, (n * (n - 1) * (2 * n + 5) - tied) / 18


def _long_scores(y: np.ndarray, ties: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same in n log n steps: rising pairs are all pairs less the equal and the falling ones."""
    n = y.shape[1]
    ranks, steps = dense_ranks(y)
    groups = np.bincount((steps + np.arange(len(y))[:, None] * n).ravel(), minlength=len(y) * n).reshape(len(y), n).astype(float)
    equal, falling = (groups * (groups - 1) / 2).sum(1), inversions(ranks)
    tied = (groups * (groups - 1) * (2 * groups + 5)).sum(1) if ties else np.zeros(len(y))
    return n * (n - 1) / 2 - equal - 2 * falling, (n * (n - 1) * (2 * n + 5) - tied) / 18


def sen_slopes(y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Theil-Sen slope of each row, from all pairs."""
    n = len(t) * (len(t) - 1) // 2
    low, high = pair_ranks(y, t, np.full((len(y), 2), [(n - 1) // 2, n // 2])).T if len(y) else (np.zeros(0),) * 2
    return (low + high) / 2


def pair_ranks(y: np.ndarray, t: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slopes of each row's pairs that have the given ranks (rows x some, from 0) in ascending order."""
    n = len(t) * (len(t) - 1) // 2
    if n > PAIRS // 4:
        return np.array([selected(row, t, sorted(set(k.tolist())), k) for row, k in zip(y, ranks)]).reshape(ranks.shape)
    i, j = np.triu_indices(len(t), 1)
    step, gap, out = max(1, PAIRS // max(1, n)), t[j] - t[i], []
    for k in range(0, len(y), step):
        slopes = (y[k : k + step, j] - y[k : k + step, i]) / gap
        own = ranks[k : k + step]
        if (own == own[:1]).all():
            slopes.partition(np.unique(own[0]), axis=1)
        else:
            slopes.sort(axis=1)
        out.append(np.take_along_axis(slopes, own, 1))
    return np.concatenate(out) if out else np.zeros(ranks.shape)


def selected(y: np.ndarray, t: np.ndarray, wanted: list[int], ranks: np.ndarray) -> np.ndarray:
    """Slopes of one long series by rank. A sample of pairs gives two cuts around each wanted rank; the pairs below a cut m are the
    inversions of y - m t, and those between two cuts the inversions from one such order to the other, which are listed."""
    found = {k: _selected(y, t, k) for k in wanted}
    return np.array([found[k] for k in ranks.tolist()])


def _selected(y: np.ndarray, t: np.ndarray, rank: int) -> float:
    n = len(y)
    total, most, rng = n * (n - 1) // 2, 40 * n, np.random.default_rng(n)
    i, j = rng.integers(0, n, SAMPLE), rng.integers(0, n - 1, SAMPLE)
    j += j >= i
    sample = np.sort((y[j] - y[i]) / (t[j] - t[i]))
    for spread in (4, 16, 64):
        half = spread * np.sqrt(SAMPLE) / 2
        at = rank / total * SAMPLE
        low, high = (float(sample[int(np.clip(k, 0, SAMPLE - 1))]) for k in (at - half, at + half))
        under, over = (_below(y, t, m, side) for m, side in ((low, -1), (high, 1)))
        if under is None or over is None:
            break
        (m0, c0), (m1, c1) = under, over
        if not c0 <= rank < c1:
            continue
        if c1 - c0 > most + spread * total // 50:
            break
        between = _between(y, t, m0, m1)
        if len(between) == c1 - c0:
            return float(np.partition(between, rank - c0)[rank - c0])
    return _scanned(y, t, rank)


def _below(y: np.ndarray, t: np.ndarray, m: float, side: int) -> tuple[float, int] | None:
    """A cut at m or a little outside it that no slope meets within rounding, and the number of slopes below it."""
    scale = np.abs(y).max() + abs(m) * np.abs(t).max()
    slack = 16 * np.finfo(float).eps * scale / np.diff(t).min()
    for k in range(1, 6):
        cut = m + side * slack * 8**k
        a, b = (int(inversions(dense_ranks((y - (cut + d) * t)[None, :])[0])[0]) for d in (-slack, slack))
        if a == b:
            return cut, a
    return None


def _between(y: np.ndarray, t: np.ndarray, low: float, high: float) -> np.ndarray:
    """The slopes between two cuts: the pairs whose order by y - low t differs from that by y - high t."""
    order = np.argsort(y - low * t, kind="stable")
    ranks = dense_ranks((y - high * t)[order][None, :])[0]
    n = ranks.shape[1]
    numbers = np.empty(n, np.int64)  # distinct numbers in the order of the ranks, so that a number tells its point
    numbers[np.lexsort((np.arange(n), ranks[0]))] = np.arange(n)
    point = np.empty(n, np.int64)
    point[numbers] = order
    out = []
    for left, right, below, width in merge_levels(padded(numbers[None, :], n)):
        c = below.ravel()
        block = np.repeat(np.arange(left.shape[1]), width)
        at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(block * width, c)
        a, b = np.repeat(left.ravel(), c), right.ravel()[at]
        real = (a < n) & (b < n)
        p, q = point[a[real]], point[b[real]]
        out.append((y[q] - y[p]) / (t[q] - t[p]))
    return np.concatenate(out)


def _scanned(y: np.ndarray, t: np.ndarray, rank: int) -> float:
    """A slope by rank where many pairs share it: passes over all pairs, some points at a time, that count the slopes equal to and
    between pivots drawn from the interval that is left, until the rank falls on a pivot or few slopes are left."""
    n, step = len(y), max(1, PAIRS // 4 // len(y))
    low, high, rng = -np.inf, np.inf, np.random.default_rng(n)

    def blocks():
        for k in range(0, n, step):
            i = np.arange(k, min(k + step, n))
            later = np.arange(n)[None, :] > i[:, None]
            with np.errstate(all="ignore"):
                yield ((y[None, :] - y[i, None]) / (t[None, :] - t[i, None]))[later]

    while True:
        below, inside, pivots = 0, 0, []
        for s in blocks():
            below += int((s <= low).sum())
            s = s[(s > low) & (s < high)]
            inside += len(s)
            pivots.append(rng.choice(s, min(len(s), 50)) if len(s) else s)
        if inside <= PAIRS:
            rest = np.concatenate([s[(s > low) & (s < high)] for s in blocks()])
            return float(np.partition(rest, rank - below)[rank - below])
        pivots = np.unique(rng.choice(np.concatenate(pivots), 64))
        counts = np.zeros(2 * len(pivots) + 1, np.int64)  # between, equal to, between, ...
        for s in blocks():
            s = s[(s > low) & (s < high)]
            counts += np.bincount(np.searchsorted(pivots, s, "left") + np.searchsorted(pivots, s, "right"), minlength=len(counts))
        at = int(np.searchsorted(below + counts.cumsum(), rank, "right"))
        if at % 2:
            return float(pivots[at // 2])
        low, high = (low if at == 0 else pivots[at // 2 - 1]), (high if at == len(counts) - 1 else pivots[at // 2])


def repeated_medians(y: np.ndarray, t: np.ndarray, intercepts: bool = False) -> np.ndarray:
    """Siegel's slope (or intercept) of each row: the upper median over i of the upper medians over j of the slopes (or intercepts) of i and j.

    Some points i are taken at a time, so no square of a long series is held.
    """
    n = len(t)
    inner = np.empty(y.shape)
    step = max(1, PAIRS // (n * n)) if n * n <= PAIRS else 1
    points = max(1, PAIRS // n)
    for k in range(0, len(y), step):
        some = y[k : k + step]
        for a in range(0, n, points):
            i = np.arange(a, min(a + points, n))
            gap = t[None, :] - t[i, None]
            with np.errstate(all="ignore"):
                slopes = (some[:, None, :] - some[:, i, None]) / gap
                values = some[:, i, None] - slopes * t[i, None] if intercepts else slopes
            values[:, np.arange(len(i)), i] = np.inf  # the point itself comes last
            at = (n - 1) // 2
            inner[k : k + step, i] = np.partition(values, at, axis=2)[:, :, at]
    return np.partition(inner, n // 2, axis=1)[:, n // 2]


def with_statistics(rows: DataFrame, names: tuple[str, ...], kernel: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """rows (ok, y, ...) with the doubles that the kernel gives for the complete series; null for the others."""
    fields = rows.columns
    ok_at, y_at = fields.index("ok"), fields.index("y")

    def run(batches):
        for b in batches:
            ok = b.column(ok_at).to_numpy(zero_copy_only=False)
            found = kernel(matrix(b.column(y_at).filter(pa.array(ok)))) if ok.any() else [np.zeros(0)] * len(names)
            columns = []
            for x in found:
                whole = np.full(len(ok), np.nan)
                whole[ok] = x
                columns.append(pa.array(whole, pa.float64(), mask=~ok))
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*fields, *names])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), *(f"`{n}` double" for n in names)]))
