"""Checks of scalar arguments; each returns the value it accepts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping


def _whole(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and x == int(x)


def time_axis(t: Iterable[float], n: int) -> list[float]:
    """Numeric, finite, strictly increasing, one value per layer."""
    out = [float(x) for x in t]
    if len(out) != n:
        raise ValueError(f"the time axis has {len(out)} values for {n} layers")
    if not all(map(math.isfinite, out)):
        raise ValueError("the time axis must be finite")
    if any(b <= a for a, b in zip(out, out[1:])):
        raise ValueError("the time axis must be strictly increasing")
    return out


def positive_integer(x, name: str) -> int:
    if not _whole(x) or x < 1:
        raise ValueError(f"{name} must be a positive whole number")
    return int(x)


def odd_window(x, name: str = "window_size") -> int:
    if not _whole(x) or x < 3 or x % 2 == 0:
        raise ValueError(f"{name} must be an odd whole number of 3 or more")
    return int(x)


def probability(x, name: str) -> float:
    if not isinstance(x, (int, float)) or isinstance(x, bool) or not 0 < x < 1:
        raise ValueError(f"{name} must lie strictly between 0 and 1")
    return float(x)


def probabilities(xs, name: str) -> list[float]:
    out = [probability(x, name) for x in (xs if isinstance(xs, (list, tuple)) else [xs])]
    if not out:
        raise ValueError(f"{name} is empty")
    return out


def seed(x) -> int | None:
    if x is None:
        return None
    if not isinstance(x, (int, float)) or isinstance(x, bool) or not math.isfinite(x):
        raise ValueError("seed must be None or a finite number")
    return int(x)


def max_pairs(x) -> float:
    if x == math.inf:
        return x
    return positive_integer(x, "max_pairs")


def positive_number(x, name: str) -> float:
    if not isinstance(x, (int, float)) or isinstance(x, bool) or not math.isfinite(x) or x <= 0:
        raise ValueError(f"{name} must be a finite positive number")
    return float(x)


def choice(x: str, allowed: Iterable[str], name: str) -> str:
    allowed = list(allowed)
    if x not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return x


def extra_arguments(args: Mapping | None, reserved: Iterable[str], name: str) -> dict:
    """Further arguments of a step: a mapping of names, none of which the workflow sets itself."""
    out = dict(args or {})
    if not all(isinstance(k, str) and k for k in out):
        raise ValueError(f"{name} must have names")
    if clash := sorted(set(out) & set(reserved)):
        raise ValueError(f"{name} sets {', '.join(clash)}, which the workflow sets itself")
    return out


def reference_alpha(alphas: Iterable[float]) -> float:
    """0.05 where it is among the levels, else the smallest."""
    alphas = list(alphas)
    return 0.05 if 0.05 in alphas else min(alphas)
