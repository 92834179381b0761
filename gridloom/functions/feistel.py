"""Keyed permutations of 0 to n - 1 that need no sorting: a Feistel network with cycle-walking.

The network permutes the numbers of 2 h bits, the least even number of bits that holds n; a number that falls outside 0 to n - 1 goes
through it again until it is inside. The round function is integer arithmetic below 63 bits, so SQL engines draw the same permutations.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 8
#: Odd multipliers of the mixing steps.
FACTORS = (2_654_435_761, 2_246_822_519)
LOW31, LOW32 = 2**31 - 1, 2**32 - 1


def half_bits(n: int) -> int:
    """Bits of a half: the smallest h >= 1 with 4^h >= n."""
    h = 1
    while 4**h < n:
        h += 1
    return h


def mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    a = ((x + key) & LOW31) * FACTORS[0] & LOW32
    a = a ^ (a >> 15)
    a = (a & LOW31) * FACTORS[1] & LOW32
    return a ^ (a >> 13)


def round_keys(seed: int, perm: np.ndarray) -> list[np.ndarray]:
    """A key for each round of each permutation."""
    perm = np.asarray(perm, np.int64)
    return [mixed(perm, np.int64((seed * 40_503 + r * 9_973) & LOW31)) for r in range(ROUNDS)]


def permute(i: np.ndarray, n: int, seed: int, perm: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Where permutation ``perm`` of 0 to n - 1 sends i (or from where it comes); i and perm are broadcast against each other."""
    h, keys = half_bits(n), round_keys(seed, perm)
    i, _ = np.broadcast_arrays(np.asarray(i, np.int64), np.asarray(perm))
    keys = [np.broadcast_to(k, i.shape).ravel() for k in keys]
    shape, i = i.shape, i.ravel().copy()
    mask, walk = (1 << h) - 1, np.arange(i.size)
    while walk.size:
        left, right = i[walk] >> h, i[walk] & mask
        if inverse:
            for k in keys[::-1]:
                left, right = right ^ (mixed(left, k[walk]) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (mixed(right, k[walk]) & mask)
        i[walk] = left << h | right
        walk = walk[i[walk] >= n]
    return i.reshape(shape)


def permute_sql(source: str, seed: int) -> str:
    """A recursive query: from ``source`` (perm, i, n) to the last step of each walk, (perm, i, n, v) where v < n."""
    def mix(x: str, key: str) -> str:
        a = f"(((({x}) + ({key})) & {LOW31}) * {FACTORS[0]} & {LOW32})"
        b = f"((xor({a}, {a} >> 15) & {LOW31}) * {FACTORS[1]} & {LOW32})"
        return f"xor({b}, {b} >> 13)"

    inner = "select perm, i, n, h, v >> h as l, v & ((1::bigint << h) - 1) as r from {from_}"
    for k in range(ROUNDS):
        key = (seed * 40_503 + k * 9_973) & LOW31
        inner = f"select perm, i, n, h, r as l, xor(l, {mix('r', mix('perm', str(key)))} & ((1::bigint << h) - 1)) as r from ({inner})"
    step = f"select perm, i, n, h, l << h | r as v from ({inner})"
    first = f"(select perm::bigint as perm, i::bigint as i, n::bigint as n, i::bigint as v, (select min(k) from range(1, 32) s(k) where pow(4, k) >= n)::bigint as h from {source})"
    return f"walk as ({step.format(from_=first)} union all {step.format(from_='walk where v >= n')})"
