"""Scales at which fields are coarsened: small integer schedules, computed on the driver.

Comparisons of lengths with limits are made in 32-bit floats, the precision of the fields' geometry. Block factors of a
budget are all multiples of a few seeds, so a coarse level can be merged from the level of its seed.
"""

from __future__ import annotations

import numpy as np

Triple = tuple[int, int, int]


def truncated_block_extent(n: int, block: int) -> tuple[int, int]:
    """Cells that whole blocks cover, and the rest."""
    if block < 1:
        raise ValueError("a block has at least one cell")
    return n - n % block, n % block


def crop(shape: Triple, used: Triple) -> Triple:
    """The cropped extents, checked to lie within the shape."""
    if any(not 0 <= u <= s for u, s in zip(used, shape)):
        raise ValueError(f"{used} does not lie within {shape}")
    return used


def least_factor(dx: float, min_h: float) -> int:
    return max(1, int(np.ceil(np.float32(min_h) / np.float32(dx))))


def effective_fz_max(nz: int, dz: float, max_dz: float) -> int:
    """The largest vertical factor within the column whose thickness stays within max_dz, or 0."""
    fits = [f for f in range(1, nz + 1) if np.float32(f) * np.float32(dz) <= np.float32(max_dz)]
    return max(fits, default=0)


def subsample_closed_range(lo: int, hi: int, n: int) -> list[int]:
    """At most n integers of [lo, hi], evenly spaced with both ends; one alone is the middle. Halves round to even."""
    if n < 1 or lo > hi:
        return []
    if hi - lo + 1 <= n:
        return list(range(lo, hi + 1))
    if n == 1:
        return [lo + (hi - lo) // 2]
    return sorted({lo + round(i * (hi - lo) / (n - 1)) for i in range(n)})


def budget_split(budget: int) -> tuple[int, int]:
    """Shares of the lower (block seeds) and the upper band (extra windows)."""
    low = max(1, budget // 2)
    return low, budget - low


def multiples(seeds: list[int], most: int) -> list[int]:
    return sorted({m for s in seeds for m in range(s, most + 1, s)})


def block_factors(nx: int, ny: int, dx: float, min_h: float, budget: int | None = 10) -> list[int]:
    """Horizontal block factors: multiples of seeds spread over the lower half of the allowed range."""
    least, most = least_factor(dx, min_h), min(nx, ny)
    if least > most:
        return [most]
    if budget is None:
        return list(range(least, most + 1))
    if budget < 1:
        raise ValueError("the budget must be at least 1")
    half = most // 2
    seeds = subsample_closed_range(least, half, budget_split(budget)[0]) if least <= half else subsample_closed_range(least, most, budget)
    return multiples(seeds, most)


def vertical_factors(nz: int, dz: float, max_dz: float, budget: int | None = 5) -> list[int]:
    most = effective_fz_max(nz, dz, max_dz)
    if most < 1:
        return []
    if budget is None:
        return list(range(1, most + 1))
    half = most // 2
    return multiples(subsample_closed_range(1, half if half >= 1 else most, budget), most)


def flat_sizes(nx: int, ny: int, dx: float, min_h: float, budget: int = 5) -> list[int]:
    """Horizontal sizes spread over the whole allowed range."""
    return subsample_closed_range(least_factor(dx, min_h), min(nx, ny), budget)


def seeds_of(sizes: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """For each horizontal size the size that its blocks are merged from: the largest that divides it and that no other divides.

    Single cells are no such size, as merging them is no less work than the cells themselves.
    """
    wide = [s for s in sizes if s != (1, 1)]
    divides = lambda a, b: b[0] % a[0] == 0 and b[1] % a[1] == 0
    seeds = [s for s in wide if not any(t != s and divides(t, s) for t in wide)]
    return {s: max((t for t in seeds if divides(t, s)), default=s) if s != (1, 1) else s for s in sizes}


def merge_metadata(fields: dict, scheme: dict) -> dict:
    """Metadata of a field with those of a reduction, which count where both have a key."""
    return {**fields, **scheme}


def by_depth(triples: set[Triple]) -> list[Triple]:
    return sorted(triples, key=lambda t: (t[2], t[0], t[1]))


def block_triples(nx: int, ny: int, nz: int, dx: float, min_h: float, dz: float, max_dz: float, budget: int = 10) -> list[Triple]:
    hs, zs = block_factors(nx, ny, dx, min_h, budget), vertical_factors(nz, dz, max_dz, budget)
    return by_depth({(h, h, z) for h in hs for z in zs})


def sliding_triples(nx: int, ny: int, nz: int, dx: float, min_h: float, dz: float, max_dz: float, budget: int = 10) -> list[Triple]:
    if budget < 1:
        raise ValueError("the budget must be at least 1")
    hs, zs = flat_sizes(nx, ny, dx, min_h, budget), subsample_closed_range(1, effective_fz_max(nz, dz, max_dz), budget)
    return by_depth({(h, h, z) for h in hs for z in zs})


def middle_window(nx: int, ny: int, dx: float, min_h: float) -> list[int]:
    """One size halfway between the least and the whole domain, unless it is one of these or twice the least."""
    least, most = least_factor(dx, min_h), min(nx, ny)
    mid = (least + most) // 2
    return [mid] if least < mid < most and mid != 2 * least else []


def extra_windows(nx: int, ny: int, dx: float, min_h: float, blocks: set[int], budget: int = 5) -> list[int]:
    """Window sizes of the upper half that no block has; if the sample has none, the middle one."""
    if budget < 0:
        raise ValueError("the budget must not be negative")
    most = min(nx, ny)
    lo = max(least_factor(dx, min_h), most // 2)
    extra = [w for w in subsample_closed_range(lo, most, budget) if w not in blocks]
    if extra or all(w in blocks for w in range(lo, most + 1)) and lo <= most:
        return extra
    return [w for w in middle_window(nx, ny, dx, min_h) if w not in blocks and lo <= w <= most]


def extra_heights(nz: int, dz: float, max_dz: float, blocks: set[int], budget: int = 5) -> list[int]:
    if budget < 1:
        raise ValueError("the budget must be at least 1")
    most = effective_fz_max(nz, dz, max_dz)
    return [z for z in subsample_closed_range(most // 2 + 1, most, budget) if z not in blocks] if most >= 1 else []


def hybrid_triples(nx: int, ny: int, nz: int, dx: float, min_h: float, dz: float, max_dz: float, budget: int = 10) -> tuple[list[Triple], list[Triple]]:
    """Block triples, and sliding triples of the sizes that the blocks lack in both directions."""
    blocks = block_triples(nx, ny, nz, dx, min_h, dz, max_dz, budget)
    hs = extra_windows(nx, ny, dx, min_h, {t[0] for t in blocks}, budget_split(budget)[1])
    zs = extra_heights(nz, dz, max_dz, {t[2] for t in blocks}, budget)
    return blocks, by_depth({(h, h, z) for h in hs for z in zs} - set(blocks))


def seed_ladder(n: int, seed: int, least: int = 1) -> list[int]:
    """seed, 2 * seed, 4 * seed ... up to n, from `least` on."""
    if min(n, seed, least) < 1:
        raise ValueError("n, seed and least must be at least 1")
    return [seed << k for k in range(n.bit_length()) if least <= seed << k <= n]


def seed_schedule(nx: int, dx: float, seeds: tuple[int, ...], min_h: float, whole: bool = True) -> list[tuple[int, float, int]]:
    """(factor, resolution, cells) of the ladders of odd, distinct seeds, with the whole domain."""
    if any(s % 2 == 0 for s in seeds) or len(set(seeds)) < len(seeds):
        raise ValueError(f"seeds must be odd and distinct: {seeds}")
    least = least_factor(dx, min_h)
    factors = [f for s in seeds for f in seed_ladder(nx, s) if f >= least]
    if whole and nx not in factors:
        factors.append(nx)
    return [(f, float(np.float32(f) * np.float32(dx)), nx // f) for f in sorted(factors)]


def divisor_triples(nx: int, ny: int, nz: int, dx: float, min_h: float, dz: float, max_dz: float, square: bool = True) -> list[Triple]:
    """Factors that divide every extent; 1 is always wide enough."""
    pairs = [(f, f) for f in range(1, nx + 1)] if square else [(a, b) for a in range(1, nx + 1) for b in range(1, ny + 1)]
    wide = [p for p in pairs if nx % p[0] == 0 and ny % p[1] == 0 and (max(p) == 1 or np.float32(dx) * np.float32(max(p)) >= np.float32(min_h))]
    deep = [z for z in range(1, nz + 1) if nz % z == 0 and np.float32(z) * np.float32(dz) <= np.float32(max_dz)]
    return by_depth({(*p, z) for p in wide for z in deep})


def z_scheme(dz: list[float], max_dz: float) -> list[tuple[int, float]]:
    """(factor, thickness): native, then powers of two within the column and max_dz."""
    if not dz:
        raise ValueError("a column has at least one level")
    mean = np.float32(np.mean(np.asarray(dz, np.float32)))
    powers = [1 << k for k in range(1, len(dz).bit_length())]
    return [(1, float(mean)), *((f, float(mean * np.float32(f))) for f in powers if f <= len(dz) and mean * np.float32(f) <= np.float32(max_dz))]


def window_count(n: int, window: int, stride: int) -> int:
    return 0 if n < window else (n - window) // stride + 1


def uniform_stride(n: int, window: int, outputs: int) -> int:
    """The stride with the most outputs, `outputs` at most; of equals that nearest the ideal, then the smallest."""
    if window < 1 or outputs < 1:
        raise ValueError("window and outputs must be at least 1")
    span = n - window
    if span < 0:
        return 1
    if outputs == 1:
        return span + 1
    ideal = span / (outputs - 1)
    fit = [s for s in range(1, max(1, span) + 1) if span // s + 1 <= outputs]
    return min(fit, key=lambda s: (-(span // s), abs(s - ideal), s), default=max(1, span))


def anchors(n: int, window: int, outputs: int) -> list[int]:
    """0-based window starts: the first, the last and others between, so many as asked or as there are."""
    if window < 1 or outputs < 1:
        raise ValueError("window and outputs must be at least 1")
    if n < window:
        raise ValueError("the window exceeds the data")
    last, k = n - window, min(outputs, n - window + 1)
    return [0] if k == 1 else [i * last // (k - 1) for i in range(k)]


def starts(n: int, window: int, outputs: int = 2, stride: int | None = None) -> list[int]:
    """Window starts: at a stride if one is given, else anchors."""
    return list(range(0, n - window + 1, stride)) if stride else anchors(n, window, outputs)


def span_dz(dz: list[float], factor: int) -> list[float]:
    """Thickness of whole groups of levels."""
    return [float(sum(dz[k : k + factor])) for k in range(0, len(dz) - factor + 1, factor)]


def centers_to_edges(centers: list[float]) -> list[float]:
    if len(centers) < 2:
        return [c + d for c in centers for d in (-0.5, 0.5)]
    mid = [(a + b) / 2 for a, b in zip(centers, centers[1:])]
    return [centers[0] - (mid[0] - centers[0]), *mid, centers[-1] + (centers[-1] - mid[-1])]


def horizontal_levels(nx: int, ny: int, dx: float, seeds: tuple[int, ...], min_h: float) -> list[tuple[int, int]]:
    """Square levels of the seed schedule, then the whole domain."""
    square = [(f, f) for f, _, _ in seed_schedule(min(nx, ny), dx, seeds, min_h, whole=False)]
    return square if (nx, ny) in square else [*square, (nx, ny)]
