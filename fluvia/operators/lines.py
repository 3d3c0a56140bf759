"""Lines as lists of points; plain Python for workers."""

from __future__ import annotations


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker with a stack."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (x, y0), (u, v) = points[a], points[b]
        size = ((u - x) ** 2 + (v - y0) ** 2) ** 0.5 or 1.0
        far, k = max(((abs((u - x) * (y0 - q) - (x - p) * (v - y0)) / size, i) for i, (p, q) in enumerate(points[a + 1 : b], a + 1)), default=(0.0, a))
        if far > tolerance:
            keep.add(k)
            stack += [(a, k), (k, b)]
    return [points[i] for i in sorted(keep)]
