"""The splat table: a fixed core of float columns, optional colours, and whatever else a file brings."""

from __future__ import annotations

CORE = ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2"]
TAIL = ["opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
RGB = ["red", "green", "blue"]
ORDINAL = "_ord"


def coefficients(degree: int) -> int:
    return {0: 0, 1: 9, 2: 24, 3: 45}[degree]


def rest(degree: int) -> list[str]:
    return [f"f_rest_{i}" for i in range(coefficients(degree))]


def standard(degree: int = 3, rgb: bool = False) -> list[str]:
    """Names in their fixed order."""
    return [*CORE, *rest(degree), *TAIL, *(RGB if rgb else [])]
