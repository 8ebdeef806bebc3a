"""Colour maps as column expressions: cube rotations, sphere maps, CIE LAB, a parametric 2-D map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import clamp


def rotate_rgb_cube(r: Column, g: Column, b: Column, position: int) -> tuple[Column, Column, Column]:
    """Positions 0 to 6: the channels turned ``position mod 3`` times, from 4 on inverted as well."""
    assert position in range(7), "position must be 0 to 6"
    turn = position % 3
    out = (r, g, b) if turn == 0 else (b, r, g) if turn == 1 else (g, b, r)
    return tuple(F.lit(1.0) - c for c in out) if position > 3 else out


def sphere(theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    return F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta)


def flatten_sphere(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.atan2(x, y), -F.acos(z)


def _linear(c: Column) -> Column:
    """sRGB companding of a linear channel."""
    c = clamp(c)
    return clamp(F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055))


def lab_to_rgb(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """CIE LAB (D65, 2 degrees) to sRGB, clipped to the gamut."""
    fy = (l + 16.0) / 116.0
    fx, fz = fy + a / 500.0, F.greatest(fy - b / 200.0, F.lit(0.0))
    back = lambda f: F.when(f > 0.2068966, f * f * f).otherwise((f - 16.0 / 116.0) / 7.787)
    x, y, z = back(fx) * 0.95047, back(fy), back(fz) * 1.08883
    # The inverse of the sRGB primaries' matrix.
    return (
        _linear(x * 3.24048134 - y * 1.53715152 - z * 0.49853633),
        _linear(x * -0.96925495 + y * 1.87599 + z * 0.04155593),
        _linear(x * 0.05564664 - y * 0.20404134 + z * 1.05731107),
    )


def lab_color(c0: Column, c1: Column, c2: Column, full_range: bool = True) -> tuple[Column, Column, Column]:
    """Channels in [0, 1] read as LAB: lightness to 100, a and b to +-128 (full range) or +-50."""
    wide, shift = (255.0, 128.0) if full_range else (100.0, 50.0)
    return lab_to_rgb(c0 * 100.0, c1 * wide - shift, c2 * wide - shift)


def map_2d(x: Column, y: Column, steps: int = 255) -> tuple[Column, Column, Column]:
    """Coordinates in [0, 1] to a diagonal cut of the RGB cube, through integer steps as a table would."""
    i, j = (x * steps).cast("int") / F.lit(float(steps)), (y * steps).cast("int") / F.lit(float(steps))
    q = lambda c: (c * 255.0).cast("int") / F.lit(255.0)
    return q(i), q(j), q(F.lit(1.0) - (i + j) / 2.0)
