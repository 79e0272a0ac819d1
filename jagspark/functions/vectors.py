"""Four-vectors as plain column functions: momenta in (pt, eta, phi, mass), angles wrapped to [-pi, pi)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import _let


def delta_phi(a: Column, b: Column) -> Column:
    """a - b, wrapped by the floored remainder."""
    turn = 2 * math.pi
    return _let(a - b + math.pi, lambda x: x - F.lit(turn) * F.floor(x / turn) - math.pi)


def delta_r(eta1: Column, phi1: Column, eta2: Column, phi2: Column) -> Column:
    return F.hypot(eta1 - eta2, delta_phi(phi1, phi2))


def pair_mass(a: Column, b: Column) -> Column:
    """Invariant mass of two massless momenta: structs with pt, eta, phi."""
    return F.sqrt(F.greatest(2 * a["pt"] * b["pt"] * (F.cosh(a["eta"] - b["eta"]) - F.cos(a["phi"] - b["phi"])), F.lit(0.0)))


def cartesian_components(v: Column) -> tuple[Column, Column, Column, Column]:
    """(px, py, pz, energy) of a struct with pt, eta, phi, mass."""
    p = v["pt"] * F.cosh(v["eta"])
    return v["pt"] * F.cos(v["phi"]), v["pt"] * F.sin(v["phi"]), v["pt"] * F.sinh(v["eta"]), F.sqrt(p * p + v["mass"] * v["mass"])


def sum_mass_pt(vectors: list[Column]) -> tuple[Column, Column]:
    """(mass, pt) of the sum of vectors."""
    px, py, pz, e = (sum(c[1:], c[0]) for c in zip(*map(cartesian_components, vectors), strict=True))
    return F.sqrt(F.greatest(e * e - px * px - py * py - pz * pz, F.lit(0.0))), F.sqrt(px * px + py * py)


def transverse_mass(pt1: Column, phi1: Column, pt2: Column, phi2: Column) -> Column:
    return F.sqrt(2 * pt1 * pt2 * (1 - F.cos(phi1 - phi2)))
