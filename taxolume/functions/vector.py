"""Euclidean and hyperbolic functions over array<double> columns.

Vectors are points of a Poincare ball of curvature -k. Sums run in double precision, in the order of the components.
Everything is a Column expression; operators.retrieve has the bulk path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, use) -> Column:
    """use(value), with value computed once for each row also where lambdas over components mention it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rounded(x: Column, places: int) -> Column:
    """F.round(x, places), whose decimal arithmetic costs more than the rest of a large scan, without it where x is below
    1000 and clearly off the middle between two results."""
    scaled = F.abs(x) * 10.0**places
    whole = F.floor(scaled + 0.5)
    clear = (F.abs(x) < 1e3) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)
    return F.when(clear, F.when(x < 0, -whole).otherwise(whole) / 10.0**places).otherwise(F.round(x, places))


def dot(u: Column, v: Column) -> Column:
    return _sum(F.zip_with(u, v, lambda a, b: a * b))


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def cosine(u: Column, v: Column, normalised: bool = True) -> Column:
    """The cosine; of vectors known to have norm 1 it is the inner product alone."""
    return dot(u, v) if normalised else dot(u, v) / (norm(u) * norm(v))


def squared_distance(u: Column, v: Column) -> Column:
    return _sum(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)))


def l2(u: Column, v: Column) -> Column:
    return F.sqrt(squared_distance(u, v))


def _acosh(x: Column) -> Column:
    return F.acosh(F.greatest(F.lit(1.0), x))


def poincare_from_norms(nu: Column, nv: Column, uv: Column, k: float | Column, eps: float = 1e-7) -> Column:
    """The distance from squared norms and inner product, which a scan over a resident table precomputes."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    d2 = F.greatest(nu + nv - uv * 2, F.lit(0.0))
    return _acosh(F.lit(1.0) + k * 2 * d2 / ((F.lit(1.0) - (k * nu + eps)) * (F.lit(1.0) - (k * nv + eps)))) / F.sqrt(k)


def poincare(u: Column, v: Column, k: float | Column, eps: float = 1e-7) -> Column:
    """Distance in the ball of curvature -k; eps keeps points on the border finite, 0 is the plain metric."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    den = (F.lit(1.0) - (k * squared_norm(u) + eps)) * (F.lit(1.0) - (k * squared_norm(v) + eps))
    return _acosh(F.lit(1.0) + k * 2 * squared_distance(u, v) / den) / F.sqrt(k)


def depth(n: Column, k: float | Column) -> Column:
    """Distance to the origin of a point of squared norm n."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    return _acosh(F.lit(1.0) + k * 2 * n / (F.lit(1.0) - k * n)) / F.sqrt(k)


def model_curvature(v: Column) -> Column:
    return F.lit(1.0) / F.size(v)


def subsumption(distance: Column, child_depth: Column, parent_depth: Column, weight: float | Column = 1.0) -> Column:
    """How well a parent subsumes a child: close to it and nearer to the origin is better."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return -(distance + w * (parent_depth - child_depth))


def mixed_distance(distances: list[Column], sigmas: list[float], kernel: str = "exp") -> Column:
    """Distance in a product of spaces, or a similarity that falls with it (exp, inv)."""
    d2 = sum((((s * d) * (s * d)) for s, d in zip(sigmas[1:], distances[1:], strict=True)), (sigmas[0] * distances[0]) * (sigmas[0] * distances[0]))
    if kernel == "dist":
        return F.sqrt(d2)
    if kernel == "exp":
        return F.exp(-F.sqrt(d2))
    if kernel in ("inv", "inverse"):
        return F.lit(1.0) / (F.lit(1.0) + d2)
    raise ValueError(f"no such kernel: {kernel}")


def reflect(p: Column, normal: Column) -> Column:
    """p mirrored at the hyperplane through the origin with this normal; an error if the normal is 0."""
    n2 = squared_norm(normal)
    factor = F.when(n2 == 0, F.raise_error(F.lit("a normal of length 0"))).otherwise(dot(p, normal) / n2)
    return bound(factor * 2, lambda f: F.zip_with(p, normal, lambda a, b: a - b * f))


def midpoint(u: Column, v: Column, k: float) -> Column:
    """The gyromidpoint of two points: half of the sum weighted by their conformal factors."""
    lam = lambda x: F.lit(2.0) / (F.lit(1.0) - squared_norm(x) * k)
    half = lambda r: F.when(r == 0, F.lit(0.0)).otherwise(F.tanh(F.atanh(F.least(r, F.lit(1 - 1e-15))) / 2) / r)
    halved = lambda m: bound(bound(norm(m) * math.sqrt(k), half), lambda h: F.transform(m, lambda x: x * h))
    whole = lambda w: F.zip_with(u, v, lambda a, b: (a * w["u"] + b * w["v"]) / (w["u"] + w["v"] - 2))
    return bound(bound(F.struct(lam(u).alias("u"), lam(v).alias("v")), whole), halved)


def project(p: Column, normal: Column, k: float) -> Column:
    """p on the hyperplane with this normal: the midpoint of p and its mirror image."""
    return bound(reflect(p, normal), lambda r: midpoint(p, r, k))


def rotate(v: Column, theta: Column) -> Column:
    """v with its two halves (a, b) turned by an angle each dimension: (a cos - b sin, a sin + b cos)."""
    half = (F.size(v) / 2).cast("int")
    a, b = F.slice(v, F.lit(1), half), F.slice(v, half + 1, half)
    first = F.zip_with(F.zip_with(a, theta, lambda x, t: x * F.cos(t)), F.zip_with(b, theta, lambda y, t: y * F.sin(t)), lambda p, q: p - q)
    second = F.zip_with(F.zip_with(a, theta, lambda x, t: x * F.sin(t)), F.zip_with(b, theta, lambda y, t: y * F.cos(t)), lambda p, q: p + q)
    return F.concat(first, second)


def role_angles(raw: Column) -> Column:
    return F.transform(raw, lambda x: F.tanh(x) * math.pi)


def role_scales(raw: Column) -> Column:
    return F.transform(raw, F.exp)


def half_aperture(v: Column, base: float = 0.1, eps: float = 1e-5) -> Column:
    """Half of the angle of the entailment cone at v (curvature 1)."""
    s = F.least(F.greatest(squared_norm(v), F.lit(base + eps)), F.lit(1 - eps))
    return F.least(F.greatest(F.asin((F.lit(1.0) - s) * base / F.sqrt(s)), F.lit(-1 + eps)), F.lit(1 - eps))


def cone_angle(tip: Column, u: Column, eps: float = 1e-5) -> Column:
    """The angle at a cone's tip between its axis and u."""
    t2, u2, tu = squared_norm(tip), squared_norm(u), dot(tip, u)
    num = tu * (t2 + 1) - t2 * (u2 + 1)
    den = norm(tip) * l2(tip, u) * F.sqrt(u2 * t2 + 1 - tu * 2)
    return F.acos(F.least(F.greatest(num / F.greatest(den, F.lit(eps)), F.lit(-1 + eps)), F.lit(1 - eps)))


def cone_energy(tip: Column, u: Column) -> Column:
    return F.greatest(F.lit(0.0), cone_angle(tip, u) - half_aperture(tip))


def static_score(subject: Column, object_: Column, distance: Column, weight: float = 1000.0) -> Column:
    """Smaller is better: the distance, scaled by how much farther out the object lies."""
    return (F.lit(1.0) + (norm(object_) - norm(subject)) * weight) * distance


#: Score functions by name: (query vector, candidate vector, curvature, weight) -> Column, and whether less is better.
SCORES = {
    "cosine": (lambda q, v, k, w: cosine(q, v, normalised=False), False),
    "inner": (lambda q, v, k, w: dot(q, v), False),
    "l2": (lambda q, v, k, w: l2(q, v), True),
    "poincare": (lambda q, v, k, w: poincare(q, v, k), True),
    "subsumption": (lambda q, v, k, w: subsumption(poincare(q, v, k, eps=0.0), depth(squared_norm(q), k), depth(squared_norm(v), k), w), False),
}
#: Those that are of this module, whatever is registered later.
OWN = dict(SCORES)


def register_score(name: str, build, ascending: bool) -> None:
    SCORES[name] = (build, ascending)
