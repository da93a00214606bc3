"""Rigid transforms as 16 row-major doubles, quaternions as (x, y, z, w).

All are flat column expressions, so they stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(m: Column, r: int, c: int) -> Column:
    return F.get(m, F.lit(4 * r + c))


def total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def matrix(px, py, pz, qx, qy, qz, qw) -> Column:
    """Transform of a position and a quaternion, which is normalised first."""
    n = qx * qx + qy * qy + qz * qz + qw * qw
    s = 2 / n
    rows = [
        [1 - s * (qy * qy + qz * qz), s * (qx * qy - qz * qw), s * (qx * qz + qy * qw), px],
        [s * (qx * qy + qz * qw), 1 - s * (qx * qx + qz * qz), s * (qy * qz - qx * qw), py],
        [s * (qx * qz - qy * qw), s * (qy * qz + qx * qw), 1 - s * (qx * qx + qy * qy), pz],
    ]
    return F.array(*[x for r in rows for x in r], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def compose(a: Column, b: Column) -> Column:
    return F.array(*[total([at(a, r, k) * at(b, k, c) for k in range(4)]) for r in range(4) for c in range(4)])


def inverse(m: Column) -> Column:
    """Transposed rotation, and the position turned back."""
    rows = [[at(m, c, r) for c in range(3)] + [-total([at(m, k, r) * at(m, k, 3) for k in range(3)])] for r in range(3)]
    return F.array(*[x for r in rows for x in r], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def position(m: Column) -> Column:
    return F.array(*[at(m, r, 3) for r in range(3)])


def quaternion(m: Column) -> Column:
    """Quaternion of a rotation, with w >= 0; computed from its largest component."""
    d = [at(m, k, k) for k in range(3)]
    trace = d[0] + d[1] + d[2]
    root = [F.sqrt(F.greatest(1 + 2 * d[k] - trace, F.lit(0.0))) for k in range(3)]
    rw = F.sqrt(F.greatest(1 + trace, F.lit(0.0)))
    diff = [at(m, 2, 1) - at(m, 1, 2), at(m, 0, 2) - at(m, 2, 0), at(m, 1, 0) - at(m, 0, 1)]
    both = lambda i, j: at(m, i, j) + at(m, j, i)
    from_w = F.array(*[diff[k] / (2 * rw) for k in range(3)], rw / 2)
    sides = []
    for k in range(3):
        parts = [root[k] / 2 if j == k else both(j, k) / (2 * root[k]) for j in range(3)]
        sides.append(F.array(*parts, diff[k] / (2 * root[k])))
    q = (
        F.when((trace >= d[0]) & (trace >= d[1]) & (trace >= d[2]), from_w)
        .when((d[0] >= d[1]) & (d[0] >= d[2]), sides[0])
        .when(d[1] >= d[2], sides[1])
        .otherwise(sides[2])
    )
    return F.when(F.get(q, F.lit(3)) < 0, F.transform(q, lambda x: -x)).otherwise(q)


def relative(frame: Column, pose: Column) -> Column:
    """``pose`` as seen from ``frame``."""
    return compose(inverse(frame), pose)


def flat12(m: Column) -> Column:
    """The upper three rows column by column: three rotation columns, then the position."""
    return F.array(*[at(m, r, c) for c in range(4) for r in range(3)])


def rotation6(v: Column, first: int = 0) -> Column:
    """Of nine rotation values from ``first`` on the first six; what follows stays."""
    return F.concat(F.slice(v, 1, first + 6), F.slice(v, F.lit(first + 10), F.size(v) - (first + 9)))


def gram_schmidt(v: Column) -> Column:
    """Two column vectors (six values) to a rotation, nine values column by column."""
    a, b = [[F.get(v, F.lit(k + o)) for k in range(3)] for o in (0, 3)]
    la = F.sqrt(total([x * x for x in a]))
    x = [c / la for c in a]
    dot = total([p * q for p, q in zip(x, b, strict=True)])
    y0 = [q - dot * p for p, q in zip(x, b, strict=True)]
    ly = F.sqrt(total([c * c for c in y0]))
    y = [c / ly for c in y0]
    z = [x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]]
    return F.array(*x, *y, *z)


def quaternion_product(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Product of two (w, x, y, z) quaternions."""
    w1, x1, y1, z1 = a
    w2, x2, y2, z2 = b
    return [
        w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2,
        w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2,
        w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2,
        w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2,
    ]


def axis_angle(axis: Sequence[Column], degrees: Column) -> list[Column]:
    """(w, x, y, z) quaternion of a turn by ``degrees`` about ``axis``, which need not have length 1."""
    half = F.radians(degrees) / 2
    length = F.sqrt(total([a * a for a in axis]))
    return [F.cos(half), *[F.sin(half) * a / length for a in axis]]


def turned(initial: Sequence[Column], axis: Sequence[Column], degrees: Column) -> list[Column]:
    """``initial`` (w, x, y, z) followed by a turn about ``axis`` in its own frame."""
    return quaternion_product(initial, axis_angle(axis, degrees))


def lerp(a: Column, b: Column, share: Column) -> Column:
    """Element-wise linear mix; quaternion parts are not normalised again."""
    return F.zip_with(a, b, lambda x, y: x + (y - x) * share)
