"""Column expressions of the per-row feature steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: gripper limits, closed and open
LIMITS = {
    ("master", "position"): (0.01244, 0.02417),
    ("puppet", "position"): (0.01844, 0.05800),
    ("master", "joint"): (-0.6842, 0.3083),
    ("puppet", "joint"): (-0.6213, 1.4910),
}
# fixed values: symmetric limits of a twist
TWIST_LIMITS = [0.03, 0.03, 0.03, 0.10, 0.10, 0.10]


def el(array: Column | str, k: int) -> Column:
    """Element k from 0; null beyond the end."""
    return F.get(array, F.lit(k))


def seconds(t_ns: Column) -> Column:
    return t_ns * 1e-9


def merged_seconds(secs: Column, nsecs: Column) -> Column:
    return secs + nsecs * 10e-10


def flag(x: Column) -> Column:
    return F.when(x, 1.0).otherwise(0.0)


def by_name(names: Column, values: Column, wanted: list[str] | Column, strict: bool = True) -> Column:
    """Values in the order of ``wanted`` names; a missing name raises, or gives null."""
    known = F.map_from_arrays(names, values)
    order = F.array(*[F.lit(n) for n in wanted]) if isinstance(wanted, list) else wanted
    if strict:
        return F.transform(order, lambda n: F.coalesce(F.try_element_at(known, n), F.raise_error(F.concat(F.lit("no joint "), n)).cast("double")))
    return F.transform(order, lambda n: F.try_element_at(known, n))


def width_of(names: Column, values: Column, fingers: list[str]) -> Column:
    """Gripper width: the sum of the named finger positions."""
    return F.aggregate(by_name(names, values, fingers), F.lit(0.0), lambda s, x: s + x)


def arm_and_width(position: Column, joints: int = 7) -> Column:
    """The first joints, then twice the last position."""
    return F.concat(F.slice(position, 1, joints), F.array(2 * F.element_at(position, -1)))


def pick(vector: Column | str, dims: list[int] | None = None, width: int | None = None) -> Column:
    """Dimensions by index list, else the first ``width``, else all."""
    if dims is None and width is None:
        return F.col(vector) if isinstance(vector, str) else vector
    return F.array(*[el(vector, k) for k in (dims if dims is not None else range(width))])


def linear(x: Column, from_: tuple[float, float], to: tuple[float, float]) -> Column:
    """The linear map that takes one pair of limits to another."""
    return (x - from_[0]) / (from_[1] - from_[0]) * (to[1] - to[0]) + to[0]


def normalise(x: Column, who: str, what: str) -> Column:
    return linear(x, LIMITS[who, what], (0.0, 1.0))


def unnormalise(x: Column, who: str, what: str) -> Column:
    return linear(x, (0.0, 1.0), LIMITS[who, what])


def leader_to_follower(x: Column, what: str) -> Column:
    return linear(x, LIMITS["master", what], LIMITS["puppet", what])


def convert(x: Column, who: str, from_: str, to: str) -> Column:
    return linear(x, LIMITS[who, from_], LIMITS[who, to])


def velocity(x: Column, who: str) -> Column:
    closed, open_ = LIMITS[who, "position"]
    return x / (open_ - closed)


def joint_middle(who: str) -> float:
    return sum(LIMITS[who, "joint"]) / 2


def two_arms(raw: Column) -> Column:
    """16 raw joints to 14: six joints and a normalised gripper per arm; mirrored fingers go."""
    grip = lambda k: F.array(normalise(el(raw, k), "puppet", "position"))
    return F.concat(F.slice(raw, 1, 6), grip(6), F.slice(raw, 9, 6), grip(14))


def arm_command(action: Column) -> Column:
    """14 action values to 16: grippers as positions, each with its mirrored finger."""
    def fingers(k: int) -> Column:
        g = unnormalise(el(action, k), "puppet", "position")
        return F.array(g, -g)

    return F.concat(F.slice(action, 1, 6), fingers(6), F.slice(action, 8, 6), fingers(13))


def _replace(vector: Column, k: int, value: Column) -> Column:
    return F.transform(vector, lambda x, i: F.when(i == k, value).otherwise(x))


def replace_dims(vector: Column, values: dict[int, Column]) -> Column:
    out = vector
    for k, v in values.items():
        out = _replace(out, k, v)
    return out


def clip(vector: Column, limits: list[float]) -> Column:
    return F.zip_with(vector, F.array(*[F.lit(x) for x in limits]), lambda x, m: F.greatest(F.least(x, m), -m))


def scatter(base: Column, dims: list[int], values: Column) -> Column:
    """``base`` with the given dimensions replaced by ``values`` in turn."""
    return replace_dims(base, {d: el(values, k) for k, d in enumerate(dims)})


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hand_label(x: Column) -> Column:
    """open or closed after rounding half to even."""
    return F.when(F.bround(x) < 0.5, "open").otherwise("closed")


def standardise(vector: Column, mean: list[float], std: list[float], scale: float = 255.0) -> Column:
    pairs = F.arrays_zip(F.array(*[F.lit(m) for m in mean]).alias("m"), F.array(*[F.lit(s) for s in std]).alias("s"))
    return F.zip_with(vector, pairs, lambda x, p: (x / scale - p["m"]) / p["s"])


def camera_members(name: Column) -> Column:
    """A stereo camera as its left and right members, any other as itself."""
    return F.when(F.endswith(name, F.lit("stereo")), F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(name))


def frame_slot(elapsed: Column, hz: float) -> tuple[Column, Column]:
    """Slot of a frame and the time left until the next one."""
    slot = F.floor(elapsed * hz)
    return slot, (1 + slot) / hz - elapsed
