"""Suffix-array dedup: remove bytes of long strings that start more than once, by merging shard Burrows-Wheeler transforms.

Texts are spelled in phrases: the leftmost smallest gram of every window of
grams is an anchor, and a phrase runs from one anchor to the next. Anchors
depend on the bytes around them alone, so equal strings hold equal anchors. A
task sorts the phrase suffixes of a shard of bounded size and keeps its
Burrows-Wheeler transform. The shards' transforms are merged by refining their
interleave: in step h a bucket of suffixes that share h - 1 phrases is split by
the phrase before each of them, and every shard says which part of its own order
falls into which bucket. Only buckets with two or more suffixes go on, so a
step's rows are the repeats alone, a shard sends one row for a bucket whatever
its size, and nothing is sorted again. The step at which a suffix is left alone
is its longest common prefix with any other, in phrases.

These repeated intervals decide all start positions whose string spans the same
phrases: if the phrases around the string occur twice, it does; if the phrases
inside it occur once, it does not. What is left lies at the ends of repeats,
where some occurrences of the inner phrases differ in the outer ones; there,
one occurrence for each outer spelling is compared byte for byte (by 128-bit
digests), first what the strings of neighbouring starts share and cover, then each
string where these do not decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, few_or_shuffled, in_arrow, materialize

#: Bytes of text in a shard, or one longer text.
SHARD_BYTES = 12 << 20
#: Neighbouring starts that are compared by what their strings share before each string is.
TILE = 16
#: Phrases to which suffixes are compared at most; strings of more phrases are compared byte for byte.
DEPTH = 10
#: Steps after which the transforms are cut down to what still repeats.
NARROW = (3, 7)
PIECE = 1 << 16
_BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Spelling:
    """How strings of ``least`` bytes are spelled: grams, windows of grams, and the bytes that a window spans."""

    def __init__(self, least: int):
        if least < 2 * TILE:
            raise ValueError(f"repeated strings have {2 * TILE} bytes at least")
        self.least, self.window = least, 3 * least // 10
        self.gram = 1 << (min(16, least // 8).bit_length() - 1)
        self.span = self.window + self.gram - 1


def anchors(data: np.ndarray, last: np.ndarray, spelling: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """The leftmost smallest grams of all windows that count, ascending, and the first window of each.

    ``last`` has for every byte the last window start of its text.
    """
    count = len(data) - spelling.span + 1
    found, first, before = [], [], -1
    for at in range(0, count, PIECE):
        to = min(at + PIECE, count)
        x = _BYTE[data[at : to + spelling.span - 1]]
        size, base = 1, np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            while size < spelling.gram:
                x = x[:-size] * base + x[size:]
                base, size = base * base, 2 * size
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
        # the hash above, the position below: a minimum finds both, and ties go left
        m = (x >> np.uint64(20) << np.uint64(20)) | np.arange(len(x), dtype=np.uint64)
        size = 1
        while 2 * size <= spelling.window:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < spelling.window:
            m = np.minimum(m[: size - spelling.window], m[spelling.window - size :])
        inside = np.flatnonzero(np.arange(at, to) <= last[at:to])
        m = (m[inside] & np.uint64((1 << 20) - 1)).astype(np.int64) + at
        new = np.flatnonzero(np.diff(m, prepend=before))
        if len(m):
            before = m[-1]
        found.append(m[new]), first.append(inside[new] + at)
    return (np.concatenate(found), np.concatenate(first)) if found else (np.zeros(0, np.int64),) * 2


def _halves(view: memoryview, bounds: Iterable[tuple[int, int]]) -> np.ndarray:
    """High and low 64 bits of the digest of every range of ``view``."""
    found = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in bounds])
    return np.frombuffer(found, ">u8").astype(np.uint64).reshape(-1, 2)


def _order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of all phrase strings in order, by doubling; every end is a symbol of its own."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    size, n = 1, len(rank)
    order = np.argsort(rank, kind="stable")
    while size < min(DEPTH, n):
        second = np.append(rank[size:] + 1, np.zeros(size, np.int64))
        key = rank * (n + len(ends) + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
        rank[order] = new
        if new[-1] == n - 1:
            break
        size *= 2
    return order


def _mix(lo: np.ndarray, hi: np.ndarray, lo_to: np.ndarray, hi_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the bucket of phrase (lo, hi) before bucket (lo_to, hi_to): 64 and 32 bits."""
    with np.errstate(over="ignore"):
        a = (lo ^ (lo_to * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
        a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        b = (hi.astype(np.uint64) ^ (hi_to.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + lo)) * np.uint64(0x165667B19E3779F9)
    return a ^ (a >> np.uint64(29)), ((b ^ (b >> np.uint64(31))) >> np.uint64(8)).astype(np.uint32)


SHARD = "shard string, digests array<binary>, bases binary, cuts binary, firsts binary, row_of binary, lo binary, hi binary, back binary, need binary, weight binary, copies array<bigint>"


def _shard(name: str, texts: dict[bytes, list], spelling: Spelling) -> pa.RecordBatch:
    """One shard's texts as cuts, suffix order and transform; positions run through all texts, one byte apart."""
    digests = sorted(texts)
    sizes = np.array([len(texts[d][0]) for d in digests], np.int64)
    bases = np.cumsum(sizes + 1) - sizes - 1
    data = b"\0".join(texts[d][0] for d in digests)
    # a window counts if it lies within one text
    last = np.repeat((bases + sizes - spelling.span).astype(np.int32), sizes + 1)
    real, first = anchors(np.frombuffer(data, np.uint8), last, spelling)
    cuts = np.union1d(np.union1d(real, bases), bases + sizes)
    firsts = np.full(len(cuts), -1, np.int64)
    firsts[np.searchsorted(cuts, real)] = first
    ends = np.searchsorted(cuts, bases + sizes)
    view = memoryview(data)
    lo, hi = np.zeros(len(cuts), np.uint64), np.zeros(len(cuts), np.uint32)
    spelled = _halves(view, zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
    lo[:-1] = spelled[:, 1]
    hi[:-1] = (spelled[:, 0] >> np.uint64(32)).astype(np.uint32)
    order = _order(lo, ends)
    row_of = np.empty(len(order), np.int32)
    row_of[order] = np.arange(len(order), dtype=np.int32)
    back = np.where(np.isin(order, np.searchsorted(cuts, bases)), -1, row_of[order - 1]).astype(np.int32)
    # phrases from a cut on that cover every string which starts in its first phrase
    after = np.append(cuts[1:], cuts[-1] + 1)
    end_of = np.repeat(ends, np.diff(ends, prepend=-1))
    need = np.minimum(np.searchsorted(cuts, after - 1 + spelling.least), end_of) - np.arange(len(cuts))
    copies = np.array([texts[d][1] for d in digests], np.int64)
    weight = np.repeat(copies, np.diff(ends, prepend=-1))[order].astype(np.int32)
    binary = lambda x: pa.array([x.tobytes()], pa.binary())
    columns = [
        pa.array([name]), pa.array([digests], pa.list_(pa.binary())), binary(bases), binary(cuts.astype(np.int32)), binary(firsts.astype(np.int32)), binary(row_of),
        binary(lo[order]), binary(hi[order]), binary(back), binary(np.minimum(need, DEPTH).astype(np.int8)[order]), binary(weight), pa.array([copies.tolist()], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHARD.split(", ")])


def _shards(spelling: Spelling) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, {}, 0
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if digest in held:
                    held[digest][1] += 1
                    continue
                held[digest] = [text, 1]
                size += len(text)
                if size >= SHARD_BYTES:
                    yield _shard(f"{part}-{count}", held, spelling)
                    count, held, size = count + 1, {}, 0
        if held:
            yield _shard(f"{part}-{count}", held, spelling)

    return run


INTERVAL = "lo long, hi int, shard string, first int, rows int, n long"


def _runs(lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, weight: np.ndarray, shard: str) -> dict[str, pa.Array]:
    """Intervals of a shard's order whose suffixes share a bucket; rows ascend."""
    new = np.ones(len(rows), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    at = np.flatnonzero(new)
    n = np.add.reduceat(weight, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    many = np.diff(np.append(at, len(rows)))
    return {
        "lo": pa.array(lo[at].view(np.int64)), "hi": pa.array(hi[at].view(np.int32)), "shard": pa.array([shard] * len(at), pa.string()),
        "first": pa.array(rows[at].astype(np.int32)), "rows": pa.array(many.astype(np.int32)), "n": pa.array(n.astype(np.int64)),
    }


def _array(table, column: str, kind) -> np.ndarray:
    return np.frombuffer(table.column(column)[0].as_py(), kind)


def _first_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of one phrase; an end is none."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            lo, hi, need, weight = (_array(one, c, t) for c, t in (("lo", np.uint64), ("hi", np.uint32), ("need", np.int8), ("weight", np.int32)))
            rows = np.flatnonzero(need > 0)
            yield pa.RecordBatch.from_pydict(_runs(lo[rows], hi[rows], rows, weight[rows], one.column("shard")[0].as_py()))


BACK = "shard string, row binary, back binary, lo binary, hi binary, need binary, weight binary"


def _members(alive: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a shard's order in any of its intervals, and which interval each is in; rows ascend."""
    first, rows = alive.column("first").to_numpy(), alive.column("rows").to_numpy()
    by = np.argsort(first, kind="stable")
    many = rows[by].astype(np.int64)
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[by].astype(np.int64), many), np.repeat(by, many)


def _pruned(shard: pa.Table, alive: pa.Table) -> pa.Table:
    """The part of a shard's transform that later steps may need: rows that repeat and whose phrase before repeats too."""
    if not shard.num_rows or not alive.num_rows:
        return pa.table({c.split()[0]: pa.array([], pa.string() if c.startswith("shard") else pa.binary()) for c in BACK.split(", ")})
    rows, _ = _members(alive)
    lo, hi, back, need, weight = (_array(shard, c, t) for c, t in (("lo", np.uint64), ("hi", np.uint32), ("back", np.int32), ("need", np.int8), ("weight", np.int32)))
    repeats = np.zeros(len(lo) + 1, bool)
    repeats[rows] = True  # the last place stands for no row before
    rows = rows[repeats[back[rows]]]
    to = back[rows]
    parts = (rows.astype(np.int32), to, lo[to], hi[to], need[to], weight[to])
    return pa.table([shard.column("shard"), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], [c.split()[0] for c in BACK.split(", ")])


def _narrowed(depth: int) -> Callable:
    """The part of a transform whose suffixes still repeat after ``depth`` phrases, before phrases that go on."""

    def run(shard: pa.Table, alive: pa.Table) -> pa.Table:
        if not shard.num_rows or not alive.num_rows:
            return shard.slice(0, 0)
        row, need = _array(shard, "row", np.int32), _array(shard, "need", np.int8)
        kept = np.isin(row, _members(alive)[0]) & (need > depth)
        kinds = {"row": np.int32, "back": np.int32, "lo": np.uint64, "hi": np.uint32, "need": np.int8, "weight": np.int32}
        return pa.table([shard.column("shard"), *[pa.array([_array(shard, c, t)[kept].tobytes()], pa.binary()) for c, t in kinds.items()]], shard.column_names)

    return run


def _next_step(depth: int) -> Callable:
    """Split every bucket by the phrase before its suffixes."""

    def run(shard: pa.Table, alive: pa.Table) -> pa.Table:
        if not shard.num_rows or not alive.num_rows:
            return pa.table(_runs(*[np.zeros(0, t) for t in (np.uint64, np.uint32, np.int64, np.int32)], ""))
        row, back, lo, hi, need, weight = (_array(shard, c, t) for c, t in (("row", np.int32), ("back", np.int32), ("lo", np.uint64), ("hi", np.uint32), ("need", np.int8), ("weight", np.int32)))
        rows, bucket = _members(alive)
        place = np.minimum(np.searchsorted(row, rows), max(0, len(row) - 1))
        kept = (row[place] == rows) & (need[place] >= depth) if len(row) else np.zeros(len(rows), bool)
        place, bucket = place[kept], bucket[kept]
        to_lo, to_hi = alive.column("lo").to_numpy().view(np.uint64)[bucket], alive.column("hi").to_numpy().view(np.uint32)[bucket]
        new_lo, new_hi = _mix(lo[place], hi[place], to_lo, to_hi)
        by = np.argsort(back[place], kind="stable")
        return pa.table(_runs(new_lo[by], new_hi[by], back[place][by], weight[place][by], shard.column("shard")[0].as_py()))

    return run


def _alive(sent: DataFrame) -> DataFrame:
    """Intervals of buckets with two suffixes or more over all shards; a shard has one row for a bucket."""
    total = F.sum("n").over(Window.partitionBy("lo", "hi"))
    return materialize(sent.withColumn("total", total).where("total >= 2").drop("n"))


SEGMENT = "digest binary, kind int, from int, to int, anchor int, lo long, hi int, depth int, outer_lo long, outer_hi int, outer_depth int"
SURE, OPEN, KNOWN = 0, 1, 2


def _segments(spelling: Spelling) -> Callable:
    """Start positions of every text that share inner and outer phrases, with what the intervals say of them.

    SURE: the outer phrases repeat. OPEN: only the inner ones do, and other
    occurrences have other outer ones. KNOWN: sure, and to be compared with
    open ones, one for each outer spelling of a shard.
    """

    def run(shard: pa.Table, alive: pa.Table) -> pa.Table:
        names, kinds = [c.split()[0] for c in SEGMENT.split(", ")], [pa.binary(), *[pa.int32()] * 4, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        if not shard.num_rows or not alive.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        bases, cuts, firsts, row_of = (_array(shard, c, t).astype(np.int64) for c, t in (("bases", np.int64), ("cuts", np.int32), ("firsts", np.int32), ("row_of", np.int32)))
        digests, single = shard.column("digests")[0].values, np.array(shard.column("copies")[0].as_py()) == 1
        depths = alive.column("depth").to_numpy()
        deepest = int(depths.max())
        # the interval of every suffix at every depth; -1: alone
        interval = np.full((deepest + 1, len(cuts)), -1, np.int64)
        for h in range(1, deepest + 1):
            at = np.flatnonzero(depths == h)
            rows, bucket = _members(alive.take(pa.array(at)))
            interval[h, rows] = at[bucket]
        total, lo, hi = (alive.column(c).to_numpy() for c in ("total", "lo", "hi"))

        def of(cut: np.ndarray, depth: np.ndarray) -> np.ndarray:
            return np.where(depth <= deepest, interval[np.minimum(depth, deepest), row_of[cut]], -1)

        real = np.flatnonzero(firsts >= 0)
        first = firsts[real]
        last = np.append(bases[1:] - 1, cuts[-1]) - spelling.least  # the last start of every text
        ahead = spelling.least - spelling.span
        text = np.searchsorted(bases, first, side="right") - 1
        own = np.searchsorted(bases, cuts, side="right") - 1
        # within a segment all strings have the same first and last phrases, whole and torn, so that
        # every occurrence of the outer ones is cut into the same segments
        starts = np.concatenate([cuts, cuts - spelling.least + 1, first, first - ahead])
        text = np.concatenate([own, own, text, text])
        starts = np.unique(starts[(starts >= bases[text]) & (starts <= last[text])])
        text = np.searchsorted(bases, starts, side="right") - 1
        stops = np.minimum(np.append(starts[1:], cuts[-1]) - 1, last[text])
        inner = real[np.searchsorted(first, starts, side="right") - 1]
        inner_depth = real[np.searchsorted(first, starts + ahead, side="right") - 1] - inner
        outer = np.searchsorted(cuts, starts, side="right") - 1
        outer_depth = np.searchsorted(cuts, stops + spelling.least) - outer
        inner_depth = np.minimum(inner_depth, DEPTH)
        a, b = of(inner, inner_depth), of(outer, outer_depth)
        inner_n, outer_n = np.where(a >= 0, total[a], 1), np.where(b >= 0, total[b], 1)
        # a text with copies repeats as a whole; it only lends its strings to others
        sure = np.flatnonzero((b >= 0) & single[text])
        known = np.flatnonzero((b >= 0) & (inner_n > outer_n))
        known = known[np.unique(a[known] * len(total) + b[known], return_index=True)[1]]
        open_ = np.flatnonzero((a >= 0) & (b < 0))
        out = []
        for kind, at in ((SURE, sure), (OPEN, open_), (KNOWN, known)):
            begin, end = starts[at], stops[at]
            if kind != KNOWN and len(at):  # neighbours in one run, open ones by their inner phrases
                apart = (np.diff(at, prepend=-2) > 1) | (np.diff(text[at], prepend=-1) != 0)
                if kind == OPEN:
                    apart |= (np.diff(inner[at], prepend=-1) != 0) | (np.diff(a[at], prepend=-1) != 0)
                new = np.flatnonzero(apart)
                end, at = end[np.append(new[1:], len(at)) - 1], at[new]
                begin = starts[at]
            base, none = bases[text[at]], kind == SURE
            id_of = lambda column, x: pa.array(column[x], mask=np.full(len(x), none))
            out.append(pa.table([
                digests.take(pa.array(text[at])), pa.array(np.full(len(at), kind, np.int32)), pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), pa.array((cuts[inner[at]] - base).astype(np.int32)),
                id_of(lo, a[at]), id_of(hi, a[at]), pa.array(inner_depth[at].astype(np.int32)),
                pa.array(lo[b[at]], mask=np.full(len(at), kind != KNOWN)), pa.array(hi[b[at]], mask=np.full(len(at), kind != KNOWN)), pa.array(outer_depth[at].astype(np.int32)),
            ], names))
        return pa.concat_tables(out)

    return run


#: Rows of digests that a task hands on at once.
ROWS = 200_000


def _columns(halves: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(halves[:, k]).view(np.int64)) for k in (1, 0)]


def _repeat(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n`` consecutive numbers from each of ``first`` on, and which of them each is from."""
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), which


def _tiled(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Tiles of ``TILE`` starts each, counted back from the anchor, that hold starts of an asked range.

    For each its key (row of the batch, last start), the range and whether it is open.
    """
    asked = batch.column("asked")
    rows = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
    from_, to, anchor, open_ = (x.to_numpy(zero_copy_only=False) for x in asked.flatten().flatten())
    from_, to, anchor = (x.astype(np.int64) for x in (from_, to, anchor))
    first, last = (anchor - to) // TILE, (anchor - from_) // TILE
    back, which = _repeat(first, last - first + 1)
    return (rows[which] << 32) + anchor[which] - TILE * back, from_[which], to[which], open_[which].astype(bool)


def _digested(texts: list[bytes], rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """High and low 64 bits of the digest of each range of its row's text; rows ascend."""
    at = np.searchsorted(rows, np.arange(len(texts) + 1))
    found = [_halves(memoryview(texts[k]), zip(begin[i:j].tolist(), end[i:j].tolist(), strict=True)) for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if i < j]
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


TILES = "low long, high long, whole_low long, whole_high long, digest binary, last int, open boolean"


def _tiles(least: int) -> Callable:
    """For every tile with an asked start: what all its strings share, and all that they cover (null beyond the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            key, _, _, open_ = _tiled(batch)
            by = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.diff(key[by], prepend=-1))  # a place counts once, whatever anchors lead to it
            opens, key = np.logical_or.reduceat(open_[by], at) if len(at) else np.zeros(0, bool), key[by][at]
            size = np.array([len(t) for t in texts], np.int64)
            for k in range(0, len(key), ROWS):
                rows, p = key[k : k + ROWS] >> 32, key[k : k + ROWS] & 0xFFFFFFFF
                shared = _digested(texts, rows, p, p - TILE + 1 + least)
                whole = _digested(texts, rows, np.maximum(0, p - TILE + 1), p + least)
                beyond = (p < TILE - 1) | (p + least > size[rows])
                covers = [pa.array(x.to_numpy(), mask=beyond) for x in _columns(whole)]
                rest = [batch.column("digest").take(pa.array(rows)), pa.array(p.astype(np.int32)), pa.array(opens[k : k + ROWS])]
                yield pa.RecordBatch.from_arrays([*_columns(shared), *covers, *rest], [c.split()[0] for c in TILES.split(", ")])

    return run


def _strings(least: int) -> Callable:
    """Digests of all strings with an asked start in a tile that is not alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tiles = batch.column("text").to_pylist(), batch.column("tiles")
            kept = np.repeat(np.arange(batch.num_rows), tiles.value_lengths().to_numpy(zero_copy_only=False)) << 32
            key, from_, to, open_ = _tiled(batch)
            found = np.flatnonzero(np.isin(key, kept + tiles.flatten().to_numpy()))
            found = found[np.argsort(key[found] >> 32, kind="stable")]
            rows, last = key[found] >> 32, key[found] & 0xFFFFFFFF
            begin, end = np.maximum(from_[found], last - TILE + 1), np.minimum(to[found], last) + 1
            for k in range(0, len(found), ROWS // TILE):
                part = slice(k, k + ROWS // TILE)
                starts, which = _repeat(begin[part], end[part] - begin[part])
                own = rows[part][which]
                columns = [*_columns(_digested(texts, own, starts, starts + least)), batch.column("digest").take(pa.array(own))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(starts.astype(np.int32)), pa.array(open_[found][part][which])], ["low", "high", "digest", "at", "open"])

    return run


def removed_spans(starts: list[tuple[int, int]], least: int, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of ``least`` bytes that start in the ranges (first, last) of a text of ``size`` bytes."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + least)
        else:
            out.append([a, b + least])
    return [(a, min(b, size)) for a, b in out]


def _cut(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, text, ranges in zip(*[batch.column(c).to_pylist() for c in ("digest", "text", "ranges")], strict=True):
                spans = removed_spans([(r["from"], r["to"]) for r in ranges], least, len(text))
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(memoryview(text)[at:a])
                    at = b
                kept.update(memoryview(text)[at:])
                rows.append((digest, spans, sum(b - a for a, b in spans), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([[{"from": a, "to": b} for a, b in r[1]] for r in rows], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.string()),
                ],
                ["digest", "spans", "n_removed", "kept_sha256"],
            )

    return run


def _texts(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """One row for each text whose digest is in ``digests``; copies are merged before they are shuffled."""
    return docs.join(few_or_shuffled(digests), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))


def repeated_intervals(docs: DataFrame, spelling: Spelling) -> tuple[DataFrame, DataFrame | None]:
    """Shards of ``docs(digest, text)`` and, for every depth, the intervals of their orders that hold repeated phrase strings."""
    shards = materialize(in_arrow(docs, _shards(spelling), SHARD))
    alive = _alive(in_arrow(shards.select("shard", "lo", "hi", "need", "weight"), _first_step, INTERVAL))
    moved = shards.select("shard", "lo", "hi", "back", "need", "weight")
    back = materialize(moved.groupBy("shard").cogroup(alive.groupBy("shard")).applyInArrow(_pruned, BACK))
    found, depth = None, 1
    while not alive.isEmpty():
        kept = alive.withColumn("depth", F.lit(depth))
        found = kept if found is None else found.unionByName(kept)
        if depth == DEPTH:
            break
        if depth in NARROW:
            wide, back = back, materialize(back.groupBy("shard").cogroup(alive.groupBy("shard")).applyInArrow(_narrowed(depth), BACK))
            drop_table(wide)
        depth += 1
        alive = _alive(back.groupBy("shard").cogroup(alive.groupBy("shard")).applyInArrow(_next_step(depth), INTERVAL))
    drop_table(back)
    return shards, found


def repeated_starts(docs: DataFrame, least: int) -> DataFrame | None:
    """Ranges of positions of ``docs(digest, text)`` at which a string of ``least`` bytes starts that starts elsewhere too: digest, ranges."""
    spelling = Spelling(least)
    shards, found = repeated_intervals(docs, spelling)
    if found is None:
        return None
    laid = shards.select("shard", "digests", "bases", "cuts", "firsts", "row_of", "copies")
    segments = materialize(laid.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(_segments(spelling), SEGMENT))
    texts = shards.select(F.explode(F.arrays_zip("digests", "copies")).alias("x")).groupBy(F.col("x.digests").alias("digest")).agg(F.sum("x.copies").alias("n"))
    copied = materialize(texts.where("n > 1").select("digest"))
    drop_table(shards)
    inner, asks = ["lo", "hi", "depth"], ["digest", "from", "to", "anchor"]
    # a text with copies repeats as a whole, but the strings that no interval covers it lends to others
    open_ = segments.where(F.col("kind") == OPEN).join(copied.withColumn("copy", F.lit(True)), "digest", "left").withColumn("open", F.col("copy").isNull())
    # without an open string among those of its inner phrases, a known one has nothing to be compared with
    known = segments.where(F.col("kind") == KNOWN).groupBy(*inner, "outer_lo", "outer_hi", "outer_depth").agg(F.min(F.struct(*asks)).alias("x"))
    known = known.join(open_.where("open").select(*inner).distinct(), inner, "left_semi").select("x.*", F.lit(False).alias("open"))
    asked = open_.select(*asks, "open").unionByName(known).groupBy("digest").agg(F.collect_list(F.struct("from", "to", "anchor", "open")).alias("asked"))
    asked = materialize(asked)
    tiles = materialize(in_arrow(_texts(docs, asked.select("digest")).join(asked, "digest"), _tiles(least), TILES))
    shared, whole, one = ["low", "high"], ["whole_low", "whole_high"], ["digest", "last", "open"]
    inside = tiles.where(F.col("whole_low").isNotNull())
    wholes = materialize(inside.groupBy(*shared, *whole).agg(F.count("*").alias("n"), F.min(F.struct(*one)).alias("x")))
    # all that a tile's strings cover occurs twice: so do they all
    twice = few_or_shuffled(wholes.where("n > 1").select(*whole))
    sure = inside.where("open").join(twice, whole, "left_semi").select("digest", (F.col("last") - (TILE - 1)).alias("from"), F.col("last").alias("to"))
    # else each string is compared, where tiles share something, with one tile of every repeated cover
    left = wholes.select(*shared, "x.digest", "x.last", (F.col("x.open") & (F.col("n") == 1)).alias("open"))
    left = left.unionByName(tiles.where(F.col("whole_low").isNull()).select(*shared, *one))
    several = left.groupBy(*shared).agg(F.count("*").alias("n"), F.bool_or("open").alias("asks")).where("n > 1 and asks").select(*shared)
    left = left.join(few_or_shuffled(several), shared, "left_semi").groupBy("digest").agg(F.collect_list("last").alias("tiles"))
    left = materialize(asked.join(left, "digest"))
    strings = materialize(in_arrow(_texts(docs, left.select("digest")).join(left, "digest"), _strings(least), "low long, high long, digest binary, at int, open boolean"))
    again = strings.groupBy("low", "high").agg(F.count("*").alias("n")).where("n > 1").select("low", "high")
    met = strings.where("open").join(few_or_shuffled(again), ["low", "high"], "left_semi").select("digest", F.col("at").alias("from"), F.col("at").alias("to"))
    found_sure = segments.where(F.col("kind") == SURE).select("digest", "from", "to")
    sure = found_sure.unionByName(sure).unionByName(met).join(copied, "digest", "left_anti")
    whole = copied.select("digest", F.lit(0).alias("from"), F.lit(1 << 30).alias("to"))
    ranges = materialize(sure.unionByName(whole).groupBy("digest").agg(F.collect_set(F.struct("from", "to")).alias("ranges")))
    drop_table(asked, tiles, wholes, left, strings, segments, copied)
    return ranges


def remove_repeats(docs: DataFrame, least: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the bytes of strings of ``least`` bytes that start anywhere else, same document included.

    Columns: id, n_bytes, n_removed, spans (removed runs as byte ranges, end
    excluded), n_spans, kept_sha256 (of the remaining bytes). Strings are
    judged on the input and never cross documents. Null texts count as empty;
    texts shorter than ``least`` lose nothing. A row is a document of its own,
    so rows that repeat a text of ``least`` bytes or more lose all of it,
    whatever their ids; null ids stay. An empty table has no rows. Other
    columns are left out, so their names cannot clash. Buckets are told apart
    by 96 bits and strings by 128 bits of a hash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    long_ = rows.where(F.octet_length("text") >= least).select("digest", "text")
    ranges = repeated_starts(long_, least)
    whole = rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    spans = "array<struct<`from`:int,`to`:int>>"
    if ranges is None:
        out = whole.withColumns({"spans": F.array().cast(spans), "n_removed": F.lit(0).cast("long"), "kept_sha256": F.col("whole")})
    else:
        cut = materialize(in_arrow(_texts(long_, ranges.select("digest")).join(ranges, "digest"), _cut(least), f"digest binary, spans {spans}, n_removed long, kept_sha256 string"))
        out = whole.join(cut, "digest", "left").withColumns({
            "spans": F.coalesce("spans", F.array().cast(spans)), "n_removed": F.coalesce("n_removed", F.lit(0).cast("long")), "kept_sha256": F.coalesce("kept_sha256", "whole"),
        })
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "spans", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
