"""Toxicity: a subsequence string-kernel SVM on Nystroem landmarks.

The kernel compares two strings by the character triples that both hold as
subsequences within a span of ``SPAN`` characters, each occurrence weighted by
``DECAY`` to the length of its span. Gaps and inserted characters thus only
lower a match. Texts are folded first: case, look-alike digits, punctuation
inside a word, and runs of single letters ("i d i o t") which become one word.

A sentence is read through windows: each of its words, and each two words that
follow one another, with the space between them as a character of its own, so
triples cross it. A sentence is as toxic as its worst window, a document as
its worst sentence.

Training: sentences of a bounded sample of labelled documents. A sentence of a
toxic document that clean ones hold too tells nothing and goes. The SVM
alternates between picking each toxic document's worst window and the clean
windows that score worst, and fitting a squared-hinge SVM in the space of the
landmarks. Sentences are cut, counted and scored in tasks; the driver gets
bounded lists of windows only. The weights over landmarks fold into one weight
per triple, so a task scores a window by a gather and a sum: exactly the sum
of kernel values to all landmarks. A logistic calibration on documents kept
out of the fit gives probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, in_arrow, materialize

SPAN = 5
DECAY = 0.8
CLASSES = 64
SPACE = CLASSES - 1
PIECE = 12  # words of more than twice as many letters are read in pieces, so that length does not dilute
OFFSETS = [(p, q) for q in range(2, SPAN) for p in range(1, q)]
# fixed values: characters that stand for letters
LOOKALIKES = dict(zip("013457@$|", "oieastasl", strict=True))
DROPPED, BREAK = -1, -2  # classes of a text's characters beside letters (1 to CLASSES - 2) and SPACE


@dataclass
class Model:
    """Weights per triple of character classes, a bias, and the calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES**3, np.float32))
    bias: float = -1.0
    slope: float = 0.0
    shift: float = -20.0

    def shared(self, df: DataFrame):
        """A broadcast of the plain values: one fixed size, whatever the data."""
        return df.sparkSession.sparkContext.broadcast((self.weights, self.bias, self.slope, self.shift))


def _class_of(c: str) -> int:
    c = LOOKALIKES.get(c, c).lower()[:1]
    if c.isspace():
        return SPACE
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + (ord(c) * 2654435761 >> 12) % (SPACE - 27) if c.isalnum() else DROPPED


_kept: dict[str, np.ndarray] = {}  # tables that a task computes once


def _class_table() -> np.ndarray:
    if "classes" not in _kept:
        table = np.array([_class_of(chr(c)) for c in range(1 << 16)], np.int16)
        table[[0, 10]] = BREAK
        _kept["classes"] = table
    return _kept["classes"]


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts' characters in one array, 0 where a sentence ends, and where each text begins in it.

    One space is left between words. Sentences end at a line's end, and at
    ``.``, ``!`` or ``?`` before white space.
    """
    codes = np.frombuffer("".join([t + "\0" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    c = _class_table()[np.minimum(codes, 0xFFFF)]
    if (high := codes > 0xFFFF).any():
        c[high] = [_class_of(chr(x)) for x in codes[high].tolist()]
    after = np.append(c[1:], BREAK)
    c[((codes == 46) | (codes == 33) | (codes == 63)) & ((after == SPACE) | (after == BREAK))] = BREAK
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    kept = c != DROPPED
    c, owner = c[kept], owner[kept]
    # of several marks side by side the first stays, as a break if one of them is
    mark = (c == SPACE) | (c == BREAK)
    first = mark & ~np.append(False, mark[:-1])
    hard = np.zeros(first.sum(), bool)
    hard[np.cumsum(first)[c == BREAK] - 1] = True
    c[first] = np.where(hard, 0, SPACE)
    kept = ~mark | first
    c, owner = c[kept], owner[kept]
    # spaces within runs of three or more single letters
    at = np.flatnonzero((c == SPACE) | (c == 0))
    if len(at) > 1:
        single = np.diff(at, prepend=-1) == 2
        joins = np.append(single[:-1] & single[1:], False) & (c[at] == SPACE)
        run = joins & (np.append(joins[1:], False) | np.append(False, joins[:-1]))
        kept = np.ones(len(c), bool)
        kept[at[run]] = False
        c, owner = c[kept], owner[kept]
    return c.astype(np.int32), np.searchsorted(owner, np.arange(len(texts)))


def units(c: np.ndarray) -> np.ndarray:
    """The unit (word, or piece of a long one) at each character; a break leaves numbers out, so that no two units meet over it."""
    n = len(c)
    at = np.flatnonzero((c == SPACE) | (c == 0))
    start = np.zeros(n, np.int64)
    start[at] = at + 1
    start = np.maximum.accumulate(start)  # where the word of each character begins
    step = np.where(c == 0, 3, (c == SPACE).astype(np.int64))
    lengths = np.diff(np.append(at, n), prepend=-1) - 1
    if (lengths > 2 * PIECE).any():
        long = np.repeat(lengths > 2 * PIECE, lengths + 1)[:n]
        offset = np.arange(n) - start
        step += long & (c != SPACE) & (c != 0) & (offset > 0) & (offset % PIECE == 0)
    return np.cumsum(step)


def spelled(text: str) -> list[list[str]]:
    """The sentences of a text, each as its units in the letters of their classes; "" between units of one word."""
    c, _ = fold([text])
    u = units(c)
    cut = np.flatnonzero((np.diff(u, prepend=0) > 0) & (c != SPACE) & (c != 0))
    shown = np.array([ord("\n"), *(ord(letter(x)) for x in range(1, CLASSES))], np.uint32)[c]
    line = np.insert(shown, cut, 1).tobytes().decode("utf-32-le")
    return [[x for w in s.split() for x in w.replace("\1", "\1\1").split("\1")] for s in line.split("\n") if s.strip()]


def letter(x: int) -> str:
    return " " if x == SPACE else chr(96 + x) if x < 27 else chr(0x100 + x)


def windows(sentence: list[str]) -> list[str]:
    """Units and neighbouring pairs of a sentence as :func:`spelled` gives it."""
    words, marks = [], []
    for k in range(len(sentence)):
        if sentence[k]:
            words.append(sentence[k])
            marks.append("" if k and not sentence[k - 1] else " ")
    return words + [a + m + b for a, m, b in zip(words, marks[1:], words[1:])]


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all windows in one array, each followed by SPAN zeros, and the windows' starts."""
    gap = "\0" * SPAN
    codes = np.frombuffer((gap.join(strings) + gap).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings)) + SPAN
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(strings) else np.zeros(0, np.int64)
    return np.where(codes == 32, SPACE, np.where(codes > 0x100, codes - 0x100, np.maximum(codes - 96, 0))), starts


def triples(classes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape of a subsequence: the triple at every position (0: none), and the shape's weight."""
    n = len(classes) - SPAN + 1
    for p, q in OFFSETS:
        a, b, c = classes[:n], classes[p : p + n], classes[q : q + n]
        yield np.where((a > 0) & (b > 0) & (c > 0), (a * CLASSES + b) * CLASSES + c, 0), DECAY ** (q + 1)


def norms(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(classes))
    for t, w in triples(classes):
        total[: len(t)] += (t > 0) * w * w
    return np.sqrt(np.maximum(np.add.reduceat(total, starts), 1e-12))


def decide(model: Model, strings: list[str]) -> np.ndarray:
    """The SVM's decision value of each window."""
    out = np.empty(len(strings))
    for at in range(0, len(strings), 20_000):
        classes, starts = encode(strings[at : at + 20_000])
        total = np.zeros(len(classes))
        for t, w in triples(classes):
            total[: len(t)] += model.weights[t] * w
        out[at : at + len(starts)] = np.add.reduceat(total, starts) / norms(classes, starts) + model.bias
    return out


def _norm_table() -> np.ndarray:
    """The norm of a window by its length: all its triples, each to the square of its weight."""
    if "norms" not in _kept:
        lengths = np.arange(4 * PIECE + 2)
        _kept["norms"] = np.sqrt(sum(np.maximum(lengths - q, 0) * DECAY ** (2 * (q + 1)) for _, q in OFFSETS))
    return _kept["norms"]


def worst(model: Model, texts: list[str]) -> np.ndarray:
    """The decision value of each text's worst window, all windows at once.

    Sums of triples within units and across neighbours give those of pairs.
    """
    c, begins = fold(texts)
    if not len(c):
        return np.full(len(texts), model.bias)
    u = units(c)
    n, top, lead = len(c), int(u[-1]) + 1, c == SPACE
    padded = np.concatenate([c, np.zeros(SPAN, np.int32)])
    middle = padded * np.int32(CLASSES)
    first = c * np.int32(CLASSES * CLASSES)
    unit = np.concatenate([u, np.full(SPAN, top + 9)]).astype(np.int32)
    base = unit[:n] - lead - np.int32(9) * (c == 0)
    inner, across = np.zeros(n, np.float32), np.zeros(n, np.float32)
    for q in range(2, SPAN):
        last = first + padded[q : q + n]
        value = model.weights.take(last + middle[1 : 1 + n])
        for p in range(2, q):
            value += model.weights.take(last + middle[p : p + n])
        value *= np.float32(DECAY ** (q + 1))
        gap = unit[q : q + n] - base  # 0: within a unit, 1: into the next one, more: over a break
        inner += value * (gap == 0)
        across += value * (gap == 1)
    s = np.bincount(u, inner, top + 1)
    length = np.bincount(u[(c > 0) & ~lead], minlength=top + 1)
    # a triple that starts at a space or reaches into the next unit belongs to the pair that ends there
    pair = s + np.bincount(np.where(lead, u, u + 1), across, top + 1)
    pair[1:] += s[:-1]
    both = length + np.bincount(u[lead], minlength=top + 1)
    both[1:] += length[:-1]
    norm = _norm_table()
    ratio = lambda x, y: x / np.maximum(norm[y], 1e-6)
    best = np.maximum(ratio(s, length), ratio(pair, both))
    low = np.append(u, top)[begins]
    ends = np.append(low[1:], top)
    out = np.zeros(len(texts))
    some = ends > low
    if some.any():
        out[some] = np.maximum.reduceat(best[:top], low[some])
    return out + model.bias


def scores(model: Model, texts: list[str | None], most: int = 30_000) -> np.ndarray:
    """Worst decision values of texts, taken together up to ``most`` characters at a time."""
    out, part, size = [], [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size > most:
            out.append(worst(model, part))
            part, size = [], 0
    return np.concatenate([*out, worst(model, part)]) if part or out else np.zeros(0)


def probability(model: Model, value: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * value + model.shift, -40, 40)))


def kernel_rows(strings: list[str], index: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel values of windows to all landmarks."""
    out = [np.zeros((0, table.shape[1]))]
    for at in range(0, len(strings), 500):
        classes, starts = encode(strings[at : at + 500])
        total = np.zeros((len(classes), table.shape[1]), np.float32)
        for t, w in triples(classes):
            total[: len(t)] += table[index[t]] * np.float32(w)
        out.append(np.add.reduceat(total, starts, axis=0) / norms(classes, starts)[:, None])
    return np.concatenate(out)


def landmark_table(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """index: triple to row; table: rows of the landmarks' weights; active: the triples."""
    pairs: dict[tuple[int, int], float] = {}
    for j, mark in enumerate(landmarks):
        classes, starts = encode([mark])
        norm = norms(classes, starts)[0]
        for t, w in triples(classes):
            for x in t[t > 0].tolist():
                pairs[x, j] = pairs.get((x, j), 0.0) + w / norm
    active = np.array(sorted({x for x, _ in pairs}), np.int64)
    index = np.zeros(CLASSES**3, np.int32)
    index[active] = np.arange(1, len(active) + 1)
    table = np.zeros((len(active) + 1, len(landmarks)), np.float32)
    for (x, j), w in pairs.items():
        table[index[x], j] = w
    return index, table, active


class Nystroem:
    """The space of the landmarks: kernel values times the inverse root of the landmarks' own."""

    def __init__(self, landmarks: list[str]):
        self.index, self.table, self.active = landmark_table(landmarks)
        gram = kernel_rows(landmarks, self.index, self.table)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        firm = values > 1e-3
        self.project = vectors[:, firm] / np.sqrt(values[firm])

    def __call__(self, strings: list[str]) -> np.ndarray:
        blocks = [kernel_rows(strings[at : at + 500], self.index, self.table) @ self.project for at in range(0, len(strings), 500)]
        return np.concatenate(blocks) if blocks else np.zeros((0, self.project.shape[1]))

    def folded(self, w: np.ndarray) -> np.ndarray:
        """One weight per triple from the weights in the space."""
        out = np.zeros(CLASSES**3)
        out[self.active] = self.table[1:] @ (self.project @ w)
        return out.astype(np.float32)


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps, the rows taken block by block; labels -1 and 1."""
    n, d = z.shape
    w, keep = np.zeros(d + 1), np.eye(d + 1) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(30):
        left, right = keep.copy(), np.zeros(d + 1)
        for at in range(0, n, 1000):
            x = np.hstack([z[at : at + 1000], np.ones((len(z[at : at + 1000]), 1))])
            own, v = y[at : at + 1000], weight[at : at + 1000]
            out = own * (x @ w) < 1
            a = x[out] * v[out, None]
            left += x[out].T @ a
            right += a.T @ own[out]
        step = np.linalg.solve(left, right)
        if np.abs(step - w).max() < 1e-7:
            break
        w = step
    return w[:-1], float(w[-1])


def calibrate(value: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, lightly held to a slope of 4."""
    x, w = np.column_stack([value, np.ones(len(value))]), np.array([4.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - toxic)) + np.array([0.1 * (w[0] - 4.0), 0.01 * w[1]])
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([0.1, 0.01])
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.1), float(w[1])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sentence: the document's id and label, a hash of the sentence, its windows of three letters or more."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            owner, marks, found = [], [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                for s in spelled(text) if text else []:
                    owner.append(k)
                    marks.append(xxhash.xxh3_64_intdigest(" ".join(s).encode()) - (1 << 63))
                    found.append(sorted({w for w in windows(s) if len(w) > 2}))
            take = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(take), part.column("y").take(take), pa.array(marks, pa.int64()), pa.array(found, pa.list_(pa.string()))],
                ["id", "y", "mark", "windows"],
            )


def _score_windows(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(window, ...)`` with value, rounded so that ties are ties on every machine."""
    held = model.shared(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            value = np.round(decide(model, batch.column("window").to_pylist()), 5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, "value"])

    schema = rows.withColumn("value", F.lit(0.0)).schema
    return in_arrow(rows, run, schema)


def _fit(sentences: DataFrame, n_clean: int, n_toxic: int, landmarks: int, rounds: int, most: int) -> Model:
    """Alternate between witnesses and fits; ``most`` bounds every list that the driver gets."""
    model = Model()
    distinct = sentences.groupBy("mark").agg(F.min("y").alias("y"), F.first("windows").alias("windows"))
    counts = materialize(
        distinct.select("y", F.explode("windows").alias("window")).groupBy("window")
        .agg(F.count_if(F.col("y") == 0).alias("k0"), F.count_if(F.col("y") == 1).alias("k1"))
    )
    shared = distinct.where("y = 0").select("mark")
    of_toxic = sentences.where("y = 1").join(shared, "mark", "left_anti").select("id", F.explode("windows").alias("window")).distinct()
    log_odds = F.log((F.col("k1") + 0.1) / (n_toxic + 1)) - F.log((F.col("k0") + 0.1) / (n_clean + 1))
    rank = F.round(F.when(log_odds > 0, log_odds * F.sqrt("k1")), 6)
    bags = materialize(of_toxic.join(counts.select("window", rank.alias("rank"), (F.col("k0") > F.col("k1")).alias("doubtful")), "window"))
    doubtful: set[str] = set()

    def votes(scored: DataFrame, by: str) -> dict[str, int]:
        """Each toxic document votes for its window of the largest ``by``; at most one row per document."""
        top = scored.where(F.col(by).isNotNull()).groupBy("id").agg(F.max(F.struct(by, "window", "doubtful")).alias("t")).select("t.*")
        rows = top.groupBy("window", "doubtful").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "window").limit(most).collect()
        doubtful.update(r.window for r in rows if r.doubtful)
        return {r.window: r.n for r in rows}

    def first_windows(rows: DataFrame, *order) -> list[str]:
        return [r.window for r in rows.orderBy(*order).select("window").limit(most).collect()]

    found = votes(bags, "rank")
    witnesses = {w: v for w, v in found.items() if v > 1 or len(found) < 200} or found
    clean = counts.where("k0 > 0").select("window", "k0")
    common = first_windows(clean, F.desc("k0"), "window")
    hard = first_windows(clean, F.xxhash64("window"), "window")
    best = first_windows(counts.withColumn("rank", rank).where("rank is not null"), F.desc("rank"), "window")
    half = landmarks // 2
    order = sorted(witnesses, key=lambda w: (-witnesses[w], w))[: half // 2]
    marks = list(dict.fromkeys(order + best[: half - len(order)]))
    draw = np.random.default_rng(7).permutation(len(common))
    marks = list(dict.fromkeys(marks + [common[k] for k in draw[: landmarks - len(marks)]]))
    if not witnesses or not hard:
        return model
    space = Nystroem(marks)
    for turn in range(rounds):
        positive = sorted(set(witnesses) - doubtful)
        negative = sorted(set(hard).difference(positive) | doubtful.intersection(witnesses))
        if not positive or not negative:
            break
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        weights = np.array([np.sqrt(witnesses[w]) for w in positive] + [1.0] * len(negative))
        weights[: len(positive)] *= 0.5 * len(negative) / weights[: len(positive)].sum()
        w, bias = svm(space(positive + negative), y, weights)
        model = Model(space.folded(w), bias)
        if turn < rounds - 1:
            worst_clean = first_windows(_score_windows(clean, model), F.desc("value"), "window")
            hard = sorted({*hard[: 2 * most // 3], *worst_clean})
            witnesses = votes(_score_windows(bags, model).where("value > 0"), "value") or witnesses
    drop_table(counts, bags)
    return model


def _worst_values(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(..., text)`` with the text's worst decision value in its place."""
    held = model.shared(rows)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            value = scores(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(value)], [*kept, "value"])

    return in_arrow(rows, run, rows.select(*kept, F.lit(0.0).alias("value")).schema)


def train(
    docs: DataFrame,
    labels: DataFrame,
    most_toxic: int = 3000,
    most_clean: int = 5000,
    landmarks: int = 256,
    rounds: int = 4,
    most_windows: int = 3000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on a bounded sample of the labelled rows: the first ids of each class by a seeded hash.

    ``most_toxic`` and ``most_clean`` are the documented bound on labelled
    rows, ``most_windows`` that on each list of windows that the driver gets.
    A fifth of the sample is kept out of the fit and calibrates the
    probability; the classes weigh as in all labelled rows. Null ids, labels
    and texts are passed over, and so are ids that are labelled both ways.
    One class missing: every score is the smoothed base rate. The same rows
    give the same model, whatever their order.
    """
    y = F.col(label_col).cast("int")
    rows = labels.select(F.col(id_col).alias("id"), y.alias("y")).where("id is not null and y in (0, 1)")
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("__y")).where("y = __y").select("id", "y")
    total = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = [rows.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k, most in ((1, most_toxic), (0, most_clean))]
    picked = some[0].unionByName(some[1])  # bounded by the two parameters
    sample = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
        .join(F.broadcast(picked), "id")
        .select("id", "y", (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(5)) == 0).alias("held"), "text")
        .repartition(24, "id")
    )
    have = {(r.held, r.y): r.n for r in sample.groupBy("held", "y").agg(F.count("*").alias("n")).collect()}
    got = {k: have.get((True, k), 0) + have.get((False, k), 0) for k in (0, 1)}
    share = {k: total.get(k, 0) / got[k] if got[k] else 1.0 for k in got}
    base = (share[1] * got[1] + 0.5) / (sum(share[k] * got[k] for k in got) + 1.0) if sum(got.values()) else 0.01
    flat = Model(shift=float(np.log(base / (1 - base))))
    if not got[0] or not got[1]:
        return flat
    split = all(have.get((h, k), 0) for h in (True, False) for k in (0, 1))
    fitted = sample.where("not held") if split else sample
    sentences = materialize(in_arrow(fitted.select("id", "y", "text"), _cut, sample.select("id", "y", F.lit(0).cast("long").alias("mark"), F.array(F.lit("")).alias("windows")).schema))
    n = {k: have.get((False, k), 0) if split else got[k] for k in (0, 1)}
    model = _fit(sentences, n[0], n[1], landmarks, rounds, most_windows)
    if not model.weights.any():
        return flat
    on = sample.where("held") if split and sum(have.get((True, k), 0) for k in (0, 1)) >= 200 else sample
    judged = sorted((r.id, r.y, r.value) for r in _worst_values(on.select("id", "y", "text"), model).collect())  # a row per sampled document
    value, toxic = np.array([v for _, _, v in judged]), np.array([float(k) for _, k, _ in judged])
    weight = np.array([share[k] for _, k, _ in judged])
    model.slope, model.shift = calibrate(value, toxic, weight * len(weight) / weight.sum())
    drop_table(sample, sentences)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every document, from its whole text alone.

    Null, empty and blank texts score as a document without words. Rows are
    scored one by one: repeated rows and null ids stay. Other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = model.shared(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            found = probability(model, scores(model, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], ["id", "score"])

    schema = rows.select("id", F.lit(0.0).alias("score")).schema
    return in_arrow(rows, run, schema).select(F.col("id").alias(id_col), "score")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``.

    A null or empty text is kept or dropped as a document without words; rows
    are judged one by one, so repeated rows share their fate.
    """
    held = model.shared(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            found = probability(model, scores(model, batch.column(text_col).to_pylist()))
            yield batch.filter(pa.array(found < threshold))

    return in_arrow(docs, run, docs.schema)
