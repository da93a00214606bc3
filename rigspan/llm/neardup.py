"""MinHash near-dedup: universal hash minima, banding, verified links, alternating stars.

1. Every document becomes the set of its word shingles as 64-bit hashes, and
   ``bands * rows`` minima of multiply-shift universal hashes over it. Equal
   sets meet by digest; the smallest id stands for them from here on.
2. Documents that agree in all rows of a band share a bucket. Each bucket
   links its members to one leader, drawn anew per band; no pairs within a
   bucket are spelled out.
3. Pairs whose signatures cannot come from the wanted similarity go. The rest
   are confirmed on the full shingle sets.
4. Alternating large-star and small-star joins make components.
5. Only where a bucket still holds several components, members outside its
   largest one meet the others block by block: signatures first, then the full
   sets, within the task, so only true links leave it. A leader that is near
   to neither end thus hides no link. Then the stars run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, few_or_shuffled, hot_keys, in_arrow, materialize, spread_join

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles; keeps the hashes of at most ``keep`` distinct words."""

    def __init__(self, size: int, keep: int = 300_000):
        self.size, self.keep, self.known = size, keep, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct shingle hashes. A-Z are lower-cased; words split at ASCII white space."""
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            hashes = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = list(map(known.__getitem__, words))
        h = np.array(hashes, np.uint64)
        k = min(self.size, len(h))
        out = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            out = mixed(out * MULTIPLIER + h[j : len(h) - k + 1 + j])
        return np.unique(out + np.uint64(k))


def _hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash (upper 32 bits of a*x + b) over the set."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512]
        low = np.minimum(low, ((a[:, None] * part[None, :] + b[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return low


def _signatures(batches: Iterator[pa.RecordBatch], size: int, n: int, seed: int) -> Iterator[pa.RecordBatch]:
    shingler, (a, b) = Shingler(size), _hash_family(n, seed)
    with np.errstate(over="ignore"):
        for batch in batches:
            digests, counts, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler(text)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                signatures.append(minima(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                ["id", "n", "digest", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(size)
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = [shingler(t).tobytes() for t in batch.column("text").to_pylist()]
            digests = [xxhash.xxh3_128_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["id", "digest", "set"]
            )


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket key per document and band, of signatures (documents x minima)."""
    s = signatures.reshape(len(signatures), bands, -1).astype(np.uint64)
    multipliers, _ = _hash_family(s.shape[2], 77)
    key = np.zeros(s.shape[:2], np.uint64)
    for r in range(s.shape[2]):
        key = mixed(key + s[:, :, r] * multipliers[r] + np.uint64(r + 1))
    return mixed(key + np.arange(bands, dtype=np.uint64)[None, :] * MULTIPLIER).view(np.int64)


def _stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _bands(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            if batch.num_rows:
                key = band_keys(_stacked(batch.column("signature")), bands)
                ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), bands)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key.ravel())], ["id", "bucket"])


def jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _block(table: pa.Table, bands: int, percent: int, least: float) -> pa.Table:
    """Links between the outside members of a bucket's block and its members of other components.

    A pair is looked at in the first band in which it agrees, hence once.
    """
    found: list[tuple[int, int]] = []
    ids, component, outside, n = (table.column(c).to_numpy() for c in ("id", "component", "outside", "n"))
    signatures, sets = _stacked(table.column("signature")), table.column("set").to_pylist()
    main, bucket = table.column("main")[0].as_py(), table.column("bucket")[0].as_py()
    inside = np.flatnonzero(~outside)
    with np.errstate(over="ignore"):
        for x in np.flatnonzero(outside):
            y = inside[component[inside] != component[x]]
            y = y[(component[y] == main) | (ids[y] > ids[x])]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            if not len(y):
                continue
            agree = signatures[y] == signatures[x]
            near = agree.mean(axis=1) >= least
            if not near.any():
                continue
            first = agree[near].reshape(near.sum(), bands, -1).all(axis=2).argmax(axis=1)
            band = int(np.flatnonzero(band_keys(signatures[x : x + 1], bands)[0] == bucket)[0])
            own = np.frombuffer(sets[x], np.uint64)
            for k in y[near][first == band]:
                if jaccard_at_least(own, np.frombuffer(sets[k], np.uint64), percent):
                    found.append((min(ids[x], ids[k]), max(ids[x], ids[k])))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
        keep = [jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sets]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _plausible(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        agree = _stacked(batch.column("sig_a")) == _stacked(batch.column("sig_b"))
        yield batch.select(["a", "b"]).filter(pa.array(agree.mean(axis=1) >= least))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` by alternating large-star and small-star.

    Returns (id, component): every node of a link and the smallest id that it
    reaches. Each turn is two aggregations and two joins, written to the shared
    folder; it ends once a turn changes no edge. A node with very many links is
    spread over tasks.
    """
    links = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        met = spread_join(both.where("v > u"), least.select("u", "m"), "u", hot_keys(least, "u", "n"), "v")
        large = materialize(met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: lower neighbours and the node itself to the least lower neighbour
        lowest = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        joined = spread_join(large, lowest.select("u", "m"), "u", hot_keys(lowest, "u", "n"), "v")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after = materialize(small)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(links, least, large, lowest)
        links = after
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _least_agreement(percent: int, n: int, deviations: float = 6) -> float:
    """Share of equal minima that a pair of the wanted similarity keeps, but for so many deviations."""
    j = percent / 100
    return j - deviations * (j * (1 - j) / n) ** 0.5


def _sets_of(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node and full shingle set of ``nodes(node, id, digest)``: of a text with that id and digest, spelled again."""
    nodes = materialize(nodes)
    rows = in_arrow(texts.join(few_or_shuffled(nodes.select("id").distinct()), "id", "left_semi"), partial(_sets, size=size), "id long, digest binary, set binary")
    out = materialize(rows.join(nodes, ["id", "digest"]).groupBy("node").agg(F.first("set").alias("set")))
    drop_table(nodes)
    return out


def _confirmed(pairs: DataFrame, chosen: DataFrame, texts: DataFrame, size: int, percent: int, n: int) -> DataFrame:
    """Of ``pairs(a, b)`` those that pass the signatures and then the full sets."""
    side = lambda k: chosen.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("signature").alias(f"sig_{k}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    )
    least, schema = _least_agreement(percent, n), pairs.select("a", "b").schema
    plausible = materialize(in_arrow(sized.select("a", "b", "sig_a", "sig_b"), partial(_plausible, least=least), schema))
    ends = plausible.select(F.explode(F.array("a", "b")).alias("node"))
    sets = _sets_of(texts, chosen.join(ends.distinct(), "node").select("node", "id", "digest"), size)
    # a node that very many pairs share is spread over tasks on both sides
    met, often = plausible, ends.groupBy("node").agg(F.count("*").alias("m"))
    often = materialize(often)
    for k, other in (("a", "b"), ("b", "a")):
        of = sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}"))
        met = spread_join(met, of, k, hot_keys(often.withColumnRenamed("node", k), k, "m"), other)
    out = materialize(in_arrow(met, partial(_similar, percent=percent), schema))
    drop_table(sets, plausible, often)
    return out


def _across(placed: DataFrame, chosen: DataFrame, texts: DataFrame, size: int, percent: int, bands: int, n: int, block: int = 32 << 20) -> DataFrame:
    """Links across components within buckets of ``placed(bucket, node, component, n)``.

    A bucket's members come in blocks of about ``block`` bytes, and so do its
    outside members; each pair of blocks is one group, so no group is larger.
    """
    weight = (8 * F.col("n") + 1024).alias("bytes")
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum(weight).alias("bytes"))
    main = parts.groupBy("bucket").agg(
        F.max_by("component", F.struct("m", "component")).alias("main"),
        F.max(F.struct("m", "component", "bytes")).getField("bytes").alias("most"),
        F.count("*").alias("k"), F.sum("m").alias("m"), F.sum("bytes").alias("bytes"),
    )
    slices = lambda size: F.ceil(size / block).cast("int")
    open_ = materialize(main.where("k > 1 and m > 2").select(
        "bucket", "main", "m", slices(F.col("bytes")).alias("ins"), slices(F.col("bytes") - F.col("most")).alias("outs")
    ))
    rows = spread_join(placed.select("bucket", "node", "component"), open_.drop("m"), "bucket", hot_keys(open_, "bucket", "m"), "node")
    placed_rows = materialize(rows.where("main is not null"))
    members = chosen.join(placed_rows.select("node").distinct(), "node")
    sets = _sets_of(texts, members.select("node", "id", "digest"), size)
    rows = placed_rows.join(chosen.select("node", "n", "signature"), "node").join(sets, "node")
    turn = F.xxhash64("node")
    inside = rows.withColumns({"outside": F.lit(False), "p": F.pmod(turn, "ins").cast("int"), "q": F.explode(F.sequence(F.lit(0), F.col("outs") - 1))})
    outside = rows.where("component <> main").withColumns(
        {"outside": F.lit(True), "q": F.pmod(turn, "outs").cast("int"), "p": F.explode(F.sequence(F.lit(0), F.col("ins") - 1))}
    )
    columns = ["bucket", "p", "q", "outside", F.col("node").alias("id"), "component", "main", "n", "signature", "set"]
    check = partial(_block, bands=bands, percent=percent, least=_least_agreement(percent, n))

    def run(table: pa.Table) -> pa.Table:
        return check(table)

    blocks = inside.select(columns).unionByName(outside.select(columns)).groupBy("bucket", "p", "q")
    out = materialize(blocks.applyInArrow(run, "a long, b long").distinct())
    drop_table(placed_rows, sets, open_)
    return out


def _judged(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Every document's id, n and digest, and of every digest the component and whether it stands for it.

    A node is a digest: equal sets are one, and texts that share an id are
    nodes of their own. Its number is made once and stored.
    """
    n = bands * rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = texts.select("id", F.lit(0).cast("long").alias("n"), F.col("text").alias("digest"), F.col("text").alias("signature")).schema
    table = materialize(in_arrow(texts, partial(_signatures, size=shingle, n=n, seed=seed), schema))
    known = table.where("id is not null and n > 0")
    # equal sets: one stands for all; a hot set is cut down before it is shuffled
    sets = known.groupBy("digest").agg(
        F.min("id").alias("id"), F.count("*").alias("m"), F.min_by(F.struct("n", "signature"), "id").alias("s")
    )
    chosen = materialize(sets.select(F.monotonically_increasing_id().alias("node"), "digest", "m", "id", "s.n", "s.signature"))

    bucket_schema = chosen.select(F.col("node").alias("id"), F.lit(0).cast("long").alias("bucket")).schema
    members = in_arrow(chosen.select(F.col("node").alias("id"), "signature"), partial(_bands, bands=bands), bucket_schema).withColumnRenamed("id", "node")
    leaders = members.groupBy("bucket").agg(
        F.count("*").alias("m"), F.min_by("node", F.xxhash64("node", "bucket")).alias("leader")
    )
    leaders = materialize(leaders.where("m > 1"))
    led = spread_join(members, leaders.select("bucket", "leader"), "bucket", hot_keys(leaders, "bucket", "m"), "node")
    crowded = materialize(led.where("leader is not null").select("bucket", "node", "leader"))
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    stars = crowded.where("node <> leader").select(*pair("node", "leader")).distinct()
    links = _confirmed(stars, chosen, texts, shingle, percent, n)
    found = components(links)

    placed = crowded.join(found.withColumnRenamed("id", "node"), "node", "left").join(chosen.select("node", "n"), "node")
    placed = placed.select("bucket", "node", F.coalesce("component", "node").alias("component"), "n")
    more = _across(placed, chosen, texts, shingle, percent, bands, n)
    if not more.isEmpty():
        found = components(links.unionByName(more))
    # the smallest id of a component names it; of nodes that share that id one stands for it
    of_node = chosen.select("digest", "m", F.col("node").alias("n0"), F.col("id").alias("first")).join(
        found.withColumnRenamed("id", "n0"), "n0", "left"
    ).withColumn("component", F.coalesce("component", "n0"))
    names = of_node.groupBy("component").agg(F.min(F.struct("first", "digest")).alias("s"), F.count("*").alias("k"))
    names = materialize(names.select("component", F.col("s.first").alias("component_id"), F.col("s.digest").alias("standing"), "k"))
    named = spread_join(of_node.select("component", "digest", "m"), names.drop("k"), "component", hot_keys(names, "component", "k"), "digest")
    of_digest = materialize(named.select("digest", "m", "component_id", (F.col("digest") == F.col("standing")).alias("stands")))
    drop_table(chosen, leaders, crowded, names)
    return table, of_digest


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, n_shingles, component_id and kept of every document.

    Linked are documents whose shingle sets have 100 * intersection >= percent
    * union; component_id is the smallest id that links reach. At the wanted
    similarity 0.8 a pair misses all of 32 bands of 5 rows with a chance of
    3.0e-6, and has 97 or fewer of 160 equal minima, which the signature checks
    refuse, with 1.4e-8: together at most 3.1e-6. Null and blank texts: no
    shingles, linked with nothing. Null ids: component_id null, not kept.
    Repeated ids: rows with one text are one document, rows with other texts
    are documents of their own. Other columns are left out.
    """
    table, of_digest = _judged(docs, shingle, percent, bands, rows, seed, id_col, text_col)
    all_docs = table.select("id", "n", "digest", F.xxhash64("id").alias("__spread"))
    out = spread_join(all_docs, of_digest.select("digest", "component_id"), "digest", hot_keys(of_digest, "digest", "m"), "__spread")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    result = materialize(
        out.select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        )
    )
    drop_table(table, of_digest)
    return result


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group of near-duplicates.

    Of a group the text with the smallest id stays; rows that repeat its id
    and set go but for one. Rows without an id or without shingles all stay.
    """
    table, of_digest = _judged(docs, shingle, percent, bands, rows, seed, id_col, text_col)
    known = table.where("id is not null and n > 0").select("id", "digest")
    verdicts = spread_join(known, of_digest.select("digest", "stands", "component_id"), "digest", hot_keys(of_digest, "digest", "m"), "id")
    stays = F.col("stands") & (F.col("id") == F.col("component_id"))
    per_id = verdicts.groupBy("id").agg(F.min(stays).alias("all"), F.count("*").alias("n"))
    # most ids have one row, which stays: those are passed through without a shuffle of their texts
    doubtful = materialize(per_id.where("not all or n > 1").select("id"))
    hint = few_or_shuffled(doubtful)
    plain = docs.join(hint.withColumnRenamed("id", "__id"), F.col(id_col).cast("long") == F.col("__id"), "left_anti")
    texts = docs.join(hint.withColumnRenamed("id", "__id"), F.col(id_col).cast("long") == F.col("__id"), "left_semi")
    standing = of_digest.where("stands").select(F.col("digest").alias("__digest"), F.col("component_id").alias("__least"))
    digest = partial(_with_digest, size=shingle, text_col=text_col)
    empty = F.lit(b"")
    schema = texts.withColumn("__digest", empty).schema
    schema["__digest"].nullable = True
    spelled = in_arrow(texts, digest, schema)
    bare = spelled.where("__digest is null").select(docs.columns)
    met = spelled.join(standing, "__digest").where(F.col(id_col).cast("long") == F.col("__least"))
    one = met.dropDuplicates(["__digest"]).select(docs.columns)
    return plain.select(docs.columns).unionByName(bare).unionByName(one)


def _with_digest(batches: Iterator[pa.RecordBatch], size: int, text_col: str) -> Iterator[pa.RecordBatch]:
    """Rows with the digest of their shingle set, null for an empty one."""
    shingler = Shingler(size)
    with np.errstate(over="ignore"):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            sets = [shingler(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t) for t in texts]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "__digest"])
