"""N-gram Jaccard join by chosen paths (Christiani, Pagh, "Set similarity search beyond MinHash", 2017).

Texts with one set of word shingles are one record with a number of copies. Every record is embedded into ``coordinates``
min-hash values. In each run a record walks down the tree of buckets: from a bucket it follows each of its
coordinates with probability ``1 / (rate * coordinates)``, decided by a hash of the bucket and the value, so two records
share a path with a chance that grows with their similarity. Buckets of at most ``leaf`` records are compared all with
all on the embedding. Larger ones first lose their near copies (``peel``), which no path can split, and are then split
again, down to ``depth``, where what is left is compared in cells. The number of runs follows from the recall asked for at the
threshold, see ``runs_needed``.

Pairs that look similar enough (4.5 standard deviations below the threshold) only say which records belong
together: connected components of them are then compared exactly, on whole shingle sets, again in cells of
bounded size, so each pair of a component is met once and a group of any size is spread over many tasks. No pair leaves a
task: a record gets its number of links and the root of its links.

Defined results: a text of one to four words has one shingle, all its words; a text without words (or null) has no
links and a class of its own. Repeated rows are copies of each other. A class is named by the smallest id in
it; an id may be null or repeated, classes go by texts. Further columns don't matter.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.llm.words import Words, mix, pieces, release_memory
from civiclake.operators.components import connected_components
from civiclake.session import materialise

#: Bytes of text whose words and shingles are held at once; a longer text alone.
PIECE = 250_000
_SKETCH = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])
_SKETCH_PA = pa.struct([("key", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary())])


def runs_needed(recall: float, threshold: float, rate: float, depth: int) -> int:
    """Runs after which a pair at the threshold has shared a leaf with chance ``recall``.

    A pair's shared paths are a branching process with ``threshold / rate`` children on average (about Poisson).
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-threshold / rate * alive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of all shingles, text by text; a shorter text is one shingle."""
    start, h = w.windows(size)
    doc = w.doc[start]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            with np.errstate(over="ignore"):
                for x in w.hash[w.first[d]:w.first[d + 1]]:
                    extra[i] = (extra[i] ^ x) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(extra + np.uint64(size))])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def _sets(w: Words, size: int) -> list[np.ndarray]:
    doc, h = shingles(w, size)
    cut = np.searchsorted(doc, np.arange(w.n_docs + 1))
    return [np.unique(h[cut[i]:cut[i + 1]]) for i in range(w.n_docs)]


def _keys(sets: list[np.ndarray]) -> list[bytes]:
    """16 bytes for each set, whatever order its members had."""
    sizes = np.array([len(s) for s in sets])
    first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    everything = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        return sums[first[1:]] - sums[first[:-1]]

    a, b = total(mix(everything)), total(mix(everything ^ np.uint64(0x5851F42D4C957F2D)))
    keys = np.stack([a, mix(b + sizes.astype(np.uint64))], 1)
    return [k.tobytes() for k in keys]


def sketcher(size: int, coordinates: int):
    """A column function: text -> key of its shingle set, its size and its min-hash embedding (4 bytes a coordinate)."""
    factors = np.random.default_rng(20170106).integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @F.arrow_udf(_SKETCH)
    def sketch(text: pa.Array) -> pa.Array:
        parts = []
        for lo, hi in pieces(text, PIECE):
            w = Words(text.slice(lo, hi - lo))
            sets = _sets(w, size)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            out = np.zeros((len(sets), coordinates), np.uint32)
            if len(full):
                members = np.concatenate(sets)
                first = np.concatenate(([0], np.cumsum(sizes)))[:-1][full]
                for k in range(coordinates):
                    out[full, k] = np.minimum.reduceat(members * factors[k], first) >> np.uint64(32)
            keys = [k if n else None for k, n in zip(_keys(sets), sizes)]
            parts.append(pa.StructArray.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes), pa.array([r.tobytes() for r in out], pa.binary())], ["key", "n", "sketch"]))
        release_memory()
        return pa.concat_arrays(parts) if parts else pa.array([], _SKETCH_PA)

    return sketch


def chooser(rate: float, coordinates: int, runs: int):
    """A column function: (bucket, sketch) -> the buckets that the record goes on to. At the root, bucket is null and every run begins."""
    limit = np.uint64(min(1.0, 1 / (rate * coordinates)) * (2**64 - 1))
    places = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def choose(bucket: pa.Array, sketch: pa.Array) -> pa.Array:
        s = np.frombuffer(b"".join(sketch.to_pylist()), np.uint32).reshape(-1, coordinates).astype(np.uint64)
        own = np.asarray(bucket.fill_null(0)).astype(np.uint64)
        root = np.asarray(bucket.is_null())
        out: list[np.ndarray] = []
        row: list[np.ndarray] = []
        for run in range(runs):
            node = np.where(root, np.uint64(run + 1), own)
            if run and not root.any():
                break
            path = mix(mix(s ^ places) ^ mix(node)[:, None])
            hit = path <= limit
            if run:
                hit &= root[:, None]
            r, k = np.nonzero(hit)
            out.append(mix(path[r, k] ^ np.uint64(0xA24BAED4963EE407)))
            row.append(r)
        r, v = np.concatenate(row), np.concatenate(out)
        order = np.argsort(r, kind="stable")
        cut = np.searchsorted(r[order], np.arange(len(s) + 1))
        return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(v[order].view(np.int64)))

    return choose


def _labels(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each row's connected component in a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _by_group(batches, *names):
    """Whole groups of rows that stand together, as (group, table): rows arrive sorted by ``names``."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(n)) for n in names]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows]):
            now = tuple(c[a] for c in columns)
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


_EDGE = "a binary, b binary"


def _peel_group(coordinates: int, least: int, near: int):
    def run(batches):
        for (bucket, _), rows in _by_group(batches, "bucket", "salt"):
            s = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint32).reshape(-1, coordinates)
            pivot, keys = np.asarray(rows["pivot"]), rows["key"].to_pylist()
            lead, rest = np.flatnonzero(pivot), np.flatnonzero(~pivot)
            same = np.zeros((len(rest), len(lead)), np.int16)
            for k in range(coordinates):
                same += s[rest, k][:, None] == s[lead, k][None, :]
            a, b = [], []
            # A row is linked to one pivot that looks similar, and to others only where that joins pivots not joined so far.
            joined = list(range(len(lead)))

            def root(j: int) -> int:
                while joined[j] != j:
                    j = joined[j]
                return j

            for i, row in enumerate(same >= least):
                own = keys[rest[i]]
                base = None
                for j in sorted(np.flatnonzero(row), key=lambda j: keys[lead[j]] != own):
                    if base is None or root(j) != root(base):
                        if keys[lead[j]] != own:
                            a.append(own)
                            b.append(keys[lead[j]])
                        if base is not None:
                            joined[root(j)] = root(base)
                    base = j if base is None else base
            stay = np.flatnonzero(same.max(1, initial=0) < near) if len(lead) else np.arange(len(rest))
            a += [keys[rest[i]] for i in stay]
            b += [None] * len(stay)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(np.full(len(a), bucket, np.int64))], ["a", "b", "bucket"])

    return run


def with_sketches(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """``rows`` with the sketches of their keys: a key meets its sketch once, in however many buckets it is."""
    at = F.collect_list(F.struct(*[c for c in rows.columns if c != "key"])).alias("_at")
    return rows.groupBy("key").agg(at).join(sketches, "key").select("key", "sketch", F.inline("_at"))


def peel(level: DataFrame, large: DataFrame, sketches: DataFrame, coordinates: int, least: int, pivots: int = 16, chunk: int = 4096) -> DataFrame:
    """Compares all rows of large buckets with some ``pivots`` of the same bucket: edges ``a, b``, and with a null ``b`` the rows that stay.

    A group of near copies can't be split by its tokens. A row that agrees with a pivot on nine tenths of the embedding leaves: what
    is similar to it looks similar to that pivot as well, and is linked to it here. A bucket is dealt to tasks in chunks, its pivots
    to all of them, so the work grows with its size and not with the square.
    """
    rows = with_sketches(level.join(large.select("bucket", "size"), "bucket"), sketches)
    rows = rows.withColumn("salts", F.ceil(F.col("size") / chunk).cast("int"))
    leads = rows.where(F.pmod(F.xxhash64("key", "bucket"), F.ceil(F.col("size") / pivots)) == 0)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")).withColumn("pivot", F.lit(False)).unionByName(
        leads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("pivot", F.lit(True)))
    dealt = dealt.select("bucket", "salt", "pivot", "key", "sketch").repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "key")
    return dealt.mapInArrow(_peel_group(coordinates, least, math.ceil(0.9 * coordinates)), "a binary, b binary, bucket long")


def _leaf_edges(coordinates: int, least: int):
    def run(batches):
        a, b = [], []
        for _, rows in _by_group(batches, "bucket"):
            s = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint32).reshape(-1, coordinates)
            same = np.zeros((len(s), len(s)), np.int16)
            for k in range(coordinates):
                same += s[:, k][:, None] == s[:, k][None, :]
            label = _labels(same >= least)
            moved = np.flatnonzero(label != np.arange(len(s)))
            if len(moved):
                keys = rows["key"].to_pylist()
                a += [keys[i] for i in moved]
                b += [keys[label[i]] for i in moved]
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def in_cells(rows: DataFrame, group: str, per_cell: int, weight: str | None = None, weight_per_cell: int = 1,
             values: DataFrame | None = None) -> DataFrame:
    """Rows of each group dealt to cells ``(group, _i, _j)``, i <= j, of at most about two chunks; every two rows meet in one cell.

    A group is cut into chunks of ``per_cell`` rows (or ``weight_per_cell`` of weight) by a hash of ``key``. ``values`` are joined on
    ``key`` before a row is repeated for its cells.
    """
    size = F.ceil(F.count(F.lit(1)) / per_cell)
    if weight:
        size = F.greatest(size, F.ceil(F.sum(weight) / weight_per_cell))
    sizes = rows.groupBy(group).agg(size.cast("int").alias("_parts"))
    own = rows.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int"))
    if values is not None:
        own = own.join(values, "key")
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    return own.withColumn("_other", other).withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))


def candidate_edges(records: DataFrame, *, coordinates: int, threshold: float, rate: float, depth: int, leaf: int, recall: float) -> DataFrame:
    """Edges ``(a, b)`` between keys; their components hold every pair that chosen paths bring together and that looks similar."""
    runs = runs_needed(recall, threshold, rate, depth)
    least = math.floor(coordinates * threshold - 4.5 * math.sqrt(coordinates * threshold * (1 - threshold)))
    choose = chooser(rate, coordinates, runs)
    sketches = records.select("key", "sketch")
    level = sketches.select("key", F.explode(choose(F.lit(None).cast("long"), "sketch")).alias("bucket"))
    leaves, peeled = [], []
    for step in range(depth):
        level = materialise(level, "paths")
        sizes = level.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("print")).where("size > 1")
        # Buckets with the same members need one comparison.
        small = sizes.where(F.col("size") <= leaf).groupBy("size", "print").agg(F.min("bucket").alias("bucket"))
        leaves.append(level.join(small.select("bucket"), "bucket"))
        large = materialise(sizes.where(F.col("size") > leaf).groupBy("size", "print").agg(F.min("bucket").alias("bucket")), "large")
        if large.isEmpty():
            break
        found = materialise(peel(level, large, sketches, coordinates, least), "peeled")
        peeled.append(found.where("b is not null").select("a", "b"))
        rest = found.where("b is null").select(F.col("a").alias("key"), "bucket")
        if step == depth - 1:
            leaves.append(rest.select("bucket", "key"))
        else:
            level = with_sketches(rest, sketches).select("key", F.explode(choose("bucket", "sketch")).alias("bucket"))
    leaves = reduce(DataFrame.unionByName, leaves)
    cells = in_cells(leaves, "bucket", leaf)
    placed = with_sketches(cells.select("key", F.xxhash64("bucket", "_i", "_j").alias("bucket")), sketches)
    dealt = placed.repartition("bucket").sortWithinPartitions("bucket", "key")
    edges = dealt.mapInArrow(_leaf_edges(coordinates, least), _EDGE)
    return reduce(DataFrame.unionByName, [edges, *peeled]).distinct()


_LINKS = "key binary, links long, set_links long, root binary, whole boolean"


def _exact_links(size: int, threshold: float):
    def overlap(sets: list[np.ndarray]) -> np.ndarray:
        sizes = [len(s) for s in sets]
        value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = count > 1
        keep = shared[column]
        row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        out = np.zeros((len(sets), len(sets)), np.float32)
        width = max(1, 4_000_000 // len(sets))
        for lo in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(column, [lo, lo + width])
            block = np.zeros((len(sets), width), np.float32)
            block[row[a:b], column[a:b] - lo] = 1
            out += block @ block.T
        return out

    def run(batches):
        out: list[tuple] = []
        for (_, i, j), rows in _by_group(batches, "component", "_i", "_j"):
            keys, own = rows["key"].to_pylist(), np.asarray(rows["_own"])
            copies, parts = np.asarray(rows["copies"]), np.asarray(rows["_parts"])
            sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
            n = np.array([len(s) for s in sets], np.float64)
            common = overlap(sets)
            linked = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= own[:, None] != own[None, :]
            label = _labels(linked)
            links, set_links = linked @ copies, linked.sum(1)
            whole = parts[0] == 1
            out += [(keys[k], int(links[k]), int(set_links[k]), keys[label[k]], bool(whole)) for k in range(len(keys))
                    if set_links[k] or whole]
            if len(out) > 10_000:
                yield _link_batch(out)
                out = []
        yield _link_batch(out)

    return run


def _link_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "links", "set_links", "root", "whole"])


def shingle_bytes(size: int):
    """A column function: text -> its sorted shingle hashes, 8 bytes each, and their key."""
    kind = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    @F.arrow_udf(kind)
    def make(text: pa.Array) -> pa.Array:
        parts = []
        for lo, hi in pieces(text, PIECE):
            sets = _sets(Words(text.slice(lo, hi - lo)), size)
            parts.append(pa.StructArray.from_arrays(
                [pa.array(_keys(sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("key", pa.binary()), ("shingles", pa.binary())]))

    return make


def _jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8,
                    recall: float = 0.9999, coordinates: int = 64, rate: float = 0.5, depth: int = 3, leaf: int = 1024,
                    broadcast_rows: int = 1_000_000) -> DataFrame:
    """A row for each row of ``docs``: ``_id``, ``_key`` (of its shingle set), ``_root`` (a key that names its class), ``_class`` (smallest id), ``_links``, ``_set_links``
    (other documents, other sets with a Jaccard similarity of ``threshold`` or more), ``_copies`` (documents with its set) and
    ``_first`` (smallest id with its set).

    Up to ``broadcast_rows`` keys are broadcast (32 bytes each) to fetch the texts to compare; more are joined by a shuffle.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    hashed = F.xxhash64("_text").alias("text_hash")
    sketched = source.select("_id", hashed, sketcher(size, coordinates)(F.col("_text")).alias("s")).select("_id", "text_hash", "s.key", "s.n", "s.sketch")
    rows = materialise(sketched, "sketches")
    records = materialise(rows.where("key is not null").groupBy("key").agg(
        F.min(F.struct(F.col("_id").isNull(), "_id", "text_hash")).alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"),
        F.max("sketch").alias("sketch")).select("key", F.col("least._id").alias("first"), F.col("least.text_hash").alias("text_hash"), "copies", "n", "sketch"), "records")
    edges = candidate_edges(records, coordinates=coordinates, threshold=threshold, rate=rate, depth=depth, leaf=leaf, recall=recall)
    groups = materialise(connected_components(edges, "a", "b"), "groups")

    # Exact comparison inside the groups. Their texts are found by the first id with the set and a hash of that row's text, so an id that
    # stands on many rows meets few of them; the set itself decides.
    wanted = materialise(groups.withColumnRenamed("node", "key").join(records.select("key", "first", "text_hash", "copies", "n"), "key"), "wanted")
    lookup = wanted.select("first", "text_hash", F.col("key").alias("_wanted"))
    found = source.join(_bounded(lookup, broadcast_rows), F.col("_id").eqNullSafe(F.col("first")) & (F.xxhash64("_text") == F.col("text_hash")))
    sets = found.select("_wanted", "_text").mapInArrow(_wanted_sets(size), "key binary, shingles binary").dropDuplicates(["key"])
    cells = in_cells(wanted.select("key", "component", "copies", "n"), "component", leaf // 2, "n", 500_000, sets)
    dealt = cells.select("component", "_i", "_j", "_own", "_parts", "key", "copies", "shingles") \
        .repartition("component", "_i", "_j").sortWithinPartitions("component", "_i", "_j", "key")
    linked = materialise(dealt.mapInArrow(_exact_links(size, threshold), _LINKS), "links")
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"), F.sum("set_links").alias("set_links"))
    roots = linked.where("whole").select("key", "root")
    spread = materialise(linked.where("not whole and key <> root").select("key", "root"), "spread")
    if not spread.isEmpty():
        roots = roots.unionByName(connected_components(spread, "key", "root").select(F.col("node").alias("key"), F.col("component").alias("root")))
    known = records.select("key", "first", "copies").join(counts, "key", "left").join(roots, "key", "left").select(
        "key", "first", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("set_links", F.lit(0)).alias("set_links"))
    named = known.join(known.groupBy("root").agg(F.min("first").alias("class")), "root").select(
        "key", F.col("root").alias("_root"), "class", F.col("first").alias("_first"), F.col("copies").alias("_copies"),
        (F.col("links") + F.col("copies") - 1).alias("_links"), F.col("set_links").alias("_set_links"))
    out = rows.select("_id", "key").join(materialise(named, "classes"), "key", "left")
    return out.select(
        "_id", F.col("key").alias("_key"), "_root", F.when(F.col("key").isNull(), F.col("_id")).otherwise(F.col("class")).alias("_class"),
        F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("_set_links", F.lit(0)).alias("_set_links"),
        F.coalesce("_copies", F.lit(1)).alias("_copies"), F.coalesce("_first", "_id").alias("_first"))


def _wanted_sets(size: int):
    """(key, text) -> the text's shingles if they have that key; a few hundred rows at a time, since sets are as large as texts."""

    def run(batches):
        for batch in batches:
            wanted, text = batch.column(0), batch.column(1)
            for lo, hi in pieces(text, PIECE):
                sets = _sets(Words(text.slice(lo, hi - lo)), size)
                same = [(k, s.tobytes()) for k, s, w in zip(_keys(sets), sets, wanted.slice(lo, hi - lo).to_pylist()) if k == w]
                keys, values = zip(*same) if same else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["key", "shingles"])
            release_memory()

    return run


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Batches of at most ``most`` rows for what runs inside: rows here hold whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it is written already and has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def jaccard_classes(docs: DataFrame, **options) -> DataFrame:
    """See ``_jaccard_classes``; whatever handles texts or sets in Python does so a thousand rows at a time."""
    with arrow_rows(docs.sparkSession, 1000):
        return _jaccard_classes(docs, **options)


def one_of_each_class(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = 5, broadcast_rows: int = 1_000_000,
                      **options) -> DataFrame:
    """``docs`` with one row of each class: one with the class's smallest id. Rows without words all stay.

    Ids that stand on one row only are dropped by id; under a repeated id the shingle set tells which row is meant, and of
    several sets under a class's smallest id the smallest key stays.
    """
    classes = materialise(jaccard_classes(docs, id_col=id_col, text=text, size=size, broadcast_rows=broadcast_rows, **options), "by-row")
    repeated = materialise(classes.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_id").alias("_again")), "repeated")
    leaves = classes.where("_key is not null and not (_id <=> _class)").select(F.col("_id").alias("_gone")).unionByName(
        repeated.withColumnRenamed("_again", "_gone")).distinct()
    leaves = materialise(leaves, "leaving")
    rows = docs.select(F.struct(*docs.columns).alias("_row"))  # no column of the documents meets a name used here
    own_id, own_text = F.col("_row").getField(id_col), F.col("_row").getField(text)
    plain = rows.join(_bounded(leaves, broadcast_rows), own_id.eqNullSafe(F.col("_gone")), "left_anti").select("_row.*")
    if repeated.isEmpty():
        return plain
    again = rows.join(_bounded(repeated, broadcast_rows), own_id.eqNullSafe(F.col("_again")), "left_semi")
    again = again.withColumn("_set", shingle_bytes(size)(own_text)).withColumn("_own", F.col("_set.key"))
    keep = classes.where("_key is not null and (_id <=> _class)").groupBy("_root").agg(F.min("_key").alias("_key")).select("_key")
    held = again.join(keep, F.col("_own") == F.col("_key"), "left_semi").dropDuplicates(["_own"])
    wordless = again.where(F.length("_set.shingles") == 0)
    return plain.unionByName(held.select("_row.*")).unionByName(wordless.select("_row.*"))
