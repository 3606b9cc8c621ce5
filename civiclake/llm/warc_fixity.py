"""WARC: records with their byte ranges in archive files, and a Merkle fixity audit between two replicas.

``archive`` makes each page a WARC response record and gives it a file and an offset: files of about ``file_bytes``, records in the
order of their ids. ``merkle_tree`` hashes records; the records that begin in one range of ``range_bytes`` of a file make a node,
``fan`` neighbouring ranges the next, and so on to one hash a file and one for all files. ``audit`` compares the roots and then, level by
level, only the children of nodes that differ, down to the records.

Everything is DataFrame functions: a node's group is bounded by its range or by ``fan``, a file's running offsets by ``file_bytes``.

Defined results: a null url or markup is written as empty; a null id is written as empty and ordered by its record's hash; equal rows are
records of their own, next to each other in one file as far as they fit; equal replicas, empty ones included, give no rows; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclake.session import materialise


def warc_record(id_: Column, url: Column, body: Column) -> Column:
    """The bytes of a response record. No date is written, so that the same page gives the same record."""
    text = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"),
        F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n")).cast("binary")


def archive(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", body: str = "html", file_bytes: int = 64_000_000) -> DataFrame:
    """``file, offset, length, id, record`` of all pages: what a replica holds.

    Equal records are placed in runs of at most ``file_bytes``, the first by the record's hash, further ones by that and their number, so
    no file grows with the copies of one page. Only ids, lengths and hashes are ordered for the offsets; the bytes join them afterwards.
    """
    records = pages.select(F.col(id_col).alias("id"), warc_record(F.col(id_col), F.col(url), F.col(body)).alias("record"))
    records = records.withColumn("digest", F.sha2("record", 256))
    key = F.concat("digest", F.when(F.col("id").isNull(), "-").otherwise("+")).alias("key")
    light = records.select(key, "id", "digest", F.octet_length("record").cast("long").alias("length"))
    total = light.agg(F.sum("length")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    copies = light.groupBy("key").agg(F.min("id").alias("id"), F.min("digest").alias("digest"), F.min("length").alias("length"), F.count(F.lit(1)).alias("copies"))
    most = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(file_bytes) / F.col("length")))
    runs = copies.withColumn("most", most).withColumn("run", F.explode(F.expr("sequence(0L, (copies - 1) div most)")))
    runs = runs.withColumn("copies", F.least("most", F.col("copies") - F.col("run") * F.col("most")))
    placed_by = F.when(F.col("run") == 0, F.col("digest")).otherwise(F.sha2(F.concat_ws(":", "digest", "run"), 256))
    runs = runs.withColumn("file", F.conv(F.substring(placed_by, 1, 8), 16, 10).cast("long") % files)
    order = "partition by file order by id, digest, run rows between unbounded preceding and 1 preceding"
    runs = runs.withColumn("start", F.expr(f"coalesce(sum(length * copies) over ({order}), 0L)"))
    # One set of bytes for each record, however often it occurs.
    bytes_ = records.select(key, "record").dropDuplicates(["key"])
    found = runs.select("key", "file", "start", "length", "id", "copies").join(bytes_, "key")
    each = found.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    return each.select("file", (F.col("start") + F.col("copy") * F.col("length")).alias("offset"), "length", "id", "record")


def merkle_tree(replica: DataFrame, *, range_bytes: int = 65_536, fan: int = 16) -> list[DataFrame]:
    """Levels from the records up: ``file, node, hash`` with the node below's number divided by ``fan``; the last level is the root.

    The number of levels follows from the highest offset, so replicas must be cut with the same ``levels``: ``audit`` sees to that.
    """
    return _tree(replica, range_bytes, fan, _height(replica, range_bytes, fan))


def _height(replica: DataFrame, range_bytes: int, fan: int) -> int:
    most = replica.agg(F.max("offset")).first()[0] or 0
    nodes, levels = most // range_bytes + 1, 1
    while nodes > 1:
        nodes, levels = -(-nodes // fan), levels + 1
    return levels


def _combine(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A hash per group over its parts in order."""
    parts = F.sort_array(F.collect_list(F.struct(*order, "hash")))
    text = F.array_join(F.transform(parts, lambda p: F.concat_ws(":", *[p[c].cast("string") for c in order], p["hash"])), "\n")
    return rows.groupBy(*keys).agg(F.sha2(text, 256).alias("hash"))


def _tree(replica: DataFrame, range_bytes: int, fan: int, height: int) -> list[DataFrame]:
    leaves = replica.select("file", "offset", "length", "id", F.sha2("record", 256).alias("hash"))
    levels = [materialise(leaves.withColumn("parent", F.floor(F.col("offset") / range_bytes).cast("long")), "leaves")]
    below = levels[0].select("file", F.col("parent").alias("node"), "offset", "length", "hash")
    node = _combine(below, ["file", "node"], ["offset", "length"])
    for _ in range(height - 1):
        node = materialise(node.withColumn("parent", F.floor(F.col("node") / fan).cast("long")), "level")
        levels.append(node)
        node = _combine(node.select("file", F.col("parent").alias("up"), "node", "hash"), ["file", "up"], ["node"]).withColumnRenamed("up", "node")
    levels.append(materialise(node.withColumn("parent", F.lit(0).cast("long")), "files"))
    # Files in groups of 1,024, and groups again, until one hash stands for all.
    width = 1024
    groups = levels[-1].select(F.col("file").alias("node"), "hash")
    while True:
        up = _combine(groups.withColumn("up", F.floor(F.col("node") / width).cast("long")), ["up"], ["node"]).withColumnRenamed("up", "node")
        up = materialise(up, "root")
        if up.count() <= 1:
            return [*levels, up]
        groups = up


def audit(left: DataFrame, right: DataFrame, *, range_bytes: int = 65_536, fan: int = 16) -> DataFrame:
    """Records in which two replicas differ: ``file, offset, length, id, kind, left_hash, right_hash``.

    ``kind`` is ``changed`` (same range, other bytes), ``resized`` (other length), ``missing`` (on the left only) or ``extra``.
    """
    height = max(_height(left, range_bytes, fan), _height(right, range_bytes, fan))
    a, b = _tree(left, range_bytes, fan, height), _tree(right, range_bytes, fan, height)
    spark = left.sparkSession
    roots = [[tuple(r) for r in t[-1].collect()] for t in (a, b)]
    suspects = None
    if roots[0] == roots[1]:
        suspects = spark.createDataFrame([], "file long, node long")
    else:
        for x, y in reversed(list(zip(a[1:-1], b[1:-1]))):
            x = x.select("file", "node", "parent", F.col("hash").alias("left_hash"))
            y = y.select("file", "node", "parent", F.col("hash").alias("right_hash"))
            if suspects is not None:
                parents = suspects.withColumnRenamed("node", "parent")
                x, y = (t.join(parents, ["file", "parent"], "left_semi") for t in (x, y))
            both = x.join(y, ["file", "node", "parent"], "full")
            suspects = materialise(both.where("not (left_hash <=> right_hash)").select("file", "node"), "suspects")
    parents = suspects.withColumnRenamed("node", "parent")
    x, y = (t.join(parents, ["file", "parent"], "left_semi") for t in (a[0], b[0]))
    # Equal records at one place can't be told apart; they meet by their hashes and number.
    x = _numbered(x).select("file", "offset", "nth", F.col("length").alias("left_length"), F.col("id").alias("left_id"), F.col("hash").alias("left_hash"))
    y = _numbered(y).select("file", "offset", "nth", F.col("length").alias("right_length"), F.col("id").alias("right_id"), F.col("hash").alias("right_hash"))
    both = x.join(y, ["file", "offset", "nth"], "full").where("not (left_hash <=> right_hash)")
    kind = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").when(
        F.col("left_length") != F.col("right_length"), "resized").otherwise("changed")
    return both.select("file", "offset", F.coalesce("left_length", "right_length").alias("length"), F.coalesce("left_id", "right_id").alias("id"),
                       kind.alias("kind"), "left_hash", "right_hash")


def _numbered(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("nth", F.expr("row_number() over (partition by file, offset order by length, hash)"))


def damaged(replica: DataFrame, one_in: int = 10) -> DataFrame:
    """A copy with faults in about one of ``one_in`` records, by a hash of the id: a flipped byte, a cut end or the record gone."""
    number = F.conv(F.substring(F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")), 256), 1, 8), 16, 10).cast("long") % (3 * one_in)
    half = F.floor(F.col("length") / 2).cast("int")
    flipped = F.expr("concat(substring(record, 1, _half), cast('~' as binary), substring(record, _half + 2))")
    cut = F.expr("substring(record, 1, _half)")
    rows = replica.withColumn("_n", number).withColumn("_half", half).where("_n <> 2")
    return rows.withColumn("record", F.when(F.col("_n") == 0, flipped).when(F.col("_n") == 1, cut).otherwise(F.col("record"))).withColumn(
        "length", F.octet_length("record").cast("long")).drop("_n", "_half")
