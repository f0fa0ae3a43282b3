"""Operator 2: shards by extendible hashing.

Rows hash by their id. The directory starts at as many prefix bits as the total asks for; only prefixes
whose rows exceed the byte limit are split on further bits, until every shard fits. Levels of the
directory are tables of prefixes; their size follows the number of shards, not of rows, and none of them
comes to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.frames import cut

BITS, STEP = 60, 8


def hash60(column: str) -> Column:
    """The first 60 bits of the md5 of an id as text; a null id counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _nodes(sums: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """(q, leaf_depth, leaf_bytes) for each prefix q at `depth` of sums (q, n): the highest node above it, from `top` bits on, that fits; null where none does.

    A node's bytes are those of all prefixes below it, so it fits if no node under it is needed.
    """
    level = F.explode(F.sequence(F.lit(top), F.lit(depth)))
    above = sums.select("q", "n", level.alias("d")).select("q", "n", "d", F.expr(f"shiftright(q, {depth} - d)").alias("at"))
    fits = above.groupBy("d", "at").agg(F.sum("n").alias("bytes")).where(F.col("bytes") <= limit)
    first = above.join(fits, ["d", "at"]).groupBy("q").agg(F.min(F.struct("d", "bytes")).alias("leaf"))
    return sums.join(first, "q", "left").select("q", "n", F.col("leaf.d").alias("leaf_depth"), F.col("leaf.bytes").alias("leaf_bytes"))


def assign_shards(docs: DataFrame, limit_bytes: int, id_column: str = "doc_id", text_column: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs with n_bytes, shard, depth and shard_bytes; columns of these names are replaced.

    A shard's name is its hash prefix in bits after an s. Rows of one id share all bits: where they exceed
    the limit together, they go by text, and copies of one text by as many as fit, named by a suffix. A
    single row over the limit is a shard of its own. Null texts count 0 bytes. An empty table stays empty.
    The directory is a table at every level and is broadcast up to `broadcast_rows` prefixes. Columns may have
    any name; where an id's rows exceed the limit, they may hold no maps, which can't be grouped.
    """
    names = [c for c in docs.columns if c not in ("n_bytes", "shard", "depth", "shard_bytes")]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    whole = F.struct(*(F.col(quoted(c)) for c in names)).alias("row")
    rows = docs.select(whole, hash60(quoted(id_column)).alias("h"), F.coalesce(F.octet_length(F.col(quoted(text_column)).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    sizes = cut(rows.select("h", "n_bytes"))
    total = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit_bytes))) + 2)
    few = lambda table: F.broadcast(table) if table.count() <= broadcast_rows else table
    top, over, levels = 0, None, []
    while True:
        part = sizes if over is None else sizes.join(over, F.shiftright("h", BITS - top) == F.col("up"), "left_semi")
        sums = part.groupBy(F.shiftright("h", BITS - depth).alias("q")).agg(F.sum("n_bytes").alias("n"))
        nodes = cut(_nodes(cut(sums), top, depth, limit_bytes))
        left = nodes.where("leaf_depth is null")
        last = depth == BITS or left.isEmpty()
        done = nodes.select("q", F.coalesce("leaf_depth", F.lit(BITS)).alias("own_depth"), F.coalesce("leaf_bytes", "n").alias("own_bytes")) if last else nodes.where("leaf_depth is not null").select("q", F.col("leaf_depth").alias("own_depth"), F.col("leaf_bytes").alias("own_bytes"))
        levels.append((depth, few(done)))
        if last:
            break
        over, top, depth = few(left.select(F.col("q").alias("up"))), depth, min(BITS, depth + STEP)
    rows = rows.select("*", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("shard_bytes"))
    for at, done in levels:
        rows = rows.join(done, F.when(F.col("depth").isNull(), F.shiftright("h", BITS - at)) == F.col("q"), "left")
        rows = rows.withColumns({"depth": F.coalesce("depth", "own_depth"), "shard_bytes": F.coalesce("shard_bytes", "own_bytes")}).drop("q", "own_depth", "own_bytes")
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin(F.expr(f"shiftright(h, {BITS} - depth)")), F.col("depth"), F.lit("0")))
    rows = rows.withColumn("shard", F.concat(F.lit("s"), bits))
    out = ["row.*", "n_bytes", "shard", "depth", "shard_bytes"]
    if left.isEmpty():
        return rows.select(*out)
    full, text = F.col("shard_bytes") > limit_bytes, F.coalesce(F.col(f"row.{quoted(text_column)}").cast("string"), F.lit(""))
    shared = rows.where(full).groupBy("row", "n_bytes", "shard", "depth").agg(F.count("*").alias("copies"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest("n_bytes", F.lit(1)))).cast("long")
    copies = shared.withColumn("fit", fit).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    named = F.concat("shard", F.lit("-"), F.substring(F.md5(text), 1, 16), F.lit("-"), F.floor(F.col("k") / F.col("fit")).cast("string"))
    held = F.least(F.col("fit"), F.col("copies") - F.floor(F.col("k") / F.col("fit")) * F.col("fit")) * F.col("n_bytes")
    split = copies.select("row", "n_bytes", named.alias("shard"), "depth", held.cast("long").alias("shard_bytes"))
    return rows.where(~full).select("row", *out[1:]).unionAll(split).select(*out)


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder for each shard of assign_shards()."""
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)


SQL = """WITH h AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
  p AS (SELECT doc_id, n_bytes, h, d, h >> (60 - d) AS p FROM h, (SELECT unnest(range(0, 61))::INT AS d)),
  s AS (SELECT doc_id, n_bytes, h, d, sum(n_bytes) OVER (PARTITION BY d, p) AS total FROM p),
  b AS (SELECT doc_id, any_value(n_bytes) AS n_bytes, any_value(h) AS h, coalesce(min(d) FILTER (WHERE total <= {limit}), 60) AS depth FROM s GROUP BY doc_id)
SELECT b.doc_id, b.n_bytes, CASE WHEN s.total > {limit} THEN 's' || lpad(bin(b.h), 60, '0') || '-' || substr(md5(coalesce(t.text, '')), 1, 16) || '-0' WHEN b.depth = 0 THEN 's' ELSE 's' || lpad(bin(b.h >> (60 - b.depth)), b.depth, '0') END AS shard,
  b.depth AS depth, CAST(s.total AS BIGINT) AS shard_bytes
FROM b JOIN s ON s.doc_id = b.doc_id AND s.d = b.depth JOIN documents t ON t.doc_id = b.doc_id"""
