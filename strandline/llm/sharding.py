"""Sharding by extendible hashing, in DataFrame operations only.

A row's key is hashed to ``KEY_BITS`` bits, and ``SALT_BITS`` more come from
the row's place in its input.  The directory is indexed by a prefix of that
bit string.  A bucket whose bytes exceed the limit is split on its next bit;
no other bucket is touched, so shards have different (local) depths.  Equal
keys share all key bits and separate on the salt bits, so that a key holding
a third of all rows still fills many shards.

Each round sums, for the buckets still too large, the bytes of all prefixes
up to ``step`` bits longer, and keeps as shards the shortest prefixes that
fit.  The number of rounds follows the logarithm of total bytes over limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import durable, free_name, small_or_shuffled

KEY_BITS = 40
SALT_BITS = 20
BITS = KEY_BITS + SALT_BITS
SHARD_BYTES = 64 * 1024 * 1024
#: Shards up to which the directory (three numbers a row) is sent to every task.
DIRECTORY_ROWS = 1_000_000


def _hash(key: Column, place: Column) -> Column:
    high = F.conv(F.substring(F.md5(key.cast("string")), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    low = F.pmod(F.xxhash64(place), F.lit(1 << SALT_BITS))
    return F.shiftleft(F.coalesce(high, F.lit(0).cast("bigint")), SALT_BITS).bitwiseOR(low)


def directory(keyed: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """Shards of ``keyed`` (h bigint of BITS bits, n_bytes): (depth, prefix, shard_bytes, shard_rows).

    A bucket that has used all bits stays whole although it exceeds the
    limit: that happens only to one row larger than the limit, or to equal
    keys that also agree in every salt bit.
    """
    open_, base, done = keyed.select("h", "n_bytes"), 0, None
    while base < BITS:
        to = min(BITS, base + step)
        cells = durable(open_.groupBy(F.shiftright("h", BITS - to).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
        first = 0 if base == 0 else base + 1
        prefixes = (
            cells.select(F.explode(F.sequence(F.lit(first), F.lit(to))).alias("depth"), "cell", "b", "n")
            .select("depth", F.expr(f"shiftright(cell, {to} - depth)").alias("prefix"), "b", "n")
            .groupBy("depth", "prefix")
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        )
        fits = F.col("shard_bytes") <= limit
        if to == BITS:
            fits = fits | (F.col("depth") == BITS)
        prefixes = durable(prefixes)
        parents = prefixes.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        leaves = prefixes.where(fits).withColumn("parent", F.shiftright("prefix", 1))
        # The parent of a bucket at the first depth of a round is known to be too large.
        own = leaves.where(F.col("depth") == first)
        below = leaves.where(F.col("depth") > first).join(parents, ["depth", "parent"], "left_semi")
        found = own.unionByName(below).select("depth", "prefix", "shard_bytes", "shard_rows")
        done = found if done is None else done.unionByName(found)
        large = durable(prefixes.where((F.col("depth") == to) & (F.col("shard_bytes") > limit)).select(F.col("prefix").alias("cell")))
        if to == BITS or large.isEmpty():
            break
        # Only rows of buckets that are still too large go on to the next round.
        open_ = durable(open_.withColumn("cell", F.shiftright("h", BITS - to)).join(small_or_shuffled(large), "cell", "left_semi").select("h", "n_bytes"))
        base = to
    return durable(done)


def assign_shards(df: DataFrame, key: str = "doc_id", size: Column | None = None, limit: int = SHARD_BYTES, keep: bool = False) -> DataFrame:
    """One row per row of ``df``: its key, n_bytes, shard (the bits of its bucket), shard_depth, shard_bytes.

    size: bytes of a row, default the UTF-8 length of ``text``; null counts 0.
    keep: also return the other columns of ``df`` (those with a clashing name
    get an underscore before it).  A null key has the hash of no bits, and
    its rows part on the salt.  An empty table gives no rows; repeated rows
    are all kept; a row larger than the limit is a shard of its own.
    """
    size = F.octet_length("text") if size is None else size
    names = {n: free_name(df, n) for n in ("h", "n_bytes", "shard", "shard_depth", "shard_bytes")} if keep else {}
    rows = df.select(*(df.columns if keep else [key]), _hash(F.col(key), F.monotonically_increasing_id()).alias(names.get("h", "h")), F.coalesce(size, F.lit(0)).cast("bigint").alias(names.get("n_bytes", "n_bytes")))
    h, b = names.get("h", "h"), names.get("n_bytes", "n_bytes")
    # The salt is fixed here: a row computed again after a loss can't change its shard.
    rows = durable(rows)
    shards = directory(rows.select(F.col(h).alias("h"), F.col(b).alias("n_bytes")), limit)
    # The directory proper: one entry per prefix of the greatest local depth, many of them to one bucket.
    depth = shards.agg(F.max("depth")).first()[0]
    if depth is None:
        return rows.select(*[c for c in rows.columns if c != h], F.lit("").alias(names.get("shard", "shard")), F.lit(0).alias(names.get("shard_depth", "shard_depth")), F.lit(0).cast("bigint").alias(names.get("shard_bytes", "shard_bytes")))
    depths = [r[0] for r in shards.select("depth").distinct().orderBy("depth").collect()]
    shards = durable(shards.select("depth", "prefix", "shard_bytes"))
    first = [c for c in rows.columns if c != h]
    shard, shard_depth, shard_bytes = (names.get(n, n) for n in ("shard", "shard_depth", "shard_bytes"))
    if shards.count() <= DIRECTORY_ROWS:
        # One look-up for each local depth; exactly one of them finds the row's bucket.
        depth_of, bytes_of, out = [], [], rows
        for d in depths:
            key_, held = free_name(out, f"_key{d}"), free_name(out, f"_held{d}")
            own = F.broadcast(shards.where(F.col("depth") == d).select(F.col("prefix").alias(key_), F.col("shard_bytes").alias(held)))
            out = out.join(own, F.shiftright(F.col(h), BITS - d) == F.col(key_), "left")
            depth_of.append(F.when(F.col(held).isNotNull(), F.lit(d)))
            bytes_of.append(F.col(held))
        out = out.select(*first, h, F.coalesce(*depth_of).alias(shard_depth), F.coalesce(*bytes_of).alias(shard_bytes))
    else:
        level, prefix = free_name(rows, "shard_level"), free_name(rows, "shard_prefix")
        found = shards.select(F.col("depth").alias(level), F.col("prefix").alias(prefix), F.col("shard_bytes").alias(shard_bytes))
        # Hashes, not whole rows, are looked up at every depth.
        probe = rows.select(h).distinct().withColumn(level, F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn(prefix, F.expr(f"shiftright(`{h}`, {BITS} - `{level}`)"))
        out = rows.join(probe.join(found, [level, prefix]), h).select(*first, h, F.col(level).alias(shard_depth), shard_bytes)
    start = F.expr(f"shiftright(`{h}`, {BITS} - `{shard_depth}`)")
    bits = F.when(F.col(shard_depth) == 0, F.lit("")).otherwise(F.lpad(F.conv(start.cast("string"), 10, 2), F.col(shard_depth), F.lit("0")))
    return out.withColumn(shard, bits).select(*first, shard, shard_depth, shard_bytes)
