"""Exact dedup over an extendible-hash index on shared files. DataFrame operations only.

One pass makes a narrow facts table (row, 64-bit key, digest, bytes) in the
shared folder. Keys are dealt to buckets by their leading bits: the directory
starts at the depth the whole table needs and doubles while a bucket holds more
bytes than its capacity, so it deepens with the data and where it is crowded.

Texts travel only where keys meet: a key with one row needs no comparison. The
texts of the other keys are grouped by their bytes, copies being combined before
the exchange, so a text that a third of all rows share costs each task one row.
What is left, one entry for each distinct text, goes to the owner task of its
bucket, which chains the entries of a key and writes the bucket. Rows then meet
the entries of repeated texts by key and digest: by broadcast while these are
few, else in a join whose skewed side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, tag_rows

CAPACITY_BYTES = 4 << 20
#: Key bits: beyond them no bucket can be split.
KEY_BITS = 64
#: Up to so many repeated keys (8 bytes each) are broadcast to the scan of the texts; beyond, all texts are grouped.
BROADCAST_KEYS = 1_000_000
#: Up to so many entries of repeated texts (about 150 bytes each) are broadcast to the rows; more are joined.
BROADCAST_ENTRIES = 200_000


def buckets(keys: DataFrame, capacity_bytes: int = CAPACITY_BYTES) -> DataFrame:
    """(key, n_bytes, ...), a stored table of distinct keys -> the same with bucket and depth.

    A bucket is named by the ``depth`` leading bits of its keys. It is split
    while it holds more than ``capacity_bytes`` and more than one key. Each
    round looks only at what is still overfull.
    """
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    depth = max(0, (int(total) // capacity_bytes).bit_length() - 1)
    rest, done = keys, None
    while True:
        lead = F.shiftrightunsigned("key", KEY_BITS - depth) if depth else F.lit(0).cast("long")
        named = rest.withColumn("bucket", lead).withColumn("depth", F.lit(depth))
        held = named.groupBy("bucket").agg(F.sum("n_bytes").alias("_held"), F.count(F.lit(1)).alias("_keys"))
        full = held.select("bucket", ((F.col("_held") > capacity_bytes) & (F.col("_keys") > 1)).alias("_full"))
        judged = cut(named.join(full, "bucket"), "dedup-directory")
        fits = judged.where(~F.col("_full")).drop("_full")
        done = fits if done is None else done.unionByName(fits)
        rest = judged.where("_full").drop("_full", "bucket", "depth")
        if depth == KEY_BITS or not rest.limit(1).count():
            return done
        depth += 1


def exact_index(
    facts: DataFrame, base: DataFrame, capacity_bytes: int = CAPACITY_BYTES, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """The index on shared files: bucket, depth, key, link, sha, group_size, keeper; one entry for each distinct text.

    ``link`` is the entry's place in the chain of its key, 0 unless keys collide.
    """
    keys = facts.groupBy("key").agg(F.max("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))
    owned = buckets(cut(keys, "dedup-keys"), capacity_bytes)
    entry = ("bucket", "depth", "key", "sha", "group_size", "keeper")
    met = owned.where("n_rows > 1").select("bucket", "depth", "key")
    texts = base.withColumn("norm", ascii_lower(F.col("text"))).withColumn("key", F.xxhash64("norm"))
    if met.count() <= broadcast_keys:
        texts = texts.join(F.broadcast(met.select("key")), "key", "left_semi")
    same = (
        texts.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "digest")).alias("keeper"))
        .select("key", F.sha2("norm", 256).alias("sha"), "group_size", "keeper")
    )
    alone = facts.join(owned.where("n_rows = 1").select("bucket", "depth", "key"), "key").select(
        "bucket", "depth", "key", "sha", F.lit(1).cast("long").alias("group_size"), F.struct("id", "digest").alias("keeper")
    )
    entries = alone.unionByName(same.join(met, "key").select(*entry))
    # the owner of a bucket has all of it: chains need no further exchange
    chain = Window.partitionBy("bucket", "key").orderBy("sha")
    owners = entries.repartition("bucket").withColumn("link", F.row_number().over(chain) - 1)
    return cut(owners.sortWithinPartitions("bucket", "key", "link"), "dedup-index")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity_bytes: int = CAPACITY_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the
    row with the largest id stays; of repeated rows with that id, one. A null id
    sorts below all others and a null text counts as empty. An empty table gives
    no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    # both passes over the texts name a row by its id and the hash of its text as it stands
    base = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    norm = ascii_lower(F.col("text"))
    facts = base.withColumn("norm", norm).select(
        "id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("digest"),
    )
    facts = cut(facts, "dedup-facts")
    index = exact_index(facts, base.withColumn("digest", F.xxhash64("text")), capacity_bytes)
    several = index.where("group_size > 1").select("key", "sha", "group_size", "keeper")
    hint = F.broadcast if several.count() <= BROADCAST_ENTRIES else lambda df: df
    # a row that meets no entry is alone with its text
    lead = F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("digest") == F.col("keeper.digest"))
    found = cut(tag_rows(facts).join(hint(several), ["key", "sha"], "left").withColumn("lead", F.col("keeper").isNull() | lead), "dedup-found")
    # rows that repeat id and text of the keeper: the one of the least row number stays
    one = found.where("lead and group_size > 1").groupBy("key", "sha").agg(F.min("_rid").alias("_one"))
    return found.join(hint(one), ["key", "sha"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("keeper").isNull(), F.col("id")).otherwise(F.col("keeper.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("lead") & F.coalesce(F.col("_rid") == F.col("_one"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without exact copies, all columns kept, whatever their names.

    The same rule as ``exact_groups``. Rows repeated with one id and equal texts
    are reduced by a shuffle of whole rows only when the table has such rows.
    """
    groups = cut(exact_groups(docs, id_col, text).where("kept"), "dedup-kept")
    kept = groups.select(F.col(id_col).alias("_dedup_id"), F.col("text_sha256").alias("_dedup_sha"))
    marked = docs.withColumn("_dedup_own", F.sha2(ascii_lower(F.col(text)), 256))
    out = marked.join(kept, F.col(id_col).eqNullSafe(F.col("_dedup_id")) & (F.col("_dedup_own") == F.col("_dedup_sha")), "left_semi")
    repeated = docs.groupBy(id_col).count().where("count > 1").limit(1).count()
    if repeated:
        out = out.dropDuplicates([id_col, "_dedup_own"])
    return out.select(*docs.columns)
