"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of characters.  Equal blocks get one integer name: the blocks of
a hash bucket are sorted and the name is the bucket with the block's dense rank, so two blocks share a name only if
they are equal.  Names of adjacent blocks are then paired and the pairs are named the same way, halving each document's
sequence per round, until one name is left.  That name with the number of rounds is the document's identity, without
any reliance on a hash being free of collisions.

A block or pair that holds a large share of all rows would send those rows to one task.  The `HEAVY` most frequent keys
(a bounded number of bounded blocks) are therefore named first, from their distinct values, and that dictionary is
broadcast; their rows are never gathered by key.  Any other key holds less than 1 / HEAVY of the rows.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import plain_text, save

#: Whitespace that the comparison ignores.
WHITE = r"[\x20\x09-\x0D]"
#: So many of the most frequent keys are named by a broadcast dictionary, if they have more than LEAST rows.
HEAVY = 1000
LEAST = 64
#: Characters of a block.
BLOCK = 8192


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def integer_names(df: DataFrame, keys: list[str], row: str, out: str) -> DataFrame:
    """df without `keys` and with a column `out`, an integer equal for two rows exactly if their keys are equal.

    Keys aren't null.  `row` is a column that spreads the rows of heavy keys over tasks.  df is evaluated three times.
    A name is 26 bits of bucket, one bit for the dictionary and 32 bits of rank within the bucket.
    """
    spark = df.sparkSession
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    top = hashed.groupBy("_hash").count().filter(F.col("count") > LEAST).orderBy(F.desc("count"), "_hash").limit(HEAVY)
    heavy = spark.createDataFrame(pa.table({"_hash": pa.array([r["_hash"] for r in top.collect()], pa.int64())}))
    bucket = F.shiftrightunsigned(F.col("_hash"), 38)
    name = F.shiftleft(F.col("_bucket"), 33).bitwiseOR(F.col("_rank").cast("long"))
    dictionary = (
        hashed.select("_hash", *keys)
        .join(F.broadcast(heavy), "_hash")
        .groupBy("_hash", *keys)
        .agg(F.lit(1).alias("_one"))
        .withColumn("_bucket", bucket)
        .withColumn("_rank", F.dense_rank().over(W.partitionBy("_bucket").orderBy(*keys)))
        .select(F.col("_hash").alias("_d_hash"), *[F.col(k).alias(f"_d_{k}") for k in keys], name.bitwiseOR(F.shiftleft(F.lit(1).cast("long"), 32)).alias("_known"))
    )
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_d_{k}") for k in keys], F.col("_hash") == F.col("_d_hash"))
    joined = hashed.join(F.broadcast(dictionary), same, "left")
    known = F.col("_known").isNotNull()
    slim = [F.when(~known, F.col(k)).alias(k) for k in keys]
    others = [c for c in df.columns if c not in keys]
    return (
        joined.select(*others, *slim, "_known", F.when(known, F.shiftrightunsigned(F.xxhash64(row), 38)).otherwise(bucket).alias("_bucket"))
        .withColumn("_rank", F.dense_rank().over(W.partitionBy("_bucket").orderBy(*keys)))
        .select(*others, F.coalesce("_known", name).alias(out))
    )


def text_identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_points, text_sha256, row_id, rounds, name.

    Two rows have equal normalised texts exactly if (rounds, name) are equal.  Null texts count as empty.
    """
    text = docs.select("doc_id", plain_text().alias("text"))
    norm = text.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        F.length("text").cast("long").alias("n_points"),
        normalised(F.col("text")).alias("norm"),
    ).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.length("norm") / F.lit(block))).cast("int"))
    pieces = norm.select(
        "row_id",
        "doc_id",
        "n_points",
        "n_blocks",
        F.sha2("norm", 256).alias("text_sha256"),
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("n_blocks") - 1),
                lambda i: F.struct(i.alias("at"), F.substring(F.col("norm"), i * block + 1, F.lit(block)).alias("block")),
            )
        ).alias("p"),
    ).select("row_id", "doc_id", "n_points", "n_blocks", F.when(F.col("p.at") == 0, F.col("text_sha256")).alias("text_sha256"), "p.at", "p.block")
    named = save(integer_names(pieces, ["block"], "row_id", "name"), "block-names")
    facts = named.filter("at = 0").select("row_id", "doc_id", "n_points", "text_sha256", "n_blocks", "name")
    done = [facts.filter("n_blocks = 1").select("row_id", F.lit(0).alias("rounds"), "name")]
    level = named.filter("n_blocks > 1").select("row_id", "at", "name", "n_blocks")
    rounds = 0
    while not level.isEmpty():
        rounds += 1
        pairs = level.groupBy("row_id", F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            F.shiftright(F.max("n_blocks") + 1, 1).alias("n_blocks"),
        )
        level = save(integer_names(pairs, ["left", "right"], "row_id", "name"), "pair-names")
        done.append(level.filter("n_blocks = 1").select("row_id", F.lit(rounds).alias("rounds"), "name"))
        level = level.filter("n_blocks > 1")
    if rounds == 0:
        return facts.select("row_id", "doc_id", "n_points", "text_sha256", F.lit(0).alias("rounds"), "name")
    identities = reduce(DataFrame.unionByName, done)
    return facts.drop("name", "n_blocks").join(identities, "row_id")


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared without the characters of WHITE, whole and block by block; a null text is an empty one.  Of equal texts the row with the
    most code points stays, then the smallest doc_id (a null doc_id last), then the first row.  Repeated rows form one
    group like any others.  Other columns are ignored.  An empty table gives an empty result.
    """
    rows = text_identities(docs, block)
    best = F.struct("n_points", (-F.col("doc_id")).alias("a"), (-F.col("row_id")).alias("b"))
    groups = rows.groupBy("rounds", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(best).alias("best"))
    groups = save(groups, "groups")  # a join of two tables, which is split where a group is large
    return rows.join(groups, ["rounds", "name"]).select(
        "doc_id",
        (-F.col("best.a")).alias("keep_id"),
        "group_size",
        (F.col("best.b") == -F.col("row_id")).alias("kept"),
        "text_sha256",
        "row_id",
    )
