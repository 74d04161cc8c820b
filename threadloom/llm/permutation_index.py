"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots and posted in the inverted files of the first few.  A query
probes the files of the first pivots in its own order.  What it meets there is ranked by the footrule distance of the
two orders, whose bound is, per query, a quantile over a bounded sample of the index; what passes is reranked by exact
inner products.  How many files are probed and which quantile is taken is measured: within the sample, TARGET of the
nearest have to be met by either.  Every row is indexed; only the pivots and that sample are fixed in number.

Equal vectors are one entry of the index with its smallest ids, as many as an answer can hold.  The file of a pivot is
dealt into blocks of bounded size, and so are the queries that probe it.  A query that found fewer neighbours than
there are (far from all pivots, or a small table) is searched again in all files and without a bound, as all are if
the caller asks for exact results.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save

PIVOTS = 256
#: Files that a vector is posted in, and positions of the pivots' order that count (the rest are equal last).
POSTED = 4
ORDERED = PIVOTS // 2
#: Rows whose footrule distances give a query's bound, how many of them are asked for their nearest, and the part of
#: these that the files, and the bound, have to let through.
SAMPLE, ASKED = 2048, 256
TARGET = 0.98
NEAREST = 20
QUERY_EVERY = 20
#: Vectors and queries of a block.
BLOCK_V, BLOCK_Q = 8192, 4096


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct vec_id, embedding (array of double) without vectors that take no part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
        .distinct()
    )


def positions(matrix, pivots, ordered: int):
    """Per row of the matrix: the place of each pivot in its order of nearness, `ordered` if later; and the order."""
    import numpy as np

    order = np.argsort(-(matrix @ pivots.T), axis=1, kind="stable")[:, :ordered]
    place = np.full((len(matrix), len(pivots)), ordered, np.uint8)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
    return place, order


def footrule(places, place):
    """Sum of absolute differences between one row of places and each of many."""
    import numpy as np

    return (np.maximum(places, place) - np.minimum(places, place)).sum(axis=1, dtype=np.int32)


def calibrated(sample, pivots, ordered: int, nearest: int) -> tuple[int, float]:
    """How many files to probe and the share of the index within a bound, for TARGET of the nearest within the sample."""
    import numpy as np

    place, order = positions(sample, pivots, ordered)
    score = sample[:ASKED] @ sample.T
    np.fill_diagonal(score, -np.inf)
    files, shares = [], []
    for i, best in enumerate(np.argsort(-score, axis=1, kind="stable")[:, : max(1, min(nearest, len(sample) - 1))]):
        far = np.sort(footrule(place, place[i]))
        shares.append(np.searchsorted(far, footrule(place[best], place[i]), "right") / len(far))
        files.append(place[i][order[best, :POSTED]].min(axis=1) + 1)
    least = lambda x: np.quantile(np.concatenate(x), TARGET, method="higher")
    return min(ordered, int(least(files))), float(least(shares))


def represented(entries: DataFrame, pivots, sample, ordered: int, posted: int, share: float = 1.0) -> DataFrame:
    """entries(node, embedding) to node, vector and place (binary), order (array of the first pivots), bound."""
    shipped = entries.sparkSession.sparkContext.broadcast((pivots, sample))

    def run(batches):
        import numpy as np

        pivots, sample = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                place, order = positions(matrix, pivots, ordered)
                if sample is None:
                    bound = [0] * len(place)
                else:
                    cut = max(0, math.ceil(share * len(sample)) - 1)
                    bound = [int(np.partition(footrule(sample, p), cut)[cut]) for p in place]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([r.tobytes() for r in matrix], pa.binary()),
                        pa.array([r.tobytes() for r in place], pa.binary()),
                        pa.array([r.tolist() for r in order[:, :posted]], pa.list_(pa.int32())),
                        pa.array(bound, pa.int32()),
                    ],
                    names=["node", "vector", "place", "order", "bound"],
                )

    return entries.select("node", "embedding").mapInArrow(
        run, "node long, vector binary, place binary, order array<int>, bound int"
    )


def search_blocks(index: DataFrame, queries: DataFrame, sizes: DataFrame, files: int, keep: int, bounded: bool) -> DataFrame:
    """Pairs q, v, score: per query and block, at most `keep` nearest of what passes.

    index and queries are represented, the queries' orders being the files that they probe: the first `files`, or all.
    """
    posts = index.select("node", "vector", "place", "order", F.posexplode("order").alias("rank", "pivot"))
    posts = posts.join(F.broadcast(sizes), "pivot").withColumn("sv", F.pmod(F.xxhash64("node"), "bv").cast("int"))
    asks = queries.select("node", "vector", "place", "bound", F.explode("order").alias("pivot"))
    asks = (
        asks.join(F.broadcast(sizes), "pivot")
        .withColumn("sq", F.pmod(F.xxhash64("node"), "bq").cast("int"))
        .withColumn("sv", F.explode(F.sequence(F.lit(0), F.col("bv") - 1)))
    )
    posts = posts.withColumn("sq", F.explode(F.sequence(F.lit(0), F.col("bq") - 1)))

    def run(asked: pa.Table, posted: pa.Table) -> pa.Table:
        import numpy as np

        if not asked.num_rows or not posted.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        read = lambda t, c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, -1)
        vectors, places, nodes = read(posted, "vector", "<f8"), read(posted, "place", "u1"), posted.column("node").to_numpy()
        order = np.array(posted.column("order").to_pylist())
        earlier = np.arange(order.shape[1])[None, :] < posted.column("rank").to_numpy()[:, None]
        ask_v, ask_p = read(asked, "vector", "<f8"), read(asked, "place", "u1")
        bounds = asked.column("bound").to_numpy()
        out: list[list] = [[], [], []]
        for i, q in enumerate(asked.column("node").to_numpy()):
            if bounded:  # a pair belongs to the first of the vector's files that the query probes
                mine = np.flatnonzero(~((ask_p[i][order] < files) & earlier).any(axis=1))
                far = footrule(places[mine], ask_p[i])
                near = far <= bounds[i]
                if len(far) > keep:
                    near[np.argpartition(far, keep)[: keep + 1]] = True
                else:
                    near[:] = True
                mine = mine[near]
            else:
                mine = np.flatnonzero(~earlier.any(axis=1))
            score = vectors[mine] @ ask_v[i]
            if len(score) > keep:
                least = np.partition(score, len(score) - keep)[len(score) - keep]
                best = np.flatnonzero(score >= least)
                if len(best) > keep:  # ties at the end
                    best = best[np.lexsort((nodes[mine[best]], -score[best]))[:keep]]
                mine = mine[best]
            out[0].append(np.full(len(mine), q))
            out[1].append(nodes[mine])
            out[2].append((vectors[mine] * ask_v[i]).sum(axis=1))
        return pa.table({n: np.concatenate(c) for n, c in zip(("q", "v", "score"), out)})

    by = ["pivot", "sv", "sq"]
    asks, posts = asks.select(*by, "node", "vector", "place", "bound"), posts.select(*by, "node", "vector", "place", "order", "rank")
    return asks.groupBy(*by).cogroup(posts.groupBy(*by)).applyInArrow(run, "q long, v long, score double")


def best_of(found: DataFrame, keep: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "v"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= keep).drop("rank")


def nearest_neighbours(vectors: DataFrame, every: int = QUERY_EVERY, nearest: int = NEAREST, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the `nearest` found for each row of vectors(vec_id, embedding) with vec_id % every = 0.

    Nearness is the inner product in double precision; ties go to the smaller vec_id.  Vectors that are null, zero or
    empty, or hold a null or non-finite component, take no part, nor do those without a vec_id.  Inner products need
    one number of components: the most frequent one, the smaller of two, and vectors of another take no part.  With
    `exact`, every query is compared with every entry, by the same blocks.  Repeated rows count once; equal vectors under other ids are candidates like any others.
    Other columns are ignored.  An empty table, or one with a single vector, gives an empty result.
    """
    import numpy as np

    keep = nearest + 1  # the query itself may be among them
    rows = usable(vectors)
    common = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = common["size"]
    rows = save(rows.filter(F.size("embedding") == size), "vectors")
    nth = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    entries = save(
        rows.withColumn("nth", nth)
        .filter(F.col("nth") <= keep)
        .groupBy("embedding")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumn("node", F.get("ids", F.lit(0))),
        "entries",
    )
    asked = save(rows.filter(F.col("vec_id") % every == 0).join(entries.select("embedding", "node"), "embedding"), "queries")

    drawn = entries.orderBy(F.xxhash64("node"), "node").select("embedding").limit(PIVOTS + SAMPLE).collect()
    drawn = np.array([r["embedding"] for r in drawn], float).reshape(-1, size)
    pivots, sample = drawn[:PIVOTS], drawn[PIVOTS:]
    ordered = min(ORDERED, len(pivots))
    sampled = positions(sample, pivots, ordered)[0] if len(sample) else None
    total = entries.count()
    files, share = calibrated(sample, pivots, ordered, round(keep * len(sample) / total)) if len(sample) > 1 else (ordered, 1.0)
    index = save(represented(entries, pivots, None, ordered, POSTED), "index")
    queries = save(represented(asked.select("node", "embedding").distinct(), pivots, sampled, ordered, files, share), "query-orders")
    many = queries.count()
    sizes = index.select(F.explode("order").alias("pivot")).groupBy("pivot").count().select(
        "pivot", F.ceil(F.col("count") / BLOCK_V).cast("int").alias("bv"), F.lit(max(1, math.ceil(many / BLOCK_Q))).alias("bq")
    )  # a row per pivot

    if exact:
        everywhere = queries.withColumn("order", F.array(*[F.lit(p) for p in range(len(pivots))]))
        found = save(best_of(search_blocks(index, everywhere, sizes, files, keep, False), keep), "found")
    else:
        found = save(best_of(search_blocks(index, queries, sizes, files, keep, True), keep), "found")
    least = min(keep, total)
    short = queries.join(found.groupBy(F.col("q").alias("node")).agg(F.count("v").alias("n")).filter(F.col("n") >= least), "node", "left_anti")
    if not short.isEmpty():
        everywhere = short.withColumn("order", F.array(*[F.lit(p) for p in range(len(pivots))]))
        again = search_blocks(index, everywhere, sizes, files, keep, False)
        found = save(best_of(again, keep).unionByName(found.join(short.select(F.col("node").alias("q")), "q", "left_anti")), "found")

    ids = entries.select(F.col("node").alias("v"), "ids")
    listed = (
        found.join(ids, "v")
        .select("q", "score", F.explode("ids").alias("vec_id"))
        .withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
        .filter(F.col("n") <= keep)
        .groupBy("q")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    )
    return (
        asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
        .join(save(listed, "listed"), "q")
        .select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, nearest).alias("best"))
        .select("query_id", F.posexplode("best").alias("rank", "b"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))
    )
