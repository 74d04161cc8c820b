"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Words and shapes (letter case, digits and punctuation of a word) are named by a hash, so every token has a place in a
table of fixed size and none is cut off as rare.  Each place has a fixed sparse ternary index vector; the vector of a
word is the sum of the index vectors of its neighbours over the training sample.  A document is the mean of its words'
vectors, the mean of the vectors of their shapes and the share of repeated word pairs.  A network with one hidden layer
reads this; its logit is divided by a temperature fitted on a part of the sample kept for it.

Only the fit is on a sample, bounded by TRAIN labelled documents.  Every whole text is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain_text, save, small_batches

#: Bound of the training sample in documents.
TRAIN = 6000
#: Places of words and of shapes, in powers of two.
WORD_BITS, SHAPE_BITS = 15, 12
DIMENSIONS, NONZERO, WINDOW = 64, 4, 2
HIDDEN, STEPS, RATE, DECAY = 32, 400, 0.01, 1e-4
THRESHOLD = 0.3
#: Distinct words whose places a task keeps, each of at most so many characters; the places of others are made anew.
KEPT, KEPT_LENGTH = 100_000, 64

RUN = re.compile(r"(.)\1+", re.DOTALL)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def shape_of(word: str) -> str:
    """Letters as A or a, digits as 0, runs as one character."""
    if word.islower() and word.isalpha():
        return "a"
    chars = ["a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return RUN.sub(r"\1", "".join(chars))


def index_vectors(first: int, n: int):
    """The sparse ternary vectors of n places, from hashes of their numbers."""
    import numpy as np
    import xxhash

    out = np.zeros((n, DIMENSIONS), np.float32)
    draw = np.array([[xxhash.xxh32_intdigest(i.to_bytes(4, "little"), k) for k in range(NONZERO)] for i in range(first, first + n)], np.int64)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(n), draw[:, k] >> 1 & (DIMENSIONS - 1)), np.where(draw[:, k] & 1, 1, -1))
    return out


class Places:
    """The places of words and of their shapes in the table of vectors: words first, then shapes."""

    def __init__(self):
        self.kept: dict[str, tuple[int, int]] = {}

    def of(self, word: str) -> tuple[int, int]:
        import xxhash

        digest = lambda token, bits: xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass"), 42) >> (32 - bits)
        got = digest(word, WORD_BITS), (1 << WORD_BITS) + digest(shape_of(word), SHAPE_BITS)
        if len(word) <= KEPT_LENGTH:
            if len(self.kept) > KEPT:
                self.kept.clear()
            self.kept[word] = got
        return got

    def pairs(self, words) -> list[tuple[int, int]]:
        kept = self.kept
        return [kept.get(w) or self.of(w) for w in words]


def context_sums(sample: DataFrame) -> DataFrame:
    """place, vector: sums of the neighbours' index vectors over sample(text), one row per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        places, size = Places(), (1 << WORD_BITS) + (1 << SHAPE_BITS)
        index, total = index_vectors(0, size), np.zeros((size, DIMENSIONS), np.float32)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = text.split()
                for at in range(0, len(words), 50_000):
                    lo, hi = max(0, at - WINDOW), min(len(words), at + 50_000 + WINDOW)
                    both = np.array(places.pairs(words[lo:hi]), np.int64)
                    own = index[both[:, 0]] + index[both[:, 1]]
                    sums = np.vstack([np.zeros((1, DIMENSIONS)), np.cumsum(own, axis=0, dtype=np.float64)])
                    here = np.arange(at, min(len(words), at + 50_000)) - lo
                    around = sums[np.minimum(here + WINDOW + 1, hi - lo)] - sums[np.maximum(here - WINDOW, 0)] - own[here]
                    for ids in both[here].T:
                        order = np.argsort(ids, kind="stable")
                        starts = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
                        total[ids[order[starts]]] += np.add.reduceat(around[order], starts, axis=0)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        for at in range(0, len(used), 5000):
            part = used[at : at + 5000]
            values = pa.array(total[part].ravel().astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * DIMENSIONS, pa.int32()), values)], names=["place", "vector"]
            )

    each = sample.select("text").mapInArrow(run, "place long, vector array<double>")
    sums = F.array(*[F.sum(F.get("vector", F.lit(i))) for i in range(DIMENSIONS)])
    return each.groupBy("place").agg(sums.alias("vector"))


class Pooler:
    """Turns texts into rows of features with the learned vectors."""

    def __init__(self, vectors):
        self.places, self.vectors = Places(), vectors

    def features(self, texts: list[str]):
        import numpy as np

        out = np.zeros((len(texts), 2 * DIMENSIONS + 2), np.float32)
        for row, text in zip(out, texts):
            words = text.split()
            if not words:
                continue
            counts = Counter(words)
            n = len(words)
            places = np.array(self.places.pairs(counts), np.int64)
            weights = np.array(list(counts.values()), np.float32) / n
            row[:DIMENSIONS] = weights @ self.vectors[places[:, 0]]
            row[DIMENSIONS:-2] = weights @ self.vectors[places[:, 1]]
            row[-2] = 1 - len(set(zip(words, words[1:]))) / max(1, n - 1)
            row[-1] = 1 - len(counts) / n
        return out


def pooled(docs: DataFrame, columns: list[str], vectors, finish, kind, name: str = "_out") -> DataFrame:
    """The named columns of docs and `name`, what finish makes of the features of text (a null one is empty)."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)
    schema = T.StructType([docs.schema[c] for c in columns]).add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = finish(pooler.features([t or "" for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(out.tolist())], names=[*columns, name])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema)


class Network:
    """Two layers over standardised features, and a temperature."""

    def __init__(self, x, y, apart):
        """apart marks the rows that the temperature is fitted on."""
        import numpy as np

        a, b, rng = x[~apart].astype(float), y[~apart].astype(float), np.random.default_rng(7)
        self.mean, self.scale = a.mean(axis=0), a.std(axis=0) + 1e-6
        a = (a - self.mean) / self.scale
        p = [rng.normal(0, a.shape[1] ** -0.5, (a.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
        for step in range(1, STEPS + 1):
            h = np.tanh(a @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - b) / len(b)
            back = np.outer(d, p[2]) * (1 - h * h)
            for i, g in enumerate((a.T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], d.sum(keepdims=True))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.layers, self.temperature = p, 1.0
        if apart.any():
            z, t = self.logit(x[apart]), y[apart]
            ones = int(t.sum())
            t = np.where(t == 1, (ones + 1) / (ones + 2), 1 / (len(t) - ones + 2))  # few rows never call for certainty
            loss = lambda k: (t * np.logaddexp(0, -z / k) + (1 - t) * np.logaddexp(0, z / k)).mean()
            self.temperature = float(min(np.geomspace(1, 32, 101), key=loss))

    def logit(self, x):
        import numpy as np

        p = self.layers
        return np.tanh((x - self.mean) / self.scale @ p[0] + p[1]) @ p[2] + p[3]

    def probability(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> DataFrame:
    """At most `most` labelled documents outside the held-out fold, the first by a hash of doc_id: doc_id, text, y."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    first = known.groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", plain_text().alias("text"))
    return texts.join(F.broadcast(first), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame):
    """The word vectors and the network learned from labels(doc_id, quality), or None without labels of both values."""
    import numpy as np

    sample = save(training_sample(docs, labels).repartition(12, "doc_id"), "quality-sample")
    if sample.select("y").distinct().count() < 2:
        return None
    vectors = np.zeros(((1 << WORD_BITS) + (1 << SHAPE_BITS), DIMENSIONS), np.float32)
    sums = context_sums(sample).toArrow()  # a row per place at most
    vectors[sums.column("place").to_numpy()] = np.array(sums.column("vector").combine_chunks().flatten()).reshape(-1, DIMENSIONS)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-6
    features = pooled(sample, ["doc_id", "y"], vectors, lambda x: x, T.ArrayType(T.DoubleType()))
    rows = features.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    x, y = np.array([r["_out"] for r in rows]), np.array([r["y"] for r in rows])
    return vectors, Network(x, y, np.arange(len(y)) % 5 == 0)


def score_quality(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) with held_out, score and predicted, fitted on labels(doc_id, quality 0 or 1).

    score is the calibrated probability of label 1 and depends on the text alone; predicted is 1 from `threshold`.
    held_out marks the fold that nothing is learned from; it is false for a null doc_id.  A null text is an empty one
    and is scored like any other; texts of any length are scored whole.  Repeated rows stay; `columns`, or all other
    columns, pass through (columns named held_out, score and predicted are replaced).  A doc_id with both labels counts
    as 1, and one with several texts is learned by the smallest.  Without labels of both values every score is 0.5.
    An empty table gives an empty result.
    """
    columns = [c for c in columns or docs.columns if c not in ("held_out", "score", "predicted")]
    name = "_out" + "_" * max(map(len, docs.columns))  # longer than any other
    scored = quality_scores(docs, labels, columns, name)
    fold = F.coalesce(held_out(name + "_id"), F.lit(False)).alias("held_out")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select(*columns, fold, F.col(name).alias("score")).select("*", predicted)


def quality_scores(docs: DataFrame, labels: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The named columns of docs, its doc_id as `name`_id, and the score as `name`."""
    learned = fit(docs, labels)
    own = docs.withColumn(name + "_id", F.col("doc_id"))
    if learned is None:
        return own.select(*columns, name + "_id", F.lit(0.5).alias(name))
    vectors, network = learned
    return pooled(own, [*columns, name + "_id"], vectors, network.probability, T.DoubleType(), name)
