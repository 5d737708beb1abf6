"""Nearest neighbours by inner product: inverted lists scanned by an adaptive number of dimensions.

The largest inner product is the smallest distance once each vector has one more component that brings all to the norm of the longest; queries get a
zero there. The vectors are rotated at random, so that the distance over the first columns is an unbiased estimate of the whole. A list's
vectors are scanned in blocks of columns: after each block a hypothesis test abandons the candidates whose partial distance is too large for the
query's best so far. What survives is scored exactly on the original vectors. Equal vectors of a chunk are scanned once, so that they all survive or none does.

Centroids come from a bounded sample, every vector is indexed. A list is cut into chunks of bounded size and the queries of a chunk into blocks, so that a
frequent vector or query is spread over tasks; the best of each chunk are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellback.llm import util

K = 20
#: Vectors that centroids are learnt from at most: the ones with the smallest hash of their id.
SAMPLE = 20_000
#: Vectors per list; but there are no more than MAX_LISTS lists, as centroids are broadcast.
LIST_ROWS = 2048
MAX_LISTS = 16_384
#: Share of the lists that a query visits. Vectors without clear clusters need many; recall is measured in tests/llm.
PROBED = 0.75
CHUNK = 4096
QUERIES = 512
COLUMNS = 16
#: Significance of the test in standard deviations; larger abandons later.
EPSILON = 2.1
#: What 32-bit distances can be off by at most, as a share of the squared norms they come from.
SLACK = 1e-6


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    longest: float

    def turned(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Rotated vectors with the component that makes all of one length (0 for queries), as 32-bit floats."""
        square = (vectors**2).sum(1)
        last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.longest**2 - square, 0))
        return (np.column_stack((vectors, last)) @ self.rotation).astype(np.float32)

    def nearest_lists(self, turned: np.ndarray, n: int) -> np.ndarray:
        apart = (self.centroids**2).sum(1) - 2 * turned @ self.centroids.T
        return np.argsort(apart, axis=1, kind="stable")[:, :n]


def valid(vectors: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """id and v (array of doubles) of the rows that take part, and the number of components.

    Null ids or vectors, zero vectors and those with a null or non-finite component take no part, nor do vectors of another length than the most
    frequent one (the longest among equally frequent ones).
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = top["d"] if top else 0
    return rows.where(F.size("v") == width), width


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), width)


def fit(rows: DataFrame, width: int) -> Index:
    """Rotation, centroids and the greatest norm. The driver gets at most SAMPLE vectors."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    stats = rows.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    random = np.random.default_rng(7)
    rotation = np.linalg.qr(random.standard_normal((width + 1, width + 1)))[0]
    index = Index(rotation, np.zeros((1, width + 1), np.float32), stats["longest"] or 0.0)
    found = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toArrow()["v"].combine_chunks()
    if not len(found):
        return index
    sample = index.turned(_matrix(found, width), False)
    lists = int(max(1, min(MAX_LISTS, round(stats["n"] / LIST_ROWS), len(sample) // 8)))
    centre = sample[random.choice(len(sample), lists, replace=False)]
    for _ in range(10):
        index.centroids = centre
        own = index.nearest_lists(sample, 1)[:, 0]
        sums = np.zeros((lists, width + 1))
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=lists)
        centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centre).astype(np.float32)
    index.centroids = centre
    return index


def scan(query: np.ndarray, candidates: np.ndarray, k: int, partial: np.ndarray, slack: float) -> np.ndarray:
    """Indices of the candidates that no test abandons against the k-th smallest distance known.

    ``partial`` has the squared distances over the first block of columns. The candidates that are nearest there are measured whole and
    give the first limit; the rest are scanned block by block. ``slack`` is what a distance can be off by; no candidate goes for less.
    """
    width = len(query)
    if len(candidates) <= 2 * k:
        return np.arange(len(candidates))
    first = np.argpartition(partial, 2 * k)[: 2 * k]
    limit = float(np.partition(((candidates[first] - query) ** 2).sum(1), k - 1)[k - 1]) * (1 + 1e-5) + slack
    alive = np.arange(len(candidates))
    for stop in range(COLUMNS, width + COLUMNS, COLUMNS):
        if stop > COLUMNS:
            start = stop - COLUMNS
            partial = partial + ((candidates[alive, start:stop] - query[start:stop]) ** 2).sum(1)
        # the share stop/width of the distance, times what the estimate can be off at this significance
        bound = limit * (stop / width) * (1 + EPSILON / stop**0.5) ** 2 if stop < width else limit
        keep = partial <= bound + slack
        alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    return np.union1d(first, alive)


def searched(vectors: DataFrame, queries: DataFrame, k: int = K, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for each query the ``k`` nearest found vectors but its own, ties to the smaller id.

    ``score`` is the inner product of the original vectors in double precision. See ``valid`` for the vectors that take part. Rows of ``vectors`` that repeat an id
    and a vector count once; queries with one id and vector, too. Without candidates a query has no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows, width = valid(vectors, id, vector)
    rows = util.stored(rows.distinct(), "vectors")
    asked, asked_width = valid(queries, id, vector)
    if not width or asked_width != width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.distinct()
    index = fit(rows, width)
    shared = spark.sparkContext.broadcast(index)
    probes = max(1, int(np.ceil(len(index.centroids) * PROBED)))

    def assign(query: bool):
        def run(batches):
            for batch in util.slices(batches, "weight", 1 << 16):
                own = shared.value.turned(_matrix(batch.column(1), width), query)
                lists = shared.value.nearest_lists(own, probes if query else 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "v", "lists"])

        return run

    def placed(df: DataFrame, query: bool) -> DataFrame:
        weighed = df.select("id", "v", F.lit(b"\0" * 64).alias("weight"))
        return weighed.mapInArrow(assign(query), "id long, v array<double>, lists array<int>")

    based = util.stored(placed(rows, False).select("id", "v", F.col("lists")[0].alias("list")), "lists")
    visits = util.stored(placed(asked, True), "queries")
    sizes = based.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # at most MAX_LISTS rows
    dealt = based.join(F.broadcast(sizes), "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    visits = visits.select("id", "v", F.explode("lists").alias("list"))
    blocks = visits.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    visits = visits.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("id", F.lit("query")), F.col("blocks")).cast("int"))
    visits = visits.join(F.broadcast(sizes), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # a chunk meets each block of its queries in a task of its own
    dealt = dealt.join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            base, same = np.unique(_matrix(left["v"].combine_chunks(), width), axis=0, return_inverse=True)
            # ids of equal vectors stand together, the smallest first
            order = np.lexsort((left["id"].to_numpy(), same.ravel()))
            ids, count = left["id"].to_numpy()[order], np.bincount(same.ravel())
            start = np.cumsum(count) - count
            turned = shared.value.turned(base, False)
            raw = _matrix(right["v"].combine_chunks(), width)
            asking = shared.value.turned(raw, True)
            # the first block of columns for all queries at once
            head, first = turned[:, :COLUMNS], asking[:, :COLUMNS]
            partial = (head**2).sum(1) + (first**2).sum(1)[:, None] - 2 * first @ head.T
            slacks = SLACK * (shared.value.longest**2 + (raw**2).sum(1))
            for name, q, t, own, slack in zip(right["id"].to_pylist(), raw, asking, partial, slacks):
                own = scan(t, turned, k + 1, own, slack)
                score = (base[own] * q).sum(1)
                # of equal vectors, none but the k + 1 smallest ids can be among the best
                n = np.minimum(count[own], k + 1)
                at = np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                score, found = np.repeat(score, n), ids[at]
                score, found = score[found != name], found[found != name]
                best = np.lexsort((found, -score))[:k]
                out[0].append(np.full(len(best), name))
                out[1].append(found[best])
                out[2].append(score[best])
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(np.concatenate(x) if x else [], kind) for n, x, kind in zip(("query_id", "vec_id", "score"), out, kinds)})

    places = ("list", "chunk", "block")
    found = dealt.select(*places, "id", "v").groupBy(*places).cogroup(visits.select(*places, "id", "v").groupBy(*places)).applyInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
