"""Approximate nearest neighbours: multiprobe p-stable hashing, buckets visited in the order of estimated success, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pdpspark.llm.common import written

#: Tables, hash functions of each, slot width in standard deviations of a projection, slots on either side of 0.
TABLES, FUNCTIONS, WIDTH, SLOTS = 2, 8, 0.75, 6
#: Similarity at which success is estimated.
SIMILARITY = 0.4
#: Share of the indexed rows that a query's buckets hold in each table, and rows at least.
SHARE, LEAST = 0.42, 4096
#: Bound of the sample of indexed rows by which a query finds how many buckets hold that share.
SAMPLE = 4096
#: Rows of a block: what one group of the search holds of the index, and of the queries.
BLOCK_ROWS, QUERY_ROWS = 16384, 16384
SLACK = 1e-9


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


class Hashing:
    """h(x) = floor((a . x + b) / WIDTH) for TABLES * FUNCTIONS normal vectors a; x is made a unit vector in one dimension more."""

    def __init__(self, dims: int, longest: float, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.a, self.b, self.longest = rng.standard_normal((dims + 1, TABLES * FUNCTIONS)), rng.uniform(0, WIDTH, TABLES * FUNCTIONS), longest
        self.edges = (np.arange(-SLOTS, SLOTS) * WIDTH)[None, :] - self.b[:, None]  # inner edges of the 2 * SLOTS + 1 slots, for each function

    def slots(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x functions: slot numbers from 0."""
        y = x / self.longest
        rest = np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1, keepdims=True)))
        h = np.floor((np.hstack([y, rest]) @ self.a + self.b) / WIDTH)
        return (np.clip(h, -SLOTS - 1, SLOTS - 1) + SLOTS + 1).astype(np.int64).reshape(-1, TABLES, FUNCTIONS)

    def success(self, q: np.ndarray) -> np.ndarray:
        """queries x tables x functions x slots: log of how much likelier a row of SIMILARITY falls in the slot than any row."""
        p = (np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))]) @ self.a)[:, :, None]
        noise = math.sqrt(1 - SIMILARITY**2)

        def mass(edges: np.ndarray) -> np.ndarray:
            upto = _phi(edges)
            ends = np.zeros((*upto.shape[:-1], 1))
            return np.maximum(np.diff(np.concatenate([ends, upto, ends + 1], axis=-1), axis=-1), 1e-12)

        near, any_row = mass((self.edges[None] - SIMILARITY * p) / noise), mass(self.edges[None])
        return (np.log(near) - np.log(any_row)).reshape(len(q), TABLES, FUNCTIONS, -1)


def estimated(success: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """queries x buckets: estimated success of buckets (functions' slots) of one table."""
    return sum(success[:, k, :][:, slots[:, k]] for k in range(FUNCTIONS))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest found by inner product, itself (its vec_id) left out.

    vectors and queries: vec_id, embedding. Null ids, and vectors that are null, zero, hold a null or non-finite component or have
    another length than most, take no part. Equal scores rank by vec_id; of repeated (id, vector) rows one counts.

    Of equal vectors the k + 1 smallest ids are indexed: no more can be among the k nearest. A query visits, in each table, its buckets
    in the order of estimated success until they hold the wanted share of the rows (LEAST rows at least); a bounded sample of rows shows
    how far that is. The buckets of a table are grouped by their first slot and dealt into blocks of about BLOCK_ROWS rows; a query goes
    to the blocks where some bucket could succeed. Queries are dealt into blocks of about QUERY_ROWS, each of which meets all blocks of rows. Candidates of both tables are reranked by exact inner products.
    """
    valid = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    clean = lambda df: df.where(valid).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    lengths = clean(vectors).groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], out)
    dims = lengths.dims
    own = clean(vectors).where(F.size("embedding") == dims).distinct()
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    rows = written(own.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    count, longest = rows.agg(F.count("*"), F.max(norm)).first()
    hashing = Hashing(dims, longest)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    seen = hashing.slots(_matrix(sample["embedding"]))
    visited = min(1.0, max(share, LEAST / count))
    blocks = max(1, round(count / BLOCK_ROWS / (2 * SLOTS + 1) * 3))  # most rows are in a third of the first slots

    def place_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                slots = hashing.slots(_matrix(pdf["embedding"]))
                for t in range(TABLES):
                    yield pd.DataFrame({"part": t * 64 + slots[:, t, 0], "block": pdf["block"], "vec_id": pdf["vec_id"], "embedding": pdf["embedding"]})

    def place_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at : at + 256]
                success = hashing.success(_matrix(pdf["embedding"]))
                for t in range(TABLES):
                    limit = np.quantile(estimated(success[:, t], seen[:, t]), 1 - visited, axis=1, method="lower") if visited < 1 else np.full(len(pdf), -np.inf)
                    reach = success[:, t, 0] + success[:, t, 1:].max(axis=2).sum(axis=1)[:, None] >= limit[:, None] - SLACK
                    i, slot = np.nonzero(reach)
                    yield pd.DataFrame({"part": t * 64 + slot, "query_id": pdf["vec_id"].to_numpy()[i], "least": limit[i], "embedding": pdf["embedding"].to_numpy()[i]})

    index = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).mapInPandas(place_rows, "part int, block int, vec_id long, embedding array<double>")
    asking = clean(queries).where(F.size("embedding") == dims).distinct()
    asked_blocks = max(1, math.ceil(asking.count() / QUERY_ROWS))
    asked = asking.mapInPandas(place_queries, "part int, query_id long, least double, embedding array<double>")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asked", F.pmod(F.xxhash64("query_id"), F.lit(asked_blocks)).cast("int"))
    index = index.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))))

    def search(asking: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(asking) or not len(block):
            return pd.DataFrame({c: [] for c in columns})
        table = int(asking["part"].iloc[0]) // 64
        ids, x, q = block["vec_id"].to_numpy(), _matrix(block["embedding"]), _matrix(asking["embedding"])
        own_ids, least = asking["query_id"].to_numpy(), asking["least"].to_numpy()
        buckets, of = np.unique(hashing.slots(x)[:, table], axis=0, return_inverse=True)
        found = []
        for at in range(0, len(q), 512):
            part = q[at : at + 512]
            visits = estimated(hashing.success(part)[:, table], buckets) >= least[at : at + 512, None] - SLACK
            scores = part @ x.T
            scores[~visits[:, of.ravel()] | (own_ids[at : at + 512, None] == ids[None])] = -np.inf
            bound = np.partition(scores, -k, axis=1)[:, -k][:, None] if scores.shape[1] > k else np.full((len(part), 1), -np.inf)
            i, j = np.nonzero((scores >= bound - SLACK) & (scores > -np.inf))
            found.append(pd.DataFrame({"query_id": own_ids[at + i], "vec_id": ids[j], "score": (part[i] * x[j]).sum(axis=1)}))
        return pd.concat(found)

    keys = ["part", "block", "asked"]
    pairs = asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    one = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # found in both tables
    return one.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
