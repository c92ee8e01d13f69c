"""Approximate nearest neighbours with a permutation index.

Pivots are a bounded sample of distinct vectors, about ``PER_ROOT`` times the root of their number (``MOST``
at most). A vector is represented by its ``LENGTH`` nearest pivots in order and posted in the inverted files
of the first ``POST`` of them. A query reads the files of its own nearest pivots, ``VISIT`` of all files
(``LEAST_VISIT`` at least); a vector in several of them counts in the first. Within a block of files the
vectors read are ranked by footrule distance, the sum of differences between places in the two orders (a
pivot outside an order has the place after its last), and the best share (``KEEP``) is reranked by exact
distance. The result is the best of all blocks.

Small files are kept together in blocks of about ``BLOCK`` postings; a file with very many vectors or
queries is dealt out in several blocks, so a vector that repeats a million times makes more blocks, not
a larger one.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors
of different lengths never meet, each length has an index of its own; a null id takes no part; rows that
repeat an id are separate candidates, but never a query's own id, and an id asks once, with the smallest
of its vectors; of equal distances the smaller id comes first; fewer candidates than asked for are all
returned if they are read, as they are in tables of up to a few hundred vectors; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ragged, staged

PER_ROOT = 16
MOST = 16_384
POST = 4
VISIT = 0.13
LEAST_VISIT = 96
LENGTH = 96
KEEP = 0.4
LEAST = 128
#: Postings and queries in a block.
BLOCK = 4096
QUERY_BLOCK = 2048


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """At most ``count`` distinct vectors, those with the smallest hash: a sample that repeats don't sway."""
    # vectors are told apart by a hash, so only hashes are gathered before the limit
    ranked = vectors.select(F.xxhash64("vector").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    some = ranked.orderBy(F.xxhash64("h"), "h").limit(count).select("h")
    found = vectors.withColumn("h", F.xxhash64("vector")).join(F.broadcast(some), "h").groupBy("h").agg(F.min("vector").alias("vector")).orderBy("h").toPandas()
    return np.stack([np.asarray(v, float) for v in found["vector"]])


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each vector the numbers of its ``length`` nearest pivots, nearest first."""
    d = (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    if length < d.shape[1]:
        some = np.sort(np.argpartition(d, length - 1, axis=1)[:, :length], axis=1)
    else:
        some = np.broadcast_to(np.arange(d.shape[1]), d.shape)
    near = np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, near, 1).astype(np.uint16)


def footrule(orders: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Distances between orders (n x m) and one, given the place in it of every pivot (m where it has none)."""
    m = orders.shape[1]
    there = places[orders]
    # pivots of the orders, then those that only the other one has
    return np.abs(there - np.arange(m, dtype=places.dtype)).sum(1, dtype=np.int32) + m * (m + 1) // 2 - (m - there).sum(1, dtype=np.int32)


def _ordered(vectors: DataFrame, pivots: np.ndarray, length: int, files: int, groups: int) -> DataFrame:
    """(id, vector binary, near binary, groups): each vector's bytes, its nearest pivots, and the groups that hold its first ``files`` files."""

    def run(batches):
        step = max(16, (1 << 21) // len(pivots))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                near = nearest_pivots(x.astype(float), pivots, length)
                of = np.sort(near[:, :files].astype(np.int32) % groups, axis=1)
                first = np.diff(of, axis=1, prepend=-1) != 0
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in near], pa.binary()), ragged(pa.array(of[first]), first.sum(1))], ["id", "vector", "near", "groups"])

    return vectors.select("id", "vector").mapInArrow(run, "id long, vector binary, near binary, groups array<int>")


def _read(column: pd.Series, kind) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _dealt(rows: DataFrame, block: int, name: str) -> tuple[DataFrame, DataFrame]:
    """A row for each group with the number of its block, and (group, blocks); a block holds about ``block`` rows."""
    rows = rows.withColumn("group", F.explode("groups")).drop("groups")
    blocks = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(f"{name}s"))
    return rows.join(F.broadcast(blocks), "group").withColumn(name, F.pmod(F.xxhash64("id", "group", "vector"), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), blocks


def nearest(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, post: int = POST, visit: int | None = None, keep: float = KEEP, least: int = LEAST, length: int = LENGTH) -> DataFrame:
    """(query_id, rank, vec_id, score, n_read): each query row's ``k`` nearest other rows found, Euclidean.

    ``is_query`` is a condition on the columns of ``table``; ``n_read`` is the number of vectors that the query
    has read. ``pivots`` and ``visit`` follow from the number of vectors unless given.
    """
    single = isinstance(table.schema[vector_col].dataType.elementType, T.FloatType)
    vector = table[vector_col] if single else F.transform(table[vector_col], lambda x: x.cast("double"))
    vectors = table.select(table[id_col].cast("long").alias("id"), vector.alias("vector"), is_query.alias("asks")).where(F.col("id").isNotNull())
    vectors = vectors.where(usable(F.col("vector")))
    sizes = vectors.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy("dims").collect()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = []
    for row in sizes:
        mine = vectors.where(F.size("vector") == row["dims"]) if len(sizes) > 1 else vectors
        found.append(_search(mine, row["n"], np.float32 if single else np.float64, k, pivots, post, visit, keep, least, length))
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_read long")
    pairs = reduce(DataFrame.unionByName, found)
    read = F.sum("n_read").over(Window.partitionBy("query_id"))
    return pairs.withColumn("n_read", read).where("vec_id IS NOT NULL").withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_read")


def _search(vectors: DataFrame, n: int, kind, k: int, pivots: int | None, post: int, visit: int | None, keep: float, least: int, length: int) -> DataFrame:
    """(query_id, vec_id, score, n_read): the best ``k`` of each block for each query, all vectors of one length."""
    points = choose_pivots(vectors, pivots or min(MOST, int(np.ceil(PER_ROOT * n**0.5))))
    count = len(points)
    visit = min(count, visit or max(LEAST_VISIT, int(np.ceil(VISIT * count))))
    post, length = min(post, count), min(length, count)
    groups = min(count, -(-n * post // BLOCK))
    files = staged(_ordered(vectors, points, max(post, length), post, groups), "ann-orders")
    asking = vectors.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    asked = staged(_ordered(asking, points, max(visit, length), visit, groups), "ann-asked")
    files, file_blocks = _dealt(files, BLOCK, "part")
    asked, ask_blocks = _dealt(asked, QUERY_BLOCK, "lot")
    # every block of vectors meets every block of queries of its group
    files = files.join(F.broadcast(ask_blocks), "group").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    asked = asked.join(F.broadcast(file_blocks), "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def meet(key, ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": [], "n_read": []}
        if not ours.empty and not theirs.empty:
            group = int(key[0])
            ids, x, near = ours["id"].to_numpy(), _read(ours["vector"], kind), _read(ours["near"], np.uint16)
            q_ids, q, q_near = theirs["id"].to_numpy(), _read(theirs["vector"], kind).astype(float), _read(theirs["near"], np.uint16)
            posted, orders = near[:, :post], near[:, :length]
            row, at = np.nonzero(posted % groups == group)
            by = np.argsort(posted[row, at], kind="stable")
            row, pivot = row[by], posted[row, at][by]
            for i in range(len(q_ids)):
                asks = q_near[i][:visit]
                rank, places = np.full(count, visit, np.int32), np.full(count, length, np.int16)
                rank[asks] = np.arange(visit)
                places[q_near[i][:length]] = np.arange(length)
                here = asks[asks % groups == group]
                spans = zip(np.searchsorted(pivot, here), np.searchsorted(pivot, here, side="right"), strict=True)
                posting = np.concatenate([np.arange(a, b) for a, b in spans])
                mine = row[posting]
                # the vector belongs to the first of the query's files that holds it
                mine = mine[(rank[posted[mine]].min(1) == rank[pivot[posting]]) & (ids[mine] != q_ids[i])]
                read, most = len(mine), max(least, int(np.ceil(keep * len(mine))), k)
                if read > most:
                    mine = mine[np.argsort(footrule(orders[mine], places), kind="stable")[:most]]
                d = np.sqrt(((x[mine].astype(float) - q[i]) ** 2).sum(1))
                best = np.lexsort((ids[mine], d))[:k]
                # a first row without a vector counts the vectors read
                out["query_id"] += [q_ids[i]] * (len(best) + 1)
                out["vec_id"] += [None, *ids[mine[best]].tolist()]
                out["score"] += [None, *d[best].tolist()]
                out["n_read"] += [read, *[0] * len(best)]
        frame = pd.DataFrame(out)
        return frame.astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "n_read": "int64"})

    return _cogrouped(files, asked, ["group", "part", "lot"], meet)


def _cogrouped(files: DataFrame, asked: DataFrame, keys: list[str], meet) -> DataFrame:
    """Each block of vectors together with the block of queries of the same key."""
    return files.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double, n_read long")
