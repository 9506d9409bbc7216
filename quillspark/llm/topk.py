"""Exact top-k search by inner product, term at a time.

Vectors become integers, floor(scale * x). A block of candidates is turned into postings: for every
dimension, the places of the block whose component there isn't 0, and their weights. A block of
queries is taken as sparse rows; term after term, each scatters its weighted postings into a dense
score array, a row a query. Per block the k best are selected by partitioning the scores, and the
blocks' selections are merged per query.

Queries against rows is a join of blocks of bounded size: a candidate block meets each query block
once, in a task of its own, so neither side has to fit into a task or be broadcast.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, and
neither do rows without an id; among equal scores the smaller id is first; a row with the query's id
is the query's own; a repeated row is a candidate as often as it is there, and a repeated query is
answered once. Vectors of another length are scored over the dimensions that both have. An empty table gives no rows; columns but
the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quillspark.llm.common import cut

#: Rows in a block of candidates and of queries. A block of candidates is sent once for every block of queries.
CANDIDATES_IN_BLOCK = 4_096
QUERIES_IN_BLOCK = 16_384
#: Queries that are scored at once: 4,096 x 1,024 scores of 8 bytes are 32 MB.
QUERIES_AT_ONCE = 1_024
#: Parts in which the candidate blocks meet a query block, each in a task that can be its own.
SPREAD = 64

BLOCK = "ids binary, dims int, cells binary"


def whole(vector: Column) -> Column:
    """Whether a vector takes part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def _packer(size: int, scale: float):
    """Arrow batches of (id, vector) to rows that each hold up to ``size`` vectors as integers."""

    def put(ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
        dims = max(map(len, vectors))
        cells = np.zeros((len(ids), dims), np.int64)
        for i, v in enumerate(vectors):
            cells[i, : len(v)] = np.floor(scale * v.astype(np.float64))
        return pa.RecordBatch.from_pydict({"ids": [np.array(ids, np.int64).tobytes()], "dims": pa.array([dims], pa.int32()), "cells": [cells.tobytes()]})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        for b in batches:
            lists, flat = b.column(1), b.column(1).flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            for i, key in enumerate(b.column(0).to_pylist()):
                ids.append(key)
                vectors.append(flat[at[i] : at[i + 1]])
                if len(ids) == size:
                    yield put(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield put(ids, vectors)

    return pack


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of every query (row) with every candidate (column), accumulated a term at a time."""
    acc = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        places = np.flatnonzero(candidates[:, term])  # the postings of the term
        rows = np.flatnonzero(queries[:, term])  # the queries that have it
        if len(places) == len(candidates) and len(rows) == len(queries):
            acc += queries[:, term, None] * candidates[None, :, term]
        elif len(places) and len(rows):
            acc[np.ix_(rows, places)] += queries[rows, term, None] * candidates[None, places, term]
    return acc


def best(acc: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its number, and ids and scores of its k best, smaller ids first among equals."""
    for q in range(len(acc)):
        row, names = acc[q], ids
        if (mine := ids == own[q]).any():
            row, names = row[~mine], ids[~mine]
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            keep = row >= least
            row, names = row[keep], names[keep]
        order = np.lexsort((names, -row))[:k]
        yield q, names[order], row[order]


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                asked, cells = np.frombuffer(r["q_cells"], np.int64).reshape(len(own), r["q_dims"]), np.frombuffer(r["cells"], np.int64).reshape(len(ids), r["dims"])
                some = range(0, len(own), QUERIES_AT_ONCE)
                found = [(q + i, n, x) for i in some for q, n, x in best(scores(asked[i : i + QUERIES_AT_ONCE], cells), ids, own[i : i + QUERIES_AT_ONCE], k)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": np.concatenate([np.full(len(n), own[q]) for q, n, _ in found] or [np.zeros(0, np.int64)]),
                        "vec_id": np.concatenate([n for _, n, _ in found] or [np.zeros(0, np.int64)]),
                        "score": np.concatenate([s for _, _, s in found] or [np.zeros(0, np.int64)]),
                    }
                )

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, candidates_in_block: int = CANDIDATES_IN_BLOCK, queries_in_block: int = QUERIES_IN_BLOCK) -> DataFrame:
    """Each query's k best rows: query_id, rank, vec_id, score."""

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
        return rows.where(F.col("id").isNotNull() & whole(F.col("v")))

    side = clean(vectors).mapInArrow(_packer(candidates_in_block, scale), BLOCK)
    asked = clean(queries).dropDuplicates(["id"]).mapInArrow(_packer(queries_in_block, scale), BLOCK)
    asked = cut(asked.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "dims", "cells")]).withColumn("q", F.monotonically_increasing_id()))
    # Only the numbers of the query blocks, 8 bytes for a thousand queries: they say which pairs of blocks there are.
    numbers = [r["q"] for r in asked.select("q").collect()]
    each = F.array(*[F.lit(q).cast("bigint") for q in numbers]) if numbers else F.expr("cast(array() as array<bigint>)")
    pairs = side.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(SPREAD)).cast("int")).withColumn("q", F.explode(each))
    met = pairs.join(asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["q", "part"])
    found = met.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, embeddings.where(F.col("vec_id") % 100 == 0), 10)
