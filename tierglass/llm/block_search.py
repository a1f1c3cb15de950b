"""Nearest neighbours by largest inner product, as a block matrix join.

Vectors are dealt into blocks; a block of queries meets every block of candidates, one tile a row.
Each block also holds int8 vectors with a scale, the length of what rounding lost and the length of
what it kept. A tile multiplies the int8 blocks (exactly: ``EXACT_DIM`` dimensions at a time fit a float32
mantissa, and these sums are added in double precision) and bounds the true inner product on both sides. Pairs whose upper bound reaches the k-th best lower
bound of their query are recomputed in double precision, so nothing is lost; per-tile heaps keep the
k best, and the tiles' lists are merged by a ranked window with a limit before its shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tierglass.llm import words as W
from tierglass.llm.common import table

NEIGHBOURS = 20
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 8192
_BLOCK = (
    "block int, dim int, ids binary, quantised binary, scale binary, lost binary, kept binary, exact binary, kind string"
)
#: Longest sum of products of int8 values that float32 holds exactly: 127 * 127 * 1024 < 2^24.
EXACT_DIM = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that take part: an id, and finite components that are not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.select("vec_id", "embedding")
    if vectors.schema["embedding"].dataType.elementType != FloatType():
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return vectors.where(
        F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    )


def _blocks(vectors: DataFrame, per_block: int, rows: int) -> tuple[DataFrame, int]:
    """Packed blocks, one row for each block and vector length."""
    n = max(1, -(-rows // per_block))
    wide = vectors.schema["embedding"].dataType.elementType != FloatType()
    kind = np.float64 if wide else np.float32

    def pack(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        x = np.array(group.column("embedding").combine_chunks().flatten(), kind).reshape(len(ids), -1)
        order = np.lexsort((*x.T[::-1], ids))
        order = order[np.append(True, ids[order][1:] != ids[order][:-1])]
        ids, x = ids[order], x[order]
        exact = x.astype(np.float64)
        # Norms are taken of rows within 127, so that tiny and huge components neither vanish nor overflow.
        scale = np.maximum(np.abs(exact).max(1) / 127, np.finfo(np.float64).tiny)
        even = exact / scale[:, None]
        q = np.rint(even).astype(np.int8)
        lost = np.linalg.norm(even - q, axis=1) * scale
        kept = np.linalg.norm(q.astype(np.float64), axis=1) * scale
        row = [group.column("block")[0].as_py(), x.shape[1]]
        row += [a.tobytes() for a in (ids.astype(np.int64), q, scale, lost, kept, x)]
        row.append(x.dtype.name)
        return pa.table([[v] for v in row], schema=_SCHEMA)

    block = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    return (
        vectors.select("vec_id", "embedding", block.alias("block"), F.size("embedding").alias("dim"))
        .groupBy("block", "dim")
        .applyInArrow(pack, _BLOCK)
    ), n


_SCHEMA = pa.schema(
    [("block", pa.int32()), ("dim", pa.int32())]
    + [(c, pa.binary()) for c in ("ids", "quantised", "scale", "lost", "kept", "exact")]
    + [("kind", pa.string())]
)


def nearest(queries: DataFrame, candidates: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score double): the k largest inner products of every query.

    Ties go to the smaller vec_id. A query is not its own neighbour. Vectors that are null, zero or
    hold null or non-finite components take no part, and only vectors of one length are compared. Of
    rows that share a vec_id one is used, the least by its components. Fewer candidates than k give
    fewer rows.
    """
    queries, candidates = usable(queries), usable(candidates)
    q_blocks, _ = _blocks(queries, QUERY_BLOCK, queries.count())
    c_blocks, n = _blocks(candidates, CANDIDATE_BLOCK, candidates.count())
    q_blocks = q_blocks.select(*[F.col(c).alias(f"q_{c}") for c in q_blocks.columns])
    tiles = q_blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(
        c_blocks.withColumnRenamed("dim", "q_dim"), ["block", "q_dim"]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield _tile({c: batch.column(c)[i].as_py() for c in batch.schema.names}, k)

    found = tiles.mapInArrow(W.task(search), "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _tile(t: dict, k: int) -> pa.RecordBatch:
    dim = t["q_dim"]
    side = {}
    for p in ("q_", ""):
        side[p] = {
            "ids": np.frombuffer(t[p + "ids"], np.int64),
            "quantised": np.frombuffer(t[p + "quantised"], np.int8).reshape(-1, dim).astype(np.float32),
            "exact": np.frombuffer(t[p + "exact"], np.dtype(t[p + "kind"])).reshape(-1, dim),
            **{c: np.frombuffer(t[p + c], np.float64) for c in ("scale", "lost", "kept")},
        }
    q, c = side["q_"], side[""]
    near = np.zeros((len(q["ids"]), len(c["ids"])))
    for d in range(0, dim, EXACT_DIM):
        near += q["quantised"][:, d : d + EXACT_DIM] @ c["quantised"][:, d : d + EXACT_DIM].T
    near *= q["scale"][:, None] * c["scale"]
    # |<x, y> - <x', y'>| <= |x - x'| |y| + |x'| |y - y'|, and |y| <= |y'| + |y - y'|
    error = q["lost"][:, None] * (c["kept"] + c["lost"]) + q["kept"][:, None] * c["lost"]
    error += 1e-9 * (np.abs(near) + error)
    own = q["ids"][:, None] == c["ids"]
    low = np.where(own, -np.inf, near - error)
    if low.shape[1] > k:
        floor = np.partition(low, -k, axis=1)[:, -k]
    else:
        floor = np.full(len(low), -np.inf)
    at_q, at_c = np.nonzero((near + error >= floor[:, None]) & ~own)
    score = np.empty(len(at_q))
    for s in range(0, len(at_q), 1 << 16):
        a, b = at_q[s : s + (1 << 16)], at_c[s : s + (1 << 16)]
        score[s : s + len(a)] = np.einsum("ij,ij->i", q["exact"][a].astype(np.float64), c["exact"][b].astype(np.float64))
    ids = c["ids"][at_c]
    borders = np.searchsorted(at_q, np.arange(len(low) + 1))
    out: list[tuple[int, int, float]] = []
    for i, query in enumerate(q["ids"].tolist()):
        a, b = borders[i], borders[i + 1]
        best = heapq.nsmallest(k, zip((-score[a:b]).tolist(), ids[a:b].tolist()))
        out.extend((query, vec, -value) for value, vec in best)
    columns = list(zip(*out)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(columns, kinds)], ["query_id", "vec_id", "score"]
    )


def op9_block_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 20 = 0"), vectors)


SQL = """
WITH usable AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
