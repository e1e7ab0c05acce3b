"""Exact top-k search by inner product: block-at-a-time pruning.

Vectors become integers; each dimension is a term. Candidates are sorted by the signs of fixed random projections and cut
into blocks of ``BLOCK`` rows, once; a block keeps a forward index (its rows' values) and for every term its largest and
smallest value. Each query first scores the block that it lies in itself, as the rows there are near; its k-th score there is
a bound that it carries to all others. Groups of near queries then meet the blocks' term maxima only, ``SUMMARIES`` blocks at a time;
a block's rows are sent to a group of queries only if the bound (the sum over terms of the query's weight times the largest
value, or the smallest where the weight is negative) reaches the k-th score of one of them. A query orders the blocks
that came by their bound and scores one after the other until the next bound falls below its k-th score. Queries and
blocks meet in tiles of bounded size, so a tile's results are at most k rows a query; a second step merges the tiles.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a
null id; ties go to the smaller id; a repeated id is a candidate as often as it occurs, but no query meets its own id;
queries meet candidates of their own length only; a query without candidates has no rows; an empty table gives none.
Components beyond 2**20 after scaling are multiplied as Python integers' 64-bit products in place of float64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veltra.llm._util import arrow_rows, materialize, mix64, read

BLOCK, TILE, QUERY_TILE, SUMMARIES = 256, 1 << 16, 512, 1 << 14
LOW = int(np.iinfo(np.int64).min)
#: Components up to this size are multiplied in float64 exactly.
EXACT = 1 << 20


def _projections(dim: int, n: int = 16) -> np.ndarray:
    h = mix64(np.arange(dim * n, dtype=np.uint64) + np.uint64(1234))
    return (h.astype(np.float64) / 2.0**63 - 1).reshape(dim, n)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _signs(vectors: np.ndarray) -> np.ndarray:
    """A Gray-like code of the projections' signs: near vectors have near codes."""
    signs = (vectors @ _projections(vectors.shape[1]) > 0).astype(np.int64)
    return np.bitwise_xor.accumulate(signs, axis=1) @ (1 << np.arange(signs.shape[1])[::-1])


def blocks_of(ids: np.ndarray, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows in blocks, ordered by their signs' code, so that near vectors meet."""
    order = np.lexsort((ids, _signs(vectors)))
    return [(ids[part], vectors[part]) for part in np.split(order, range(BLOCK, len(order), BLOCK))]


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """What no row of a block scores more than, for each query and block."""
    return _dot(np.maximum(queries, 0), most) + _dot(np.minimum(queries, 0), least)


def _scores(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.where(ids[None, :] == query_ids[:, None], LOW, _dot(queries, vectors))


def search_blocks(query_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows of blocks for every query, but for some below the score known that k other rows reach: positions in
    queries, ids, scores; and the number of blocks scored."""
    bound = bounds(queries, np.array([v.max(0) for _, v in blocks]), np.array([v.min(0) for _, v in blocks]))
    order = np.argsort(-bound, axis=1, kind="stable")
    best_score, best_id = np.full((len(queries), k), LOW), np.full((len(queries), k), np.iinfo(np.int64).max)
    live, opened = np.arange(len(queries)), 0
    for step in range(len(blocks)):
        block = order[live, step]
        # A bound that equals the k-th score may still hide a smaller id of that score.
        go = bound[live, block] >= np.maximum(best_score[live, -1], known[live])
        live, block = live[go], block[go]
        if not len(live):
            break
        opened += len(live)
        for b in np.unique(block):
            rows = live[block == b]
            own, v = blocks[b]
            score = _scores(query_ids[rows], queries[rows], own, v)
            all_score = np.concatenate([best_score[rows], score], axis=1)
            all_id = np.concatenate([best_id[rows], np.broadcast_to(own, score.shape)], axis=1)
            all_id = np.where(all_score == LOW, np.iinfo(np.int64).max, all_id)
            by = np.lexsort((all_id, -np.maximum(all_score, LOW + 1)), axis=1)[:, :k]
            best_score[rows], best_id[rows] = np.take_along_axis(all_score, by, 1), np.take_along_axis(all_id, by, 1)
    q, r = np.nonzero(best_score != LOW)
    return q, best_id[q, r], best_score[q, r], opened


def _table(kinds: list, names: str, rows: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names.split())


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int64).reshape(-1, dim)


def _build(k: int):
    """Blocks of a tile with their forward index and term maxima, and the queries inside with what their own block tells of
    their k-th score."""

    def run(table: pa.Table) -> pa.Table:
        dim, t = table.column("dim")[0].as_py(), table.column("t")[0].as_py()
        ids, asks = table.column("id").to_numpy(), table.column("is_query").to_numpy()
        vectors = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, dim)
        order = np.lexsort((ids, _signs(vectors)))
        out = []
        for b, part in enumerate(np.split(order, range(BLOCK, len(order), BLOCK))):
            v, i, q = vectors[part], ids[part], part[asks[part]]
            known = np.full(len(q), LOW)
            if len(q) and len(part) > k:
                known = -np.sort(-_scores(ids[q], vectors[q], i, v), axis=1)[:, k - 1]
            out.append((dim, t, b, i.tobytes(), v.tobytes(), v.max(0).tobytes(), v.min(0).tobytes(), ids[q].tobytes(), vectors[q].tobytes(), known.tobytes(), _signs(v[:1])[0]))
        return _table([pa.int32()] * 3 + [pa.binary()] * 7 + [pa.int64()], "dim t b ids data most least q_ids q_data known code", out)

    return run


def _asked(batches):
    """The queries of blocks as rows."""
    for batch in batches:
        for dim, i, v, known, code in zip(*(batch.column(c).to_pylist() for c in ("dim", "q_ids", "q_data", "known", "code"))):
            rows = [np.frombuffer(x, np.int64) for x in (i, known)]
            data = [x.tobytes() for x in _matrix([v], dim)]
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(data), pa.int32()), pa.array(rows[0]), pa.array(data, pa.binary()), pa.array(rows[1]), pa.array([code] * len(data), pa.int64())], names=["dim", "id", "q", "known", "code"])


def _reached(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The blocks that a query of the group may find one of its k best rows in."""
    out = []
    if len(left) and len(right):
        dim, g, _ = (x.as_py() for x in key)
        queries = _matrix(left.column("q").to_pylist(), dim)
        bound = bounds(queries, *(_matrix(right.column(c).to_pylist(), dim) for c in ("most", "least")))
        hit = np.flatnonzero((bound >= left.column("known").to_numpy()[:, None]).any(0))
        t, b = right.column("t").to_pylist(), right.column("b").to_pylist()
        out = [(dim, g, t[i], b[i]) for i in hit.tolist()]
    return _table([pa.int32(), pa.int64(), pa.int32(), pa.int32()], "dim g t b", out)


def _search(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table([pa.int64()] * 3, "query_id vec_id score", [])
        dim = key[0].as_py()
        query_ids, known = left.column("id").to_numpy(), left.column("known").to_numpy()
        blocks = [(np.frombuffer(i, np.int64), _matrix([v], dim)) for i, v in zip(right.column("ids").to_pylist(), right.column("data").to_pylist())]
        q, i, s, _ = search_blocks(query_ids, _matrix(left.column("q").to_pylist(), dim), known, blocks, k)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (query_ids[q], i, s)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row for which is_query holds."""
    arrow_rows(vectors.sparkSession, 10_000)
    v = F.col("v")
    x = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.transform(F.col(vector_col), lambda e: F.floor(e.cast("double") * scale)).alias("v"), F.transform(F.col(vector_col), lambda e: e.cast("double")).alias("raw"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    bad = F.exists("raw", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = x.where(F.col("id").isNotNull() & F.col("raw").isNotNull() & (F.size("raw") > 0) & ~bad).select("id", F.size(v).alias("dim"), "v", "is_query")
    x = materialize(x, "vectors")
    sizes = x.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).where("q > 0")
    # Bits of the signs' code that make groups of queries, and tiles of rows and of blocks.
    sizes = sizes.select("dim", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), F.least(F.lit(16), F.ceil(F.log2(F.ceil(F.col("q") / QUERY_TILE)))).cast("int").alias("bits"))
    sizes = materialize(sizes, "sizes")
    rows = x.join(sizes, "dim").withColumn("t", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    blocks = materialize(rows.groupBy("dim", "t").applyInArrow(_build(k), "dim int, t int, b int, ids binary, data binary, most binary, least binary, q_ids binary, q_data binary, known binary, code long"), "blocks")
    asked = blocks.where(F.octet_length("q_ids") > 0).mapInArrow(_asked, "dim int, id long, q binary, known long, code long").join(sizes, "dim")
    asked = asked.withColumn("code", F.expr("shiftright(code, 16 - bits)"))
    parts = asked.groupBy("dim", "code").agg(F.ceil(F.count(F.lit(1)) / QUERY_TILE).alias("parts"))
    asked = asked.join(parts, ["dim", "code"]).withColumn("g", F.col("code") * (1 << 40) + F.pmod(F.xxhash64("id"), "parts"))
    asked = materialize(asked.select("dim", "g", "id", "q", "known", "tiles"), "asked")
    groups = asked.groupBy("dim", "g").agg(F.first("tiles").alias("tiles"))
    per_tile = max(1, SUMMARIES * BLOCK // TILE)  # tiles of rows whose blocks' term maxima meet a group at once
    spread = F.explode(F.sequence(F.lit(0), F.floor((F.col("tiles") - 1) / per_tile).cast("int"))).alias("s")
    left = asked.select("dim", "g", "q", "known", spread)
    left = left.toDF(*left.columns)  # attributes of its own
    maxima = blocks.select("dim", F.floor(F.col("t") / per_tile).cast("int").alias("s"), "t", "b", "most", "least")
    right = maxima.join(groups.select("dim", "g", spread), ["dim", "s"]).select("dim", "g", "s", "t", "b", "most", "least")
    reached = left.groupBy("dim", "g", "s").cogroup(right.groupBy("dim", "g", "s")).applyInArrow(_reached, "dim int, g long, t int, b int")
    reached = materialize(reached, "reached")
    left = asked.join(reached.select("dim", "g", "t").distinct(), ["dim", "g"]).select("dim", "g", "t", "id", "q", "known")
    left = left.toDF(*left.columns)
    right = reached.join(blocks.select("dim", "t", "b", "ids", "data"), ["dim", "t", "b"]).select("dim", "g", "t", "ids", "data")
    found = left.groupBy("dim", "g", "t").cogroup(right.groupBy("dim", "g", "t")).applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
