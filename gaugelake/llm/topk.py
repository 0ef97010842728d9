"""Exact top-k search (operator 9) by inner product, with a pivot table.

Every vector has its distances to the pivots. By the triangle inequality the largest difference of two
vectors' distances to a pivot bounds their distance from below, and so their product from above.

Vectors are grouped by their nearest pivot and packed into blocks, a few of which are a cell. A block of
queries first meets one block of its own group, which gives each query a score to beat. Then it meets the
cells of those groups that may hold a better one for some of its queries, as the least and largest distances
in a group tell; inside a block candidates are evaluated in the order of their bounds until the best of the
rest is out of reach.

A query block travels to each cell that it meets, which is far more than the stored rows say: compressed, or
with repeated vectors, they are a small part of it. So no join brings them together, which Spark might
broadcast through the driver; both sides are dealt by cell, and a cell's blocks come before its queries.

How much that saves is up to the data. Vectors without any clusters are nearly all as far from each pivot as
the query is, so hardly a candidate is excluded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake.llm.shared import splits, stored

PIVOTS = 32
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: Pivots after which a block is looked at, and the share of open candidates above which the others are left out.
FIRST_PIVOTS, USELESS = 8, 0.95
#: Candidates that are tried for that.
PROBE = 512
#: Queries whose bounds are computed together.
QUERIES_AT_ONCE = 64
#: Components that a cell's blocks have together; a block of more is a cell.
CELL_NUMBERS = 2**22

BLOCK = "dim int, grp int, block int, ids binary, vectors binary"
FOUND = "query_id bigint, query_key bigint, query_copies bigint, vec_id bigint, copies bigint, score bigint, evaluated bigint"


def whole_parts(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))


def usable(vector: Column) -> Column:
    """Not NULL, not empty, and every component a finite number."""
    inf = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (x == inf) | (x == -inf))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each vector to each pivot, all of whole numbers."""
    square, pivot_square = (vectors**2).sum(1), (pivots**2).sum(1)
    if np.sqrt(square.max(initial=0)) + np.sqrt(pivot_square.max(initial=0)) < 2.0**26:  # then all sums are exact
        return np.sqrt(square[:, None] + pivot_square[None] - 2 * (vectors @ pivots.T))
    out = np.empty((len(vectors), len(pivots)))
    for low in range(0, len(vectors), 4096):
        part = slice(low, low + 4096)
        out[part] = np.sqrt(((vectors[part, None, :] - pivots[None]) ** 2).sum(2))
    return out


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims).tolist():
            yield dim, batch.filter(pa.array(dims == dim))


def _grouped(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with the number of their nearest pivot."""
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own in _by_dim(batches):
            vectors = own["vector"].flatten().to_numpy().reshape(-1, dim)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dim), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors))])
            yield pa.RecordBatch.from_arrays(
                [*[own[c] for c in ("vec_id", "vec_key", "copies", "is_query", "dim")],
                 pa.array(distances(vectors, pivots[dim]).argmin(1).astype(np.int32)), packed.cast(pa.binary())],
                names=["vec_id", "vec_key", "copies", "is_query", "dim", "grp", "vector"])

    kind = "vec_id bigint, vec_key bigint, copies bigint, is_query boolean, dim int, grp int, vector binary"
    return rows.select("vec_id", "vec_key", "copies", "is_query", "dim", "vector").mapInArrow(nearest, kind)


def narrow(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them all."""
    most = np.abs(vectors).max(initial=0)
    return vectors.astype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64))


def _arrays(ids: pa.Scalar, vectors: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids, keys and copies, and its vectors; their bytes tell what ``narrow`` took."""
    ids, vectors = np.frombuffer(ids.as_buffer(), np.int64).reshape(-1, 3).copy(), vectors.as_buffer()
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}[vectors.size // (len(ids) * dim)]
    return ids, np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64)


def _packed(rows: DataFrame, block: Column) -> DataFrame:
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = np.column_stack([table[c].to_numpy() for c in ("vec_id", "vec_key", "copies")])
        vectors = narrow(np.frombuffer(b"".join(table["vector"].to_pylist())))
        return pa.table({"dim": [key[0]], "grp": [key[1]], "block": [key[2]], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})

    return rows.withColumn("block", block).groupBy("dim", "grp", "block").applyInArrow(pack, BLOCK)


def _spans(rows: DataFrame, pivots: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]]:
    """(dimension, group) -> least and largest distance to each pivot, largest length; a row for each reaches the driver."""
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: dict[tuple[int, int], list[np.ndarray]] = {}
        for dim, own in _by_dim(batches):
            vectors, groups = np.frombuffer(b"".join(own["vector"].to_pylist())).reshape(-1, dim), own["grp"].to_numpy()
            far, square = distances(vectors, pivots[dim]), (vectors**2).sum(1)
            for grp in np.unique(groups).tolist():
                its = groups == grp
                row = [far[its].min(0), far[its].max(0), square[its].max(keepdims=True)]
                old = spans.get((dim, grp))
                spans[dim, grp] = row if old is None else [np.minimum(old[0], row[0]), np.maximum(old[1], row[1]), np.maximum(old[2], row[2])]
        for (dim, grp), row in spans.items():
            yield pa.RecordBatch.from_pydict({"dim": [dim], "grp": [grp], "low": [row[0].tolist()], "high": [row[1].tolist()], "square": row[2].tolist()})

    found = rows.select("dim", "grp", "vector").mapInArrow(reduce, "dim bigint, grp bigint, low array<double>, high array<double>, square double")
    each = found.select("dim", "grp", "square", F.posexplode(F.arrays_zip("low", "high")).alias("p", "span"))
    merged = each.groupBy("dim", "grp", "p").agg(F.min("span.low").alias("low"), F.max("span.high").alias("high"), F.max("square").alias("square"))
    out: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]] = {}
    for key, rows_of in groupby(merged.orderBy("dim", "grp", "p").collect(), key=lambda r: (r["dim"], r["grp"])):
        own = list(rows_of)
        out[key] = np.array([r["low"] for r in own]), np.array([r["high"] for r in own]), max(r["square"] for r in own)
    return out


def upper_bound(total: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Largest possible score of vectors ``apart`` whose squared lengths add up to ``total``; scores are whole, rounding is far below the slack."""
    return (total - apart**2) / 2 + total * 1e-12 + 0.5


def group_bounds(queries: np.ndarray, far: np.ndarray, span: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """For each query the largest score that a vector of the group may have."""
    low, high, square = span
    apart = np.maximum(0, np.maximum(far - high, low - far).max(1))
    return upper_bound((queries**2).sum(1) + square, apart)


def best_of(queries: np.ndarray, query_far: np.ndarray, vectors: np.ndarray, far: np.ndarray, ids: np.ndarray,
            query_ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query number, places, scores, evaluated) of each query's best ``k``; more only where scores tie with the k-th.

    What scores below a query's floor is left out.
    """
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    square, query_square = (vectors**2).sum(1), (queries**2).sum(1)
    # no sum on the way to a product is larger than the lengths' product, and single precision holds whole numbers below 2**24
    kind = np.float32 if query_square.max(initial=0) * square.max(initial=0) < 2.0**48 else np.float64
    rows, query_rows = vectors.astype(kind, copy=False), queries.astype(kind, copy=False)
    order = np.argsort(ids, kind="stable")
    own = [order[a:b] for a, b in zip(*(np.searchsorted(ids, query_ids, side, sorter=order) for side in ("left", "right")), strict=True)]
    probe, middle = slice(None, None, max(1, len(vectors) // PROBE)), far.mean(0)
    none = np.zeros(0, np.int64), np.zeros(0)
    for low in range(0, len(queries), QUERIES_AT_ONCE):
        part = slice(low, low + QUERIES_AT_ONCE)
        least_of = floors[part, None]
        # those pivots first from which queries and candidates are most differently far
        by_use = np.argsort(-np.abs(query_far[part].mean(0) - middle), kind="stable")
        total = query_square[part, None] + square[None, probe]
        apart = np.zeros(total.shape)
        for p in by_use[:FIRST_PIVOTS]:
            np.maximum(apart, np.abs(query_far[part, p, None] - far[None, probe, p]), out=apart)
        # where the first pivots exclude next to nothing, the products themselves cost less than the bounds
        if (upper_bound(total, apart) >= least_of).mean() > USELESS:
            products = query_rows[part] @ rows.T
            for i, places in enumerate(own[part]):
                products[i, places] = -np.inf
            lowest = np.maximum(least_of, -float(np.finfo(np.float32).max)).astype(kind)
            numbers, places = np.divmod(np.flatnonzero(products >= lowest), max(1, len(vectors)))
            ends = np.searchsorted(numbers, np.arange(len(products) + 1)).tolist()
            for i in range(len(products)):
                found, scores = none
                if ends[i] < ends[i + 1]:
                    found = places[ends[i]:ends[i + 1]]
                    scores = products[i, found].astype(np.float64)
                if len(scores) > k:
                    keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    scores, found = scores[keep], found[keep]
                yield low + i, found, scores, len(vectors) - len(own[low + i])
            continue
        some, total = np.arange(len(vectors)), query_square[part, None] + square[None]
        apart = np.zeros(total.shape)
        for n, p in enumerate(by_use, 1):
            np.maximum(apart, np.abs(query_far[part, p, None] - far[None, some, p]), out=apart)
            if n & (n - 1) == 0:  # now and then leave out those that are out of reach for all of these queries
                reached = (upper_bound(total, apart) >= least_of).any(0)
                if 2 * np.count_nonzero(reached) < len(some):
                    some, total, apart = some[reached], total[:, reached], apart[:, reached]
        bounds = upper_bound(total, apart)
        for i, bound in enumerate(bounds):
            query, least, evaluated = low + i, floors[low + i], 0
            if len(own[query]):
                bound[np.isin(some, own[query])] = -np.inf
            open_ = np.flatnonzero((bound > -np.inf) & (bound >= least))
            step, (found, scores) = 64, none
            while len(open_):
                if step < len(open_):
                    top = np.argpartition(-bound[open_], step)
                    now, open_ = open_[top[:step]], open_[top[step:]]
                else:
                    now, open_ = open_, open_[:0]
                evaluated += len(now)
                found = np.concatenate([found, some[now]])
                scores = np.concatenate([scores, vectors[some[now]] @ queries[query] if 2 * len(now) < len(vectors)
                                         else (vectors @ queries[query])[some[now]]])
                if len(scores) >= k:
                    least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
                keep = scores >= least
                scores, found = scores[keep], found[keep]
                open_ = open_[bound[open_] >= least]
                step *= 4
            yield query, found, scores, evaluated


def first_of(found: np.ndarray, k: int) -> np.ndarray:
    """Of rows of query number, id, copies and score the ``k`` with the best scores of each query, ties to the smaller id."""
    found = found[np.lexsort((found[:, 1], -found[:, 3], found[:, 0]))]
    return found[np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0]) < k]


def _met(candidates: DataFrame, queries: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """``work`` over the rows of each cell: its blocks, then the query blocks that meet it."""
    columns = ("dim", "grp", "cell", "block", "ids", "vectors", "floors", "asks")
    blocks = candidates.withColumns({"floors": F.lit(None).cast("binary"), "asks": F.lit(False)}).select(*columns)
    both = blocks.union(queries.withColumn("asks", F.lit(True)).select(*columns))
    return both.repartition(splits(both), "dim", "grp", "cell").sortWithinPartitions("dim", "grp", "cell", "asks").mapInArrow(work, kind)


def _asked(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[tuple]:
    """Dimension, group, ids, vectors and row of each query block, and the blocks of its cell."""
    at, blocks = None, {}
    for batch in batches:
        keys = zip(*(batch[c].to_pylist() for c in ("dim", "grp", "cell", "block", "asks")), strict=True)
        for i, (dim, grp, cell, block, asks) in enumerate(keys):
            if (dim, grp, cell) != at:
                at, blocks = (dim, grp, cell), {}
            ids, vectors = _arrays(batch["ids"][i], batch["vectors"][i], dim)
            if asks:
                yield dim, grp, ids, vectors, batch.slice(i, 1), blocks
            else:
                blocks[block] = vectors, distances(vectors, pivots[dim]), ids


def found_pairs(df: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
                vector_col: str = "embedding", pivots_of: int = PIVOTS, candidate_block: int = CANDIDATE_BLOCK,
                query_block: int = QUERY_BLOCK) -> DataFrame:
    """What ``top_k`` ranks: each query's best rows of each cell, and one row without ids for each query block in a cell, with the number of products computed."""
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"), is_query.alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("vector", whole_parts(F.col("vector"), scale))
    rows = rows.withColumn("vec_key", F.xxhash64("vector")).groupBy("vec_id", "vec_key", "vector").agg(
        F.count("*").alias("copies"), F.bool_or(F.coalesce("is_query", F.lit(False))).alias("is_query")).withColumn("dim", F.size("vector"))
    rows = stored(rows, "topk-vectors")
    total = rows.count()
    # the rows with the smallest hashes: a bounded choice that any order of the rows gives again
    order = W.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "vec_key")
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // 4096))) == 0)
    chosen = sample.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= pivots_of).select("dim", "vector").collect()
    dims = [r["dim"] for r in rows.select("dim").distinct().collect()]
    pivots = {dim: np.array([r["vector"] for r in chosen if r["dim"] == dim] or [[0.0] * dim]) for dim in dims}
    grouped = stored(_grouped(rows, pivots), "topk-grouped")
    spans = _spans(grouped, pivots)
    counts = {(r["dim"], r["grp"]): (r["n"], r["q"]) for r in grouped.groupBy("dim", "grp").agg(
        F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect()}  # at most pivots_of for each dimension
    # blocks of candidates and of queries, and the blocks of a cell
    blocks = {(dim, grp): (-(-n // candidate_block), -(-max(q, 1) // query_block), max(1, CELL_NUMBERS // (candidate_block * dim)))
              for (dim, grp), (n, q) in counts.items()}

    def number(i: int) -> Column:
        pairs = [x for (dim, grp), n in blocks.items() for x in (F.lit(f"{dim}/{grp}"), F.lit(n[i]))]
        return F.create_map(*pairs)[F.concat_ws("/", "dim", "grp")] if pairs else F.lit(1)

    hashed, cell = F.xxhash64("vec_id", "vec_key"), F.floor(F.col("block") / number(2)).cast("int")
    candidates = stored(_packed(grouped, F.pmod(hashed, number(0)).cast("int")), "topk-candidates").withColumn("cell", cell)
    queries = _packed(grouped.filter("is_query"), F.pmod(hashed, number(1)).cast("int"))
    shared = df.sparkSession.sparkContext.broadcast((spans, blocks, pivots))

    # one block of the own group first: scores to beat
    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, blocks, pivots = shared.value
        for dim, _, ids, queries, row, held in _asked(batches, pivots):
            far, least = distances(queries, pivots[dim]), np.full(len(ids), -np.inf)
            if (block := row["block"][0].as_py()) in held:
                vectors, c_far, c_ids = held[block]
                for i, _, scores, _ in best_of(queries, far, vectors, c_far, c_ids[:, 0], ids[:, 0], k):
                    if len(scores) >= k:
                        least[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
                # beyond whole numbers that can be told apart, the same product may come out lower the next time
                length = np.sqrt((queries**2).sum(1) * (vectors**2).sum(1).max())
                least -= np.where(length < 2.0**53, 0, length * 1e-12)
            # the cells of groups in which some query may find better
            places = [{"grp": g, "cell": c} for (d, g), span in spans.items() if d == dim and (group_bounds(queries, far, span) >= least).any()
                      for c in range(-(-blocks[d, g][0] // blocks[d, g][2]))]
            yield pa.RecordBatch.from_arrays(
                [row["dim"], row["ids"], row["vectors"], pa.array([least.tobytes()]), pa.array([places], pa.list_(pa.struct([("grp", pa.int32()), ("cell", pa.int32())])))],
                names=["dim", "ids", "vectors", "floors", "places"])

    one = queries.withColumn("block", F.pmod("block", number(0)).cast("int")).withColumns({"cell": cell, "floors": F.lit(None).cast("binary")})
    first = stored(_met(candidates, one, floors, "dim int, ids binary, vectors binary, floors binary, places array<struct<grp:int,cell:int>>"), "topk-floors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, _, pivots = shared.value
        names = [c.split()[0] for c in FOUND.split(", ")]
        for dim, grp, q_ids, queries, row, held in _asked(batches, pivots):
            q_far, least = distances(queries, pivots[dim]), np.frombuffer(row["floors"][0].as_buffer()).copy()
            out, evaluated = [np.zeros((0, 4), np.int64)], 0
            for vectors, far, ids in held.values():
                own = np.flatnonzero(group_bounds(queries, q_far, spans[dim, grp]) >= least)
                for i, found, scores, n in best_of(queries[own], q_far[own], vectors, far, ids[:, 0], q_ids[own, 0], k, least[own]):
                    evaluated += n
                    if len(found):
                        its = np.column_stack([np.full(len(found), own[i]), ids[found][:, [0, 2]], scores.astype(np.int64)])
                        out.append(first_of(its, k) if len(found) > k else its)
                    if len(scores) >= k:
                        least[own[i]] = max(least[own[i]], np.partition(scores, len(scores) - k)[len(scores) - k])
            best = first_of(np.concatenate(out), k)
            rows = np.column_stack([q_ids[best[:, 0]], best[:, 1:]])
            yield pa.RecordBatch.from_arrays([*[pa.array(rows[:, c]) for c in range(6)], pa.nulls(len(rows), pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 6, pa.array([evaluated], pa.int64())], names=names)

    met = first.select("dim", "ids", "vectors", "floors", F.inline("places")).withColumn("block", F.lit(0))
    return _met(candidates, met, search, FOUND)


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vector_col: str = "embedding", **block_options) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row with ``is_query`` (over ``id_col``) the ``k`` best others.

    Components become ``floor(scale * x)``; scores are exact up to 2**53. Ties go to the smaller id. Rows
    whose id or vector is NULL, or whose vector is empty or has a NULL or non-finite component, take no
    part; vectors of different lengths do not meet. Rows with the query's id are no candidates. Equal rows
    are rows: as candidates they take a rank each, as queries they have an answer each.
    """
    found = found_pairs(df, is_query, k, scale, id_col, vector_col, **block_options).filter("evaluated IS NULL")
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))).alias("copy"))
    ranked = each.withColumn("rank", F.row_number().over(
        W.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id", "copy")))
    best = ranked.filter(F.col("rank") <= k)
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("query_copies"))).alias("answer")
    return best.select("query_id", "rank", "vec_id", "score", again).drop("answer")
