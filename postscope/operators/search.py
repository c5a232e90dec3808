"""Similarity search of posts by their vectors.

Vectors are wide (thousands of bytes) and scores are eight bytes, so a search for one
query scores first, where the vectors are read, and only ids and scores move after that.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from postscope import fixed_values as fv
from postscope.operators.filters import filter_date_range

# A result of up to this many rows is small enough to be sent to every task.
_BROADCAST_ROWS = 10_000
# Scores are rounded before they are ranked, so that copies of a vector tie and ids decide.
SCORE_DIGITS = 9
_QUERIES_AT_ONCE = 256


def align_embeddings(posts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Posts with their vector; posts or vectors without partner drop out."""
    return posts.join(vectors.select("post_id", "embedding"), "post_id")


def vector_of(vectors: DataFrame, post_id) -> list[float]:
    """The vector of one post, read now, as a query vector."""
    row = vectors.filter(F.col("post_id") == post_id).select("embedding").first()
    if row is None or row.embedding is None:
        raise ValueError(f"post {post_id} has no vector")
    return [float(x) for x in row.embedding]


def _matrix(batch, size: int):
    """Ids and vectors of an Arrow batch, without null vectors and those with null entries."""
    import numpy as np
    import pyarrow.compute as pc

    batch = batch.filter(batch.column("embedding").is_valid())
    lengths = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
    wrong = np.flatnonzero(lengths != size)
    if len(wrong):
        first = batch.column("post_id")[int(wrong[0])].as_py()
        raise ValueError(f"the vector of post {first} has {lengths[wrong[0]]} entries, not {size}")
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("float64")
    rows = flat.reshape(batch.num_rows, size)
    whole = ~np.isnan(rows).any(axis=1)
    ids = batch.column("post_id").to_numpy(zero_copy_only=False)
    return (ids.astype(str) if ids.dtype == object else ids)[whole], rows[whole]


def _scores(vectors: DataFrame, query_vector: Sequence[float], cosine: bool) -> DataFrame:
    """``(post_id, similarity_score)`` of every usable vector, a batch times the query at a time."""
    asked = [float(x) for x in query_vector]
    aligned = vectors.select("post_id", "embedding")
    id_type = to_arrow_type(aligned.schema["post_id"].dataType)
    schema = T.StructType([aligned.schema["post_id"], T.StructField("similarity_score", T.DoubleType())])

    def score(batches):
        import numpy as np
        import pyarrow as pa

        column = np.array(asked)
        if cosine:
            column = column / np.linalg.norm(column)
        for batch in batches:
            ids, rows = _matrix(batch, len(asked))
            found = rows @ column
            if cosine:
                lengths = np.linalg.norm(rows, axis=1)
                ids, found, lengths = ids[lengths > 0], found[lengths > 0], lengths[lengths > 0]
                found = found / lengths
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.tolist(), id_type), pa.array(found)], names=["post_id", "similarity_score"]
            )

    return aligned.mapInArrow(score, schema)


def similarity_scores(
    posts: DataFrame | None, vectors: DataFrame, query_vector: Sequence[float], cosine: bool = False
) -> DataFrame:
    """``(post_id, similarity_score)`` for every post with a vector; plain dot product.

    Without posts every vector is scored and nothing is joined, for vectors that
    ``load_embeddings`` has found to match the posts. Null vectors have no score; a vector
    of another length is an error that names its post.
    """
    scored = _scores(vectors, query_vector, cosine)
    # An inner join on the unique id, not a semi join: Catalyst would move a semi
    # join below the scores and shuffle the vectors in their place.
    return scored if posts is None else scored.join(posts.select("post_id"), "post_id")


def _best(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("similarity_score"), "post_id").limit(k)


def _with_posts(best: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    if k <= _BROADCAST_ROWS:
        best = F.broadcast(best)
    return _best(posts.join(best, "post_id"), k)


def search_top_k(
    posts: DataFrame,
    vectors: DataFrame,
    query_vector: Sequence[float],
    k: int = fv.DEFAULT_TOP_K,
    matched: bool = False,
    cosine: bool = False,
) -> DataFrame:
    """The k best posts, best first, equal scores by id, with ``similarity_score``.

    Ids and scores decide the winners; the posts' other columns are read once more for
    the winners only and are never shuffled. With ``matched`` the posts are all posts and
    each has its vector, so ids need no join before the winners are known.
    """
    scores = similarity_scores(None if matched else posts, vectors, query_vector, cosine)
    ranked = scores.withColumn("similarity_score", F.round("similarity_score", SCORE_DIGITS))
    return _with_posts(_best(ranked, k), posts, k)


def search_filtered(
    posts: DataFrame,
    vectors: DataFrame,
    query_vector: Sequence[float],
    start: dt.date,
    end: dt.date,
    k: int = fv.DEFAULT_TOP_K,
) -> DataFrame:
    """The k best posts of a date range."""
    return search_top_k(filter_date_range(posts, start, end), vectors, query_vector, k)


def cosine_top_k(
    posts: DataFrame,
    vectors: DataFrame,
    query_vector: Sequence[float],
    k: int = fv.DEFAULT_TOP_K,
    matched: bool = False,
) -> DataFrame:
    """As ``search_top_k`` with lengths divided out, for vectors that are not of unit length."""
    return search_top_k(posts, vectors, query_vector, k, matched, cosine=True)


def posts_sharing_link(posts: DataFrame, url: str) -> DataFrame:
    """Posts that share a link, compared without case; the posts of a search within it."""
    return posts.filter(F.lower("url") == url.lower())


def search_many(
    posts: DataFrame | None,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = fv.DEFAULT_TOP_K,
    query_block: int = 16_384,
    vector_block: int = 1_000_000,
) -> DataFrame:
    """Top k of every query: ``(query_id, rank, post_id, similarity_score)``.

    ``queries`` has ``query_id`` and ``embedding``; null query vectors are left out, and so
    are those with null entries. Queries and vectors are dealt to blocks, and each pair of blocks is a cell of a
    grid: a task holds the queries of its cell and streams the cell's vectors past them, so
    that it returns k candidates per query at most. The best of a query's cells are its
    result. One plan with one scan of each table serves any number of queries, and no vector
    passes through the driver, which only counts both sides. Posts, where given, are joined
    with the vectors first: that moves the vectors, unless both are bucketed alike.
    """
    aligned = vectors.select("post_id", "embedding")
    if posts is not None:
        aligned = aligned.join(posts.select("post_id"), "post_id")
    asked = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    aligned = aligned.filter(F.col("embedding").isNotNull())
    rows = max(1, -(-asked.count() // query_block))
    columns = max(1, -(-aligned.count() // vector_block))
    query_type, id_type = asked.schema["query_id"].dataType, aligned.schema["post_id"].dataType

    def placed(side: DataFrame, key: str, own: int, others: int, vector_side: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.lit(own))
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other")
        dealt = side.select("*", mine.alias("mine"), every)
        row, column = ("other", "mine") if vector_side else ("mine", "other")
        return dealt.select(
            (F.col(row) * columns + F.col(column)).alias("cell"),
            F.lit(vector_side).alias("vector_side"),
            (F.lit(None).cast(query_type) if vector_side else F.col("query_id")).alias("query_id"),
            (F.col("post_id") if vector_side else F.lit(None).cast(id_type)).alias("post_id"),
            F.col("embedding").cast(vectors.schema["embedding"].dataType).alias("embedding"),
        )

    grid = placed(asked, "query_id", rows, columns, False).unionByName(placed(aligned, "post_id", columns, rows, True))
    grid = grid.repartition("cell").sortWithinPartitions("cell", "vector_side")
    schema = T.StructType(
        [asked.schema["query_id"], aligned.schema["post_id"], T.StructField("similarity_score", T.DoubleType())]
    )
    found = grid.mapInArrow(_cells(k, to_arrow_type(query_type), to_arrow_type(id_type)), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity_score"), "post_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "post_id", "similarity_score")
    )


def _cells(k: int, query_type, id_type):
    """Of rows sorted by (cell, vector_side): the k best posts of every query of a cell."""
    import numpy as np
    import pyarrow as pa

    class Best:
        """Candidates of the queries of a cell; all that may still be among the k best are kept."""

        def __init__(self):
            self.names: list = []
            self.parts: list[np.ndarray] = []
            self.open: list[tuple] = []
            self.size = 0
            self.matrix = None

        def ask(self, batch: pa.RecordBatch) -> None:
            size = len(batch.column("embedding")[0])
            names, rows = _matrix(batch.select(["query_id", "embedding"]).rename_columns(["post_id", "embedding"]), size)
            self.names += names.tolist()
            self.parts.append(rows)

        def score(self, batch: pa.RecordBatch) -> None:
            if self.matrix is None:
                self.matrix = np.concatenate(self.parts).T if self.names else np.zeros((0, 0))
                self.limit = np.full(len(self.names), -np.inf)
            if not self.names:
                return
            ids, rows = _matrix(batch.select(["post_id", "embedding"]), len(self.matrix))
            for at in range(0, len(ids), 1024):
                for first in range(0, len(self.names), _QUERIES_AT_ONCE):
                    chosen = slice(first, first + _QUERIES_AT_ONCE)
                    scores = np.round(rows[at : at + 1024] @ self.matrix[:, chosen], SCORE_DIGITS)
                    row, query = np.nonzero(scores >= self.limit[chosen])
                    self.open.append((query + first, ids[at + row], scores[row, query]))
                    self.size += len(row)
                    if self.size > max(1_000_000, 2 * k * len(self.names)):
                        self.cut()

        def cut(self) -> None:
            if not self.open:
                return
            query, ids, scores = (np.concatenate(x) for x in zip(*self.open))
            order = np.lexsort((ids, -scores, query))
            query, ids, scores = query[order], ids[order], scores[order]
            begin = np.searchsorted(query, query, "left")
            place = np.arange(len(query)) - begin
            keep, last = place < k, place == k - 1
            self.limit[query[last]] = scores[last]
            self.open, self.size = [(query[keep], ids[keep], scores[keep])], int(keep.sum())

        def rows(self) -> pa.RecordBatch | None:
            self.cut()
            if not self.open:
                return None
            query, ids, scores = self.open[0]
            names = [self.names[q] for q in query.tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(names, query_type), pa.array(ids.tolist(), id_type), pa.array(scores)],
                names=["query_id", "post_id", "similarity_score"],
            )

    def run(batches):
        cell, best = None, Best()
        for batch in batches:
            at, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            change = (at[1:] != at[:-1]) | (side[1:] != side[:-1])
            edges = np.flatnonzero(np.concatenate([[True], change, [True]])) if len(at) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if at[a] != cell:
                    found = best.rows()
                    if found is not None:
                        yield found
                    cell, best = at[a], Best()
                (best.score if side[a] else best.ask)(batch.slice(a, b - a))
        found = best.rows()
        if found is not None:
            yield found

    return run
