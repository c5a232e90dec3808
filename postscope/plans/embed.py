"""The embedding job: texts out in batches, vectors back in.

Between the two functions stands the embedding model, a service outside of Spark
that takes a batch of texts and returns a vector for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from postscope import fixed_values as fv
from postscope.operators.embedding_jobs import prepare_embedding_text, token_budget_batches
from postscope.operators.ingest import choose_text_column, flatten_struct
from postscope.sources.vectors import write_embeddings


def embedding_batches(records: DataFrame, budget: int = fv.MAX_TOKENS) -> DataFrame:
    """Raw records to ``(post_id, batch, n_tokens, text)``.

    Records without a usable time are embedded too. Batches are packed from counts, then
    texts join them by id, which needs no shuffle of texts where posts are bucketed by it.
    """
    texts = prepare_embedding_text(choose_text_column(flatten_struct(records)), budget)
    batches = token_budget_batches(texts, budget)
    return batches.join(texts.select("post_id", "text"), "post_id")


def store_vectors(vectors: DataFrame, records: DataFrame, path: str) -> None:
    """Save the vectors once each record is known to have exactly one."""
    write_embeddings(vectors, path, flatten_struct(records))
