"""BM25 and vector rankings fused per query, optionally filtered and reranked."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillstat.operators import retrieval
from quillstat.session import broadcast_if_small, stored
from quillstat.sources.index import SearchIndex, search_postings


def hybrid_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, prefilter: DataFrame | None = None,
                  zero_based: bool = False, overfetch: int = 3, doc_id: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, doc_id, score, rank) from 3·k candidates of each ranker.

    ``queries`` has (query_id, query, query_vector), ``vectors`` (doc_id, embedding).
    """
    words = retrieval.bm25_top_k(docs, queries, k * overfetch, doc_id, query_id=query_id, prefilter=prefilter)
    near = retrieval.vector_top_k(vectors, queries, k * overfetch, doc_id, query_id=query_id, prefilter=prefilter)
    return retrieval.rrf_fuse([words, near], query_id, doc_id, k, zero_based=zero_based)


def search_index(index: SearchIndex, queries: DataFrame, k: int = 5, prefilter: DataFrame | None = None, overfetch: int = 3,
                 doc_id: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """The same over a stored index, with chunk text and metadata attached."""
    words = search_postings(index, queries, k * overfetch, doc_id, query_id, prefilter=prefilter)
    near = retrieval.vector_top_k(index.vectors, queries, k * overfetch, doc_id, query_id=query_id, prefilter=prefilter)
    fused = stored(retrieval.rrf_fuse([words, near], query_id, doc_id, k), "fused")
    return retrieval.attach(broadcast_if_small(fused), index.chunks, doc_id)  # k rows per query: the texts stay where they are read


def search_corpora(corpora: dict[str, tuple[DataFrame, DataFrame]], queries: DataFrame, k: int = 5, **options) -> dict[str, DataFrame]:
    """One hybrid search per corpus (reports, knowledge base, chunks)."""
    return {name: hybrid_search(docs, vectors, queries, k, **options) for name, (docs, vectors) in corpora.items()}
