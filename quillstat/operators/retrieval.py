"""BM25, vector and fused retrieval for batches of queries.

One job answers many queries. Documents are tokenised in their own rows; only tokens of the query
vocabulary leave the scan. Postings are kept by blocks of documents with the largest weight of every term, so a
query scores the blocks that can hold one of its k best. Vectors and queries meet in hashed blocks that
keep k rows per query.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.expr import settled
from quillstat.functions.textclean import tokenize
from quillstat.operators.windows import first_rows
from quillstat.session import broadcast_if_small, durable, spread

K1, B = 1.5, 0.75
#: Documents of a block of postings; vectors and queries of a block of the vector search, queries multiplied at a time.
BLOCK_DOCS, BLOCK_VECTORS, BLOCK_QUERIES, QUERY_SLICE = 128, 16384, 8192, 256


def token_rows(docs: DataFrame, doc_id: str, text: str, tokens=tokenize) -> DataFrame:
    """(doc_id, tokens, doc_len); documents without tokens stay with length 0."""
    rows = settled(spread(docs.select(doc_id, text), doc_id), tokens=tokens(F.col(text)))
    return rows.select(doc_id, "tokens", F.size("tokens").alias("doc_len"))


def query_terms(queries: DataFrame, query_id: str, text: str, tokens=tokenize) -> DataFrame:
    """Distinct (query_id, term)."""
    return queries.select(query_id, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def corpus_size(rows: DataFrame) -> DataFrame:
    """One row: number of documents and mean length."""
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def postings(rows: DataFrame, doc_id: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc_id, doc_len, term, tf); with a vocabulary other terms are dropped before anything is shuffled."""
    t = rows.select(doc_id, "doc_len", F.explode("tokens").alias("term"))
    if vocabulary is not None:
        t = t.join(broadcast_if_small(vocabulary.select("term").distinct()), "term", "left_semi")
    return t.groupBy(doc_id, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(posting: DataFrame, size: DataFrame) -> DataFrame:
    """(term, df, idf, n_docs, avg_len); idf = ln((N − df + 0.5)/(df + 0.5) + 1)."""
    return with_idf(posting.groupBy("term").agg(F.count(F.lit(1)).alias("df")), size)


def with_idf(df: DataFrame, size: DataFrame) -> DataFrame:
    """The same from (term, df)."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(size.withColumn("_k", F.lit(1))), "_k").drop("_k").withColumn(
        "idf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def bm25_weight(tf: Column, doc_len: Column, avg_len: Column, idf_: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len))


def block_of(doc_id: str, n_docs: Column, block_docs: int = BLOCK_DOCS) -> Column:
    """Block of a document: about ``block_docs`` documents share one, by a hash of the id."""
    return F.pmod(F.xxhash64(doc_id), F.greatest(F.ceil(n_docs / block_docs), F.lit(1))).cast("int")


def weighted_postings(posting: DataFrame, weights: DataFrame, doc_id: str, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, term, weight, block)."""
    w = bm25_weight(F.col("tf"), F.col("doc_len"), F.col("avg_len"), F.col("idf"), k1, b)
    return posting.join(weights, "term").select(doc_id, "term", w.alias("weight"), block_of(doc_id, F.col("n_docs")).alias("block"))


def by_block(df: DataFrame) -> DataFrame:
    """Rows of a block in one partition, so what is asked of a block meets its postings there and scores are added up without another shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")


def _block_scores(weighted: DataFrame, asked: DataFrame, doc_id: str, query_id: str) -> DataFrame:
    """(query_id, doc_id, score) of the documents of the asked (query, block, term)."""
    met = by_block(weighted).join(by_block(asked.select(query_id, "block", "term")), ["block", "term"])
    return met.groupBy("block", query_id, doc_id).agg(F.sum("weight").alias("score")).drop("block")


def block_bounds(weighted: DataFrame, terms: DataFrame, k: int, doc_id: str, query_id: str, maxima: DataFrame | None = None,
                 seed_blocks: int = 2, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """((query, block, term) of the terms that a block holds, (query, block, bound, threshold, open)).

    A block's bound is the sum of the largest weights of the query's terms in it. The threshold is the k-th score among the documents of
    the ``seed_blocks`` blocks with the highest bounds: no document of a block whose bound is lower can be among the k best.
    """
    if maxima is None:
        maxima = by_block(weighted).groupBy("block", "term").agg(F.max("weight").alias("largest"))
    asked = broadcast_if_small(terms).join(maxima, "term")
    bounds = asked.groupBy(query_id, "block").agg(F.sum("largest").alias("bound"))
    seeds = first_rows(bounds, [query_id], [F.col("bound").desc(), F.col("block")], seed_blocks)
    seen = ranked(_block_scores(weighted, asked.join(seeds.select(query_id, "block"), [query_id, "block"], "left_semi"), doc_id, query_id), query_id, doc_id, k, digits)
    kth = seen.filter(F.col("rank") == k).select(query_id, F.col("score").alias("threshold"))
    near = 2 * 10.0**-digits  # scores are compared after rounding
    judged = bounds.join(kth, query_id, "left").withColumn("open", F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - near))
    return asked, judged


def bm25_scores(weighted: DataFrame, terms: DataFrame, k: int, doc_id: str, query_id: str, maxima: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every document that may be among the k best; blocks of documents that can't hold one are skipped."""
    asked, judged = block_bounds(weighted, terms, k, doc_id, query_id, maxima)
    return _block_scores(weighted, asked.join(judged.filter("open").select(query_id, "block"), [query_id, "block"], "left_semi"), doc_id, query_id)


def ranked(scores: DataFrame, query_id: str, doc_id: str, k: int, digits: int = 9) -> DataFrame:
    """Best k per query with 1-based rank; scores equal to ``digits`` places count as ties and go by id."""
    return first_rows(scores, [query_id], [F.round("score", digits).desc(), F.col(doc_id)], k, "rank")


def best_scores(weighted: DataFrame, terms: DataFrame, k: int, doc_id: str, query_id: str, maxima: DataFrame | None = None) -> DataFrame:
    """The k best documents of every query, computed now: both sides of the join on (block, term) lie by block, which this setting lets them keep."""
    conf, name = weighted.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return durable(ranked(bm25_scores(weighted, terms, k, doc_id, query_id, maxima), query_id, doc_id, k))
    finally:
        conf.set(name, before)


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text",
               query_id: str = "query_id", query_text: str = "query", prefilter: DataFrame | None = None,
               tokens=tokenize) -> DataFrame:
    """Rank whole documents for every query. Statistics cover all documents; ``prefilter`` limits the candidates."""
    rows = token_rows(docs, doc_id, text, tokens)
    terms = query_terms(queries, query_id, query_text, tokens)
    # document frequencies and scores read the same postings: write them once instead of tokenising twice
    post = durable(postings(rows, doc_id, terms))
    weights = broadcast_if_small(durable(idf(post, corpus_size(rows))))
    candidates = post if prefilter is None else post.join(prefilter.select(doc_id), doc_id, "left_semi")
    weighted = durable(weighted_postings(candidates, weights, doc_id))
    return best_scores(weighted, terms, k, doc_id, query_id)


def report_text(file_name: Column, text: Column, limit: int | None = None) -> Column:
    """Text a report is indexed under: file name and whole text (with ``limit``: its first characters)."""
    whole = F.concat(file_name, F.lit(" "), text)
    return whole if limit is None else F.substring(whole, 1, limit)


# vectors

def normalized(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / (norm + F.lit(1e-10)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the normalised vectors."""
    return dot(normalized(a), normalized(b))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)


def _best_of_block(rows: pd.DataFrame, asked: pd.DataFrame, columns: tuple[str, str, str, str], k: int, digits: int) -> pd.DataFrame:
    """The k best vectors of one block for every query of another."""
    vec_id, vector, query_id, query_vector = columns
    out: list[tuple] = []
    if len(rows) and len(asked):
        m, q = (_unit(np.stack(c.to_list()).astype("float64")) for c in (rows[vector], asked[query_vector]))
        keys, names = rows[vec_id].tolist(), asked[query_id].tolist()
        for at in range(0, len(q), QUERY_SLICE):
            scores = np.round(q[at : at + QUERY_SLICE] @ m.T, digits)
            for name, s in zip(names[at:], scores):
                few = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else range(len(s))
                out += [(name, key, -x) for x, key in sorted((-s[i], keys[i]) for i in few)[:k]]
    return pd.DataFrame(out, columns=["query", "vec", "score"])


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
                 query_id: str = "query_id", query_vector: str = "query_vector", prefilter: DataFrame | None = None,
                 digits: int = 9) -> DataFrame:
    """Exact k largest inner products per query over normalised vectors; null vectors take no part.

    Vectors and queries are dealt to blocks by a hash of their ids and every pair of blocks is one group: its vectors are multiplied with slices of its
    queries and k rows per query remain, so no pairs are produced and no vector passes the driver.
    """
    base = vectors if prefilter is None else vectors.join(prefilter.select(vec_id), vec_id, "left_semi")
    base = base.select(vec_id, vector).filter(F.col(vector).isNotNull())
    asked = queries.select(query_id, query_vector).filter(F.col(query_vector).isNotNull())
    schema = f"query {asked.schema[query_id].dataType.simpleString()}, vec {base.schema[vec_id].dataType.simpleString()}, score double"
    n, m = (max(1, -(-df.count() // size)) for df, size in ((base, BLOCK_VECTORS), (asked, BLOCK_QUERIES)))

    def dealt(df, key, own, blocks, other, others):
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(base, vec_id, "_vb", n, "_qb", m).groupBy("_vb", "_qb")
    right = dealt(asked, query_id, "_qb", m, "_vb", n).groupBy("_vb", "_qb")
    columns = (vec_id, vector, query_id, query_vector)
    found = left.cogroup(right).applyInPandas(lambda a, b: _best_of_block(a, b, columns, k, digits), schema)
    return ranked(found.select(F.col("query").alias(query_id), F.col("vec").alias(vec_id), "score"), query_id, vec_id, k, digits)


# fusion

def rrf_fuse(lists: list[DataFrame], query_id: str = "query_id", doc_id: str = "doc_id", k: int = 5, constant: int = 60,
             zero_based: bool = False) -> DataFrame:
    """Σ 1/(constant + rank) over ranked lists; the lists hold at most k' rows per query."""
    rank = F.col("rank") - 1 if zero_based else F.col("rank")
    rows = reduce(lambda a, b: a.unionByName(b), [x.select(query_id, doc_id, rank.alias("_r")) for x in lists])
    fused = rows.groupBy(query_id, doc_id).agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("_r"))).alias("score"))
    return ranked(fused, query_id, doc_id, k, 12)


def attach(ranking: DataFrame, chunks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Ranked ids → text and metadata."""
    return ranking.join(chunks, doc_id)


def prefilter_chunks(chunks: DataFrame, doc_id: str, company: str | None = None, year: int | None = None) -> DataFrame:
    """Candidate ids by company and year; no match leaves no candidates."""
    out = chunks
    if company is not None:
        out = out.filter(F.col("company") == company)
    if year is not None:
        out = out.filter(F.col("year") == year)
    return out.select(doc_id)


def rerank(candidates: DataFrame, queries: DataFrame, embeddings: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id",
           query_vector: str = "query_vector", vector: str = "embedding", k: int = 3, digits: int = 9) -> DataFrame:
    """Order the candidates of each query by the cosine of their own embeddings."""
    pairs = candidates.select(query_id, doc_id).join(queries.select(query_id, query_vector), query_id).join(
        embeddings.select(doc_id, vector), doc_id)
    scored = pairs.select(query_id, doc_id, F.round(cosine(F.col(query_vector), F.col(vector)), digits).alias("score"))
    return ranked(scored, query_id, doc_id, k, digits)
