"""BM25, vector, fused and filtered retrieval over ``documents``, ``embeddings``, ``benchmark`` and ``labels``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quillstat.catalog.base import query
from quillstat.operators import retrieval
from quillstat.plans.hybrid_search import hybrid_search, search_corpora, search_index
from quillstat.plans.views import table
from quillstat.session import work_path
from quillstat.sources.index import build_index, load_index

TOKENS = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) term FROM documents),
lens AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) dl FROM documents),
corpus AS (SELECT COUNT(*) n, AVG(dl) avgdl FROM lens),
qt AS (SELECT DISTINCT item_id query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) term FROM benchmark),
tf AS (SELECT doc_id, term, COUNT(*) tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY 1,2),
df AS (SELECT term, COUNT(*) df FROM tf GROUP BY 1),
w AS (SELECT doc_id, tf.term, ln((n-df+0.5)/(df+0.5)+1)*tf*2.5/(tf+1.5*(1-0.75+0.75*dl/avgdl)) w FROM tf JOIN df USING (term) JOIN lens USING (doc_id), corpus),
scored AS (SELECT query_id, doc_id, SUM(w) score FROM qt JOIN w USING (term) GROUP BY 1,2)"""

VEC = """exemplar AS (SELECT label query_id, arg_min(embedding, vec_id) qv FROM embeddings GROUP BY 1),
vs AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) score FROM exemplar, embeddings),
vr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM vs)"""


def benchmark_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def exemplars(spark, sf_dir):
    """One query vector per label: the vector with the smallest id."""
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query_vector"))


@query("token_counts", "FN33", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) n_terms FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.tokenize(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@query("bm25_statistics", "AG15", f"WITH {TOKENS} SELECT term, df, CAST(ln((n-df+0.5)/(df+0.5)+1) AS DECIMAL(18,6)) idf, n n_docs, CAST(avgdl AS DECIMAL(18,6)) avg_len FROM df, corpus")
def bm25_statistics(spark, sf_dir):
    rows = retrieval.token_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    terms = retrieval.query_terms(benchmark_queries(spark, sf_dir), "query_id", "query")
    out = retrieval.idf(retrieval.postings(rows, "doc_id", terms), retrieval.corpus_size(rows))
    return out.select("term", "df", F.col("idf").cast("decimal(18,6)").alias("idf"), "n_docs", F.col("avg_len").cast("decimal(18,6)").alias("avg_len"))


@query("bm25_top_documents", "FN34 TK4", f"WITH {TOKENS} SELECT query_id, doc_id, CAST(score AS DECIMAL(18,6)) score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, doc_id) rank FROM scored) WHERE rank<=10")
def bm25_top_documents(spark, sf_dir):
    out = retrieval.bm25_top_k(table(spark, sf_dir, "documents"), benchmark_queries(spark, sf_dir), 10)
    return out.withColumn("score", F.col("score").cast("decimal(18,6)"))


@query("bm25_filtered", "JN11 TK4", f"WITH {TOKENS} SELECT query_id, doc_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, doc_id) rank FROM scored WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality=1 AND toxic=0)) WHERE rank<=10")
def bm25_filtered(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return retrieval.bm25_top_k(table(spark, sf_dir, "documents"), benchmark_queries(spark, sf_dir), 10, prefilter=good).drop("score")


@query("bm25_report_corpus", "AG15 CP10", 
       "WITH rep AS (SELECT doc_id, lower(source||'.md '||text) t FROM documents), tok AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}]+')) term FROM rep), lens AS (SELECT doc_id, len(regexp_extract_all(t, '[\\p{L}\\p{N}]+')) dl FROM rep), corpus AS (SELECT COUNT(*) n, AVG(dl) avgdl FROM lens), "
       "qt AS (SELECT DISTINCT item_id query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) term FROM benchmark), tf AS (SELECT doc_id, term, COUNT(*) tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY 1,2), df AS (SELECT term, COUNT(*) df FROM tf GROUP BY 1), "
       "w AS (SELECT doc_id, tf.term, ln((n-df+0.5)/(df+0.5)+1)*tf*2.5/(tf+1.5*(1-0.75+0.75*dl/avgdl)) w FROM tf JOIN df USING (term) JOIN lens USING (doc_id), corpus), scored AS (SELECT query_id, doc_id, SUM(w) score FROM qt JOIN w USING (term) GROUP BY 1,2) "
       "SELECT query_id, doc_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, doc_id) rank FROM scored) WHERE rank<=5")
def bm25_report_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", retrieval.report_text(F.concat(F.col("source"), F.lit(".md")), F.col("text")).alias("text"))
    return retrieval.bm25_top_k(docs, benchmark_queries(spark, sf_dir), 5).drop("score")


@query("vector_top_k", "TK5 FN35", f"WITH {VEC} SELECT query_id, vec_id, CAST(score AS DECIMAL(10,6)) score, rank FROM vr WHERE rank<=10")
def vector_top_k(spark, sf_dir):
    out = retrieval.vector_top_k(table(spark, sf_dir, "embeddings"), exemplars(spark, sf_dir), 10)
    return out.withColumn("score", F.col("score").cast("decimal(10,6)"))


@query("vector_top_k_filtered", "TK5 JN11", f"WITH {VEC} SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM vs WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality=1)) WHERE rank<=10")
def vector_top_k_filtered(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return retrieval.vector_top_k(table(spark, sf_dir, "embeddings"), exemplars(spark, sf_dir), 10, prefilter=good).drop("score")


@query("cosine_to_label_exemplar", "FN35", "WITH exemplar AS (SELECT label, arg_min(embedding, vec_id) qv FROM embeddings GROUP BY 1) SELECT vec_id, CAST(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS DECIMAL(10,6)) cosine FROM embeddings JOIN exemplar USING (label)")
def cosine_to_label_exemplar(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = exemplars(spark, sf_dir).withColumnRenamed("query_id", "label")
    return v.join(q, "label").select("vec_id", retrieval.cosine(F.col("embedding"), F.col("query_vector")).cast("decimal(10,6)").alias("cosine"))


def text_and_vector_queries(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return benchmark_queries(spark, sf_dir).join(v, "query_id")


HYBRID = TOKENS + """,
qv AS (SELECT item_id query_id, embedding qv FROM benchmark JOIN embeddings ON item_id=vec_id),
vsim AS (SELECT query_id, vec_id doc_id, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) score FROM qv, embeddings),
l1 AS (SELECT query_id, doc_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, doc_id) rank FROM scored WHERE query_id IN (SELECT query_id FROM qv)),
l2 AS (SELECT query_id, doc_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM vsim),
fused AS (SELECT query_id, doc_id, SUM(1.0/(60+rank)) score FROM (SELECT * FROM l1 WHERE rank<=15 UNION ALL SELECT * FROM l2 WHERE rank<=15) GROUP BY 1,2),
top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score,12) DESC, doc_id) rank FROM fused)"""


def doc_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query("hybrid_search", "CP10 AG16", f"WITH {HYBRID} SELECT query_id, doc_id, CAST(score AS DECIMAL(18,9)) score, rank FROM top WHERE rank<=5")
def hybrid(spark, sf_dir):
    out = hybrid_search(table(spark, sf_dir, "documents"), doc_vectors(spark, sf_dir), text_and_vector_queries(spark, sf_dir), 5)
    return out.withColumn("score", F.col("score").cast("decimal(18,9)"))


@query("hybrid_search_stored_index", "SRC15 SRC16 JN12 CP10", f"WITH {HYBRID} SELECT query_id, t.doc_id, rank, lang, source, md5(text) digest FROM top t JOIN documents USING (doc_id) WHERE rank<=5")
def hybrid_stored(spark, sf_dir):
    path = work_path(spark, "index")
    build_index(table(spark, sf_dir, "documents"), doc_vectors(spark, sf_dir), path)
    out = search_index(load_index(spark, path), text_and_vector_queries(spark, sf_dir), 5)
    return out.select("query_id", "doc_id", "rank", "lang", "source", F.md5("text").alias("digest"))


@query("rrf_zero_based", "AG16", f"WITH {HYBRID}, f0 AS (SELECT query_id, doc_id, SUM(1.0/(59+rank)) score FROM (SELECT * FROM l1 WHERE rank<=15 UNION ALL SELECT * FROM l2 WHERE rank<=15) GROUP BY 1,2) SELECT query_id, doc_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score,12) DESC, doc_id) rank FROM f0) WHERE rank<=5")
def rrf_zero_based(spark, sf_dir):
    return hybrid_search(table(spark, sf_dir, "documents"), doc_vectors(spark, sf_dir), text_and_vector_queries(spark, sf_dir), 5, zero_based=True).drop("score")


@query("rerank_candidates", "CP11", f"WITH {HYBRID}, cand AS (SELECT query_id, doc_id FROM l1 WHERE rank<=20), rs AS (SELECT query_id, doc_id, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) score FROM cand JOIN qv USING (query_id) JOIN embeddings ON doc_id=vec_id) "
       "SELECT query_id, doc_id, CAST(score AS DECIMAL(10,6)) score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM rs) WHERE rank<=3")
def rerank_candidates(spark, sf_dir):
    q = text_and_vector_queries(spark, sf_dir)
    candidates = retrieval.bm25_top_k(table(spark, sf_dir, "documents"), q, 20)
    return retrieval.rerank(candidates, q, doc_vectors(spark, sf_dir)).withColumn("score", F.col("score").cast("decimal(10,6)"))


def _corpus_sql(name, documents, embeddings):
    """The fused search over a part of both tables."""
    part = HYBRID.replace("FROM documents", f"FROM (SELECT * FROM documents WHERE {documents})").replace("FROM qv, embeddings", f"FROM qv, (SELECT * FROM embeddings WHERE {embeddings}) AS embeddings")
    return f"SELECT '{name}' corpus, query_id, doc_id, CAST(score AS DECIMAL(18,9)) score, rank FROM (WITH {part} SELECT * FROM top WHERE rank<=5)"


CORPORA = {"reports": ("lang='en'", "label<4"), "knowledge": ("lang='de'", "label BETWEEN 4 AND 6"), "chunks": ("lang NOT IN ('en','de') OR lang IS NULL", "label>6")}


@query("corpora_search", "CP10", " UNION ALL ".join(_corpus_sql(name, *parts) for name, parts in CORPORA.items()))
def corpora_search(spark, sf_dir):
    """Three corpora with their own statistics, searched for the same questions."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    corpora = {name: (table(spark, sf_dir, "documents").filter(d), vectors.filter(v).drop("label")) for name, (d, v) in CORPORA.items()}
    found = search_corpora(corpora, text_and_vector_queries(spark, sf_dir), 5)
    rows = [df.select(F.lit(name).alias("corpus"), "query_id", "doc_id", F.col("score").cast("decimal(18,9)").alias("score"), "rank") for name, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("prefiltered_chunks", "JN11 TK4", f"WITH {TOKENS} SELECT query_id, doc_id, CAST(score AS DECIMAL(18,6)) score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, doc_id) rank FROM scored WHERE doc_id IN (SELECT doc_id FROM documents WHERE source='src3' AND n_chars//1000=1)) WHERE rank<=10")
def prefiltered_chunks(spark, sf_dir):
    """Candidates of one company and year; the statistics still cover all documents."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.col("source").alias("company"), F.floor(F.col("n_chars") / 1000).cast("int").alias("year"))
    out = retrieval.bm25_top_k(docs, benchmark_queries(spark, sf_dir), 10, prefilter=retrieval.prefilter_chunks(chunks, "doc_id", "src3", 1))
    return out.withColumn("score", F.col("score").cast("decimal(18,6)"))
