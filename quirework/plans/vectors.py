"""Queries over vectors: nearest rows, the guard, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import answers, vectors
from quirework.sources.tables import table


def _queries(index: DataFrame) -> DataFrame:
    return index.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest rows of every hundredth vector."""
    index = table(spark, folder, "embeddings")
    return vectors.search(index, _queries(index)).select("query_id", "vec_id", F.round("score", 5).alias("score"))


def vector_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Those of them with a score high enough."""
    index = table(spark, folder, "embeddings")
    return vectors.guarded(vectors.search(index, _queries(index))).select("query_id", "vec_id", F.round("score", 5).alias("score"))


def vector_topk_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """The five rows of label 3 nearest to the first vector."""
    index = table(spark, folder, "embeddings")
    first = index.orderBy("vec_id").limit(1).collect()[0]["embedding"]
    return vectors.nearest(index.where("label = 3"), list(first)).select("vec_id", F.round("score", 5).alias("score"))


def vector_knn_label_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """How often neighbours have the label of their query."""
    index = table(spark, folder, "embeddings")
    return vectors.label_accuracy(vectors.search(index, _queries(index)), index)


def rag_context(spark: SparkSession, folder: str) -> DataFrame:
    """Context of a question: articles nearest to it by hashed words, with the fields of their issue."""
    embed = vectors.hash_embedding(32)
    articles = table(spark, folder, "articles").where("raw_text IS NOT NULL").select(F.col("id").alias("vec_id"), "doc_id", "number", F.col("raw_text").alias("text"))
    index = vectors.indexed(articles, embed)
    question = spark.createDataFrame([(1, "query: délai de dépôt de la demande", "fr")], "query_id bigint, question string, lang string").withColumn("embedding", embed(F.col("question")))
    hits = vectors.search(index.select("vec_id", "embedding"), question, k=3).join(articles, "vec_id")
    issue = table(spark, folder, "bulletins").select("doc_id", "bo_number")
    none = lambda kind: F.lit(None).cast(kind)
    full = hits.join(issue, "doc_id", "left").select(
        "query_id", "rank", "text", "doc_id", "number", "bo_number", none("string").alias("instrument_type"), none("string").alias("reference"), none("int").alias("pdf_page"),
        none("int").alias("printed_page"), none("array<struct<n_rows:int,n_cols:int,rows:array<array<string>>>>").alias("extracted_tables"),
    )
    return answers.prompts(question, answers.contexts(full))


QUERIES = {f.__name__: f for f in (vector_search, vector_guard, vector_topk_by_label, vector_knn_label_accuracy, rag_context)}
_SCORED = """
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
         s AS (SELECT query_id, vec_id, label, list_inner_product(v, embedding::DOUBLE[]) AS score FROM q, embeddings),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
"""
SQL = {
    "vector_search": f"{_SCORED} SELECT query_id, vec_id, round(score, 5) AS score FROM r WHERE k <= 5",
    "vector_guard": f"{_SCORED} SELECT query_id, vec_id, round(score, 5) AS score FROM r WHERE k <= 5 AND score >= 0.82",
    "vector_topk_by_label": """
        WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1)
        SELECT vec_id, round(list_inner_product(v, embedding::DOUBLE[]), 5) AS score FROM q, embeddings WHERE label = 3 ORDER BY 2 DESC, 1 LIMIT 5
    """,
    "vector_knn_label_accuracy": f"""
        {_SCORED} SELECT e.label, count(DISTINCT query_id) AS queries, round(avg((r.label = e.label)::INT), 6) AS accuracy
        FROM r JOIN embeddings e ON e.vec_id = query_id WHERE k <= 5 AND query_id <> r.vec_id GROUP BY 1
    """,
}
