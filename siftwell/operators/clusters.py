"""Clusters of documents and their words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(df: DataFrame, column: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.where(F.col(column).isNotNull()).withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def kmeans(df: DataFrame, column: str, k: int, seed: int = 42) -> DataFrame:
    """``topic`` per row by k-means on the vectors; density clustering isn't reproduced."""
    from pyspark.ml.clustering import KMeans

    v = _vectors(df, column)
    return KMeans(k=k, seed=seed, predictionCol="topic").fit(v).transform(v).drop("features")


def project_2d(df: DataFrame, column: str) -> DataFrame:
    """``x`` and ``y``: the first two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = _vectors(df, column)
    p = PCA(k=2, inputCol="features", outputCol="pc").fit(v).transform(v).withColumn("pc", vector_to_array("pc"))
    return p.withColumns({"x": F.col("pc")[0], "y": F.col("pc")[1]}).drop("features", "pc")


def topic_words(tokens: DataFrame, k: int) -> DataFrame:
    """Class-based TF-IDF of ``tokens(topic, term)``: ``tf * ln(1 + A / f)``, A the mean words per topic, f the term's count; the ``k`` best per topic."""
    from pyspark.sql.window import Window

    tf = tokens.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    per_topic = tf.groupBy("topic").agg(F.sum("n").alias("words"))
    a = per_topic.agg(F.avg("words")).scalar()  # a subquery: the counts are made once for all branches
    f = tf.groupBy("term").agg(F.sum("n").alias("f"))
    s = tf.join(per_topic, "topic").join(f, "term").withColumn("score", F.col("n") / F.col("words") * F.log1p(a / F.col("f")))
    w = Window.partitionBy("topic").orderBy(F.col("score").desc(), "term")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("topic", "rank", "term", "score")
