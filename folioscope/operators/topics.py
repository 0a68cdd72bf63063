"""Topics of documents: pooled vectors are clustered, class-based TF-IDF names the clusters.

Clusters are those of operators.density (with outliers, -1), or with a given number of topics those of PCA and
bisecting k-means, without outliers. The weights and labels are exact given the assignment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import tokens
from folioscope.sources.places import written

# English words that name no topic.
STOP_WORDS = "a about after all also an and any are as at be because been but by can could did do for from had has have he her his if in into is it its may more most no not of on one or other our out she so some such than that the their them then there these they this to up us was we were what when which who will with would you your".split()


def document_texts(chunks: DataFrame) -> DataFrame:
    """doc_id, text: a document's chunks in order, a space between."""
    own = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda c: c["content"]), " ").alias("text"))


def _components(pooled: DataFrame, components: int) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = pooled.select("doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return PCA(k=components, inputCol="features", outputCol="few").fit(rows).transform(rows)


def reduced(pooled: DataFrame, components: int = 5) -> DataFrame:
    """doc_id, embedding: the vectors' principal components, for density clusters."""
    from pyspark.ml.functions import vector_to_array

    return _components(pooled.filter(F.col("embedding").isNotNull()), components).select("doc_id", vector_to_array("few").alias("embedding"))


def assign_topics(pooled: DataFrame, n_topics: int, seed: int = 42, components: int = 5) -> DataFrame:
    """doc_id, topic_id from (doc_id, embedding array)."""
    from pyspark.ml.clustering import BisectingKMeans

    few = _components(pooled, components)
    model = BisectingKMeans(k=n_topics, seed=seed, featuresCol="few", predictionCol="topic_id").fit(few)
    return model.transform(few).select("doc_id", "topic_id")


def class_tfidf(docs: DataFrame, min_df: int = 2) -> DataFrame:
    """topic_id, term, weight of (topic_id, doc_id, text): term share in the topic times
    ln(1 + mean words per topic / frequency over all topics)."""
    words = docs.select("topic_id", F.col("doc_id").alias("_d"), F.explode(tokens(F.col("text"))).alias("term")).filter(~F.col("term").isin(STOP_WORDS) & (F.length("term") > 1))
    # words of a document are counted where it lies, then documents and words by topic
    own = words.groupBy("topic_id", "_d", "term").agg(F.count(F.lit(1)).alias("tf"))
    per = written(own.groupBy("topic_id", "term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")), "topic-counts")
    total = per.groupBy("term").agg(F.sum("tf").alias("f"), F.sum("df").alias("df")).filter(F.col("df") >= min_df)
    # size, mean and result all read it: one pass over the texts
    kept = written(per.select("topic_id", "term", "tf").join(total.select("term", "f"), "term"), "topic-words")
    size = kept.groupBy("topic_id").agg(F.sum("tf").alias("words"))
    mean = size.agg(F.avg("words").alias("mean"))
    out = kept.join(F.broadcast(size), "topic_id").crossJoin(F.broadcast(mean))
    return out.select("topic_id", "term", (F.col("tf") / F.col("words") * F.log(1 + F.col("mean") / F.col("f"))).alias("weight"))


def topic_words(weights: DataFrame, n: int = 5, digits: int = 9) -> DataFrame:
    """topic_id, rank (from 1), term, weight of the n weightiest terms."""
    rounded = weights.withColumn("weight", F.round("weight", digits))
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term"))).filter(F.col("rank") <= n)


def topic_summary(assigned: DataFrame, words: DataFrame, n: int = 10) -> DataFrame:
    """The n largest topics with their label."""
    label = words.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "_").alias("label"))
    sizes = assigned.groupBy("topic_id").agg(F.count(F.lit(1)).alias("documents"))
    return sizes.join(label, "topic_id", "left").orderBy(F.desc("documents"), "topic_id").limit(n)


def topic_rows(assigned: DataFrame, words: DataFrame, metadata: DataFrame) -> DataFrame:
    """doc_id, title, year, topic_id, topic_label for a CSV; the id stands in for a missing title."""
    label = words.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "_").alias("topic_label"))
    out = assigned.join(metadata.select("doc_id", "title", "year"), "doc_id", "left").join(F.broadcast(label), "topic_id", "left")
    return out.select("doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), "topic_id", F.coalesce("topic_label", F.lit("")).alias("topic_label"))
