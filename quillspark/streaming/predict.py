"""Nearest topics of a stream of vectors: a stateless join with the static centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillspark.operators.topics import nearest_topics


def predict_stream(vectors: DataFrame, centres: DataFrame, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """key, topic, similarity per row of the stream; the centroids are one row, so no aggregation keeps state."""
    return nearest_topics(vectors, centres, 1, key, vector).select(key, "topic", "similarity")
