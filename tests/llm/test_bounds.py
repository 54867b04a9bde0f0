"""Bounds of the language stage."""

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import langid


def test_bounds_come_from_all_rows(spark):
    """Of many rows a small sample would miss the weak ones."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("the weather of the north "), F.repeat(F.lit("zq x "), (F.col("id") % 40).cast("int"))).alias("text"), F.lit("en").alias("lang"))
    settings = langid.Settings(sample_rows=5)
    profiles = langid.fit(docs, settings)
    scores = [profiles.predict(r["text"])[1] for r in docs.collect()]
    assert abs(langid.fit_bounds(docs, profiles)["en"] - settings.reject * np.percentile(scores, 100 * settings.outliers)) < 1e-9
