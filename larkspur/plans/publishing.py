"""Publishing of built documents: new contents get versions, ids and vectors, go live, and retire what they displace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import content_hash
from larkspur.operators import lifecycle as K
from larkspur.operators import plans as N
from larkspur.operators.providers import embed_guarded
from larkspur.plans.registry import query
from larkspur.session import stored as stored_table
from larkspur.sources.tables import places

GROUP = ["restaurant_id", "doc_type"]


def publish(stored: DataFrame, built: DataFrame, scope: str, size: int, provider: Callable | None = None, model: str | None = None, force: bool = False) -> DataFrame:
    """The stored documents after a run.

    With a ``model`` (stored documents then have embedding_model and embedding_dimensions) a run is refused while live documents
    come from another one, unless forced; a forced run retires those. Texts that the provider fails for stay out of use.

    ``stored``: document_id, restaurant_id, doc_type, content, content_hash, version, embedding, is_active;
    ``built``: restaurant_id, doc_type, content. Contents that are stored already are passed over, so a run
    that is repeated changes nothing. Vectors that fail the quality gate are not kept, and
    their documents stay out of use, as do the live ones they would have displaced stay in it.
    """
    if model is not None:
        K.check_model(stored, model, size, force)
        other = ~F.col("embedding_model").eqNullSafe(F.lit(model)) | ~F.col("embedding_dimensions").eqNullSafe(F.lit(size))
        stored = stored.withColumn("is_active", F.col("is_active") & ~other)
    hashed = built.select(*GROUP, "content", content_hash(F.lit(scope), F.col("doc_type"), F.col("restaurant_id"), F.col("content")).alias("content_hash"))
    fresh = hashed.dropDuplicates([*GROUP, "content_hash"]).join(stored.select(*GROUP, "content_hash"), [*GROUP, "content_hash"], "left_anti")
    versioned = K.assign_versions(stored.select(*GROUP, "version"), fresh, GROUP, "content_hash")
    top = stored.agg(F.coalesce(F.max("document_id"), F.lit(0)).alias("_top"))
    numbered = K.numbered_rows(versioned, "_n").crossJoin(F.broadcast(top)).withColumn("document_id", F.col("_top") + F.col("_n"))  # one row
    vectored = embed_guarded(numbered, "content", size, provider or (lambda texts: [N.fake_vector(t, size) for t in texts])).withColumns({"embedding_model": F.lit(model), "embedding_dimensions": F.lit(size)})
    judged = K.quality_gate(vectored, size, "restaurant_id", "document_id")
    page = judged.select(*[F.when(F.col("problem").isNull(), F.col("embedding")).alias(c) if c == "embedding" else F.lit(False).alias(c) if c == "is_active" else F.col(c) for c in stored.columns])
    page = stored_table(page, "page")  # read several times, and each text is to be embedded once, also when an executor is lost
    return K.activate(stored.unionByName(page), page, "document_id", GROUP)


@query("""WITH p AS (SELECT c_custkey AS r FROM customer) SELECT r AS restaurant_id, 1 AS version, r % 3 <> 0 OR r % 5 = 0 AS is_active, true AS vectored FROM p
UNION ALL SELECT r, 2, r % 5 <> 0, r % 5 <> 0 FROM p WHERE r % 3 = 0""")
def published_documents(spark, sf):
    """Places with a stored text each, of which every third has a new one; of those every fifth gets a vector of zeros."""
    r = F.col("restaurant_id")
    built = places(spark, sf).select("restaurant_id", F.lit("profile").alias("doc_type"), "name")
    provider = lambda texts: [[0.0] * 8 if t.endswith("#") else N.fake_vector(t, 8) for t in texts]
    one = F.concat("name", F.lit(" one"))
    stored = built.select(
        r.alias("document_id"), *GROUP, one.alias("content"), content_hash(F.lit("evidence"), F.col("doc_type"), r, one).alias("content_hash"), F.lit(1).alias("version"),
        F.array(*[F.lit(0.5).cast("float")] * 8).alias("embedding"), F.lit(True).alias("is_active"),
    )
    later = F.when(r % 3 != 0, " one").when(r % 5 == 0, " two#").otherwise(" two")
    done = publish(stored, built.withColumn("content", F.concat("name", later)), "evidence", 8, provider)
    return done.select("restaurant_id", "version", "is_active", F.col("embedding").isNotNull().alias("vectored"))
