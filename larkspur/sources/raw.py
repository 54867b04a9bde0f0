"""Raw sources and sinks: JSON lines, lenient objects, bad records, boundaries, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import geo
from larkspur.functions import text as X
from larkspur.functions.interpret import hours

def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_TEXT, _TEXTS, _NUMBER = T.StringType(), T.ArrayType(T.StringType()), T.DoubleType()

PLACE = _schema(
    gmap_id=_TEXT, name=_TEXT, address=_TEXT, description=_TEXT, price=_TEXT, state=_TEXT, latitude=_NUMBER, longitude=_NUMBER, category=_TEXTS, avg_rating=_NUMBER,
    num_of_reviews=T.IntegerType(), hours=T.ArrayType(_TEXTS), MISC=_TEXT, relative_results=_TEXTS, url=_TEXT,
)
REVIEW = _schema(user_id=_TEXT, name=_TEXT, time=T.LongType(), rating=T.IntegerType(), text=_TEXT, gmap_id=_TEXT)

#: Longest line that is accepted, in characters.
LONGEST_LINE = 16 << 20


def scan_lines(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """One row per non-blank line: the schema's fields as ``record``, ``line_no`` and ``reason`` ('decode_error' or null).

    Gzip files are read whole by one task each; ``line_no`` counts within a file's task.
    A limit bounds the lines that are read, not those that are accepted.
    """
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).where(F.trim("value") != "")
    return parsed_lines(lines if limit is None else lines.limit(limit), schema)


def parsed_lines(lines: DataFrame, schema: T.StructType, *keep: str) -> DataFrame:
    """Lines (line_no, value) read as JSON: ``keep``, line_no, record and reason as in ``scan_lines``."""
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = (F.length("value") <= LONGEST_LINE) & parsed.isNotNull() & parsed["_bad"].isNull()
    fields = F.struct(*[parsed[f.name].alias(f.name) for f in schema.fields])
    return lines.select(*keep, "line_no", F.when(good, fields).alias("record"), F.when(~good, "decode_error").alias("reason"))


def accepted(scanned: DataFrame) -> DataFrame:
    return scanned.where("reason IS NULL").select("line_no", "record.*")


def rejected(scanned: DataFrame) -> DataFrame:
    """Line numbers and reasons, never the text."""
    return scanned.where("reason IS NOT NULL").select("line_no", "reason")


def labels_of(misc: Column) -> Column:
    """A JSON object of topic to string, list or mixed list as map<string, array<string>>; odd shapes give no labels."""
    top = F.from_json(misc, "map<string,string>")

    def listed(value: Column) -> Column:
        many = F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull())
        plain = ~F.ltrim(value).rlike(r"^[\[{]")
        return F.when(F.ltrim(value).startswith("["), F.coalesce(many, F.array().cast("array<string>"))).when(plain, F.array(value)).otherwise(F.array().cast("array<string>"))

    return F.coalesce(F.transform_values(top, lambda k, v: F.coalesce(listed(v), F.array().cast("array<string>"))), F.create_map().cast("map<string,array<string>>"))


def curate_places(raw: DataFrame, areas: list[tuple[str, list]] | None = None, *keep: str) -> DataFrame:
    """Raw places with ``outcome`` (accept, filter or reject) and ``reason``, by the first rule that applies, and the curated fields.

    ``areas`` are boundaries as ``load_boundaries`` gives them; a point in none of them is in no
    borough. Only without boundaries do the boxes decide.
    """
    borough = geo.area_by_box if areas is None else lambda lat, lon: geo.area_by_polygon(lat, lon, areas)
    lat, lon = F.col("latitude"), F.col("longitude")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    food, valid, served = X.is_food_place(F.col("category")), geo.valid_point(lat, lon), geo.in_box(lat, lon, *geo.SERVICE_AREA)
    reason = F.when(blank("gmap_id"), "missing_id").when(~food, "not_food").when(~valid, "coordinates").when(~served, "outside_area").when(blank("name"), "missing_name")
    misc = labels_of(F.col("MISC"))
    return raw.select(
        *[c for c in ("line_no",) if c in raw.columns], *keep,
        F.when(reason.isNull(), "accept").when(reason.isin("not_food", "outside_area"), "filter").otherwise("reject").alias("outcome"), reason.alias("reason"), "gmap_id", F.trim("name").alias("name"),
        F.trim(F.coalesce("address", F.lit(""))).alias("address"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), hours(F.col("hours")).alias("hours"), X.cuisine_tags(F.col("category")).alias("cuisine_tags"), X.price_level(F.col("price")).alias("price_level"),
        F.col("avg_rating").alias("source_avg"), X.snapshot_status(F.col("state")).alias("snapshot_status"), borough(lat, lon).alias("borough"), lat.alias("lat"), lon.alias("lon"),
        F.col("num_of_reviews").alias("source_review_count"), F.coalesce(F.col("num_of_reviews") >= X.REVIEW_COUNT_CAP, F.lit(False)).alias("source_review_count_capped"),
        X.tri_states(misc).alias("tri_states"), X.tags_of(misc, "atmosphere").alias("atmosphere_tags"), X.tags_of(misc, "service_options").alias("service_option_tags"),
        X.tags_of(misc, "popular_for").alias("popular_for_tags"), X.tags_of(misc, "accessibility").alias("accessibility_tags"),
    )


def curate_reviews(raw: DataFrame, least_chars: int = 1, *keep: str) -> DataFrame:
    """Raw reviews with outcome and reason, scrubbed text (short texts blank), hash, topics and the dedup key; no identity fields."""
    at = X.reviewed_at(F.col("time"))
    text = X.short_to_blank(X.scrub(F.trim(F.coalesce("text", F.lit("")))), least_chars)
    reason = F.when(F.trim(F.coalesce("gmap_id", F.lit(""))) == "", "missing_id").when(~F.coalesce(F.col("rating").between(1, 5), F.lit(False)), "rating").when(F.coalesce("time", F.lit(0)) <= 0, "time").when(at.isNull(), "time_range")
    hashed = X.text_hash(text)
    return raw.select(
        *[c for c in ("line_no",) if c in raw.columns], *keep,
        F.when(reason.isNull(), "accept").otherwise("reject").alias("outcome"), reason.alias("reason"), "gmap_id", "rating", at.alias("reviewed_at"), text.alias("text"), hashed.alias("text_hash"),
        X.topics(text).alias("topic_tags"), X.joined_hash(F.col("gmap_id"), F.col("user_id"), F.col("time"), hashed).alias("dedup_key"),
    )


#: Most place ids that are broadcast to the reviews.
BROADCAST_IDS = 1_000_000


def prefilter(reviews: DataFrame, ids: DataFrame, key: str = "gmap_id") -> DataFrame:
    """Reviews of known places. The ids are broadcast if they are counted to be few, else joined by shuffle."""
    known = ids.select(key).distinct()
    return reviews.join(F.broadcast(known) if known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else known, key, "left_semi")


def write_lines(df: DataFrame, path: str) -> None:
    """Gzip JSON lines; the commit protocol leaves no partial output."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def load_boundaries(spark: SparkSession, path: str, checksum: str | None = None) -> list[tuple[str, list]]:
    """Areas as (slug, polygons) from a JSON list of features with boroname and the_geom; rings of fewer than four points are dropped.

    The file is a handful of areas; its polygons become expressions.
    """
    from larkspur.operators.errors import Refused

    if checksum is not None:
        found = file_checksums(spark, path).first()
        if found is None or found["sha256"] != checksum:
            raise Refused("the boundary file isn't the pinned one")
    shape = "boroname string, the_geom struct<type:string,coordinates:string>"
    areas = []
    for row in spark.read.schema(shape).option("multiLine", "true").json(path).collect():
        import json

        slug = "_".join((row["boroname"] or "").lower().split()).replace("-", "_").replace("'", "")
        geometry = row["the_geom"]
        if not slug or geometry is None or geometry["type"] not in ("Polygon", "MultiPolygon"):
            raise Refused("a feature has no name or no polygon")
        members = json.loads(geometry["coordinates"])
        polygons = []
        for rings in [members] if geometry["type"] == "Polygon" else members:
            closed = [[tuple(map(float, p[:2])) for p in ring] for ring in rings]
            closed = [r if r and r[0] == r[-1] else [*r, r[0]] for r in closed if r]
            if kept := [r for r in closed if len(r) >= 4]:
                polygons.append(kept)
        if not polygons:
            raise Refused(f"{slug} has no polygon")
        areas.append((slug, polygons))
    if not areas:
        raise Refused("the boundary file has no features")
    return areas
