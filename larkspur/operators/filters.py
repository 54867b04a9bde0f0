"""Hard filters, validation, keyset pages and cursors."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import geo
from larkspur.functions.text import like_escaped
from larkspur.operators.errors import EmptyFilter, EmptyQuery, NotFound, Refused, ShortQuery

AREAS = ("bronx", "brooklyn", "manhattan", "queens", "staten_island")

#: Page sizes: default and most; oversampling and depth of each channel.
DEFAULT_LIMIT, MAX_LIMIT = 10, 100
OVERSAMPLE = 2
DEPTHS = {"structured": (10, 500), "vector": (10, 200), "review": (10, 200)}
EVIDENCE_DEPTH = (20, 100)
MIN_QUERY = 3


@dataclass(frozen=True)
class PlaceFilter:
    """Conditions that all must hold; a null in the data satisfies none of them."""

    borough: str | None = None
    cuisines: tuple[str, ...] = ()
    price_levels: tuple[int, ...] = ()
    min_rating: float | None = None
    neighborhood: str | None = None
    open_now: bool | None = None
    point: tuple[float, float] | None = None
    max_metres: float | None = None

    def is_empty(self) -> bool:
        return self == PlaceFilter()

    def validate(self, areas: Sequence[str] = AREAS) -> None:
        if self.borough is not None and self.borough.strip().lower() not in areas:
            raise Refused(f"unknown borough {self.borough!r}")
        if any(not 1 <= p <= 4 for p in self.price_levels):
            raise Refused("price levels are 1 to 4")
        if self.min_rating is not None and not 0 <= self.min_rating <= 5:
            raise Refused("ratings are 0 to 5")
        if self.max_metres is not None and self.max_metres < 0:
            raise Refused("a distance isn't negative")
        if self.point is not None and not (-90 <= self.point[0] <= 90 and -180 <= self.point[1] <= 180):
            raise Refused("a point is out of range")

    def predicates(self, post: bool = False) -> list[Column]:
        """Column conditions; with ``post`` those that are checked again on a fused pool (no flag, no distance)."""
        out: list[Column] = []
        if self.borough:
            out.append(F.col("borough") == self.borough.strip().lower())
        if self.cuisines:
            out.append(F.arrays_overlap("cuisines", F.array(*map(F.lit, self.cuisines))))
        if self.price_levels:
            out.append(F.col("price_level").isin(*self.price_levels))
        if self.min_rating is not None:
            out.append(F.col("rating") >= self.min_rating)
        if self.neighborhood:
            out.append(contains_literal(F.col("address"), self.neighborhood))
        if self.open_now is not None and not post:
            out.append(flag_state(F.col("attributes"), "open_now") == str(self.open_now).lower())
        if self.point is not None and self.max_metres is not None and not post:
            lat, lon = self.point
            out.append(geo.near_box(F.col("lat"), F.col("lon"), lat, lon, self.max_metres))
            out.append(geo.distance_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= self.max_metres)
        return out

    def describe(self) -> str:
        """The conditions as reasons quote them."""
        parts = [
            f"菜系={'/'.join(self.cuisines)}" if self.cuisines else "", f"价格={'/'.join(f'${p}' for p in self.price_levels)}" if self.price_levels else "", f"评分>={self.min_rating:.1f}" if self.min_rating is not None else "",
            f"地区={self.neighborhood}" if self.neighborhood else "", f"行政区={self.borough}" if self.borough else "", f"营业={str(self.open_now).lower()}" if self.open_now is not None else "",
            f"距离<{self.max_metres:.0f}m" if self.point is not None and self.max_metres is not None else "",
        ]
        return "、".join(p for p in parts if p)


def contains_literal(column: Column, text: str) -> Column:
    """Case-insensitive substring; nothing in it is a wildcard."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def flag_state(attributes: Column, name: str) -> Column:
    """A three-valued flag of a JSON object; 'unknown' where it is missing."""
    return F.coalesce(F.get_json_object(attributes, f"$.{name}"), F.lit("unknown"))


def clamp_limit(limit: int) -> int:
    return DEFAULT_LIMIT if limit <= 0 else min(limit, MAX_LIMIT)


def channel_depth(channel: str, page: int) -> int:
    times, most = DEPTHS[channel]
    return min(clamp_limit(page) * times, most)


def hard_filter(places: DataFrame, wanted: PlaceFilter, areas: Sequence[str] = AREAS) -> DataFrame:
    """Active places that satisfy every condition; an empty filter and one with impossible values are refused."""
    if wanted.is_empty():
        raise EmptyFilter("a search needs at least one condition")
    wanted.validate(areas)
    return places.where(reduce(lambda a, b: a & b, wanted.predicates(), F.col("is_active")))


def post_filter(pool: DataFrame, wanted: PlaceFilter) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the places of a fused pool that still satisfy what a pool can be checked for, and per query how many do not."""
    good = F.coalesce(reduce(lambda a, b: a & b, wanted.predicates(post=True), F.lit(True)), F.lit(False))
    judged = pool.withColumn("_good", good)
    return judged.where("_good").drop("_good"), judged.groupBy("query_id").agg(F.count_if(~F.col("_good")).alias("removed"))


def top_places(places: DataFrame, wanted: PlaceFilter, limit: int = 0, areas: Sequence[str] = AREAS) -> DataFrame:
    return hard_filter(places, wanted, areas).orderBy(F.col("score").desc(), F.col("restaurant_id")).limit(clamp_limit(limit))


def text_pattern(text: str) -> str:
    """The escaped pattern of a text query; empty and short ones are refused, each by its own error."""
    text = text.strip()
    if not text:
        raise EmptyQuery("the query is empty")
    if len(text) < MIN_QUERY:
        raise ShortQuery(f"a query has {MIN_QUERY} characters at least")
    return like_escaped(text)


def query_terms(query: str) -> list[str]:
    """Distinct terms of three characters or more, in lower case and order."""
    terms = list(dict.fromkeys(t for t in query.lower().split() if len(t) >= MIN_QUERY))
    if not query.strip():
        raise EmptyQuery("the query is empty")
    if not terms:
        raise ShortQuery(f"no term has {MIN_QUERY} characters")
    return terms


def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def require(df: DataFrame) -> DataFrame:
    if df.limit(1).isEmpty():
        raise NotFound("no such row")
    return df


def keyset_page(df: DataFrame, key: str, after: int | None, size: int) -> DataFrame:
    """Rows below a key, falling, one more than the page so that its being there says there is more."""
    rows = df if after is None else df.where(F.col(key) < after)
    return rows.orderBy(F.col(key).desc()).limit(size + 1)


def composite_page(df: DataFrame, first: str, second: str, after: tuple | None, size: int) -> DataFrame:
    """Rows whose (first, second) is below a pair in row order, falling."""
    rows = df if after is None else df.where(F.struct(first, second) < F.struct(F.lit(after[0]).cast(df.schema[first].dataType).alias(first), F.lit(after[1]).cast(df.schema[second].dataType).alias(second)))
    return rows.orderBy(F.col(first).desc(), F.col(second).desc()).limit(size + 1)


def mixed_page(df: DataFrame, down: str, up: str, after: tuple | None, size: int) -> DataFrame:
    """First key falling, second rising."""
    if after is not None:
        x, y = F.lit(after[0]).cast(df.schema[down].dataType), F.lit(after[1])
        df = df.where((F.col(down) < x) | ((F.col(down) == x) & (F.col(up) > y)))
    return df.orderBy(F.col(down).desc(), F.col(up)).limit(size + 1)


def with_more(page: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """The page's rows with ``has_more``; reads size + 1 rows only."""
    from pyspark.sql import Window

    numbered = page.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return numbered.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")


def tail_page(df: DataFrame, key: str, before: int | None, size: int) -> DataFrame:
    """The latest rows before a key, shown oldest first."""
    rows = df if before is None else df.where(F.col(key) < before)
    return rows.orderBy(F.col(key).desc()).limit(size).orderBy(key)


def encode_cursor(*columns: str) -> Column:
    """base64url of the columns as a JSON object, without padding."""
    text = F.base64(F.to_json(F.struct(*columns)).cast("binary"))
    return F.rtrim(F.translate(F.regexp_replace(text, r"\s", ""), "+/", "-_"), F.lit("="))


def decode_cursor(cursor: str) -> dict:
    try:
        return json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as error:
        raise Refused("not a cursor") from error


def optional_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality on each column for which a value is given."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def lookups(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """A row for each wanted key with the columns of its row and ``status``: found or not_found."""
    rows = df.withColumn("_there", F.lit(True))
    return wanted.select(key).join(rows, key, "left").withColumn("status", F.when(F.col("_there"), "found").otherwise("not_found")).drop("_there")


def query_state(text: Column) -> Column:
    """Whether a text can be searched for: empty, short (fewer code points than MIN_QUERY) or ok."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    return F.when(plain == "", "empty").when(F.length(plain) < MIN_QUERY, "short").otherwise("ok")
