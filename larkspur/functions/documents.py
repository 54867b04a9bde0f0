"""Texts of documents about a place, as Column expressions over one row's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import one_decimal, shortened
from larkspur.operators.evidence import clock_label

# ---- Fixed values: wording of the documents.

UNKNOWN_ADDRESS, UNKNOWN_DESCRIPTION = "地址未知", "暂无官方描述。"
SNAPSHOT_NOTE = "数据来源：Google Local（2021 年快照），非实时信息。"
STATUS_LINES = {
    "open": "快照状态：2021 年时该店在营业。",
    "closed": "快照状态：2021 年时该店已停业，但仍保留其历史信息。",
    "permanently_closed": "快照状态：2021 年时该店已永久停业。",
}
UNKNOWN_STATUS = "快照状态：2021 年时未知。"
WEEKDAYS = ("周日", "周一", "周二", "周三", "周四", "周五", "周六")
CLOSED_DAY = "休息"
FEATURE_LABELS = {"atmosphere_tags": "氛围", "popular_for_tags": "适合", "service_option_tags": "服务", "accessibility_tags": "无障碍"}
ATTRIBUTE_LABELS = {"atmosphere_tags": "氛围", "popular_for_tags": "适合场合", "service_option_tags": "服务", "accessibility_tags": "无障碍"}
DESCRIPTION_CHARS, REVIEW_CHARS = 1000, 400
DIGEST_END = "This is a rule-based statistics text used only for retrieval ranking, not as citation evidence."


def _joined(parts: list[Column], mark: str) -> Column:
    """The parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), mark)


def _distinct(tags: str) -> Column:
    return F.array_distinct(F.coalesce(F.col(tags), F.array().cast("array<string>")))


def _prefixed(label: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(label), text))


def price_signs(level: Column) -> Column:
    return F.when(level.isNotNull(), F.repeat(F.lit("$"), level))


def headline() -> Column:
    """Name with the first cuisine, the price and the mean rating."""
    cuisine = F.trim(F.coalesce(F.get(F.col("cuisine_tags"), F.lit(0)), F.lit("")))
    facts = _joined([cuisine, price_signs(F.col("price_level")), F.concat(one_decimal(F.col("computed_avg")), F.lit("星"))], "，")
    return F.when(facts == "", F.col("name")).otherwise(F.concat("name", F.lit("（"), facts, F.lit("）")))


def address_line() -> Column:
    address, borough = F.trim(F.coalesce("address", F.lit(""))), F.trim(F.coalesce("borough", F.lit("")))
    return F.concat(F.when(address == "", UNKNOWN_ADDRESS).otherwise(address), F.when(borough == "", "").otherwise(F.concat(F.lit("（"), borough, F.lit("）"))))


def hours_text(hours: Column) -> Column:
    """Opening hours by weekday from Sunday, each day's in order of opening; the source's own words where there are some."""

    def said(x: Column) -> Column:
        raw = F.trim(F.coalesce(x["raw"], F.lit("")))
        return F.when(x["closed"], CLOSED_DAY).when(raw != "", raw).otherwise(F.concat(clock_label(x["open"]), F.lit("-"), clock_label(x["close"])))

    placed = F.transform(F.coalesce(hours, F.array().cast("array<struct<weekday:int,open:int,close:int,closed:boolean,raw:string>>")), lambda x, i: F.struct(x["open"].alias("open"), i.alias("i"), x.alias("x")))

    def day(number: int, name: str) -> Column:
        own = F.array_sort(F.filter(placed, lambda p: p["x"]["weekday"] == number))
        return F.when(F.size(own) > 0, F.concat(F.lit(f"{name} "), F.array_join(F.transform(own, lambda p: said(p["x"])), "、")))

    return _joined([day(number, name) for number, name in enumerate(WEEKDAYS)], "；")


def features() -> Column:
    tags = [F.array_join(_distinct("cuisine_tags"), "、")]
    tags += [_prefixed(f"{label}：", F.array_join(_distinct(column), "、")) for column, label in FEATURE_LABELS.items()]
    return _joined(tags, "；")


def review_overview() -> Column:
    """Means with the size of their sample, and the source's own mean apart."""
    capped = F.when(F.coalesce("source_review_count_capped", F.lit(False)), "（已截顶）").otherwise("")
    return _joined(
        [
            F.concat(F.lit("入库评论样本均分 "), one_decimal(F.col("computed_avg"))), F.when(F.col("stored_count") > 0, F.concat(F.lit("样本量 "), F.col("stored_count").cast("string"), F.lit(" 条"))),
            F.when(F.col("text_count") > 0, F.concat(F.lit("含文字评论 "), F.col("text_count").cast("string"), F.lit(" 条"))), F.concat(F.lit("来源站评分 "), one_decimal(F.col("source_avg")), capped),
        ],
        "，",
    )


def profile_text() -> Column:
    description = shortened(F.trim(F.coalesce("description", F.lit(""))), DESCRIPTION_CHARS)
    status = F.lit(UNKNOWN_STATUS)
    for name, line in STATUS_LINES.items():
        status = F.when(F.col("snapshot_status") == name, line).otherwise(status)
    return _joined(
        [
            headline(), F.concat(F.lit("地址："), address_line()), F.concat(F.lit("简介："), F.when(description == "", UNKNOWN_DESCRIPTION).otherwise(description)), _prefixed("营业时间：", hours_text(F.col("hours"))),
            _prefixed("特色：", features()), _prefixed("评论概况：", review_overview()), status, F.lit(SNAPSHOT_NOTE),
        ],
        "\n",
    )


def attributes_text() -> Column:
    lines = _joined([_prefixed(f"{label}：", F.array_join(_distinct(column), "、")) for column, label in ATTRIBUTE_LABELS.items()], "\n")
    return F.when(lines != "", F.concat("name", F.lit("的服务与设施\n"), lines))


def place_documents(places: DataFrame) -> DataFrame:
    """restaurant_id, doc_type and content of every place's profile, and of its attributes and hours where there are some.

    ``places``: the curated columns with stored_count, text_count and computed_avg.
    """
    hours = hours_text(F.col("hours"))
    texts = {"restaurant_profile": profile_text(), "restaurant_attributes": attributes_text(), "restaurant_hours": F.when(hours != "", F.concat("name", F.lit("的营业时间\n"), hours))}
    rows = F.array(*[F.struct(F.lit(kind).alias("doc_type"), text.alias("content")) for kind, text in texts.items()])
    return places.select("restaurant_id", F.inline(F.filter(rows, lambda x: x["content"].isNotNull())))


def representative_documents(selected: DataFrame, counts: DataFrame) -> DataFrame:
    """One document per place of its chosen reviews, newest first; a place has thirty at most.

    ``selected``: restaurant_id, id, rating, reviewed_at, text; ``counts``: restaurant_id and available, the reviews chosen from.
    """
    line = F.concat(F.lit("["), F.col("rating").cast("string"), F.lit("星] “"), shortened(F.trim("text"), REVIEW_CHARS), F.lit("”（"), F.date_format("reviewed_at", "yyyy-MM-dd"), F.lit("）"))
    each = selected.select("restaurant_id", F.struct((-F.unix_micros(F.col("reviewed_at").cast("timestamp"))).alias("at"), "id", line.alias("line")).alias("r"))
    listed = each.groupBy("restaurant_id").agg(F.array_sort(F.collect_list("r")).alias("rows")).join(counts, "restaurant_id")
    head = F.concat(F.lit("代表性评论（2021 快照，"), F.col("available").cast("string"), F.lit(" 条可用评论中选出 "), F.size("rows").cast("string"), F.lit(" 条）"))
    return listed.select("restaurant_id", F.lit("representative_reviews").alias("doc_type"), F.array_join(F.concat(F.array(head), F.transform("rows", lambda x: x["line"])), "\n").alias("content"))


def rules_digest(places: DataFrame, reviews: DataFrame, selected: DataFrame, topics: DataFrame) -> DataFrame:
    """restaurant_id and content of each place with chosen reviews: its header, means and one line for each topic.

    ``reviews`` are those with text; ``topics``: restaurant_id, topic, n, mean_rating, positive_ratio, sentiment, keywords.
    """
    percent = lambda x: F.replace(F.format_number(x * 100, 0), F.lit(","), F.lit(""))
    means = reviews.groupBy("restaurant_id").agg(F.count("*").alias("_texts"), F.avg("rating").alias("_mean"))
    chosen = selected.groupBy("restaurant_id").agg(F.avg((F.col("rating") >= 4).cast("double")).alias("_positive"))
    direction = F.when(F.col("sentiment") > 0.15, "relatively better reviewed").when(F.col("sentiment") < -0.15, "relatively lower reviewed").otherwise("in line with the overall restaurant")
    words = F.when(F.size("keywords") > 0, F.array_join("keywords", ", ")).otherwise("no notable keywords")
    line = F.concat("topic", F.lit(": "), F.col("n").cast("string"), F.lit(" reviews, average "), one_decimal(F.col("mean_rating")), F.lit(" stars, positive ratio "), percent(F.col("positive_ratio")), F.lit("%, "), direction, F.lit("; keywords: "), words, F.lit("."))
    lines = topics.groupBy("restaurant_id").agg(F.array_sort(F.collect_list(F.struct("topic", line.alias("line")))).alias("_lines"))  # seven topics at most
    rows = places.join(means, "restaurant_id").join(chosen, "restaurant_id").join(lines, "restaurant_id", "left")
    header = _joined(
        [
            _prefixed("cuisine: ", F.trim(F.coalesce(F.get(F.col("cuisine_tags"), F.lit(0)), F.lit("")))), _prefixed("borough: ", F.trim(F.coalesce("borough", F.lit("")))), _prefixed("price: ", F.coalesce(price_signs(F.col("price_level")), F.lit(""))),
        ],
        ", ",
    )
    first = F.concat("name", F.lit(" review comprehension (offline rule statistics over "), F.col("_texts").cast("string"), F.lit(" text reviews)."))
    average = F.concat(F.lit("Average sample rating "), one_decimal(F.col("_mean")), F.lit(" stars; positive (4-5 stars) share among representative reviews is "), percent(F.col("_positive")), F.lit("%."))
    middle = F.array_join(F.transform(F.coalesce("_lines", F.array().cast("array<struct<topic:string,line:string>>")), lambda x: x["line"]), "\n")
    return rows.select("restaurant_id", _joined([first, F.when(header != "", F.concat(header, F.lit("."))), average, middle, F.lit(DIGEST_END)], "\n").alias("content"))
