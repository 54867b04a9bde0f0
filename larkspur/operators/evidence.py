"""Evidence: completeness, dedup, diversity, token budget, citations, sampling, documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import one_decimal, shortened, token_estimate
from larkspur.operators.errors import BudgetExceeded

DEFAULT_BUDGET, MIN_BUDGET, PER_KIND = 2000, 24, 3
MIN_YEAR = 2000
SAMPLE_FLOOR, SAMPLE_CEILING, SAMPLE_SHARE = 10, 30, 0.1


def incompleteness(now: Column) -> Column:
    """The first rule that a document breaks; null if it can be cited."""
    at = F.col("snapshot_at")
    return (
        F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty_content").when(F.trim(F.coalesce("source", F.lit(""))) == "", "missing_source")
        .when(at.isNull(), "missing_snapshot").when(at > now, "snapshot_in_future").when(F.year(at) < MIN_YEAR, "implausible_snapshot")
        .when(F.coalesce("document_id", F.lit(0)) <= 0, "missing_document_id")
    )


def with_source(docs: DataFrame) -> DataFrame:
    """Documents whose blank source is 'unknown', with a ``warning`` where it is."""
    known = F.nullif(F.trim(F.coalesce("source", F.lit(""))), F.lit(""))
    return docs.withColumn("warning", F.when(known.isNull(), F.concat(F.lit("证据 "), F.col("document_id").cast("string"), F.lit(" 缺少来源")))).withColumn("source", F.coalesce(known, F.lit("unknown")))


def assembly_status(docs: DataFrame, now: Column, budget: int) -> DataFrame:
    """Per place what assembling its evidence comes to: nothing_citable (an error of the input), over_budget (no citable document fits), or assembled; with the counts behind it.

    ``docs`` have restaurant_id, the columns of ``incompleteness`` and cost.
    """
    budget = check_budget(budget)
    good = incompleteness(now).isNull()
    counts = docs.groupBy("restaurant_id").agg(F.count("*").alias("found"), F.count_if(good).alias("citable"), F.count_if(good & (F.col("cost") <= budget)).alias("fitting"))
    return counts.withColumn("status", F.when(F.col("citable") == 0, "nothing_citable").when(F.col("fitting") == 0, "over_budget").otherwise("assembled"))


def dedupe(docs: DataFrame) -> DataFrame:
    """The best-scored document of each (place, kind, content hash)."""
    w = Window.partitionBy("restaurant_id", "doc_type", "content_hash").orderBy(F.col("score").desc(), "document_id")
    return docs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cap_per_kind(docs: DataFrame, cap: int = PER_KIND, order: Column | None = None) -> DataFrame:
    """At most ``cap`` documents of each (place, kind), in arrival order."""
    w = Window.partitionBy("restaurant_id", "doc_type").orderBy(*([order] if order is not None else [F.col("score").desc(), F.col("document_id")]))
    return docs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def check_budget(budget: int) -> int:
    budget = budget if budget > 0 else DEFAULT_BUDGET
    if budget < MIN_BUDGET:
        raise BudgetExceeded(f"a budget of {budget} tokens cannot hold a citation; {MIN_BUDGET} can")
    return budget


def greedy(costs: list[int], budget: int) -> list[int]:
    """Places of the rows that fit when each is taken in turn unless it would exceed the budget."""
    taken = []
    for at, cost in enumerate(costs):
        if cost <= budget:
            taken.append(at)
            budget -= cost
    return taken


def assemble_rows(rows: list[dict], budget: int) -> list[dict]:
    """Rows within the budget; they come, and are returned, by falling score and rising id.

    Where all rows that fit are of one kind, the best row of another kind takes the place of as
    few of the last ones as make room for it, if the first can stay.
    """
    kept = [rows[at] for at in greedy([r["cost"] for r in rows], budget)]
    kinds = {r["doc_type"] for r in kept}
    newcomer = next((r for r in rows if r["doc_type"] not in kinds), None)
    if len(kept) < 2 or len(kinds) > 1 or newcomer is None:
        return kept
    for stay in range(len(kept), 0, -1):
        if sum(r["cost"] for r in kept[:stay]) + newcomer["cost"] <= budget:
            return [r for r in rows if r in kept[:stay] or r is newcomer]
    return kept


def assemble(docs: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """Per place the documents within the token budget: restaurant_id, document_id, cost, position, status.

    The fold depends on the order of a place's candidates, which the diversity cap bounds
    to a few per kind before it; a place of which nothing fits has one row of status 'budget_exceeded'.
    """
    budget = check_budget(budget)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["score", "document_id"], ascending=[False, True]).to_dict("records")
        kept = assemble_rows(rows, budget)
        place = rows[0]["restaurant_id"]
        out = [(place, r["document_id"], r["cost"], i + 1, "kept") for i, r in enumerate(kept)] or [(place, None, None, None, "budget_exceeded")]
        return pd.DataFrame(out, columns=["restaurant_id", "document_id", "cost", "position", "status"]).astype({"document_id": "Int64", "cost": "Int64", "position": "Int64"})

    priced = cap_per_kind(dedupe(docs)).withColumn("cost", token_estimate(F.col("content")).cast("long"))
    return priced.select("restaurant_id", "document_id", "doc_type", "score", "cost").groupBy("restaurant_id").applyInPandas(fold, "restaurant_id long, document_id long, cost long, position long, status string")


#: Kinds of documents that an answer without a caveat needs.
ANSWERABLE_KINDS = 2


def adequacy(docs: Column, kinds: Column, candidates: Column, soft: Column) -> Column:
    """Struct of mode and sufficient, from the numbers of documents, their kinds, candidates and soft conditions.

    Any document makes it evidence; without one, candidates are facts, and soft conditions that
    no review speaks to are a gap. Without candidates either there is no mode.
    """
    mode = F.when(docs > 0, "evidence").when(candidates == 0, None).when(soft > 0, "review_gap").otherwise("facts_only")
    return F.struct(mode.alias("mode"), F.coalesce(F.when(mode == "evidence", kinds >= ANSWERABLE_KINDS).otherwise(mode == "facts_only"), F.lit(False)).alias("sufficient"))


def trim_history(messages: DataFrame, key: str, order: str, last: int, budget: int) -> DataFrame:
    """The last messages of each thread, without the oldest until the rest fits the budget."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    costs = messages.withColumn("cost", token_estimate(F.coalesce("text", F.lit("")))).withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= last)
    suffix = F.sum("cost").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return costs.withColumn("_sum", suffix).where(F.col("_sum") <= budget).drop("_rn", "_sum")


def cited_ids(text: Column) -> Column:
    """Ids of all [^n] markers in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\^(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))


def invalid_citations(text: Column, allowed: Column) -> Column:
    """Cited ids that are not allowed, first occurrences in order."""
    return F.array_except(F.array_distinct(cited_ids(text)), allowed)


def sorted_citations(ids: Column) -> Column:
    """Ids in rising order, each once."""
    return F.array_sort(F.array_distinct(ids))


def citation_verdict(text: Column, allowed: Column, tries: Column) -> Column:
    """What becomes of an answer: accepted, regenerated once if it cites what it may not, failed if it does so again."""
    return F.when(F.size(invalid_citations(text, allowed)) == 0, "accept").when(tries < 1, "regenerate").otherwise("fail")


def is_permutation(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def is_offered_subset(cited: Column, offered: Column) -> Column:
    """False for an empty citation list."""
    return (F.size(cited) > 0) & (F.size(F.array_except(cited, offered)) == 0)


def band(rating: Column) -> Column:
    return F.when(rating >= 4, "positive").when(rating == 3, "neutral").otherwise("negative")


def sample_target(n: Column) -> Column:
    """A tenth, ten at least and thirty at most, but no more than there are."""
    return F.least(F.greatest(F.floor(n * SAMPLE_SHARE), F.lit(SAMPLE_FLOOR)), F.lit(SAMPLE_CEILING), n).cast("long")


def representative(reviews: DataFrame) -> DataFrame:
    """Stratified sample of each place's reviews with text: quotas in proportion to band sizes by largest remainder.

    Within a band low ratings first, then the newest, then the id. Leftover seats go to the
    bands by remainder, ties to the lower band (negative, neutral, positive).
    """
    texts = reviews.where(F.trim("text") != "").withColumn("band", band(F.col("rating")))
    number = F.when(F.col("band") == "negative", 0).when(F.col("band") == "neutral", 1).otherwise(2)
    sizes = texts.groupBy("restaurant_id", "band").agg(F.count("*").alias("size")).withColumn("band_no", number)
    place = Window.partitionBy("restaurant_id")
    shares = sizes.withColumn("total", F.sum("size").over(place)).withColumn("target", sample_target(F.col("total"))).withColumn("share", F.col("target").cast("double") * F.col("size") / F.col("total"))
    base = shares.withColumn("base", F.floor("share")).withColumn("left", F.col("target") - F.sum("base").over(place))
    # a share never exceeds its band, and what is left over is less than the number of bands, so one round of seats suffices
    seats = base.withColumn("seat", F.row_number().over(place.orderBy((F.col("share") - F.col("base")).desc(), "band_no")))
    quotas = seats.withColumn("quota", F.least(F.col("base") + (F.col("seat") <= F.col("left")).cast("long"), F.col("size"))).select("restaurant_id", "band", "quota")
    rank = F.row_number().over(Window.partitionBy("restaurant_id", "band").orderBy("rating", F.col("reviewed_at").desc(), "id"))
    return texts.withColumn("rn", rank).join(quotas, ["restaurant_id", "band"]).where(F.col("rn") <= F.col("quota"))


def topic_summary(label: Column, n: Column, mean: Column, positive: Column, keywords: Column) -> Column:
    """The stored line of a topic's figures."""
    words = F.when(F.size(keywords) > 0, F.concat(F.lit("高频词："), F.array_join(keywords, "、"), F.lit("。"))).otherwise("暂无明显关键词。")
    return F.concat(label, F.lit("："), n.cast("string"), F.lit(" 条评论，平均 "), one_decimal(mean), F.lit(" 星，正面占比 "), _percent(positive), F.lit("%。"), words)


def _percent(share: Column) -> Column:
    return F.replace(F.format_number(share * 100, 0), F.lit(","), F.lit(""))


def summary_average(text: Column) -> Column:
    """The average read back out of a stored line; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"平均 (?:评分)?\s*(?:平均)?\s*([^ 星]+)[ 星]", 1), F.lit("")).try_cast("double")


def sentiment_phrase(offset: Column) -> Column:
    """A topic's mean against the place's, in words; none within 0.15."""
    return F.when(offset > 0.15, "更受好评").when(offset < -0.15, "评价偏低").otherwise("")


def summary_document(name: Column, label: Column, line: Column, n: Column, positive: Column, offset: Column) -> Column:
    """The citable document of a topic; its average is that of the stored line."""
    average = summary_average(line)
    said = F.when(average.isNull(), "评分未知").otherwise(F.concat(one_decimal(average), F.lit(" 星")))
    phrase = sentiment_phrase(offset)
    head = F.concat(name, F.lit("的"), label, F.lit("评论\n在 "), n.cast("string"), F.lit(" 条提到"), label, F.lit("的评论中，平均评分 "), said, F.lit("，正面（4–5 星）占比 "), _percent(positive), F.lit("%。"))
    return F.concat(head, F.when(phrase != "", F.concat(F.lit("该主题相对本店整体"), phrase, F.lit("。"))).otherwise(""))


def clock_label(minute: Column) -> Column:
    """A minute of the day as 9:05 or 17:00; the days before and after count on."""
    m = F.pmod(minute, F.lit(1440))
    return F.format_string("%d:%02d", F.floor(m / 60), F.pmod(m, F.lit(60)))


def sample_document(name: Column, selected: Column, available: Column, most: int = 400) -> Column:
    """The text of a sample: an array of (rating, text, day), in order, below a heading."""
    lines = F.transform(selected, lambda r: F.concat(F.lit("["), r["rating"].cast("string"), F.lit("] "), shortened(F.trim(r["text"]), most), F.lit(" ("), r["day"], F.lit(")")))
    head = F.concat(name, F.lit(": "), F.size(selected).cast("string"), F.lit(" of "), available.cast("string"), F.lit(" reviews"))
    return F.array_join(F.concat(F.array(head), lines), "\n")


# ---- Fixed values: the gate's lengths and patterns.

GATE_LENGTHS = (150, 800)
GATE_URL = r"(?i)(https?://|www\.)\S+"
GATE_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
GATE_PHONE = r"(\+?\d{1,3}[-.\s]\d{3}[-.\s]\d{4})|(1[3-9]\d{9})"
GATE_OVERRIDE = (
    r"(?i)(忽略[^\n]{0,6}指令|无视[^\n]{0,6}指令|不要(再)?(遵守|听取)[^\n]{0,6}(指令|规则)"
    r"|ignore\s+(all\s+)?(the\s+)?(previous|prior|above|preceding|earlier)\s+(instruction|prompt|rule)s?"
    r"|disregard\s+(all\s+)?(the\s+)?(previous|prior|above|preceding)\s+(instruction|prompt|rule)s?"
    r"|forget\s+(all\s+)?(the\s+)?(previous|prior|above)\s+(instruction|prompt|rule)s?)"
)


def text_problems(text: Column) -> Column:
    """Names of the gate's rules that a generated text, without white space at its ends, breaks."""
    body = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    rules = {"url": GATE_URL, "email": GATE_EMAIL, "phone": GATE_PHONE, "instruction": GATE_OVERRIDE}
    size = F.when(F.length(body) < GATE_LENGTHS[0], "too_short").when(F.length(body) > GATE_LENGTHS[1], "too_long")
    return F.array_compact(F.array(size, *[F.when(body.rlike(pattern), name) for name, pattern in rules.items()]))

