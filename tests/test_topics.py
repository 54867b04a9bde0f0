"""Topics and their words: a text is cut once for each, and they are what a loop finds."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import rollups

TEXTS = [
    (1, "Fresh food and the staff was kind; zebra zebra apple", 5), (1, "food: apple-apple mango, x_food", 2), (1, "nothing to see zebra zebra zebra", 3),
    (2, "caféfood née $5 thé thé", 4), (2, "family \n friendly DATE night pear", 1), (2, "only $ and family friends", 5), (2, "foods pear food_x", 1),
    (3, None, 2), (3, "", 3), (3, "...", 3), (4, "food of it", 4), (None, "queue QUEUE food melon", 2),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "restaurant_id long, text string, rating int").coalesce(2)


def told(text):
    low = (text or "").lower()
    inside = lambda phrase: re.search(r"(?<![0-9A-Za-z_])" + phrase.replace(" ", r"\s+") + r"(?![0-9A-Za-z_])", low)
    return sorted(n for n, words in T.TOPICS.items() if any(re.search(r"\$[0-9]", low) if w == "$" else inside(w) for w in words))


def test_topics_and_their_words_are_a_loops(texts):
    counts = {}
    for place, text, _ in TEXTS:
        for topic in told(text):
            counts.setdefault((place, topic), Counter()).update(w for w in re.split(r"[\W_]+", text.lower()) if len(w) >= T.MIN_KEYWORD and w not in T.STOP_WORDS)
    want = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3]] for k, c in counts.items() if c}
    assert {(r["restaurant_id"], r["topic"]): r["keywords"] for r in rollups.topic_keywords(texts, 3).collect()} == want and len(want) > 6
    assert {(r["restaurant_id"], r["topic"]): r["n"] for r in rollups.topic_rollup(texts).collect()} == Counter((place, topic) for place, text, _ in TEXTS for topic in told(text))


def test_a_text_is_cut_once_for_topics_and_once_for_words(texts):
    assert rollups.topic_keywords(texts, 3)._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2


def test_words_are_dealt_out_to_topics_after_the_shuffle(texts):
    plan = rollups.topic_keywords(texts, 3)._jdf.queryExecution().optimizedPlan().toString()
    counted = [line for line in plan.split("\n") if "Aggregate [" in line][-1]  # the lowest one, next to the input
    assert counted.split("Aggregate [")[1].split("]")[0].count("#") == 2  # place and word


def test_the_digest_cuts_a_text_once_for_each_reading(spark):
    from larkspur.plans import catalogue

    plan = catalogue.queries()["rules_digest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 3  # topics for the rollup, topics and words for the keywords


def test_figures_and_words_of_one_reading_are_those_of_two(texts):
    odd = texts.withColumn("rating", F.when(F.col("rating") != 3, F.col("rating"))).unionByName(texts.selectExpr("restaurant_id + 10 AS restaurant_id", "concat(text, ' snake_case ÉCOLE_food éfood date\u00a0night date_night family_friendly') AS text", "rating"))
    known = {(r["restaurant_id"], r["topic"]): r["keywords"] for r in rollups.topic_keywords(odd, 3).collect()}
    figures = ("n", "mean_rating", "positive_ratio", "sentiment")
    want = {(r["restaurant_id"], r["topic"]): (*[r[c] for c in figures], known.get((r["restaurant_id"], r["topic"]))) for r in rollups.topic_rollup(odd).collect()}
    assert {(r["restaurant_id"], r["topic"]): (*[r[c] for c in figures], r["keywords"]) for r in rollups.topic_figures(odd, 3).collect()} == want and len(want) > 12


def test_the_digest_reads_topics_and_words_in_one_pass_and_sorts_no_words(spark):
    from larkspur.plans import catalogue

    plan = catalogue.queries()["rules_digest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1  # topics are found once; a text that both rules cut alike is cut once
    assert plan.count("MapInArrow") == 1


def test_only_words_that_may_lead_are_left():
    rows = [(p, None if w == 0 else f"w{(w * 7919) % 5003:04d}", (w * w + (p or 0)) % 11, w % 3) for p in (None, 1, 2) for w in range(5000)]
    counts = pa.RecordBatch.from_pylist([dict(zip(("restaurant_id", "word", "a", "b"), r)) for r in rows])
    batches = [counts.slice(k, 700) for k in range(0, len(rows), 700)]
    left = [r for b in rollups._leaders(["a", "b"], ["restaurant_id", "word"], 3)(iter(batches)) for r in b.to_pylist()]
    for p in (None, 1, 2):
        for t, topic in enumerate("ab"):
            all_ = [(-r[2 + t], r[1]) for r in rows if r[0] == p and r[1] and r[2 + t]]
            own = [(-r["n"], r["word"]) for r in left if (r["restaurant_id"], r["topic"]) == (p, topic) and r["word"]]
            assert sorted(own)[:3] == sorted(all_)[:3] and len(own) <= 3 * len(batches) and set(own) <= set(all_)
    assert sum(r["word"] is None for r in left) == sum(n > 0 for r in rows if r[1] is None for n in r[2:])
