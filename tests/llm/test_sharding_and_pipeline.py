import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import hashtree


def docs(spark, n=3000):
    plain = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("é text "), F.col("id") % 50).alias("text"), F.lit(1).alias("shard"))
    return plain.unionByName(spark.createDataFrame([(None, "x", 1), (None, None, 1), (n, None, 1), (n + 1, "", 1), (7, "again", 1), (7, "again", 1)], "doc_id long, text string, shard int"))


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(hashtree, "BUCKET_ROWS", 100)
    rows = hashtree.shard_documents(docs(spark)).collect()
    assert len(rows) == 3006
    texts = defaultdict(set)
    for r in docs(spark).collect():
        texts[r["doc_id"]].add((len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())))
    slots, of = defaultdict(list), {}
    for r in rows:
        assert (r["size"], r["text_crc32"]) in texts[r["doc_id"]] and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
        assert of.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 24) and r["shard"] == r["region"] * 12 + r["rack"] * 4 + r["shard"] % 4
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(a != b for a, b in of.values())
    assert 60 < moved < 200 and max(map(len, slots.values())) < 190
    assert hashtree.shard_documents(docs(spark).limit(0)).count() == 0


def test_weights_decide_shares_and_movement(spark):
    rows = spark.range(20000).select(F.col("id").alias("k"))
    old = (((1.0, 1.0), (2.0,)), ((4.0,),))
    new = (((1.0, 1.0), (3.0,)), ((4.0,),))
    got = hashtree.assign(hashtree.assign(rows, F.col("k"), old), F.col("k"), new, "next").collect()
    share = Counter(r["shard"] for r in got)
    for shard, weight in enumerate((1, 1, 2, 4)):
        assert share[shard] == pytest.approx(20000 * weight / 8, rel=0.06)
    # only the first region gains, and within the other nothing moves
    assert all(r["next_region"] == 0 for r in got if r["shard"] != r["next"])
    with pytest.raises(ValueError):
        hashtree.assign(rows, F.col("k"), ((),))
    assert {r["shard"] for r in hashtree.assign(rows, F.col("k"), (((0.0, 1.0),),)).collect()} == {1}


def test_no_python_on_the_path_of_shards(spark):
    plan = hashtree.shard_documents(docs(spark, 10))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark, tmp_path):
    english = "the cat and the dog saw that this was the house of the other one with a lot of things in it"
    base = [" ".join(f"{w}{i}{k % 5}" if k % 3 == 0 else w for k, w in enumerate(english.split() * 3)) + f" number{i} ends" * 3 for i in range(20)]
    item = "which of these nine answers is the right one for the question asked here today"
    shared = "\n".join(f"shared line number {k} with words of its own" for k in range(12))
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    data += [(50, base[3] + " tail", "en", "s", 1), (51, base[4] + " " + item, "en", "s", 1), (52, "12 34", "en", "s", 5), (53, None, "en", "s", None)]
    data += [(60 + k, f"{base[10 + k]} first\n{shared}\n{base[9 - k]} last", "en", "s", 1) for k in range(2)]
    folder = str(tmp_path)
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {51, 52, 53, 50}.isdisjoint(rows) and {3, 4, 60, 61} <= set(rows) and set(range(20)) <= set(rows)
    current = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, folder)
        assert current.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert [f.dataType for f in current.schema] == [f.dataType for f in spark.read.parquet(f"{folder}/documents.parquet").schema]
    left = {r["doc_id"]: r for r in current.collect()}
    assert shared in left[60]["text"] and shared not in left[61]["text"] and left[61]["n_chars"] == len(left[61]["text"])
    assert set(left) == set(rows)


def test_pipeline_of_nothing(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
