"""Queries that give the whole result, where others of the same operator show a part."""

from larkspur.plans import catalogue
from larkspur.sources.tables import texts

SF = "/root/testdata/sf0.1"


def test_every_place_has_a_score(spark):
    scores = catalogue.queries()["knowledge_score_all"](spark, SF)
    assert scores.count() == spark.read.parquet(f"{SF}/customer.parquet").count() > 2000


def test_fusion_asks_with_every_twentieth_document(spark):
    small = SF.replace("0.1", "0.001")
    want = {r[0] for r in spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    for name in ("fuse_weighted_all", "fuse_rrf_all", "rescore_overlay_all"):
        assert {r[0] for r in catalogue.queries()[name](spark, small).select("query_id").distinct().collect()} == want and len(want) > 3


def test_budget_counts_whole_texts(spark):
    """Against plain loops: duplicates and the fourth of a kind go, then greedy by score, then a swap for a second kind."""
    small, by_place, seen, want = SF.replace("0.1", "0.001"), {}, {}, {}
    docs = sorted(texts(spark, small).collect(), key=lambda r: (-(r["doc_id"] % 101), r["doc_id"]))
    for r in docs:
        kind = r["doc_id"] % 3 == 0
        same = seen.setdefault((r["restaurant_id"], kind), set())
        if r["text"] in same or len(same) == 3:
            continue
        same.add(r["text"])
        wide = sum(ord(c) > 255 for c in r["text"])
        by_place.setdefault(r["restaurant_id"], []).append((r["doc_id"], kind, max(1, wide + (len(r["text"]) - wide) // 4) if r["text"] else 0))
    for place, rows in by_place.items():
        kept, left = [], 400
        for row in rows:
            if row[2] <= left:
                kept.append(row)
                left -= row[2]
        other = next((r for r in rows if kept and r[1] != kept[0][1]), None)
        if len(kept) > 1 and len({r[1] for r in kept}) == 1 and other:
            n = next((n for n in range(len(kept), 0, -1) if sum(r[2] for r in kept[:n]) + other[2] <= 400), 0)
            kept = sorted([*kept[:n], other], key=rows.index) if n else kept
        want[place] = [(r[0], r[2]) for r in kept]
    got = {place: [] for place in by_place}
    for r in sorted(catalogue.queries()["budget_whole_texts"](spark, small).collect(), key=lambda r: r["position"] or 0):
        if r["status"] == "kept":
            got[r["restaurant_id"]].append((r["document_id"], r["cost"]))
    assert got == want


def test_sizes_end_at_the_unit_asked_for(spark):
    from pyspark.sql import functions as F

    from larkspur.operators import plans

    n = F.lit(7 * 600_000**2)
    assert tuple(spark.range(1).select(plans.size_label(n, "GiB"), plans.size_label(n)).first()) == ("2346.9GiB", "2.3TiB")


def test_fusion_keeps_the_weaker_reviews():
    """The fusion queries look at reviews from 0.1 on; the reasons, like the hybrid search, from the operator's floor."""
    for name in ("fuse_weighted", "fuse_rrf", "unknown_hits", "rescore_overlay"):
        for sql in (catalogue.oracle_sql()[name], catalogue.oracle_sql()[f"{name}_all"]):
            assert "FROM near WHERE score >= 0.1" in sql
    assert "FROM near WHERE score >= 0.3" in catalogue.oracle_sql()["fusion_reasons"]
