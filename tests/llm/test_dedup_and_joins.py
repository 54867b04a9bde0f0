import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontam, graph, linechunks, parity, subspace
from larkspur.llm.shingles import ascii_words, plain_words

rng = random.Random(11)
WORDS = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def grams(words, n):
    words = [w.decode() if isinstance(w, bytes) else w for w in words]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 120), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 120, 150: 120, 120: 120}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ decontamination


@pytest.fixture(scope="module")
def leaky(spark):
    items = [prose(n) for n in (6, 9, 14, 20, 33, 50, 80, 200)] + ["one two three", "Äpfel und Birnen; Nüsse? im Korb!", "", None]
    docs = []
    for k, item in enumerate(items[:8]):
        docs.append(prose(300) + " " + item + " " + prose(500))
        docs.append(prose(200) + ". " + item.upper().replace(" ", ",  ", 3) + "\n" + prose(100))
        cut = item.split(" ")
        docs.append(prose(50) + " " + " ".join(cut[: len(cut) // 2]) + " " + prose(50))
        docs.append(prose(40) + " " + " ".join(cut[: -max(1, len(cut) // 10)]) + " " + prose(40))
        docs.append(prose(60) + " " + " ".join(cut[: len(cut) // 2]) + " zz " + " ".join(cut[len(cut) // 2 :]) + " " + prose(40))
    docs += ["one two three", "one two three four", "zero one two three", "x äpfel und birnen nüsse im korb y", "", None, prose(3000) + items[3], prose(20)]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)] + [(0, docs[0], "clash"), (None, docs[0], "clash")], "doc_id long, text string, item_id string")
    return frame.repartition(3), spark.createDataFrame([*enumerate(items), (3, items[3]), (None, items[4])], "item_id long, text string")


def expected_leaks(docs, items):
    out = defaultdict(int)
    sets = [(i, grams(plain_words(t or ""), 5)) for i, t in dict.fromkeys(items)]
    for doc_id, text in docs:
        own = grams(plain_words(text or ""), 5)
        for i, item in sets:
            if item and len(own & item) >= 0.8 * len(item):
                out[doc_id, i, len(own & item), len(item)] += 1
    return out


def test_leaks_against_brute_force(leaky, monkeypatch):
    docs, items = leaky
    want = expected_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    for most in (20_000, 3):  # one block, several blocks
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", most)
        got = defaultdict(int)
        for r in decontam.find_leaks(docs, items).collect():
            got[r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]] += 1
        assert got == want and len(want) > 20
        clean = decontam.drop_leaks(docs, items)
        assert clean.schema == docs.schema
        assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - {k[0] for k in want}


def test_no_items_or_documents(leaky):
    docs, items = leaky
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), items).count() == 0


def test_repeated_items_are_collected_once(spark):
    items = spark.range(3000).select(F.lit(1).alias("item_id"), F.lit("one two three four five six").alias("text")).unionByName(spark.createDataFrame([(2, "seven eight nine ten eleven twelve")], "item_id int, text string"))
    (index,) = decontam.item_blocks(items)
    assert sorted(index.ids) == [1, 2]
    docs = spark.createDataFrame([(5, "zero one two three four five six")], "doc_id long, text string")
    assert [(r["item_id"], r["n_shared"]) for r in decontam.find_leaks(docs, items).collect()] == [(1, 2)]
    assert decontam.drop_leaks(docs, items.limit(0)).count() == docs.count()


# ------------------------------------------------------------------ lines


def line_docs(spark):
    passage = "\n".join(prose(6) for _ in range(14))
    other = "\n".join(prose(5) for _ in range(9))
    data = []
    for i in range(12):
        lines = [prose(7) for _ in range(rng.randrange(3, 12))]
        at = rng.randrange(len(lines))
        data.append((i, "\n".join([*lines[:at], passage if i % 2 else other, *lines[at:]])))
    data += [(20, "a\n\n\n\nb\n"), (21, ""), (22, None), (23, "one line"), (24, "one line"), (25, "\n".join(["same"] * 60)), (26, data[0][1]), (27, "x\r\ny\r\nz"), (28, "\n\n\n\n"), (29, "\n\n\n\n")]
    return data


def test_line_chunks_against_sql(spark):
    data = line_docs(spark)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = linechunks.remove_repeated_chunks(docs).toPandas()
    con = duckdb.connect()
    documents = docs.toPandas()
    con.register("documents", documents)
    want = con.execute(linechunks.ORACLE).df()
    key = lambda df: sorted(map(tuple, df[["doc_id", "text", "n_removed", "removed_chars"]].astype(object).where(df.notna(), None).values.tolist()))
    assert key(got) == key(want)
    by = got.set_index("doc_id")
    # of a copy only what was no multi-line chunk stays: single lines at either end
    assert by["n_removed"].sum() > 10 and len(by.loc[26, "text"].split("\n")) <= 2
    assert by.loc[28, "text"] == by.loc[29, "text"] == "\n\n\n\n" and by.loc[20, "text"] == "a\n\n\n\nb\n"


def without_passages(data):
    """By plain loops: lines that are in a pair that was seen before go, run by run, unless all of a run is blank."""
    seen, out = set(), {}
    for doc_id, text in sorted(data):
        lines = text.split("\n")
        again = []
        for pair in zip(lines, lines[1:], strict=False):
            again.append(pair in seen)
            seen.add(pair)
        kept, i, n = [], 0, 0
        while i < len(lines):
            j = i
            while j < len(again) and again[j]:
                j += 1
            if j > i and "".join(lines[i : j + 1]).strip():
                n += 1
            else:
                kept += lines[i : j + 1]
            i = j + 1
        out[doc_id] = ("\n".join(kept), n)
    return out


def test_short_passages_in_the_middle_go(spark):
    data, whole = [], {}
    for n in range(2, 7):
        for k in range(4):
            passage = [prose(52 // n + 1) for _ in range(n)]
            for copy in range(3):
                data.append((len(data), "\n".join([*[prose(9) for _ in range(3 + copy)], *passage, *[prose(9) for _ in range(4)]])))
                whole[data[-1][0]] = copy, passage
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in linechunks.remove_repeated_passages(docs).collect()}
    for i, text in data:
        copy, passage = whole[i]
        left = [x for x in text.split("\n") if x not in passage] if copy else text.split("\n")
        assert (got[i]["text"], got[i]["n_removed"]) == ("\n".join(left), int(copy > 0))
        assert got[i]["removed_chars"] == len(text) - len(got[i]["text"])


def test_passages_against_loops(spark):
    data = [(i, t) for i, t in line_docs(spark) if t is not None]
    data += [(40, "q r\ns t\nu"), (41, "p\nq r\ns t\nu\nv\nq r\ns t"), (42, "s t\nu\n\n\nw")]
    docs = spark.createDataFrame([*data, (90, None)], "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in linechunks.remove_repeated_passages(docs).collect()}
    assert rows[90]["text"] is None and rows[90]["n_removed"] == 0
    assert {i: (rows[i]["text"], rows[i]["n_removed"]) for i, _ in data} == without_passages(data)


def test_line_chunks_edges(spark):
    text = "\n".join(prose(5) for _ in range(20))
    docs = spark.createDataFrame([(1, text, 5), (1, text, 6), (None, text, 7), (2, text, 8)], "doc_id long, text string, n_removed int")
    rows = linechunks.remove_repeated_chunks(docs).collect()
    assert len(rows) == 4 and {r["doc_id"]: r["text"] == text for r in rows} == {None: True, 1: False, 2: False}
    assert len({r["text"] for r in rows if r["doc_id"] == 1}) == 1  # equal rows are one document
    assert all(len(r["text"].split("\n")) <= 2 for r in rows if r["doc_id"] is not None)
    assert linechunks.remove_repeated_chunks(docs.limit(0)).count() == 0


@pytest.mark.parametrize("remove", [linechunks.remove_repeated_chunks, linechunks.remove_repeated_passages])
def test_lines_with_clashing_columns_and_long_texts(spark, remove):
    names = ["_gone", "_doc", "_hash", "_lines", "_row", "_new", "a.b", "N_Removed", "x`y"]
    passage = "\n".join(f"line {k} of the passage" for k in range(30))
    long = "\n".join(f"{k} filler" for k in range(20_000))
    rows = [(i, t, *range(9)) for i, t in enumerate([f"{passage}\nend", f"start\n{passage}\nend", f"{long}\n{passage}", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join("`" + n.replace("`", "``") + "` int" for n in names))
    got = remove(docs, ("cut", "chars"))
    assert got.columns == [*docs.columns, "cut", "chars"]
    by = {r[0]: r for r in got.collect()}
    assert all(tuple(by[i])[2:11] == tuple(range(9)) for i in range(5))
    assert by[0][1] == rows[0][1] and by[1]["cut"] and "line 15" not in by[1][1] and by[2][1].startswith(long) and "line 15" not in by[2][1]
    assert (by[3][1], by[4][1]) == (None, "")


def test_jaccard_join_of_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    docs = spark.createDataFrame([(1, long, 0, 0, 0), (2, long + " tail", 0, 0, 0), (3, None, 0, 0, 0), (4, "", 0, 0, 0)], "doc_id long, text string, _gone int, _go int, `a.b` int")
    kept = parity.keep_one_each(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [1, 3, 4]


def test_boundaries_do_not_shift(spark):
    passage = [prose(6) for _ in range(30)]
    docs = spark.createDataFrame([(i, "\n".join([prose(3) for _ in range(i)] + passage)) for i in range(6)], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in linechunks.remove_repeated_chunks(docs).collect()}
    assert all(len(set(left[i].split("\n")) & set(passage)) <= 6 for i in range(1, 6))


def test_no_python_on_the_path_of_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    plan = linechunks.remove_repeated_chunks(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ------------------------------------------------------------------ Jaccard join


def near_docs():
    data = []
    for size in (3, 5, 8, 12, 20, 45, 90, 200, 600):
        base = prose(size)
        for share in (0, 0, 0.004, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1, 0.3):
            data.append(edited(base, share))
        data.append(base.upper() + "\n")
        data.append(base + " " + prose(max(1, size // 12)))
        data.append(" ".join(base.split()[: max(1, int(size * 0.9))]))
    star = prose(150)
    data += [edited(star, 0.02) for _ in range(60)]  # many links to the middle, few among the rest
    chain = prose(300).split()
    data += [" ".join(chain[i * 8 : i * 8 + 150]) for i in range(12)]  # neighbours link, ends do not
    rng.shuffle(data)
    return list(enumerate([*data, "", "  ", None, "é É", "É É", "a\x0bb c\td", "a b c d", "A B\nC D"]))


@pytest.mark.parametrize(("words", "p", "q"), [(4, 85, 100), (5, 4, 5)])
@pytest.mark.parametrize("rounds", [1, 0])
def test_jaccard_join_against_brute_force(spark, monkeypatch, words, p, q, rounds):
    monkeypatch.setattr(parity, "LEAD_ROUNDS", rounds)  # 0: all pairs of a bucket are looked at
    data = near_docs()
    sets = {i: grams(ascii_words(t or ""), words) for i, t in data}
    union, ids = Union(), list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if q * shared >= p * (len(sets[a]) + len(sets[b]) - shared):
                    union.join(a, b)
    docs = spark.createDataFrame([(i, t, -1) for i, t in data] + [(None, data[0][1], -1), (5, data[5][1], -1)], "doc_id long, text string, n long").repartition(3)
    got = parity.near_duplicates(docs, parity.Join(words, p, q)).collect()
    assert len(got) == len(data) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == len(sets[0])
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), union.find(r["doc_id"])), r
    if rounds and words == 5:
        kept = parity.keep_one_each(docs, parity.Join(words, p, q))
        assert kept.schema == docs.schema
        assert {r["doc_id"] for r in kept.collect()} == {union.find(i) for i in ids} | {None}


def test_equal_ids_with_unlike_texts_are_one_document(spark):
    a, b = prose(60), prose(60)
    docs = spark.createDataFrame([(1, a), (2, b), (7, a), (7, b)], "doc_id long, text string")
    assert {r["component_id"] for r in parity.near_duplicates(docs).collect()} == {1}
    assert parity.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_rows_hide_no_link(spark):
    """Stars of a hub and two leaves that share a key with the hub each, but none all three; every row occurs twice."""
    gen, join, stars = random.Random(5), parity.Join(), []
    word = lambda: f"v{gen.randrange(10**6)}"
    own = lambda t: set(join.keys(parity.shingle_set(ascii_words(" ".join(t)), join.words)).tolist())
    while len(stars) < 12:
        hub = [word() for _ in range(13)]
        star = [hub, [word(), *hub[1:]], [*hub[:-1], word()]]  # 8 of 10 shingles are shared with the hub, 7 of 11 between leaves
        a, b, c = map(own, star)
        if a & b and a & c and not a & b & c:
            stars.append(star)
    rows = [(3 * i + k, " ".join(t)) for i, star in enumerate(stars) for k, t in enumerate(star)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(3)
    got = parity.near_duplicates(docs).collect()
    assert len(got) == 2 * len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 3 * 3 for i, _ in rows}


def test_pigeonhole_holds():
    """Linked sets share a key whatever their sizes."""
    gen = np.random.default_rng(1)
    join = parity.Join(4, 85, 100)
    for _ in range(400):
        n = int(gen.integers(6, 900))
        base = np.unique(gen.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(gen.integers(0, max(1, int(0.16 * len(base)))))
        other = np.unique(np.concatenate([gen.permutation(base)[drop:], gen.integers(0, 2**64, int(gen.integers(0, max(1, n // 12))), dtype=np.uint64)]))
        shared = len(np.intersect1d(base, other))
        linked = 100 * shared >= 85 * (len(base) + len(other) - shared)
        if linked and shared < max(len(base), len(other)):
            assert len(np.intersect1d(join.keys(base), join.keys(other))), (len(base), len(other), shared)
            apart = int(np.unpackbits((parity.fold(base) ^ parity.fold(other)).view(np.uint8)).sum())
            assert apart <= len(base) + len(other) - 2 * shared
            assert parity.hamming(parity.wide(base), parity.wide(other)) <= len(base) + len(other) - 2 * shared


# ------------------------------------------------------------------ vectors


def vectors():
    gen = np.random.default_rng(2)
    out = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = gen.normal(size=16)
            for spread in (0, 0, 0.02, 0.05, 0.08, 0.1, 0.12, 0.3):
                out.append(((centre + spread * np.linalg.norm(centre) / 4 * gen.normal(size=16)).astype(np.float32).tolist(), label))
        out += [(gen.normal(size=16).astype(np.float32).tolist(), label) for _ in range(60)]
    v = out[0][0]
    out += [([x * 2 for x in v], 0), (v[:8], 0), (v[:8], 0), ([0.0] * 16, 0), ([0.0] * 16, 0), (None, 0), ([], 0), ([float("nan")] * 16, 0), ([float("inf"), *v[1:]], 0), ([None, *v[1:]], 0), ([3.0], 1), ([4.0], 1), ([-4.0], 1)]
    return [(i, e, label) for i, (e, label) in enumerate(out)]


@pytest.mark.parametrize("tile", [1 << 19, 256])
def test_vectors_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(subspace, "TILE_NUMBERS", tile)
    monkeypatch.setattr(subspace, "STEP", 24)
    data = vectors()
    data += [(9000, data[3][1], data[3][2]), (9001, data[3][1], data[3][2])]
    union, links = Union(), defaultdict(int)
    usable = [(i, np.array(e, np.float64), label) for i, e, label in data if label is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    for i, a, la in usable:
        for j, b, lb in usable:
            if i != j and la == lb and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                links[i] += 1
                union.join(i, j)
    df = spark.createDataFrame([(*x, 1) for x in data] + [(None, data[0][1], 0, 1)], "vec_id long, embedding array<float>, label int, kept int").repartition(3)
    got = subspace.near_vectors(df).collect()
    assert len(got) == len(data) + 1 and sum(links.values()) > 200
    for r in got:
        i = r["vec_id"]
        if i is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], union.find(i), union.find(i) == i), r
    assert subspace.near_vectors(df.limit(0)).count() == 0


def test_budgets_add_up():
    gen = np.random.default_rng(4)
    for size in (1, 3, 8, 64, 70):
        rotation = subspace.Rotation.fit(gen.normal(size=(50, size)), 0.93)
        assert rotation.budgets.sum() >= 0.14 and sum(b.stop - b.start for b in rotation.blocks) == size
        assert np.allclose(rotation.axes.T @ rotation.axes, np.eye(size), atol=1e-9)
