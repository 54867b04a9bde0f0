import hashlib
import zlib

import pytest
import zstandard
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import chat, langid, warc

SAMPLES = {
    "en": "the quick brown fox and the lazy dog were in the house with the other things that they had seen",
    "de": "der schnelle braune fuchs und der faule hund waren in dem haus mit den anderen dingen die sie sahen",
    "fr": "le rapide renard brun et le chien paresseux etaient dans la maison avec les autres choses qu ils voyaient",
}


def labelled(spark):
    data = [(i, f"{text} {i}", lang) for i, (lang, text) in enumerate(list(SAMPLES.items()) * 40)]
    return spark.createDataFrame(data + [(900, None, "en"), (901, "", None), (902, "1234 !!", "en"), (903, "x", None), (None, SAMPLES["de"], "de"), (4, f"{SAMPLES['de']} 4", "de")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))


def test_languages(spark):
    got = {r["doc_id"]: r for r in langid.identify(labelled(spark)).collect()}
    assert len(got) == 125 and langid.identify(labelled(spark)).count() == 126
    for i, lang in enumerate(list(SAMPLES) * 40):
        assert got[i]["lang_pred"] == lang and 0 < got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[None]["lang_pred"] == "de" and not got[None]["held_out"]


def test_nothing_to_learn_and_empty(spark):
    none = labelled(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(labelled(spark).limit(0)).count() == 0
    assert langid.keep_identified(none).count() == 123


def test_rejects_go_and_columns_stay(spark):
    docs = labelled(spark)
    kept = langid.keep_identified(docs)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {900, 901, 902, 903}  # a lone letter is close to no language


def test_out_of_place_distance_by_hand():
    """Against a plain reckoning with dictionaries."""
    text, settings = "Ab ab, abc!", langid.Settings(profile=7)
    counts: dict[str, int] = {}
    for word in ("ab", "ab", "abc"):
        padded = f" {word} "
        for n in range(1, 6):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram.strip() and " " not in gram[1:-1] and (n > 1 or gram != " "):
                    counts[gram] = counts.get(gram, 0) + 1
    grams, n = langid.counted(langid.grams_of(langid.letters_of(text), 5, settings.bits))
    assert sorted(n.tolist()) == sorted(counts.values())
    own = langid.ranked(grams, n, 7).tolist()
    other = [*own[2:], 12345, 12346]
    profiles = langid.Profiles({"x": own, "y": other}, settings)
    assert profiles.predict(text) == ("x", 1.0)
    only = langid.Profiles({"y": other}, settings)
    distance = sum(abs(i - other.index(g)) if g in other else 7 for i, g in enumerate(own))
    assert only.predict(text) == ("y", pytest.approx(1 - distance / 49))


def pages(spark):
    big = "<p>" + "word " * 50 + "</p>"
    data = [(5, "http://a", big), (2, "http://b\r\nX: y%", big), (9, None, big), (1, "http://c", "tiny"), (3, "http://d", "tiny"), (4, "", ""), (6, "u", None), (7, "u", "é" * 50), (8, "u", "é" * 50), (7, "u", "é" * 50), (None, "n", big)]
    return spark.createDataFrame([(*x, "clash") for x in data], "page_id long, url string, html string, digest string")


def test_archives(spark):
    got = warc.archive_pages(pages(spark)).collect()
    assert len(got) == 11
    rows = {(r["page_id"], r["url"]): r for r in got}
    for r in pages(spark).collect():
        payload, row = (r["html"] or "").encode(), rows[r["page_id"], r["url"]]
        assert (row["payload_bytes"], row["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
    of = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert of[2] == ("response", None) and of[5] == ("revisit", 2) and of[9] == ("revisit", 2)
    assert of[1] == of[3] == of[4] == of[6] == of[7] == of[None] == ("response", None) and of[8] == ("revisit", 7)
    assert warc.archive_pages(pages(spark).limit(0)).count() == 0


def test_archive_layout(spark):
    folder = warc.scratch(spark, "layout")
    many = spark.range(0, 3000, numPartitions=1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<html>" + "common text " * 40), F.col("id")).alias("html"))
    warc.write_archives(many, folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect()
    total = 0
    for f in files:
        content = bytes(f["content"])
        assert content[:4] == (0x184D2A5D).to_bytes(4, "little")
        total += len(content)
        size = int.from_bytes(content[4:8], "little")
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size])).stream_reader(content, read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n")  # any reader passes over the skippable frames
    assert sum(1 for f in files for _ in warc.read_archive(bytes(f["content"]))) == 3000
    assert total < 3000 * 300


@given(st.text(alphabet="\\<|>turn:end\nab", max_size=40), st.text(alphabet="\\|:x", max_size=8), st.text(alphabet="<|\\", max_size=5))
def test_turns_read_back(text, role, more):
    parts = [{"kind": "text", "text": text}, {"kind": "image", "ref": "r", "width": 60, "height": 28}, {"kind": "text", "text": more}, {"kind": "text", "text": text}]
    visitor = chat.format_turn(role, parts)
    got_role, content = chat.parse_turn("".join(visitor.out))
    joined = [x for x in content if not isinstance(x, str)]
    assert got_role == role and joined == [("image", 0)]
    assert "".join(x for x in content if isinstance(x, str)) == text + more + text
    assert visitor.attachments == [{"ordinal": 0, "kind": "image", "ref": "r", "tokens": 5}]


def test_parts_and_loss_spans(spark):
    parts = [("text", "hi <|end|>", None, None, None, None, None), ("audio", None, "a.wav", None, None, 2.01, None), ("document", None, "d.pdf", None, None, None, 3), ("text", "bye", None, None, None, None, None)]
    df = spark.createDataFrame([(1, "assistant", parts), (2, None, None), (3, "user", [])], f"k int, role string, parts {chat.PART_SCHEMA}")
    got = {r["k"]: r for r in chat.format_turns(df).collect()}
    one = got[1]
    assert [one["formatted"][s["start"] : s["stop"]] for s in one["loss_spans"]] == ["hi <\\|end|>", "bye"]
    assert [(a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(0, "audio", "a.wav", 51), (1, "document", "d.pdf", 3072)]
    assert one["text_chars"] == 13 and one["attachment_tokens"] == 3123
    assert got[2]["formatted"] == "<|turn:|>\n\n<|end|>\n" and got[3]["loss_spans"] == []
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"kind": "video"}])


def test_conversations(spark):
    data = [(1, 0, "user", "a\\b"), (1, 1, "assistant", "é<|x"), (1, 2, "assistant", None), (2, 5, None, "t"), (2, 5, None, "t"), (None, 0, "assistant", "z"), (3, None, "system", "s"), (3, 0, "assistant", "")]
    df = chat.with_probe(spark.createDataFrame([(*x, "clash") for x in data], "conv_id long, turn long, role string, text string, formatted string"))
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    by: dict = {}
    for conv, _, role, text in [*data, *chat.PROBE]:
        by.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns) and row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert row["formatted_chars"] > sum(len(r) + len(t) for r, t in turns)
    assert chat.format_conversations(df.limit(0)).count() == 0


# ------------------------------------------------------------------ noise, long texts, reading in slices


def test_profiles_by_hand(spark):
    """Fitted profiles are the most frequent n-grams of all rows that may teach, by falling count, then by code."""
    docs = labelled(spark)
    settings = langid.Settings(profile=40, sample_rows=10**6)
    got = langid.fit(docs, settings)
    assert got.languages == ["de", "en", "fr"]
    want = {}
    for lang in got.languages:
        grams = [langid.grams_of(langid.letters_of(r["text"]), settings.longest, settings.bits) for r in docs.collect() if r["lang"] == lang and len(langid.letters_of(r["text"] or ""))]
        counts = {}
        for g in (int(x) for part in grams for x in part):
            counts[g] = counts.get(g, 0) + 1
        want[lang] = sorted(counts, key=lambda g: (-counts[g], g))[:40]
    expected = langid.Profiles(want, settings)
    assert (got.grams == expected.grams).all() and (got.ranks == expected.ranks).all() and (got.absent == expected.absent).all()


def test_noise_and_unlearned_languages_go(spark):
    import base64
    import random

    gen = random.Random(4)
    said = {lang: text.split() for lang, text in SAMPLES.items()}
    data = [(i, " ".join(gen.choice(said[lang]) for _ in range(gen.randrange(5, 60))), lang) for i, lang in enumerate(list(said) * 100)]
    letters = [" ".join("".join(gen.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(gen.randrange(2, 10))) for _ in range(40)) for _ in range(5)]
    polish = "wszystkie ludzkie istoty rodzą się wolne i równe pod względem swej godności i swych praw są one obdarzone rozumem i sumieniem"
    noise = [*letters, *[base64.b64encode(gen.randbytes(300)).decode() for _ in range(5)], polish, polish * 3]
    docs = spark.createDataFrame(data + [(1000 + i, t, None) for i, t in enumerate(noise)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in langid.keep_identified(docs).collect()} == {i for i, _, _ in data}


def test_very_long_texts(spark):
    long = " ".join([SAMPLES["en"]] * 8000)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(SAMPLES.items())] + [(50, long, "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}[50] == "en"
    page = spark.createDataFrame([(1, "u", long), (2, "v", long)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_pages(page).collect()}
    assert got[1]["payload_bytes"] == len(long) and got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 1
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns).first()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())


def test_reading_hands_over_little_more_than_the_archive(monkeypatch):
    """Whatever follows a record, the decompressor gets at most about twice its frame."""
    import random

    gen = random.Random(3)
    records = [warc.record_bytes(f"urn:x:{i}", "2024-01-01T00:00:00Z", i, "u", gen.randbytes(1500), "0" * 64, 1500, None) for i in range(2000)]
    dictionary = warc.build_dictionary(records[:100])
    writer = zstandard.ZstdCompressor(dict_data=dictionary)
    content = warc.dictionary_frame(dictionary) + b"".join(map(writer.compress, records))
    handed = 0

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def decompressobj(self):
            outer, machine = self, self.inner.decompressobj()

            class Machine:
                eof = property(lambda _: machine.eof)
                unused_data = property(lambda _: machine.unused_data)

                def decompress(self, data):
                    nonlocal handed
                    handed += len(data)
                    return machine.decompress(data)

            return Machine()

    real = zstandard.ZstdDecompressor
    monkeypatch.setattr(warc.zstandard, "ZstdDecompressor", lambda **kw: Counting(real(**kw)))
    found = list(warc.read_archive(content))
    assert [f["X-Page-ID"] for f, _ in found] == [str(i) for i in range(2000)] and handed <= 2.5 * len(content)


def test_headers_are_whole_and_ids_unique(spark):
    folder = warc.scratch(spark, "headers")
    warc.write_archives(pages(spark), folder, date="2024-05-06T07:08:09Z")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect()
    heads = [f for x in files for f, _ in warc.read_archive(bytes(x["content"]))]
    assert len({h["WARC-Record-ID"] for h in heads}) == len(heads) == 11 and {h["WARC-Date"] for h in heads} == {"2024-05-06T07:08:09Z"}
    assert all({"WARC-Profile", "WARC-Refers-To-Date"} <= set(h) for h in heads if h["WARC-Type"] == "revisit")


def test_whole_prediction_against_dictionaries(spark):
    """Profiles, ranks, distances and the choice, reckoned anew for every row."""
    import re
    from collections import Counter

    def own_ranks(texts):
        counts = Counter()
        for word in (w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower())):
            padded = f" {word} "
            counts.update(padded[i : i + n] for n in range(1, 6) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
        return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:300]

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").unionByName(labelled(spark).drop("score").where("doc_id >= 900 OR doc_id IS NULL"))
    rows, profiles = docs.collect(), {}
    for r in rows:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        if not held and r["lang"] and r["text"] and re.search(r"[^\W\d_]", r["text"]):
            profiles.setdefault(r["lang"], []).append(r["text"])
    ranks = {lang: {g: i for i, g in enumerate(own_ranks(texts))} for lang, texts in profiles.items()}
    want = []
    for r in rows:
        own = own_ranks([r["text"] or ""])
        far = {lang: sum(abs(known[g] - i) if g in known else 300 for i, g in enumerate(own)) for lang, known in sorted(ranks.items())}
        best = min(far, key=far.get) if own else "und"
        want.append((r["doc_id"], best, round(1 - far[best] / (300 * len(own)), 9) if own else 0.0))
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.identify(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(set(x[2] for x in want)) > 20
