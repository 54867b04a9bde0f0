"""Gzip lines as a source, and the import in micro-batches behind a kill and a restart."""

import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from larkspur.plans import importing
from larkspur.sources import gzip_lines
from larkspur.streaming import imports


def packed(path, text, members=1):
    size = -(-len(text) // members)
    path.write_bytes(b"".join(gzip.compress(text[i : i + size].encode()) for i in range(0, max(1, len(text)), max(1, size))))


def test_lines_have_true_numbers_and_bytes(spark, tmp_path):
    texts = {"a.gz": "one\n\nthree\r\nfour", "b.gz": "x\n" * 5000, "c.gz": "", "d.gz": "é" * 3_000_000 + "\nlast\n"}
    for i, (name, text) in enumerate(texts.items()):
        packed(tmp_path / name, text, members=1 + i)
    got = gzip_lines.read_lines(spark, f"{tmp_path}/*.gz")
    rows = [(r["path"].rsplit("/")[-1], r["line_no"], r["value"]) for r in got.where("path LIKE '%a.gz'").orderBy("line_no").collect()]
    assert rows == [("a.gz", 1, "one"), ("a.gz", 2, ""), ("a.gz", 3, "three"), ("a.gz", 4, "four")]
    done = {r["path"].rsplit("/")[-1]: r for r in gzip_lines.progress(got).collect()}
    assert {n: r["lines"] for n, r in done.items()} == {"a.gz": 4, "b.gz": 5000, "d.gz": 2}
    assert all(r["share"] == 1 and r["file_bytes"] == (tmp_path / n).stat().st_size for n, r in done.items())
    sums = {r["path"].rsplit("/")[-1]: (r["length"], r["sha256"]) for r in gzip_lines.checksums(spark, str(tmp_path)).collect()}
    assert sums == {n: (len(b := (tmp_path / n).read_bytes()), hashlib.sha256(b).hexdigest()) for n in texts}


def test_small_pieces_and_broken_files(tmp_path):
    text = "\n".join(f"line {i} " + "z" * (i % 50) for i in range(500))
    packed(tmp_path / "x.gz", text, members=7)
    (file,) = gzip_lines.listed(str(tmp_path))
    got = list(gzip_lines.lines_of(file, piece=64))
    assert [t.decode() for _, t, _ in got] == text.split("\n") and [n for n, _, _ in got] == list(range(1, 501))
    read = [b for _, _, b in got]
    assert read == sorted(read) and read[-1] == file.size and read[0] < file.size
    whole = (tmp_path / "x.gz").read_bytes()
    (tmp_path / "x.gz").write_bytes(whole[:-20])
    with pytest.raises(EOFError):
        list(gzip_lines.lines_of(gzip_lines.listed(str(tmp_path))[0]))
    with pytest.raises(FileNotFoundError):
        gzip_lines.listed(str(tmp_path / "none"))


def test_a_stream_reads_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for round_ in range(2):
        packed(tmp_path / "in" / f"{round_}.gz", f"r{round_}\nend")
        lines = gzip_lines.stream_lines(spark, str(tmp_path / "in")).select("line_no", "value")
        lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["end", "end", "r0", "r1"]


BASE = {"category": ["Thai restaurant"], "latitude": 40.7, "longitude": -73.95, "avg_rating": 4.5}


def shards(folder):
    """Five files of places; keys repeat within and across them."""
    folder.mkdir()
    for k in range(5):
        rows = [{"gmap_id": f"g{(k * 3 + i) % 8}", "name": f"P {k} {i}"} | BASE for i in range(4)]
        rows += [rows[0] | {"name": f"P {k} again"}, {"gmap_id": "lib", "name": "L"} | BASE | {"category": ["Library"]}, {"gmap_id": f"n{k}"} | BASE]
        packed(folder / f"{k}.gz", "\n".join([*map(json.dumps, rows), "", "{bad"]))
        os.utime(folder / f"{k}.gz", (1_700_000_000 + k, 1_700_000_000 + k))  # batches take files by their time of change


def test_killed_and_restarted(spark, tmp_path, monkeypatch):
    shards(tmp_path / "in")
    out, calls, real = str(tmp_path / "out"), [], imports.finish

    def dies(session, folder, number, *rest):
        calls.append(number)
        if number == 1 and calls.count(1) == 1:
            raise RuntimeError("killed after the rows, before the audit")
        real(session, folder, number, *rest)

    monkeypatch.setattr(imports, "finish", dies)
    run = lambda: imports.import_batches(spark, str(tmp_path / "in"), out, imports.judged_places, files_per_batch=2)
    with pytest.raises(Exception, match="killed"):
        run()
    assert {r["status"] for r in imports.batches(spark, out).collect()} == {"success", "running"}
    run()
    run()  # nothing new
    assert calls == [0, 1, 1, 2]
    audit = {r["batch_id"]: r for r in imports.batches(spark, out).collect()}
    assert {n: (r["status"], r["read"], r["accepted"], r["filtered"], r["rejected"]) for n, r in audit.items()} == {0: ("success", 16, 10, 2, 4), 1: ("success", 16, 10, 2, 4), 2: ("success", 8, 5, 1, 2)}
    assert sum(r["read_bytes"] for r in audit.values()) == sum(p.stat().st_size for p in (tmp_path / "in").iterdir()) and all(r["finished_at"] >= r["started_at"] for r in audit.values())
    got = {r["gmap_id"]: r["name"] for r in imports.current(spark, out, "gmap_id").collect()}
    want = {}
    for k in range(5):
        want |= {f"g{(k * 3 + i) % 8}": f"P {k} {i}" for i in range(4)} | {f"g{k * 3 % 8}": f"P {k} again"}
    assert got == want
    bad = imports.rejected(spark, out)
    assert set(bad.columns) == {"batch_id", "path", "line_no", "outcome", "reason"} and bad.where("outcome = 'reject'").count() == 10
    assert {(r["line_no"], r["reason"]) for r in bad.collect()} == {(6, "not_food"), (7, "missing_name"), (9, "decode_error")}
    assert imports.rows(spark, out).where("outcome <> 'accept' AND name IS NOT NULL").count() == 0


def test_the_same_tables_as_the_import_in_one_piece(spark, tmp_path):
    shards(tmp_path / "in")
    imports.import_batches(spark, str(tmp_path / "in"), str(tmp_path / "out"), imports.judged_places)
    places, audit = importing.import_places(spark, f"{tmp_path}/in/*.gz")
    own = imports.current(spark, str(tmp_path / "out"), "gmap_id")
    same = ["gmap_id", "cuisine_tags", "borough", "source_avg"]
    assert sorted(map(str, own.select(same).collect())) == sorted(map(str, places.select(same).collect()))
    counts = imports.batches(spark, str(tmp_path / "out")).agg(F.sum("accepted"), F.sum("filtered"), F.sum("rejected")).first()
    by = {o: sum(r["n"] for r in audit.collect() if r["outcome"] == o) for o in ("accept", "filter", "reject")}
    assert tuple(counts) == (by["accept"], by["filter"], by["reject"])
