"""Long files read by many tasks."""

import csv
import hashlib
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tradeloom.sources import manifest, readers, splits, versions


@pytest.fixture
def small_splits(spark):
    """Byte ranges of 2000 bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def odd_text(rng):
    return "".join(rng.choice(["a", "{", "}", "[", "]", '"', "\\", ",", ":", "é", "\n", " ", '[{"x":[', '":[{']) for _ in range(rng.randint(0, 12)))


def test_json_documents_are_cut_into_their_objects(spark, tmp_path, small_splits):
    rng = random.Random(1)
    want = []
    for f in range(4):
        order = lambda i: {"so_number": str(i), "address": odd_text(rng), "lines": [{"color": odd_text(rng)} for _ in range(rng.randint(0, 3))]}
        doc = {
            "meta}": {"a": odd_text(rng), "b": {"c": {"d": [1, {"e": odd_text(rng)}]}}}, "ready_orders": [order(i) for i in range(150)],
            "empty": [], "numbers": [1, 2], "note": odd_text(rng) + '":[{', "logs": [{"message_id": odd_text(rng)} for _ in range(80)],
            "deeper": [[{"no": 1}], [{"no": 2}]], "last": odd_text(rng),
        }
        (tmp_path / f"{f}.json").write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=f % 2 == 0), encoding="utf-8")
        objects = [(k, o) for k in ("ready_orders", "logs") for o in doc[k]]
        want += [(f"{f}.json", n, k, json.dumps(o)) for n, (k, o) in enumerate(objects)]
    found = splits.json_elements(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r["file"]), r["element"], r["field"], json.dumps(json.loads(r["text"]))) for r in found) == want
    orders = readers.scan_orders_json(spark, str(tmp_path))
    assert orders.count() == 600 and orders.where("size(lines) > 0").select("lines.color").first() is not None
    want_logs = sorted(json.loads(t)["message_id"] for _, _, k, t in want if k == "logs")
    assert sorted(r["message_id"] for r in readers.scan_logs_json(spark, str(tmp_path)).collect()) == want_logs


def test_one_document_is_read_by_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text(json.dumps({"ready_orders": [{"so_number": str(i), "address": "x" * 50} for i in range(400)]}))
    assert splits.pieces(spark, str(tmp_path), "}").select("start").distinct().count() > 10
    rows = readers.scan_orders_json(spark, str(tmp_path)).select("so_number").collect()
    assert sorted(int(r["so_number"]) for r in rows) == list(range(400))


def test_documents_in_lines_and_documents_without_objects(spark, tmp_path):
    text = '{"ready_orders": [{"so_number": "1"}, {"so_number": "2"}]}\n{"ready_orders": []}\n\n{}\n{"ready_orders":[{"so_number":"3"}],"logs":[{"message_id":"m"}]}'
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text("")
    assert sorted(r["so_number"] for r in readers.scan_orders_json(spark, str(tmp_path)).collect()) == ["1", "2", "3"]
    assert [r["message_id"] for r in readers.scan_logs_json(spark, str(tmp_path)).collect()] == ["m"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_with_line_breaks(spark, tmp_path, small_splits, end):
    rng = random.Random(2)
    rows = [[odd_text(rng) + str(i)] + [odd_text(rng) for _ in range(3)] for i in range(900)]
    for f in range(2):
        with open(tmp_path / f"{f}.csv", "w", newline="", encoding="utf-8-sig" if f else "utf-8") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerows([["code", "b", "c", "d"], *rows])
    assert splits.pieces(spark, str(tmp_path), "\n").select("file", "start").distinct().count() > 10
    found = splits.csv_records(spark, str(tmp_path)).where("file like '%0.csv'").orderBy("record").collect()
    assert [r["record"] for r in found] == list(range(901))
    assert [next(csv.reader(io.StringIO(r["text"], newline=""))) for r in found[1:]] == rows
    got = readers.scan_typed_csv(spark, str(tmp_path), "code string, b string, c string, d string").collect()
    want = sorted([[x or None for x in r] for r in rows] * 2, key=repr)
    assert sorted([list(r) for r in got], key=repr) == want


def test_csv_types_codes_and_empty_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿group_code,group_name,description,created_at\n007,"a ""b""\n\nc",,2026-01-02 03:04:05\n\n010,x,"",\n', encoding="utf-8")
    got = readers.scan_typed_csv(spark, str(tmp_path / "a.csv"), readers.CSV_SCHEMAS["product_group"]).orderBy("group_code").collect()
    assert [(r[0], r[1], r[2], str(r[3])) for r in got] == [("007", 'a "b"\n\nc', None, "2026-01-02 03:04:05"), ("010", "x", None, "None")]


@pytest.mark.parametrize("opened", [manifest.OPENED, ()])
def test_manifest_of_files_of_any_size(spark, tmp_path, small_splits, opened):
    """Both ways: files that tasks open, and files that only Spark reads."""
    rng = random.Random(3)
    contents = {
        "a b.bin": b"x", "c%20d.bin": rng.randbytes(1000), "empty.csv": b"", "f g.bin": rng.randbytes(60_000), "line.txt": b"\n", "two.txt": b"\n\n",
        "mark.csv": b"\xef\xbb\xbfcode\r\n1\r\n", "mark only.csv": b"\xef\xbb\xbf", "open.csv": b"a\nb", "closed.csv": b"a\nb\n", "latin.txt": "h\u00e9\n".encode("latin1"),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "folder").mkdir()
    (tmp_path / ".hidden").write_bytes(b"x")
    got = manifest.input_manifest(spark, str(tmp_path), chunk=7, opened=opened).collect()
    assert len(got) == len(contents)
    assert {r["file_name"]: (r["n_bytes"], r["sha256"]) for r in got} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
    assert manifest.input_manifest(spark, str(tmp_path), "*.nothing", opened=opened).collect() == []


def test_manifest_streams_what_no_row_can_hold(spark, tmp_path):
    with open(tmp_path / "sparse.bin", "wb") as file:
        file.truncate((2 << 30) + 5)
    digest = hashlib.sha256()
    for _ in range(2048):
        digest.update(bytes(1 << 20))
    digest.update(bytes(5))
    row = manifest.input_manifest(spark, str(tmp_path)).first()
    assert tuple(row) == ("sparse.bin", (2 << 30) + 5, digest.hexdigest())


MONTHS = "id int, amount double, y int, m int"


def month_rows(spark, *rows):
    return spark.createDataFrame(list(rows), MONTHS)


def stored(spark, path, version=None):
    return sorted(tuple(r) for r in versions.read(spark, path, version).collect())


def test_a_month_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    old = [(1, 1.0, 2001, 1), (2, 2.0, 2001, 2), (3, 3.0, 2001, 3)]
    new = [(4, 4.0, 2001, 2), (5, 5.0, 2001, 2)]
    assert versions.commit(month_rows(spark, *old), path, ["y", "m"]) == 1
    publish = versions._Store.publish
    monkeypatch.setattr(versions._Store, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # killed after the rows are written
        versions.commit(month_rows(spark, *new), path, ["y", "m"])
    assert stored(spark, path) == old
    monkeypatch.setattr(versions._Store, "publish", publish)
    for n in (2, 3):  # a rerun gives the same table
        assert versions.commit(month_rows(spark, *new), path, ["y", "m"]) == n
        assert stored(spark, path) == [old[0], old[2], *new]
    assert stored(spark, path, 1) == old
    assert versions.commit(month_rows(spark), path, ["y", "m"], replaced=[(2001, 1)]) == 4  # a month without new rows
    assert stored(spark, path) == [old[2], *new]
    assert versions.commit(month_rows(spark, old[0], old[0]), path, ["y", "m"], replaced=[]) == 5
    assert versions.commit(month_rows(spark, old[0]), path, ["y", "m"], replaced=[]) == 6
    assert stored(spark, path) == [old[0]] * 3 + [old[2], *new]
    assert versions.vacuum(spark, path) > 0 and versions.versions(spark, path) == [6]
    assert stored(spark, path) == [old[0]] * 3 + [old[2], *new]
    with pytest.raises(ValueError):
        versions.commit(month_rows(spark, old[0]).withColumn("more", F.lit(1)), path, ["y", "m"])
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    versions.commit(month_rows(spark, (1, 1.0, 2001, 1)), path, ["y", "m"])
    publish, first = versions._Store.publish, []

    def late(self, name, text):
        if not first:  # another writer takes the number between the look and the commit
            first.append(name)
            versions.commit(month_rows(spark, (2, 2.0, 2001, 2)), path, ["y", "m"], replaced=[])
        return publish(self, name, text)

    monkeypatch.setattr(versions._Store, "publish", late)
    assert versions.commit(month_rows(spark, (3, 3.0, 2001, 1)), path, ["y", "m"]) == 3
    assert stored(spark, path) == [(2, 2.0, 2001, 2), (3, 3.0, 2001, 1)]
