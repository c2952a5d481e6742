"""Files by name, binary files, crawls."""

import json

import pytest

from eventloom.operators import select
from eventloom.sources import feeds, readers

SCHEMA = "id long"


@pytest.fixture
def folder(tmp_path):
    for day, i in (("2024-01-01", 1), ("2024-01-03", 3), ("20240102", 2)):
        (tmp_path / f"reports_{day}.jsonl").write_text(json.dumps({"id": i}) + "\n{broken\n")
    (tmp_path / "reports_9999.jsonl.crc").write_text("")
    return tmp_path


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_newest_file(spark, folder):
    assert ids(readers.newest_file(spark, f"{folder}/*.jsonl", SCHEMA)) == [2]
    assert ids(readers.newest_file(spark, f"{folder}/none*.jsonl", SCHEMA)) == []


def test_dated_files(spark, folder):
    assert ids(readers.dated_files(spark, f"{folder}/*.jsonl", SCHEMA, "2024-01-02", "2024-01-03")) == [2, 3]
    assert ids(readers.dated_files(spark, f"{folder}/*.jsonl", SCHEMA, "2025-01-01", "2025-01-03")) == []


def test_keyed_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "old"}\n{"id": 2, "v": "two"}\n{"v": "no key"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 1, "v": "new"}\n{"id": 1, "v": "newest"}\n')
    got = readers.keyed_json_lines(spark, f"{tmp_path}/*.jsonl", "id long, v string", "id").collect()
    assert {(r["id"], r["v"]) for r in got} == {(1, "newest"), (2, "two")}


def test_gazetteer(spark, tmp_path):
    from eventloom.sources import schemas

    names = [f.split()[0] for f in schemas.GAZETTEER.split(",")]
    rows = [{"name": "Springfield", "state": s, "country": "US", "alternates": "Old Town"} for s in ("IL", "MA")] + [{"name": "Paris", "state": "11", "country": "FR"}]
    (tmp_path / "g.txt").write_text("".join("\t".join(r.get(n, "") for n in names) + "\n" for r in rows))
    got = {r["city"]: r["states"] for r in readers.city_states(spark, str(tmp_path / "g.txt")).collect()}
    assert got["springfield"] == ["IL", "MA"] == got["old town"] and "paris" not in got


def test_binary_texts(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"page one")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r["path"].rpartition("/")[2]: r["text"] for r in feeds.binary_texts(spark, str(tmp_path), lambda b: b.decode()).collect()}
    assert got == {"a.pdf": "page one", "b.pdf": None}


def test_crawl_stops():
    site = {1: "a b", 2: "c d", 3: "e", 4: "e", 5: "f"}
    go = lambda stop, most=50: feeds.crawl("x", site.get, lambda _, n: n, str.split, stop, most)
    assert go(set()) == ["a b", "c d", "e"]  # page 4 has nothing new
    assert go({"d"}) == ["a b", "c d"]
    assert go(set(), 1) == ["a b"]


def test_sort_option(spark):
    with pytest.raises(ValueError, match="newest"):
        select.stories_sorted(spark.range(1), "other", "id", "id", "id")
