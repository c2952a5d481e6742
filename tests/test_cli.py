"""The commands, end to end over small files."""

import json

import pytest
from pyspark.sql import functions as F

from eventloom import cli


def lines(spark, path):
    return spark.read.json(str(path)).collect()


@pytest.fixture
def triplets(tmp_path):
    f = tmp_path / "t.jsonl"
    rows = [{"story_id": f"s{i}", "published_at": f"2024-01-{i:02d}T00:00:00", "latitude": 30.0 + i, "longitude": -90.0, "who": "A", "what": "b"} for i in (1, 29, 30)]
    f.write_text("\n".join(map(json.dumps, rows)))
    return f


def test_export(spark, tmp_path, triplets):
    cli.main(["export", "--triplets", str(triplets), "--as-of", "2024-01-31 00:00:00", "--out", str(tmp_path / "out")], spark)
    assert {n: len(lines(spark, tmp_path / "out" / n)) for n in cli.WINDOWS} == {"3d": 2, "7d": 2, "30d": 3, "90d": 3, "all": 3}


def test_service(spark, triplets):
    rows = cli.readers.triplets(spark, str(triplets)).withColumn("published_at", F.to_timestamp("published_at"))
    ask = lambda target: cli.answer(rows, target, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    assert ask("/health") == (200, {"status": "ok"})
    assert [r["story_id"] for r in ask("/api/triplets?since_hours=72")[1]] == ["s30", "s29"]
    assert [r["story_id"] for r in ask("/api/triplets?since_hours=0&bbox=-100,0,-80,35")[1]] == ["s1"]
    assert ask("/api/triplets?bbox=1,2")[0] == 400 and ask("/api/triplets?since_hours=9999")[0] == 400 and ask("/other")[0] == 404


def test_extract_and_ingest(spark, tmp_path):
    reports = tmp_path / "r.jsonl"
    row = {"source": "s", "source_id": "1", "title": "Protest in town", "url": "https://a.org/2024/01/02/x", "summary": "protest", "content": "John Smith blocked the road in Boston, and left."}
    reports.write_text(json.dumps(row))
    cli.main(["extract", "--reports", str(reports), "--out", str(tmp_path / "e")], spark)
    assert [(r["who"], r["what"]) for r in lines(spark, tmp_path / "e")] == [("John Smith", "blocked the road in Boston")]
    (tmp_path / "k.txt").write_text("# words\nprotest\n")
    (tmp_path / "f.csv").write_text("name,address,city,state,latitude,longitude\nA,1 St,X,TX,31.5,-100\n")
    cli.main(["ingest", "--reports", str(reports), "--keywords", str(tmp_path / "k.txt"), "--facilities", str(tmp_path / "f.csv"), "--as-of", "2024-02-01 00:00:00", "--out", str(tmp_path / "i")], spark)
    assert [r["source_id"] for r in lines(spark, tmp_path / "i/reports")] == ["1"] == [r["source_id"] for r in lines(spark, tmp_path / "i/fresh")]


def test_report(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a": "x", "b": null}\n{"a": "y", "b": "unknown"}\n')
    with pytest.raises(SystemExit, match="b"):
        cli.main(["report", "--table", str(tmp_path / "t.json"), "--out", str(tmp_path / "o"), "--required", "a", "b"], spark)
    assert {r["field"]: r["verdict"] for r in lines(spark, tmp_path / "o")} == {"a": "ok", "b": "fail"}
