"""Commands over tables in files: ingest, extract, incidents, report, export, serve.

    python -m eventloom.cli export --triplets triplets.jsonl --as-of "2024-01-31 00:00:00" --out slices
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import select
from .plans import extract, jobs
from .sources import readers, schemas, sinks

WINDOWS = {"3d": 3, "7d": 7, "30d": 30, "90d": 90, "all": None}
CACHE, SEEN = "query string, latitude double, longitude double, fetched_at timestamp", "title_norm string"


def _table(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    if not path:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path) if path.endswith(".parquet") else readers.json_lines(spark, path, schema)


def _moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    blocked = readers.blacklist(spark, a.blacklist) if a.blacklist else spark.createDataFrame([], "host string, prefix string")
    words = [r["line"] for r in readers.config_lines(spark, a.keywords).collect()]  # a configuration file
    found = jobs.ingest(
        readers.json_lines(spark, a.reports, schemas.REPORT), words, [], readers.facilities(spark, a.facilities), _table(spark, a.cache, CACHE), _table(spark, a.seen, SEEN), blocked, _moment(a.as_of)
    )
    sinks.json_lines(found.reports, f"{a.out}/reports")
    sinks.json_lines(found.fresh, f"{a.out}/fresh")
    sinks.json_lines(found.metrics, f"{a.out}/metrics")


def extracted(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.json_lines(extract.triplets(readers.json_lines(spark, a.reports, a.schema), a.key, a.text, per_story=a.per_story), a.out)


def incidents(spark: SparkSession, a: argparse.Namespace) -> None:
    done = jobs.daily_incidents(spark.read.json(a.existing), [spark.read.json(p) for p in a.incoming], a.access_date)
    for name in ("records", "changes", "index"):
        sinks.json_lines(getattr(done, name), f"{a.out}/{name}")


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    gate = select.quality_gate(spark.read.json(a.table), a.required)
    sinks.json_lines(gate, a.out)
    if bad := [r["field"] for r in gate.where("verdict = 'fail'").collect()]:
        raise SystemExit(f"too many unknown: {', '.join(sorted(bad))}")


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.triplets(spark, a.triplets).withColumn("__el_ts", F.to_timestamp("published_at"))
    for name, table in select.slices(rows, "__el_ts", _moment(a.as_of), WINDOWS).items():
        sinks.json_lines(table.drop("__el_ts"), f"{a.out}/{name}")


def answer(rows: DataFrame, target: str, as_of: Column) -> tuple[int, object]:
    """Status and body of a request to the service: /health, or /api/triplets with since_hours and bbox."""
    url = urlsplit(target)
    if url.path == "/health":
        return 200, {"status": "ok"}
    if url.path != "/api/triplets":
        return 404, {"detail": "not found"}
    asked = {k: v[-1] for k, v in parse_qs(url.query).items()}
    try:
        found = jobs.serve(rows, as_of, int(asked.get("since_hours", 24)), asked.get("bbox"))
    except ValueError as e:
        return 400, {"detail": str(e)}
    return 200, [json.loads(x) for x in found.toJSON().collect()]  # at most the service's cap


def serve(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.triplets(spark, a.triplets).withColumn("published_at", F.to_timestamp("published_at"))

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, body = answer(rows, self.path, _moment(a.as_of) if a.as_of else F.current_timestamp())
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    ThreadingHTTPServer((a.host, a.port), Handler).serve_forever()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="eventloom")
    commands = p.add_subparsers(required=True)

    def command(name: str, run, needed: str, optional: dict[str, object]) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for option in needed.split():
            c.add_argument(f"--{option}", required=True)
        for option, default in optional.items():
            c.add_argument(f"--{option}", default=default, type=type(default) if default is not None else str)
        return c

    command("ingest", ingest, "reports keywords facilities as-of out", {"blacklist": None, "cache": None, "seen": None})
    command("extract", extracted, "reports out", {"schema": schemas.REPORT, "key": "url", "text": "content", "per-story": 2})
    command("incidents", incidents, "existing access-date out", {}).add_argument("--incoming", nargs="+", required=True)
    command("report", report, "table out", {}).add_argument("--required", nargs="+", required=True)
    command("export", export, "triplets as-of out", {})
    command("serve", serve, "triplets", {"as-of": None, "host": "127.0.0.1", "port": 8000})
    return p


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("eventloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
