"""Paged and batched JSON sources, and streams that resume."""

import http.server
import json
import threading
import time
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import paged
from shelfmark.streaming import incremental


def envelope(rows, pages=1):
    return json.dumps({"success": True, "data": {"rows": rows, "totalPages": pages}})


def test_pages_keep_scan_order(spark, tmp_path):
    paged.register(spark)
    (tmp_path / "page-1.json").write_text(envelope([{"unified": {"id": 1}}, {"unified": {"id": 2}}], pages=2))
    (tmp_path / "page-2.json").write_text(envelope([{"unified": {"id": 3}}], pages=2))
    rows = spark.read.format("paged_json").option("path", str(tmp_path)).load().orderBy("page", "pos").collect()
    assert [(r.page, r.pos, json.loads(r.body)["unified"]["id"]) for r in rows] == [(1, 0, 1), (1, 1, 2), (2, 0, 3)]


def test_failed_answer_is_not_retried(tmp_path):
    (tmp_path / "page-1.json").write_text('{"success": false, "error": "no"}')
    with pytest.raises(paged.AnswerFailed):
        paged.fetch(str(tmp_path / "page-1.json"), 3, 60)


def test_broken_page_is_retried_then_raised(tmp_path):
    (tmp_path / "p.json").write_text("{")
    with pytest.raises(ValueError):
        paged.fetch(str(tmp_path / "p.json"), 2, 0)


def test_failed_batches_are_rows(spark, tmp_path):
    paged.register(spark)
    (tmp_path / "a.json").write_text(envelope([{"unified": {"id": 5}}]))
    (tmp_path / "b.json").write_text('{"success": false, "error": "busy"}')
    rows = spark.read.format("lookup_json").option("path", str(tmp_path)).load().orderBy("batch").collect()
    assert [(r.unified_id, r.error) for r in rows] == [(5, None), (None, "busy")]


class Catalogue(http.server.BaseHTTPRequestHandler):
    """Five records in pages of two; ids by list; id 13 breaks its batch; the first request of a page fails once."""

    broken: set = set()
    ROWS = [{"unified": {"id": i, "canonical_name": f"é{i}"}} for i in (11, 12, 13, 14, 15)]

    def do_GET(self):
        asked = parse_qs(urlparse(self.path).query)
        if "page" in asked:
            n, size = int(asked["page"][0]), int(asked["pageSize"][0])
            if n == 2 and "page 2" not in self.broken:
                self.broken.add("page 2")
                return self.answer("{", 200)
            rows = self.ROWS[(n - 1) * size : n * size]
            return self.answer(json.dumps({"success": True, "data": {"rows": rows, "page": n, "totalPages": -(-len(self.ROWS) // size)}}), 200)
        ids = [int(x) for x in asked["ids"][0].split(",")]
        if 13 in ids:
            return self.answer("", 503)
        self.answer(envelope([r for r in self.ROWS if r["unified"]["id"] in ids]), 200)

    def answer(self, text, status):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(text.encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def address():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Catalogue)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/api"
    server.shutdown()


def test_pages_of_a_server(spark, address):
    paged.register(spark)
    read = spark.read.format("paged_json").option("path", address).option("page_size", 2).option("pause", 0).option("rate", 0)
    rows = read.load().orderBy("page", "pos").collect()
    assert [(r.page, r.pos, json.loads(r.body)["unified"]["id"]) for r in rows] == [(1, 0, 11), (1, 1, 12), (2, 0, 13), (2, 1, 14), (3, 0, 15)]


def test_lookups_of_a_server(spark, address):
    ids = spark.createDataFrame([(15,), (11,), (None,), (12,), (11,), (99,), (13,)], "id bigint")
    got = paged.lookup(ids, address, batch=2, retries=1, pause=0, rate=0).collect()
    assert sorted((r.batch, r.unified_id or 0, r.error) for r in got) == [(0, 11, None), (0, 12, None), (1, 0, "status 503")]
    assert json.loads(next(r.body for r in got if r.unified_id == 11))["unified"]["canonical_name"] == "é11"
    with pytest.raises(ValueError):
        paged.lookup(ids, "/some/folder")


def test_pacing():
    pacer, began = paged.Pacer(50), time.monotonic()
    for _ in range(6):
        pacer.wait()
    assert time.monotonic() - began >= 0.09


def test_runs_resume_and_are_kept(spark, tmp_path):
    from shelfmark.operators import runs

    base, made = str(tmp_path / "runs"), []

    def part(name, fail=False):
        def make():
            made.append(name)
            if fail:
                raise RuntimeError("broken off")
            return spark.createDataFrame([(name,)], "n string")

        return make

    with pytest.raises(RuntimeError):
        runs.save(spark, base, "r1", {"a": part("a"), "b": part("b", fail=True)})
    out = runs.save(spark, base, "r1", {"a": part("a"), "b": part("b")})
    assert made == ["a", "b", "b"] and out["b"].first().n == "b" and runs.load(spark, base, "r1", "a").first().n == "a"
    runs.save(spark, base, "r2", {"a": part("a2")})
    assert runs.names(spark, base) == ["r1", "r2"] and runs.keep_only(spark, base, "r2") == ["r1"] and runs.names(spark, base) == ["r2"]
    assert runs.keep_only(spark, base) == ["r2"] and runs.names(spark, str(tmp_path / "none")) == []


def test_cached_tables_expire(spark, tmp_path):
    from shelfmark.operators import runs

    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    get = lambda seconds: runs.cached(spark, str(tmp_path), "k", make, seconds).first().n
    assert [get(60), get(60), get(-5), get(60)] == [1, 1, 2, 2]


def test_stream_upsert_resumes(spark, tmp_path):
    schema = "k bigint, n bigint, v string"
    write = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    write([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], "x=1")
    seen = []

    def go():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        sink = incremental.upsert_sink(spark, str(tmp_path / "out"), "k", "n")
        incremental.run_to_end(stream, lambda b, i: (sink(b, i), seen.append(i)), str(tmp_path / "log"))

    go()
    write([(2, 5, "d"), (3, 1, "e"), (None, 9, "z")], "x=2")
    go()
    rows = spark.read.parquet(str(tmp_path / "out" / f"v{max(seen)}")).collect()
    assert {(r.k, r.v) for r in rows} == {(1, "c"), (2, "d"), (3, "e")}
    assert seen == [0, 1]


def test_stream_upsert_keeps_the_greatest_of_all_batches(spark, tmp_path):
    schema = "k bigint, n bigint, v string"
    sink = incremental.upsert_sink(spark, str(tmp_path), "k", "n")
    batches = [[(1, 5, "a"), (2, 1, "b")], [(1, 3, "older"), (2, 2, "c"), (3, 1, "d")], [(2, 1, "older"), (None, 9, "z")]]
    for i, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), i)
        sink(spark.createDataFrame(rows, schema), i)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "v2")).collect()} == {(1, 5, "a"), (2, 2, "c"), (3, 1, "d")}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v1", "v2"]


def test_first_seen_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:01")], "k bigint, t string")
    rows.select("k", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k bigint, t timestamp").parquet(str(tmp_path / "in"))
    first = incremental.first_seen(stream, ["k"], "t", "1 hour")
    q = first.writeStream.format("memory").queryName("seen_rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.sql("select k from seen_rows").collect()) == [1, 2]
