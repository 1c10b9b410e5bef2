"""Polled feeds against a local server, and findings published by version."""

import email.utils
import http.server
import json
import threading

import pytest
from gridway.operators import serving
from gridway.sources import polled, sinks
from pyspark.sql import functions as F


@pytest.fixture
def service():
    """Answers by path: (stamp, features), or a status alone; asked lists what was asked for."""
    state = {"answers": {}, "asked": []}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            said = state["answers"][self.path]
            since = email.utils.parsedate_to_datetime(self.headers["If-Modified-Since"]).timestamp() if self.headers["If-Modified-Since"] else None
            status = said if isinstance(said, int) else 304 if since is not None and said[0] <= since else 200
            state["asked"].append((self.path, status))
            self.send_response(status)
            if status == 200:
                self.send_header("Last-Modified", email.utils.formatdate(said[0], usegmt=True))
            self.end_headers()
            if status == 200:
                self.wfile.write(json.dumps({"features": [{"properties": {"name": n}, "geometry": None} for n in said[1]]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}"
    yield state
    server.shutdown()


def test_only_changed_feeds_are_read(spark, service, tmp_path):
    spark.dataSource.register(polled.PolledFeeds)
    feeds = json.dumps([{"source_id": k, "url": f"{service['url']}/{k}"} for k in (1, 2)])
    batches = []

    def poll():
        """A start of the stream from its checkpoint, as after a restart."""
        batches.clear()
        source = spark.readStream.format("polled_feeds").options(feeds=feeds, tries="1").load()
        keep = lambda df, _: batches.extend((r.source_id, r.run, r.ord, r.properties and json.loads(r.properties)["name"]) for r in df.collect())
        source.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(batches, key=str)

    service["answers"] = {"/1": (1000, ["a", "b"]), "/2": (2000, ["c"])}
    assert poll() == [(1, 1000, 0, "a"), (1, 1000, 1, "b"), (2, 2000, 0, "c")]
    assert poll() == []
    service["answers"]["/2"] = (3000, [])
    assert poll() == [(2, 3000, None, None)]
    service["answers"] = {"/1": (4000, ["b"]), "/2": 204}
    assert poll() == [(1, 4000, 0, "b")]


def test_a_poll_asks_for_changes_only(service):
    service["answers"] = {"/1": (1000, ["a"]), "/2": 500}
    poller = polled.Poller({"feeds": json.dumps([{"source_id": k, "url": f"{service['url']}/{k}"} for k in (1, 2)]), "tries": "1"})
    with pytest.warns(UserWarning, match="source 2"):
        first = poller.latestOffset()
        assert poller.latestOffset() == first == {"1": 1000}
    assert [status for path, status in service["asked"] if path == "/1"] == [200, 304]
    assert poller.partitions(first, first) == []
    service["answers"]["/1"] = 500
    with pytest.raises(RuntimeError, match="source 1"):
        list(poller.read(poller.partitions({}, first)[0]))


def test_findings_are_published_whole_or_not_at_all(spark, tmp_path):
    folder, schema = str(tmp_path), "project_id bigint, titel string"
    projects = lambda *ids: spark.createDataFrame([(i,) for i in ids], "project_id bigint")
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    now = lambda: sorted(tuple(r) for r in sinks.published(spark, folder, schema).collect())
    assert now() == []
    sinks.publish(rows((1, "a"), (1, "b"), (2, "c")), projects(1, 2), folder, 1)
    assert now() == [(1, "a"), (1, "b"), (2, "c")]
    failing = rows((1, "x"), (2, "y")).withColumn("titel", F.when(F.col("project_id") == 2, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("titel")))
    for bad in (failing, rows((3, "z")), rows((None, "z"))):
        with pytest.raises(Exception, match="lost|another project"):
            sinks.publish(bad, projects(1, 2), folder, 2)
        assert now() == [(1, "a"), (1, "b"), (2, "c")]
    sinks.publish(rows((2, "d")), projects(2), folder, 2)
    sinks.publish(rows((2, "replayed")), projects(2), folder, 2)
    assert now() == [(1, "a"), (1, "b"), (2, "d")]
    sinks.publish(rows(), projects(1), folder, 3)
    assert now() == [(2, "d")]


def test_a_page_beyond_the_limit_is_refused(spark):
    with pytest.raises(ValueError, match="5001"):
        serving.page(spark.range(3), [F.col("id")], 5001, 0)
    assert [tuple(r) for r in serving.page(spark.range(3), [F.col("id")], 2, 1).collect()] == [(2, 3)]
