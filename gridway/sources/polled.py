"""Feeds that are polled for changes, as a stream of import messages.

spark.readStream.format("polled_feeds"): option feeds is a JSON list of {source_id, url, full}; timeout and tries are as for
paged_features. An offset holds each feed's Last-Modified, which is also the run's number, so that a restart from a checkpoint
knows what was read. Feeds whose answer has not changed (304, no content, or the same stamp) give no rows and are thereby left alone
by an import; a feed that cannot be reached is left for the next poll, with a warning. A changed feed gives a row for each feature,
numbered by ord, or one row without ord if it has none. A feed without Last-Modified counts as changed in each poll.

What is read is the feed as it stands then: if it has changed again since the poll, the next poll reads it once more.
"""

from __future__ import annotations

import calendar
import email.utils
import json
import time
import urllib.error
import urllib.request
import warnings
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Feed(InputPartition):
    def __init__(self, source_id: int, url: str, full: bool, run: int):
        self.source_id, self.url, self.full, self.run = source_id, url, full, run


def stamp(headers) -> int | None:
    """Last-Modified in seconds."""
    said = email.utils.parsedate(headers.get("Last-Modified") or "")
    return calendar.timegm(said) if said else None


class Poller(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.feeds = {str(f["source_id"]): f for f in json.loads(options["feeds"])}
        self.tries, self.timeout = int(options.get("tries", 3)), float(options.get("timeout", 30))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Asks each feed for its stamp; bodies are left to the tasks."""
        for name, feed in self.feeds.items():
            request = urllib.request.Request(feed["url"])
            if name in self.seen:
                request.add_header("If-Modified-Since", email.utils.formatdate(self.seen[name], usegmt=True))
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    if answer.status != 204:
                        self.seen[name] = stamp(answer.headers) or int(time.time())
            except urllib.error.HTTPError as e:
                if e.code != 304:
                    warnings.warn(f"source {name}: {e}", stacklevel=1)
            except OSError as e:
                warnings.warn(f"source {name}: {e}", stacklevel=1)
        return {name: self.seen[name] for name in sorted(self.seen)}

    def partitions(self, start: dict, end: dict) -> list[Feed]:
        changed = [name for name, at in end.items() if start.get(name) != at and name in self.feeds]
        return [Feed(int(name), self.feeds[name]["url"], bool(self.feeds[name].get("full", True)), end[name]) for name in changed]

    def read(self, partition: Feed) -> Iterator[tuple]:
        last = None
        for k in range(self.tries):
            time.sleep(k)
            try:
                with urllib.request.urlopen(partition.url, timeout=self.timeout) as answer:
                    features = json.load(answer)["features"]
                break
            except (OSError, ValueError, KeyError, TypeError) as e:  # a service may answer with a page about maintenance
                last = e
        else:
            raise RuntimeError(f"source {partition.source_id} could not be read") from last  # what is missing would be taken for gone
        head = (partition.source_id, partition.run, partition.full)
        if not features:
            yield (*head, None, None, None)
        for n, feature in enumerate(features):
            yield (*head, n, json.dumps(feature.get("properties", {})), json.dumps(feature.get("geometry")))


class PolledFeeds(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "polled_feeds"

    def schema(self) -> str:
        return "source_id bigint, run bigint, full boolean, ord bigint, properties string, geometry string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Poller(self.options)
