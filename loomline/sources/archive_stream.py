"""A chat workspace as a stream: offsets are a cursor per channel, the time of the newest message read.

A batch is what lies between two such offsets, so a batch that is run again after a failure asks for the
same messages, and a restart goes on where the last committed batch ended. A channel's range is cut into
pieces of time, each a partition, so that a long history is many tasks.

A call that fails after its retries fails the batch, and no cursor moves: nothing is lost. Channels that
cannot be read are named in ``skip``. A channel that leaves the list and comes back is read from its
beginning; ingest by key leaves out what is there already. Times are the server's, and grow within a channel;
replies to a message that was read before are read by ``archive.scan``.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import archive
from .rest import call_with_retries, paged

#: Seconds of a channel's history that one task reads, and channels asked for their newest message at a time.
PIECE_SECONDS, PROBES = 30 * 86400, 8


class ArchiveStream(DataSource):
    """options: client (``module:function``), params (JSON, added to each call), skip (JSON list of channels),
    since (seconds, where a channel has no time of creation), piece_seconds."""

    @classmethod
    def name(cls) -> str:
        return "loomline_archive"

    def schema(self) -> str:
        return "channel string, item string"

    def streamReader(self, schema) -> ArchiveStreamReader:
        return ArchiveStreamReader(self.options)


class ArchiveStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)
        self.params = json.loads(self.options.get("params", "{}"))
        self.skip = set(json.loads(self.options.get("skip", "[]")))
        self.piece = Decimal(self.options.get("piece_seconds", PIECE_SECONDS))
        if self.piece <= 0:
            raise ValueError("piece_seconds must be positive")

    def _client(self) -> Callable[[str, dict], dict]:
        module, _, function = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), function)

    def _all(self, endpoint: str, params: dict, items: str):
        """All items of a page chain, or an error."""
        error = yield from paged(self._client(), endpoint, self.params | params, items)
        if error:
            raise RuntimeError(f"{endpoint} {params.get('channel', '')}: {error}")

    def _channels(self) -> dict[str, str]:
        """Channels by id, with the second from which their messages are read."""
        endpoint, items, _, params = archive.KINDS["channels"]
        since = self.options.get("since", "0")
        return {c["id"]: str(c.get("created") or since) for c in self._all(endpoint, params, items) if c["id"] not in self.skip}

    def _newest(self, channel: str) -> str | None:
        endpoint, items, *_ = archive.KINDS["history"]
        reply = call_with_retries(self._client(), endpoint, self.params | {"channel": channel, "limit": 1})
        if not reply.get("ok"):
            raise RuntimeError(f"{endpoint} {channel}: {reply.get('error') or 'failed'}")
        return reply[items][0]["ts"] if reply.get(items) else None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Per channel with messages, the time of its newest, and where its history begins."""
        begins = self._channels()
        with ThreadPoolExecutor(PROBES) as pool:
            newest = dict(zip(begins, pool.map(self._newest, begins), strict=True))
        return {c: {"to": ts, "begin": begins[c]} for c, ts in sorted(newest.items()) if ts is not None}

    def partitions(self, start: dict, end: dict):
        out = []
        for channel, at in end.items():
            # A message may bear the very second of the channel's creation, so the first range begins before it.
            low = Decimal(start[channel]["to"]) if channel in start else Decimal(at["begin"]) - 1
            high = Decimal(at["to"])
            if channel not in start and high <= low:  # older than its channel, as imported messages are
                low = Decimal(-1)
            while low < high:
                cut = min(high, low + self.piece) if low >= 1 else high
                out.append(InputPartition((channel, str(low), str(cut))))
                low = cut
        return out

    def read(self, partition):
        """Messages later than the piece's begin, up to and with its end. What a client gives beside them is left out."""
        channel, low, high = partition.value
        endpoint, items, _, params = archive.KINDS["history"]
        asked = params | {"channel": channel, "oldest": low, "latest": high, "inclusive": True}
        for item in self._all(endpoint, asked, items):
            if Decimal(low) < Decimal(item["ts"]) <= Decimal(high):
                yield (channel, json.dumps(item, sort_keys=True))


def message_stream(spark: SparkSession, client: str, **options: str) -> DataFrame:
    """New messages of all channels as a stream: channel, and the fields of the history scan."""
    spark.dataSource.register(ArchiveStream)
    rows = spark.readStream.format("loomline_archive").options(client=client, **options).load()
    return rows.select("channel", F.from_json("item", archive.KINDS["history"][2]).alias("i")).select("channel", "i.*")
