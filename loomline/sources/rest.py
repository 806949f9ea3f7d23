"""A paged REST API as a Python data source: one partition per start of a page chain.

The client is given as ``module:function`` and called as client(endpoint, params) -> dict. Errors end a
chain with a row that tells the error, as an archive run should keep what it has. Tokens come from the environment.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_RETRIES, FIRST_WAIT = 4, 2.0


def call_with_retries(client: Callable[[str, dict], dict], endpoint: str, params: dict, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Up to four tries; waits as told, or twice as long each time; bad credentials end it at once."""
    reply: dict = {"ok": False, "error": "not tried"}
    for n in range(MOST_RETRIES):
        try:
            reply = client(endpoint, params)
        except OSError as e:
            reply = {"ok": False, "error": str(e)}
        if reply.get("ok") or reply.get("error") == "invalid_auth":
            return reply
        if n + 1 < MOST_RETRIES:
            sleep(float(reply.get("retry_after") or FIRST_WAIT * 2**n))
    return reply


def items_of(found) -> list:
    """What a reply holds as a list: a map gives objects with name and url, an object itself."""
    if isinstance(found, dict):
        named = found and all(isinstance(v, str) and ":" in v for v in found.values())
        return [{"name": k, "url": v} for k, v in found.items()] if named else [found]
    return list(found or [])


def paged(
    client: Callable[[str, dict], dict], endpoint: str, params: dict, items: str, sleep: Callable[[float], None] = time.sleep, first_page: bool = False
) -> Iterator[dict]:
    """All items of a cursor chain; a failed call ends it, and its error is the generator's value."""
    cursor = ""
    while True:
        reply = call_with_retries(client, endpoint, params | ({"cursor": cursor} if cursor else {}), sleep)
        if not reply.get("ok"):
            return reply.get("error") or "failed"
        yield from items_of(reply.get(items))
        cursor = (reply.get("response_metadata") or {}).get("next_cursor", "")
        if not cursor or first_page:
            return None


class RestSource(DataSource):
    """options: client, endpoint, items, chains (a JSON list of parameters, one partition each), first_page."""

    @classmethod
    def name(cls) -> str:
        return "loomline_rest"

    def schema(self) -> str:
        return "chain int, item string, error string"

    def reader(self, schema) -> RestReader:
        return RestReader(self.options)


class RestReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        chains = json.loads(self.options.get("chains", "[{}]"))
        return [InputPartition((i, chain)) for i, chain in enumerate(chains)]

    def read(self, partition):
        number, params = partition.value
        module, _, function = self.options["client"].partition(":")
        client = getattr(importlib.import_module(module), function)
        items = paged(client, self.options["endpoint"], params, self.options["items"], first_page=self.options.get("first_page") == "true")
        while True:
            try:
                yield (number, json.dumps(next(items), sort_keys=True), None)
            except StopIteration as end:
                if end.value:  # what came before is kept, and the reader can tell that it is not whole
                    yield (number, None, end.value)
                return
