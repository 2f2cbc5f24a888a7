"""Snapshot servers as data sources: a unix socket that answers a request line, and an HTTP address."""

from __future__ import annotations

import json
import socket
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "captured_ms long, ok boolean, size long, width int, height int, content binary, error string"


def _exactly(s: socket.socket, n: int) -> bytes:
    parts = []
    while n:
        part = s.recv(min(n, 1 << 16))
        if not part:
            raise ConnectionError(f"{n} bytes short")
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def socket_snapshot(path: str, timeout: float = 5.0, most: int = 1 << 28) -> tuple:
    """One request: a JSON line out, a JSON header line back, then exactly its ``size`` bytes."""
    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
        s.settimeout(timeout)
        s.connect(path)
        s.sendall(b'{"cmd":"snapshot","format":"jpeg"}\n')
        line = bytearray()
        while not line.endswith(b"\n"):
            line += _exactly(s, 1)
            if len(line) > 1 << 16:
                raise ConnectionError("header line doesn't end")
        h = json.loads(line)
        ok, size = bool(h.get("ok")), int(h.get("size", 0))
        if size > most:
            raise ConnectionError(f"snapshot of {size} bytes")
        return ok, size, int(h.get("width", 0)), int(h.get("height", 0)), _exactly(s, size) if ok else None


def http_snapshot(url: str, timeout: float = 5.0, wait: float = 0.5, tries: int = 3) -> tuple:
    """One GET, tried again after a wait."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                body = r.read()
                return True, len(body), 0, 0, body
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(wait)
    raise AssertionError


def _row(options: dict) -> tuple:
    now = int(time.time() * 1000)
    try:
        if "url" in options:
            return (now, *http_snapshot(options["url"], float(options.get("timeout", 5))), None)
        return (now, *socket_snapshot(options["path"], float(options.get("timeout", 5))), None)
    except (OSError, ValueError) as e:
        return now, False, 0, 0, 0, None, str(e)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("n", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield _row(self.options)


class _StreamReader(SimpleDataSourceStreamReader):
    """A snapshot per trigger; a batch that is run again takes a new one, as the server keeps none."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        return iter([_row(self.options)]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([_row(self.options) for _ in range(end["n"] - start["n"])])


class SnapshotSource(DataSource):
    """format("snapshot") with option path (unix socket) or url; failures are rows with an error."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(SnapshotSource)
