"""Datagrams as a stream: a Python data source. Register it with spark.dataSource.register(UdpSource).

A reader listens for `seconds` and gives one row for each datagram; datagrams that come between batches wait in the
socket's buffer. There is no replay, so a lost batch is lost: where that matters, let a relay write files or Kafka.
"""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

LARGEST = 65_535


class UdpReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.seconds = float(options.get("seconds", "1"))
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((options.get("host", "0.0.0.0"), int(options["port"])))
        self.socket.settimeout(0.1)

    def initialOffset(self) -> dict:
        return {"seen": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, until = [], time.monotonic() + self.seconds
        while time.monotonic() < until:
            try:
                data, (addr, _) = self.socket.recvfrom(LARGEST)
            except TimeoutError:
                continue
            rows.append((data.decode("utf-8", "replace").rstrip("\r\n"), addr))
        return iter(rows), {"seen": start["seen"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(())

    def commit(self, end: dict) -> None:
        pass


class UdpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self) -> str:
        return "value string, source_addr string"

    def simpleStreamReader(self, schema) -> UdpReader:
        return UdpReader(self.options)
