"""Pages fetched from the web, as a Spark data source.

Addresses are dealt over tasks; each task fetches its own and yields a row for each, with an error
in place of a page that can't be had. Nothing is fetched inside an extraction.
"""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Iterator
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagequern.sources.files import MOST_BYTES

TIMEOUT_S = 10


class FetchError(Exception):
    """Why a page wasn't fetched: blocked, http status, too large, or the network's reason."""


def check_address(url: str, allow_private: bool = False) -> None:
    """Raises unless the address is http or https and its host neither local nor private."""
    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    if parts.scheme not in ("http", "https") or not host:
        raise FetchError("blocked: not http or https")
    if allow_private:
        return
    if host == "localhost" or host.endswith((".local", ".internal", ".lan", ".localhost")):
        raise FetchError("blocked: local host")
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return
    mapped = getattr(address, "ipv4_mapped", None) or address
    shared = mapped.version == 4 and mapped in ipaddress.ip_network("100.64.0.0/10")
    if mapped.is_private or mapped.is_loopback or mapped.is_link_local or mapped.is_multicast or mapped.is_reserved or mapped.is_unspecified or shared:
        raise FetchError("blocked: private address")


def fetch(url: str, timeout: float = TIMEOUT_S, most: int = MOST_BYTES, allow_private: bool = False) -> tuple[str, str]:
    """(final address, text) of a page. Redirects are followed and where they lead is checked too."""
    check_address(url, allow_private)
    try:
        with urlopen(Request(url, headers={"User-Agent": "pagequern"}), timeout=timeout) as answer:
            check_address(answer.url, allow_private)
            data = answer.read(most + 1)
            if len(data) > most:
                raise FetchError("too large")
            return answer.url, data.decode(answer.headers.get_content_charset() or "utf-8", errors="replace")
    except OSError as e:
        raise FetchError(f"http: {getattr(e, 'code', e)}") from e


class FetchSource(DataSource):
    """Format "pagequern_fetch"; options urls (a JSON list), tasks, timeout, allowPrivate."""

    @classmethod
    def name(cls) -> str:
        return "pagequern_fetch"

    def schema(self) -> str:
        return "page_id bigint, url string, html string, error string"

    def reader(self, schema) -> FetchReader:
        return FetchReader(self.options)


class Share(InputPartition):
    def __init__(self, first: int, urls: list[str]):
        super().__init__(first)
        self.urls = urls


class FetchReader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.tasks = json.loads(options.get("urls", "[]")), int(options.get("tasks", "8"))
        self.timeout, self.allow_private = float(options.get("timeout", str(TIMEOUT_S))), options.get("allowprivate", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        size = max(1, -(-len(self.urls) // self.tasks))
        return [Share(i, self.urls[i : i + size]) for i in range(0, len(self.urls), size)] or [Share(0, [])]

    def read(self, share: Share) -> Iterator[tuple]:
        for i, url in enumerate(share.urls, share.value):
            try:
                final, html = fetch(url, self.timeout, allow_private=self.allow_private)
                yield i, final, html, None
            except FetchError as e:
                yield i, url, None, str(e)
