"""HTTP source: pages are fetched on the executors, errors are kept as rows."""

from __future__ import annotations

import http.client
import random
import socket
import threading
import urllib.error
import urllib.parse
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryweb.functions import urls

#: How a client names itself.
DEFAULT_AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.124 Safari/537.36"
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10.15; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.0.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Safari/605.1.15",
)
#: Error kinds and how their messages begin.
PREFIXES = {"HttpError": "HTTP error: ", "ParseError": "Parse error: ", "InvalidUrl": "Invalid URL: ", "Timeout": "Timeout: ", "Other": "Error: "}


MOST_REDIRECTS, MOST_CONNECTIONS = 10, 100
#: Pages that a task fetches at a time, in all and of one host.
THREADS, EACH_HOST = 10, 4


@dataclass(frozen=True)
class Client:
    """Settings of the HTTP client; every change makes a new one. fetcher(url, client) -> text or bytes replaces the built-in one."""

    timeout: float = 30
    agent: str = DEFAULT_AGENT
    random_agent: bool = False
    headers: dict[str, str] = field(default_factory=dict)
    fetcher: Callable[[str, Client], str | bytes] | None = None
    seed: int | None = None

    def with_headers(self, headers: dict[str, str], keep: bool) -> Client:
        for name, value in headers.items():
            if not name or not all("!" <= c <= "~" and c not in '"(),/:;<=>?@[\\]{}' for c in name):
                raise RuntimeError(f"{PREFIXES['HttpError']}Invalid header name: {name}")
            if any(c in value for c in "\r\n\0"):
                raise RuntimeError(f"{PREFIXES['HttpError']}Invalid header value: {name}")
        return replace(self, headers={**(self.headers if keep else {}), **headers})

    def chosen_agent(self) -> str:
        return random.Random(self.seed).choice(AGENTS) if self.random_agent else self.agent


class Session:
    """Connections of one thread, kept open by host as long as the server lets them."""

    def __init__(self):
        self.open: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def _connection(self, scheme: str, place: str, client: Client) -> http.client.HTTPConnection:
        found = self.open.get((scheme, place))
        if found is None:
            if len(self.open) >= MOST_CONNECTIONS:
                self.close()
            kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
            found = self.open[scheme, place] = kind(place, timeout=client.timeout or None)
        return found

    def _ask(self, url: str, client: Client, headers: dict[str, str]) -> tuple[http.client.HTTPResponse, bytes]:
        parts = urllib.parse.urlsplit(url)
        if parts.scheme not in ("http", "https"):
            raise urllib.error.URLError(f"no such protocol: {parts.scheme}")
        path = urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, ""))
        place = parts.netloc.rpartition("@")[2]
        for again in (True, False):
            kept = (parts.scheme, place) in self.open
            connection = self._connection(parts.scheme, place, client)
            try:
                connection.request("GET", path, headers=headers)
                response = connection.getresponse()
                data = response.read()
            except TimeoutError:
                self._drop(parts.scheme, place)
                raise
            except (http.client.HTTPException, OSError) as e:
                self._drop(parts.scheme, place)
                if kept and again:  # the server has closed a connection that was kept
                    continue
                raise e if isinstance(e, OSError) else urllib.error.URLError(e) from e
            if response.will_close:
                self._drop(parts.scheme, place)
            return response, data
        raise AssertionError

    def get(self, url: str, client: Client) -> str:
        """The body of whatever the server answers, error pages included; redirects are followed."""
        headers = {"User-Agent": client.chosen_agent(), "Accept": "*/*", **client.headers}
        for _ in range(MOST_REDIRECTS + 1):
            url = str(urls.parse(url))
            response, data = self._ask(url, client, headers)
            to = response.headers.get("Location") if response.status in (301, 302, 303, 307, 308) else None
            if to is None:
                return _decoded(data, response.headers.get_content_charset())
            url = str(urls.parse(to, urls.parse(url)))
        raise urllib.error.URLError("too many redirects")

    def _drop(self, scheme: str, place: str) -> None:
        if found := self.open.pop((scheme, place), None):
            found.close()

    def close(self) -> None:
        for found in self.open.values():
            found.close()
        self.open.clear()


_LOCAL = threading.local()


def http_get(url: str, client: Client) -> str:
    """The body of a page, over this thread's connections."""
    if not hasattr(_LOCAL, "session"):
        _LOCAL.session = Session()
    return _LOCAL.session.get(url, client)


def _decoded(data: bytes, charset: str | None) -> str:
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def error_of(e: BaseException) -> dict[str, str]:
    reason = getattr(e, "reason", e)
    if isinstance(e, TimeoutError | socket.timeout) or isinstance(reason, TimeoutError | socket.timeout):
        kind = "Timeout"
    elif isinstance(e, urllib.error.URLError | ConnectionError):
        kind = "HttpError"
    elif isinstance(e, ValueError):
        kind = "InvalidUrl"
    else:
        kind = "Other"
    return {"kind": kind, "message": f"{PREFIXES[kind]}{e}"}


def get(url: str, client: Client) -> tuple[str | None, dict[str, str] | None]:
    """(html, error): one of them is None."""
    try:
        urls.parse(url)
        page = (client.fetcher or http_get)(url, client)
        return (_decoded(page, None) if isinstance(page, bytes) else page), None
    except Exception as e:  # noqa: BLE001  every failure is a row
        return None, error_of(e)


def fetch_pages(df: DataFrame, client: Client | None = None, max_concurrent: int | None = None, url_col: str = "url", html_col: str = "html", threads: int = THREADS, each_host: int = EACH_HOST) -> DataFrame:
    """df with html_col filled and error set where that failed.

    Rows that have html already (empty pages included) are not fetched. The
    input's partitions are kept, so a crawl grows with its cluster; in each
    task `threads` pages are fetched at a time, of one host `each_host` at
    most. max_concurrent bounds the pages that are fetched at a time over all
    tasks (by that many tasks of one thread), for small batches.
    """
    client = client or Client()
    if html_col not in df.columns:
        df = df.withColumn(html_col, F.lit(None).cast("string"))
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("struct<kind:string,message:string>"))
    if max_concurrent and not df.isStreaming:
        df, threads = df.repartition(max_concurrent), 1
    names = df.columns
    kind = pa.struct([("kind", pa.string()), ("message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str | None, threading.Semaphore] = {}

        def one(url: str | None) -> tuple[str | None, dict[str, str] | None]:
            if url is None:
                return None, error_of(ValueError("null"))
            parsed = urls.try_parse(url)
            with hosts.setdefault(parsed.host if parsed else None, threading.Semaphore(each_host)):
                return get(url, client)

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                pages, errors = batch.column(html_col).to_pylist(), batch.column("error").to_pylist()
                links = batch.column(url_col).to_pylist()
                todo = [i for i in range(len(links)) if pages[i] is None and errors[i] is None]
                for i, got in zip(todo, pool.map(one, [links[i] for i in todo]), strict=True):
                    pages[i], errors[i] = got
                made = {html_col: pa.array(pages, pa.string()), "error": pa.array(errors, kind)}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return df.mapInArrow(run, df.schema)
