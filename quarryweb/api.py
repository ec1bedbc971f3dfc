"""The single-page and batch facade over the extraction plan."""

from __future__ import annotations

import asyncio
import math
import time
import warnings
from dataclasses import replace
from typing import Any

from pyspark.sql import Row, SparkSession

from quarryweb.plans import Request, extract
from quarryweb.sources.fetch import PREFIXES, Client, fetch_pages, get
from quarryweb.sources.robots import TTL_SECONDS, RulesStore, allowed, host_and_path, robots_url

MISSING_FIELDS = 'Without fields every field is extracted; name the ones that are needed, or pass fields=["all"].'
PAGE = "pos long, url string, html string"


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _plain(value: Any) -> Any:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


class ExtractionResult:
    """What a page gave."""

    def __init__(self, row: Row):
        self._row = _plain(row)

    url = property(lambda self: self._row["url"])
    text = property(lambda self: self._row["text"])
    language = property(lambda self: self._row["language"])
    language_confidence = property(lambda self: self._row["language_confidence"])
    links = property(lambda self: self._row["links"])
    socials = property(lambda self: self._row["socials"])
    videos = property(lambda self: self._row["videos"])
    product = property(lambda self: self._row["product"])
    article = property(lambda self: self._row["article"])
    result = property(lambda self: self.to_dict())

    @property
    def grouped_links(self) -> dict | None:
        """Deprecated: the same as links."""
        return self.links

    @property
    def content(self) -> dict[str, Any]:
        return {k: v for k, v in self._row["content"].items() if v is not None}

    def to_dict(self) -> dict[str, Any]:
        text = {"content": self.text, "language": self.language, "language_confidence": self.language_confidence, "text_length": self._row["content"]["text_length"]}
        out = {"url": self.url, "text": {k: v for k, v in text.items() if v is not None}}
        return out | {k: self._row[k] for k in ("links", "socials", "videos", "product", "article") if self._row[k] is not None}

    def __repr__(self) -> str:
        return f"ExtractionResult(url={self.url!r})"


class WebExtractor:
    """Set what is wanted, then run. With html no page is fetched, even if html is empty."""

    def __init__(self, url: str, html: str | None = None):
        self.url, self.html = url, html
        self._request, self._client, self._set = Request(), Client(), False
        self._rules: dict[str, tuple[str, float]] | None = None
        self._ttl = TTL_SECONDS
        self._store: RulesStore | None = None

    def _want(self, **fields) -> None:
        self._request, self._set = replace(self._request, **fields), True

    @staticmethod
    def _fields(fields: list[str] | None) -> tuple[str, ...]:
        if fields is None:
            warnings.warn(MISSING_FIELDS, UserWarning, stacklevel=3)
            return ("all",)
        return tuple(fields)

    def extract_text(self, language_detection: bool = False) -> None:
        self._want(text=True, language=language_detection)

    def extract_links(self, internal: bool = False, external: bool = False, all: bool = False) -> None:  # noqa: A002
        both = all or internal == external
        self._want(links=("all",) if both else ("internal",) if internal else ("external",))

    def extract_socials(self, fields: list[str] | None = None) -> None:
        self._want(socials=self._fields(fields))

    def extract_video(self, fields: list[str] | None = None) -> None:
        self._want(videos=self._fields(fields))

    def extract_product(self, fields: list[str] | None = None) -> None:
        self._want(product=self._fields(fields))

    def extract_article(self, fields: list[str] | None = None) -> None:
        self._want(article=self._fields(fields))

    def set_timeout(self, timeout_secs: float) -> None:
        self._client = replace(self._client, timeout=int(timeout_secs))

    def set_user_agent(self, user_agent: str) -> None:
        self._client = replace(self._client, agent=user_agent, random_agent=False)

    def set_random_user_agent(self, enabled: bool = True) -> None:
        self._client = replace(self._client, random_agent=enabled)

    def add_header(self, name: str, value: str) -> None:
        self._client = self._client.with_headers({name: value}, keep=True)

    def set_headers(self, headers: dict[str, str]) -> None:
        self._client = self._client.with_headers(headers, keep=False)

    def configure_client(self, fetcher) -> None:
        """fetcher(url, client) replaces the built-in HTTP client."""
        self._client = replace(self._client, fetcher=fetcher)

    # Robots rules.

    def enable_robots_check(self) -> None:
        self._rules = {}

    def enable_robots_check_with_redis(self, redis_url: str) -> None:
        self._store, self._rules = RulesStore.from_url(redis_url), {}

    def _checked(self) -> dict[str, tuple[str, float]]:
        if self._rules is None:
            raise RuntimeError(f"{PREFIXES['Other']}Robots checker not enabled")
        return self._rules

    def set_robots_redis_ttl(self, ttl_secs: int) -> None:
        self._checked()
        self._ttl = ttl_secs
        if self._store:
            self._store.ttl = ttl_secs

    def _host(self) -> str:
        host, _ = host_and_path(self.url)
        if not host:
            raise RuntimeError(f"{PREFIXES['InvalidUrl']}{self.url}")
        return host

    def set_robots_txt(self, content: str) -> None:
        rules, host = self._checked(), self._host()
        rules[host] = content, math.inf
        if self._store:
            self._store.put(host, content)

    def _find_rules(self) -> str:
        rules, host = self._checked(), self._host()
        if host not in rules or rules[host][1] < time.monotonic():
            text = self._store.get(host) if self._store else None
            if text is None:
                text = get(robots_url(self.url), replace(self._client, timeout=10))[0] or ""
                if self._store:
                    self._store.put(host, text)
            rules[host] = text, time.monotonic() + self._ttl
        return rules[host][0]

    def check_robots_allowed(self) -> bool:
        if self._rules is None:
            return True
        return allowed(self._find_rules(), host_and_path(self.url)[1] or "/", self._client.chosen_agent())

    def remove_robots_from_redis(self) -> None:
        self._checked()
        if self._store:
            self._store.remove(self._host())

    def clear_robots_cache(self) -> None:
        if self._rules:
            self._rules.clear()

    def __enter__(self) -> WebExtractor:
        return self

    def __exit__(self, *exc) -> bool:
        self.clear_robots_cache()
        return False

    def run(self) -> ExtractionResult:
        if not self._set:
            raise RuntimeError("No activities configured: call an extract method before run()")
        if not self.check_robots_allowed():
            raise RuntimeError(f"{PREFIXES['Other']}URL {self.url} is disallowed by robots.txt")
        page = _session().createDataFrame([(0, self.url, self.html)], PAGE)
        if self._request.active():
            page = fetch_pages(page, self._client, max_concurrent=None)
        row = extract(page, self._request).first()
        if row.error is not None:
            raise RuntimeError(row.error.message)
        return ExtractionResult(row)


class AsyncWebExtractor(WebExtractor):
    """The same, with an awaitable run()."""

    async def run(self) -> ExtractionResult:  # type: ignore[override]
        return await asyncio.to_thread(super().run)


async def batch_extract(
    urls: list[str],
    extract_text: bool = False,
    language_detection: bool = False,
    extract_links_internal: bool = False,
    extract_links_external: bool = False,
    extract_links_all: bool = False,
    extract_socials_all: bool = True,
    extract_video_all: bool = True,
    extract_product_all: bool = True,
    extract_article_all: bool = True,
    max_concurrent: int = 10,
    client: Client | None = None,
    keep_errors: bool = False,
) -> list[Any]:
    """Results in the order of urls. Pages that fail are left out, or (keep_errors) given as their error's message."""
    options = extract_links_all, extract_links_internal, extract_links_external
    chosen = [k for k, on in zip(("all", "internal", "external"), options, strict=True) if on]
    both = extract_links_all or extract_links_internal and extract_links_external
    every = lambda on: ("all",) if on else ()
    request = Request(
        extract_text, language_detection, (("all",) if both else tuple(chosen)) if chosen else None, every(extract_socials_all), every(extract_video_all), every(extract_product_all), every(extract_article_all)
    )

    def work() -> list[Any]:
        pages = _session().createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGE)
        rows = extract(fetch_pages(pages, client, max_concurrent), request, keep=["pos"]).collect()
        rows.sort(key=lambda r: r.pos)
        return [ExtractionResult(r) if r.error is None else r.error.message for r in rows if r.error is None or keep_errors]

    return await asyncio.to_thread(work)
