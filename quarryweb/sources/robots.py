"""robots.txt: rules by the public standard (RFC 9309), as a table keyed by host, and the gate before extraction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryweb.functions import urls
from quarryweb.sources.fetch import PREFIXES, Client, fetch_pages

TTL_SECONDS = 1800
TIMEOUT_SECONDS = 10
_LINE = re.compile(r"\s*([A-Za-z-]+)\s*:\s*([^#\r\n]*)")


@lru_cache(maxsize=4096)
def _rules(text: str) -> tuple[tuple[frozenset[str], tuple[tuple[bool, str], ...]], ...]:
    """(agents, (allow, path) ...) of each group."""
    groups: list[tuple[set[str], list[tuple[bool, str]]]] = []
    naming = False
    for line in text.lstrip("\ufeff").splitlines():
        m = _LINE.match(line)
        if not m:
            continue
        key, value = m[1].lower(), m[2].strip()
        if key == "user-agent":
            if not naming:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
            naming = True
        elif key in ("allow", "disallow") and groups:
            naming = False
            if value:
                groups[-1][1].append((key == "allow", value))
    return tuple((frozenset(a), tuple(r)) for a, r in groups)


_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|.", re.S)
#: What stands for itself in a path; everything else, and an escaped slash, is compared in its escaped form.
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~/:?&=+,;@!'()")


@lru_cache(maxsize=4096)
def canonical(path: str, special: str = "") -> str:
    """path with one way to write each character: `%61` as `a`, `<` as `%3C`; characters of special are kept."""
    out = []
    for part in _ESCAPED.findall(path):
        if part in special:
            out.append(part)
            continue
        raw = bytes([int(part[1:], 16)]) if len(part) == 3 else part.encode("utf-8", "surrogatepass")
        kept = raw.decode("latin-1") if len(raw) == 1 else ""
        out.append(kept if kept in _PLAIN and kept and not (kept == "/" and len(part) == 3) else "".join(f"%{b:02X}" for b in raw))
    return "".join(out)


@lru_cache(maxsize=4096)
def _pattern(path: str) -> re.Pattern:
    body, end = (path[:-1], r"\Z") if path.endswith("$") else (path, "")
    return re.compile("".join(".*" if c == "*" else re.escape(c) for c in canonical(body, "*")) + end, re.S)


def allowed(rules: str | None, path: str, agent: str) -> bool:
    """The longest rule of the agent's groups (else of *) decides; allow wins ties; no rules allow everything."""
    if not rules:
        return True
    agent, groups, path = agent.lower(), _rules(rules), canonical(path)
    mine = [a for names, _ in groups for a in names if a != "*" and a and a in agent]
    best_name = max(mine, key=len) if mine else "*"
    found = [(len(p), allow) for names, lines in groups if best_name in names for allow, p in lines if _pattern(p).match(path)]
    return max(found)[1] if found else True


def host_and_path(url: str | None) -> tuple[str | None, str | None]:
    parsed = urls.try_parse(url)
    return (parsed.host or None, parsed.path_text or "/") if parsed else (None, None)


def robots_url(url: str) -> str | None:
    """scheme://host/robots.txt; the port is left out."""
    parsed = urls.try_parse(url)
    return f"{parsed.scheme}://{parsed.host}/robots.txt" if parsed and parsed.host else None


def with_host(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host, path and robots_url of its URLs."""

    @F.arrow_udf("struct<host:string,path:string,robots_url:string>")
    def place(pages: pa.Array) -> pa.Array:
        rows = [(*host_and_path(u := x.as_py()), robots_url(u) if u is not None else None) for x in pages]
        return pa.array([dict(zip(("host", "path", "robots_url"), r, strict=True)) for r in rows], pa.struct([(k, pa.string()) for k in ("host", "path", "robots_url")]))

    return df.withColumn("_at", place(F.col(url_col))).select(*df.columns, "_at.host", "_at.path", "_at.robots_url")


def fresh(rules: DataFrame, ttl_seconds: int = TTL_SECONDS, now=None) -> DataFrame:
    """The rows of a rules table (host, robots_txt, fetched_at) that are not too old."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return rules.where(F.col("fetched_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def fetch_rules(pages: DataFrame, client: Client | None = None, known: DataFrame | None = None, url_col: str = "url", store: Callable[[], RulesStore] | None = None) -> DataFrame:
    """host, robots_txt, fetched_at of the hosts of pages that a known table lacks. Failures count as no rules.

    store makes, in each task, a key-value store that is asked before the
    network and told what the network says; its own time to live holds there.
    """
    hosts = with_host(pages.select(url_col), url_col).where("host is not null").groupBy("host").agg(F.min("robots_url").alias("url"))
    if known is not None:
        hosts = hosts.join(known.select("host"), "host", "left_anti")
    client = client or Client(timeout=TIMEOUT_SECONDS)
    if store is not None:
        hosts = _asked(hosts, store)
    got = fetch_pages(hosts, client).withColumn("robots_txt", F.coalesce("html", F.lit("")))
    if store is not None:
        got = _told(got, store)
    return got.select("host", "robots_txt", F.current_timestamp().alias("fetched_at"))


def _asked(hosts: DataFrame, store: Callable[[], RulesStore]) -> DataFrame:
    """hosts with html, the store's rules where it has some, and stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = store()
        for batch in batches:
            rules = [held.get(h) for h in batch.column("host").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("url"), pa.array(rules, pa.string()), pa.array([r is not None for r in rules], pa.bool_())], ["host", "url", "html", "stored"])

    return hosts.select("host", "url").mapInArrow(run, "host string, url string, html string, stored boolean")


def _told(rows: DataFrame, store: Callable[[], RulesStore]) -> DataFrame:
    """rows as they are, after what was fetched has been put into the store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = store()
        for batch in batches:
            for host, text, stored in zip(*(batch.column(c).to_pylist() for c in ("host", "robots_txt", "stored")), strict=True):
                if not stored:
                    held.put(host, text)
            yield batch.select(["host", "robots_txt"])

    return rows.select("host", "robots_txt", "stored").mapInArrow(run, "host string, robots_txt string")


def robots_gate(pages: DataFrame, rules: DataFrame, agent: str = Client().agent, url_col: str = "url") -> DataFrame:
    """pages with allowed (boolean) and, where it is false, error. Rules are joined on the host; only the path is tested.

    Hosts without rules allow everything. The rules table may be of any size:
    Spark broadcasts it if it is small and shuffles both sides if not.
    """

    @F.arrow_udf("boolean")
    def ask(texts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([allowed(t.as_py(), p.as_py() or "/", agent) for t, p in zip(texts, paths, strict=True)], pa.bool_())

    columns = [c for c in pages.columns if c not in ("allowed", "error")]
    placed = with_host(pages.select(*columns).withColumn("_error", F.col("error") if "error" in pages.columns else F.lit(None).cast("struct<kind:string,message:string>")), url_col)
    one = rules.groupBy(F.col("host").alias("_host")).agg(F.max_by("robots_txt", "fetched_at").alias("_rules") if "fetched_at" in rules.columns else F.max("robots_txt").alias("_rules"))
    both = placed.join(one, F.col("host") == F.col("_host"), "left").withColumn("allowed", ask(F.col("_rules"), F.col("path")))
    message = F.concat(F.lit(f"{PREFIXES['Other']}URL "), F.col(url_col), F.lit(" is disallowed by robots.txt"))
    error = F.when(~F.col("allowed"), F.struct(F.lit("Other").alias("kind"), message.alias("message"))).otherwise(F.col("_error"))
    return both.select(*columns, "allowed", error.alias("error"))


class RulesStore:
    """An optional key-value store of rules (keys robots:{host}), such as a Redis client with get, setex and delete."""

    def __init__(self, client, ttl_seconds: int = TTL_SECONDS):
        self.client, self.ttl = client, ttl_seconds

    @classmethod
    def from_url(cls, url: str) -> RulesStore:
        try:
            import redis
        except ImportError as e:
            raise RuntimeError(f"{PREFIXES['Other']}a Redis client library is needed for {url}") from e
        return cls(redis.Redis.from_url(url, decode_responses=True))

    def get(self, host: str) -> str | None:
        return self.client.get(f"robots:{host}")

    def put(self, host: str, rules: str) -> None:
        self.client.setex(f"robots:{host}", self.ttl, rules)

    def remove(self, host: str) -> None:
        self.client.delete(f"robots:{host}")
