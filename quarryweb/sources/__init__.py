"""Where pages and robots rules come from."""

from quarryweb.sources.fetch import Client, fetch_pages
from quarryweb.sources.pages import spread
from quarryweb.sources.robots import allowed, robots_gate

__all__ = ["Client", "allowed", "fetch_pages", "robots_gate", "spread"]
