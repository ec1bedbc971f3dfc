"""URLs as browsers read them: parsing, joining and writing by the public URL standard."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import unquote_to_bytes

#: Fixed values of the URL standard: special schemes with their default ports.
SPECIAL = {"ftp": 21, "file": None, "http": 80, "https": 443, "ws": 80, "wss": 443}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_EDGES = "".join(map(chr, range(0x21)))
_FORBIDDEN = frozenset("\0\t\n\r #/:<>?@[\\]^|%\x7f") | frozenset(map(chr, range(0x20)))
_FRAGMENT = frozenset(' "<>`')
_QUERY = frozenset(' "#<>')
_PATH = _QUERY | frozenset("?`{}")
_USERINFO = _PATH | frozenset("/:;=@[\\]^|")
_DOTS = {".": 1, "%2e": 1, "..": 2, ".%2e": 2, "%2e.": 2, "%2e%2e": 2}


def _encode(text: str, extra: frozenset[str]) -> str:
    if all(" " < c <= "~" and c not in extra for c in text):
        return text
    return "".join(c if " " <= c <= "~" and c not in extra else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


@dataclass
class Url:
    scheme: str
    host: str | None = None
    port: int | None = None
    user: str = ""
    password: str = ""
    path: list[str] = field(default_factory=list)
    opaque: str | None = None
    query: str | None = None
    fragment: str | None = None

    @property
    def path_text(self) -> str:
        return self.opaque if self.opaque is not None else "".join(f"/{p}" for p in self.path)

    def __str__(self) -> str:
        out = f"{self.scheme}:"
        if self.host is not None:
            out += "//"
            if self.user or self.password:
                out += self.user + (f":{self.password}" if self.password else "") + "@"
            out += self.host + (f":{self.port}" if self.port is not None else "")
        elif self.opaque is None and len(self.path) > 1 and not self.path[0]:
            out += "/."
        out += self.path_text
        if self.query is not None:
            out += f"?{self.query}"
        return out if self.fragment is None else f"{out}#{self.fragment}"


def _ipv4(host: str) -> str | None:
    """The address if host ends in a number, None if it is not one; raises ValueError if it is malformed."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    last = parts[-1]
    if not (last.isdigit() and last.isascii() or re.fullmatch(r"0[xX][0-9a-fA-F]*", last)):
        return None
    if len(parts) > 4:
        raise ValueError(host)
    numbers = []
    for p in parts:
        if not p:
            raise ValueError(host)
        base = 16 if p[:2].lower() == "0x" else 8 if len(p) > 1 and p[0] == "0" else 10
        digits = p[2:] if base == 16 else p[1:] if base == 8 else p
        numbers.append(int(digits, base) if digits else 0)
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError(host)
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str) -> str:
    import ipaddress

    words = [int(x, 16) for x in ipaddress.IPv6Address(text).exploded.split(":")]
    best, at, i = 1, -1, 0
    while i < 8:
        j = i
        while j < 8 and not words[j]:
            j += 1
        if j - i > best:
            best, at = j - i, i
        i = max(j, i + 1)
    if at < 0:
        return "[" + ":".join(f"{w:x}" for w in words) + "]"
    return "[" + ":".join(f"{w:x}" for w in words[:at]) + "::" + ":".join(f"{w:x}" for w in words[at + best :]) + "]"


@lru_cache(maxsize=4096)
def _host(text: str, special: bool) -> str:
    if text.startswith("["):
        if not text.endswith("]"):
            raise ValueError(text)
        return _ipv6(text[1:-1])
    if not special:
        if any(c in _FORBIDDEN and c != "%" for c in text):
            raise ValueError(text)
        return _encode(text, frozenset())
    name = unquote_to_bytes(text).decode("utf-8")
    if name.isascii():
        name = name.lower()
    else:
        try:
            import idna

            name = idna.encode(name, uts46=True, transitional=False).decode()
        except ImportError:
            name = name.encode("idna").decode().lower()
        except Exception as e:
            raise ValueError(text) from e
    if not name or any(c in _FORBIDDEN for c in name):
        raise ValueError(text)
    return _ipv4(name) or name


def _authority(url: Url, text: str) -> None:
    special = url.scheme in SPECIAL
    login, at, rest = text.rpartition("@")
    if at:
        user, _, password = login.partition(":")
        url.user, url.password = _encode(user, _USERINFO), _encode(password, _USERINFO)
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", rest, re.S)
    if not m:
        raise ValueError(text)
    name, port = m[1], m[2]
    if port:
        if not (port.isascii() and port.isdigit()) or int(port) > 65535:
            raise ValueError(text)
        url.port = int(port) if int(port) != SPECIAL.get(url.scheme) else None
    if not name and special and url.scheme != "file":
        raise ValueError(text)
    url.host = _host(name, special) if name else ""
    if url.scheme == "file" and url.host == "localhost":
        url.host = ""


def _path(base: list[str], text: str, special: bool) -> list[str]:
    parts = re.split(r"[/\\]" if special else "/", text)
    out = list(base)
    for i, p in enumerate(parts):
        dots, last = _DOTS.get(p.lower(), 0), i == len(parts) - 1
        if dots == 2 and out:
            out.pop()
        if dots:
            if last:
                out.append("")
        else:
            out.append(_encode(p, _PATH))
    return out


def parse(text: str, base: Url | None = None) -> Url:
    """Raises ValueError for what is not a URL."""
    text = text.strip(_EDGES)
    text = text.replace("\t", "").replace("\n", "").replace("\r", "")
    text, has_fragment, fragment = text.partition("#")
    url = _parse(text, base)
    url.fragment = _encode(fragment, _FRAGMENT) if has_fragment else None
    return url


def _parse(text: str, base: Url | None) -> Url:
    m = _SCHEME.match(text)
    if m:
        scheme, rest = m[1].lower(), text[m.end() :]
        special = scheme in SPECIAL
        if not (special and base and base.scheme == scheme and rest[:1] not in ("/", "\\")):
            url = Url(scheme)
            rest, has_query, query = rest.partition("?")
            url.query = _encode(query, _QUERY | ({"'"} if special else set())) if has_query else None
            if special and scheme != "file":
                rest = rest.lstrip("/\\")
                cut = re.search(r"[/\\]", rest)
                _authority(url, rest[: cut.start()] if cut else rest)
                url.path = _path([], rest[cut.end() :] if cut else "", True)
            elif rest[:2] == "//" or special and re.match(r"[/\\]{2}", rest):
                rest = rest[2:]
                cut = re.search(r"[/\\]" if special else "/", rest)
                _authority(url, rest[: cut.start()] if cut else rest)
                url.path = _path([], rest[cut.end() :], special) if cut else [""] if special else []
            elif rest[:1] == "/" or special:
                url.host = "" if special else None
                url.path = _path([], rest.lstrip("/\\") if special else rest[1:], special)
            else:
                url.opaque = _encode(rest, frozenset())
            return url
        text = rest
    if base is None:
        raise ValueError("a relative URL without a base")
    if base.opaque is not None:
        if text:
            raise ValueError("the base has no path to join with")
        return Url(base.scheme, opaque=base.opaque, query=base.query)
    special = base.scheme in SPECIAL
    text, has_query, query = text.partition("?")
    encoded = _encode(query, _QUERY | ({"'"} if special else set())) if has_query else None
    slashes = text.replace("\\", "/") if special else text
    if slashes.startswith("//"):
        return _parse(f"{base.scheme}:{slashes}" + (f"?{query}" if has_query else ""), None)
    url = Url(base.scheme, base.host, base.port, base.user, base.password)
    url.query = encoded
    if slashes.startswith("/"):
        url.path = _path([], slashes[1:], special)
    elif slashes:
        url.path = _path(base.path[:-1], slashes, special)
    else:
        url.path = list(base.path)
        if not has_query:
            url.query = base.query
    return url


def try_parse(text: str | None) -> Url | None:
    try:
        return parse(text) if text is not None else None
    except (ValueError, UnicodeError):
        return None
