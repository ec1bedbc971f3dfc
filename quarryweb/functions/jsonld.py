"""JSON-LD scripts: strict parsing and the property paths that the fields ask for."""

from __future__ import annotations

import json

#: Every property path that a field looks up.
PATHS = (
    "headline name title articleSection keywords author description brand brand.name manufacturer.name category productCategory sku productID mpn "
    "image image.url price offers.price offers.lowPrice offers.highPrice originalPrice priceCurrency offers.priceCurrency availability offers.availability "
    "aggregateRating.ratingValue ratingValue aggregateRating.reviewCount reviewCount aggregateRating.bestRating bestRating aggregateRating.worstRating worstRating"
).split()
_SPLIT = {p: p.split(".") for p in PATHS}


def _reject(name: str):
    raise ValueError(name)


def objects(raw: str) -> list[dict]:
    """The object, or the objects of the array, that a script holds; none if it is not strictly JSON."""
    try:
        value = json.loads(raw, parse_constant=_reject)
        raw.encode("utf-8")
    except (ValueError, RecursionError):
        return []
    found = [value] if isinstance(value, dict) else [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []
    return found


def _text(value) -> str | None:
    """A string; of an array its first string; of an object its name, @id or url. Numbers do not count."""
    if isinstance(value, list):
        value = next((x for x in value if isinstance(x, str)), None)
    elif isinstance(value, dict):
        value = next((value[k] for k in ("name", "@id", "url") if isinstance(value.get(k), str)), None)
    return value if isinstance(value, str) and not any("\ud800" <= c <= "\udfff" for c in value) else None


def resolve(obj: dict) -> list[tuple[str, str]]:
    """(path, text) of the paths that an object has."""
    out = []
    for path, keys in _SPLIT.items():
        value = obj
        for k in keys:
            value = value.get(k) if isinstance(value, dict) else None
        if value is not None and (text := _text(value)) is not None:
            out.append((path, text))
    return out
