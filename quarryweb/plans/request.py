"""What a caller wants from each page."""

from __future__ import annotations

from dataclasses import dataclass

from quarryweb.operators import fields as f


@dataclass(frozen=True)
class Request:
    """None: not requested. An empty list of fields: requested, but nothing is done. ("all",): every field."""

    text: bool = False
    language: bool = False
    links: tuple[str, ...] | None = None
    socials: tuple[str, ...] = ()
    videos: tuple[str, ...] = ()
    product: tuple[str, ...] = ()
    article: tuple[str, ...] = ()

    def unknown(self) -> list[str]:
        """Requested names that no catalogue has."""
        out = []
        for kind in f.CATALOGUES:
            wanted = getattr(self, kind)
            if "all" not in wanted:
                aliases = f.CATALOGUES[kind][1]
                out += [f"{kind}.{n}" for n in wanted if aliases.get(n, n) not in f.CATALOGUES[kind][0]]
        return out

    def active(self) -> bool:
        """Whether any page has to be read at all."""
        return self.text or bool(self.links) or any(getattr(self, k) for k in f.CATALOGUES)

    def parts(self) -> list[str]:
        """The parts of the page index that the request reads, in a fixed order."""
        wanted = {"text"} if self.text else set()
        wanted |= {"links"} if self.links else set()
        for kind in f.CATALOGUES:
            wanted |= f.parts(kind, list(getattr(self, kind)))
        from quarryweb.html.index import PARTS

        return [p for p in PARTS if p in wanted]
