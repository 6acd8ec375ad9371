"""Tags and texts of HTML in one pass, in time linear in the source however broken it is."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SPECIAL = re.compile(r"[>\"']")


class Token(NamedTuple):
    """A text, or a tag with its name, whether it closes, and its attributes as written."""

    text: str | None = None
    tag: str = ""
    end: bool = False
    attributes: str = ""


class _TagEnds:
    """Where tags end: at the first ``>`` outside quotes. Every special character is followed once, whoever asks."""

    def __init__(self, source: str) -> None:
        self.places = [m.start() for m in _SPECIAL.finditer(source)]
        self.source, self.at = source, 0
        following: dict[str, int] = {}
        self.next_same = [-1] * len(self.places)
        for k in range(len(self.places) - 1, -1, -1):
            kind = source[self.places[k]]
            self.next_same[k] = following.get(kind, -1)
            following[kind] = k
        self.known: dict[int, int] = {len(self.places): -1}

    def after(self, place: int) -> int:
        """The end of a tag whose attributes begin at ``place``, or -1. Places are asked for in ascending order."""
        while self.at < len(self.places) and self.places[self.at] < place:
            self.at += 1
        k, path = self.at, []
        while k not in self.known:
            path.append(k)
            if self.source[self.places[k]] == ">":
                self.known[k] = self.places[k]
            elif self.next_same[k] < 0:
                self.known[k] = -1  # an open quote
            else:
                k = self.next_same[k] + 1
        for passed in path:
            self.known.setdefault(passed, self.known[k])
        return self.known[k]


def tokens(source: str, raw: frozenset[str]) -> Iterator[Token]:
    """Texts and tags in order.

    Comments, declarations and the elements named in ``raw`` (with all they hold, or a self-closed ``svg``) give
    nothing; one that is never closed takes all that follows. A ``<`` that begins no tag is text.
    """
    ends, at, n = _TagEnds(source), 0, len(source)
    missing: set[str] = set()  # what is nowhere ahead is not looked for again

    def find(what: str, begin: int) -> int:
        if what in missing:
            return -1
        place = source.find(what, begin)
        if place < 0:
            missing.add(what)
        return place

    while at < n:
        if source[at] != "<":
            place = find("<", at)
            place = n if place < 0 else place
            yield Token(source[at:place])
            at = place
            continue
        if source.startswith("<!--", at):
            place = find("-->", at + 4)
            at = n if place < 0 else place + 3
            continue
        if source.startswith("<![cdata[", at) or source[at : at + 9].lower() == "<![cdata[":
            place = find("]]>", at + 9)
            if place >= 0:
                at = place + 3
                continue
        if source.startswith(("<!", "<?"), at):
            place = find(">", at + 2)
            if place >= 0:
                at = place + 1
                continue
        found = _NAME.match(source, at + 1)
        close = ends.after(found.end()) if found else -1
        if close < 0:
            yield Token("<")
            at += 1
            continue
        name = found[2].lower()
        bare = re.split("[:-]", name, maxsplit=1)[0]
        beyond = source[found.end()]
        if bare == name and (beyond.isalnum() or beyond == "_"):
            bare = ""  # a longer name, of letters that no tag has
        if not found[1] and bare in raw:
            if bare == "svg" and source[close - 1] == "/":
                at = close + 1
                continue
            ending = None if bare in missing else re.compile(rf"</{bare}\s*>", re.I).search(source, close + 1)
            if ending is None:
                missing.add(bare)
            at = ending.end() if ending else n
            continue
        yield Token(None, name, bool(found[1]), source[found.end() : close])
        at = close + 1
