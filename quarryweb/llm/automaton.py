"""Rule regexes compiled into one minimal deterministic automaton over bytes.

Each rule is parsed into a syntax tree, laid out as an epsilon automaton, and
all rules together go through subset construction behind a start state that
stays active at every byte, so that one pass over the text finds the ends of
the matches of every rule. Moore's refinement then merges equal states. The
result is a flat transition array indexed by state and byte class.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ANY = (1 << 256) - 1


def _mask(chars) -> int:
    m = 0
    for c in chars:
        m |= 1 << c
    return m


_CLASSES = {"d": _mask(range(48, 58)), "s": _mask(b" \t\n\v\f\r"), "w": _mask(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")}
_ESCAPES = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


class _Parser:
    """The regular part of the usual syntax: literals, classes, groups, (?i:...) for either case, |, ?, *, + and {m,n}; ASCII only."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def parse(self):
        tree = self._alternation()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def _peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def _alternation(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self.i += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def _sequence(self):
        items = []
        while self._peek() not in ("", "|", ")"):
            items.append(self._repeat(self._atom()))
        return ("cat", items)

    def _repeat(self, atom):
        while (c := self._peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i : end].partition(",")
                least, most = int(low), (int(low) if "," not in self.p[self.i : end] else int(high) if high else None)
                self.i = end + 1
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            atom = ("rep", atom, least, most)
        return atom

    def _cased(self, mask: int) -> int:
        if self.fold:
            for lower in range(97, 123):
                if mask >> lower & 1 or mask >> (lower - 32) & 1:
                    mask |= 1 << lower | 1 << (lower - 32)
        return mask

    def _escape(self):
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return 1 << int(self.p[self.i - 2 : self.i], 16)
        return _CLASSES.get(c) or 1 << _ESCAPES.get(c, ord(c))

    def _atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            fold = self.fold
            if self.p.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.p.startswith("?:", self.i):
                self.i += 2
            tree = self._alternation()
            self.fold = fold
            if self._peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return tree
        if c == "[":
            return ("set", self._cased(self._set()))
        if c == ".":
            return ("set", ANY & ~(1 << 10))
        return ("set", self._cased(self._escape() if c == "\\" else 1 << ord(c)))

    def _set(self) -> int:
        negate = self._peek() == "^"
        self.i += negate
        mask, first = 0, True
        while first or self._peek() != "]":
            first = False
            c = self.p[self.i]
            self.i += 1
            one = self._escape() if c == "\\" else 1 << ord(c)
            if self._peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                self.i += 1
                c = self.p[self.i]
                self.i += 1
                last = self._escape() if c == "\\" else 1 << ord(c)
                one = sum(1 << x for x in range(one.bit_length() - 1, last.bit_length()))
            mask |= one
        self.i += 1
        return ANY & ~mask if negate else mask


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.arc: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.arc.append(None)
        return len(self.eps) - 1

    def add(self, tree, at: int) -> int:
        """Lays tree out from state at; returns its last state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.arc[at] = (tree[1], end)
            return end
        if kind == "cat":
            for x in tree[1]:
                at = self.add(x, self._after(at))
            return at
        if kind == "alt":
            end = self.state()
            for x in tree[1]:
                self.eps[self.add(x, self._after(at))].append(end)
            return end
        _, body, least, most = tree
        for _ in range(least):
            at = self.add(body, self._after(at))
        if most is None:
            loop = self._after(at)
            self.eps[self.add(body, self._after(loop))].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.eps[at].append(end)
            at = self.add(body, self._after(at))
        self.eps[at].append(end)
        return end

    def _after(self, at: int) -> int:
        new = self.state()
        self.eps[at].append(new)
        return new

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Dfa:
    """next[state * classes + class of the byte] is the next state times classes; states from hot on accept, the dead state is -1 times classes."""

    byte_class: bytes
    classes: int
    next: list[int]
    hot: int
    accepts: dict[int, tuple[int, ...]] = field(default_factory=dict)
    start: int = 0

    @property
    def states(self) -> int:
        return len(self.next) // self.classes

    def leftmost(self, coded: bytes, end: int, low: int) -> int:
        """Of an automaton that reads backward: the least place from low on where a match begins that ends at `end`, or -1."""
        s, begin, nxt, hot = self.start, -1, self.next, self.hot
        for i in range(end - 1, low - 1, -1):
            s = nxt[s + coded[i]]
            if s < 0:
                break
            if s >= hot:
                begin = i
        return begin

    def longest(self, coded: bytes, at: int) -> int:
        """The end of the longest match that begins at `at` in class-coded text, or -1."""
        s, end, nxt, hot = self.start, -1, self.next, self.hot
        for i in range(at, len(coded)):
            s = nxt[s + coded[i]]
            if s < 0:
                break
            if s >= hot:
                end = i + 1
        return end


def _byte_classes(masks: set[int]) -> tuple[bytes, list[int]]:
    """Bytes that no mask tells apart share a class; also a byte for each class."""
    table, first, code = {}, [], bytearray(256)
    ordered = sorted(masks)
    for b in range(256):
        key = tuple(m >> b & 1 for m in ordered)
        if key not in table:
            table[key] = len(table)
            first.append(b)
        code[b] = table[key]
    return bytes(code), first


def _backward(tree):
    """The tree of the same texts, each read from its end."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return (kind, _backward(tree[1]), *tree[2:])
    return (kind, [_backward(x) for x in (tree[1][::-1] if kind == "cat" else tree[1])])


def compile_dfa(patterns: list[str], search: bool, classes: bytes | None = None, finer: list[str] | None = None, backward: bool = False) -> Dfa:
    """search: matches may begin at any byte. classes: a byte coding to share; finer: patterns that are to share this one's. backward: texts are read from their ends."""
    nfa, ends = _Nfa(), {}
    start = nfa.state()
    if search:
        nfa.eps[start].append(loop := nfa.state())
        nfa.arc[loop] = (ANY, start)
    for k, pattern in enumerate(patterns):
        tree = _Parser(pattern).parse()
        ends[nfa.add(_backward(tree) if backward else tree, nfa._after(start))] = k
    masks = {a[0] for a in nfa.arc if a}
    for pattern in finer or []:
        other = _Nfa()
        other.add(_Parser(pattern).parse(), other.state())
        masks |= {a[0] for a in other.arc if a}
    code, sample = _byte_classes(masks)
    if classes is not None:
        code, sample = classes, [classes.index(c) for c in range(max(classes) + 1)]
    width = len(sample)

    ids = {nfa.closure([start]): 0}
    order, rows = list(ids), []
    for group in order:
        row = []
        arcs = [nfa.arc[x] for x in group if nfa.arc[x]]
        for b in sample:
            to = nfa.closure([t for m, t in arcs if m >> b & 1])
            if not to:
                row.append(-1)
                continue
            if to not in ids:
                ids[to] = len(ids)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows, dtype=np.int64)
    marks = [tuple(sorted(ends[x] for x in group if x in ends)) for group in order]

    kinds = {m: i for i, m in enumerate(sorted(set(marks)))}
    label = np.array([kinds[m] for m in marks])
    while True:
        seen = np.where(table < 0, -1, label[table])
        _, new = np.unique(np.column_stack([label, seen]), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == label.max():
            break
        label = new
    # Accepting states get the highest numbers, so that one comparison finds them; the start state is 0 if it does not accept.
    groups = sorted(set(label.tolist()), key=lambda g: (bool(marks[int(np.argmax(label == g))]), g != label[0]))
    rank = {g: i for i, g in enumerate(groups)}
    hot = sum(not marks[int(np.argmax(label == g))] for g in groups)
    flat: list[int] = []
    accepts = {}
    for g in groups:
        one = int(np.argmax(label == g))
        flat += [rank[int(label[t])] * width if t >= 0 else -width for t in table[one]]
        if marks[one]:
            accepts[rank[g] * width] = marks[one]
    return Dfa(code, width, flat, hot * width, accepts, rank[int(label[0])] * width)
