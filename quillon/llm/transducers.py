"""Weighted finite-state transducers in the tropical semiring: costs add along a path, the least path counts.

Every arc reads one symbol and writes one, so a composition needs no rules for empty symbols, and
an input of n symbols has paths of n arcs.  A transducer that isn't written out arc by arc may be
any object with `start`, `leaving(state, symbol)` and `ending(state)`; `shortest` asks for no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

INF = math.inf


@dataclass
class Transducer:
    """Arcs by state and symbol read: (symbol written, cost, next state).  States without an entry in finals don't end a path."""

    start: object = 0
    finals: dict = field(default_factory=dict)
    arcs: dict = field(default_factory=dict)

    def arc(self, state, read: str, written: str, cost: float, to) -> None:
        self.arcs.setdefault(state, {}).setdefault(read, []).append((written, cost, to))

    def leaving(self, state, read: str) -> list[tuple[str, float, object]]:
        return self.arcs.get(state, {}).get(read, [])

    def ending(self, state) -> float:
        return self.finals.get(state, INF)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that reads what a reads and writes what b makes of a's output; only states that can be reached."""
    out, todo, seen = Transducer(start=(a.start, b.start)), [(a.start, b.start)], {(a.start, b.start)}
    while todo:
        state = todo.pop()
        left, right = state
        if a.ending(left) + b.ending(right) < INF:
            out.finals[state] = a.ending(left) + b.ending(right)
        for read, found in a.arcs.get(left, {}).items():
            for between, cost, to in found:
                for written, more, to2 in b.leaving(right, between):
                    out.arc(state, read, written, cost + more, (to, to2))
                    if (to, to2) not in seen:
                        seen.add((to, to2))
                        todo.append((to, to2))
    return out


def numbered(t: Transducer) -> Transducer:
    """The same transducer with the states 0, 1, ..., and of arcs that differ in nothing but their cost the cheapest."""
    number = {t.start: 0}
    for state, by in t.arcs.items():
        number.setdefault(state, len(number))
        for found in by.values():
            for _, _, to in found:
                number.setdefault(to, len(number))
    out = Transducer(start=0, finals={number[s]: c for s, c in t.finals.items() if s in number})
    for state, by in t.arcs.items():
        for read, found in by.items():
            best: dict = {}
            for written, cost, to in found:
                best[written, number[to]] = min(cost, best.get((written, number[to]), INF))
            for (written, to), cost in best.items():
                out.arc(number[state], read, written, cost, to)
    return out


def shortest(t, symbols: Iterable[str]) -> tuple[float, list[str] | None]:
    """Cost and output of the least path that reads the symbols; (infinite, None) if there is none.  The path found first wins a tie."""
    now: dict = {t.start: (0.0, None)}
    for symbol in symbols:
        after: dict = {}
        for state, (cost, back) in now.items():
            for written, more, to in t.leaving(state, symbol):
                if cost + more < after.get(to, (INF,))[0]:
                    after[to] = (cost + more, (written, back))
        now = after
    best, back = INF, None
    for state, (cost, found) in now.items():
        if cost + t.ending(state) < best:
            best, back = cost + t.ending(state), (found,)
    if back is None:
        return INF, None
    out, link = [], back[0]
    while link:
        out.append(link[0])
        link = link[1]
    return best, out[::-1]


def paths(t, symbols: list[str]) -> Iterator[tuple[float, list[str]]]:
    """Cost and output of every path, for tests."""

    def walk(state, at: int, cost: float, out: list[str]):
        if at == len(symbols):
            if cost + t.ending(state) < INF:
                yield cost + t.ending(state), out
            return
        for written, more, to in t.leaving(state, symbols[at]):
            yield from walk(to, at + 1, cost + more, [*out, written])

    yield from walk(t.start, 0, 0.0, [])
