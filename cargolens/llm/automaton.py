"""Regular expressions compiled to one minimal byte automaton.

A rule's expression becomes a small nondeterministic automaton; all rules together are made
deterministic by subset construction and minimised by partition refinement. The result is
plain transition arrays over byte classes, a few hundred kilobytes for dozens of rules, that
any task can hold.

Expressions know literals, classes, groups, ``|``, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``
over bytes. They are for rule tables that we write, so anything else is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    """Recursive descent to tuples: ("set", frozenset), ("cat", ...), ("alt", ...), ("rep", x, lo, hi)."""

    def __init__(self, text: str):
        self.s, self.i = text, 0

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        c = self.s[self.i]
        self.i += 1
        return c

    def alt(self):
        parts = [self.cat()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def cat(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("cat", *parts)

    def repeat(self):
        x = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                lo, _, hi = self.s[self.i : end].partition(",")
                hi = int(lo) if "," not in self.s[self.i : end] else (int(hi) if hi else None)
                self.i = end + 1
                x = ("rep", x, int(lo), hi)
            else:
                x = ("rep", x, int(c == "+"), 1 if c == "?" else None)
        return x

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def atom(self):
        c = self.take()
        if c == "(":
            if self.s[self.i : self.i + 2] == "?:":
                self.i += 2
            x = self.alt()
            if self.peek() != ")":
                raise ValueError(f"unbalanced group in {self.s!r}")
            self.i += 1
            return x
        if c == "[":
            return ("set", self.klass())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        if c in ")*+?{":
            raise ValueError(f"unexpected {c!r} in {self.s!r}")
        return ("set", frozenset([self.escape() if c == "\\" else ord(c)]))

    def klass(self) -> frozenset[int]:
        negate = self.peek() == "^"
        self.i += negate
        got: set[int] = set()
        while True:
            c = self.take()
            if c == "]":
                break
            lo = self.escape() if c == "\\" else ord(c)
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                d = self.take()
                got.update(range(lo, (self.escape() if d == "\\" else ord(d)) + 1))
            else:
                got.add(lo)
        return frozenset(range(256)) - got if negate else frozenset(got)


def parse(pattern: str):
    p = _Parser(pattern)
    tree = p.alt()
    if p.i != len(pattern):
        raise ValueError(f"trailing text in {pattern!r}")
    return tree


def any_case(tree):
    """The expression with ASCII letters in either case."""
    if tree[0] == "set":
        more = {b ^ 32 for b in tree[1] if 65 <= (b & ~32) <= 90 and b < 128}
        return ("set", tree[1] | more)
    if tree[0] == "rep":
        return ("rep", any_case(tree[1]), *tree[2:])
    return (tree[0], *(any_case(x) for x in tree[1:]))


def mirrored(tree):
    """The expression of the reversed words."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", mirrored(tree[1]), *tree[2:])
    parts = [mirrored(x) for x in tree[1:]]
    return (tree[0], *(parts[::-1] if tree[0] == "cat" else parts))


def earliest(tree):
    """The expression without what may follow the earliest end of a match: a last ``x+`` is one ``x``.

    Every match has a match of this one as its beginning. Open-ended tails would stay alive
    beside all other rules and multiply the states of a combined automaton.
    """
    if tree[0] == "rep":
        return ("rep", tree[1], tree[2], tree[2])
    if tree[0] == "cat" and len(tree) > 1:
        return (*tree[:-1], earliest(tree[-1]))
    if tree[0] == "alt":
        return ("alt", *(earliest(x) for x in tree[1:]))
    return tree


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def new(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1

    def add(self, tree, at: int) -> int:
        """Adds the expression from state ``at`` on; the state behind it."""
        kind = tree[0]
        if kind == "set":
            to = self.new()
            here = self.new()
            self.eps[at].append(here)
            self.move[here] = (tree[1], to)
            return to
        if kind == "cat":
            for x in tree[1:]:
                at = self.add(x, at)
            return at
        if kind == "alt":
            end = self.new()
            for x in tree[1:]:
                first = self.new()
                self.eps[at].append(first)
                self.eps[self.add(x, first)].append(end)
            return end
        _, x, lo, hi = tree
        for _ in range(lo):
            at = self.add(x, at)
        if hi is None:
            loop = self.new()
            self.eps[at].append(loop)
            self.eps[self.add(x, loop)].append(loop)
            return loop
        end = self.new()
        for _ in range(hi - lo):
            self.eps[at].append(end)
            at = self.add(x, at)
        self.eps[at].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if self.move[s] is not None or not self.eps[s])


@dataclass(frozen=True)
class Dfa:
    """``step[state * classes + classes_of[byte]]`` is the next state times ``classes``.

    States are numbered so that those with an accepting rule come last, from ``accepting``
    on (also times ``classes``); ``rules[i]`` are the rules that end in the i-th of these.
    State ``dead`` (or -1) has no way to any match.
    """

    classes: int
    class_of: bytes
    step: list[int]
    start: int
    accepting: int
    rules: list[tuple[int, ...]]
    dead: int


def compile_dfa(trees: list, search: bool) -> Dfa:
    """One automaton for all expressions; with ``search``, a match may start at any byte."""
    nfa = _Nfa()
    root = nfa.new()
    final: dict[int, int] = {}
    for i, tree in enumerate(trees):
        first = nfa.new()
        nfa.eps[root].append(first)
        end = nfa.new()
        nfa.eps[nfa.add(tree, first)].append(end)
        final[end] = i
    # bytes that no expression tells apart are one class
    sets = list({m[0] for m in nfa.move if m is not None})
    keys: dict[tuple[bool, ...], int] = {}
    class_of = bytes(keys.setdefault(tuple(b in s for s in sets), len(keys)) for b in range(256))
    n_cls = len(keys)
    member = [class_of.index(c) for c in range(n_cls)]
    in_set = {s: [c for c in range(n_cls) if member[c] in s] for s in sets}
    begin = nfa.closure([root])
    ids, todo, rows = {begin: 0}, [begin], []
    while todo:
        state = todo.pop(0)
        targets: list[set[int]] = [set() for _ in range(n_cls)]
        for s in state:
            if nfa.move[s] is not None:
                for c in in_set[nfa.move[s][0]]:
                    targets[c].add(nfa.move[s][1])
        row = []
        for t in targets:
            to = nfa.closure(t) | (begin if search else frozenset())
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows, dtype=np.int64)
    accept = [tuple(sorted({final[s] for s in st if s in final})) for st in ids]
    # minimisation: split blocks until all members of a block step to the same blocks
    kinds = {a: i for i, a in enumerate(dict.fromkeys(accept))}
    block = np.array([kinds[a] for a in accept])
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    n = int(block.max()) + 1
    first_of = np.array([int(np.flatnonzero(block == b)[0]) for b in range(n)])
    order = sorted(range(n), key=lambda b: (bool(accept[first_of[b]]), b))
    number = np.empty(n, dtype=np.int64)
    number[order] = np.arange(n)
    small = number[block[table[first_of[order]]]]
    quiet = sum(not accept[first_of[b]] for b in order)
    loops = [i for i in range(quiet) if (small[i] == i).all()]
    return Dfa(
        classes=n_cls,
        class_of=class_of,
        step=(small * n_cls).ravel().tolist(),
        start=int(number[block[0]]) * n_cls,
        accepting=quiet * n_cls,
        rules=[accept[first_of[b]] for b in order[quiet:]],
        dead=loops[0] * n_cls if loops else -1,
    )


def longest(dfa: Dfa, data: bytes, path: range) -> int:
    """Bytes in the longest match that begins with the first byte on the path, or -1."""
    state, best, n = dfa.start, -1, 0
    step, class_of, accepting, dead = dfa.step, dfa.class_of, dfa.accepting, dfa.dead
    if state >= accepting:
        best = 0
    for i in path:
        state = step[state + class_of[data[i]]]
        n += 1
        if state >= accepting:
            best = n
        elif state == dead:
            break
    return best
