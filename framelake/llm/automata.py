"""Regular expressions over bytes as one minimal deterministic automaton.

A rule is a head (a regex) and a tail (a class of bytes, at least so many in a
row).  Rules are compiled together: subset construction over classes of bytes
that no rule tells apart, then minimisation by partition refinement.  The result
is an array of transitions and a mask of rules for each state, so that one pass
over the bytes watches for all rules at once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: No text in UTF-8 holds this byte and no rule may: it ends texts that lie side by side.
END = 0xFF
#: Bytes of a chunk that is scanned at once, and the lanes that it is cut into.
CHUNK_BYTES = 1 << 21
LANES = 4096


@dataclass(frozen=True)
class Rule:
    """``head`` (a regex), then bytes of the class ``tail``: as many as there are, ``least`` or more."""

    kind: str
    head: str
    tail: str
    least: int


class Net:
    """A non-deterministic automaton: steps (class of bytes -> state) and free moves."""

    def __init__(self):
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def reach(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


class Regex:
    """Adds a regex to a net: literals, escapes, classes, groups, ``(?i:...)``, ``|``, ``? * + {m} {m,} {m,n}``."""

    def __init__(self, text: str, net: Net):
        self.text, self.at, self.net, self.fold = text, 0, net, False

    def add(self, start: int) -> int:
        """Builds from ``start``; returns the last state."""
        end = self._either(start)
        if self.at != len(self.text):
            raise ValueError(f"unmatched ) at {self.at} of {self.text!r}")
        return end

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _take(self) -> str:
        c = self._peek()
        if not c:
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return c

    def _either(self, start: int) -> int:
        end = self.net.state()
        while True:
            begin = self.net.state()
            self.net.free[start].append(begin)
            self.net.free[self._row(begin)].append(end)
            if self._peek() != "|":
                return end
            self.at += 1

    def _row(self, state: int) -> int:
        while self._peek() not in ("", "|", ")"):
            state = self._repeated(state)
        return state

    def _repeated(self, state: int) -> int:
        begin = self.at
        state = self._one(state)
        atom, fold = self.text[begin : self.at], self.fold
        c = self._peek()
        if c not in ("?", "*", "+", "{"):
            return state
        self.at += 1
        low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
        if c == "{":
            close = self.text.index("}", self.at)
            low, _, most = self.text[self.at : close].partition(",")
            high = (int(most) if most else None) if "," in self.text[self.at : close] else int(low)
            low, self.at = int(low), close + 1
        # The atom built above is the first copy; the state before it is found again through a free move.
        first, copies = self._start_of[atom, begin], [state]
        again = lambda s: self._copy(atom, fold, s)
        if low == 0:
            self.net.free[first].append(state)
        if high is None:
            while len(copies) < max(low, 1):
                copies.append(again(copies[-1]))
            loop = first if len(copies) == 1 else copies[-2]
            self.net.free[copies[-1]].append(loop)
            return copies[-1] if low else self._joint(copies[-1])
        end = self.net.state()
        for k in range(max(low, 1), high + 1):
            while len(copies) < k:
                copies.append(again(copies[-1]))
            self.net.free[copies[-1]].append(end)
        if low == 0:
            self.net.free[first].append(end)
        return end

    def _joint(self, state: int) -> int:
        end = self.net.state()
        self.net.free[state].append(end)
        return end

    def _copy(self, atom: str, fold: bool, state: int) -> int:
        part = Regex(atom, self.net)
        part.fold = fold
        return part._one(self._joint(state))

    @property
    def _start_of(self) -> dict:
        return self.__dict__.setdefault("_starts", {})

    def _one(self, state: int) -> int:
        begin = self.at
        start = self._joint(state)
        c = self._take()
        if c == "(":
            was = self.fold
            if self.text.startswith("?i:", self.at):
                self.fold, self.at = True, self.at + 3
            elif self.text.startswith("?:", self.at):
                self.at += 2
            end = self._either(start)
            if self._take() != ")":
                raise ValueError(f"no ) in {self.text!r}")
            self.fold = was
        else:
            self.at = begin
            end = self.net.state()
            self.net.steps[start].append((self._bytes(), end))
        self._start_of[self.text[begin : self.at], begin] = start
        return end

    def _bytes(self) -> frozenset[int]:
        c = self._take()
        if c == "[":
            found: set[int] = set()
            if self._peek() == "^":
                raise ValueError("classes are listed, not negated")
            while self._peek() != "]":
                low = self._byte(self._take())
                high = low
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self._byte(self._take())
                found.update(range(low, high + 1))
            self.at += 1
        else:
            if c in ".^$":
                raise ValueError(f"{c} is not supported")
            found = {self._byte(c)}
        if self.fold:
            found |= {b ^ 32 for b in found if chr(b).isalpha()}
        return frozenset(found)

    def _byte(self, c: str) -> int:
        if c == "\\":
            c = self._take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            if c.isalnum():
                raise ValueError(f"\\{c} is not supported")
        if ord(c) > 127:
            raise ValueError("rules are written in ASCII")
        return ord(c)


class Automaton:
    """A minimal deterministic automaton: ``flat[state + class]`` is the next state; states are multiples of the number of classes."""

    def __init__(self, table: np.ndarray, class_of: np.ndarray, accept: np.ndarray, dead: int):
        self.width = table.shape[1]
        self.class_of = class_of
        self.flat = (table * self.width).astype(np.int32).reshape(-1)
        self.mask = np.repeat(accept, self.width)  # by the same multiples
        self.dead = dead * self.width
        self._next: list[int] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_next": None}

    @property
    def states(self) -> int:
        return len(self.flat) // self.width

    def _rows(self, chunk: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """The state after each byte of a chunk, when ``state`` is the one before it.

        The chunk is cut into lanes that advance together, each from the first
        state.  Where the lane before ends in another one, the lane's states are
        mended byte by byte until they are what they were: automata forget soon.
        """
        lanes = max(1, min(LANES, len(chunk) // 256))
        long = -(-len(chunk) // lanes)
        padded = np.full(lanes * long, END, dtype=np.uint8)
        padded[: len(chunk)] = chunk
        kinds = np.ascontiguousarray(self.class_of[padded].reshape(lanes, long).T)
        out = np.empty((long, lanes), dtype=np.int32)
        now = np.zeros(lanes, dtype=np.int32)
        now[0] = state
        for i in range(long):
            now = self.flat[now + kinds[i]]
            out[i] = now
        if self._next is None:
            self._next = self.flat.tolist()
        follow = self._next
        for j in range(1, lanes):
            true = int(out[-1, j - 1])
            if true:
                for i, (kind, was) in enumerate(zip(kinds[:, j].tolist(), out[:, j].tolist())):
                    true = follow[true + kind]
                    if true == was:
                        break
                    out[i, j] = true
        rows = out.T.reshape(-1)[: len(chunk)]
        return rows, int(rows[-1])

    def hits(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after which some rule is fulfilled, and the masks of those rules."""
        at, masks, state = [], [], 0
        for lo in range(0, len(buf), CHUNK_BYTES):
            rows, state = self._rows(buf[lo : lo + CHUNK_BYTES], state)
            mask = self.mask[rows]
            here = np.flatnonzero(mask)
            at.append(here + lo)
            masks.append(mask[here])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate(masks)

    def longest(self, raw: bytes, start: int) -> int:
        """The end of the longest match that begins at ``start``; -1 if there is none."""
        if self._next is None:
            self._next = self.flat.tolist()
        follow, kinds, mask, state, end = self._next, self.class_of, self.mask, 0, -1
        for i in range(start, len(raw)):
            state = follow[state + int(kinds[raw[i]])]
            if state == self.dead:
                break
            if mask[state]:
                end = i + 1
        return end


def _classes(sets: Iterable[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """Bytes that all sets treat alike share a class; also one byte of each class."""
    seen: dict[tuple, int] = {}
    sets = list(dict.fromkeys(sets))
    class_of = np.array([seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)], dtype=np.uint8)
    return class_of, [int(np.flatnonzero(class_of == k)[0]) for k in range(len(seen))]


def minimal(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States that no further bytes tell apart become one (partition refinement); state 0 stays the first."""
    label = np.unique(accept, return_inverse=True)[1]
    count = label.max() + 1
    while True:
        _, label = np.unique(np.column_stack((label, label[table])), axis=0, return_inverse=True)
        label = label.reshape(-1)
        if label.max() + 1 == count:
            break
        count = label.max() + 1
    first = np.full(count, len(label))
    np.minimum.at(first, label, np.arange(len(label)))
    order = np.argsort(first)
    number = np.empty(count, dtype=np.int64)
    number[order] = np.arange(count)
    keep = first[order]
    return number[label[table[keep]]], accept[keep]


def compiled(rules: list[Rule], tails: list[int], anywhere: bool, backward: bool = False, once: bool = False) -> Automaton:
    """The rules as one automaton, each with so many bytes of its tail at least.

    Tails of several rules can be under way at once, and then their counts
    multiply to states: compile long tails alone, or one of them with others' heads.
    ``anywhere``: matches may begin at any byte.  ``backward``: reads texts from
    their end, and is fulfilled where a match begins.  ``once``: is fulfilled when a
    tail has just enough bytes, and then forgets it, which saves most states.
    """
    net = Net()
    begins, accepts, chains = [], [], []
    for rule, least in zip(rules, tails):
        begin = net.state()
        state = Regex(rule.head, net).add(begin)
        tail = Regex(rule.tail, Net())._bytes()
        chain = []
        for _ in range(least):
            step = net.state()
            net.steps[state].append((tail, step))
            state = step
            chain.append(step)
        if not once:
            net.steps[state].append((tail, state))
        begins.append(begin)
        accepts.append(state)
        chains.append(chain)
    if backward:
        back = Net()
        for _ in net.steps:
            back.state()
        for s in range(len(net.steps)):
            for kinds, to in net.steps[s]:
                back.steps[to].append((kinds, s))
            for to in net.free[s]:
                back.free[to].append(s)
        net, begins, accepts, chains = back, accepts, begins, []
    if any(END in kinds for steps in net.steps for kinds, _ in steps):
        raise ValueError("no rule may hold byte 255")
    class_of, samples = _classes(kinds for steps in net.steps for kinds, _ in steps)

    def settled(states: frozenset[int]) -> frozenset[int]:
        """A tail that has more bytes is as good as the same tail with fewer, which go: else their sets would multiply."""
        drop = set()
        for chain in chains:
            held = [s for s in chain if s in states]
            drop.update(held[:-1])
        return states - drop

    root = net.reach(begins)
    number, todo, rows, masks = {settled(root): 0}, [settled(root)], [], []
    reached = [net.reach([s]) for s in range(len(net.steps))]
    while len(rows) < len(todo):
        states = todo[len(rows)]
        masks.append(sum(1 << k for k, a in enumerate(accepts) if a in states))
        moves = [(kinds, reached[to]) for s in states for kinds, to in net.steps[s]]
        row = []
        for byte in samples:
            after = frozenset().union(*[found for kinds, found in moves if byte in kinds], root if anywhere else ())
            after = settled(after)
            k = number.get(after)
            if k is None:
                k = number[after] = len(todo)
                todo.append(after)
            row.append(k)
        rows.append(row)
    table, accept = minimal(np.array(rows, dtype=np.int64), np.array(masks, dtype=np.int64))
    own = np.arange(len(table))
    dead = np.flatnonzero((table == own[:, None]).all(axis=1) & (accept == 0))
    return Automaton(table, class_of, accept, int(dead[0]) if len(dead) and not anywhere else -1)
