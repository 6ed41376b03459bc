"""Rules compiled into one deterministic automaton over bytes.

A rule is a prefix pattern followed by one or more bytes of a tail class; it counts
as found from `least` tail bytes on, and a shorter match uses up its bytes all the same. Each rule becomes
a nondeterministic automaton; the subset construction runs over all rules at once and keeps,
per rule, the sets of positions in the order of their starts, so that the
leftmost match wins and what began inside it is cut off. The result is minimised and
stored as one transition array over byte classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rule:
    kind: str
    prefix: str
    tail: str
    least: int
    any_case: bool = False      # ASCII letters of the prefix


class _Pattern:
    """Parser of the patterns used here: literals, \\xHH, classes, groups, |, ?, *, + and {n}."""

    def __init__(self, text: str, any_case: bool):
        self.text, self.at, self.any_case = text, 0, any_case
        self.edges: list[list] = []         # per state: (byte set or None, next)

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def alternatives(self):
        ends = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            ends.append(self.sequence())
        first, last = self.state(), self.state()
        for a, b in ends:
            self.edges[first].append((None, a))
            self.edges[b].append((None, last))
        return first, last

    def peek(self):
        return self.text[self.at] if self.at < len(self.text) else ""

    def sequence(self):
        first = last = self.state()
        while self.peek() not in ("", "|", ")"):
            begin = self.at
            a, b = self.piece()
            if self.peek() == "{":
                end = self.text.index("}", self.at)
                times, stop = int(self.text[self.at + 1:end]), end + 1
                for _ in range(times - 1):
                    self.edges[last].append((None, a))
                    last = b
                    self.at = begin
                    a, b = self.piece()
                self.at = stop
            elif self.peek() in ("?", "*", "+") and self.peek():
                sign = self.text[self.at]
                self.at += 1
                if sign in "*+":
                    self.edges[b].append((None, a))
                if sign in "?*":
                    self.edges[a].append((None, b))
            self.edges[last].append((None, a))
            last = b
        return first, last

    def piece(self):
        if self.peek() == "(":
            self.at += 1
            found = self.alternatives()
            self.at += 1
            return found
        chosen = self.klass() if self.peek() == "[" else {self.char()}
        a, b, c = self.state(), self.state(), self.state()      # a and c keep loops apart from neighbours
        self.edges[a].append((self.cased(chosen), b))
        self.edges[b].append((None, c))
        return a, c

    def cased(self, chosen):
        return frozenset(x for c in chosen for x in ((c, c ^ 32) if self.any_case and chr(c).isalpha() else (c,)))

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c != "x":
            return ord(c)
        self.at += 2
        return int(self.text[self.at - 2:self.at], 16)

    def klass(self) -> set[int]:
        self.at += 1
        found = set()
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                found.update(range(low, self.char() + 1))
            else:
                found.add(low)
        self.at += 1
        return found


class _Machine:
    """One rule without epsilon moves: states reached by a byte, entry states, and tail counts."""

    def __init__(self, rule: Rule):
        head = _Pattern(rule.prefix, rule.any_case)
        first, last = head.alternatives()
        tail = frozenset(_Pattern(rule.tail, False).klass()) if rule.tail[0] == "[" else frozenset({_Pattern(rule.tail, False).char()})
        self.edges = head.edges
        self.count = {}             # tail state: bytes of the tail so far
        for k in range(1, rule.least + 1):
            here = len(self.edges)
            self.edges.append([])
            self.edges[last].append((tail, here))
            self.count[here] = k
            last = here
        self.edges[last].append((tail, last))
        self.least = rule.least
        self.entry = frozenset({first})
        self.start = self.closed({first})

    def closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for byte, to in self.edges[todo.pop()]:
                if byte is None and to not in found:
                    found.add(to)
                    todo.append(to)
        return frozenset(s for s in found if s in self.count or any(b is not None for b, _ in self.edges[s]))

    def step(self, states, byte) -> frozenset:
        return self.closed({to for s in states for b, to in self.edges[s] if b is not None and byte in b})

    def move(self, threads: tuple, byte: int) -> tuple:
        """Sets of positions by start, earliest first; nothing begins inside a match."""
        found, seen = [], frozenset()
        inside = any(s in self.count for t in threads for s in t)
        for states in threads if inside else (*threads, self.start):
            after = self.step(states, byte) - seen
            if after:
                found.append(after)
                seen |= after
                if any(s in self.count for s in after):
                    break
        if inside and not found:        # the match is over; this byte may begin the next
            after = self.step(self.start, byte)
            found = [after] if after else []
        return tuple(found)

    def status(self, threads) -> int:
        """0: no match, 1: too short, 2: found."""
        most = max((self.count.get(s, 0) for t in threads for s in t), default=0)
        return 2 if most >= self.least else 1 if most else 0


class Automaton:
    """The combined automaton: `move[state * classes + class]`, `inside` and `found` bits per state."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        machines = [_Machine(r) for r in rules]
        sets = sorted({b for m in machines for e in m.edges for b, _ in e if b is not None}, key=sorted)
        prints = [tuple(byte in s for s in sets) for byte in range(256)]
        kinds = {p: k for k, p in enumerate(dict.fromkeys(prints))}
        self.klass = np.array([kinds[p] for p in prints], np.int32)
        example = [prints.index(p) for p in kinds]
        empty = tuple(() for _ in machines)
        index, todo, table = {empty: 0}, [empty], []
        parts: list[dict] = [{} for _ in machines]      # each rule's own moves, computed once
        while todo:
            state, todo = todo[0], todo[1:]
            row = []
            for byte in example:
                after = []
                for k, (machine, threads) in enumerate(zip(machines, state)):
                    if (threads, byte) not in parts[k]:
                        parts[k][threads, byte] = machine.move(threads, byte)
                    after.append(parts[k][threads, byte])
                after = tuple(after)
                if after not in index:
                    index[after] = len(index)
                    todo.append(after)
                row.append(index[after])
            table.append(row)
        status = np.array([[m.status(t) for m, t in zip(machines, state)] for state in index])
        self._minimise(np.array(table, np.int32), status)
        # after such a byte the state is the same whatever came before: texts may be cut there
        self.resets = np.array([len(np.unique(self.table[:, c])) == 1 for c in self.klass])

    def _minimise(self, table, status):
        """Merge states that no continuation tells apart (partition refinement)."""
        _, block = np.unique(status, axis=0, return_inverse=True)
        block = block.ravel()
        while True:
            _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        _, first = np.unique(block, return_index=True)
        self.table = block[table[first]].astype(np.int32)
        self.initial = int(block[0])
        bits = 1 << np.arange(len(self.rules))
        self.inside = ((status[first] > 0) * bits).sum(axis=1).astype(np.int32)
        self.found = ((status[first] > 1) * bits).sum(axis=1).astype(np.int32)

    def states(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The state after every byte. `cuts` are where texts begin; pieces between resets run side by side."""
        begins = np.zeros(len(data) + 1, bool)
        begins[cuts] = True
        begins[np.flatnonzero(self.resets[data]) + 1] = True
        # a piece that follows a reset inside a text starts from the one state that reset leads to
        start = np.flatnonzero(begins[:-1])
        length = np.diff(np.append(start, len(data)))
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        klass, flat, width = self.klass[data], self.table.ravel(), self.table.shape[1]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[cuts] = True
        before = np.where(fresh[start] | (start == 0), self.initial,
                          self.table[0, klass[np.maximum(start - 1, 0)]]).astype(np.int32)
        states = np.empty(len(data), np.int32)
        active = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
        for t, n in enumerate(active.tolist()):
            at = start[:n] + t
            before = flat[before[:n] * width + klass[at]]
            states[at] = before
        return states

    def _reverse(self):
        """Each rule's machine with all moves turned round, for finding starts."""
        machines = []
        for rule in self.rules:
            machine = _Machine(rule)
            back: dict[int, list] = {}
            for s, edges in enumerate(machine.edges):
                for byte, to in edges:
                    back.setdefault(to, []).append((byte, s))
            machines.append((machine, back))
        return machines

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """(rule, start, end) in bytes of every match found, by rule and start; `offsets` bound the texts."""
        if not len(data):
            return []
        states = self.states(data, offsets[:-1][offsets[:-1] < len(data)])
        found, inside = self.found[states], self.inside[states]
        heads = np.zeros(len(data) + 1, bool)
        heads[offsets] = True
        result, machines = [], None
        for k in range(len(self.rules)):
            hit = np.flatnonzero(found & (1 << k))
            if not len(hit):
                continue
            machines = machines or self._reverse()
            follows = np.concatenate((np.diff(hit) == 1, [False]))
            ends = hit[~(follows & ~heads[hit + 1])] + 1
            used = np.flatnonzero(inside & (1 << k))
            for end in ends.tolist():
                # the bytes of this match's tail, then back to the match before it
                run = np.searchsorted(used, end - 1)
                low = offsets[np.searchsorted(offsets, end - 1, "right") - 1]
                first = run
                while first > 0 and used[first - 1] == used[first] - 1 and used[first] > low:
                    first -= 1
                floor = max(int(low), int(used[first - 1]) + 1 if first > 0 else 0)
                result.append((k, self._start(machines[k], data, floor, end), end))
        return result

    @staticmethod
    def _start(machine, data, floor, end):
        machine, back = machine
        now = {s for s, c in machine.count.items() if c == machine.least}
        start = end
        for at in range(end - 1, floor - 1, -1):
            byte, after = int(data[at]), set()
            todo = list(now)
            seen = set(now)
            while todo:
                for b, s in back.get(todo.pop(), ()):
                    if b is None and s not in seen:
                        seen.add(s)
                        todo.append(s)
                    elif b is not None and byte in b:
                        after.add(s)
            if not after:
                break
            now = after
            # a start if the entry is reached without further bytes
            todo, seen = list(now), set(now)
            while todo:
                for b, s in back.get(todo.pop(), ()):
                    if b is None and s not in seen:
                        seen.add(s)
                        todo.append(s)
            if seen & (machine.start | machine.entry):
                start = at
        return start
