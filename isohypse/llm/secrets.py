"""Secret scans with one combined deterministic automaton.

The rules' regular expressions (bytes, no anchors or captures) are parsed, turned into
nondeterministic automata, joined, made deterministic by subset construction and minimised
by partition refinement.  One pass over a text's bytes runs all rules at once and reports
where a rule's match can end; the match itself is then delimited by the rule's own two
small automata, backwards for the leftmost start and forwards for the longest end.

Cases: a null text is empty; a very long one is scanned whole, in time linear in its length;
repeated rows are judged alike; spans that begin together go by kind; an empty table gives
an empty table; offsets are code points; columns that the operator doesn't name are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import lists, map_batches


# ---- regular expressions -> syntax trees -------------------------------------------------


def _bytes_of(text: str) -> frozenset[int]:
    return frozenset(text.encode("latin-1"))


class _Parser:
    """Literals, classes, groups, |, ?, *, +, {m}, {m,} and {m,n}."""

    def __init__(self, pattern: str, any_case: bool) -> None:
        self.p, self.i, self.any_case = pattern, 0, any_case

    def _more(self) -> bool:
        return self.i < len(self.p)

    def _set(self, own: set[int]):
        if self.any_case:
            own = own | {b ^ 32 for b in own if chr(b).isascii() and chr(b).isalpha()}
        return ("set", frozenset(own))

    def _char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def alternatives(self):
        options = [self.sequence()]
        while self._more() and self.p[self.i] == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self._more() and self.p[self.i] not in "|)":
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        node = self.atom()
        while self._more() and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                least, most = int(low), int(high) if high else None if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tail = [("star", node)] if most is None else [("maybe", node)] * (most - least)
            node = ("seq", [node] * least + tail)
        return node

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 3 if self.p[self.i : self.i + 3] == "(?:" else 1
            node = self.alternatives()
            self.i += 1
            return node
        if c == "[":
            self.i += 1
            own: set[int] = set()
            while self.p[self.i] != "]":
                low = self._char()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    own |= set(range(low, self._char() + 1))
                else:
                    own.add(low)
            self.i += 1
            return self._set(own)
        return self._set({self._char()})


def _reversed(node):
    kind, body = node
    if kind == "set":
        return node
    if kind in ("star", "maybe"):
        return kind, _reversed(body)
    return kind, [_reversed(x) for x in (body[::-1] if kind == "seq" else body)]


# ---- syntax trees -> automata ------------------------------------------------------------


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.on: list[list[tuple[frozenset[int], int]]] = []
        self.ends: dict[int, int] = {}  # state -> rule

    def state(self) -> int:
        self.empty.append([])
        self.on.append([])
        return len(self.empty) - 1

    def add(self, node, at: int) -> int:
        """Adds a tree that begins in state `at`; returns its last state."""
        kind, body = node
        if kind == "set":
            to = self.state()
            self.on[at].append((body, to))
            return to
        if kind == "seq":
            for x in body:
                at = self.add(x, at)
            return at
        to = self.state()
        if kind == "or":
            for x in body:
                start = self.state()
                self.empty[at].append(start)
                self.empty[self.add(x, start)].append(to)
            return to
        start = self.state()
        self.empty[at] += [start, to]
        last = self.add(body, start)
        self.empty[last].append(to)
        if kind == "star":
            self.empty[last].append(start)
        return to

    def closed(self, states: set[int]) -> frozenset[int]:
        stack, seen = list(states), set(states)
        while stack:
            for x in self.empty[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """next[256 * state + byte]; accepts[state]: bits of the rules; state 0 is the start."""

    next: list[int]
    accepts: list[int]
    dead: int  # the state that nothing leaves, or -1


def _determined(nfa: _Nfa, start: int) -> Automaton:
    """Subset construction."""
    first = nfa.closed({start})
    number, todo, rows, accepts = {first: 0}, [first], [], []
    while todo:
        own = todo.pop(0)
        by_byte: list[set[int]] = [set() for _ in range(256)]
        for s in own:
            for on, to in nfa.on[s]:
                for b in on:
                    by_byte[b].add(to)
        made: dict[frozenset[int], frozenset[int]] = {}
        row = []
        for targets in by_byte:
            key = frozenset(targets)
            if key not in made:
                made[key] = nfa.closed(targets)
            to = made[key]
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
        accepts.append(sum({1 << nfa.ends[s] for s in own if s in nfa.ends}))
    return _minimised(rows, accepts)


def _minimised(rows: list[list[int]], accepts: list[int]) -> Automaton:
    """Partition refinement: states that no input tells apart become one."""
    kinds: dict = {}
    block = [kinds.setdefault(a, len(kinds)) for a in accepts]
    while True:
        kinds = {}
        finer = [kinds.setdefault((block[s], *[block[t] for t in row]), len(kinds)) for s, row in enumerate(rows)]
        if len(kinds) == len(set(block)):
            break
        block = finer
    order: dict[int, int] = {}
    for s in range(len(rows)):  # the start keeps number 0
        order.setdefault(block[s], len(order))
    table, marks = [0] * (256 * len(order)), [0] * len(order)
    for s, row in enumerate(rows):
        n = order[block[s]]
        marks[n] = accepts[s]
        table[256 * n : 256 * n + 256] = [order[block[t]] for t in row]
    dead = next((s for s in range(len(order)) if not marks[s] and set(table[256 * s : 256 * s + 256]) == {s}), -1)
    return Automaton(table, marks, dead)


# ---- rules -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A kind with its expression.

    `trigger` is an expression for the shortest beginnings of matches: the joint automaton
    looks for these, as the product of long counted runs would have too many states.  What
    follows the head (see _KEY) needs `tail` bytes at least.
    """

    kind: str
    trigger: str
    pattern: str
    least: int = 0  # of the whole match, in bytes
    any_case: bool = False
    tail: int = 0


_KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The contract's three kinds come first, then the published token formats.
RULES = (
    Rule("assign", _KEY + "[A-Za-z0-9+/_.=-]", _KEY + "[A-Za-z0-9+/_.=-]+", any_case=True, tail=12),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]{16}", "[0-9a-f]+", least=16),
    Rule("github", "gh[pousr]_", "gh[pousr]_[A-Za-z0-9]{36}[A-Za-z0-9]*"),
    Rule("slack", "xox[abprs]-", "xox[abprs]-[A-Za-z0-9]{8}[A-Za-z0-9-]*"),
    Rule("stripe", "[rs]k_(live|test)_", "[rs]k_(live|test)_[A-Za-z0-9]{16}[A-Za-z0-9]*"),
    Rule("google", "AIza", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ", r"eyJ[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*\.[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*"),
    Rule("key", "-----BEGIN ", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
)


class Scanner:
    """All rules' automata."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        trees = [(_Parser(r.trigger, r.any_case).alternatives(), _Parser(r.pattern, r.any_case).alternatives()) for r in rules]
        joint = _Nfa()
        begin = joint.state()
        joint.on[begin].append((frozenset(range(256)), begin))  # a match can begin anywhere
        self.forward, self.backward = [], []
        for k, (trigger, whole) in enumerate(trees):
            start = joint.state()
            joint.empty[begin].append(start)
            joint.ends[joint.add(trigger, start)] = k
            for own, shape in ((self.forward, whole), (self.backward, _reversed(trigger))):
                one = _Nfa()
                first = one.state()
                one.ends[one.add(shape, first)] = 0
                own.append(_determined(one, first))
        self.joint = _determined(joint, begin)
        head = _Nfa()
        first = head.state()
        head.ends[head.add(_Parser(_KEY, True).alternatives(), first)] = 0
        self.head = _determined(head, first)
        # for the pass itself: a row for each state, with the next row for each byte, then the rules
        n = len(self.joint.accepts)
        self.rows: list[list] = [[] for _ in range(n)]
        for s in range(n):
            self.rows[s] += [*(self.rows[t] for t in self.joint.next[256 * s : 256 * s + 256]), self.joint.accepts[s]]

    @staticmethod
    def _longest(a: Automaton, data: bytes, at: int, step: int, stop: int) -> int:
        """The last index at which an automaton that starts before data[at] accepts, or -1."""
        s, last = 0, -1
        while at != stop:
            s = a.next[256 * s + data[at]]
            if s == a.dead:
                break
            if a.accepts[s]:
                last = at
            at += step
        return last

    @staticmethod
    def _ended(a: Automaton, data: bytes, at: int, failed: list) -> int:
        """The end of the longest match from data[at] on, or 0.

        `failed` holds the place and the states of a run that failed: a run that comes to the
        same state at the same place fails too, so that many beginnings of one unfinished
        match cost no more than the text's length.
        """
        begin, known = failed or (0, ())
        s, last, own, start = 0, -1, [], at
        while at < len(data):
            s = a.next[256 * s + data[at]]
            if s == a.dead:
                break
            if a.accepts[s]:
                last = at
            elif last < 0 and 0 <= at - begin < len(known) and known[at - begin] == s:
                return 0
            own.append(s)
            at += 1
        if last < 0:
            failed[:] = [start, own]
        return last + 1

    def _passes(self, rule: Rule, data: bytes, start: int, end: int) -> bool:
        if end - start < rule.least:
            return False
        if not rule.tail:
            return True
        return end - (self._longest(self.head, data, start, 1, end) + 1) >= rule.tail

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of every match, in bytes: leftmost, longest, non-overlapping for each rule."""
        row, ends, i = self.rows[0], [], 0
        for b in data:  # the one pass
            row = row[b]
            if row[256]:
                ends.append((i, row[256]))
            i += 1
        out, over, failed = [], [0] * len(self.rules), [[] for _ in self.rules]
        for i, bits in ends:
            for k, rule in enumerate(self.rules):
                if bits >> k & 1 and i >= over[k]:
                    start = self._longest(self.backward[k], data, i, -1, over[k] - 1)
                    if start < 0:
                        continue
                    end = self._ended(self.forward[k], data, start, failed[k])
                    if not end:
                        continue
                    over[k] = end
                    if self._passes(rule, data, start, end):
                        out.append((start, k, end))
        return sorted(out)


@lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Compiled once in each Python worker."""
    return Scanner(rules)


def spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points."""
    data = (text or "").encode()
    found = scanner(rules).find(data)
    if not found or len(data) == len(text):
        return found
    out, at, chars = [], 0, 0
    points = {}
    for p in sorted({x for s, _, e in found for x in (s, e)}):
        chars += len(data[at:p].decode())
        at, points[p] = p, chars
    for s, k, e in found:
        out.append((points[s], k, points[e]))
    return out


def redact(text: str | None, rules: tuple[Rule, ...] = RULES) -> str | None:
    """The text with a mark in place of each secret."""
    if not text:
        return text
    out, at = [], 0
    for s, k, e in spans(text, rules):
        if s >= at:
            out += [text[at:s], f"<{rules[k].kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def rows(batch: pa.RecordBatch) -> dict:
        ids, texts = lists(batch, "doc_id", "text")
        out: dict = {"doc_id": ids, "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for t in texts:
            got = spans(t)
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(x[1] == k for x in got))
            line = [f"{RULES[k].kind}:{s}:{e}" for s, k, e in got]
            out["base_sha256"].append(hashlib.sha256(",".join(x for x, (_, k, _) in zip(line, got, strict=True) if k < 3).encode()).hexdigest())
            out["spans"].append(",".join(line))
        return out

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), rows, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
