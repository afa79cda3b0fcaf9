"""Secret scan with one deterministic automaton for all rules.

The heads of all rules (what precedes their first counted part, and one piece of that) become one NFA, subset
construction makes it deterministic and partition refinement minimises it into a transition array. A batch of
texts is one byte buffer, cut into stripes that advance in step: each step is one array lookup for all stripes.
Heads have a longest match, so a stripe that starts that many bytes early is in the right state when its own
bytes begin; the result is that of one pass over the bytes. Where a head ends, the whole rule is matched from
each place where that head can begin. Heads are short, so matches may begin after any byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import quoted

#: Guard of rules that a caller brings: their matches follow the start of the text or a character outside these.
TOKEN = "0-9A-Za-z_+/-"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api[_-]?key")))
#: Name -> regex. Supported: literals, classes, groups, |, ?, {m}, {m,n}, {m,}; every head must have a longest match.
#: These need no guard: a match may follow any byte, as in db_password=, "\\n-----BEGIN" or a path.
RULES = {
    "aws_access_key": "A(?:KIA|SIA)[0-9A-Z]{16}",
    "github_token": "gh[pousr]_[0-9A-Za-z]{36}",
    "gitlab_token": "glpat-[0-9A-Za-z_-]{20}",
    "google_api_key": "AIzaSy[0-9A-Za-z_-]{33}",
    "slack_token": "xox[abprs]-[0-9]{10,13}-[0-9]{10,13}-[0-9A-Za-z]{24}",
    "stripe_key": "[rs]k_live_[0-9A-Za-z]{24}",
    "private_key": "-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "assigned_secret": f"(?:{_KEYWORD}) ?[=:] ?[\"']?[0-9A-Za-z+/_-]{{16,}}(?:\\.[0-9A-Za-z+/_-]{{1,}}){{0,}}={{0,2}}",
}
STRIPE = 2048


class _Parser:
    """Regex -> tree of ("set", bytes), ("cat", [...]), ("alt", [...]), ("rep", tree, low, high or None)."""

    def __init__(self, source: str) -> None:
        self.s, self.i = source, 0

    def parse(self):
        tree = self._alt()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} in {self.s!r}")
        return tree

    def _alt(self):
        options = [self._cat()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            options.append(self._cat())
        return options[0] if len(options) == 1 else ("alt", options)

    def _cat(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self._repeat(self._atom()))
        return ("cat", parts)

    def _repeat(self, tree):
        while self.i < len(self.s):
            if self.s[self.i] == "?":
                self.i += 1
                tree = ("rep", tree, 0, 1)
            elif m := re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.s, self.i):
                self.i = m.end()
                tree = ("rep", tree, int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
            elif self.s[self.i] in "*+{":
                raise ValueError(f"{self.s!r} has no longest match")
            else:
                break
        return tree

    def _atom(self):
        c = self.s[self.i]
        if c == "(":
            self.i += 3 if self.s.startswith("(?:", self.i) else 1
            tree = self._alt()
            if self.s[self.i : self.i + 1] != ")":
                raise ValueError(f"unclosed group in {self.s!r}")
            self.i += 1
            return tree
        if c == "[":
            return self._set()
        if c in "^$.":
            raise ValueError(f"{c!r} isn't supported in {self.s!r}")
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c in "dws":
                return ("set", {"d": frozenset(range(48, 58)), "s": frozenset(b" \t\n\r\f\v"), "w": frozenset([*range(48, 58), *range(65, 91), 95, *range(97, 123)])}[c])
        return ("cat", [("set", frozenset([b])) for b in c.encode()])

    def _set(self):
        self.i += 1
        negated = self.s[self.i] == "^"
        self.i += negated
        held: set[int] = set()
        first = True
        while first or self.s[self.i] != "]":
            first = False
            self.i += self.s[self.i] == "\\"
            low = high = ord(self.s[self.i])
            if self.s[self.i + 1] == "-" and self.s[self.i + 2] != "]":
                high = ord(self.s[self.i + 2])
                self.i += 2
            self.i += 1
            held |= set(range(low, high + 1))
        self.i += 1
        return ("set", frozenset(set(range(1, 256)) - held if negated else held))


def longest(tree) -> int:
    kind = tree[0]
    if kind == "set":
        return 1
    if kind == "rep":
        if tree[3] is None and longest(tree[1]):
            raise ValueError("a rule's head has no longest match")
        return longest(tree[1]) * (tree[3] or 0)
    return (sum if kind == "cat" else max)((longest(t) for t in tree[1]), **({} if kind == "cat" else {"default": 0}))


def shortest(tree) -> int:
    kind = tree[0]
    if kind == "set":
        return 1
    if kind == "rep":
        return shortest(tree[1]) * tree[2]
    return (sum if kind == "cat" else min)((shortest(t) for t in tree[1]), **({} if kind == "cat" else {"default": 0}))


def head(tree):
    """(tree of what every match begins with, up to the first counted part and one piece of that; whether it is all)."""
    kind = tree[0]
    if kind == "set":
        return tree, True
    if kind == "rep":
        own, whole = head(tree[1])
        if tree[3] == 1:
            return ("rep", own, tree[2], 1), whole
        return (own if tree[2] else ("cat", [])), False
    if kind == "alt":
        parts = [head(t) for t in tree[1]]
        return ("alt", [t for t, _ in parts]), all(whole for _, whole in parts)
    parts = []
    for t in tree[1]:
        own, whole = head(t)
        parts.append(own)
        if not whole:
            return ("cat", parts), False
    return ("cat", parts), True


def reverse(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(t) for t in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self) -> None:
        self.moves: list[tuple[frozenset, int] | None] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append(None)
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int) -> int:
        """Adds the tree from state start on; returns its end state."""
        kind = tree[0]
        if kind == "set":
            end, own = self.state(), self.state()
            self.empty[start].append(own)
            self.moves[own] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        end = self.state()
        for n in range(tree[2] if tree[3] is None else tree[3]):
            if n >= tree[2]:
                self.empty[start].append(end)
            start = self.add(tree[1], start)
        if tree[3] is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(tree[1], loop)].append(loop)
            start = loop
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """Minimal deterministic automaton that, after each byte, names the rules with a head ending there.

    `guard` is the inside of a character class; a match never follows one of these characters.
    """

    def __init__(self, rules: dict[str, str], guard: str = TOKEN) -> None:
        self.names = list(rules)
        self.guard = _Parser(f"[{guard}]").parse()[1][0][1] if guard else frozenset()
        whole = [_Parser(p).parse() for p in rules.values()]
        trees = [own if shortest(own := head(t)[0]) else t for t in whole]
        self.reach = max([longest(t) for t in trees], default=0)
        if any(longest(t) == 0 for t in trees):
            raise ValueError("a rule matches nothing but the empty text")
        self.forward = [_Lazy(t) for t in whole]
        self.reversed = [_Lazy(reverse(t)) for t in trees]
        nfa = _Nfa()
        start = nfa.state()
        ends = {nfa.add(t, start): r for r, t in enumerate(trees)}
        root = nfa.closure([start])
        sets = sorted({m[0] for m in nfa.moves if m}, key=sorted)
        kinds: dict[tuple, int] = {}
        self.kind = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
        width = len(kinds)
        sample = [int(np.flatnonzero(self.kind == k)[0]) for k in range(width)]
        closed: dict[int, frozenset] = {}
        step = [[(k, m[1]) for k, b in enumerate(sample) if b in m[0]] if m else [] for m in nfa.moves]
        useful = lambda s: frozenset(x for x in s if nfa.moves[x] or x in ends)
        root = useful(root)
        number, order, table = {root: 0}, [root], []
        for subset in order:  # subset construction; every state also holds the start, as matches begin anywhere
            to: list[set] = [set() for _ in range(width)]
            for x in subset:
                for k, t in step[x]:
                    if t not in closed:
                        closed[t] = useful(nfa.closure([t]))
                    to[k] |= closed[t]
            row = []
            for s in to:
                s = frozenset(s | root)
                if s not in number:
                    number[s] = len(order)
                    order.append(s)
                row.append(number[s])
            table.append(row)
        self.subsets = len(order)
        table = np.array(table, np.int64)
        marks = [frozenset(ends[x] for x in s if x in ends) for s in order]
        labels = {m: i for i, m in enumerate(sorted(set(marks), key=lambda m: (len(m) > 0, sorted(m))))}
        group, count = np.array([labels[m] for m in marks]), len(labels)
        weight = np.random.default_rng(1).integers(1, 1 << 62, width, dtype=np.uint64)
        while True:  # minimisation: split groups whose members lead to different groups
            with np.errstate(over="ignore"):
                sign = ((group[table].astype(np.uint64) + np.uint64(1)) ** np.uint64(3) * weight).sum(1, dtype=np.uint64)
            _, new = np.unique(np.stack((group.astype(np.uint64), sign)), axis=1, return_inverse=True)
            new = new.reshape(-1)
            if new.max() + 1 == count:
                break
            group, count = new, int(new.max()) + 1
        member = np.zeros(count, np.int64)
        member[group] = np.arange(len(group))
        accepting = np.array([len(marks[m]) > 0 for m in member])
        place = np.empty(count, np.int64)
        place[np.argsort(accepting, kind="stable")] = np.arange(count)
        self.width, self.states = width, count
        self.first_accepting = int((~accepting).sum()) * width
        self.start = int(place[group[0]]) * width
        self.next = np.zeros(count * width, np.int32)
        self.rules_of: dict[int, frozenset] = {}
        for g in range(count):
            at = int(place[g]) * width
            self.next[at : at + width] = place[group[table[member[g]]]] * width
            self.rules_of[at] = marks[member[g]]

    def ends(self, buf: np.ndarray) -> list[tuple[int, int]]:
        """(end offset, rule) of every head in buf, in one pass."""
        if not len(buf) or not self.names:
            return []
        lead, n = self.reach, -(-len(buf) // STRIPE)
        padded = np.zeros(lead + n * STRIPE, np.uint8)
        padded[lead : lead + len(buf)] = buf
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(self.kind[padded], (n, lead + STRIPE), (STRIPE, 1)).T).astype(np.int32)
        state = np.full(n, self.start, np.int32)
        found = []
        for j in range(lead + STRIPE):
            state = self.next.take(state + steps[j])
            if j >= lead and state.max() >= self.first_accepting:
                for i in np.flatnonzero(state >= self.first_accepting):
                    found += [(int(i) * STRIPE + j - lead + 1, r) for r in self.rules_of[int(state[i])]]
        return found

    def find(self, data: bytes, ends: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(rule, from, to) of the findings in data, given its heads; overlapping matches of a rule are one finding."""
        starts = set()
        for end, rule in ends:
            lengths = self.reversed[rule].lengths(data[max(0, end - self.reach) : end][::-1])
            starts.update((rule, end - n) for n in lengths if n == end or data[end - n - 1] not in self.guard)
        found: list[tuple[int, int, int]] = []
        for rule, start in sorted(starts):
            end = start + max(self.forward[rule].lengths(data, start), default=0)
            if found and found[-1][0] == rule and start < found[-1][2]:
                found[-1] = (rule, found[-1][1], max(end, found[-1][2]))
            elif start < end:
                found.append((rule, start, end))
        return found


class _Lazy:
    """Matches of one tree that begin at a given place, its states made as they are needed."""

    def __init__(self, tree) -> None:
        self.nfa = _Nfa()
        start = self.nfa.state()
        self.end = self.nfa.add(tree, start)
        self.root = self.nfa.closure([start])
        self.memo: dict[tuple[frozenset, int], frozenset] = {}

    def lengths(self, data: bytes, at: int = 0) -> Iterator[int]:
        state = self.root
        for i in range(at, len(data)):
            b = data[i]
            if (state, b) not in self.memo:
                self.memo[state, b] = self.nfa.closure([m[1] for m in (self.nfa.moves[x] for x in state) if m and b in m[0]])
            state = self.memo[state, b]
            if not state:
                break
            if self.end in state:
                yield i + 1 - at


@lru_cache(4)
def _compiled(rules: tuple[tuple[str, str], ...], guard: str) -> Automaton:
    return Automaton(dict(rules), guard)


def scan_texts(machine: Automaton, texts: list[str | None]) -> Iterator[tuple[int, str, int, str]]:
    """(index of the text, rule, first character from 1, secret). NUL never belongs to a match."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    stops = np.cumsum([len(r) + 1 for r in raw])
    by: dict[int, list[tuple[int, int]]] = {}
    for end, rule in machine.ends(np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)):
        i = int(np.searchsorted(stops, end, "right"))
        by.setdefault(i, []).append((end - (int(stops[i - 1]) if i else 0), rule))
    for i in sorted(by):
        for rule, a, b in machine.find(raw[i], by[i]):
            yield i, machine.names[rule], len(raw[i][:a].decode("utf-8", "surrogatepass")) + 1, raw[i][a:b].decode("utf-8", "replace")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """One row for each finding: (doc_id, rule, start, secret), start counting characters from 1.

    A finding is a maximal run of overlapping matches of one rule; different rules may find the same place.
    Matches of RULES begin after any byte, those of other rules after none of TOKEN.
    Null and empty texts have none; very long texts are scanned whole; repeated rows give repeated findings;
    a null id stays null; extra columns are ignored; an empty table or rule set gives no row.
    """
    machine = docs.sparkSession.sparkContext.broadcast(_compiled(tuple((RULES if rules is None else rules).items()), "" if rules is None else TOKEN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                piece = b.slice(at, 1024)
                found = list(scan_texts(machine.value, piece.column(1).to_pylist()))
                who, rule, start, secret = zip(*found) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(who, pa.int64())), pa.array(rule, pa.string()), pa.array(start, pa.int64()), pa.array(secret, pa.string())], names=["doc_id", "rule", "start", "secret"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(quoted(id_col), quoted(text_col).cast("string").alias("t")).where("t is not null").mapInArrow(run, f"doc_id {kind}, rule string, start long, secret string")


def oracle_sql(table: str = "documents") -> str:
    """The same rules by the SQL engine's own regular expressions: every match after any byte, whole."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = [f"SELECT doc_id, {quote(name)} AS rule, regexp_extract_all(text, {quote(p)}) AS found, string_split_regex(text, {quote(p)}) AS rest FROM {table} WHERE regexp_matches(text, {quote(p)})" for name, p in RULES.items()]
    return f"""
WITH hits AS ({" UNION ALL ".join(each)})
SELECT doc_id, rule, (list_sum(list_transform(rest[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:n - 1], lambda x: length(x))), 0) + 1)::BIGINT AS start, found[n] AS secret
FROM (SELECT *, unnest(range(1, len(found) + 1)) AS n FROM hits)"""
