"""Secret scans: all rules in one minimal deterministic automaton, run over a text's bytes once.

Each rule's regex becomes a nondeterministic automaton; together, free to start anywhere, they are made deterministic
by subset construction and minimised by partition refinement into arrays of transitions, one of 256 entries for each
state, with the set of rules that end in it. The pass reports where a rule's shortest match ends. From there a reversed
automaton of that rule walks back to the leftmost start behind the rule's previous match, and its forward one on to the
longest end; a check of the match follows, as lengths do. A match that fails its check is used up, not tried again.

That equals a leftmost, greedy, non-overlapping search because in each rule a match that ends first also starts first
(a rule's keyword can't occur between its keyword and its value), and the longest match is the greedy one.

Defined results: a null text is empty; offsets are code points, the end exclusive; equal rows get equal results; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batches, small_batches, table, text_bytes

NAME = "[A-Za-z0-9_-]+"
#: Rules: kind, regex over ASCII, and the shortest match that counts. Kinds in the order of the contract, then the method's.
BASE = ("assign", "access", "hex")
RULES: tuple[tuple[str, str, int], ...] = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 0),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]{16}[0-9a-f]*", 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    ("google", r"AIza" + NAME, 39),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]+", 24),
    ("jwt", rf"eyJ{NAME}\.{NAME}\.{NAME}", 40),
    ("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0),
)
ASSIGN_VALUE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


class Nfa:
    """States with moves on sets of bytes, given as 256-bit masks, and free moves."""

    def __init__(self):
        self.moves: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, backward: bool) -> int:
        """Builds a parsed regex from a state on; returns its last state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "seq":
            for part in reversed(tree[1]) if backward else tree[1]:
                start = self.add(part, start, backward)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(part, own, backward)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start, backward)
        end = self.state()
        self.free[start].append(end)
        if most is None:
            own = self.state()
            self.free[end].append(own)
            self.free[self.add(part, own, backward)].append(end)
        for _ in range((most or least) - least):
            start = self.add(part, start, backward)
            self.free[start].append(end)
        return end


def parse(pattern: str):
    """A tree of sets, sequences, choices and repetitions, of the plain regex syntax that the rules use."""
    at = 0

    def one() -> int:
        nonlocal at
        ch = pattern[at]
        at += 1
        if ch == "\\":
            ch = pattern[at]
            at += 1
            if ch == "x":
                ch = chr(int(pattern[at : at + 2], 16))
                at += 2
        return ord(ch)

    def atom():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            tree = choice()
            at += 1
            return tree
        if pattern[at] == "[":
            at += 1
            mask = 0
            while pattern[at] != "]":
                low = high = one()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = one()
                for b in range(low, high + 1):
                    mask |= 1 << b
            at += 1
            return "set", mask
        return "set", 1 << one()

    def sequence():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            tree = atom()
            while at < len(pattern) and pattern[at] in "?*+{":
                ch = pattern[at]
                at += 1
                if ch == "{":
                    stop = pattern.index("}", at)
                    n = int(pattern[at:stop])
                    at = stop + 1
                    tree = "times", tree, n, n
                else:
                    tree = "times", tree, int(ch == "+"), 1 if ch == "?" else None
            parts.append(tree)
        return "seq", parts

    def choice():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    return choice()


def byte_classes(nfa: Nfa) -> list[list[int]]:
    """Bytes that no move tells apart, together."""
    masks = sorted({mask for moves in nfa.moves for mask, _ in moves})
    groups: dict[tuple[int, ...], list[int]] = {}
    for b in range(256):
        groups.setdefault(tuple(m >> b & 1 for m in masks), []).append(b)
    return list(groups.values())


def determinise(nfa: Nfa, start: int, ends: dict[int, int], anywhere: bool) -> tuple[list[list[int]], list[int]]:
    """Transitions and accepted rules (a bit each) by subset construction; state 0 is the start, -1 none."""
    closed: dict[int, frozenset[int]] = {}

    def closure(q: int) -> frozenset[int]:
        if q not in closed:
            seen, todo = {q}, [q]
            while todo:
                for r in nfa.free[todo.pop()]:
                    if r not in seen:
                        seen.add(r)
                        todo.append(r)
            closed[q] = frozenset(seen)
        return closed[q]

    classes = byte_classes(nfa)
    #: from a state, for each class of bytes, where it leads; only states with moves or ends matter
    steps = {q: [[closure(to) for mask, to in moves if mask >> group[0] & 1] for group in classes] for q, moves in enumerate(nfa.moves) if moves}
    trimmed = lambda states: frozenset(q for q in states if q in steps or q in ends)
    first = trimmed(closure(start))
    numbers, order, rows, accepts = {first: 0}, [first], [], []
    for states in order:
        row = [-1] * 256
        for c, group in enumerate(classes):
            goal = set(first) if anywhere else set()
            for q in states:
                if q in steps:
                    goal.update(*steps[q][c])
            goal = trimmed(goal)
            if not goal:
                continue
            if goal not in numbers:
                numbers[goal] = len(order)
                order.append(goal)
            for b in group:
                row[b] = numbers[goal]
        rows.append(row)
        accepts.append(sum(1 << r for r in {ends[q] for q in states if q in ends}))
    return rows, accepts


def first_end(tree):
    """The regex with a loop at its end cut short: its matches end where the whole regex's shortest ones do."""
    if tree[0] == "seq" and tree[1]:
        last = first_end(tree[1][-1])
        return first_end(("seq", tree[1][:-1])) if last == ("seq", []) else ("seq", [*tree[1][:-1], last])
    if tree[0] == "times" and tree[3] is None:
        return ("seq", [tree[1]] * tree[2])
    return tree


def minimise(rows: list[list[int]], accepts: list[int]) -> tuple[list[list[int]], list[int]]:
    """Merges states that no text tells apart, by refining the partition of accepted rules until it is stable."""
    part = accepts
    while True:
        numbers: dict[tuple, int] = {}
        new = [numbers.setdefault((part[s], *(part[t] if t >= 0 else None for t in row)), len(numbers)) for s, row in enumerate(rows)]
        if len(numbers) == len(set(part)):
            break
        part = new
    firsts = {p: s for s, p in reversed(list(enumerate(new)))}
    return [[new[t] if t >= 0 else -1 for t in rows[firsts[p]]] for p in range(len(firsts))], [accepts[firsts[p]] for p in range(len(firsts))]


def compile_rules(rules: tuple[tuple[str, str, int], ...]) -> dict:
    """The combined automaton, and each rule's forward and backward one."""
    trees = [parse(r[1]) for r in rules]
    nfa = Nfa()
    start = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        own = nfa.state()
        nfa.free[start].append(own)
        ends[nfa.add(first_end(tree), own, False)] = k
    out = {"all": minimise(*determinise(nfa, start, ends, True)), "forward": [], "backward": []}
    for tree in trees:
        for way in ("forward", "backward"):
            nfa = Nfa()
            own = nfa.state()
            out[way].append(minimise(*determinise(nfa, own, {nfa.add(tree, own, way == "backward"): 0}, False)))
    return out


class Scanner:
    """Finds the matches of all rules in a text; ``valid`` has a check of a match for some kinds."""

    def __init__(self, compiled: dict, rules: tuple[tuple[str, str, int], ...], valid: dict[str, Callable[[bytes], bool]]):
        self.rules, self.valid, self.compiled = rules, valid, compiled
        rows, accepts = compiled["all"]
        #: a state is its row of 256 next states; entry 256 has the rules that end in it
        self.rows = [[None] * 257 for _ in rows]
        for own, row, rules_ in zip(self.rows, rows, accepts, strict=True):
            own[:256] = [self.rows[t] for t in row]
            own[256] = rules_
        self.bits = {a: [k for k in range(len(rules)) if a >> k & 1] for a in set(accepts)}

    def extent(self, k: int, data: bytes, end: int, least: int) -> tuple[int, int] | None:
        """The longest match of rule k with the leftmost start from ``least`` on that has a match ending at ``end``."""
        rows, accepts = self.compiled["backward"][k]
        state, start = 0, -1
        for i in range(end - 1, least - 1, -1):
            state = rows[state][data[i]]
            if state < 0:
                break
            if accepts[state]:
                start = i
        if start < 0:
            return None
        rows, accepts = self.compiled["forward"][k]
        state, stop = 0, start
        for i in range(start, len(data)):
            state = rows[state][data[i]]
            if state < 0:
                break
            if accepts[state]:
                stop = i + 1
        return start, stop

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule."""
        out, done = [], [0] * len(self.rules)
        row = self.rows[0]
        for at, byte in enumerate(data):
            row = row[byte]
            if row[256]:
                for k in self.bits[row[256]]:
                    if at < done[k]:
                        continue
                    found = self.extent(k, data, at + 1, done[k])
                    if found:
                        done[k] = found[1]
                        kind, _, least = self.rules[k]
                        if found[1] - found[0] >= least and (kind not in self.valid or self.valid[kind](data[found[0] : found[1]])):
                            out.append((found[0], k, found[1]))
        return sorted(out)


def long_value(match: bytes) -> bool:
    """Whether an assignment's value, the run of value characters at its end, has 12 of them or more.

    The value starts behind the first colon or equals sign, blanks and one quote.
    """
    first = min(p for p in (match.find(b":"), match.find(b"=")) if p >= 0)
    rest = match[first + 1 :].lstrip(b" ")
    return len(rest[1:] if rest[:1] in (b'"', b"'") else rest) >= 12


VALID = {"assign": long_value}


def points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    if data.isascii():
        return spans
    where = {x: len(data[:x].decode("utf-8", "replace")) for x in {x for s in spans for x in (s[0], s[2])}}
    return [(where[a], k, where[b]) for a, k, b in spans]


def scanned(docs: DataFrame, keep: list[str], rules: tuple[tuple[str, str, int], ...] = RULES) -> DataFrame:
    """The columns ``keep`` and ``found``, array<struct<kind, start, end>>."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(compile_rules(rules))
    picked = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("se__text"))
    n = len(keep)
    schema = StructType([*picked.schema.fields[:n], *StructType.fromDDL("found array<struct<kind:string,start:int,end:int>>").fields])
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, rules, VALID)
        for batch in batches(it):
            out = []
            for text in batch.column(n):
                data = text_bytes(text.as_py())
                spans = scanner.spans(data)
                out.append([{"kind": rules[k][0], "start": a, "end": b} for a, k, b in (points(data, spans) if spans else spans)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, kind_of)], names=schema.fieldNames())

    return picked.mapInArrow(run, schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
