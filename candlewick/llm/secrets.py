"""Operator 10, secret scans: one deterministic automaton for all rules.

The rules' patterns are parsed and joined into one non-deterministic automaton over bytes, which the
subset construction makes deterministic and partition refinement minimises. What remains is one flat
array of next states, 256 to a state. A text is passed once, byte by byte; wherever the automaton
stands in an accepting state, some rule has a match that ends there, and that rule's own automaton,
started at the first place where a match may begin, gives the leftmost, longest span. Matches of one
rule never overlap; those that fail the rule's check are dropped, but the text they took stays taken.

The scan is a map over rows: no shuffle, and memory for one batch of texts.

Defined cases: a null text is empty and has no spans; a row gives one row, repeated or not; texts of any
length are scanned whole; an empty table gives an empty result; other columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import table


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int  # characters of the whole match
    any_case: bool = False
    value: int = 0  # characters of the value behind the sign of assignment


# The rules in the order in which kinds are listed; the first three are the base.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0, any_case=True, value=6),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{8,}", 24),  # a run of 24 or more is one of 8 or more; fewer candidates
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
]
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:int,end:int>>"


class _Nfa:
    """Patterns of literals, [classes], (a|b), ?, *, + and {n}, {n,}; \\x20 and \\. escape a byte."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def add(self, pattern: str, any_case: bool) -> tuple[int, int]:
        self.p, self.i, self.any_case = pattern, 0, any_case
        return self._either()

    def _peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def _either(self) -> tuple[int, int]:
        a, z = self.state(), self.state()
        while True:
            s, e = self._row()
            self.eps[a].append(s)
            self.eps[e].append(z)
            if self._peek() != "|":
                return a, z
            self.i += 1

    def _row(self) -> tuple[int, int]:
        a = z = self.state()
        while self._peek() not in ("", "|", ")"):
            at = self.i
            s, e = self._one()
            low, high = self._count()
            for k in range(max(low, 1) if high is None else high):
                if k:  # the same piece once more
                    end, self.i = self.i, at
                    s, e = self._one()
                    self.i = end
                self.eps[z].append(s)
                if k >= low:
                    self.eps[s].append(e)
                if high is None and k == max(low, 1) - 1:
                    self.eps[e].append(s)
                z = e
        return a, z

    def _count(self) -> tuple[int, int | None]:
        c = self._peek()
        if c in ("?", "*", "+"):
            self.i += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            low, comma, _ = self.p[self.i + 1 : self.p.index("}", self.i)].partition(",")
            self.i = self.p.index("}", self.i) + 1
            return int(low), None if comma else int(low)
        return 1, 1

    def _byte(self) -> int:
        c = self.p[self.i]
        if c == "\\":
            if self.p[self.i + 1] == "x":
                self.i += 4
                return int(self.p[self.i - 2 : self.i], 16)
            self.i += 1
        self.i += 1
        return ord(self.p[self.i - 1])

    def _one(self) -> tuple[int, int]:
        if self._peek() == "(":
            self.i += 1
            s, e = self._either()
            self.i += 1
            return s, e
        found: set[int] = set()
        if self._peek() == "[":
            self.i += 1
            while self._peek() != "]":
                low = high = self._byte()
                if self._peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    high = self._byte()
                found.update(range(low, high + 1))
            self.i += 1
        else:
            found.add(self._byte())
        if self.any_case:
            found |= {b ^ 32 for b in found if chr(b & ~32).isalpha() and b < 128}
        s, e = self.state(), self.state()
        self.step[s] = frozenset(found), e
        return s, e

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _determinise(nfa: _Nfa, starts: list[int], ends: list[int], anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction: next states (states x 256) and the mask of rules that each state accepts.

    anywhere: a match may start at each byte; else only at the first, and the last state is dead.
    """
    # bytes that no pattern tells apart share a column
    kinds: dict[tuple, int] = {}
    column = np.zeros(256, dtype=np.int64)
    sets = list({s[0] for s in nfa.step if s})
    for b in range(256):
        column[b] = kinds.setdefault(tuple(b in s for s in sets), len(kinds))
    byte_of = [int(np.argmax(column == k)) for k in range(len(kinds))]
    root = nfa.closed(starts)
    at, todo, rows = {root: 0}, [root], []
    for here in todo:
        row = []
        for b in byte_of:
            there = nfa.closed([t for s in here if nfa.step[s] and b in nfa.step[s][0] for t in [nfa.step[s][1]]] + (starts if anywhere else []))
            if there not in at:
                at[there] = len(at)
                todo.append(there)
            row.append(at[there])
        rows.append(row)
    accepts = np.array([sum(1 << r for r, e in enumerate(ends) if e in here) for here in todo], dtype=np.int64)
    return np.array(rows, dtype=np.int64)[:, column], accepts


def _minimise(step: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement: states that accept alike and go to like states become one; the start stays 0."""
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    # accepting states last, the start first
    first = np.array([np.argmax(part == k) for k in range(part.max() + 1)])
    order = sorted(range(len(first)), key=lambda k: (k != part[0], accepts[first[k]] != 0))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place[part[step[first[order]]]], accepts[first[order]]


class Automaton:
    """The combined automaton of some rules, and one of each rule alone."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules
        nfa = _Nfa()
        ends = [nfa.add(_first_end(r.pattern), r.any_case) for r in rules]
        step, accepts = _minimise(*_determinise(nfa, [s for s, _ in ends], [e for _, e in ends], True))
        self.states = len(step)
        self.next = (step * 256).ravel().tolist()
        self.first_accepting = int(np.argmax(accepts != 0)) * 256 if accepts.any() else len(self.next)
        self.accepts = accepts.tolist()
        # the same arrays linked to each other, for texts without a match: accepting states lead to themselves
        self.linked = [[None] * 256 for _ in accepts]
        self.hit = self.linked[-1]
        for row, there in zip(self.linked, step.tolist(), strict=True):
            row[:] = [self.hit if self.accepts[k] else self.linked[k] for k in there]
        self.hit[:] = [self.hit] * 256
        self.own = []
        for r in rules:
            nfa = _Nfa()
            s, e = nfa.add(r.pattern, r.any_case)
            step, accepts = _minimise(*_determinise(nfa, [s], [e], False))
            dead = {k * 256 for k in range(len(step)) if not accepts[k] and (step[k] == k).all()}
            self.own.append(((step * 256).ravel().tolist(), {k * 256 for k in range(len(step)) if accepts[k]}, dead))

    def longest(self, r: int, data: bytes, start: int) -> int:
        """End of the longest match of rule r that starts there; -1 if none does."""
        step, accepting, dead = self.own[r]
        s, end = 0, -1
        for i in range(start, len(data)):
            s = step[s + data[i]]
            if s in accepting:
                end = i + 1
            elif s in dead:
                break
        return end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of all matches that pass their rule's check, by start, then rule."""
        row = self.linked[0]
        for b in data:
            row = row[b]
        if row is not self.hit:
            return []
        step, first, s, since = self.next, self.first_accepting, 0, 0
        taken: dict[int, int] = {}
        found = []
        for i, b in enumerate(data):
            s = step[s + b]
            if not s:
                since = i + 1  # nothing has begun
            elif s >= first:
                mask = self.accepts[s >> 8]
                for r, rule in enumerate(self.rules):
                    if mask >> r & 1 and taken.get(r, 0) <= i:
                        for start in range(max(since, taken.get(r, 0)), i + 1):
                            end = self.longest(r, data, start)
                            if end >= 0:
                                taken[r] = end
                                if _passes(rule, data[start:end]):
                                    found.append((start, r, end))
                                break
        return sorted(found)


def _first_end(pattern: str) -> str:
    """The pattern up to where its shortest matches end: a last repetition is cut to its least count.

    Each match of the whole pattern begins with one of these, and the rule's own automaton follows it to
    its end. Without open repetitions at the end, the rules' states don't multiply.
    """
    if pattern.endswith(",}"):
        return pattern[:-2] + "}"
    return pattern[:-1] if pattern.endswith("]+") else pattern


def _passes(rule: Rule, match: bytes) -> bool:
    if rule.value:
        sign = min(x for x in (match.find(b":"), match.find(b"=")) if x >= 0)
        value = match[sign + 1 :].lstrip(b" ")
        return len(value) - (value[:1] in (b'"', b"'")) >= rule.value
    return len(match) >= rule.least


@lru_cache(4)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton(list(rules))


def in_characters(data: bytes, spans: list[tuple[int, int, int]], rules) -> list[dict]:
    """Spans with places counted in code points."""
    out, at, chars = [], 0, 0
    for start, r, end in spans:
        chars += len(data[at:start].decode("utf-8", "replace"))
        at = start
        out.append({"kind": rules[r].kind, "start": chars, "end": chars + len(data[start:end].decode("utf-8", "replace"))})
    return out


def scanner(rules: list[Rule] | None = None) -> Callable[[Column], Column]:
    """A function of a text column that gives its secrets as an array of (kind, start, end)."""
    own = tuple(rules or RULES)

    @F.arrow_udf(SPANS)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = automaton(own)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in texts:
            yield pa.array([in_characters(x, a.spans(x), own) if x else [] for x in batch.cast(pa.binary()).to_pylist()], type=kind)

    return scan


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs as struct ``doc`` and all secrets of its text as ``secrets``."""
    return docs.select(F.struct("*").alias("doc")).withColumn("secrets", scanner(rules)(F.col("doc.text")))


def masked(text: Column, secrets: Column) -> Column:
    """The text with each secret replaced by its kind in brackets; overlapping spans become one mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))))
        mask = F.when(x["start"] < acc["at"], F.lit("")).otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(kept, mask).alias("out"))

    return F.aggregate(secrets, start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secret_scan(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc.doc_id", "secrets")
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    counts = [F.size(F.filter(F.transform("secrets", lambda x: x["kind"]), lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: secrets are masked and n_chars counted anew where they are; every row stays, as it was without a
    secret, null texts and repeated rows among them; other columns are carried."""
    text = F.col("doc.text")
    changed = F.size("secrets") > 0
    new = F.when(changed, masked(text, F.col("secrets"))).otherwise(text)
    found = find_secrets(docs).withColumn("new", new)
    cols = [F.col("new").alias(c) if c == "text" else F.when(changed, F.length("new").cast("long")).otherwise(F.col("doc.n_chars")).alias(c) if c == "n_chars" else F.col(f"doc.`{c}`") for c in docs.columns]
    return found.select(cols)


def _cased(pattern: str) -> str:
    return pattern.replace("(password|passwd|secret|token|api_?key)", "(" + "|".join("".join(c if c in "_?" else f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")")


def oracle_sql() -> str:
    """Pieces between matches give the matches' places: RE2's leftmost matches, cut out one by one."""
    kinds = []
    for k, r in enumerate(RULES):
        pattern = _cased(r.pattern).replace("'", "''")
        size = "length(regexp_replace(m[i], '^[^:=]*[:=] *[\"'']?', ''))" if r.value else "length(m[i])"
        kinds.append(f"""
        SELECT doc_id, rid, {k} AS k, '{r.kind}' AS kind, s, s + length(m[i]) AS e FROM (
          SELECT *, (coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM (
            SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, rid, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d)))
        WHERE {size} >= {r.value or r.least}""")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({" UNION ALL ".join(kinds)}),
    g AS (SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
      string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k) AS spans FROM f GROUP BY rid)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (rid)
    """
