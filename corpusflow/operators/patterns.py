"""Many patterns against many texts, without a join of all with all.

Each pattern has literals of which one must stand in every text that it matches. All literals of a block of patterns are
one Aho-Corasick automaton in numpy arrays, which is broadcast; a block ends before its table takes
``TABLE_BYTES``. Tasks stream the text column in Arrow batches through it. Cut into pieces of equal length that
advance in step, a batch costs one gather for each byte of a piece, whatever the number of patterns. What is found are
numbers of patterns; Spark joins these (an equi join) and evaluates the pattern itself on those rows alone.

The automaton compares letters folded as Java's Unicode-case patterns compare them, so it finds more than a
case-sensitive pattern matches, and never less.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import blocks, ship

TABLE_BYTES = 64 << 20
PIECE = 512
_BREAK = 0xFF  # no byte of UTF-8: stands between texts


def fold(text: str) -> str:
    """Each letter's lower case of its upper case, where both are one letter."""
    upper = lambda c: u if len(u := c.upper()) == 1 else c
    lower = lambda c: w if len(w := c.lower()) == 1 else "i" if c == "İ" else c
    return "".join(lower(upper(c)) for c in text)


@cache
def _special() -> dict[int, str]:
    """Letters of the basic plane whose folded form isn't their simple lower case."""
    letters = map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000)))
    simple = pc.utf8_lower(pa.array([chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x10000))])).to_pylist()
    return {ord(w): f for c, w in zip(letters, simple, strict=True) if (f := fold(c)) != w}


def _folded(texts: pa.Array) -> pa.Array:
    low = pc.utf8_lower(texts)
    special = _special()
    odd = pc.match_substring_regex(low, "[" + "".join(map(chr, special)) + "]")
    if pc.any(odd).as_py():
        low = pa.array([t.translate(special) if o else t for t, o in zip(low.to_pylist(), odd.to_pylist(), strict=True)], low.type)
    return low


@dataclass
class Automaton:
    classes: np.ndarray  # uint8: of each byte
    table: np.ndarray  # int32: nodes x classes
    hit: np.ndarray  # bool: whether a literal ends at a node
    chain: np.ndarray  # int32: the next shorter literal's node that ends there too, 0 without
    term: np.ndarray  # int32: the literal that ends at a node, -1 without
    owners: list[np.ndarray]  # of each literal the numbers of its patterns
    longest: int

    @classmethod
    def of(cls, literals: dict[bytes, list[int]]) -> Automaton:
        used = sorted({b for t in literals for b in t})
        classes = np.zeros(256, np.uint8)
        classes[used] = np.arange(1, len(used) + 1, dtype=np.uint8)
        children: list[dict[int, int]] = [{}]
        term = [-1]
        for i, t in enumerate(literals):
            node = 0
            for c in classes[list(t)].tolist():
                follow = children[node].get(c)
                if follow is None:
                    follow = children[node][c] = len(children)
                    children.append({})
                    term.append(-1)
                node = follow
            term[node] = i
        table = np.zeros((len(children), len(used) + 1), np.int32)
        fail, chain = np.zeros(len(children), np.int32), np.zeros(len(children), np.int32)
        for c, n in children[0].items():
            table[0, c] = n
        waiting = deque(children[0].values())
        while waiting:
            node = waiting.popleft()
            back = fail[node]
            chain[node] = back if term[back] >= 0 else chain[back]
            table[node] = table[back]
            for c, n in children[node].items():
                fail[n] = table[back, c]
                table[node, c] = n
                waiting.append(n)
        terms = np.array(term, np.int32)
        return cls(classes, table, (terms >= 0) | (chain > 0), chain, terms, [np.array(v, np.int64) for v in literals.values()], max(map(len, literals), default=0))

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, literal), once each, for all literals in the folded texts."""
        texts = texts.cast(pa.large_string())
        _, at, data = texts.buffers()
        off = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        sizes = np.diff(off)
        ends = np.cumsum(sizes + 1)  # a break behind each text
        stream = np.full(int(ends[-1]) if len(ends) else 0, self.classes[_BREAK], np.uint8)
        inside = np.ones(len(stream), bool)
        inside[ends - 1] = False
        stream[inside] = self.classes[raw]
        before = max(0, self.longest - 1)
        pieces = -(-len(stream) // PIECE)
        lead = np.concatenate([np.zeros(before, np.uint8), stream, np.zeros(pieces * PIECE - len(stream), np.uint8)])
        lanes = np.lib.stride_tricks.sliding_window_view(lead, before + PIECE)[::PIECE].T if pieces else np.zeros((0, 0), np.uint8)
        state = np.zeros(pieces, np.int64)
        flat, width = self.table.ravel(), self.table.shape[1]
        places, nodes = [], []
        for step, column in enumerate(lanes):
            state = flat[state * width + column]
            if step >= before and (hit := self.hit[state]).any():
                lane = np.flatnonzero(hit)
                places.append(lane * PIECE + step - before)
                nodes.append(state[lane])
            state = state.astype(np.int64)
        place, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, nodes))
        row = np.searchsorted(ends, place, "right")
        found = []
        while len(node):
            term = self.term[node]
            own = term >= 0
            found.append(np.unique(row[own] * len(self.owners) + term[own]))
            node = self.chain[node]
            row, node = row[node > 0], node[node > 0]
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // max(1, len(self.owners)), both % max(1, len(self.owners))

    def numbers(self, texts: pa.Array) -> pa.Array:
        """Of each text the numbers of all patterns of which a literal stands in it."""
        row, literal = self.find(_folded(pc.fill_null(texts.cast(pa.string()), "")))
        owned = np.array([len(self.owners[t]) for t in literal.tolist()], np.int64)
        pattern = np.concatenate([self.owners[t] for t in literal.tolist()]) if len(literal) else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.repeat(row, owned), pattern]), axis=1) if len(pattern) else np.zeros((2, 0), np.int64)
        counts = np.bincount(pairs[0], minlength=len(texts))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(pairs[1]))


# --- literals of a regular expression ------------------------------------------------------


def required(pattern: str) -> list[str] | None:
    """Literals of which one stands in whatever the pattern matches, the longest of each alternative; None where an
    alternative has none of two letters. Read are flags, groups, alternatives, quoted and escaped characters; all else
    ends a literal."""
    pattern = re.sub(r"\\Q(.*?)(?:\\E|$)", lambda m: "".join("\\" + c if not c.isalnum() else c for c in m[1]), pattern, flags=re.DOTALL)
    at = 0

    def quantifier() -> tuple[int, bool]:
        """(characters, whether what is before may be missing)"""
        m = re.compile(r"(\*|\?|\+|\{(\d+)(?:,\d*)?\})[?+]?").match(pattern, at)
        return (len(m[0]), m[1] in "*?" or m[2] == "0") if m else (0, False)

    def alternatives() -> list[set[str] | None]:
        nonlocal at
        out: list[set[str] | None] = []
        best: set[str] | None = None
        run = ""

        def better(now: set[str] | None) -> None:
            nonlocal best
            if now and all(len(x) >= 2 for x in now) and (best is None or min(map(len, now)) > min(map(len, best))):
                best = now

        def end() -> None:
            nonlocal run
            better({run} if run else None)
            run = ""

        while at < len(pattern) and pattern[at] != ")":
            c = pattern[at]
            at += 1
            if c == "|":
                end()
                out.append(best)
                best = None
                continue
            literal = None
            if c == "\\" and at < len(pattern):
                e = pattern[at]
                at += 1
                if e in "bBAzZG":  # a border has no width: the literal goes on
                    continue
                if e in "pP":  # a property and its name
                    at += len(re.compile(r"\{[^}]*\}|.").match(pattern, at)[0])
                elif e.isalnum() and e not in "dDsSwWhHvVRXntrfae123456789":
                    raise ValueError(e)
                literal = None if e.isalnum() else e
            elif c == "(":
                end()
                m = re.compile(r"\?[a-zA-Z-]*\)").match(pattern, at)
                if m:
                    at += len(m[0])
                    continue
                look = re.compile(r"\?(?:[a-zA-Z-]*:|<?[!=]|>|<\w+>)").match(pattern, at)
                kind = look[0] if look else ""
                at += len(kind)
                inner = alternatives()
                at += 1
                n, optional = quantifier()
                at += n
                better(None if optional or kind.endswith(("!", "=")) or not all(inner) else set().union(*inner))
                continue
            elif c == "[":
                end()
                first = True
                if "[" in pattern[at : pattern.find("]", at + 1)]:
                    raise ValueError("[")
                while at < len(pattern) and (pattern[at] != "]" or first):
                    at += 2 if pattern[at] == "\\" else 1
                    first = False
                at += 1
            elif c in "^$":
                continue
            elif c != ".":
                literal = c
            n, optional = quantifier()
            at += n
            if literal is None:
                end()
            elif n:
                if not optional:
                    run += literal
                end()
            else:
                run += literal
        end()
        out.append(best)
        return out

    if "(?x" in pattern or "&&" in pattern or re.search(r"\(\?[a-wyzA-Z-]*x", pattern):
        return None
    try:
        found = alternatives()
    except (ValueError, TypeError):  # what is not read here
        return None
    return sorted(set().union(*found)) if all(found) and at >= len(pattern) else None


# --- the join ------------------------------------------------------------------------------


def _blocks(patterns: list, most: int) -> Iterator[tuple[dict[bytes, list[int]], list]]:
    """Runs of patterns whose automaton's table takes so many bytes at most (or one pattern)."""
    literals: dict[bytes, list[int]] = {}
    rows, size, used = [], 1, set()
    for row in patterns:
        own = {fold(t).encode() for t in row["__literals"]}
        size_, used_ = size + sum(map(len, own)), used.union(*own)
        if rows and size_ * (len(used_) + 1) * 4 > most:
            yield literals, rows
            literals, rows = {}, []
            size_, used_ = 1 + sum(map(len, own)), set().union(*own)
        size, used = size_, used_
        for t in own:
            literals.setdefault(t, []).append(len(rows))
        rows.append(row)
    if rows:
        yield literals, rows


def join(rows: DataFrame, text: str, patterns: DataFrame, literals: Column, check: Column, most: int = TABLE_BYTES) -> DataFrame:
    """rows with the columns of all patterns that match: those for which ``check``, over both's columns, holds.

    literals: an array of strings of which one stands in ``text`` wherever check holds, in any case; null (or with an empty one)
    where there is none such: these patterns alone are tried on every row, a thousand at once. Patterns come to the driver one
    block after another. A null text matches nothing but such patterns."""
    spark = rows.sparkSession
    ship(spark)
    good = literals.isNotNull() & (F.size(literals) > 0) & ~F.exists(literals, lambda x: x.isNull() | (x == ""))
    given = patterns.withColumn("__literals", F.when(F.coalesce(good, F.lit(False)), literals))
    out = None
    for found, block in _blocks(given.filter("__literals is not null").toLocalIterator(), most):
        shared = spark.sparkContext.broadcast(Automaton.of(found))
        numbers = F.arrow_udf(lambda c, shared=shared: shared.value.numbers(c), "array<bigint>")
        side = spark.createDataFrame([(i, *(r[c] for c in patterns.columns)) for i, r in enumerate(block)], given.drop("__literals").select(F.lit(0).cast("long").alias("__number"), "*").schema)
        hits = rows.withColumn("__number", F.explode(numbers(F.col(text)))).join(F.broadcast(side), "__number").drop("__number").filter(check)
        out = hits if out is None else out.unionByName(hits)
    rest = given.filter("__literals is null").drop("__literals")
    if out is None or not rest.isEmpty():
        for part in blocks(rest):
            hits = rows.join(part, check)
            out = hits if out is None else out.unionByName(hits)
    return out
