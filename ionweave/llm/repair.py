"""Conversation structure repair by a min-plus dynamic program over a grammar.

A row of a conversation is a symbol: the initial of its role and its fault. Cheapest edits to ``(s?(ua)+)?`` are a product of one
matrix a row over four states (nothing yet, after s, after u, after a): an entry is a cost and the audit, a rope of edit initials, and
equal costs are settled by the audit that is least in ASCII. Two audits of equal cost between the same states over the same rows
are never a prefix of one another, since a further insertion costs more, so the order of audits survives joining and the product
is exact however it is bracketed.

Sequences of symbols are cut into pieces of at most ``PIECE`` rows, and only distinct pieces are worked on. A task takes
them in blocks of about ``BLOCK`` symbols, replaces the most frequent pair of symbols by a rule until none stands twice (Re-Pair), and
evaluates one matrix per rule, bottom-up; conversations share the rules of a block. Every conversation, long ones too, is the
product of its pieces, which lie in as many range partitions as its rows fill.

The repaired text needs the rows in order with their audit: rows and pieces of a conversation meet in one range, in a stream that
holds the audit (a character a row) and one batch of rows. The digest of one conversation is sequential by its definition, so
its rows pass through one task, in bounded memory.

Rows: null text, role, conv_id and turn stand for one space where they are read as text; rows of one turn are ordered by role,
then by a digest of the text; repeated rows stay repeated; rows with a null conv_id are one conversation; further columns are not read; an
empty table gives no rows. Roles whose initial is none of s, u, a cannot be kept.
"""
from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.base import columns_only, query, table, written

#: Rows of a conversation in a piece, and symbols of distinct pieces that share a grammar.
PIECE, BLOCK = 2048, 100_000

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: State after each role from each state (0 nothing yet, 1 after s, 2 after u, 3 after a).
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
STATES = 4
ROLES = {2: "user", 3: "assistant"}
#: Faults in a symbol: none, truncated, blank, duplicate. Symbols are characters from this one on: initial (s, u, a, other) by fault.
FAULTS = " tbd"
FIRST = 65
INITIALS = "sua?"

_PRIME = 2**61 - 31


class Rope:
    """A text as a tree of parts, compared without writing it out."""
    __slots__ = ("left", "right", "text", "size", "mark")

    def __init__(self, text: str | None = None, left: "Rope | None" = None, right: "Rope | None" = None):
        self.left, self.right, self.text = left, right, text
        if text is not None:
            self.size, self.mark = len(text), int.from_bytes(text.encode(), "big") % _PRIME
        else:
            self.size = left.size + right.size
            self.mark = (left.mark * pow(256, right.size, _PRIME) + right.mark) % _PRIME

    def joined(self, other: "Rope") -> "Rope":
        return other if not self.size else self if not other.size else Rope(None, self, other)

    def less(self, other: "Rope") -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or x.size == y.size and x.mark == y.mark:
                continue
            if x.text is not None and y.text is not None:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                a += [Rope(x.text[n:])] if x.size > n else []
                b += [Rope(y.text[n:])] if y.size > n else []
            elif y.text is not None or x.text is None and x.size >= y.size:
                a += [x.right, x.left]
                b.append(y)
            else:
                b += [y.right, y.left]
                a.append(x)
        return bool(b)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.text is not None:
                out.append(x.text)
            else:
                todo += [x.right, x.left]
        return "".join(out)


#: An entry is (cost, rope) or None where no edits lead from one state to the other; a matrix has an entry per pair of states.
Matrix = list
NOTHING = Rope("")


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    return b if b[0] < a[0] or b[0] == a[0] and b[1].less(a[1]) else a


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for i in range(STATES):
        for j in range(STATES):
            # ropes are joined only for the winner; a tie compares the joined ones
            best, rope = None, None
            for k in range(STATES):
                x, y = a[STATES * i + k], b[STATES * k + j]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is None or cost < best:
                    best, rope = cost, x[1].joined(y[1])
                elif cost == best:
                    other = x[1].joined(y[1])
                    if other.less(rope):
                        rope = other
            out.append(None if best is None else (best, rope))
    return out


def insertions() -> Matrix:
    """Any insertions: more than two in a row cost more than fewer that lead to the same state."""
    out: Matrix = [None] * STATES ** 2
    for i in range(STATES):
        at = {i: ""}
        for _ in range(STATES):
            for state, edits in list(at.items()):
                for role in "ua":
                    to = MOVES[role].get(state)
                    if to is not None and to not in at:
                        at[to] = edits + "I"
        for j, edits in at.items():
            out[STATES * i + j] = (INSERT * len(edits), Rope(edits))
    return out


INSERTIONS = insertions()


def symbol(role: str, fault: str) -> str:
    who = INITIALS.index(role[0]) if role[:1] in ("s", "u", "a") else len(INITIALS) - 1
    return chr(FIRST + len(FAULTS) * who + FAULTS.index(fault))


def of_symbol(s: str) -> Matrix:
    """Insertions before a row, then one edit of it."""
    who, fault = divmod(ord(s) - FIRST, len(FAULTS))
    own: Matrix = [None] * STATES ** 2
    for i in range(STATES):
        choices = {i: (DELETE, Rope("D"))}
        if FAULTS[fault] in " t":
            extra = TRUNCATED if FAULTS[fault] == "t" else 0
            for role in "ua":
                if (to := MOVES[role].get(i)) is not None:
                    choices[to] = better(choices.get(to), (REROLE + extra, Rope("R")))
            if (to := MOVES.get(INITIALS[who], {}).get(i)) is not None:
                choices[to] = better(choices.get(to), (extra, Rope("K")))
        for j, entry in choices.items():
            own[STATES * i + j] = entry
    return product(INSERTIONS, own)


def product_of(parts: list[Matrix]) -> Matrix:
    """The product of matrices, halves first, so that ropes stay shallow."""
    if not parts:
        return [(0, NOTHING) if i == j else None for i in range(STATES) for j in range(STATES)]
    while len(parts) > 1:
        parts = [product(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def grammar(texts: list[str]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Re-Pair: rules (pairs of symbols; symbols from 256 on are rules in order) and what is left of each text."""
    flat, bounds = [], [0]
    for t in texts:
        flat += [ord(c) for c in t] + [-1]
        bounds.append(len(flat))
    n = len(flat)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)

    def add(i: int) -> None:
        j = after[i]
        if i >= 0 and j < n and flat[i] >= 0 and flat[j] >= 0:
            places[flat[i], flat[j]].add(i)

    def drop(i: int) -> None:
        j = after[i] if i >= 0 else n
        if j < n and flat[i] >= 0 and flat[j] >= 0:
            places[flat[i], flat[j]].discard(i)

    for i in range(n):
        add(i)
    heap = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        now = len(places[pair])
        if now < 2:
            continue
        if now != -count:
            heapq.heappush(heap, (-now, pair))
            continue
        new, touched, made = 256 + len(rules), set(), 0
        for i in sorted(places.pop(pair)):
            j = after[i]
            # places of a pair like aa overlap: an earlier one may have taken this
            if j >= n or (flat[i], flat[j]) != pair:
                continue
            left, right = before[i], after[j]
            if left >= 0:
                drop(left)
            drop(j)
            flat[i], flat[j], after[i] = new, -2, right
            if right < n:
                before[right] = i
            if left >= 0:
                add(left)
                touched.add((flat[left], new))
            add(i)
            if right < n:
                touched.add((new, flat[right]))
            made += 1
        places.pop(pair, None)
        if made:
            rules.append(pair)
        for p in touched:
            if p in places and len(places[p]) > 1:
                heapq.heappush(heap, (-len(places[p]), p))
    rest = []
    for a, z in zip(bounds, bounds[1:], strict=False):
        rest.append([])
        while a < z - 1:
            rest[-1].append(flat[a])
            a = after[a]
    return rules, rest


def matrices(texts: list[str]) -> list[Matrix]:
    """The matrix of each text, by the rules that all of them share."""
    rules, rest = grammar(texts)
    known = {ord(c): of_symbol(c) for c in set("".join(texts))}
    for k, (a, b) in enumerate(rules):
        known[256 + k] = product(known[a], known[b])
    return [product_of([known[s] for s in r]) for r in rest]


def finished(whole: Matrix) -> tuple[int, Rope]:
    """Cost and audit from nothing to an end that is allowed, with insertions at the end."""
    last = product(whole, INSERTIONS)
    return better(last[0], last[3])


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, _n: how often the row stands in the damaged table (0 to 2)."""
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    own = columns_only(rows, "conv_id", "turn", "role", "text").withColumn("_h", h)
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return own.select("conv_id", "turn", F.when(F.col("_h") == 4, F.lit("user")).otherwise(role).alias("role"),
                      F.when(F.col("_h") == 1, F.lit("")).when(F.col("_h") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                      F.when(F.col("_h") == 0, 0).when(F.col("_h") == 3, 2).otherwise(1).cast("long").alias("_n"))


def marked(rows: DataFrame) -> DataFrame:
    """A row per distinct damaged row: conv_id, turn, role, _digest, _n, _symbol of its first place and of its further ones."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(last == "", F.lit("b")).when(~last.isin(".", "!", "?"), F.lit("t")).otherwise(F.lit(" "))
    own = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("_digest"), fault.alias("_fault"), "_n")
    own = own.groupBy("conv_id", "turn", "role", "_digest").agg(F.first("_fault").alias("_fault"), F.sum("_n").alias("_n"))
    # rows of equal role and text: those of the least turn come first. A dropped row is none
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    least = own.filter("_n > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_digest").alias("_same")).agg(F.min(place).alias("_least"))
    met = own.join(least, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_digest") == F.col("_same")), "left")
    earlier = F.coalesce(place > F.col("_least"), F.lit(False))
    initial = F.substring("role", 1, 1)
    who = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit(INITIALS[-1]))
    code = lambda f: F.lit(FIRST) + F.lit(len(FAULTS)) * (F.position(who, F.lit(INITIALS)) - 1) + F.position(f, F.lit(FAULTS)) - 1
    again = F.when(F.col("_fault") == "b", F.lit("b")).otherwise(F.lit("d"))
    return met.select("conv_id", "turn", "role", "_digest", "_n", F.chr(code(F.when(earlier, again).otherwise(F.col("_fault")))).alias("_symbol"),
                      F.chr(code(again)).alias("_further"))


PIECES = "conv_id {kind}, _at long, _known boolean, _turn long, _role string, _digest binary, symbols string, low long, high long, turns long"


def pieces(rows: DataFrame) -> DataFrame:
    """Runs of one conversation's rows in order, at most ``PIECE`` of them, with the key of their first row and their turns: least,
    greatest, and how many. A conversation without rows has one empty piece."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        held: dict | None = None
        done: list[dict] = []
        at = 0

        def cut() -> None:
            nonlocal held
            if held is not None:
                held["symbols"] = "".join(held["symbols"])
                done.append(held)
                held = None

        for b in batches:
            for r in b.to_pylist():
                n, first = r["_n"], True
                while n > 0 or first:
                    if held is None or held["conv_id"] != r["conv_id"] or held["count"] >= PIECE:
                        cut()
                        held = {"conv_id": r["conv_id"], "_at": at, "_known": r["turn"] is not None, "_turn": r["turn"], "_role": r["role"], "_digest": r["_digest"], "symbols": [],
                                "count": 0, "low": None, "high": None, "turns": 0}
                        at += 1
                    if n > 0:
                        take = 1 if first else min(n, PIECE - held["count"])
                        held["symbols"].append(r["_symbol"] if first else r["_further"] * take)
                        held["count"] += take
                        n -= take
                        if r["turn"] is not None:
                            held["turns"] += r["turn"] != held["high"]
                            held["high"] = r["turn"]
                            held["low"] = r["turn"] if held["low"] is None else held["low"]
                    first = False
            if len(done) > 1000:
                yield pa.RecordBatch.from_pydict({k: [d[k] for d in done] for k in names}, schema=form)
                done = []
        cut()
        if done:
            yield pa.RecordBatch.from_pydict({k: [d[k] for d in done] for k in names}, schema=form)

    form = arrow_schema(PIECES.format(kind=kind))
    ordered = rows.repartitionByRange("conv_id", "turn", "role", "_digest").sortWithinPartitions("conv_id", "turn", "role", "_digest")
    return ordered.mapInArrow(run, PIECES.format(kind=kind))


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
             "array<string>": pa.list_(pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def evaluated(distinct: DataFrame) -> DataFrame:
    """symbols, costs, audits: the matrix of each distinct piece by rows; null where no edits lead from state to state."""
    ddl = "symbols string, costs array<long>, audits array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for b in batches for t in b["symbols"].to_pylist())
        while True:
            block, size = [], 0
            for t in texts:
                block.append(t)
                size += len(t) + 1
                if size >= BLOCK:
                    break
            if not block:
                return
            found = zip(block, matrices(block), strict=True)
            while some := list(islice(found, 500)):
                yield pa.RecordBatch.from_pydict({"symbols": [t for t, _ in some], "costs": [[e and e[0] for e in m] for _, m in some],
                                                  "audits": [[e and str(e[1]) for e in m] for _, m in some]}, schema=arrow_schema(ddl))

    return distinct.repartitionByRange("symbols").sortWithinPartitions("symbols").mapInArrow(run, ddl)


class Folded:
    """The pieces of a conversation so far: products of neighbours whose number of pieces is a power of two, and its facts."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Matrix]] = []
        self.low = self.high = None
        self.turns, self.faults, self.illegal, self.last = 0, [0] * len(FAULTS), 0, ""

    def add(self, r: dict) -> None:
        m, size = [None if c is None else (c, Rope(a)) for c, a in zip(r["costs"], r["audits"], strict=True)], 1
        while self.stack and self.stack[-1][0] == size:
            m, size = product(self.stack.pop()[1], m), 2 * size
        self.stack.append((size, m))
        if r["low"] is not None:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low = r["low"] if self.low is None else self.low
            self.high = r["high"]
        codes = [divmod(ord(c) - FIRST, len(FAULTS)) for c in self.last + r["symbols"]]
        for _, fault in codes[len(self.last):]:
            self.faults[fault] += 1
        self.illegal += sum(INITIALS[a] + INITIALS[b] not in ("su", "ua", "au") for (a, _), (b, _) in zip(codes, codes[1:], strict=False))
        self.last = r["symbols"][-1:] or self.last

    def result(self) -> tuple[dict, str]:
        whole = product_of([])
        for _, m in self.stack:
            whole = product(whole, m)
        cost, audit = finished(whole)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.faults[2], "duplicate": self.faults[3], "truncated": self.faults[1], "illegal": self.illegal, "cost": cost}, str(audit)


class Repaired:
    """Digest of the repaired rows, taken as the rows come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sum, self.any = audit, 0, 0, hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.sum.update(f"{chr(10) * self.any}{role}:{text}".encode())
        self.any = True

    def inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.state = 3 if self.state == 2 else 2
            self.line(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = MOVES[role[0]][self.state]
            self.line(role, text)
        elif edit == "R":
            self.state = 3 if self.state == 2 else 2
            self.line(ROLES[self.state], text)

    def result(self) -> str:
        self.inserted()
        return self.sum.hexdigest()


RESULT = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    rows = damaged(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()
    cut = written(pieces(marked(rows)), "pieces")
    known = written(evaluated(cut.select("symbols").distinct()), "matrices")
    parts = cut.join(known, "symbols").select("conv_id", F.lit(0).alias("_kind"), F.col("_turn").alias("turn"), F.col("_role").alias("role"), "_digest", "_at", F.lit(None).cast("string").alias("text"),
                                              F.lit(0).cast("long").alias("_n"), "symbols", "low", "high", "turns", "costs", "audits")
    texts = rows.filter("_n > 0").select("conv_id", F.lit(1).alias("_kind"), "turn", "role", F.unhex(F.md5("text")).alias("_digest"), F.lit(0).cast("long").alias("_at"), "text", "_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        done: list[dict] = []
        conv, folded, facts, walk = None, None, None, None

        def end() -> None:
            if folded is not None:
                out, audit = facts or folded.result()
                done.append({"conv_id": conv, **out, "audit": audit, "repaired_sha256": (walk or Repaired(audit)).result()})

        for b in batches:
            for r in b.to_pylist():
                if folded is None or r["conv_id"] != conv:
                    end()
                    conv, folded, facts, walk = r["conv_id"], Folded(), None, None
                if r["_kind"] == 0:
                    folded.add(r)
                    continue
                if walk is None:
                    facts = folded.result()
                    walk = Repaired(facts[1])
                for _ in range(r["_n"]):
                    walk.row(r["role"], r["text"])
            if len(done) > 1000:
                yield pa.RecordBatch.from_pydict({k: [d[k] for d in done] for k in names}, schema=form)
                done = []
        end()
        if done:
            yield pa.RecordBatch.from_pydict({k: [d[k] for d in done] for k in names}, schema=form)

    form = arrow_schema(RESULT.format(kind=kind))
    met = parts.unionByName(texts, allowMissingColumns=True).repartitionByRange("conv_id").sortWithinPartitions("conv_id", "_kind", "turn", "role", "_digest", "_at")
    return met.mapInArrow(run, RESULT.format(kind=kind))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
