"""Conversation repair against a plain dynamic program over whole audits, and against every sequence of edits for short rows."""
import hashlib
import random
import re
import zlib
from collections import Counter

from ionweave.llm import repair as R
from tests.llm.common import saved

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
STRIP = " \t\n\x0b\x0c\r"


def edits_by_hand(rows, every=False):
    """Least (cost, audit) for rows of (initial, fault). ``every`` keeps all audits, not the least of each state."""
    def least(entries):
        out = {}
        for state, cost, audit in entries:
            out.setdefault(state, set()).add((cost, audit))
        for state, some in out.items():
            low = min(c for c, _ in some)
            some = {e for e in some if e[0] == low}
            out[state] = some if every else {min(some)}
        return out

    def inserted(at):
        todo = [(s, c, a) for s, some in at.items() for c, a in some]
        found = list(todo)
        for _ in range(3):
            todo = [(NEXT[s, r], c + 3, a + "I") for s, c, a in todo for r in "ua" if (s, r) in NEXT]
            found += todo
        return least(found)

    at = {"": {(0, "")}}
    for initial, fault in rows:
        found = []
        for s, some in inserted(at).items():
            for c, a in some:
                found.append((s, c + 4, a + "D"))
                extra = 3 if fault == "truncated" else 0
                if fault not in ("blank", "duplicate"):
                    found += [(NEXT[s, r], c + 3 + extra, a + "R") for r in "ua" if (s, r) in NEXT]
                    found += [(NEXT[s, initial], c + extra, a + "K")] if (s, initial) in NEXT else []
        at = least(found)
    end = inserted(at)
    return min(e for s in ("", "a") for e in end.get(s, ()))


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def conversation_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(STRIP)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    cost, audit = edits_by_hand(list(zip(initials, faults, strict=True)))
    state, lines, left = "", [], iter(rows)
    for e in audit:
        if e == "I":
            state = "a" if state == "u" else "u"
            lines.append({"u": "user:", "a": "assistant:"}[state])
            continue
        _, _, role, text = next(left)
        if e == "K":
            state = role[0]
            lines.append(f"{role}:{text}")
        elif e == "R":
            state = "a" if state == "u" else "u"
            lines.append({"u": "user:", "a": "assistant:"}[state] + text)
    turns = [r[1] for r in rows if r[1] is not None]
    count = Counter(faults)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_hand(rows):
    groups = {r[0]: [] for r in rows}
    for r in damaged_by_hand(rows):
        groups[r[0]].append(r)
    return {c: conversation_by_hand(g) for c, g in groups.items()}


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


FAULT = {" ": "", "t": "truncated", "b": "blank", "d": "duplicate"}


def test_products_equal_every_sequence_of_edits():
    rng = random.Random(12)
    for _ in range(150):
        rows = [[(rng.choice("sua?uaua"), rng.choice("  ttbd   ")) for _ in range(rng.randint(0, 8))] for _ in range(6)]
        for r, m in zip(rows, R.matrices(["".join(R.symbol(*x) for x in r) for r in rows]), strict=True):
            cost, audit = R.finished(m)
            assert (cost, str(audit)) == edits_by_hand([(i, FAULT[f]) for i, f in r], every=True)


def test_grammar_gives_the_texts_back_and_leaves_no_pair_twice():
    rng = random.Random(13)
    for _ in range(200):
        texts = ["".join(rng.choice("ABC") for _ in range(rng.randint(0, 60))) for _ in range(5)] + ["A" * rng.randint(0, 50)]
        rules, rest = R.grammar(texts)
        whole = lambda s: chr(s) if s < 256 else whole(rules[s - 256][0]) + whole(rules[s - 256][1])   # noqa: E731, B023
        assert ["".join(map(whole, r)) for r in rest] == texts
        pairs = Counter()
        for r in rest:
            i = 0
            while i < len(r) - 1:
                pairs[r[i], r[i + 1]] += 1
                i += 2 if r[i:i + 3] == [r[i]] * 3 else 1
        assert not [p for p, n in pairs.items() if n > 1]


def test_ropes_compare_as_texts():
    rng = random.Random(14)
    for _ in range(500):
        text = "".join(rng.choice("AB") for _ in range(rng.randint(0, 12)))
        other = text[:rng.randint(0, 12)] + rng.choice(["", "A", "BA"])
        ropes = []
        for t in (text, other):
            cuts = sorted(rng.randint(0, len(t)) for _ in range(3))
            parts = [R.Rope(t[a:z]) for a, z in zip([0, *cuts], [*cuts, len(t)], strict=True)]
            ropes.append(parts[0].joined(parts[1].joined(parts[2])).joined(parts[3]))
        assert str(ropes[0]) == text and ropes[0].less(ropes[1]) == (text < other)


def test_query_equals_plain_python(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert got(R.op12_conversation_repair(spark, sf)) == by_hand(rows)


def test_edges(spark, tmp_path):
    rng = random.Random(15)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "User", "agent", "é"], ["Hello.", "no end", "", "  \t", None, "End!\n ", "\x0b.", "é?", "Hello."]
    rows = [(None if c == 0 else c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(100, 3, "user", "x" * 100_000)] * 3 + [(101, 2**40, "user", "a."), (101, -2**40, "assistant", "b.")]
    gone = [c for c in range(200, 400) if zlib.crc32(f"{c}:1".encode()) % 20 == 0][:3]
    rows += [(c, 1, "user", "a.") for c in gone]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS _n", "'x' AS symbols", "2 AS costs", "3 AS _kind")
    have = got(R.op12_conversation_repair(spark, saved(spark, tmp_path, conversations=df)))
    assert gone and have == by_hand(rows) and all(have[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)
    assert not R.repaired(df.filter("false")).collect()


def test_a_conversation_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 1000)
    rng = random.Random(16)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["A.", "b", f"text {t}."])) for t in range(5000)]
    rows += [(2, 7, "user", "same.")] * 5000 + [(3, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(40)]
    have = got(R.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)))
    assert have == by_hand(rows) and len(have[1][6]) > 2 * R.PIECE
