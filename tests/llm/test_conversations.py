"""Chat formatting and repair of conversations against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rowfeed.llm import chat_grammar, turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ODD = [
    (1, 0, "user", "[\\INST] <s>"), (1, 1, "<s>", "a</s>"), (1, 2, "x[/ROLE]", "[ROLE"), (1, 3, None, None), (2, None, "system", "<<SYS>>"), (2, None, "user", "a."),
    (2, 0, "assistant", "<\\\\s>"), (None, 0, "assistant", "</s"), (None, None, "user", ">"), (None, None, None, None), (3, 0, "", "[ROLE]a[/ROLE]<s>b</s>"), (4, 0, "assistant", ""),
    (4, 0, "assistant", ""), (5, 7, "user", "é😀 \x00 [/INST"), (5, 9, "assistant", "<</SYS>> </\\s> $1 \\2"), (6, 0, "user", "[INST]" * 20_000), (6, 1, "assistant", "<\\s>" * 20_000),
]


@pytest.fixture(scope="module")
def odd_turns(spark):
    rows = [(*r, 1, True, "x", [1]) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", n_turns int, escaped boolean, edit string, segments array<int>").repartition(3)


def plain_format(rows):
    """conv_id -> what the contract asks for of the turns, without any template."""
    talks = defaultdict(list)
    for c, t, role, text in rows:
        talks[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        lines = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_turns_and_loss_come_back(odd_turns):
    got = chat_grammar.format_digest(chat_grammar.format_conversations(odd_turns)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain_format(ODD)


def test_no_control_string_is_left_in_a_text(odd_turns):
    for r in chat_grammar.format_conversations(odd_turns).collect():
        bodies = [s.text for s in r.segments][1::3]
        assert not any(re.search(chat_grammar.CONTROL, b) for b in bodies)
        assert r.rounds < 2 and (r.rounds == 0 or any("\\" in b for b in bodies))


def test_random_turns_come_back(spark):
    r = random.Random(3)
    bits = ["[", "<", "\\", "/", "s>", "INST]", "ROLE]", "<SYS>>", "\n", " ", "a", "[INST]", "</s>"]
    rows = [(c, t, "".join(r.choice(bits) for _ in range(r.randrange(4))) if r.random() < 0.3 else r.choice(["system", "user", "assistant"]), "".join(r.choice(bits) for _ in range(r.randrange(12)))) for c in range(400) for t in range(r.randrange(1, 5))]
    got = chat_grammar.format_digest(chat_grammar.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in got} == plain_format(rows)


def test_format_equals_sql(spark, sf, odd_turns):
    for frame in (spark.read.parquet(f"{sf}/conversations.parquet"), odd_turns):
        got = chat_grammar.format_digest(chat_grammar.format_conversations(chat_grammar.with_probe(frame)))
        names, con = sorted(got.columns), duckdb.connect()
        con.register("conversations", frame.select("conv_id", "turn", "role", "text").toArrow())
        want = con.sql(f"SELECT {', '.join(names)} FROM ({chat_grammar.format_sql()})").fetchall()
        assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want, key=str)


def test_format_is_native_and_takes_empty_tables(odd_turns, spark):
    out = chat_grammar.format_digest(chat_grammar.format_conversations(odd_turns))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert chat_grammar.format_conversations(odd_turns.limit(0)).count() == 0
    empty = chat_grammar.format_digest(chat_grammar.format_conversations(chat_grammar.with_probe(odd_turns.limit(0)))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in empty] == [(-7, 2, 21)]


# Repair


def legal(roles):
    return re.fullmatch("(s?(ua)*u?)?", roles)


def cheapest(rows):
    """(cost, audit, roles) of the cheapest edits of rows (initial, fault), least audit first: all sequences by cost, then audit."""
    heap, seen, found, bound = [(0, "", 0, "")], set(), [], None
    while heap:
        cost, audit, k, out = heapq.heappop(heap)
        if bound is not None and cost > bound:
            break
        if (cost, audit, k, out) in seen:
            continue
        seen.add((cost, audit, k, out))
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            bound = cost
            found.append((audit, out))
        if k < len(rows):
            initial, fault = rows[k]
            more = 5 * (fault == "truncated")
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, out))
            if fault in (None, "truncated"):
                if initial in ("s", "u", "a") and legal(out + initial):
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, out + initial))
                for role in "ua":
                    if legal(out + role):
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", k + 1, out + role))
        for role in "ua":
            if legal(out + role) and audit.count("I") < 4:
                heapq.heappush(heap, (cost + 5, audit + "I", k, out + role))
    return bound, *min(found)


WHITE = " \t\n\v\f\r"


def plain_repair(rows):
    talks, originals = defaultdict(list), []
    for conv, turn, role, text in rows:
        originals.append(conv)
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        talks[conv] += [(turn is not None, turn or 0, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv in set(originals):
        turns, seen, faults = sorted(talks[conv]), set(), []
        for _, _, role, text in turns:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        marks = [role[:1] for _, _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit, roles = cheapest(list(zip(marks, faults))) if turns else (0, "", "")
        lines, k, place = [], 0, 0
        for edit in audit:
            if edit != "D":
                own = turns[k][2] if edit == "K" else {"u": "user", "a": "assistant"}[roles[place]]
                lines.append(f"{own}:{'' if edit == 'I' else turns[k][3]}")
                place += 1
            k += edit != "I"
        at = [t for there, t, _, _ in turns if there]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        out[conv] = (gaps, *(faults.count(f) for f in turn_repair.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(turns):
    got = turn_repair.repair_digest(turn_repair.repair_conversations(turn_repair.damage(turns))).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_automaton_equals_all_sequences():
    auto, r = turn_repair.Determinised(), random.Random(1)
    faults = [None, *turn_repair.FAULTS]
    for _ in range(600):
        rows = [(r.choice("suax") if r.random() < 0.6 else "ua"[k % 2], r.choice([0, 0, 0, 1, 2, 3])) for k in range(r.randrange(8))]
        symbols = bytes("suax".index(i) * 4 + f for i, f in rows)
        edits, last = auto.edits(symbols)
        state, cost = auto.end, auto.end_cost
        for symbol in reversed(symbols):
            state, more = auto.before(state, symbol)
            cost += more
        assert (cost + auto.vectors[state][turn_repair.START], "".join(edits) + last) == cheapest([(i, faults[f]) for i, f in rows])[:2]
    assert len(auto.vectors) < 60


def test_repair_equals_plain(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert repaired(turns) == plain_repair(rows)


def test_repair_of_odd_and_empty_tables(odd_turns):
    assert repaired(odd_turns) == plain_repair(ODD)
    assert repaired(odd_turns.limit(0)) == {}


def test_repair_of_random_turns(spark):
    r = random.Random(8)
    texts = ["Yes.", "No", "", " \t", "Why?", "Well . ", None, "a.b"]
    rows = [(c if c % 9 else None, r.choice([t, t, t + 3, None]), r.choice(["system", "user", "assistant", "tool", "", None]), r.choice(texts)) for c in range(1, 300) for t in range(r.randrange(1, 6))]
    short = [x for x in rows if x[0] is not None]
    assert repaired(spark.createDataFrame(short, SCHEMA).repartition(5)) == plain_repair(short)


def test_long_conversation_is_spooled(spark, monkeypatch):
    """A conversation of many rows over many batches, with rows in a file, is repaired as in one batch."""
    r = random.Random(4)
    rows = [(c, t, ("user", "assistant")[t % 2] if r.random() < 0.8 else r.choice(["user", "system", "tool"]), f"{c} {t} {'x' * 50}" + r.choice([".", ".", ".", ""])) for c, n in ((1, 3), (2, 3000), (3, 2), (4, 2000)) for t in range(n)]
    turns = turn_repair.damage(spark.createDataFrame(rows, SCHEMA)).coalesce(1)
    numbered = turn_repair._numbered(turns).coalesce(1).sort(F.asc_nulls_first("conv_id"), "turn", "role", "text").toArrow().to_batches()
    whole = list(turn_repair._repair(iter(numbered)))
    monkeypatch.setattr(turn_repair, "HELD_BYTES", 20_000)
    parts = [b.slice(k, 100) for b in numbered for k in range(0, b.num_rows, 100)]
    cut = list(turn_repair._repair(iter(parts)))

    def rows_of(batches):
        return [x for b in batches for x in b.to_pylist()]

    assert rows_of(whole) == rows_of(cut)
    assert sum(x["cost"] for x in rows_of(cut)) == sum(v[5] for v in repaired(spark.createDataFrame(rows, SCHEMA)).values())
    roles = defaultdict(str)
    for x in rows_of(cut):
        roles[x["conv_id"]] += (x["new_role"] or "")[:1]
    assert all(re.fullmatch("(s?(ua)+)?", v) for v in roles.values())
