"""Conversation repair against a shortest-path search over whole edit lists in plain Python."""

import hashlib
import heapq
import random
import zlib

from pyspark.sql import functions as F

from sightline.llm import conversations
from sightline.llm.conversations import Repair, damaged, repair_report

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def repair(rows):
    """cost, audit, lines: cheapest first, then the least audit, by a search that carries whole audits."""
    found = faults(rows)
    queue, done = [(0, "", 0, "", ())], {}
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done[(i, state)] = True
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        following = "assistant" if state == "u" else "user"
        heapq.heappush(queue, (cost + 3, audit + "I", i, following[0], lines + (following + ":",)))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, lines))
            if found[i] not in ("blank", "duplicate"):
                extra = 3 if found[i] else 0
                heapq.heappush(queue, (cost + 3 + extra, audit + "R", i + 1, following[0], lines + (f"{following}:{text}",)))
                if role[:1] == following[0] or role[:1] == "s" and state == "":
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, role[:1], lines + (f"{role}:{text}",)))


def expected(table):
    """Per conversation: gaps, faults, illegal pairs, cost, audit, digest."""
    convs, out = {}, {}
    for conv, turn, role, text in table:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role,
                                           " " if text is None else text))
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = [r[1] for r in rows if r[0]]
        pairs = [(r[2], r[3]) for r in rows]
        found = faults(pairs)
        initials = [r[:1] for r, _ in pairs]
        cost, audit, lines = repair(pairs)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[found.count(f) for f in (
            "blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(df, **options):
    rows = Repair(df, **options).report().collect()
    assert len({r.conv for r in rows}) == len(rows)
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "using"]
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "End. \n", "Wait...\t", "ünï?", "a.b"]
    return [(c if c else None, rng.choice([None, t, t, t, t // 2]), rng.choice(roles), rng.choice(texts) if rng.random() < .5
             else f"text {rng.randrange(10 ** 6)}.") for c in range(convs) for t in range(rng.randrange(1, most + 1))]


def test_equals_search(spark):
    rows = random_rows(1, 80, 9)
    assert report(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_long_conversations_in_many_blocks(spark):
    rows = random_rows(2, 3, 260) + [(9, t, "user", "Same.") for t in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert report(df, block=16) == expected(rows)


def test_repaired_rows_follow_the_rule(spark):
    rows = random_rows(3, 20, 8)
    made = {}
    for r in Repair(spark.createDataFrame(rows, SCHEMA)).repaired().orderBy("pos").collect():
        made.setdefault(r.conv, []).append(r)
    want = expected(rows)
    for conv, lines in made.items():
        initials = "".join(r.role[:1] for r in lines).removeprefix("s")
        assert initials and initials == "ua" * (len(initials) // 2)
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == want[conv][-1]
    assert {c for c, w in want.items() if set(w[6]) != {"D"}} == set(made)


def test_damage_and_missing_conversations(spark):
    rows = [(c if c else None, t if t else None, "user" if t % 2 else "assistant", f"Text {t}. Ends!") for c in range(40)
            for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    made, kinds = [], set()
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kinds.add(kind)
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            made += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    assert {0, 1, 2, 3, 4} <= kinds
    bad = damaged(df)
    assert sorted(map(repr, map(tuple, bad.collect()))) == sorted(map(repr, made))
    want = expected(made)
    clash = df.union(spark.createDataFrame([(77, 1, "user", "Gone.")], SCHEMA))
    found = repair_report(bad.withColumns({n: F.lit(1) for n in ("c", "i", "x", "pos", "conv", "letter")}), clash).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert got == {**want, 77: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()),
                   **{c: got[c] for c in got if c not in want and c != 77}}
    assert len(found) == 41


def test_empty_table_long_text_and_lone_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_report(empty, empty).count() == 0
    rows = [(1, 1, "user", "a" * 400_000 + "."), (2, None, None, None), (3, 5, "system", "Only."), (4, 2, "assistant", "Hm")]
    assert report(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_every_arc_is_listed_once_by_letter():
    for kind in range(16):
        arcs = [(s, letter) for s, _, _, letter in conversations._ARCS[kind]]
        assert len(arcs) == len(set(arcs))
