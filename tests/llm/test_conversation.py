import hashlib
import itertools
import random
import re
import zlib

import pytest

from auditspark.llm import conversation as c


def blank(text):
    return not re.search(r"[^\x20\x09-\x0d]", text)


def damage(rows):
    """Rows after damage, by conversation; every conversation has an entry."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if blank(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("fine" if re.findall(r"[^\x20\x09-\x0d]", text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, fault, most_inserts=3):
    """All edits of all rows with all inserts between them, none left out for its cost."""
    best = (10**9, "~", None)

    def walk(at, cost, audit, lines, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if at == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = min(best, (cost, audit, lines), key=lambda b: b[:2])
        else:
            _, role, text = rows[at]
            walk(at + 1, cost + 2, audit + "D", lines, 0)
            if fault[at] in ("fine", "truncated"):
                late = 5 * (fault[at] == "truncated")
                walk(at + 1, cost + late, audit + "K", lines + [(role, text)], 0)
                for other in ("user", "assistant"):
                    walk(at + 1, cost + late + 1, audit + "R", lines + [(other, text)], 0)
        if inserts < most_inserts:
            for other in ("user", "assistant"):
                walk(at, cost + 5, audit + "I", lines + [(other, "")], inserts + 1)

    walk(0, 0, "", [], 0)
    return best


def expected(rows):
    out = []
    for conv, kept in damage(rows).items():
        fault = faults(kept)
        turns = {t for t, _, _ in kept if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(kept)]
        cost, audit, lines = cheapest(kept, fault)
        whole = "\n".join(f"{r}:{t}" for r, t in lines)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(whole.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(spark, rows, **settings):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = c.repaired(c.with_faults(c.damaged(df)), **settings)
    return sorted(map(tuple, found.collect()), key=str)


def made_up(seed, conversations=60, longest=5):
    rnd, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "so it", "a b. ", "x.y", "", " \t\n", "\x0b", "Été?\x0c", None, "Yes."]
    for conv in range(conversations):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            rows.append((conv, rnd.choice([turn, turn, turn + 3, None]), role, rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_trying_all_edits(spark, seed):
    rows = made_up(seed)
    assert got(spark, rows) == expected(rows)


def test_cut_conversations_travel_as_segments(spark):
    rows = made_up(4)
    assert got(spark, rows, segment_bytes=1) == expected(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Yes."), (None, 1, "user", "Yes."), (7, None, "user", "Yes."),
            (7, 2, "assistant", "No."), (7, 2, "assistant", "No."), (7, 2, "assistant", "Also.")]
    assert got(spark, rows) == expected(rows)


def test_conversation_without_rows_after_damage(spark):
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert got(spark, [(conv, 0, "user", "Yes.")]) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_one_very_long_conversation(spark):
    """Beyond what an enumeration can do: the cost of a known repair, and its hash by hand."""
    n = 4000
    free = [t for t in range(3 * n) if zlib.crc32(f"1:{t}".encode()) % 20 > 4][:n]
    rows = [(1, t, "ua"[k % 2] and ("user", "assistant")[k % 2], f"Text {k}.") for k, t in enumerate(free)]
    rows[1001] = (1, free[1001], "user", "Other.")
    (found,) = got(spark, rows, segment_bytes=1 << 12)
    lines = [f"{'assistant' if k == 1001 else r}:{t}" for k, (_, _, r, t) in enumerate(rows)]
    assert found[5:] == (2, 1, "K" * 1001 + "R" + "K" * (n - 1002), hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_empty_table_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, kind int, fault string, conv long"
    assert c.repair(spark.createDataFrame([], schema)).collect() == []
    (row,) = c.repair(spark.createDataFrame([(1, 0, "user", "Yes.", 1, "x", 5)], schema)).collect()
    assert row["conv_id"] == 1 and len(row) == 9


def test_grammar_states(spark):
    stacks = c.Stacks()
    assert len(c.Repair(stacks).tops) == 5
    with pytest.raises(ValueError):
        c.Stacks((("whole", ("x",)), ("x", ("u", "y")), ("x", ("s", "y")), ("y", ("a",))))
