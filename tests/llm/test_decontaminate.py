import hashlib
import random
import re

import pytest

from auditspark.llm import decontaminate as d

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(rows, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - width + 1, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        w, hit, held = words(text), set(), set()
        for window, ids in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    held |= ids
        digest = hashlib.sha256(",".join(sorted(held, key=str.encode)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(held), digest, bool(hit)))
    return sorted(out, key=str)


def made_up(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "The", "the", "über", "Éa", "x1", "99", "c", "d", "e", "日本"]
    text = lambda n: rnd.choice([" ", "-", ". ", "\n"]).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, text(rnd.choice([10, 11, 25, 14]))) for k in range(12)] + [(40, text(4)), (41, text(3)), (None, text(12))]
    items += [items[0], (2, text(13)), (50, "a b c d e " * 4), (51, None), (52, " .,;"), (3, items[1][1])]
    rows = []
    for k in range(120):
        parts = [text(rnd.randint(0, 20))]
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            whole = words(rnd.choice(items)[1])
            parts += ["/".join(whole[rnd.randrange(3) : len(whole) - rnd.randrange(3)]), text(rnd.randint(0, 5))]
        rows.append((k, "-".join(parts)))
    rows += [(None, rows[3][1]), (5, rows[5][1]), (500, None), (501, ""), (502, "..."), (503, "a b c d e " * 30), (504, "\0a\0b")]
    return rows, items


@pytest.mark.parametrize("seed,limit,short", [(1, d.BROADCAST_BYTES, []), (2, 0, []), (3, d.BROADCAST_BYTES, [(60, "über"), (61, "c-d")]),
                                              (4, 0, [(60, "99"), (61, "e E")])])
def test_equals_brute_force(spark, docs, seed, limit, short):
    rows, items = made_up(seed)
    items = items + short
    given = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in d.report(docs(rows), given, limit=limit).collect()]
    assert sorted(got, key=str) == expected(rows, items)


def test_other_widths_and_columns(spark, docs):
    rows, items = made_up(5)
    given = spark.createDataFrame(items, "k int, passage string")
    got = d.report(docs(rows), given, item_id_col="k", item_text_col="passage", width=5).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, items, 5)


def test_spans_items_and_kept_documents(spark, docs):
    passage = "one two three four five six seven eight nine ten eleven"
    given = spark.createDataFrame([(1, passage), (2, passage.upper())], "item_id long, text string")
    table = docs([(1, "x " + passage + " y"), (2, "nothing here"), (None, None)])
    row = {r["doc_id"]: r for r in d.contamination(table, given).collect()}
    assert sorted(map(tuple, row[1]["spans"])) == [(1, 10), (2, 10)] and row[1]["items"] == ["1", "2"]
    kept = d.decontaminated(table, given).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [2, None] and len(kept[0]) == 7


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [tuple(r)[1:4] for r in d.report(docs([(1, "a b c d")]), none).collect()] == [(4, 0, 0)]
    assert d.report(docs([]), some).collect() == []


def test_no_python_on_the_main_path(spark, docs):
    given = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = d.report(docs([(1, "a b c d")]), given)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
