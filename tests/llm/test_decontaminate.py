from itertools import combinations

import duckdb
import pandas as pd

from riskloom.llm import decontaminate as d
from riskloom.llm import oracle


def test_masks_are_lossless():
    for lost in combinations(range(d.WINDOW), d.TOLERANCE):
        assert any(not {s + i for i in mask} & set(lost) for mask in d.MASKS for s in range(d.WINDOW - d.SPAN + 1))
    for w in range(1, d.WINDOW):
        span, family = d.masks(w)
        assert span == w and all(0 <= i < w for mask in family for i in mask)
        assert all(any(lost not in mask for mask in family) for lost in range(w)) == (w >= d.SHORT)


def brute(docs, items):
    out = {}
    for doc, text in docs:
        w = (text or "").lower().split()
        for item, passage in items:
            p = (passage or "").lower().split()
            if not p:
                continue
            n, allowed = min(d.WINDOW, len(p)), 2 if len(p) >= 13 else 1 if len(p) >= 8 else 0
            lines = {}
            for i in range(len(w) - n + 1):
                for j in range(len(p) - n + 1):
                    same = sum(a == b for a, b in zip(w[i:i + n], p[j:j + n]))
                    if same >= n - allowed:
                        lines.setdefault(i - j, []).append((j, same))
            if lines:
                tokens, matches = out.get((doc, item), (0, 0))
                out[doc, item] = (max(tokens, *(max(j for j, _ in x) + n - min(j for j, _ in x) for x in lines.values())),
                                  max(matches, *(s for x in lines.values() for _, s in x)))
    return out


def test_against_brute_force(spark, documents, prose):
    items = [(k, " ".join(prose(k, n))) for k, n in enumerate([30, 20, 13, 10, 8, 7, 45, 1, 12, 2])] + [(19, None), (20, "")]
    changed = lambda t, *at: " ".join("zzz" if i in at else w for i, w in enumerate(t.split()))
    docs = [(1, None), (2, ""), (3, "  ,,  "), (4, items[0][1]), (5, changed(items[0][1], 3, 9, 15, 21)), (6, changed(items[0][1], *range(0, 30, 4))),
            (7, " ".join(prose(50, 40)) + " " + changed(items[1][1], 0, 19) + " " + " ".join(prose(51, 30))), (8, items[2][1]),
            (9, changed(items[2][1], 5, 6)), (10, changed(items[2][1], 5, 6, 7)), (11, items[3][1]), (12, changed(items[3][1], 2)), (13, items[4][1]),
            (14, items[5][1]), (15, " ".join(items[6][1].split()[10:30])), (16, " ".join(prose(60, 3000)) + " " + items[6][1].upper()), (17, items[0][1]), (17, items[0][1]),
            (18, changed(items[3][1], 2, 7)), (19, changed(items[4][1], 7)), (20, changed(items[5][1], 0)), (21, items[7][1]), (22, "a " + changed(items[8][1], 0) + " b"), (23, items[9][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {(a, b, 1, *v) for (a, b), v in brute([(i, t) for i, t in docs], items).items()}
    found = {w[:2] for w in want}
    assert {(4, 0), (5, 0), (7, 1), (9, 2), (11, 3), (12, 3), (13, 4), (14, 5), (15, 6), (16, 6), (19, 4), (21, 7), (22, 8), (23, 9)} <= found
    assert not {(10, 2), (18, 3), (20, 5)} & found
    for limit in (200_000, 0):  # broadcast and shuffled
        assert {tuple(r) for r in d.overlaps(documents(docs), table, broadcast_seeds=limit).collect()} == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(list({r for r in docs}), columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    assert set(con.sql(oracle.DECONTAMINATION).fetchall()) == want


def test_equal_items_are_one_class_with_all_its_members(spark, documents):
    """Short questions, a changed word, items of equal text, ids that repeat, other columns."""
    asked, other = "What is the capital of France?", "name the longest river that runs through the country"
    rows = [(5, asked, "x"), (3, asked, "y"), (7, other, "z"), (7, "a third text", None), (8, None, None), (9, "", None)]
    table = spark.createDataFrame(rows, "item_id long, text string, n_items string")
    docs = documents([(1, f"Q: {asked} A: Paris"), (2, other.replace("longest", "widest")), (3, "the capital of France"), (4, "is a third text")])
    docs = docs.selectExpr("*", "'s' as seed", "1 as p", "2 as h", "3 as item_id")
    got = {tuple(r) for r in d.overlaps(docs, table).collect()}
    assert got == {(1, 3, 2, 6, 6), (2, 7, 1, 9, 8), (4, 7, 1, 3, 3)}
    members = {tuple(r) for r in d.equal_items(table).collect()}
    assert members == {(5, 3), (3, 3), (7, 7), (8, 8), (9, 8)}
    kept = d.decontaminate(docs, table)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4] and kept.columns == docs.columns
    assert d.decontaminate(docs, table, shortest=1).count() == 1


def test_filter_keeps_clean_rows_and_nulls(spark, documents, prose):
    item = " ".join(prose(1, 20))
    table = spark.createDataFrame([(0, item), (1, item)], "item_id long, text string")
    docs = documents([(None, "clean"), (1, item), (2, None), (3, "clean"), (3, "clean")])
    kept = d.decontaminate(docs, table)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 3), (False, 3), (True, 0)]
    assert kept.columns == docs.columns
    assert d.overlaps(docs, table.limit(0)).count() == 0 and d.overlaps(docs.limit(0), table).count() == 0
    assert d.decontaminate(documents([(None, item)]), table).count() == 0


def test_shuffled_seeds_leave_their_documents_behind(spark, documents, prose):
    """A text of 20,000 words on the shuffled path; no whole document is under an exchange."""
    item = " ".join(prose(2, 25))
    table = spark.createDataFrame([(0, item)], "item_id long, text string")
    long = " ".join(prose(3, 10_000)) + " " + item + " " + " ".join(prose(4, 10_000))
    docs = documents([(1, long), (2, "clean")])
    got = d.overlaps(docs, table, broadcast_seeds=0)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in d.overlaps(docs, table).collect()] == [(1, 0, 1, 25, 13)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    output = [line for line in plan.splitlines() if "Exchange hashpartitioning(seed" in line]
    assert output and "slice(h" in plan
