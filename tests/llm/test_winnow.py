"""Winnowed fingerprints against a plain loop."""

import hashlib
import re

import xxhash

from recordweave.llm import winnow

SCHEMA = "doc_id bigint, text string, fp string, bucket int"


def slow_print(text, k=5, w=8):
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    h = []
    for x in words:
        v = xxhash.xxh64(x.encode(), seed=42).intdigest()
        h.append((v - (1 << 64) if v >> 63 else v) % winnow.PRIME)
    if 0 < len(h) < k:
        h += [0] * (k - len(h))
    grams = []
    for i in range(len(h) - k + 1):
        g = 0
        for x in h[i : i + k]:
            g = (g * winnow.BASE + x) % winnow.PRIME
        grams.append(g)
    out = []
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        run = [(grams[p], -p) for p in range(i, min(i + w, len(grams)))]
        g, p = min(run)
        if (g, -p) not in out:
            out.append((g, -p))
    return out


def slow_text(entries):
    return ",".join(f"{g:X}:{p}" for g, p in entries)


def alike(a, b):
    x, y = {g for g, _ in a}, {g for g, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def slow(rows):
    rows = sorted(((-(1 << 63) if i is None else i, t or "", i) for i, t in rows), key=lambda r: r[:2], reverse=True)
    out = []
    for k, (_, text, i) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        take = len(text) // 3
        edited = text[: len(text) - take] + after[:take]
        a, b, c = slow_print(text), slow_print(edited), slow_print(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), slow_text(a), slow_text(b), round(alike(a, b), 9), round(alike(a, c), 9)))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in winnow.edited_report(df).collect()), key=str)


def test_whole_table_and_odd_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000, None), (9000, ""), (9001, "one"), (9002, "one two three"), (90000, " ".join(str(i % 701) for i in range(3000))),
             (9003, "a a a a a a a a a a a a a a a a a a"), (None, "no id here at all but words"), (-7, "été \U0001F600 b"), (9001, "one more")]
    assert got(spark, rows) == slow(rows)


def test_one_row_and_none(spark):
    rows = [(1, "the only text of the table is its own next one")]
    assert got(spark, rows) == slow(rows)
    assert got(spark, []) == []


def test_shared_run_is_found(spark):
    shared = " ".join(f"s{i}" for i in range(12))
    rows = [(1, " ".join(f"a{i}" for i in range(50)) + " " + shared), (2, shared + " " + " ".join(f"b{i}" for i in range(70)))]
    assert {r[0]: r[6] for r in got(spark, rows)}[2] > 0


def test_no_python_in_the_plan(spark):
    df = winnow.edited_report(spark.createDataFrame([], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
