"""Line chunks: boundaries, removals, odd rows, and the SQL twin."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from recordweave.llm import lines

DOCS = "doc_id bigint, text string, n_chars bigint, number int, hash string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), 1, "h") for i, t in rows], DOCS)


def slow(rows):
    """Texts after removal, by (doc_id, text): what an earlier place has goes, if it is a chunk or a long run."""
    seen, out = set(), []
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda r: r[:2] + (lines_sig(r[2]),))
    for _, i, t in order:
        all_lines = t.encode().split(b"\n")
        gone, flag = set(), set()
        for _, start, part in lines.chunks(t.encode()):
            if len(part) > 1:
                key = ("chunk", *part)
                gone |= set(range(start, start + len(part))) if key in seen else set()
                seen.add(key)
        a = 0
        for b, line in enumerate(all_lines, 1):
            if b < len(all_lines) and len(line.split()) <= 10 and hashlib.md5(line).digest()[3] % 2:
                continue
            for k in range(a, b):
                for key, reach in ((("head", *all_lines[a : k + 1]), range(a, k + 1)), (("tail", *all_lines[k:b]), range(k, b))):
                    flag |= set(reach) if key in seen else set()
                    seen.add(key)
            a = b
        run = []
        for k in range(len(all_lines) + 1):
            if k in flag:
                run.append(k)
            else:
                gone |= set(run) if sum(len(all_lines[j].split()) for j in run) > 50 else set()
                run = []
        out.append((i, t, b"\n".join(x for k, x in enumerate(all_lines) if k not in gone).decode()))
    return out


SIG = {}


def lines_sig(text):
    return SIG[text]


def test_chunks_cover_and_resist_shifts():
    text = b"\n".join(b"line %d" % i for i in range(200))
    parts = [part for _, _, part in lines.chunks(text)]
    assert b"\n".join(x for p in parts for x in p) == text
    shifted = [part for _, _, part in lines.chunks(b"new\nlines\nbefore\n" + text)]
    assert sum(p in shifted for p in parts) >= len(parts) - 2
    assert [p for _, _, p in lines.chunks(b"")] == [[b""]]


def test_removal_of_repeats_and_odd_rows(spark):
    part = "\n".join(f"shared line number {i}" for i in range(30))
    rows = [(1, part), (2, "own start\n" + part + "\nown end"), (3, part + "\n" + part), (4, None), (5, ""), (6, "single"), (7, "single"),
            (8, "\n\n\n"), (9, "é\n" + part), (1, part), (None, part), (10, "a\nb\n" * 3000)]
    df = make(spark, rows)
    SIG.update({r.text: r.s for r in df.select("text", lines.sig().alias("s")).collect() if r.text is not None})
    want = {(i, t): kept for i, t, kept in slow([r for r in rows if r[0] is not None])}
    out = lines.dedup_lines(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = out.collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.doc_id == 1] == [""] * 2  # a null doc_id comes first, and the run is long
    assert next(r.text for r in got if r.doc_id == 4) is None and next(r.text for r in got if r.doc_id is None) == part
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    without = lines.dedup_lines(make(spark, [r for r in rows if r[0] is not None])).collect()
    by = {i: t for i, t in rows}
    for r in without:
        if r.doc_id not in (1, 4):
            assert r.text == want[r.doc_id, by[r.doc_id]], r.doc_id
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_report_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = lines.line_report(spark.read.parquet(f"{folder}/documents.parquet"))
    want = con.execute(f"SELECT {','.join(df.columns)} FROM ({lines.SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_hot_chunk(spark):
    part = "alpha line\nbeta line\ngamma line\ndelta line\nomega line"
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(part + "\nrow "), "id").alias("text"))
    got = lines.line_report(df)
    assert got.filter("removed_chunks > 0").count() == 2999 and got.filter("doc_id = 0 and removed_chunks > 0").count() == 0


def test_passages_of_any_shape_go_whole(spark):
    """Passages of over 50 words in 1 to 5 lines, between other lines: all later copies go, whole, and nothing else."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for p in range(60):
        m = p % 5 + 1
        sizes = [51 // m + 1] * m
        if m > 1 and p % 2:
            sizes = [2] * (m - 1) + [51 - 2 * (m - 1)]
        passage = [line(n) for n in sizes]
        for copy in range(3):
            before, after = [line(rng.randint(1, 30)) for _ in range(4)], [line(rng.randint(1, 30)) for _ in range(4)]
            doc = 3 * p + copy
            rows.append((doc, "\n".join(before + passage + after)))
            want[doc] = "\n".join(before + (passage if copy == 0 else []) + after)
    got = {r.doc_id: r.text for r in lines.dedup_lines(make(spark, rows)).collect()}
    assert got == want


def test_short_repeats_stay_and_removals_leave_one_copy(spark):
    rng = random.Random(6)
    pool = [" ".join(f"w{k}{j}" for j in range(k % 23)) for k in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    rows += [(500, "own words here\n" + pool[22] + "\nmore own words"), (501, "other\n" + pool[22] + "\nand others")]
    df = make(spark, rows)
    SIG.update({r.text: r.s for r in df.select("text", lines.sig().alias("s")).collect()})
    want = {i: kept for i, _, kept in slow(rows)}
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert got == want and pool[22] in got[500] and pool[22] in got[501]
    assert {x for _, t in rows for x in t.split("\n")} == {x for t in got.values() for x in t.split("\n")} | {""}


def test_what_was_shuffled_to_compare_is_gone_before_the_texts_move_again(spark):
    passage = "\n".join(f"line {i} of a passage that is found in several texts of this table" for i in range(6))
    df = make(spark, [(i, f"{passage}\nown {i}") for i in range(30)]).repartition(3)

    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffled()
    cuts = lines.with_cuts(df)
    assert not shuffled() - before
    # left: the texts and their cuts, and the deal of the input above; nothing of the comparison
    assert "bytes" not in cuts._jdf.queryExecution().optimizedPlan().toString()
    assert cuts.filter("_cut IS NOT NULL").count() == 29


def test_salted_chunks_and_parts_are_not_broadcast(spark, monkeypatch):
    plans, plain = {}, lines.stage
    monkeypatch.setattr(lines, "stage", lambda df, name, *a: plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString()) and plain(df, name, *a))
    out = lines.dedup_lines(make(spark, [(i, "one line\nanother line\nand a third line") for i in range(20)]))
    assert out.count() == 20
    for plan in (plans["again"], out._jdf.queryExecution().sparkPlan().toString()):
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
