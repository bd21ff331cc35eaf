"""Reply trees, escaping, and the way back."""

import hashlib
import random

import duckdb
import pytest

from recordweave.llm import chat

NODES = "conv_id bigint, node_id bigint, parent_id bigint, role string, text string, score double, c string, up int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], NODES)


def slow(rows, top=1):
    out = {}
    for conv in {r[0] for r in rows}:
        own = {r[1]: r for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[3] or "", r[4] or ""), reverse=True)}
        trees = {}
        parents = {r[2] for r in own.values()}
        for node in own:
            if node in parents:
                continue
            path, at = [], node
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            if at in path:
                continue
            mean = round(sum(own[n][5] or 0 for n in path) / len(path), 9)
            trees.setdefault(path[-1], []).append(((-mean, -len(path), node), path[::-1]))
        for root, leaves in trees.items():
            for branch, (_, path) in enumerate(sorted(leaves)[:top], 1):
                out[conv, root, branch] = [(own[n][3] or "", own[n][4] or "") for n in path]
    return out


@pytest.mark.parametrize("top", [1, 3])
def test_best_paths(spark, top):
    rng = random.Random(4)
    rows = []
    for conv in range(25):
        for n in range(rng.randint(1, 40)):
            rows.append((conv, n, None if n == 0 else rng.choice([n - 1, rng.randint(0, n - 1)]), rng.choice(["user", "assistant", None]), rng.choice([None, "", f"t{n}"]), rng.choice([None, 0.5, 1.0, rng.random()])))
    rows += [(None, 1, None, "user", "null id", 0.0), (50, 1, 2, "user", "cycle", 0.0), (50, 2, 1, "user", "cycle", 0.0), (51, 1, 99, "user", "no parent", 0.0), rows[3]]
    # two trees in one conversation, one of them with a parent that is not there
    rows += [(60, 1, None, "user", "q1", 0.0), (60, 2, 1, "assistant", "a1", 0.9), (60, 3, 77, "user", "q2", 0.0), (60, 4, 3, "assistant", "a2", 0.1), (60, 5, 3, "assistant", "a3", 0.2)]
    path = chat.paths(make(spark, rows), top)
    got = {}
    for r in sorted(path.collect(), key=lambda r: r.depth):
        got.setdefault((r.conv_id, r.root_id, r.branch), []).append((r.role, r.text))
    assert got == slow(rows, top)
    assert got[60, 1, 1] == [("user", "q1"), ("assistant", "a1")] and got[60, 3, 1] == [("user", "q2"), ("assistant", "a3")]
    # every path is a conversation of its own, and comes back as it was
    back = {(r.conv_id, r.root_id, r.branch): r for r in chat.read_back(chat.format_paths(path)).collect()}
    assert {k: (r.n_turns, r.turns_sha256) for k, r in back.items()} == {
        k: (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()) for k, turns in got.items()
    }


def test_escapes_and_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 200)
    rng = random.Random(8)
    bits = ["\\", "###", "#", "</turn>", "\n", ": ", "### assistant: ", "<", "é\U0001F600", "x", "\\n", "</turn>\n", ""]
    rows = [(conv, n, n - 1 if n else None, rng.choice(["user", "assistant", "a: b\\", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), 0.0) for conv in range(20) for n in range(rng.randint(1, 20))]
    formatted = chat.format_paths(chat.paths(make(spark, rows)))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in range(20):
        own = [(r[3], r[4]) for r in rows if r[0] == conv]
        said = "".join(t for role, t in own if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert formatted.filter("part > 0").count() > 0


def test_query_equals_its_sql_and_odd_rows(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", None), (1, None, "user", "a"), (1, 3, None, "b"), (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE), (2, 0, "system", "x" * 300000), (2, 2, "assistant", "y\n" * 9000)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id bigint, turn bigint, role string, text string, node_id string")
    out = chat.read_back(chat.format_paths(chat.paths(chat.linear_nodes(df)))).drop("root_id", "branch")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, coalesce(?, -1), ?, ?)", [r for r in rows if r[0] != -7])
    want = con.execute(f"SELECT {','.join(out.columns)} FROM ({chat.SQL})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert chat.read_back(chat.format_paths(chat.paths(chat.linear_nodes(df.limit(0))))).count() == 0
