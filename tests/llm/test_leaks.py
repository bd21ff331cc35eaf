"""Template windows, slot consistency, and reports on odd rows."""

import pytest

from recordweave.llm import leaks

ITEM = "A farmer named Olga Petrov sells 12 crates of pears at 7 dollars a crate and 12 crates of plums so how much does Olga get"
OTHER = "The river runs past four old mills before it meets the sea near the white cliffs of the northern coast in the evening"


def report(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, shape string, share int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return {r.doc_id: r for r in leaks.leak_report(d, b).collect()}


def test_template():
    codes = leaks.Codes()
    words, hashes, slot = leaks.template("So Anna paid 5 kg. Anna left, 3.5 km", codes)
    kinds = {h: k for k, h in leaks.SLOTS.items()}
    assert [kinds.get(h, w) for w, h in zip(words, hashes.tolist())] == ["So", "<name>", "paid", "<number>", "<unit>", "<name>", "left,", "<number>", "<unit>"]
    assert slot.sum() == 6
    assert leaks.template("", codes)[0] == [] and leaks.template("... !!", codes)[0] == []


def test_plain_and_reparameterised_copies(spark):
    changed = ITEM.replace("12", "40").replace("7", "9").replace("Olga", "Mira").replace("Petrov", "Stone")
    broken = "A farmer named Mira Stone sells 1 crates of pears at 2 dollars a crate and 3 crates of plums so how much does Zoe get"
    docs = [(1, "before it all " + ITEM + " and after"), (2, "x\n" + changed), (3, OTHER.upper()), (4, "nothing of the kind is said here at all today"),
            (5, None), (6, ""), (7, "five words of it only: sells 12 crates of pears"), (8, "z " * 30000 + OTHER), (1, "before it all " + ITEM + " and after"), (9, "the " * 50)]
    got = report(spark, docs, [(10, ITEM), (20, OTHER), (20, OTHER), (30, None), (40, "")])
    assert got[1].item_ids == [10] and got[2].item_ids == [10] and got[3].item_ids == [20] and got[8].item_ids == [20]
    assert not any(got[i].leaked for i in (4, 5, 6, 7, 9))
    pairs = lambda text: [(d, i, dv, iv) for d, s, dv in leaks.windows(text, 5, leaks.Codes()) for i, t, iv in leaks.windows(ITEM, 5, leaks.Codes()) if s == t]
    assert leaks.matches(pairs(broken), 5)[0] < leaks.matches(pairs(changed), 5)[0]


def test_brute_force_on_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    docs += [(7000 + i, docs[i][1] + "\n" + t.lower()) for i, t in items[:5]]
    codes = leaks.Codes()
    shapes = {i: [(a, s, v) for a, s, v in leaks.windows(t, 5, codes)] for i, t in items}
    want = {}
    for d, text in docs:
        own = {}
        for at, shape, values in leaks.windows(text, 5, codes):
            own.setdefault(shape, []).append((at, values))
        bad = []
        for i, windows in shapes.items():
            pairs = [(at, a, dv, v) for a, s, v in windows for at, dv in own.get(s, ())]
            n, run = leaks.matches(pairs, 5) if pairs else (0, 0)
            if n / max(1, len(windows)) >= 0.8 or run + 4 >= 13:
                bad.append(i)
        want[d] = sorted(bad)
    got = report(spark, docs, items)
    assert {d: r.item_ids for d, r in got.items()} == want
    assert sum(map(bool, want.values())) >= 5


def test_empty_tables_and_filter(spark):
    assert report(spark, [], [(1, ITEM)]) == {}
    assert not report(spark, [(1, ITEM)], [])[1].leaked
    d = spark.createDataFrame([(1, ITEM, "x"), (None, ITEM, "y"), (None, "calm words", "y"), (2, None, "z")], "doc_id bigint, text string, item_id string")
    out = leaks.drop_leaks(d, spark.createDataFrame([(1, ITEM)], "item_id bigint, text string"))
    assert out.columns == d.columns and sorted(str(r.text) for r in out.collect()) == ["None", "calm words"]


def test_whole_items_among_names_and_in_other_case(spark):
    items = [(10, ITEM), (20, OTHER), (30, "Maria met Paul in Rome. The next day Paul took Maria to Milan where Anna Bell met them at The Old Gate")]
    heavy = "Reports from In The Field. He read A Tale of The Maria River By An Old Mill, How So, In The White Evening by hand. "
    changed = ITEM.replace("12", "40").replace("7", "9").replace("Olga", "Mira").replace("Petrov", "Stone")
    docs, want = [], {}
    for i, text in items:
        for k, made in enumerate([text, text.lower(), text.upper(), text.title()]):
            docs += [(i + k, heavy + made + " " + heavy), (100 + i + k, "so then " + made)]
            want[i + k] = want[100 + i + k] = [i]
    docs += [(500, heavy + changed), (501, heavy * 5), (502, heavy.lower() * 5)]
    want |= {500: [10], 501: [], 502: []}
    got = report(spark, docs, items)
    assert {i: r.item_ids for i, r in got.items()} == want
    assert all(got[i].share == 1 for i in want if i < 500)


def test_item_of_numbers(spark):
    item = "Add 3 + 4 + 5 + 6 + 7 + 8 + 9 + 10 + 11 + 12 + 13 + 14 + 15 and 16"
    got = report(spark, [(1, "Try this: " + item + " please"), (2, item.replace("1", "2"))], [(1, "3 4 5 6 7 8 9 10"), (2, item)])
    assert got[1].item_ids == [1, 2] and got[2].item_ids == []


def test_each_word_is_hashed_once(monkeypatch):
    seen, mark = [], leaks.mark
    monkeypatch.setattr(leaks, "mark", lambda word: seen.append(word) or mark(word))
    assert len(list(leaks.windows("take 7 of 9 pears " * 300, 5, leaks.Codes()))) > 1400
    assert sorted(seen) == ["7", "9", "of", "pears", "take"]


@pytest.mark.parametrize("chars", [1, 120, 1 << 16])
def test_texts_of_a_block_stand_alone(monkeypatch, chars):
    texts = [ITEM, "He gave 5", "km to go from here to Maria", None, "", "... !!", "Maria of the hill said no. Maria left", "Maria", "Olga went", "kg and 3", "kg 4 kg",
             "- Anna came by", "a b 7 8", "1 2 3 4 5 6", "one\ntwo Three\nThree four five six", OTHER, OTHER.title(), "so Paul met Anna. Anna met Paul and", "Anna met no one here"]
    want = {(k, *map(str, w)) for k, text in enumerate(texts) for w in leaks.windows(text, 5, leaks.Codes())}
    monkeypatch.setattr(leaks, "BLOCK_CHARS", chars)
    codes, got = leaks.Codes(), []
    for held in leaks.blocks(enumerate(texts)):
        got += [(held[k][0], *map(str, w)) for k, *w in leaks.block_windows(leaks.Block([text for _, text in held], codes), 5)]
    assert len(got) == len(want) and set(got) == want
    assert {k for k, *_ in want} == set(range(len(texts))) - {3, 4, 5}


def test_array_steps_do_not_grow_with_the_number_of_texts(monkeypatch):
    steps, rolling = [], leaks.rolling
    monkeypatch.setattr(leaks, "rolling", lambda *a: steps.append(1) or rolling(*a))
    bloom, taken = leaks.np.full(1 << leaks.BLOOM_BITS - 3, 255, leaks.np.uint8), []
    for n in (2, 40):
        steps.clear()
        for held in leaks.blocks([(ITEM,), (OTHER,)] * (n // 2)):
            list(leaks.block_windows(leaks.Block([text for (text,) in held], leaks.Codes()), 5, bloom))
        taken.append(len(steps))
    assert taken[0] == taken[1] > 0
