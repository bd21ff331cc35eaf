"""Ranked lexical search over an index in strata of equal length normaliser."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordweave.llm.shared import arrow_type, map_rows, text_bytes
from recordweave.session import stage

NO_ID = (1 << 63) - 1
STRATUM_POSTINGS = 100_000
BLOCK_TERMS = 250_000
FIRST_STRATA = 8
WORDS = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.translate(WORDS).split()


# ------------------------------------------------------------------ the index


class Index:
    """An index that lies in the shared folder: strata, document frequencies, and the totals of the collection."""

    def __init__(self, strata: DataFrame, frequencies: DataFrame, documents: int, occurrences: int) -> None:
        self.strata, self.frequencies, self.documents, self.occurrences = strata, frequencies, documents, occurrences


def packed(batches: Iterable[pa.RecordBatch], most: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Strata rows, one a batch, from (m, part, doc_id, words, tfs) sorted by (m, part).

    A row holds documents of one m and part, of about ``most`` postings. These are grouped by term,
    then by tf: ``tops`` has the largest tf of each term, ``ends`` where a term's groups end,
    ``tfs`` and ``stops`` each group's tf and the end of its places in ``docs``.
    """
    def row(m, held):
        ids = pa.concat_arrays([h.column("doc_id") for h in held])
        terms = pc.split_pattern(pa.concat_arrays([h.column("words") for h in held]), pattern=" ")
        sizes = pc.list_value_length(terms).to_numpy()
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        every = terms.flatten().dictionary_encode()
        order = pc.sort_indices(every.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        term = rank[every.indices.to_numpy()]
        tf = pa.concat_arrays([h.column("tfs") for h in held]).flatten().to_numpy().astype(np.int64)
        at = np.lexsort((doc, -tf, term))
        term, tf, doc = term[at], tf[at], doc[at]
        heads = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))))
        stops = np.append(heads[1:], len(term))
        first = np.flatnonzero(np.concatenate(([True], term[heads][1:] != term[heads][:-1])))
        ends = np.append(first[1:], len(heads))
        lists = [ids, every.dictionary.take(pa.array(order)), *map(pa.array, (tf[heads][first], ends, tf[heads], stops, doc))]
        values = [pa.array([m], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists)]
        return pa.RecordBatch.from_arrays(values, schema=schema)

    at, held, size = None, [], 0
    for batch in batches:
        m, part = batch.column("m").to_numpy(), batch.column("part").to_numpy()
        many = np.cumsum(pc.list_value_length(batch.column("tfs")).to_numpy())
        low = 0
        while low < len(m):
            if held and ((m[low], part[low]) != at or size >= most):
                yield row(int(at[0]), held)
                held, size = [], 0
            at = m[low], part[low]
            before = many[low - 1] if low else 0
            same = low + int(np.argmin(np.append((m[low:] == m[low]) & (part[low:] == part[low]), False)))
            high = min(same, low + 1 + int(np.searchsorted(many[low:], before + most - size)))
            held.append(batch.slice(low, high - low))
            size += int(many[high - 1] - before)
            low = high
    if held:
        yield row(int(at[0]), held)


STRATA = (
    "m bigint, ids array<bigint>, terms array<binary>, tops array<bigint>, ends array<bigint>, tfs array<bigint>, "
    "stops array<bigint>, docs array<int>"
)


def build(docs: DataFrame, most: int = STRATUM_POSTINGS) -> Index:
    """Index every row of ``docs`` (doc_id, text); documents without a term are not in it.

    One pass turns each text into its bag of terms. Document frequencies and totals come
    from the bags; then these are dealt by m. A stratum of more than ``most`` postings is
    dealt in parts, so neither a common length nor very long documents make a large task.
    """
    def bags(rows):
        for doc_id, text in rows:
            bag = Counter(terms(text))
            if bag:
                yield doc_id, bag.total(), b" ".join(bag), list(bag.values())

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), text_bytes().alias("text"))
    bag = stage(map_rows(rows, bags, "doc_id bigint, n bigint, words binary, tfs array<int>", rows=128), "bags")
    count, total = bag.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = bag.select(F.explode(F.split(F.col("words").cast("string"), " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    frequencies = stage(each.select(F.col("term").cast("binary").alias("term"), "df"), "frequencies")
    m = F.expr(f"75 + (25 * n * {count}L) div {max(total, 1)}L")
    keyed = bag.withColumn("m", m)
    # one row a length; stored, so that Spark knows its size when it plans the join
    sizes = stage(keyed.groupBy("m").agg(F.expr(f"cast(sum(size(tfs)) div {most} + 1 as int)").alias("parts")), "lengths")
    dealt = (
        keyed.join(sizes, "m")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "words"), F.col("parts")).cast("int"))
        .select("m", "part", "doc_id", "words", "tfs").repartition("m", "part").sortWithinPartitions("m", "part")
    )
    schema = pa.schema([(f.name, arrow_type(f.dataType)) for f in T._parse_datatype_string(STRATA)])
    strata = dealt.mapInArrow(lambda batches: packed(batches, most, schema), STRATA)
    return Index(stage(strata, "strata"), frequencies, count, total)


# ------------------------------------------------------------------ searching


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Queries:
    """The terms of one block of items: for each term the items that hold it, with their weights."""

    def __init__(self, rows: list[tuple[int, bytes, int]]) -> None:
        """``rows`` are (item, term, weight times repeats)."""
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.items = np.array(sorted({q for q, _, _ in rows}), np.int64)
        self.words = sorted({t for _, t, _ in rows})
        place = {t: i for i, t in enumerate(self.words)}
        self.of = np.searchsorted(self.items, np.array([q for q, _, _ in rows], np.int64))
        self.weight = np.array([w for _, _, w in rows], np.int64)
        self.first = np.searchsorted(np.array([place[t] for _, t, _ in rows], np.int64), np.arange(len(self.words) + 1))


class Stratum:
    """One row of the index against a block of items."""

    def __init__(self, batch: pa.RecordBatch, row: int, queries: Queries) -> None:
        def column(name):
            return batch.column(name)[row].values

        self.m = batch.column("m")[row].as_py()
        found = pc.index_in(column("terms"), value_set=pa.array(queries.words, pa.binary()))
        self.terms = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        self.query_terms = found.drop_null().to_numpy().astype(np.int64)
        self.column, self.queries = column, queries
        tops = impact(column("tops").to_numpy()[self.terms], self.m)
        many = queries.first[self.query_terms + 1] - queries.first[self.query_terms]
        self.entries = np.repeat(queries.first[self.query_terms] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        self.entry_term = np.repeat(np.arange(len(self.terms)), many)
        self.bounds = np.zeros(len(queries.items), np.int64)
        np.add.at(self.bounds, queries.of[self.entries], queries.weight[self.entries] * tops[self.entry_term])
        self.open = False

    def visit(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, score) of all documents here that share a weighted term with an item."""
        if not self.open:
            self.ids, self.docs = self.column("ids").to_numpy(), self.column("docs").to_numpy()
            ends, tfs, stops = (self.column(c).to_numpy() for c in ("ends", "tfs", "stops"))
            self.starts = np.concatenate(([0], stops))
            self.groups = np.concatenate(([0], ends))
            self.impacts = impact(tfs, self.m)  # one for each tf of a term
            by = np.argsort(self.queries.of[self.entries], kind="stable")
            self.entries, self.entry_term = self.entries[by], self.entry_term[by]
            self.cuts = np.searchsorted(self.queries.of[self.entries], np.arange(len(self.queries.items) + 1))
            self.open = True
        score = np.zeros(len(self.ids), np.int64)
        for e in range(self.cuts[item], self.cuts[item + 1]):
            term, weight = self.terms[self.entry_term[e]], self.queries.weight[self.entries[e]]
            a, b = self.groups[term], self.groups[term + 1]
            lo, hi = self.starts[a], self.starts[b]
            # a document stands once under a term, so plain indexed addition is right
            score[self.docs[lo:hi]] += np.repeat(weight * self.impacts[a:b], np.diff(self.starts[a : b + 1]))
        some = np.flatnonzero(score)
        return self.ids[some], score[some]


def best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, equal ones by rising id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        ids, score = ids[score >= least], score[score >= least]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def scan(strata: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(record batches, one index row at a time) -> tuples`` over the index."""
    fields = T._parse_datatype_string(schema)
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in fields])

    def run(batches):
        rows = list(fn((batch, i) for batch in batches for i in range(batch.num_rows)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return strata.mapInArrow(run, fields)


def search_block(index: Index, rows: list[tuple[int, bytes, int]], k: int) -> DataFrame:
    """(q, doc_id, score): each task's best ``k`` documents for each item of one block.

    1. Every stratum row's bound for an item is the sum of its terms' weights times the
       impact of their largest tf there. Each item's highest bounds say which rows come first.
    2. Those rows are visited; the k-th best score found is the item's floor.
    3. All other rows whose bound reaches the floor are visited. A lower row holds no
       document of the result, a tie included.

    Each task keeps k documents an item and raises the floor by its own. Only bounds and
    floors of the items of the block, one number each, come to the driver.
    """
    queries = Queries(rows)
    n = len(queries.items)

    def highest(strata):
        kept = [[] for _ in range(n)]
        for batch, i in strata:
            bounds = Stratum(batch, i, queries).bounds
            for q in np.flatnonzero(bounds).tolist():
                kept[q].append(int(bounds[q]))
                if len(kept[q]) > 4 * FIRST_STRATA:
                    kept[q] = sorted(kept[q])[-FIRST_STRATA:]
        for q, own in enumerate(kept):
            for bound in sorted(own)[-FIRST_STRATA:]:
                yield int(queries.items[q]), bound

    def visits(low, high, floor):
        def run(strata):
            top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
            least = floor.copy()
            for batch, i in strata:
                stratum = Stratum(batch, i, queries)
                for q in np.flatnonzero((stratum.bounds >= np.maximum(low, least)) & (stratum.bounds < high)).tolist():
                    ids, score = stratum.visit(q)
                    some = score >= least[q]
                    top[q] = best(np.concatenate([top[q][0], ids[some]]), np.concatenate([top[q][1], score[some]]), k)
                    if len(top[q][0]) == k:
                        least[q] = max(least[q], top[q][1][-1])
            for q, (ids, score) in enumerate(top):
                for d, s in zip(ids.tolist(), score.tolist()):
                    yield int(queries.items[q]), d, s

        return stage(scan(index.strata, run, "q bigint, doc_id bigint, score bigint"), "visits")

    def told(df: DataFrame, at: int, value: str, default: int) -> np.ndarray:
        """Each item's ``at``-th highest ``value``, ``default`` where there are fewer."""
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(value)))
        out = np.full(n, default, np.int64)
        for q, v in df.withColumn("r", rank).filter(f"r = {at}").select("q", value).collect():
            out[np.searchsorted(queries.items, q)] = v
        return out

    every = np.full(n, NO_ID, np.int64)
    low = told(scan(index.strata, highest, "q bigint, bound bigint"), FIRST_STRATA, "bound", 1)
    first = visits(low, every, np.ones(n, np.int64))
    floor = told(first, k, "score", 1)
    return first.union(visits(np.ones(n, np.int64), low, floor))


def search(index: Index, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of the index for each row of ``items`` (item_id, text).

    A term weighs floor(1000 ln((2N+2)/(2df+1))); a document's score sums weight times
    10^9 tf div (1000 tf + 12 m) over the item's terms, repeats included. Only scores above
    0 count, equal ones go by doc_id, and rank starts at 1. Rows of ``items`` are searched one by
    one, those with equal item_id too; a null text, or one without a known term, has no result. A null doc_id
    is larger than any other. Other columns are not looked at.

    Items are dealt into blocks of at most ``block_terms`` terms (a longer item is a block
    of its own), so what tasks are sent is bounded, and each block is searched over the whole index.
    """
    def asked(rows):
        for q, text in rows:
            for term, n in Counter(terms(text)).items():
                yield q, term, n

    numbered = stage(items.select(F.monotonically_increasing_id().alias("q"), "item_id", text_bytes().alias("text")), "items")
    weight = F.expr(f"cast(floor(1000 * ln((2 * {index.documents}D + 2) / (2 * df + 1))) as bigint)")
    weighed = stage(
        map_rows(numbered.select("q", "text"), asked, "q bigint, term binary, n bigint")
        .join(index.frequencies, "term")
        .select("q", "term", (F.col("n") * weight).alias("weight"))
        .filter("weight > 0"),
        "asked",
    )
    sizes = weighed.groupBy("q").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_terms)) if total > block_terms else 1
    while True:
        block = F.pmod(F.xxhash64("q"), F.lit(blocks))
        over = sizes.groupBy(block.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("items")).filter(f"n > {block_terms} AND items > 1")
        if not over.limit(1).count():
            break
        blocks *= 2
    found = []
    for b in range(blocks):
        rows = [(q, bytes(t), w) for q, t, w in weighed.filter(block == b).collect()]
        if rows:
            found.append(search_block(index, rows, k))
    if not found:
        return items.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    top = reduce(DataFrame.union, found).withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.join(numbered.select("q", "item_id"), "q").select(
        "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
m AS (SELECT doc_id, 75 + ((25 * n * docs) // total) AS m FROM n, c),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
qt AS (SELECT item_id, term, count(*)::BIGINT AS n FROM q GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, sum(n * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
