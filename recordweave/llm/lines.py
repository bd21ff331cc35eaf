"""Line dedup: content-defined chunks of lines, repeats removed after byte comparison.

Two kinds of lines go. Those of a whole chunk of two lines or more that an earlier place
has; and those of a run of repeated lines of more than :data:`RUN` words. For the runs,
texts are also cut into stretches, after lines of more than :data:`LONG` words or with an
even hash, and whatever a stretch begins or ends with is looked up, so a match reaches to
the last common line on both sides. A passage of more than 50 words in up to five lines
has a line of more than ten, so it has a boundary of its own and all its lines are found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.shared import append, map_rows, sig, text_bytes
from recordweave.session import stage

BASE, PRIME = 31, 1_000_003
LONG, RUN = 10, 50
SALTS = 16
WHOLE, HEAD, TAIL = 0, 1, 2


def own_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def chunks(text: bytes, divisor: int = 2) -> Iterator[tuple[int, int, list[bytes]]]:
    """(number, first line, lines) of each chunk.

    The hash of a line is the first 32 bits of its MD5; it is rolled over two lines,
    ``(before * 31 + own) mod 1000003``, and a chunk ends where that is divisible by
    ``divisor``. A boundary so depends on two lines only, and lines put in before a
    shared passage do not shift the boundaries inside it.
    """
    lines = text.split(b"\n")
    number, start, before = 0, 0, 0
    for i, line in enumerate(lines):
        own = own_hash(line)
        if (before * BASE + own) % PRIME % divisor == 0:
            yield number, start, lines[start : i + 1]
            number, start = number + 1, i + 1
        before = own
    if start < len(lines):
        yield number, start, lines[start:]


def stretches(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first line, line after the last) of each stretch; an end depends on its own line only."""
    start = 0
    for i, line in enumerate(lines, 1):
        if i == len(lines) or own_hash(line) % 2 == 0 or len(line.split()) > LONG:
            yield start, i
            start = i


def parts(text: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(kind, first line, number of lines, hash) of all that is looked up.

    Chunks of two lines or more, and each beginning and each end of every stretch. Hashes
    go from line to line, so a stretch of any length is read twice.
    """
    for _, start, own in chunks(text):
        if len(own) > 1:
            yield WHOLE, start, len(own), signed(xxhash.xxh64_digest(b"\n".join(own)))
    lines = text.split(b"\n")
    for a, b in stretches(lines):
        for kind, order in ((HEAD, range(a, b)), (TAIL, range(b - 1, a - 1, -1))):
            rolled = xxhash.xxh64()
            for n, i in enumerate(order, 1):
                rolled.update(lines[i])
                rolled.update(b"\n")
                yield kind, a if kind == HEAD else i, n, signed(rolled.digest())


def signed(mark: bytes) -> int:
    return int.from_bytes(mark[:8], "big", signed=True)


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, parts): the repeated parts (kind, at, n) of each text.

    Parts meet by hash first, without their bytes, and the first by (doc_id, sig, at) is
    their owner. Of parts that lie in one another only the longest goes on. These and
    their owners are then compared byte by byte. A part found everywhere is summed up
    before each shuffle, and joins back as the long side of a unique key; after the
    comparison by SHA-256 in place of the bytes, dealt by salts.
    """
    texts = docs.select("doc_id", sig().alias("sig"), text_bytes().alias("text"))
    place = F.struct("doc_id", "sig", "at")

    def hashed(rows):
        for doc_id, mark, text in rows:
            for part in parts(text):
                yield doc_id, mark, *part

    def whole(rows):
        for doc_id, mark, text, asked in rows:
            lines = text.split(b"\n")
            for part in asked:
                at, n = part["at"], part["n"]
                yield doc_id, mark, part["kind"], at, n, part["hash"], b"\n".join(lines[at : at + n])

    key = "doc_id bigint, sig bigint, kind int, at int, n int, hash bigint"
    marks = stage(map_rows(texts, hashed, key), "parts")
    owners = (
        marks.groupBy("kind", "hash")
        .agg(F.min(place).alias("owner"), F.max(place).alias("last"))
        .filter(~F.col("owner").eqNullSafe(F.col("last")))
        .drop("last")
    )
    edge = F.when(F.col("kind") == TAIL, F.col("at") + F.col("n")).otherwise(F.col("at"))
    found = stage(
        marks.join(owners, ["kind", "hash"])
        .filter(~place.eqNullSafe(F.col("owner")))
        .groupBy("doc_id", "sig", "kind", edge.alias("edge"))
        .agg(F.max(F.struct("n", "at", "hash", "owner")).alias("p"))
        .select("doc_id", "sig", "kind", "p.at", "p.n", "p.hash", "p.owner"),
        "longest",
    )
    asked = (
        found.select("owner.doc_id", "owner.sig", "kind", "owner.at", "n", "hash")
        .unionByName(found.drop("owner"))
        .groupBy("doc_id", "sig")
        .agg(F.collect_set(F.struct("kind", "at", "n", "hash")).alias("asked"))
        .withColumnsRenamed({"doc_id": "_id", "sig": "_sig"})
    )
    pairs = texts.join(
        asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sig") == F.col("_sig"))
    ).select("doc_id", "sig", "text", "asked")
    cand = stage(map_rows(pairs, whole, key + ", bytes binary", rows=256), "bytes")
    digest = F.unhex(F.sha2("bytes", 256)).alias("sha")
    first = (
        cand.groupBy("kind", "hash", "bytes")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter(~F.col("first").eqNullSafe(F.col("last")))
        .select("kind", digest, "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    again = (
        cand.select("doc_id", "sig", "kind", "at", "n", digest, F.pmod(F.xxhash64("doc_id", "sig"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(first.hint("merge"), ["kind", "sha", "salt"])  # sized as if it had no salts, so not to be broadcast
        .filter(~place.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "sig")
        .agg(F.collect_set(F.struct("kind", "at", "n")).alias("parts"))
    )
    # written, so that what was shuffled for the comparison is gone before the texts move again
    return stage(again, "again")


def with_cuts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_cut``: its repeated parts (null: none).

    Parts are stored in a fraction of their size, so a file that Spark would broadcast may be too much for the driver.
    """
    gone = repeated(docs).withColumnsRenamed({"doc_id": "_id", "sig": "_sig", "parts": "_cut"})
    return (
        docs.withColumn("_mark", sig())
        .join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_sig")), "left")
        .drop("_id", "_sig", "_mark")
    )


def cut(text: bytes, found: list[dict] | None) -> tuple[bytes, int, int, int]:
    """The text without its repeats, and the numbers of chunks, of runs and of lines removed."""
    if not found:
        return text, 0, 0, 0
    lines = text.split(b"\n")
    gone, flag, whole, runs = [False] * len(lines), [False] * (len(lines) + 1), 0, 0
    for part in found:
        to = gone if part["kind"] == WHOLE else flag
        to[part["at"] : part["at"] + part["n"]] = [True] * part["n"]
        whole += part["kind"] == WHOLE
    start = 0
    for i, on in enumerate(flag):
        if not on:
            if sum(len(line.split()) for line in lines[start:i]) > RUN:
                gone[start:i] = [True] * (i - start)
                runs += 1
            start = i + 1
    return b"\n".join(line for line, out in zip(lines, gone) if not out), whole, runs, sum(gone)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the multi-line chunks and long runs of lines that an earlier place already has.

    Columns are those of ``docs``; ``text`` is cut and ``n_chars``, if there, counted
    anew. Every row stays, with an empty text if all of it was repeated; a null text
    stays null. Rows with the same doc_id and text are one document and are cut alike; a
    null doc_id comes before all others. Of equal lines one always stays somewhere, since
    a line goes only where an earlier place has it. Names beginning with ``_`` are taken.
    """
    def trim(text, found):
        if text is None or not found:
            return text, None if text is None else len(text)
        out = cut(text.encode(), found)[0].decode()
        return out, len(out)

    made = append(with_cuts(docs), ["text", "_cut"], trim, "_text string, _chars bigint")
    new = {"text": F.col("_text").alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.col("_chars")).cast(
            docs.schema["n_chars"].dataType
        ).alias("n_chars")
    return made.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, removed_chunks, removed_runs, removed_lines, kept_md5) for every row."""
    def count(text, found):
        text = text or ""
        kept, whole, runs, lost = cut(text.encode(), found)
        return text.count("\n") + 1, whole, runs, lost, hashlib.md5(kept).hexdigest()

    rows = with_cuts(docs.select("doc_id", "text"))
    return append(
        rows, ["text", "_cut"], count,
        "n_lines bigint, removed_chunks bigint, removed_runs bigint, removed_lines bigint, kept_md5 string",
    ).drop("text", "_cut")


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), h AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS own FROM l
), r AS (
  SELECT *, CASE WHEN (coalesce(lag(own) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31 + own) % 1000003 % 2 = 0
            THEN 1 ELSE 0 END AS ends
  FROM h
), n AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS number
  FROM r
), c AS (
  SELECT doc_id, number, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body FROM n GROUP BY doc_id, number
), g AS (
  SELECT doc_id, number, lines > 1 AND row_number() OVER (PARTITION BY body, lines > 1 ORDER BY doc_id, number) > 1 AS gone
  FROM c
), w AS (
  SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM n
), k AS (
  SELECT *, coalesce(sum(CASE WHEN words > 10 OR own % 2 = 0 THEN 1 ELSE 0 END)
                     OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch
  FROM w
), p AS (
  SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc_id, stretch ORDER BY i ROWS UNBOUNDED PRECEDING) AS head,
         string_agg(line, chr(10)) OVER (PARTITION BY doc_id, stretch ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS tail
  FROM k
), f AS (
  SELECT doc_id, i, number, line, words,
         row_number() OVER (PARTITION BY head ORDER BY doc_id, i) > 1 OR row_number() OVER (PARTITION BY tail ORDER BY doc_id, i) > 1 AS again
  FROM p
), q AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, again ORDER BY i) AS run FROM f
), x AS (
  SELECT *, again AND sum(words) OVER (PARTITION BY doc_id, again, run) > 50 AS ran FROM q
)
SELECT doc_id, count(*) AS n_lines, count(DISTINCT CASE WHEN gone THEN number END) AS removed_chunks,
       count(DISTINCT CASE WHEN ran THEN run END) AS removed_runs,
       count(CASE WHEN gone OR ran THEN 1 END) AS removed_lines,
       md5(coalesce(string_agg(CASE WHEN NOT (gone OR ran) THEN line END, chr(10) ORDER BY i), '')) AS kept_md5
FROM x JOIN g USING (doc_id, number) GROUP BY doc_id
"""
