"""Benchmark decontamination: plain and template windows, hash join, slot consistency."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.shared import append, free_name, map_rows, sig
from recordweave.session import stage

UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes "
    "ounce ounces pound pounds lb lbs oz ml l liter liters litre litres gallon gallons second seconds minute minutes hour "
    "hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees "
    "watt watts volt volts mph kph km/h m/s".split()
)
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
TITLE_BIT, END_BIT, DIGIT_BIT, UNIT_BIT = 1 << 62, 1 << 61, 1 << 60, 1 << 59
HASH = UNIT_BIT - 1
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„–—…¿¡"
MIX = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 65)]
BLOOM_BITS = 23
KEEP_WORDS = 400_000
BLOCK_CHARS = 1 << 16


def mark(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & HASH


SLOTS = {NUMBER: mark(NUMBER), NAME: mark(NAME), UNIT: mark(UNIT)}


class Codes(dict):
    """Word to hash and flags, kept while there is room (it only saves time)."""

    def __missing__(self, word: str) -> int:
        bare = word if word.isalpha() else word.strip(EDGE)
        code = END_BIT if word[-1] in ".!?:" or word == "\x01" else 0
        if bare and word != "\x01":
            low = bare.lower()
            code |= mark(low) or 1
            if not low.isalpha() and any(map(str.isdigit, low)):
                code |= DIGIT_BIT
            else:
                if low in UNITS:
                    code |= UNIT_BIT
                if bare[0].isupper() and (len(bare) == 1 or not bare[1:].isupper()):
                    code |= TITLE_BIT
        if len(self) >= KEEP_WORDS:
            self.clear()
        self[word] = code
        return code


class Block:
    """The words of some texts one after another, and (hashes, which are slots) of their three forms.

    Words are split at white space and bared of punctuation at their ends. One with a
    digit is a number; a unit word after a number is a unit; a word in title case
    inside a sentence is a name, and so is the same word where it begins one. All
    other words stand for themselves in lower case. As that makes a name of any word
    that some heading or title holds, the second form takes only words inside a sentence
    for names, and in the third, which has no slots, every word stands for itself.
    Each form has the slots of the next and maybe more. No text depends on the others:
    they share arrays, as many array steps on each short text alone cost more than the work in them.
    """

    def __init__(self, texts: list[str | None], codes: Codes):
        self.raw: list[str] = []
        raw = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts, 1):
            self.raw += (text or "").replace("\n", " \x01 ").split()
            raw[k] = len(self.raw)
        code = np.fromiter(map(codes.__getitem__, self.raw), np.int64, len(self.raw))
        begins = np.ones(len(code), bool)
        begins[1:] = (code[:-1] & END_BIT) != 0
        begins[raw[:-1][np.diff(raw) > 0]] = True
        self.kept = np.flatnonzero(code & HASH)
        self.bounds = np.searchsorted(self.kept, raw)
        code, begins = code[self.kept], begins[self.kept]
        hashes = code & HASH
        number = (code & DIGIT_BIT) != 0
        unit = np.zeros(len(code), bool)
        unit[1:] = number[:-1]
        unit[self.bounds[:-1][np.diff(self.bounds) > 0]] = False
        unit &= (code & UNIT_BIT) != 0
        titles = np.flatnonzero(code & TITLE_BIT)
        inner = ~begins[titles]
        _, word = np.unique(hashes[titles], return_inverse=True)
        word += self.text_of(titles) * len(titles)
        template = np.where(number, SLOTS[NUMBER], np.where(unit, SLOTS[UNIT], hashes))
        self.forms = []
        for names in (titles[np.isin(word, word[inner])], titles[inner]):
            names = names[~unit[names]]
            found, slot = template.copy(), number | unit
            found[names], slot[names] = SLOTS[NAME], True
            self.forms.append((found, slot))
        self.forms.append((hashes, np.zeros(len(code), bool)))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Which text the words at these places are of."""
        return np.searchsorted(self.bounds, at, "right") - 1

    def words(self, at: int, width: int) -> list[str]:
        return [self.raw[k] for k in self.kept[at : at + width].tolist()]

    def starts(self, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """(width, where windows of it begin); a text shorter than a window is one window."""
        lengths = np.diff(self.bounds)
        room = np.repeat(self.bounds[1:], lengths) - np.arange(self.bounds[-1])
        yield width, np.flatnonzero(room >= width)
        for short in range(1, width):
            yield short, self.bounds[:-1][lengths == short]


def blocks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows that end in a text, in lists of about ``BLOCK_CHARS`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "") + 1
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def template(text: str, codes: Codes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, template hashes, which are slots) of a text: the first form of its :class:`Block`."""
    block = Block([text], codes)
    return block.words(0, len(block.kept)), *block.forms[0]


def counts(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def rolling(hashes: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Hash of the run of ``width`` words at each of these places."""
    rolled = np.zeros(len(at), np.uint64)
    for k in range(width):
        rolled += hashes[at + k].view(np.uint64) * MIX[k]
    return rolled


def windows(text: str, width: int, codes: Codes, bloom: np.ndarray | None = None) -> Iterator[tuple[int, str, list[str]]]:
    """(position, shape, slot values) of the windows of a text, each in all forms that differ, see :func:`block_windows`."""
    for _, at, shape, values in block_windows(Block([text], codes), width, bloom):
        yield at, shape, values


def block_windows(block: Block, width: int, bloom: np.ndarray | None = None) -> Iterator[tuple[int, int, str, list[str]]]:
    """(which text, position in it, shape, slot values) of the windows of texts, each in all forms that differ.

    A form that leaves fewer than two plain words says nothing and is left out. ``bloom``
    leaves only windows whose hash it holds; a text shorter than a window is one window.
    """
    kinds = {h: kind for kind, h in SLOTS.items()}
    for size, starts in block.starts(width):
        if not len(starts):
            continue
        before = None
        for hashes, slot in block.forms:
            at = starts
            if before is not None:
                changed = counts(slot != before)
                at = at[changed[at + size] > changed[at]]
            before = slot
            slots = counts(slot)
            at = at[slots[at + size] - slots[at] <= size - min(2, size)]
            if bloom is not None:
                for second in (False, True):
                    bits = place(rolling(hashes, size, at), second)
                    at = at[(bloom[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)]
            texts = block.text_of(at)
            for which, first, pos in zip(texts.tolist(), block.bounds[texts].tolist(), at.tolist()):
                parts, values = [], []
                for k, word in enumerate(block.words(pos, size), pos):
                    low = word.strip(EDGE).lower()
                    if slot[k]:
                        parts.append(kinds[int(hashes[k])])
                        values.append(low)
                    else:
                        parts.append(low)
                yield which, pos - first, " ".join(parts), values


def place(rolled: np.ndarray, second: bool) -> np.ndarray:
    """One of the two bit places of each window hash in the filter."""
    mixed = (rolled ^ (rolled >> np.uint64(29))) * MIX[1]
    if second:
        mixed *= MIX[2]
    return (mixed >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


def item_windows(items: DataFrame, width: int) -> DataFrame:
    def each(rows):
        codes = Codes()
        for item, text in rows:
            found = list(windows(text, width, codes))
            core = positions(text, width, codes)
            total = len({at for at, _, _ in found})
            for at, shape, values in found:
                yield item, at, shape, values, at in core, total, len(core)

    return map_rows(
        items.select("item_id", "text"), each,
        "item_id bigint, ipos int, shape string, ivalues array<string>, icore boolean, total int, core int",
    )


def positions(text: str, width: int, codes: Codes) -> set[int]:
    """Positions of the windows whose template has two plain words or more."""
    _, _, slot = template(text or "", codes)
    width = min(width, len(slot))
    plain = np.concatenate(([0], np.cumsum(~slot)))
    return set(np.flatnonzero(plain[width:] - plain[: len(plain) - width] >= min(2, width)).tolist()) if width else set()


def bloom_of(items: DataFrame, width: int) -> bytes:
    """Filter of fixed size (1 MB) over the window hashes of all items.

    Its bytes are joined up on the executors; at most one row per byte comes to the
    driver, however many items there are. A full filter lets more rows go on to the
    join and loses none.
    """
    def each(rows):
        codes = Codes()
        for part in blocks(rows):
            block = Block([text for (text,) in part], codes)
            for size, at in block.starts(width):
                for hashes, _ in block.forms:
                    for second in (False, True):
                        bits = place(rolling(hashes, size, at), second)
                        yield from zip((bits >> 3).tolist(), (1 << (bits & 7)).tolist())

    out = np.zeros(1 << BLOOM_BITS - 3, np.uint8)
    for at, bits in map_rows(items.select("text"), each, "at int, bits int").groupBy("at").agg(F.bit_or("bits")).collect():
        out[at] = bits
    return out.tobytes()


def matches(pairs: list[tuple[int, int, list[str], list[str]]], width: int) -> tuple[int, int]:
    """(item windows matched, longest run of them), see :func:`matched`."""
    seen, longest = matched(pairs)
    return len(seen), longest


def matched(pairs: list[tuple[int, int, list[str], list[str]]]) -> tuple[set[int], int]:
    """(positions of item windows matched, longest run of them) among (dpos, ipos, doc values, item values).

    Windows on one diagonal (dpos - ipos) must agree on what each slot value of the
    item became in the document: a window that says otherwise than most is dropped.
    """
    lanes = defaultdict(list)
    for dpos, ipos, dvalues, ivalues in pairs:
        lanes[dpos - ipos].append((ipos, list(zip(ivalues, dvalues))))
    seen, longest = set(), 0
    for lane in lanes.values():
        votes = Counter(p for _, slots in lane for p in slots)
        best = {}
        for (old, new), n in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
            best.setdefault(old, new)
        at = sorted({ipos for ipos, slots in lane if all(best[old] == new for old, new in slots)})
        seen.update(at)
        run = 0
        for k, pos in enumerate(at):
            run = run + 1 if k and at[k - 1] == pos - 1 else 1
            longest = max(longest, run)
    return seen, longest


def leaked_items(docs: DataFrame, items: DataFrame, width: int = 5, share: float = 0.8, run: int = 13) -> DataFrame:
    """(doc_id, sig, item_id, share, run_words) of each leaked item in each document.

    An item is leaked if ``share`` of its windows of ``width`` words occur, word for word or
    as a template with consistent slots, or ``run`` words of it in a row. The share is that of
    all its windows or of those whose template says something, whichever is more. A null or
    empty item leaks nowhere; repeated item rows count once.
    """
    items = items.filter("text is not null").dropDuplicates(["item_id", "text"])
    held = docs.sparkSession.sparkContext.broadcast(bloom_of(items, width))

    def each(rows):
        codes, bloom = Codes(), np.frombuffer(held.value, np.uint8)
        for part in blocks(rows):
            for which, at, shape, values in block_windows(Block([text for _, _, text in part], codes), width, bloom):
                yield *part[which][:2], at, shape, values

    found = map_rows(
        docs.select("doc_id", sig().alias("sig"), "text"), each,
        "doc_id bigint, sig bigint, dpos int, shape string, dvalues array<string>",
    )
    met = found.join(item_windows(items, width), "shape")
    grouped = met.groupBy("doc_id", "sig", "item_id", "total", "core").agg(
        F.collect_set(F.struct("dpos", "ipos", "dvalues", "ivalues", "icore")).alias("pairs")
    )

    def judge(pairs, total, core):
        seen, longest = matched([(p["dpos"], p["ipos"], p["dvalues"], p["ivalues"]) for p in pairs])
        said = {p["ipos"] for p in pairs if p["icore"]} & seen
        return max(len(seen) / total, len(said) / max(1, core)), longest + width - 1

    return (
        append(grouped, ["pairs", "total", "core"], judge, "share double, run_words int")
        .filter((F.col("share") >= share) | (F.col("run_words") >= run))
        .select("doc_id", "sig", "item_id", "share", "run_words")
    )


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, leaked, item_ids, share) for every row of ``docs``, clean ones with no items.

    A null text is clean. Rows that share doc_id and text get the same answer.
    """
    bad = (
        leaked_items(docs, items)
        .groupBy("doc_id", "sig")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))
        .withColumnsRenamed({"doc_id": "_id", "sig": "_sig"})
    )
    rows = docs.select("doc_id", sig().alias("sig"))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sig") == F.col("_sig")), "left").select(
        "doc_id",
        F.col("_sig").isNotNull().alias("leaked"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns stay as they are, whatever their names."""
    one, two, mark = (free_name(docs, c) for c in ("_id", "_sig", "_mark"))
    bad = stage(leaked_items(docs, items).select(F.col("doc_id").alias(one), F.col("sig").alias(two)).distinct(), "leaks")
    marked = docs.withColumn(mark, sig())
    return marked.join(bad, F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(mark) == F.col(two)), "left_anti").drop(mark)
