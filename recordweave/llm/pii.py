"""Personal data: exact patterns, and a character BiLSTM with CRF transitions for what they miss."""

from __future__ import annotations

import hashlib
import random
import re
import string
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.shared import map_rows
from recordweave.operators.common import top_n

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
WINDOW, STRIDE, REACH = 64, 32, 24
SAMPLE = 300
HIDDEN, EMBED = 12, 8
TRIGGER = re.compile(r"[0-9@]+")

MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
MAIL_NAME = frozenset(string.ascii_letters + string.digits + "._%+-")
# a match starts at the start of a run of digits or nowhere in it, so the look-behind changes nothing
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    own = [int(c) for c in reversed(number)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def fits(kind: str, text: str) -> bool:
    """What a match of a kind must hold besides its form."""
    number = digits(text)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(number) <= 19 and luhn(number)
    if kind == "phone":
        return 9 <= len(number) <= 15
    name, at, host = text.partition("@")
    return bool(name and at and "." in host)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, leftmost and non-overlapping per kind, by start and kind."""
    if not TRIGGER.search(text):
        return []
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in MAIL_NAME:
            start -= 1
        found = MAIL_HOST.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if fits(kind, m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ------------------------------------------------------------------ the network

PUNCT = string.punctuation
CLASSES = 8 + len(PUNCT)


def char_classes(text: str) -> np.ndarray:
    """Class of each character: 0 is padding, then lower, upper, digit, other letter, space, line feed, other; punctuation singly."""
    return np.fromiter(map(CLASS_OF.__getitem__, text), np.int64, len(text))


class _Classes(dict):
    def __missing__(self, c: str) -> int:
        if "a" <= c <= "z":
            kind = 1
        elif "A" <= c <= "Z":
            kind = 2
        elif "0" <= c <= "9":
            kind = 3
        elif c.isalpha():
            kind = 4
        elif c == "\n":
            kind = 6
        elif c.isspace():
            kind = 5
        else:
            kind = 8 + PUNCT.index(c) if c in PUNCT else 7
        if len(self) < 10_000:
            self[c] = kind
        return kind


CLASS_OF = _Classes()


def start_weights(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    tags, wide = len(TAGS), EMBED + HIDDEN
    p = {"embed": rng.normal(0, 0.3, (CLASSES, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, tags)), "bias": np.zeros(tags), "move": np.zeros((tags, tags))}
    for side in "fb":
        p["w" + side] = rng.normal(0, wide**-0.5, (wide, 4 * HIDDEN))
        p["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in p.items()}


# I may only follow B or I of its kind
ALLOWED = np.array([[not b.startswith("I") or (a != "O" and a[2:] == b[2:]) for b in TAGS] for a in TAGS])
FIRST = np.array([not t.startswith("I") for t in TAGS])
NEVER = np.float32(-1e4)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, w: np.ndarray, c: np.ndarray, keep: list | None = None) -> np.ndarray:
    """(batch, steps, EMBED) to (batch, steps, HIDDEN), left to right."""
    n, steps, _ = x.shape
    h = s = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((n, steps, HIDDEN), np.float32)
    for t in range(steps):
        z = np.concatenate([x[:, t], h], 1)
        a = z @ w + c
        g = sigmoid(a[:, : 3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        u = np.tanh(a[:, 3 * HIDDEN :])
        before, s = s, f * s + i * u
        th = np.tanh(s)
        h = o * th
        out[:, t] = h
        if keep is not None:
            keep.append((z, i, f, o, u, before, th))
    return out


def lstm_back(grad: np.ndarray, w: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, steps, _ = grad.shape
    dx, dw, dc = np.empty((n, steps, EMBED), np.float32), np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
    dh = ds = np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        z, i, f, o, u, before, th = keep[t]
        dh = dh + grad[:, t]
        ds = ds + dh * o * (1 - th * th)
        da = np.concatenate([ds * u * i * (1 - i), ds * before * f * (1 - f), dh * th * o * (1 - o), ds * i * (1 - u * u)], 1)
        dw += z.T @ da
        dc += da.sum(0)
        dz = da @ w.T
        dx[:, t], dh = dz[:, :EMBED], dz[:, EMBED:]
        ds = ds * f
    return dx, dw, dc


def emissions(classes: np.ndarray, p: dict) -> np.ndarray:
    x = p["embed"][classes]
    both = np.concatenate([lstm(x, p["wf"], p["cf"]), lstm(x[:, ::-1], p["wb"], p["cb"])[:, ::-1]], 2)
    return both @ p["out"] + p["bias"]


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(classes: np.ndarray, gold: np.ndarray, p: dict) -> tuple[float, dict]:
    """Mean CRF loss of a batch of windows and its gradient."""
    n, steps = classes.shape
    x = p["embed"][classes]
    kf, kb = [], []
    both = np.concatenate([lstm(x, p["wf"], p["cf"], kf), lstm(x[:, ::-1], p["wb"], p["cb"], kb)[:, ::-1]], 2)
    e = both @ p["out"] + p["bias"]
    move = np.where(ALLOWED, p["move"], NEVER)
    e0 = e.copy()
    e0[:, 0] = np.where(FIRST, e0[:, 0], NEVER)
    ahead = [e0[:, 0]]
    for t in range(1, steps):
        ahead.append(e0[:, t] + lse(ahead[-1][:, :, None] + move, 1))
    back = [np.zeros_like(ahead[0])]
    for t in range(steps - 2, -1, -1):
        back.append(lse(move + (e0[:, t + 1] + back[-1])[:, None, :], 2))
    back.reverse()
    total = lse(ahead[-1], 1)
    rows = np.arange(n)
    de, dmove, path = np.empty_like(e), np.zeros_like(move), np.zeros(n)
    for t in range(steps):
        de[:, t] = np.exp(ahead[t] + back[t] - total[:, None])
        de[rows, t, gold[:, t]] -= 1
        path += e0[rows, t, gold[:, t]]
        if t:
            pair = ahead[t - 1][:, :, None] + move + (e0[:, t] + back[t])[:, None, :] - total[:, None, None]
            dmove += np.exp(pair).sum(0)
            np.add.at(dmove, (gold[:, t - 1], gold[:, t]), -1)
            path += move[gold[:, t - 1], gold[:, t]]
    de /= n
    g = {"out": np.einsum("nth,ntk->hk", both, de), "bias": de.sum((0, 1)), "move": np.where(ALLOWED, dmove / n, 0)}
    db = de @ p["out"].T
    dxf, g["wf"], g["cf"] = lstm_back(db[:, :, :HIDDEN], p["wf"], kf)
    dxb, g["wb"], g["cb"] = lstm_back(db[:, ::-1, HIDDEN:], p["wb"], kb)
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], classes, dxf + dxb[:, ::-1])
    return float((total - path).mean()), g


def variant(kind: str, rng: random.Random) -> str:
    """A made-up value of a kind, also in forms that the patterns do not know."""
    num = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    name = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    if kind == "email":
        user = name(rng.randint(2, 9)) + rng.choice(["", ".", "_", "-", "+"]) + rng.choice([name(4), num(2)])
        return f"{user}@{name(rng.randint(3, 8))}{rng.choice(['', num(1), '.' + name(4)])}.{rng.choice(['com', 'org', 'net', 'io', 'fr', 'de', 'co.uk'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        own = rng.choice("3456") + num(rng.choice([14, 14, 14, 13]))
        own += next(d for d in string.digits if luhn(own + d))
        gap = rng.choice(["", " ", "-", ".", "  "])
        return gap.join(own[i : i + 4] for i in range(0, len(own), 4))
    a, b, c = num(3), num(3), num(4)
    return rng.choice([f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{num(2)} {a} {b} {c}", f"+{num(2)} {a} {b} {c}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"+{num(2)}{a}{b}{c}", f"{a}/{b}-{c}"])


def harmless(rng: random.Random) -> str:
    num = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    return rng.choice([
        f"{rng.randint(0, 30)}.{rng.randint(0, 30)}", f"{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 30)}", f"20{num(2)}-0{rng.randint(1, 9)}-1{num(1)}",
        f"{rng.randint(1, 999)},{num(3)}.{num(2)}", num(rng.randint(1, 8)), f"{rng.randint(10, 23)}:{num(2)}:{num(2)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([16, 32, 40]))),
        "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16)), f"@{rng.choice('abcdef')}name", f"#{num(4)}", f"${num(3)}.{num(2)}",
        f"{num(4)}-{num(4)}", f"pp. {num(3)}-{num(3)}",
    ])


def examples(rows: list[tuple[str, list[tuple[str, int, int]]]], rng: random.Random, number: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled snippets and made variants of them, their values replaced or put between words."""
    out = list(rows)
    plain = [t for t, _ in rows] or ["of the and in to it is for on with"]
    for k in range(number):
        text = rng.choice(plain)
        text = TRIGGER.sub(lambda m: rng.choice(["", "x"]), text)
        at = rng.randint(0, len(text))
        while at and at < len(text) and not text[at - 1].isspace():
            at -= 1
        value, kind = (harmless(rng), None) if k % 3 == 0 else (variant(KINDS[k % 4], rng), KINDS[k % 4])
        text = text[:at] + value + rng.choice([" ", ", ", ". ", "\n"]) + text[at:]
        out.append((text, [(kind, at, at + len(value))] if kind else []))
    return out


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 7, epochs: int = 14, made: int = 2400) -> dict[str, np.ndarray]:
    """Weights from labelled snippets (text, spans); the same rows give the same weights."""
    rng = random.Random(seed)
    data = examples(sorted(rows), rng, made)
    classes, gold = np.zeros((len(data), WINDOW), np.int64), np.zeros((len(data), WINDOW), np.int64)
    for n, (text, spans) in enumerate(data):
        mid = (spans[0][1] + spans[0][2]) // 2 if spans else len(text) // 2
        low = max(0, min(mid - WINDOW // 2 + rng.randint(-14, 14), len(text) - WINDOW))
        part = char_classes(text[low : low + WINDOW])
        classes[n, : len(part)] = part
        for kind, start, end in spans:
            a, b = max(start - low, 0), min(end - low, len(part))
            if a < b:
                gold[n, a:b] = 2 + 2 * KINDS.index(kind)
                gold[n, a] = 1 + 2 * KINDS.index(kind)
    p = start_weights(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    order, step = list(range(len(data))), 0
    for epoch in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            _, g = gradient(classes[some], gold[some], p)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            rate = 0.02 * (1 - 0.8 * epoch / epochs)
            for k in p:
                x = g[k] * min(1.0, 5.0 / (norm + 1e-6))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


# ------------------------------------------------------------------ decoding


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within ``REACH`` characters of a digit or @; outside them nothing can be personal data of these kinds."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


WEIGHT = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1).astype(np.float32)


def region_scores(parts: list[np.ndarray], p: dict) -> list[np.ndarray]:
    """Tag scores of each stretch: overlapping windows, averaged with most weight on a window's middle."""
    at = [(k, low) for k, part in enumerate(parts) for low in range(0, max(1, len(part) - STRIDE), STRIDE)]
    sums = [np.zeros((len(part), len(TAGS)), np.float32) for part in parts]
    mass = [np.zeros((len(part), 1), np.float32) for part in parts]
    for first in range(0, len(at), 512):
        some = at[first : first + 512]
        classes = np.zeros((len(some), WINDOW), np.int64)
        for n, (k, low) in enumerate(some):
            part = parts[k][low : low + WINDOW]
            classes[n, : len(part)] = part
        scores = emissions(classes, p)
        for n, (k, low) in enumerate(some):
            size = min(WINDOW, len(parts[k]) - low)
            sums[k][low : low + size] += scores[n, :size] * WEIGHT[:size, None]
            mass[k][low : low + size] += WEIGHT[:size, None]
    return [s / w for s, w in zip(sums, mass)]


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """The best tags of a whole stretch."""
    now, came = np.where(FIRST, scores[0], NEVER), []
    for row in scores[1:]:
        reach = now[:, None] + move
        best = reach.argmax(0)
        came.append(best)
        now = reach[best, np.arange(len(best))] + row
    tags = [int(now.argmax())]
    for best in reversed(came):
        tags.append(int(best[tags[-1]]))
    return tags[::-1]


def model_spans(texts: list[str], p: dict) -> list[list[tuple[str, int, int]]]:
    """Spans that the network finds in each text, trimmed and held to the rules of their kinds."""
    where = [(n, a, b) for n, text in enumerate(texts) for a, b in regions(text)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    move = np.where(ALLOWED, p["move"], NEVER)
    for (n, low, high), scores in zip(where, region_scores([char_classes(texts[n][a:b]) for n, a, b in where], p)):
        tags, start = [*viterbi(scores, move), 0], None
        for k, tag in enumerate(tags):
            if start is not None and (tag == 0 or tag % 2 == 1):
                kind = KINDS[(tags[start] - 1) // 2]
                a, b = low + start, low + k
                text = texts[n]
                while a < b and not (text[a].isalnum() or text[a] in "+("):
                    a += 1
                while b > a and not text[b - 1].isalnum():
                    b -= 1
                alone = not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum())
                if b > a and alone and fits(kind, text[a:b]):
                    out[n].append((kind, a, b))
                start = None
            if tag % 2 == 1:
                start = k
    return out


def joined(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those further ones that touch none of them, by start and kind."""
    fresh = [s for s in more if all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
    return sorted([*base, *fresh], key=lambda s: (s[1], KINDS.index(s[0])))


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ------------------------------------------------------------------ over tables


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Network trained on at most ``sample`` snippets for each kind and as many without one.

    The patterns label the snippets on the executors; the first of each kind by a hash of
    document and place are taken. Without any, made-up values alone train it.
    """
    def each(rows):
        for doc_id, text in rows:
            spans = base_spans(text)
            for kind, a, b in spans:
                low = max(0, a - 40)
                part = text[low : b + 40]
                yield kind, doc_id, a, part, shown([(k, x - low, y - low) for k, x, y in spans if x >= low and y <= b + 40 and not (y <= low or x >= b + 40)])
            for m in TRIGGER.finditer(text):
                if not any(a - 60 < m.start() < b + 60 for _, a, b in spans):
                    low = max(0, m.start() - 40)
                    yield "none", doc_id, m.start(), text[low : m.end() + 40][:200], ""

    found = map_rows(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), each, "kind string, doc_id bigint, at bigint, part string, spans string"
    ).filter(F.length("part") <= 400)
    rows = top_n(found, ["kind"], [F.xxhash64("doc_id", "at"), F.col("doc_id"), F.col("at"), F.col("part")], sample).select("part", "spans").collect()
    parsed = [(r["part"], [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]) for r in rows]
    return train(parsed)


def find_all(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    Counts and digest are those of the patterns; ``spans`` holds these and what the
    network adds. A null text is empty and has none; repeated rows get the same answer.
    """
    model = fit(docs) if model is None else model
    held = docs.sparkSession.sparkContext.broadcast(model)

    def each(rows):
        rows = iter(rows)
        while some := list(islice(rows, 512)):
            texts = [text for _, text in some]
            for (doc_id, text), more in zip(some, model_spans(texts, held.value)):
                base = base_spans(text)
                count = [sum(1 for s in base if s[0] == k) for k in KINDS]
                yield doc_id, *count, hashlib.sha256(shown(base).encode()).hexdigest(), shown(joined(base, more))

    return map_rows(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), each,
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    )
