"""Quality classifier: a linear-chain CRF over the lines of a text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.shared import append, free_name, map_rows
from recordweave.session import stage

SAMPLE_DOCS = 3000
SAMPLE_LINES = 200
THRESHOLD = 0.7

LOWER, UPPER, DIGIT, SPACE, STOP, SHOUT, QUOTE, BAR, SYMBOL, WIDE, CONTROL = range(11)
CLASS = np.full(256, WIDE, np.uint8)
CLASS[:32] = CONTROL
CLASS[127] = CONTROL
CLASS[[9, 32]] = SPACE
for chars, kind in ((b".,;:?", STOP), (b"!", SHOUT), (b"\"'()[]{}`-", QUOTE), (b"|", BAR), (b"#$%&*@^~_=+<>\\/", SYMBOL)):
    CLASS[list(chars)] = kind
CLASS[48:58], CLASS[65:91], CLASS[97:123] = DIGIT, UPPER, LOWER
KINDS = 11
WIDTH = KINDS + 9


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with those of its neighbours, length of each line in bytes)."""
    raw = (text or "").encode("utf-8", "replace")
    lines = raw.split(b"\n")
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = CLASS[np.frombuffer(raw + b"\n", np.uint8)]
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    counts = np.empty((len(lines), KINDS))
    for k in range(KINDS):
        counts[:, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64)
    counts[:, CONTROL] -= 1  # the line feed
    split = [line.split() for line in lines]
    words = np.fromiter(map(len, split), np.float64, len(lines))
    unique = np.fromiter((len(set(w)) for w in split), np.float64, len(lines))
    seen: set[bytes] = set()
    again = np.zeros(len(lines))
    for i, line in enumerate(lines):
        again[i] = line in seen
        seen.add(line)
    size, many = np.maximum(sizes, 1), np.maximum(words, 1)
    own = np.column_stack([
        counts / size[:, None],
        np.log1p(sizes) / 8,
        counts[:, UPPER] / np.maximum(counts[:, UPPER] + counts[:, LOWER], 1),
        np.minimum(counts[:, [SYMBOL, BAR, SHOUT, STOP]] / many[:, None], 4),
        np.minimum((sizes - counts[:, SPACE]) / many / 10, 4),
        unique / many,
        again,
    ])
    blank = np.zeros((1, WIDTH))
    return np.hstack([own, np.vstack([blank, own[:-1]]), np.vstack([own[1:], blank]), np.ones((len(lines), 1))]), size


# ------------------------------------------------------------------ the chain


def marginals(scores: list[np.ndarray], between: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: (P(label) per line, summed edge marginals, log partition).

    ``scores`` has (lines, 2) per chain, ``between`` the score of label to label.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    steps = int(sizes[0]) if len(sizes) else 0
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]  # chains longer than t
    emit = [np.empty((n, 2)) for n in live]
    for row, i in enumerate(order):
        for t in range(len(scores[i])):
            emit[t][row] = scores[i][t]
    ahead = []
    for t in range(steps):
        if t == 0:
            ahead.append(emit[0])
        else:
            before = ahead[-1][: live[t]]
            ahead.append(emit[t] + np.logaddexp(before[:, :1] + between[0], before[:, 1:] + between[1]))
    back = [None] * steps
    total = np.empty(len(sizes))
    edges = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        here = np.zeros((live[t], 2))
        if t + 1 < steps:
            after = emit[t + 1] + back[t + 1]
            n = live[t + 1]
            here[:n] = np.logaddexp(between[:, 0] + after[:, :1], between[:, 1] + after[:, 1:])
        back[t] = here
        last = slice(live[t + 1] if t + 1 < steps else 0, live[t])
        total[last] = np.logaddexp(ahead[t][last, 0], ahead[t][last, 1])
    out = [np.empty((n, 2)) for n in sizes]
    for t in range(steps):
        p = np.exp(ahead[t] + back[t] - total[: live[t], None])
        for row in range(live[t]):
            out[row][t] = p[row]
        if t + 1 < steps:
            n = live[t + 1]
            pair = ahead[t][:n, :, None] + between[None] + (emit[t + 1] + back[t + 1])[:, None, :] - total[:n, None, None]
            edges += np.exp(pair).sum(axis=0)
    back_in_order = [None] * len(scores)
    for row, i in enumerate(order):
        back_in_order[i] = out[row]
    return back_in_order, edges, total


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 120, decay: float = 1e-3) -> dict:
    """CRF weights from (features, lengths, label): each line of a text carries its label.

    Maximum likelihood by Adam on standardised features, then a logistic curve from
    the length-weighted marginal to the label. Without both labels every score is 0.5.
    """
    if len({label for _, _, label in rows}) < 2:
        return {"mean": 0.0, "scale": 1.0, "w": np.zeros((3 * WIDTH + 1, 2)), "between": np.zeros((2, 2)), "curve": (0.0, 0.0)}
    every = np.vstack([x for x, _, _ in rows])
    mean, scale = every.mean(axis=0), every.std(axis=0)
    mean[-1], scale[scale < 1e-6] = 0.0, 1.0
    feats = [np.clip((x - mean) / scale, -6, 6) for x, _, _ in rows]
    flat = np.vstack(feats)
    cuts = np.cumsum([len(x) for x in feats])[:-1]
    labels = np.concatenate([np.full(len(x), label) for (x, _, label) in rows])
    weight = np.concatenate([np.full(len(x), 1 / len(x)) for x in feats])
    gold = np.eye(2)[labels]
    seen_edges = np.zeros((2, 2))
    for x, _, label in rows:
        seen_edges[label, label] += len(x) - 1
    w, between = np.zeros((flat.shape[1], 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(between), np.zeros_like(between)]
    for r in range(1, rounds + 1):
        got, edges, _ = marginals(np.split(flat @ w, cuts), between)
        gw = flat.T @ (np.vstack(got) - gold) / len(labels) + decay * w
        gb = (edges - seen_edges) / len(labels) + decay * between
        for value, grad, k in ((w, gw, 0), (between, gb, 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * grad
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * grad**2
            value -= 0.08 * (moments[k] / (1 - 0.9**r)) / (np.sqrt(moments[k + 1] / (1 - 0.99**r)) + 1e-8)
    model = {"mean": mean, "scale": scale, "w": w, "between": between, "curve": (1.0, 0.0)}
    raw = logit(np.array(shares([(x, s) for x, s, _ in rows], model)))
    truth = np.array([label for _, _, label in rows], float)
    a, b = 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        h = p * (1 - p) + 1e-6
        grad = np.array([((p - truth) * raw).sum() + 0.1 * (a - 1), (p - truth).sum()])
        hess = np.array([[(h * raw * raw).sum() + 0.1, (h * raw).sum()], [(h * raw).sum(), h.sum()]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - 0.5 * da, b - 0.5 * db
        if abs(da) + abs(db) < 1e-9:
            break
    model["curve"] = (float(a), float(b))
    return model


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def shares(docs: list[tuple[np.ndarray, np.ndarray]], model: dict) -> list[float]:
    """Length-weighted mean of P(good) over the lines of each text."""
    scores = [np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["w"] for x, _ in docs]
    got, _, _ = marginals(scores, model["between"])
    return [float((p[:, 1] * size).sum() / size.sum()) for p, (_, size) in zip(got, docs)]


def score_texts(texts: list[str | None], model: dict) -> list[float]:
    a, b = model["curve"]
    raw = logit(np.array(shares([line_features(t) for t in texts], model)))
    return (1 / (1 + np.exp(-(a * raw + b)))).tolist()


# ------------------------------------------------------------------ over tables


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> dict:
    """Model from at most ``sample`` labelled documents that are not held out.

    They are the first by a hash of their id, half of them of either label as far as
    there are enough; of a text beyond ``SAMPLE_LINES`` lines, evenly spaced ones
    train. Lines are turned into features on the executors; the bounded result comes to the driver.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = None
    for label in (0, 1):
        some = known.filter((F.col("quality") == label) & ~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        ids = some if ids is None else ids.union(some)
    rows = docs.select("doc_id", "text").join(ids.withColumnsRenamed({"doc_id": "_id"}), F.col("doc_id") == F.col("_id"))

    def each(rows):
        for doc_id, text, label in rows:
            x, size = line_features(text)
            if len(x) > SAMPLE_LINES:
                pick = np.linspace(0, len(x) - 1, SAMPLE_LINES).astype(int)
                x, size = x[pick], size[pick]
            yield doc_id, label, x.astype("<f4").tobytes(), size.astype("<i8").tobytes()

    made = map_rows(rows.select("doc_id", "text", "quality"), each, "doc_id bigint, label int, x binary, size binary", rows=256)
    got = sorted(made.collect())
    seen, use = set(), []
    for doc_id, label, x, size in got:
        if doc_id not in seen:
            seen.add(doc_id)
            use.append((np.frombuffer(x, "<f4").reshape(-1, 3 * WIDTH + 1).astype(float), np.frombuffer(size, "<i8"), label))
    return train(use)


def with_score(docs: DataFrame, model: dict, out: str = "_score") -> DataFrame:
    """``docs`` with the quality score of each text as a further column."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = []
            for at in range(0, len(texts), 256):
                made += score_texts(texts[at : at + 256], model)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.float64())], schema=pa.schema([*batch.schema, (out, pa.float64())])
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    A null text counts as empty, an empty one as one empty line. Repeated rows get equal scores;
    with no usable labels all get 0.5.
    """
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored below ``THRESHOLD``; columns stay, whatever their names."""
    out = free_name(docs, "_score")
    return with_score(docs, fit(docs, labels), out).filter(F.col(out) >= THRESHOLD).drop(out)
