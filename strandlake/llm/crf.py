"""Quality of documents from a linear-chain conditional random field over their lines.

A line is good or bad. Its features are the binned measures of the line itself and of its
neighbours; neighbouring labels are tied by a transition matrix. The field is fitted to
labelled documents, whose lines all take the document's label, by gradient ascent of the
regularised likelihood with forward-backward expectations. A document's quality is the
mean marginal of "good" over its lines, weighted by their lengths and calibrated by a
logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded, texts_of, tidy

#: Labelled documents that the field is fitted on, those of the smallest hashes of such as have at most so many characters and lines. Scores have no bound.
SAMPLE = 3_000
CHARACTERS, LINES = 200_000, 500
#: Quantiles and evenly spaced values between which a measure is binned.
QUANTILES = 10
EVEN = 8
BINS = QUANTILES + EVEN
ROUNDS = 150
RATE = 0.1
DECAY = 1e-3
#: Bytes of text measured at once, and lines of a document from which on its messages go line by line, PIECE of them at once.
BLOCK = 1 << 18
STEPS, PIECE = 1 << 14, 1 << 12
THRESHOLD = 0.3
MEASURES = 16

_LETTER_LOW, _LETTER_UP, _DIGIT, _BLANK, _COMMON, _RARE, _HIGH, _CONTINUED = range(8)


def byte_classes() -> np.ndarray:
    out = np.full(256, _RARE, np.uint8)
    out[ord("a") : ord("z") + 1] = _LETTER_LOW
    out[ord("A") : ord("Z") + 1] = _LETTER_UP
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[[9, 10, 11, 12, 13, 32]] = _BLANK
    out[[ord(c) for c in ".,;:?'\"()-"]] = _COMMON
    out[128:192] = _CONTINUED
    out[192:] = _HIGH
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def measure(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MEASURES numbers for each line [start, end) of data, and a hash of its words. Lines aren't blank and are in order."""
    raw = np.frombuffer(data, np.uint8)
    kind = byte_classes()[raw]
    n = len(start)
    at = np.stack([start, end], 1).ravel()
    pad = np.append(kind, np.uint8(_BLANK))
    inner = lambda mask: np.add.reduceat(np.append(mask, False).astype(np.int32), at)[::2].astype(np.float64)
    chars = inner(kind != _CONTINUED)
    up, low, digit, rare, common, high = (inner(kind == k) for k in (_LETTER_UP, _LETTER_LOW, _DIGIT, _RARE, _COMMON, _HIGH))
    blank = pad == _BLANK
    first = np.flatnonzero(~blank[:-1] & np.concatenate([[True], blank[:-2]]))
    last = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    inside = np.searchsorted(end, first, "right")
    keep = (inside < n) & (first >= start[np.minimum(inside, n - 1)])
    first, last, line = first[keep], last[keep], inside[keep]
    padded = data + bytes(8)
    load = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = last - first
    mask = np.array([0, *((1 << 8 * i) - 1 for i in range(1, 9))], np.uint64)
    code = _mix((load[first] & mask[np.minimum(size, 8)]) + _mix((load[np.maximum(last - 8, first)] & mask[np.minimum(size, 8)]) + size.astype(np.uint64)))
    words = np.bincount(line, minlength=n).astype(np.float64)
    begin = np.concatenate([[0], np.cumsum(words)[:-1]]).astype(np.int64)
    place = np.arange(len(code)) - begin[line]
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (line[1:] == line[:-1])
    pair = _mix(code + line.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    order = np.argsort(pair, kind="stable")
    new = np.ones(len(pair), bool)
    new[1:] = pair[order][1:] != pair[order][:-1]
    distinct = np.bincount(line[order[new]], minlength=n)
    ends_rare = np.bincount(line, weights=kind[last - 1] == _RARE, minlength=n)
    shouted = np.bincount(line, weights=(kind[first] == _LETTER_UP) & (size > 1) & (kind[np.minimum(first + 1, len(kind) - 1)] == _LETTER_UP), minlength=n)
    alone = np.bincount(line, weights=(size == 1) & (kind[first] == _RARE), minlength=n)
    w = np.maximum(words, 1)
    letters = np.maximum(up + low + high, 1)
    c = np.maximum(chars, 1)
    measures = np.stack(
        [
            np.log1p(chars), np.log1p(words), up / letters, digit / c, rare / c, common / c, high / letters, (up + low + high) / c, chars / w,
            distinct / w, np.bincount(line, weights=again, minlength=n) / w, ends_rare / w, shouted / w, alone / w,
            (kind[end - 1] == _COMMON).astype(float), (kind[start] == _LETTER_UP).astype(float),
        ], 1,
    )
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, line, _mix(code + place.astype(np.uint64)))
    return measures, whole


def lines_of(texts: Iterator[bytes], model: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Measures (the last one: whether the line occurs again in its document), lengths and document numbers of all lines that aren't blank; how many documents.

    With a model, what the measures come to in place of them: see potentials().
    """
    found, lengths, owner, hashes = [], [], [], []
    held: list[bytes] = []
    owners: list[int] = []
    size = docs = 0

    def flush() -> None:
        nonlocal held, owners, size
        if not held:
            return
        data = b"\n".join(held) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        stop = np.flatnonzero(raw == 10)
        begin = np.concatenate([[0], stop[:-1] + 1])
        piece = np.repeat(np.arange(len(held)), [t.count(b"\n") + 1 for t in held])
        solid = np.flatnonzero(byte_classes()[raw] != _BLANK)
        # a line without its outer blanks
        a = np.searchsorted(solid, begin)
        b = np.searchsorted(solid, stop)
        full = a < b
        if full.any():
            s, e = solid[a[full]], solid[b[full] - 1] + 1
            m, h = measure(data, s, e)
            found.append(m if model is None else potentials(model, m))
            hashes.append(h)
            lengths.append((e - s).astype(np.int32))
            owner.append(np.array(owners, np.int32)[piece[full]])
        held, owners, size = [], [], 0

    for t in texts:
        at = 0
        while len(t) - at > BLOCK:
            cut = t.rfind(b"\n", at, at + BLOCK)
            cut = t.find(b"\n", at + BLOCK) if cut <= at else cut
            if cut < 0:
                break
            flush()
            held, owners = [t[at:cut]], [docs]
            flush()
            at = cut + 1
        held.append(t[at:])
        owners.append(docs)
        size += len(t) - at
        docs += 1
        if size > BLOCK:
            flush()
    flush()
    if not found:
        return np.zeros((0, MEASURES + 1 if model is None else 3)), np.zeros(0), np.zeros(0, np.int64), docs
    doc, size, pair = _joined(owner), _joined(lengths), _joined(hashes)
    pair = _mix(pair + _mix(doc.astype(np.uint64)))
    several = np.sort(pair)
    several = np.unique(several[1:][several[1:] == several[:-1]])
    again = np.zeros(len(pair), bool)
    if len(several):
        again = several[np.minimum(np.searchsorted(several, pair), len(several) - 1)] == pair
    del pair
    kept = _joined(found)
    if model is None:
        return np.column_stack([kept, again]), size.astype(float), doc, docs
    either = potentials(model, np.array([[0.0], [1.0]]), MEASURES)
    for k in range(3):
        kept[:, k] += np.where(again, either[1, k], either[0, k])
    return kept, size.astype(float), doc, docs


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; each is given up as it is copied."""
    out = np.empty((sum(map(len, parts)), *parts[0].shape[1:]), parts[0].dtype)
    at = len(out)
    while parts:
        part = parts.pop()
        out[at - len(part) : at] = part
        at -= len(part)
    return out


def features(measures: np.ndarray, doc: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Indices of the features of every line: its own bins and those of the lines before and after it in the document."""
    width = len(edges) * (BINS + 1)
    own = np.stack([np.searchsorted(e, measures[:, i], "right") + i * (BINS + 1) for i, e in enumerate(edges)], 1)
    none = np.full(own.shape[1], 3 * width)
    before, after = np.empty_like(own), np.empty_like(own)
    before[1:], after[:-1] = own[:-1] + width, own[1:] + 2 * width
    start = np.ones(len(doc), bool)
    start[1:] = doc[1:] != doc[:-1]
    before[start] = none
    after[np.append(start[1:], True)[: len(doc)]] = none
    return np.concatenate([own, before, after], 1)


def potentials(model: dict, measures: np.ndarray, first: int = 0) -> np.ndarray:
    """What measures, from number `first` on, add to the line itself, to the next line and to the one before."""
    out = np.zeros((len(measures), 3))
    by_place = model["weight"][:-1].reshape(3, -1)
    for i, column in enumerate(measures.T, first):
        at = np.searchsorted(model["edges"][i], column, "right") + i * (BINS + 1)
        for k in range(3):
            out[:, k] += by_place[k, at]
    return out


def _scores(model: dict, added: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The log potential of every line, from its potentials() and those of the lines beside it in the document."""
    edge = len(model["edges"]) * model["weight"][-1]
    same = doc[1:] == doc[:-1]
    score = added[:, 0].copy()
    score[1:] += np.where(same, added[:-1, 1], edge)
    score[:-1] += np.where(same, added[1:, 2], edge)
    if len(score):
        score[0] += edge
        score[-1] += edge
    return score


def long_marginals(score: np.ndarray, change: np.ndarray) -> np.ndarray:
    """P(good) of the lines of one document of any length, as forward_backward() has it: messages are odds, of which the forward ones are kept, a number a line."""
    (bad_bad, bad_good), (good_bad, good_good) = np.exp(change).tolist()
    out = np.empty(len(score))
    pieces = range(0, len(score), PIECE)

    def odds(at: int) -> list[float]:
        return np.exp(np.clip(score[at : at + PIECE], -30, 30)).tolist()

    ahead = None
    for at in pieces:
        found = []
        for own in odds(at):
            ahead = own if ahead is None else own * (bad_good + ahead * good_good) / (bad_bad + ahead * good_bad)
            found.append(ahead)
        out[at : at + PIECE] = found
    back = 1.0
    for at in reversed(pieces):
        found = []
        for seen, own in zip(reversed(out[at : at + PIECE].tolist()), reversed(odds(at)), strict=True):
            found.append(seen * back / (1 + seen * back))
            here = own * back
            back = (good_bad + here * good_good) / (bad_bad + here * bad_good)
        out[at : at + PIECE] = found[::-1]
    return out


def forward_backward(score: np.ndarray, doc: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of each pair of neighbouring labels.

    score: log potential of good against bad; change: log potentials [from, to], 0 bad, 1 good.
    All documents take a step together, the longest first.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.append(start, n))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    own = np.stack([1 - p, p], 1)
    step = np.exp(change)
    a, b = np.empty((n, 2)), np.empty((n, 2))
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    for t in range(length[0]):
        at = start[: live[t]] + t
        x = own[at] if t == 0 else (a[at - 1] @ step) * own[at]
        a[at] = x / x.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    b[start + length - 1] = 1.0
    for t in range(length[0] - 2, -1, -1):
        at = start[: live[t + 1]] + t
        ahead = own[at + 1] * b[at + 1]
        x = ahead @ step.T
        b[at] = x / x.sum(1, keepdims=True)
        joint = a[at][:, :, None] * step * ahead[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    m = a * b
    return m[:, 1] / m.sum(1), pairs


def _edges(x: np.ndarray) -> np.ndarray:
    """Quantiles, and even steps for what is rare."""
    return np.unique(np.concatenate([np.quantile(x, np.linspace(0, 1, QUANTILES + 1)[1:]), np.linspace(x.min(), x.max(), EVEN + 1)[1:]]))


def fit(measures: np.ndarray, lengths: np.ndarray, doc: np.ndarray, label: np.ndarray) -> dict:
    """The field for lines in document order; label: of each document."""
    share = float(label.mean()) if len(label) else 0.5
    edges = [_edges(measures[:, i]) for i in range(measures.shape[1])] if len(doc) else [np.zeros(0)] * (MEASURES + 1)
    model = {"share": share, "edges": edges, "weight": None, "change": np.zeros((2, 2)), "slope": 1.0, "shift": 0.0}
    if not len(doc) or not 0 < share < 1:
        return model
    index = features(measures, doc, edges)
    size = 3 * len(edges) * (BINS + 1) + 1
    y = label[doc].astype(float)
    # lines of either label weigh alike
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if 0 < y.mean() < 1 else np.ones(len(y))
    same = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same].astype(int), y[1:][same].astype(int)), 1)
    theta, first, second = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for r in range(1, ROUNDS + 1):
        weight, change = theta[:size], theta[size:].reshape(2, 2)
        good, pairs = forward_backward(weight[index].sum(1), doc, change)
        gradient = np.empty(size + 4)
        gradient[:size] = np.bincount(index.ravel(), weights=np.repeat((y - good) * balance, index.shape[1]), minlength=size) / len(y)
        gradient[size:] = (seen - pairs).ravel() / len(y)
        gradient -= DECAY * theta
        gradient[size:] -= 0.02 * theta[size:]
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + RATE * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-6)
    model |= {"weight": theta[:size], "change": theta[size:].reshape(2, 2)}
    quality = _mean(model, potentials(model, measures), lengths, doc, len(label))
    x = np.log(quality / (1 - quality))
    slope, shift = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        slope += 0.05 * float(((label - p) * x).mean() - 0.01 * (slope - 1))
        shift += 0.2 * float((label - p).mean())
    return model | {"slope": max(slope, 0.05), "shift": shift}


def _mean(model: dict, added: np.ndarray, lengths: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """The mean marginal of every document by the lengths of its lines; added: potentials() of all measures."""
    scores = _scores(model, added, doc)
    lines = np.bincount(doc, minlength=docs)
    long = lines > STEPS
    good = np.empty(len(doc))
    few = ~long[doc] if long.any() else slice(None)
    good[few], _ = forward_backward(scores[few], doc[few], model["change"])
    for d in np.flatnonzero(long).tolist():
        a, b = np.searchsorted(doc, [d, d + 1])
        good[a:b] = long_marginals(scores[a:b], model["change"])
    total = np.bincount(doc, weights=lengths, minlength=docs)
    mean = np.bincount(doc, weights=lengths * good, minlength=docs) / np.maximum(total, 1)
    return np.clip(np.where(total > 0, mean, model["share"]), 1e-4, 1 - 1e-4)


def quality(model: dict, texts: Iterator[bytes]) -> np.ndarray:
    """The score of every text; texts without a line have the share of good labels. BLOCK bytes of texts are scored at once, and a longer text by itself."""
    out, held, size = [], [], 0
    for t in texts:
        if held and size + len(t) > BLOCK:
            out.append(_quality(model, held))
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        out.append(_quality(model, held))
    return np.concatenate(out) if out else np.zeros(0)


def _quality(model: dict, texts: list[bytes]) -> np.ndarray:
    if model["weight"] is None:
        return np.full(len(texts), model["share"])
    kept, lengths, doc, docs = lines_of(iter(texts), model)
    mean = _mean(model, kept, lengths, doc, docs)
    score = 1 / (1 + np.exp(-(model["slope"] * np.log(mean / (1 - mean)) + model["shift"])))
    empty = np.bincount(doc, minlength=docs) == 0
    return np.where(empty, model["share"], score)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The field, fitted to `sample` labelled documents at most, of CHARACTERS and LINES at most and those whose crc32 isn't divisible by 5."""
    crc = F.crc32(F.col("doc_id").cast("string")) % 5
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    fit_for = (F.coalesce(F.length("text"), F.lit(0)) <= CHARACTERS) & (F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")), F.lit(0)) < LINES)
    rows = bounded(docs).where(fit_for).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("lines", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for t in texts_of(b.column(1)):
                measures, lengths, _, _ = lines_of(iter([t]))
                packed.append(np.column_stack([measures, lengths]).astype("<f4").tobytes())
            yield batch(schema, b.column(0), b.column(2).cast(pa.int32()), packed)

    got = rows.mapInArrow(tidy(run), "doc_id long, quality int, lines binary").toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    lines = [np.frombuffer(x, "<f4").reshape(-1, MEASURES + 2) for x in got["lines"]]
    doc = np.repeat(np.arange(len(lines)), np.array([len(x) for x in lines], np.int64))
    every = np.concatenate(lines) if lines else np.zeros((0, MEASURES + 2))
    return fit(every[:, :-1].astype(np.float64), every[:, -1].astype(np.float64), doc, got["quality"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted.

    labels(doc_id, quality): a document with several labels takes the greatest; null
    ones don't count. Null and empty texts have the share of good labels as their score;
    without labels of both kinds every text has. Repeated rows stay; a null doc_id isn't
    held out; other columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, sample)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(schema, b.column(0), quality(model, texts_of(b.column(1))))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; score() says what holds for odd rows."""
    model = train(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(quality(model, texts_of(b.column(at))) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
