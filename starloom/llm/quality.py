"""Quality classifier: a generalised additive model with pairwise interactions over statistics of a text.

Shallow trees are boosted in turn, one feature after the other and round after round, on the residual of all the others;
summed up they are one lookup table for each feature over its bins, and one for each chosen pair of features.  A text's
score is the sum of its bins' entries through the logistic function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import read, tidy, written
from .textops import SPACED, mix, pieces, words

#: Labelled rows a model is fitted on at most: those with the smallest hashes, whole texts.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, LEAST = 64, 12, 6, 150, 0.1, 20
THRESHOLD = 0.3
FEATURES = (
    "log_words", "mean_word", "sd_word", "long_words", "short_words", "distinct_words", "top_word", "repeat_next", "letters", "upper",
    "digits", "stops", "symbols", "bars", "spaces", "non_ascii", "line_words", "distinct_lines", "upper_words", "symbol_words",
    "sentence_words", "caps_start", "max_word", "common_words", "vowels", "brackets", "repeat_lines", "distinct_pairs", "exclaims", "html",
)

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "letters": _LETTER, "upper": _UPPER, "digits": _set(b"0123456789"), "stops": _set(b".,;:?"), "symbols": _set(b"#$%&*+=@^_~\\"), "bars": _set(b"|<>"),
    "spaces": _set(b" \t\n\r\x0b\x0c"), "vowels": _set(b"aeiouAEIOU"), "brackets": _set(b"()[]{}\"'`"), "exclaims": _set(b"!"), "html": _set(b"<>/"),
}
_LINES = (np.array([b != 10 for b in range(256)]), SPACED[1])


def _share(a, b):
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _distinct(of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has."""
    _, at = np.unique(h ^ mix(of.astype(np.uint64) + np.uint64(1)), return_index=True)
    return np.bincount(of[at], minlength=n).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES): statistics of whole texts, 0 where a text has nothing to count."""
    n = len(offsets) - 1
    out = {f: np.zeros(n) for f in FEATURES}
    length = np.diff(offsets).astype(float)

    def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(flags, dtype=np.float64)])[first])

    for name, table in _CLASSES.items():
        out[name] = _share(per_text(table[data], offsets), length)
    out["non_ascii"] = _share(per_text(data >= 128, offsets), length)
    h, s, e, first = words(data, offsets, SPACED)
    count = np.diff(first).astype(float)
    size = (e - s).astype(float)
    of = np.repeat(np.arange(n), np.diff(first))
    out["log_words"] = np.log1p(count)
    mean = out["mean_word"] = _share(per_text(size, first), count)
    out["sd_word"] = np.sqrt(np.maximum(0, _share(per_text(size**2, first), count) - mean**2))
    out["long_words"], out["short_words"] = _share(per_text(size > 12, first), count), _share(per_text(size <= 3, first), count)
    if len(h):
        np.maximum.at(out["max_word"], of, np.minimum(size, 100))
        out["upper_words"] = _share(per_text(_UPPER[data[s]] & _UPPER[data[np.minimum(s + 1, e - 1)]] & (size > 1), first), count)
        out["caps_start"] = _share(per_text(_UPPER[data[s]], first), count)
        out["symbol_words"] = _share(per_text(~(_LETTER[data[e - 1]] | np.isin(data[e - 1], np.frombuffer(b".,;:?0123456789", np.uint8))), first), count)
        out["sentence_words"] = _share(per_text(data[e - 1] == 46, first), count)
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (of[1:] == of[:-1])])
        out["repeat_next"] = _share(per_text(same, first), count)
        _, at, times = np.unique(h ^ mix(of.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
        owner = of[at]
        out["distinct_words"] = _share(np.bincount(owner, minlength=n).astype(float), np.maximum(count, 1) ** 0.8)
        np.maximum.at(out["top_word"], owner, times)
        out["top_word"] = _share(out["top_word"], count)
        out["common_words"] = _share(np.bincount(owner, weights=times * (times > 2), minlength=n), count)
        pair = mix(h[:-1] * np.uint64(3) + h[1:])
        inside = of[1:] == of[:-1]
        out["distinct_pairs"] = _share(_distinct(of[1:][inside], pair[inside], n), np.maximum(count - 1, 0))
    lines, _, _, line_first = words(data, offsets, _LINES)
    line_count = np.diff(line_first).astype(float)
    out["line_words"] = np.minimum(_share(count, line_count), 500)
    if len(lines):
        line_of = np.repeat(np.arange(n), np.diff(line_first))
        distinct = _distinct(line_of, lines, n)
        out["distinct_lines"] = _share(distinct, line_count)
        out["repeat_lines"] = np.log1p(line_count - distinct)
    return np.stack([out[f] for f in FEATURES], axis=1)


def with_statistics(docs: DataFrame, text: str, keep: list[str], name: str = "features") -> DataFrame:
    """Columns keep of docs and an array of statistics of the text."""
    flow = docs.select(F.col(text).alias("_t"), *keep)

    def make(batches):
        for batch in batches:
            for row, data, offsets in pieces(batch.column(0), 1 << 21):
                x = statistics(data, offsets)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(c.slice(row, len(x)) for c in batch.columns[1:]), flat], names=[*keep, name])

    kinds = [f.simpleString().split(":", 1)[1] for f in flow.schema.fields[1:]]
    return flow.mapInArrow(tidy(make), ", ".join(f"`{c}` {k}" for c, k in zip([*keep, name], [*kinds, "array<double>"], strict=True)))


@dataclass
class Additive:
    """Edges of each feature's bins, a table for each feature, and (feature, feature, table) for pairs of coarser bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Best cut of bins lo..hi-1 into two leaves: (gain, first bin on the right)."""
    a, b, c = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi]), np.cumsum(n[lo:hi])
    left = a[:-1] ** 2 / (b[:-1] + 1) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + 1) - a[-1] ** 2 / (b[-1] + 1)
    left[(c[:-1] < LEAST) | (c[-1] - c[:-1] < LEAST)] = -1
    return (float(left.max()), lo + 1 + int(np.argmax(left))) if len(left) else (-1.0, lo)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A step function over bins with few leaves, grown by the best gain."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        gain, part, at = max(((*_split(g, h, n, *p)[:1], p, _split(g, h, n, *p)[1]) for p in parts), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], at), (at, part[1])]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four leaves: (gain, leaf values)."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gain, at = -1.0, (0, 0)
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            part = [(a[i, j], b[i, j]), (a[i, -1] - a[i, j], b[i, -1] - b[i, j]), (a[-1, j] - a[i, j], b[-1, j] - b[i, j]), (a[-1, -1] - a[i, -1] - a[-1, j] + a[i, j], b[-1, -1] - b[i, -1] - b[-1, j] + b[i, j])]
            if min(p[1] for p in part) > 0.5 and (got := sum(p * p / (q + 1) for p, q in part)) > gain:
                gain, at = got, (i + 1, j + 1)
    out = np.zeros_like(g)
    if gain > 0:
        for r in (slice(0, at[0]), slice(at[0], None)):
            for c in (slice(0, at[1]), slice(at[1], None)):
                out[r, c] = g[r, c].sum() / (h[r, c].sum() + 1)
    return gain, out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Additive:
    """Boosts single features in turn, then the pairs that gain most on the residual.  Without both labels the score is constant."""
    n, d = x.shape
    w = np.ones(n) if weight is None else weight
    rate = float((w * y).sum() / w.sum()) if n else 0.5
    base = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    edges, coarse = [_cuts(x[:, k], BINS) if n else np.zeros(0) for k in range(d)], [_cuts(x[:, k], PAIR_BINS) if n else np.zeros(0) for k in range(d)]
    model = Additive(base, edges, [np.zeros(len(e) + 1) for e in edges], coarse, [])
    if not n or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    cells = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    held = [np.bincount(b, minlength=len(e) + 1) for b, e in zip(bins, edges, strict=True)]
    total = np.full(n, base)

    def pull() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return w * (y - p), w * p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(d):
            if len(edges[k]):
                g, h = pull()
                size = len(edges[k]) + 1
                step = RATE * _tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size), held[k])
                model.tables[k] += step
                total += step[bins[k]]
    g, h = pull()

    def table(v: np.ndarray, i: int, j: int) -> np.ndarray:
        size = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cells[i] * size[1] + cells[j], v, size[0] * size[1]).reshape(size)

    ranked = sorted(((-_quadrants(table(g, i, j), table(h, i, j))[0], i, j) for i in range(d) for j in range(i) if len(coarse[i]) and len(coarse[j])))
    model.pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked[:PAIRS]]
    for _ in range(ROUNDS // 3):
        for i, j, t in model.pairs:
            g, h = pull()
            step = RATE * _quadrants(table(g, i, j), table(h, i, j))[1]
            t += step
            total += step[cells[i], cells[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = FIT_ROWS) -> Additive:
    """Fits on the labelled documents, or on most of them with the smallest hashes of their ids.

    Labels other than 0 and 1, or null, and null ids are left out; a document with several labels counts with its largest.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    some = written(marked.orderBy(F.xxhash64("_id"), "_id").limit(most), "labels")
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(some), "_id")  # at most FIT_ROWS rows of two numbers
    rows = with_statistics(found, "text", ["_id", "_y"]).dropDuplicates(["_id"]).toArrow()
    order = np.argsort(rows.column("_id").to_numpy(), kind="stable")
    x = np.array(rows.column("features").combine_chunks().flatten()).reshape(-1, len(FEATURES))[order] if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows.column("_y").to_numpy().astype(float)[order])


def scored(docs: DataFrame, model: Additive, keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep of docs and score.  A null text counts as empty; an empty text has a score like any other."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    flow = docs.select(F.col(text).alias("_t"), *keep)

    def make(batches):
        for batch in batches:
            score = [sent.value.score(statistics(data, offsets)) for _, data, offsets in pieces(batch.column(0), 1 << 21)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(score) if score else [], pa.float64())], names=[*keep, "__starloom_score"])

    return flow.mapInArrow(tidy(make), StructType([*flow.schema.fields[1:], StructField("__starloom_score", DoubleType())]))


def held_out(doc_id: str, n: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)) == rest, F.lit(False))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id", 5, 0)))
    out = scored(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("__starloom_score").alias("score"), (F.col("__starloom_score") >= THRESHOLD).cast("int").alias("predicted"))
