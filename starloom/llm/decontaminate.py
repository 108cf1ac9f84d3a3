"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

A window is a run of WINDOW consecutive words of an item (all words of a shorter item).  Its tokens are its runs of up to
TOKEN words, ordered by rarity over all documents.  A document contains a window only if it contains the window's rarest
token (the prefix of a containment join at threshold 1), at the same position in the window, with all the window's words
around it; so documents are probed with prefix tokens alone, and the length and positional bounds and a comparison of
the windows' words settle the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, tidy, unclashing, written
from .textops import ALNUM, buffers, pieces, runs, words

WINDOW, TOKEN = 10, 3
#: Windows that one pass over the documents looks for; more items take more passes, so that what is sent to the executors stays bounded.
WINDOWS_A_PASS = 1_000_000


def _tokens_of(items: list[tuple], window: int, token: int):
    """(hashes of words per item, windows as (item, first word, words), token hashes of each window)."""
    data, offsets = buffers(pa.array([t for _, t in items], pa.large_string()))
    h, _, _, first = words(data, offsets, ALNUM)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = min(window, b - a)
        if n:
            own = runs(h[a:b], min(token, n))
            for s in range(b - a - n + 1):
                yield i, h[a + s : a + s + n], own[s : s + n - min(token, n) + 1]


def _probe(table: np.ndarray, bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of x whose value is in the sorted table; bits is a bitmap of 2**20 low ends that spares most searches."""
    hit = np.flatnonzero(bits[(x & np.uint64(0xFFFFF)).astype(np.int64)])
    at = np.searchsorted(table, x[hit])
    at[at == len(table)] = 0
    return hit[table[at] == x[hit]] if len(table) else hit[:0]


def _bitmap(table: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(table & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return bits


def token_counts(docs: DataFrame, tables: list, text: str) -> DataFrame:
    """(token, n): how often each token of the tables (one sorted array for each number of words) occurs in all documents."""
    known = [(k, t, _bitmap(t)) for k, t in tables]

    def count(batches):
        total = [np.zeros(len(t), np.int64) for _, t, _ in known]
        for batch in batches:
            for _, data, offsets in pieces(batch.column(0)):
                h, _, _, first = words(data, offsets, ALNUM)
                of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                for j, (k, t, bits) in enumerate(known):
                    r = runs(h, k)
                    at = _probe(t, bits, r)
                    at = at[of[at] == of[at + k - 1]]
                    total[j] += np.bincount(np.searchsorted(t, r[at]), minlength=len(t))
        for (_, t, _), n in zip(known, total, strict=True):
            if (some := n > 0).any():
                yield pa.record_batch({"token": pa.array(t[some].view(np.int64)), "n": pa.array(n[some])})

    return docs.select(text).mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


class _Index:
    """Windows by their rarest token: sorted prefix hashes and, for each, (item, place of the token, words)."""

    def __init__(self, found: list, count: dict[int, int]):
        groups: dict[tuple[int, int], set] = {}
        for item, w, tokens in found:
            signed = tokens.view(np.int64).tolist()
            best = min(range(len(signed)), key=lambda p: (count.get(signed[p], 0), signed[p], p))
            size = len(w) - len(tokens) + 1
            groups.setdefault((size, len(w)), set()).add((int(tokens[best]), best, item, w.tobytes()))
        self.groups = []
        for (size, n), rows in sorted(groups.items()):
            rows = sorted(rows)
            key = np.array([r[0] for r in rows], np.uint64)
            self.groups.append((size, n, np.unique(key), _bitmap(key), key, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), n)))

    def hits(self, h: np.ndarray, first: np.ndarray, of: np.ndarray):
        """(text, item, first word, past the last word) of every occurrence of a window; words count within the arrays."""
        for size, n, table, bits, key, place, item, window in self.groups:
            r = runs(h, size)
            at = _probe(table, bits, r)
            lo, hi = np.searchsorted(key, r[at], "left"), np.searchsorted(key, r[at], "right")
            at, row = np.repeat(at, hi - lo), np.repeat(lo, hi - lo) + _ramp(hi - lo)
            start = at - place[row]
            text = of[at]
            fits = (start >= first[text]) & (start + n <= first[text + 1])
            start, row, text = start[fits], row[fits], text[fits]
            same = np.ones(len(start), bool)
            for k in range(n):
                same &= h[start + k] == window[row, k]
            yield text[same], item[row[same]], start[same], start[same] + n


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) - np.repeat(total - n, n)


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, token: int = TOKEN, most: int = WINDOWS_A_PASS, keep: list[str] | None = None, names: tuple = ("n_words", "spans", "items")) -> DataFrame:
    """Columns keep of docs (all by default) and, by the given names, the number of words, spans (array of first word and past the last) and items (ids as strings, sorted).

    A null or empty text has no words and no hit.  Items that are null or have no words match nothing; items with the same
    id count once.  Repeated documents are judged each by itself.  Without items every document is clean.
    A column of docs that has one of the given names isn't kept: the result takes its place.
    Items come to the driver in blocks of so many windows, one at a time; with more than one the documents are written
    after each pass, so that one index alone is with the executors.  Documents are never shuffled.
    """
    spark = docs.sparkSession
    own = ("__starloom_words", "__starloom_spans", "__starloom_items")
    kept = unclashing([c for c in (keep if keep is not None else docs.columns) if c not in own], names)
    flow = docs.select(*dict.fromkeys([*kept, text])).withColumn(own[0], F.lit(None).cast("long")).withColumn(own[1], F.array().cast("array<struct<a:long,b:long>>")).withColumn(own[2], F.array().cast("array<string>"))
    before = None
    for block, last in _blocks(items.select(F.col(item_id).cast("string"), F.col(item_text)).where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()), most):
        found = list(_tokens_of(block, window, token))
        tables = [(k, np.unique(np.concatenate([t for _, w, t in found if len(w) - len(t) + 1 == k]))) for k in sorted({len(w) - len(t) + 1 for _, w, t in found})]
        rare = {r["token"]: r["n"] for r in token_counts(docs, tables, text).toLocalIterator()} if tables else {}
        index = spark.sparkContext.broadcast((_Index(found, rare), [i for i, _ in block]))
        flow = _scan(flow, text, own, index)
        if not last:  # one index is there at a time
            after = written(flow, "pass")
            discard(before)
            index.destroy()
            flow = before = after
    return flow.select(*kept, *(F.col(a).alias(b) for a, b in zip(own, names, strict=True)))


def _blocks(items: DataFrame, most: int):
    """(items, whether they are the last) in blocks of so many windows at most, or a single item; a block is held at a time."""
    block, size = [], 0
    for r in items.distinct().orderBy(*items.columns).toLocalIterator():
        n = len(r[1]) // 2  # a word and what ends it take two characters at least
        if block and size + n > most:
            yield block, False
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    yield block, True


def _scan(flow: DataFrame, text: str, own: tuple, sent) -> DataFrame:
    at = [flow.columns.index(c) for c in (text, *own)]
    names, kinds = flow.columns, flow.schema

    def scan(batches):
        index, ids = sent.value
        for batch in batches:
            batch = batch if isinstance(batch, pa.RecordBatch) else pa.RecordBatch.from_batches([batch])
            n_words, spans, items = [], [], []
            for row, data, offsets in pieces(batch.column(at[0])):
                h, _, _, first = words(data, offsets, ALNUM)
                of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                parts = [np.stack(x, axis=1) for x in index.hits(h, first, of)]
                got = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
                got = got[np.lexsort((got[:, 2], got[:, 0]))]
                cut = np.searchsorted(got[:, 0], np.arange(len(offsets)))
                n_words.append(np.diff(first))
                for d in range(len(offsets) - 1):
                    mine = got[cut[d] : cut[d + 1]]
                    spans.append([] if not len(mine) else [{"a": a, "b": b} for a, b in merged(mine[:, 2] - first[d], mine[:, 3] - first[d])])
                    items.append([] if not len(mine) else [ids[i] for i in np.unique(mine[:, 1]).tolist()])
            old = batch.columns
            columns = list(old)
            before, seen = old[at[2]].to_pylist(), old[at[3]].to_pylist()
            if any(before):
                spans = [[{"a": a, "b": b} for a, b in merged(np.array([x["a"] for x in p + q]), np.array([x["b"] for x in p + q]))] if p else q for p, q in zip(before, spans, strict=True)]
            items = [sorted({*p, *q}) for p, q in zip(seen, items, strict=True)]
            columns[at[1]] = pa.array(np.concatenate(n_words) if n_words else [], pa.int64())
            columns[at[2]] = pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            columns[at[3]] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return flow.mapInArrow(tidy(scan), kinds)


def merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Intervals united where they overlap or touch, in order."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else a
    return list(zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist(), strict=True)) if len(a) else []


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: Brute force: every window of every item against every run of as many words.
OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ik AS (SELECT item_id, w, least(10, len(w)) AS k FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM ik)),
ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, s, dg.k FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
hw AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY 1),
hi AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
