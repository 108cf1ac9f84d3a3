"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; each bit of it is predicted by a binary classifier over hashed n-grams, and the language
whose codeword loses least, each bit weighted by how well it is predicted, wins.  A narrow win is flagged as ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import read, tidy, unclashing
from .quality import held_out
from .textops import pieces

#: Sizes of n-grams in bytes, and buckets they are hashed into.
GRAMS, BUCKETS = (2, 3, 4), 1 << 15
#: Longest codeword; languages of which no more are told apart.
MOST_BITS, MOST_LANGUAGES = 64, 4096
#: A win by less probability than this is ambiguous.
NARROW = 0.2
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
#: Bytes of a long text whose n-grams are held at once.
BLOCK = 1 << 21
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32  # digits, punctuation and white space all end a word alike


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram that starts at each byte and at each text's end, for each size; offsets of the texts in them.

    Spaces follow each text, so that no n-gram reaches into the next one.  Letters count in lower case, also those of two
    bytes whose lower case lies 32 further (as in Latin-1).
    """
    n = len(offsets) - 1
    gap = max(GRAMS)
    m = len(data) + n * gap
    x = np.full(m + gap, 32, np.uint64)
    x[np.arange(len(data)) + np.repeat(np.arange(n) * gap, np.diff(offsets))] = _FOLD[data]
    accent = np.flatnonzero((x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[:-1] == 0xC3)) + 1
    x[accent] += np.uint64(32)
    starts = np.ones(m, bool)
    starts[(offsets[1:] + np.arange(1, n + 1) * gap)[:, None] - np.arange(1, gap)] = False
    out, key = [], x[:m].copy()
    for k in range(1, max(GRAMS)):
        key = (key << np.uint64(8)) | x[k : k + m]
        if k + 1 in GRAMS:
            out.append(((key * np.uint64(0x9E3779B97F4A7C15) + np.uint64((k * 0xC2B2AE3D27D4EB4F) % 2**64)) >> np.uint64(64 - 15))[starts].astype(np.int64))
    return out, offsets + np.arange(n + 1)


def gram_blocks(data: np.ndarray, offsets: np.ndarray):
    """The same in parts of bounded size: a run of texts whole, a long text alone in several parts of offsets [0, n]."""
    if len(offsets) > 2 or len(data) <= BLOCK:
        yield grams(data, offsets)
        return
    for lo in range(0, len(data), BLOCK):
        hi = min(lo + BLOCK, len(data))
        before = min(lo, 1)  # a letter of two bytes may lie across the cut
        part = data[lo - before : hi + max(GRAMS) - 1]
        found, _ = grams(part, np.array([0, len(part)]))
        n = hi - lo + (hi == len(data))
        yield [x[before : before + n] for x in found], np.array([0, n])


def lettered(text: str | None) -> bool:
    return text is not None and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: all splits of up to six languages, else random ones kept far apart."""
    if n <= 6:
        splits = [s for s in range(1, 2 ** max(n - 1, 1))]
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n)])
    rng = np.random.Generator(np.random.PCG64(11))
    bits = min(MOST_BITS, int(np.ceil(10 * np.log2(n))))
    best, far = None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (n, bits)) * 2 - 1
        agree = code @ code.T - 2 * bits * np.eye(n, dtype=int)
        if (bits - agree.max()) > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, bits - agree.max()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    #: (sizes, BUCKETS, bits) evidence of an n-gram for +1
    evidence: np.ndarray
    #: how much a bit's loss counts
    trust: np.ndarray


def margins(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, bits): mean evidence of a text's n-grams."""
    n, total = np.zeros(len(offsets) - 1), np.zeros((len(offsets) - 1, model.code.shape[1]))
    for found, at in gram_blocks(data, offsets):
        n += np.diff(at)
        for k, bucket in enumerate(found):
            if len(bucket):
                total += np.add.reduceat(model.evidence[k][bucket], at[:-1], axis=0)
    return total / np.maximum(n, 1)[:, None] / len(GRAMS)


def decode(model: Model, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, ambiguous) by weighted logistic loss over the bits; short texts are judged less surely."""
    strength = 4 * np.sqrt(np.minimum(n, 400))[:, None]
    signed = (m * strength)[:, None, :] * model.code[None]
    loss = (np.logaddexp(0, -signed) * model.trust).sum(axis=2) / model.trust.sum()
    p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    best = np.argmax(p, axis=1)
    top = np.sort(p, axis=1)
    gap = top[:, -1] - top[:, -2] if p.shape[1] > 1 else np.ones(len(p))
    return best, top[:, -1], gap < NARROW


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts n-grams by language over all docs with a language, however many; what comes to the driver is of fixed size per language."""
    spark = docs.sparkSession
    some = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    languages = sorted(r[0] for r in some.select(F.col(lang)).distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    number = {x: i for i, x in enumerate(languages)}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            of = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for row, data, offsets in pieces(batch.column(0), 1 << 20):
                for found, at in gram_blocks(data, offsets):
                    mine = np.repeat(of[row : row + len(offsets) - 1], np.diff(at))
                    for i in np.unique(mine).tolist():
                        for k, bucket in enumerate(found):
                            t = total.setdefault(i, np.zeros((len(GRAMS), BUCKETS), np.int64))
                            t[k] += np.bincount(bucket[mine == i], minlength=BUCKETS)
        for i, t in total.items():
            for k in range(len(GRAMS)):
                b = np.flatnonzero(t[k])
                yield pa.record_batch({"lang": pa.array(np.full(len(b), i, np.int32)), "size": pa.array(np.full(len(b), k, np.int32)), "bucket": pa.array(b.astype(np.int32)), "n": pa.array(t[k][b])})

    counts = some.select(text, lang).mapInArrow(tidy(count), "lang int, size int, bucket int, n long").groupBy("lang", "size", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), len(GRAMS), BUCKETS))
    got = counts.toArrow()
    table[got.column("lang").to_numpy(), got.column("size").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    code = codewords(len(languages))
    evidence = np.zeros((len(GRAMS), BUCKETS, code.shape[1] if len(languages) else 0), np.float32)
    share = (table + 0.5) / (table.sum(axis=2, keepdims=True) + 0.5 * BUCKETS)
    for b in range(evidence.shape[2]):
        plus, minus = (share[code[:, b] == s].mean(axis=0) if (code[:, b] == s).any() else np.full(share.shape[1:], 1 / BUCKETS) for s in (1, -1))
        evidence[:, :, b] = np.clip(np.log(plus) - np.log(minus), -4, 4)
    # How far a bit's mean evidence parts the languages of either side, by the training counts themselves.
    trust = np.ones(evidence.shape[2])
    for b in range(evidence.shape[2]):
        mean = (share * evidence[None, :, :, b]).sum(axis=2).mean(axis=1)
        trust[b] = max(0.05, float((mean * code[:, b]).min()))
    return Model(languages, code, evidence, trust)


def identified(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns keep of docs, lang_pred, score and ambiguous.

    A text that is null or has no letter is `und` with score 0; so is every text when no language has been learned.
    Of columns in keep that have the name of a result, the result alone is returned.
    """
    keep = unclashing(keep, ("lang_pred", "score", "ambiguous"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    flow = docs.select(F.col(text).alias("_t"), *keep)

    def make(batches):
        model = sent.value
        for batch in batches:
            names: list = []
            score, doubt = [], []
            for row, data, offsets in pieces(batch.column(0), 1 << 20):
                some = batch.column(0).slice(row, len(offsets) - 1).to_pylist()
                letters = np.array([lettered(t) for t in some])
                if model.languages:
                    m = margins(model, data, offsets)
                    best, p, close = decode(model, m, np.diff(offsets))
                else:
                    best, p, close, letters = np.zeros(len(some), int), np.zeros(len(some)), np.zeros(len(some), bool), np.zeros(len(some), bool)
                names += [model.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                score.append(np.where(letters, p, 0.0))
                doubt.append(np.where(letters, close, True))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64()), pa.array(np.concatenate(doubt) if doubt else [], pa.bool_())], names=[*keep, "lang_pred", "score", "ambiguous"])

    kinds = StructType([*flow.schema.fields[1:], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])
    return flow.mapInArrow(tidy(make), kinds)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id", 3, 1)))
    return identified(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")
