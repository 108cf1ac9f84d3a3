"""Alignment of two tokenizers' tokens of the same texts, and corpus-wide counts of the token pairs that it links.

The tokens of a document are laid out by position with their cumulative lengths in bytes; ends that both sides have are its
cuts, found by joining the two lists of ends on document and end; the number of cuts before a token is its group; tokens of
both sides in a group are linked.  These steps run on the flat columns of an Arrow batch, since a document's tokens are all in
one row and need no exchange: as exploded rows with windows and joins (``by_relations``, which tests hold against this) they
would be shuffled and sorted at several times the texts' size.  Counts of pairs are relational: a pair is counted once for each
document, and documents look their pairs up by broadcast while there are few kinds of pairs, by a shuffled join beyond.
"""

from __future__ import annotations

import sys
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_pairs import USUAL, WIDE, Coder, _spelled, coder
from .common import read, scratch, tidy, written
from .textops import pieces
from .token_index import _Words

#: Kinds of pairs up to which their counts are broadcast (24 bytes each).
BROADCAST_PAIRS = 2_000_000
#: Pairs of one group that are laid out one by one; in larger groups equal tokens are counted first.
LAID_OUT = 4096
#: A pair of ids is one number, the first id times this and the second.
_PAIR = 1 << 31


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class _Pieces:
    """Ids of chunks by a sentencepiece BPE model with byte fallback, remembered by their hashes.

    No piece goes on over a space or a line feed after another character, so that chunks which begin there are encoded as in
    the whole text.  A chunk whose pieces don't spell it (it holds the mark that stands for spaces) has the id -1.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(self.library)
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes_of])
        if any("\n" in p or "▁" in p.lstrip("▁") for p in names):
            raise ValueError("the model has pieces that go on over spaces")
        self.blank = self.library.piece_to_id("▁")
        self.known, self.long = _Words(np.dtype("<i4")), {}

    def encode(self, chunks: list[bytes]) -> list[list[int]]:
        # The library puts a space before what it gets: chunks that begin with one leave it out, others lose the piece for it.
        texts = [c[1:].decode() if c[:1] == b" " else c.decode() for c in chunks]
        out = []
        for c, t, ids in zip(chunks, texts, self.library.encode(texts, num_threads=1), strict=True):
            if c[:1] != b" ":
                ids = ids[1:] if ids[:1] == [self.blank] else [-1]
            elif not t:
                ids = [self.blank]  # a lone space, for which the library gives nothing
            out.append(ids if -1 not in ids and b"".join([self.bytes_of[i] for i in ids]) == c else [-1])
        return out

    def __call__(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of chunks in a row, numbers of them)."""
        size = end - start
        h = Coder._hashes(_spelled(np.frombuffer(raw + bytes(8), np.uint8), start, np.minimum(size, WIDE)), size)
        short, far = np.flatnonzero(size <= WIDE), np.flatnonzero(size > WIDE)
        if self.known.n > self.known.most:
            self.known.clear()
        new = short[self.known.find(h[short]) < 0]
        if len(new):
            keys, at = np.unique(h[new], return_index=True)
            at = new[at]
            found = self.encode([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            self.known.add(keys, np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found]))
        ids, m = self.known.gather(self.known.find(h[short]))
        if not len(far):
            return ids, m
        n = np.zeros(len(size), np.int64)
        n[short] = m
        held = self.encode([raw[a:b] for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)])
        n[far] = [len(x) for x in held]
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        out[_ranges(at[short], m)] = ids
        out[_ranges(at[far], n[far])] = [i for x in held for i in x]
        return out, n


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, then those from first[1] on, and so forth."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Aligner:
    """Tokens, groups and links of texts by a byte-level BPE (A) and a sentencepiece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = coder(path_a, USUAL), _Pieces(path_b)
        self.lengths = np.array([len(x) if x is not None else 0 for x in self.a.bytes_of]), self.b.lengths
        most = max(len(self.a.bytes_of), len(self.b.bytes_of))
        self.digits = np.zeros((most, len(str(most)) + 1), np.uint8)  # each id's decimal digits and room for what follows
        self.n_digits = np.array([len(str(i)) for i in range(most)])
        for i in range(most):
            self.digits[i, : self.n_digits[i]] = np.frombuffer(str(i).encode(), np.uint8)

    def _chunks(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends of chunks, how many are before each text): a chunk ends before a space or line feed after a character that is no white space."""
        codes = np.frombuffer(raw, np.uint8)
        begins = None
        if not raw.isascii():
            begins = np.append(np.flatnonzero((codes & 0xC0) != 0x80), len(raw))
            codes = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        inner = np.flatnonzero(((codes[1:] == 32) | (codes[1:] == 10)) & (self.a.kinds[codes[:-1]] != 3)) + 1
        at = np.unique(np.concatenate([inner if begins is None else begins[inner], offsets[1:][offsets[1:] > 0]]))
        return at, np.searchsorted(at, offsets, "right") * (offsets > 0)

    def tokens(self, raw: bytes, offsets: np.ndarray) -> tuple[tuple, tuple, np.ndarray]:
        """(ids and counts of A, of B, whether each text is spelled by its tokens) of texts in a row, each with a space before it."""
        a, n_a = self.a(raw, offsets)
        ends, before = self._chunks(raw, offsets)
        b, n = self.b(raw, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
        total = np.concatenate([[0], np.cumsum(n)])[before]
        wrong = np.concatenate([[0], np.cumsum(b < 0)])[total]
        return (a, n_a), (b, np.diff(total)), wrong[1:] == wrong[:-1]

    def __call__(self, texts: list[bytes]) -> dict:
        """Columns for texts: n_a, n_b, n_groups, n_links, groups (bytes) and, in a row, their pairs (text, a * 2 ** 31 + b, links)."""
        good = np.array([len(t) > 0 for t in texts], bool)
        spaced = [b" " + t for t in texts]
        sizes = np.array([len(t) for t in spaced]) * good
        raw, offsets = b"".join(t for t, g in zip(spaced, good, strict=True) if g), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        (a, n_a), (b, n_b), spelled = self.tokens(raw, offsets)
        good &= spelled
        if not good.all():  # texts without tokens are as if they weren't there
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b, sizes = n_a * good, n_b * good, sizes * good
        return {"n_a": n_a, "n_b": n_b, **self._linked(a, b, n_a, n_b, sizes)}

    def _linked(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, sizes: np.ndarray) -> dict:
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        marks = np.zeros(int(sizes.sum()) + 1, np.uint8)
        marks[end_a] = 1
        marks[end_b] += 2
        cut_a, cut_b = marks[end_a] == 3, marks[end_b] == 3
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        groups = int(cut_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        text_of = np.repeat(np.arange(len(n_a)), n_a)[cut_a]  # a group's text
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        text, pair, links = self._pairs(a, b, in_a, in_b, first_a, first_b, text_of)
        n_links = np.bincount(text_of, in_a * in_b, len(n_a)).astype(np.int64)
        return {"n_groups": np.bincount(text_of, minlength=len(n_a)), "n_links": n_links, "groups": self._written(a, b, group_a, group_b, in_a, in_b, cut_a, cut_b, n_a, n_b), "text": text, "pair": pair, "links": links}

    def _pairs(self, a, b, in_a, in_b, first_a, first_b, text_of):
        """Distinct pairs of each text, in its order, with their numbers of links."""
        small = in_a * in_b <= LAID_OUT
        p, q = in_a[small], in_b[small]
        each = np.repeat(np.arange(len(p)), p * q)
        k = np.arange(len(each)) - np.repeat(np.cumsum(p * q) - p * q, p * q)
        left, right = a[first_a[small][each] + k // q[each]], b[first_b[small][each] + k % q[each]]
        text, pair, links = [text_of[small][each]], [left.astype(np.int64) * _PAIR + right], [np.ones(len(each), np.int64)]
        for g in np.flatnonzero(~small).tolist():  # no cut for long: every pair of distinct ids, by their numbers
            x, n_x = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            y, n_y = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            text.append(np.full(len(x) * len(y), text_of[g]))
            pair.append((x.astype(np.int64)[:, None] * _PAIR + y).ravel())
            links.append((n_x[:, None] * n_y).ravel())
        text, pair, links = np.concatenate(text), np.concatenate(pair), np.concatenate(links)
        order = np.lexsort((pair, text))
        text, pair, links = text[order], pair[order], links[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        return text[at], pair[at], np.add.reduceat(links, at) if len(at) else links

    def _written(self, a, b, group_a, group_b, in_a, in_b, cut_a, cut_b, n_a, n_b) -> list[bytes]:
        """Each text's groups as text: ids of A by commas, a bar, ids of B, and a semicolon between groups."""
        place = np.empty(len(a) + len(b), np.int64)
        spot_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        spot_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        place[spot_a], place[spot_b] = a, b
        mark = np.full(len(place), ord(","), np.uint8)
        mark[spot_a[cut_a]], mark[spot_b[cut_b]] = ord("|"), ord(";")
        n = self.n_digits[place]
        spelled = self.digits[place]
        spelled[np.arange(len(place)), n] = mark
        flat = spelled[np.arange(spelled.shape[1])[None, :] <= n[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(n + 1)])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        return [flat[x : z - 1] if z > x else b"" for x, z in zip(ends[:-1], ends[1:], strict=True)]


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker, kept on a module that all tasks of the worker see."""
    kept = sys.__dict__.setdefault("_starloom_aligners", {})
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = Aligner(path_a, path_b)
    return kept[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, n_a, n_b, n_groups, n_links, groups_sha256, and pairs and links, its distinct pairs of ids
    (a * 2 ** 31 + b) with how often they are linked.

    Texts that are null or empty, or that the tokens don't spell, have no tokens.  Repeated rows stay; an empty table stays
    empty; other columns aren't read.
    """

    def align(batches):
        own = aligner(path_a, path_b)
        for batch in batches:
            for row, data, offsets in pieces(batch.column(1), 1 << 20):
                raw = data.tobytes()
                found = own([raw[x:z] for x, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                n = len(offsets) - 1
                at = pa.array(np.searchsorted(found["text"], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(found[c])) for c in ("pair", "links")]
                digests = [sha256(g).hexdigest() if g else "" for g in found["groups"]]
                counts = [pa.array(found[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.record_batch([batch.column(0).slice(row, n), *counts, pa.array(digests, pa.string()), *lists], names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(align), f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>").withColumnRenamed("key", key)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows of aligned each pair of ids is linked, and whether that is the most for its A id."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = written(counts, "pairs", True)
    most = counts.groupBy(F.expr(f"pair div {_PAIR}").alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.expr(f"pair div {_PAIR}")).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, most_broadcast: int | None = None) -> DataFrame:
    """Adds n_best (links whose pair is linked in the most documents for its A id) and count_sum (documents of each link's pair)."""
    with scratch() as keep:
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned")
        counts = written(pair_counts(rows), "counts", True)
        keep(rows, counts)
    small = counts.count() <= (BROADCAST_PAIRS if most_broadcast is None else most_broadcast)
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("_row", "p.pairs", "p.links").withColumnRenamed("pairs", "pair")
    met = each.join(F.broadcast(counts) if small else counts.hint("merge"), "pair")
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "links").join(sums, "_row", "left").select(*[c for c in rows.columns if c not in ("_row", "pairs", "links")], *zero)


def by_relations(tokens: DataFrame) -> DataFrame:
    """The links (doc, a, b, times) of tokens (doc, side 'a' or 'b', position, id, size) by windows and joins alone."""
    ends = tokens.withColumn("end", F.sum("size").over(W.partitionBy("doc", "side").orderBy("position")))
    cuts = ends.where("side = 'a'").select("doc", "end").join(ends.where("side = 'b'").select("doc", "end"), ["doc", "end"]).withColumn("cut", F.lit(1))
    before = W.partitionBy("doc", "side").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    grouped = ends.join(cuts, ["doc", "end"], "left").withColumn("group", F.coalesce(F.sum("cut").over(before), F.lit(0)))
    side = {s: grouped.where(F.col("side") == s).groupBy("doc", "group", F.col("id").alias(s)).agg(F.count("*").alias(f"n_{s}")) for s in "ab"}
    return side["a"].join(side["b"], ["doc", "group"]).groupBy("doc", "a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("times"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_counts(aligned(read(spark, sf_dir, "documents"), *paths()))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
