"""Byte-level BPE over ranks: texts to ids and back.

A text falls into pre-tokens by a pattern, and each is looked up in two tiers.  A minimal perfect hash over the vocabulary
resolves a whole batch of pre-tokens that are tokens themselves; an entry holds the token's bytes, so a hit is exact.  The
others are merged by a heap of adjacent pairs over linked bytes, lowest rank first and then leftmost, and a worker remembers
their ids by 64-bit hashes of their bytes, which stand for them.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, tidy
from .textops import mix, pieces
from .token_index import _slots, _Words, build_hash

#: Bytes of pre-tokens that are hashed and compared as words of 8; longer ones, and all longer than any token, are kept by their bytes.
WIDE = 64
#: Bytes of a text that are split at a time, about.
STRETCH = 1 << 20
#: Fixed value: the pattern whose classes are looked up for a whole batch; any other is matched text by text.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_RNG = np.random.Generator(np.random.PCG64(12))
_Q = [np.uint64(int(x) | 1) for x in _RNG.integers(0, 2**64, WIDE // 8 + 1, dtype=np.uint64)]
_EDGE = re.compile(rb"[!-~](?=[ \t-\r])")
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a file of lines, each a token in base64 and its rank, or of a byte-level BPE model in JSON.

    There each byte is written as a character: the printable ones of Latin-1 as themselves, the others, in order, as those
    from U+0100 on; merges stand in the order of the ids that they give.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"] if t["special"]}
        shown = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: pairs of neighbours are merged by rank, the leftmost first among equals, as long as a pair is a token."""
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))  # a part is known by its first byte; 0 after a part that is gone
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if not j or j >= n or after[j] != end:
            continue  # one of its two parts has changed since
        after[i], after[j] = end, 0
        if end < n:
            before[end] = i
            stop = after[end]
            if (r := ranks.get(word[i:stop])) is not None:
                heappush(heap, (r, i, stop))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def _spelled(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """The bytes of spans as 64-bit words: for each word of 8 bytes, which spans reach it and what they have there.  data has 8 bytes to spare."""
    every = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out, left = [], slice(None)
    for k in range(WIDE // 8):
        if k:
            left = np.flatnonzero(size > 8 * k)
            if not len(left):
                break
        out.append((left, every[start[left] + 8 * k] & _MASKS[np.minimum(size[left] - 8 * k, 8)]))
    return out


class Coder:
    """Ids of texts and texts of ids, by the ranks of a vocabulary that has every byte."""

    def __init__(self, ranks: dict[bytes, int], split: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(split)
        self.kinds = self._kinds() if split == USUAL else None
        tokens = sorted(ranks, key=ranks.__getitem__)
        if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for {len(lacking)} bytes")
        self.ids = np.array([ranks[t] for t in tokens], np.int32)
        self.bytes_of = np.full(int(self.ids.max()) + 1, None, object)
        self.bytes_of[self.ids] = tokens
        self.known, self.long = _Words(np.dtype("<i4")), {}
        short = [i for i, t in enumerate(tokens) if len(t) <= WIDE]
        size = np.array([len(tokens[i]) for i in short])
        data = np.frombuffer(b"".join(tokens[i] for i in short) + bytes(8), np.uint8)
        start = np.cumsum(size) - size
        h = self._hashes(spelled := _spelled(data, start, size), size)
        self.move = build_hash(h)
        slot = self._slot(h)
        self.size, self.rank = np.zeros(len(short), np.int64), np.zeros(len(short), np.int32)
        self.words = np.zeros((WIDE // 8, len(short)), np.uint64)
        self.size[slot], self.rank[slot] = size, self.ids[short]
        for k, (which, w) in enumerate(spelled):
            self.words[k, slot[which]] = w

    @staticmethod
    def _hashes(spelled, size: np.ndarray) -> np.ndarray:
        h = size.astype(np.uint64) * _Q[-1]
        for k, (which, w) in enumerate(spelled):
            h[which] += mix(w * _Q[k] + np.uint64(k))
        return mix(h)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        bucket = ((h >> np.uint64(32)) % np.uint64(len(self.move))).astype(np.int64)
        return _slots(h, self.move[bucket], len(self.rank) if hasattr(self, "rank") else len(h)).astype(np.int64)

    def _kinds(self) -> np.ndarray:
        """For each code point, whether it is a letter, a number, white space or another."""
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))  # surrogates are in no text
        out = np.zeros(0x110000, np.uint8)
        for kind, what in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(what, every):
                out[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
        out[0xD800:0xE000] = _OTHER
        return out

    def ends(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the pre-tokens of texts that stand in a row end, in bytes; how many of them are before each text, and in all)."""
        data = np.frombuffer(raw, np.uint8)
        wide = not raw.isascii()
        begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw)) if wide else np.arange(len(raw) + 1)
        firsts = np.searchsorted(begins, offsets)
        if self.split.pattern != USUAL:
            sizes = [list(map(len, self.split.findall(raw[a:b].decode()))) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            stops = np.concatenate([firsts[:-1].repeat([len(x) for x in sizes]) + np.concatenate([np.cumsum(x) for x in sizes]).astype(np.int64)]) if sizes else firsts[:0]
            return begins[stops], np.concatenate([[0], np.cumsum([len(x) for x in sizes])]).astype(np.int64)
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4") if wide else data
        starts = self._starts(codes, firsts)
        at = np.flatnonzero(starts)
        return begins[np.append(at[1:], len(codes))] if len(at) else at, np.searchsorted(at, firsts)

    def _starts(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Which characters begin a pre-token: those of another kind than the one before them, but for single spaces, which
        go with what follows, and contractions."""
        n = len(codes)
        kind = self.kinds[codes]
        first = np.zeros(n + 1, bool)
        first[firsts] = True
        first[n] = True
        starts = first[:n].copy()
        starts[1:] |= kind[1:] != kind[:-1]
        after = np.flatnonzero(starts & ~first[:n] & (kind != _SPACE))
        after = after[kind[after - 1] == _SPACE]  # what follows white space: its last character stands apart, or before it if a space
        starts[after - 1] = True
        starts[after[codes[after - 1] == 32]] = False
        mark = np.flatnonzero((codes == 39) & starts)
        mark = mark[mark + 1 < n]
        mark = mark[(kind[mark + 1] == _LETTER) & ~first[mark + 1]]
        one = codes[mark + 1]
        two = np.where((mark + 2 < n) & ~first[np.minimum(mark + 2, n)], codes[np.minimum(mark + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        mark, size = mark[size > 0], size[size > 0]
        starts[mark + 1] = False
        end = mark + 1 + size
        starts[end[end < n]] = True
        return starts

    def _stretches(self, raw: bytes):
        """A long text in parts between which no pre-token is cut: white space after a character that is none begins one."""
        at = 0
        while at < len(raw):
            stop, found = at + STRETCH, None
            while stop < len(raw) and found is None:
                found = _EDGE.search(raw, stop)
                stop = found.start() + 1 if found else len(raw)
            yield raw[at : min(stop, len(raw))]
            at = stop

    def __call__(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts that stand in a row, numbers of ids of each)."""
        if len(offsets) == 2 and len(raw) > STRETCH:
            ids = np.concatenate([self._coded(part, np.array([0, len(part)]))[0] for part in self._stretches(raw)])
            return ids, np.array([len(ids)])
        return self._coded(raw, offsets)

    def _coded(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, before = self.ends(raw, offsets)
        ids, n = self.counted(raw, np.frombuffer(raw + bytes(8), np.uint8), ends)
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(total[before])

    def counted(self, raw: bytes, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them for each pre-token)."""
        start = np.concatenate([[0], ends[:-1]])
        size = ends - start
        spelled = _spelled(data, start, np.minimum(size, WIDE))
        h = self._hashes(spelled, size)
        slot = self._slot(h)
        hit = self.size[slot] == size
        for k, (which, w) in enumerate(spelled):
            hit[which] &= self.words[k, slot[which]] == w
        n = np.ones(len(size), np.int64)
        missed = np.flatnonzero(~hit)
        short = missed[size[missed] <= WIDE]
        if len(short):
            self._learn(raw, start[short], ends[short], h[short])
            ids, n[short] = self.known.gather(self.known.find(h[short]))
        far = missed[size[missed] > WIDE]
        held = [self._far(raw[a:b]) for a, b in zip(start[far].tolist(), ends[far].tolist(), strict=True)]
        n[far] = [len(x) for x in held]
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        out[at[hit]] = self.rank[slot[hit]]
        if len(short):
            m = n[short]
            out[np.repeat(at[short] - (np.cumsum(m) - m), m) + np.arange(len(ids))] = ids
        for k, x in zip(at[far].tolist(), held, strict=True):
            out[k : k + len(x)] = x
        return out, n

    def _learn(self, raw: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        if self.known.n > self.known.most:
            self.known.clear()
        new = np.flatnonzero(self.known.find(h) < 0)
        if len(new):
            keys, at = np.unique(h[new], return_index=True)
            at = new[at]
            found = [merged(raw[a:b], self.ranks) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            self.known.add(keys, np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found]))

    def _far(self, word: bytes) -> list[int]:
        """Ids of a long pre-token; a few short of very long ones are remembered."""
        if (rank := self.ranks.get(word)) is not None:
            return [rank]
        if (found := self.long.get(word)) is None:
            found = merged(word, self.ranks)
            if len(word) <= 1 << 10:
                if len(self.long) >= 1 << 16:
                    self.long.clear()
                self.long[word] = found
        return found

    def decoded(self, ids: np.ndarray) -> list[bytes]:
        """Bytes of each id."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.bytes_of)):
            raise ValueError("an id is beyond the vocabulary")
        return self.bytes_of[ids].tolist()


def coder(path: str, split: str) -> Coder:
    """One for each Python worker, kept on a module that all tasks of the worker see."""
    kept = sys.__dict__.setdefault("_starloom_coders", {})
    if (path, split) not in kept:
        kept[path, split] = Coder(read_ranks(path), split)
    return kept[path, split]


def encoded(docs: DataFrame, path: str, split: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of each whole text in place of the text (the name ids replaces a column of docs that has it).

    Null texts count as empty and have no ids; repeated rows stay; an empty table stays empty.
    """
    others = [c for c in docs.columns if c not in (text, ids)]

    def code(batches):
        own = coder(path, split)
        for b in batches:
            for row, data, offsets in pieces(b.column(text), 1 << 20):
                found, n = own(data.tobytes(), offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(found))
                yield pa.record_batch([*(b.column(c).slice(row, len(n)) for c in others), lists], names=[*others, ids])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in others)
    return docs.select(*[F.col(f"`{c}`") for c in others], text).mapInArrow(tidy(code), f"{kinds}{', ' if kinds else ''}`{ids}` array<int>")


def decoded(rows: DataFrame, path: str, split: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """rows with the bytes that their ids stand for as the column out (instead of one that has the name); null ids count as none."""
    others = [c for c in rows.columns if c != out]

    def decode(batches):
        own = coder(path, split)
        for b in batches:
            lists = b.column(ids)
            flat = lists.flatten().to_numpy()
            n = np.diff(np.asarray(lists.offsets)) * lists.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(n)])
            step = max(1, int(np.searchsorted(ends, 1 << 22)) - 1) if ends[-1] > 1 << 22 else b.num_rows
            for row in range(0, b.num_rows, step):
                found = [b"".join(own.decoded(flat[a:z])) for a, z in zip(ends[row : row + step].tolist(), ends[row + 1 : row + step + 1].tolist(), strict=False)]
                yield pa.record_batch([*(b.column(c).slice(row, len(found)) for c in others), pa.array(found, pa.binary())], names=[*others, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in others)
    return rows.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(tidy(decode), f"{kinds}, `{out}` binary")


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decoded(encoded(docs, ranks_path(), pattern()), ranks_path(), pattern())
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
