"""Token ids as raw shards with a minimal perfect hash index over document keys.

Layout of a store (a folder in any file system that pyarrow.fs opens):

* ``ids/N.bin`` - shard: 32-byte header (magic ``SLTOK1\\0\\0``, documents, ids, bytes of an id), then for each
  document its key (int64), a null flag (uint64) and its number of ids (uint64), then all ids, little-endian and
  unsigned.  Shards follow one another in ascending key order, null keys first.
* ``index/NNNNNN.bin`` - one of the hash partitions of the keys: header (magic ``SLMPH1\\0\\0``, keys, buckets, seed),
  the buckets' displacements (uint32), then a table with an entry of four uint64 for each key at its hash value:
  fingerprint, shard, first id in the shard, number of ids.
* ``manifest.json`` - number of shards and index parts, and each shard's first id in the whole store.

A lookup hashes the key to an index part, to a bucket and with that bucket's displacement to an entry, compares the
fingerprint and reads one range of one shard: a constant number of steps, whatever the number of documents.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_folder, tidy, written
from .textops import SPACED, mix, pieces, words

END_ID = 1
#: Documents of a shard, and keys of an index part, aimed at; both numbers of files grow with the table.
SHARD_ROWS, PART_KEYS = 8192, 16384
#: Words whose ids a worker remembers at most, 60 bytes each or so; beyond them it begins anew.
REMEMBERED = 2_000_000
#: Bytes of ids at which a shard is closed and another begun.
SHARD_BYTES = 1 << 27
_BUCKET_KEYS, _SEEDS = 4, 1 << 20
_IDS, _MPH = b"SLTOK1\0\0", b"SLMPH1\0\0"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_TAIL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")


def _plain(word: bytes) -> bool:
    text = word.decode()
    return text.isalpha() and text.islower() and max(text) <= "\xff"


class _Words:
    """Ids of words by the words' 64-bit hashes: an open-addressed table of NumPy arrays over one array of ids."""

    def __init__(self, kind):
        self.kind, self.most = kind, REMEMBERED
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.hash, self.begin, self.size = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 12, self.kind)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it isn't known."""
        mask = np.int64(len(self.hash) - 1)
        at = (h >> np.uint64(40)).astype(np.int64) & mask
        found = self.hash[at]
        out = np.where(found == h, at, -1)
        left = np.flatnonzero((found != h) & (found != 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            found = self.hash[at[left]]
            same = found == h[left]
            out[left[same]] = at[left[same]]
            left = left[~same & (found != 0)]
        return out

    def _place(self, h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        mask = np.int64(len(self.hash) - 1)
        at = (h >> np.uint64(40)).astype(np.int64) & mask
        left = np.arange(len(h))
        while len(left):
            free = left[self.hash[at[left]] == 0]
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.hash[at[won]], self.begin[at[won]], self.size[at[won]] = h[won], begin[won], size[won]
            left = left[self.hash[at[left]] != h[left]]
            at[left] = (at[left] + 1) & mask

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Adds distinct hashes that aren't known yet, whose ids stand in a row."""
        room = len(self.hash)
        while 2 * (self.n + len(h)) > room:
            room *= 2
        if room > len(self.hash):
            old = self.hash != 0
            rows = self.hash[old], self.begin[old], self.size[old]
            self.hash, self.begin, self.size = np.zeros(room, np.uint64), np.zeros(room, np.int64), np.zeros(room, np.int32)
            self._place(*rows)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), self.used), self.kind)])
        self.ids[self.used : self.used + len(ids)] = ids
        self._place(h, self.used + np.cumsum(size) - size, size.astype(np.int32))
        self.n, self.used = self.n + len(h), self.used + len(ids)

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in these slots in a row, and how many each has."""
        size = self.size[slot].astype(np.int64)
        return self.ids[np.repeat(self.begin[slot] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


class _Encoder:
    """Encodes texts word by word, remembering words.

    The tokenizer never joins characters over ASCII white space (its pre-tokenizer drops it) and lower-cases, so a text's
    ids are its lower-cased words' ids in a row.  Words new to a worker go through the library many at a time, with a
    special token between them that tells where each ends.  Texts that may spell a special token go through it whole.
    Two words count as equal if their 64-bit hashes are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = next(iter(special.items()))
        self.opening = {t[:2].encode() for t in special}
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = _Words(self.kind)
        # For lower-case letters below U+0100, which the normalizer leaves alone and the pre-tokenizer keeps together.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, self.kind)

    def _ask(self, library, some: list[bytes], step: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row and how many each has, by the library."""
        mark = f" {self.mark} "
        found = library.encode_batch_fast([mark.join([w.decode() for w in some[at : at + step]]) for at in range(0, len(some), step)], add_special_tokens=False)
        raw = [np.array(x, self.kind) for e in found for x in (e.ids, [self.mark_id])]
        raw = np.concatenate(raw) if raw else np.zeros(0, self.kind)
        marks = np.flatnonzero(raw == self.mark_id)
        return np.delete(raw, marks), np.diff(marks, prepend=-1) - 1

    def _ensure(self, some: list[bytes], library, step: int) -> np.ndarray:
        """Hashes of words (A-Z lower-cased already), which are all known from now on."""
        joined = np.frombuffer(b" ".join(some), np.uint8)
        h = words(joined, np.array([0, len(joined)]), SPACED)[0]
        missing = np.flatnonzero(self.known.find(h) < 0)
        new, at = np.unique(h[missing], return_index=True)
        if len(new):
            self.known.add(new, *self._ask(library, [some[i] for i in missing[at].tolist()], step))
        return h

    def learn(self, h: np.ndarray, new: list[bytes]) -> None:
        """Remembers new words: letters with punctuation after them (no apostrophe, which joins letters) as these two parts."""
        at, cores, tails, rest = [], [], [], []
        for i, w in enumerate(new):
            core = w.rstrip(_TAIL)
            if core and len(core) < len(w) and (core.isalpha() or _plain(core)):
                at.append(i)
                cores.append(core)
                tails.append(w[len(core) :])
            else:
                rest.append(i)
        letters = [i for i in rest if new[i].isalpha() or _plain(new[i])]
        rest = sorted(set(rest).difference(letters))
        for some, library, step in ((letters, self.letters, 50), (rest, self.library, 20)):
            if some:
                self.known.add(h[some], *self._ask(library, [new[i] for i in some], step))
        if at:
            parts = np.stack([self._ensure(cores, self.letters, 50), self._ensure(tails, self.library, 20)], axis=1)
            ids, size = self.known.gather(self.known.find(parts.ravel()))
            self.known.add(h[at], ids, size.reshape(-1, 2).sum(axis=1))

    def lookup(self, h: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slots of words, given by hash and place."""
        if self.known.n > self.known.most:
            self.known.clear()
        slot = self.known.find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            at = missing[at]
            self.learn(new, [raw[a:b].lower() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            slot = self.known.find(h)
        return slot

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of a run of texts, each with the end id after it (in parts), and how many of them each text has."""
        raw = data.tobytes()
        if any(o in raw for o in self.opening):
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            if len(texts) > 1:  # text by text, as only some need be taken whole
                each = [self(np.frombuffer(t, np.uint8), np.array([0, len(t)]), end_id) for t in texts]
                return [p for parts, _ in each for p in parts], np.concatenate([n for _, n in each])
            ids = np.append(self.whole(raw), self.kind.type(end_id))
            return [ids], np.array([len(ids)])
        h, start, end, first = words(data, offsets, SPACED)
        parts, sizes = [], []
        for lo in range(0, len(h) + 1, 1 << 17):
            hi = min(lo + (1 << 17), len(h))
            ids, size = self.known.gather(self.lookup(h[lo:hi], raw, start[lo:hi], end[lo:hi]))
            parts.append(ids)
            sizes.append(size)
        ids, total = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return [np.insert(ids, total[first[1:]], self.kind.type(end_id))], np.diff(total[first]) + 1


def _encoder(path: str) -> _Encoder:
    """One for each Python worker, kept on a module that all tasks of the worker see."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    kept = sys.__dict__.setdefault("_starloom_encoders", {})
    if path not in kept:
        kept[path] = _Encoder(path)
    return kept[path]


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, parts: list[bytes]) -> None:
    """Writes a file under another name and renames it, so that tasks may run twice and readers see whole files only."""
    system, root = _fs(uri)
    folder, _, _ = f"{root}/{name}".rpartition("/")
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        for p in parts:
            f.write(p)
    try:
        system.move(draft, f"{root}/{name}")
    except OSError:  # where a move doesn't replace, an earlier run of this task has the same file in place
        if not system.get_file_info(f"{root}/{name}").is_file:
            raise
        system.delete_file(draft)


def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and fingerprint of int64 keys: two independent 64-bit hashes."""
    k = keys.astype(np.int64).view(np.uint64)
    return mix(k ^ np.uint64(0xD1B54A32D192ED03)), mix(mix(k + np.uint64(0x8CB92BA72F3D8DD7)))


def _slots(place: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return mix(place + displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)


def build_hash(place: np.ndarray) -> np.ndarray:
    """Displacements that send each of the distinct hashes to a place of its own among len(place): hash, displace, fullest buckets first."""
    n = len(place)
    m = max(1, -(-n // _BUCKET_KEYS))
    bucket = ((place >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    start = np.concatenate([[0], np.cumsum(sizes)])
    taken, out = np.zeros(n, bool), np.zeros(m, np.uint32)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        own = place[order[start[b] : start[b + 1]]]
        for lo in range(0, _SEEDS, 256):
            d = np.arange(lo, lo + 256, dtype=np.uint64)
            s = _slots(own[None, :], d[:, None], n).astype(np.int64)
            good = ~taken[s].any(axis=1)
            if len(own) > 1:
                t = np.sort(s, axis=1)
                good &= (t[:, 1:] != t[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                taken[s[k]] = True
                out[b] = lo + k
                break
        else:
            raise ValueError("no displacement found")
    return out


def write_store(docs: DataFrame, uri: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> tuple[dict, DataFrame]:
    """Encodes docs and writes a store at uri; returns its manifest and its documents (k, shard, first, n, indexed).

    Null texts count as empty.  Rows that repeat a key stay in a row (ties fall by the text's hash); the index then leads
    to the first of them.  Rows without a key come first and are not in the index.  An empty table gives an empty store.
    A shard is closed at so many documents or SHARD_BYTES of ids, but never within a document.  Only one summary row for
    each shard comes to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = rows.count()
    tasks = max(1, -(-n // SHARD_ROWS), min(n, spark.sparkContext.defaultParallelism))
    ordered = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(tasks, F.col("k").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("h"))

    def put(batches):
        from pyspark import TaskContext

        task, encode, shard = TaskContext.get().partitionId(), _encoder(tokenizer), 0
        for keys, nulls, length, ids in _filled(batches, encode, end_id):
            number = (task << 20) + shard  # a task closes few shards
            head = np.stack([keys.view(np.uint64), nulls.astype(np.uint64), length.astype(np.uint64)], axis=1)
            _put(uri, f"ids/{number}.bin", [_IDS, np.array([len(length), int(length.sum()), encode.kind.itemsize], "<u8").tobytes(), head.astype("<u8").tobytes(), *ids])
            yield pa.record_batch({"k": pa.array(keys, mask=nulls), "shard": pa.array(np.full(len(length), number), pa.int64()), "first": pa.array(np.cumsum(length) - length), "n": pa.array(length)})
            shard += 1

    entries = written(ordered.select("k", "t").mapInArrow(tidy(put), "k long, shard long, first long, n long"), "entries")
    sizes = {r["shard"]: r["n"] for r in entries.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    parts = max(1, -(-n // PART_KEYS))
    first = entries.where("k is not null").groupBy("k").agg(F.min(F.struct("shard", "first", "n")).alias("e")).select("k", "e.*")

    def index(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        k = t.column("k").to_numpy()
        place, fingerprint = _hashes(k)
        part = place % np.uint64(parts)
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            inner = mix(place[mine])
            move = build_hash(inner)
            slot = _slots(inner, move[((inner >> np.uint64(32)) % np.uint64(len(move))).astype(np.int64)], len(mine)).astype(np.int64)
            table = np.zeros((len(mine), 4), "<u8")
            table[slot] = np.stack([fingerprint[mine], *(t.column(c).to_numpy()[mine].astype(np.uint64) for c in ("shard", "first", "n"))], axis=1)
            _put(uri, f"index/{int(p):06d}.bin", [_MPH, np.array([len(mine), len(move)], "<u8").tobytes(), move.astype("<u4").tobytes(), table.tobytes()])
            yield pa.record_batch({"keys": pa.array([len(mine)], pa.int64())})

    # A part's number is computed here as in _hashes, so that a part's keys meet in one task; there are PART_KEYS of them at most, roughly.
    def parted(batches):
        for b in batches:
            place = _hashes(b.column("k").to_numpy())[0] % np.uint64(parts)
            yield pa.record_batch([*b.columns, pa.array(place.astype(np.int64))], names=[*b.schema.names, "part"])

    flat = written(first.mapInArrow(parted, "k long, shard long, first long, n long, part long"), "keys", True)
    keys = flat.repartition(parts, "part").select("k", "shard", "first", "n").mapInArrow(index, "keys long").agg(F.sum("keys")).head()[0]
    starts, total = {}, 0
    for s in sorted(sizes):
        starts[s] = total
        total += sizes[s]
    manifest = {"shards": [[s, starts[s]] for s in sorted(sizes)], "parts": parts, "rows": n, "keys": keys or 0, "ids": total}
    _put(uri, "manifest.json", [json.dumps(manifest).encode()])
    rest = entries.join(flat.select("k", "shard", "first"), ["k", "shard", "first"], "left_anti").select("k", "shard", "first", "n")
    return manifest, flat.select("k", "part").withColumn("indexed", F.lit(True)).unionByName(rest.withColumn("indexed", F.lit(False)), allowMissingColumns=True)


def _filled(batches, encode, end_id: int):
    """(keys, null flags, numbers of ids, ids) of each shard's documents."""
    keys, nulls, lengths, ids, held = [], [], [], [], 0
    for batch in batches:
        k, is_null = batch.column(0).fill_null(0).to_numpy().astype(np.int64), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        for row, data, offsets in pieces(batch.column(1), 1 << 22):
            parts, n = encode(data, offsets, end_id)
            ids += parts
            lengths.append(n.astype(np.int64))
            keys.append(k[row : row + len(n)])
            nulls.append(is_null[row : row + len(n)])
            held += sum(p.nbytes for p in parts)
            if held >= SHARD_BYTES:
                yield np.concatenate(keys), np.concatenate(nulls), np.concatenate(lengths), ids
                keys, nulls, lengths, ids, held = [], [], [], [], 0
    if lengths:
        yield np.concatenate(keys), np.concatenate(nulls), np.concatenate(lengths), ids


def _looked_up(file, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries of keys in an open index part, whether the fingerprint is theirs)."""
    if file.read(8) != _MPH:
        raise ValueError("an index part is not in this format")
    n, m = np.frombuffer(file.read(16), "<u8").tolist()
    move = np.frombuffer(file.read(4 * m), "<u4")
    table = np.frombuffer(file.read(32 * n), "<u8").reshape(n, 4)
    place, fingerprint = _hashes(keys)
    inner = mix(place)
    slot = _slots(inner, move[((inner >> np.uint64(32)) % np.uint64(m)).astype(np.int64)], n).astype(np.int64)
    return table[slot, 1:].astype(np.int64), table[slot, 0] == fingerprint


def read_store(spark: SparkSession, uri: str, manifest: dict, wanted: DataFrame) -> DataFrame:
    """One row per document of wanted, from the files: doc_id, start (ids before it in the store), n_tokens, ids_crc32.

    A row of wanted names a key and its index part, which tells where the ids are; a row that isn't indexed (a null key,
    or a repeat of one) tells it itself.  Index parts and shards are read once each, by the tasks that their rows meet in.
    """

    def look_up(batches):
        system, root = _fs(uri)
        for batch in batches:
            key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(part):
                k = key[part == p]
                with system.open_input_file(f"{root}/index/{p:06d}.bin") as f:
                    entry, good = _looked_up(f, k)
                if not good.all():
                    raise ValueError(f"index part {p} lacks keys of the store")
                yield pa.record_batch({"k": pa.array(k), **{c: pa.array(entry[:, i].copy()) for i, c in enumerate(("shard", "first", "n"))}})

    def load(batches):
        system, root = _fs(uri)
        file, open_, head, size = None, None, None, 0
        for batch in batches:
            shards, firsts, lengths = (batch.column(i).to_numpy() for i in (1, 2, 3))
            crc = []
            for shard, first, n in zip(shards.tolist(), firsts.tolist(), lengths.tolist(), strict=True):
                if shard != open_:
                    if file is not None:
                        file.close()
                    file, open_ = system.open_input_stream(f"{root}/ids/{shard}.bin"), shard
                    if file.read(8) != _IDS:
                        raise ValueError(f"shard {shard} is not in this format")
                    docs, _, size = np.frombuffer(file.read(24), "<u8").tolist()
                    file.read(24 * docs)
                    head = 0
                while head < first:  # rows come in the order of the shard, and most of it is wanted
                    head += len(file.read(size * min(first - head, 1 << 20))) // size or _cut(shard)
                raw = file.read(size * n)
                if len(raw) != size * n:
                    _cut(shard)
                head += n
                crc.append(zlib.crc32(np.frombuffer(raw, f"<u{size}").astype("<u4")))
            yield pa.record_batch({"doc_id": batch.column(0), "shard": batch.column(1), "first": batch.column(2), "n_tokens": batch.column(3), "ids_crc32": pa.array(crc, pa.int64())})
        if file is not None:
            file.close()

    sought = wanted.where("indexed").select("k", "part").repartition(max(1, manifest["parts"]), "part").sortWithinPartitions("part").mapInArrow(look_up, "k long, shard long, first long, n long")
    every = sought.union(wanted.where("not indexed").select("k", "shard", "first", "n"))
    shards = spark.createDataFrame(manifest["shards"] or [], "shard long, base long")
    read = every.repartition(max(1, len(manifest["shards"])), "shard").sortWithinPartitions("shard", "first").mapInArrow(tidy(load), "doc_id long, shard long, first long, n_tokens long, ids_crc32 long")
    return read.join(shards, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def _cut(shard: int) -> int:
    raise ValueError(f"shard {shard} is cut short")


class Store:
    """Keyed access to a store: store[key] gives the ids of the document (an array of uint32), KeyError if there is none."""

    def __init__(self, uri: str):
        self.system, self.root = _fs(uri)
        self.manifest = json.loads(self._read("manifest.json", 0, None))

    def _read(self, name: str, at: int, n: int | None) -> bytes:
        with self.system.open_input_file(f"{self.root}/{name}") as f:
            f.seek(at)
            return f.read(n) if n is not None else f.read()

    def __getitem__(self, key: int) -> np.ndarray:
        place, fingerprint = _hashes(np.array([key], np.int64))
        name = f"index/{int(place[0] % np.uint64(self.manifest['parts'])):06d}.bin"
        try:
            n, m = np.frombuffer(self._read(name, 8, 16), "<u8").tolist()
        except FileNotFoundError:
            raise KeyError(key) from None
        inner = mix(place)
        b = int((inner[0] >> np.uint64(32)) % np.uint64(m))
        move = np.frombuffer(self._read(name, 24 + 4 * b, 4), "<u4")
        slot = int(_slots(inner, move, n)[0])
        mark, shard, first, length = np.frombuffer(self._read(name, 24 + 4 * m + 32 * slot, 32), "<u8").tolist()
        if mark != int(fingerprint[0]):
            raise KeyError(key)
        path = f"ids/{shard}.bin"
        docs, _, size = np.frombuffer(self._read(path, 8, 24), "<u8").tolist()
        return np.frombuffer(self._read(path, 32 + 24 * docs + size * first, size * length), f"<u{size}").astype(np.uint32)


def token_index(docs: DataFrame, tokenizer: str | None = None, uri: str | None = None) -> tuple[DataFrame, str]:
    """Writes docs (doc_id, text) as a store and reads it back; (one row per document, the store's URI)."""
    spark = docs.sparkSession
    uri = uri or shared_folder(spark, "tokens")
    manifest, wanted = write_store(docs, uri, tokenizer or tokenizer_path())
    return read_store(spark, uri, manifest, wanted), uri


def op4_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(read(spark, sf_dir, "documents"))[0]
