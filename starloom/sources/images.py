"""FITS images: plain and tile-compressed planes by ranges of rows, and files of several planes.

By the published standard (version 4, chapters 4, 5 and 10).  Tiles are Rice- or gzip-coded, of integers or of quantised
floats with or without dither.  Rice tiles of one size are decoded in step, a pixel of all of them at a time, so that NumPy
works on columns of tiles and no Python code runs for each pixel.

``spark.read.format("fits-image")`` gives a row (file, plane, y, width, values) for each row of each plane of the files at
path; ``spark.write.format("fits-planes")`` writes a file for each row.
"""

from __future__ import annotations

import gzip
import io
import os
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .fits import BLOCK, CARD, _padded, _size, header

#: Bytes of files that a task reads, about (tiles are never split), and how many files at most.
SHARE, FILES = 1 << 25, 64
#: Rows of the sink, a file each, that a task of save holds at a time.
AT_ONCE = 16
#: Fixed values of the standard: by bytes of a pixel, bits of a block's code, its largest value, bits of a raw difference.
RICE = {1: (3, 6, 8), 2: (4, 14, 16), 4: (5, 25, 32)}
#: Fixed values of the standard: pixel types by BITPIX, and what marks a null in quantised floats and an exact zero in dithered ones.
PIXELS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
NULL, ZERO = -2147483647, -2147483646


def opened(uri: str):
    """A file for reading, seekable, in any file system that Arrow opens; a plain path or file: is local."""
    if re.match(r"^(?!file:)[a-z][a-z0-9+.-]*:", uri):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        f = system.open_input_file(path)
        return io.BufferedReader(gzip.GzipFile(fileobj=f)) if uri.endswith(".gz") else f
    path = re.sub(r"^file:(//)?", "", uri)
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


# --- Rice coding


def rice_encode(tiles: np.ndarray, block: int = 32) -> list[bytes]:
    """Code of each row of integers (int8-, int16- or int32-sized), block by block."""
    size = tiles.dtype.itemsize
    code_bits, most, raw_bits = RICE[size]
    v = tiles.astype(np.int64)
    diff = np.diff(v, axis=1, prepend=v[:, :1])
    span = 1 << raw_bits
    diff = (diff + span // 2) % span - span // 2  # differences wrap as the pixels do
    folded = np.where(diff < 0, -2 * diff - 1, 2 * diff)
    out = []
    for first, row in zip(v[:, 0] % span, folded, strict=True):
        bits = [_bits(np.array([first]), raw_bits)]
        for at in range(0, len(row), block):
            d = row[at : at + block]
            if not d.any():
                bits.append(np.zeros(code_bits, np.uint8))
                continue
            mean = (float(d.sum()) - len(d) / 2 - 1) / len(d)
            k = min(max(int(np.log2(max(mean, 1.0))), 0), most)
            if k >= most:
                bits += [_bits(np.array([most + 1]), code_bits), _bits(d, raw_bits)]
                continue
            high = d >> k
            length = high + 1 + k
            end = np.cumsum(length)
            chunk = np.zeros(int(end[-1]), np.uint8)
            one = end - k - 1
            chunk[one] = 1
            for j in range(k):
                chunk[one + 1 + j] = (d >> (k - 1 - j)) & 1
            bits += [_bits(np.array([k + 1]), code_bits), chunk]
        out.append(np.packbits(np.concatenate(bits)).tobytes())
    return out


def _bits(values: np.ndarray, n: int) -> np.ndarray:
    return ((values[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).ravel()


class _Streams:
    """Bit streams that are read in step."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b"".join(p + bytes(16) for p in parts), np.uint8)
        sizes = np.array([len(p) + 16 for p in parts], np.int64)
        self.at = (np.cumsum(sizes) - sizes) * 8
        self.last = (len(self.data) - 9) * 8
        self.words = np.ndarray((len(self.data) - 7,), ">u8", self.data, strides=(1,))

    def window(self, which) -> np.ndarray:
        """The next 56 bits at least, at the top of 64."""
        at = np.minimum(self.at[which], self.last)
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, which, n: int) -> np.ndarray:
        out = (self.window(which) >> np.uint64(64 - n)).astype(np.int64)
        self.at[which] += n
        return out

    def zeros(self, which: np.ndarray) -> np.ndarray:
        """Zeros up to the next one, which is read too."""
        out = np.zeros(len(which), np.int64)
        left = np.arange(len(which))
        while len(left):
            top = (self.window(which[left]) >> np.uint64(32)).astype(np.float64)
            n = np.where(top > 0, 32 - np.frexp(top)[1], 32)
            out[left] += n
            self.at[which[left]] += n + (top > 0)
            left = left[(top == 0) & (self.at[which[left]] < self.last)]
        return out


def rice_decode(parts: list[bytes], n: int, size: int, block: int = 32) -> np.ndarray:
    """len(parts) x n integers of so many bytes from their Rice codes, all decoded in step."""
    code_bits, most, raw_bits = RICE[size]
    if not parts:
        return np.zeros((0, n), np.int64)
    s, every = _Streams(parts), np.arange(len(parts))
    out = np.zeros((len(parts), n), np.int64)
    value = s.take(every, raw_bits)
    for at in range(0, n, block):
        k = s.take(every, code_bits) - 1
        raw, coded = np.flatnonzero(k == most), np.flatnonzero((k >= 0) & (k < most))
        low, own = k[coded], k[coded].astype(np.uint64)
        for x in range(at, min(at + block, n)):
            d = np.zeros(len(parts), np.int64)
            if len(coded):
                d[coded] = s.zeros(coded) << low
                bits = s.window(coded)
                d[coded] |= np.where(low > 0, bits >> (np.uint64(64) - np.maximum(own, np.uint64(1))), np.uint64(0)).astype(np.int64)
                s.at[coded] += low
            if len(raw):
                d[raw] = s.take(raw, raw_bits)
            value = value + np.where(d & 1, ~(d >> 1), d >> 1)
            out[:, x] = value
    half = 1 << (raw_bits - 1)
    return out % (1 << raw_bits) if size == 1 else (out + half) % (1 << raw_bits) - half


# --- dither of quantised floats


def _randoms() -> np.ndarray:
    """The standard's 10,000 numbers of a linear congruential generator."""
    out, seed = np.zeros(10000), 1.0
    for i in range(10000):
        seed = (16807.0 * seed) % 2147483647.0
        out[i] = seed / 2147483647.0
    return out


_RANDOM: list[np.ndarray] = []


def dither(tile: int, n: int, start: int) -> np.ndarray:
    """Random numbers of a tile's pixels; tiles count from 0, start is ZDITHER0."""
    if not _RANDOM:
        _RANDOM.append(_randoms())
    r = _RANDOM[0]
    row = (tile + start - 1) % 10000
    at = int(r[row] * 500)
    out = np.empty(n)
    done = 0
    while done < n:
        m = min(n - done, 10000 - at)
        out[done : done + m] = r[at : at + m]
        done += m
        row = (row + 1) % 10000
        at = int(r[row] * 500)
    return out


# --- files


@dataclass
class Plane:
    """An image of a file: its name and header, where its data begins, its shape and the rows of a tile."""

    name: str
    header: dict
    at: int
    width: int
    height: int
    tile_rows: int


def planes(f) -> list[Plane]:
    """The images of an open file, compressed or not, by EXTNAME or their number; those of three axes as planes name:0, name:1, ..."""
    out, number = [], 0
    while (h := header(f)) is not None:
        at = f.tell()
        packed = h.get("ZIMAGE") == "T"
        axes = "ZNAXIS" if packed else "NAXIS"
        image = packed or h.get("XTENSION", "IMAGE") == "IMAGE"
        name, n_axes = h.get("EXTNAME", str(number)), int(h.get(axes, 0))
        if image and n_axes == 2:
            w, n = int(h[f"{axes}1"]), int(h[f"{axes}2"])
            if packed and int(h.get("ZTILE1", w)) != w:
                raise ValueError("tiles must be as wide as their image")
            out.append(Plane(name, h, at, w, n, int(h.get("ZTILE2", 1)) if packed else 1))
        elif image and n_axes == 3 and not packed:  # each of its planes, by number
            w, n = int(h["NAXIS1"]), int(h["NAXIS2"])
            size = w * n * abs(int(h["BITPIX"])) // 8
            out += [Plane(f"{name}:{k}", h, at + k * size, w, n, 1) for k in range(int(h["NAXIS3"]))]
        number += 1
        f.seek(_padded(_size(h)), 1)
    return out


def rows(f, plane: Plane, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Rows lo to hi of a plane; only their bytes, or the tiles that hold them, are read."""
    h, w = plane.header, plane.width
    hi = min(plane.height, plane.height if hi is None else hi)
    if hi <= lo:
        return np.zeros((0, w))
    if h.get("ZIMAGE") != "T":
        kind = np.dtype(PIXELS[int(h["BITPIX"])])
        f.seek(plane.at + lo * w * kind.itemsize)
        return _scaled(np.frombuffer(f.read((hi - lo) * w * kind.itemsize), kind).reshape(-1, w), h)
    t = plane.tile_rows
    first, last = lo // t, -(-hi // t)
    got = np.concatenate(_tiles(f, plane, first, last))
    return _scaled(got[lo - first * t : hi - first * t], h)


def _scaled(v: np.ndarray, h: dict) -> np.ndarray:
    scale, zero = float(h.get("BSCALE", 1)), float(h.get("BZERO", 0))
    if scale != 1 or zero != 0:
        return v * scale + zero
    return v.astype(v.dtype.newbyteorder("="))


def _columns(h: dict) -> tuple[np.dtype, dict]:
    """Row type of the table of tiles: descriptors of its variable columns, and fixed ones."""
    fields = []
    for k in range(1, int(h["TFIELDS"]) + 1):
        form = h[f"TFORM{k}"]
        m = re.match(r"(\d*)([PQ]?)([A-Z])", form)
        wide = {"P": (">i4", (2,)), "Q": (">i8", (2,))}.get(m[2])
        fields.append((h[f"TTYPE{k}"], *(wide or ({"D": ">f8", "E": ">f4", "J": ">i4", "I": ">i2", "B": "u1"}[m[3]],))))
    return np.dtype(fields), {n[0]: h[f"TFORM{i + 1}"] for i, n in enumerate(fields)}


def _tiles(f, plane: Plane, first: int, last: int) -> list[np.ndarray]:
    """Decoded tiles (rows x width) first to last of a compressed plane."""
    h, w = plane.header, plane.width
    kind, _ = _columns(h)
    f.seek(plane.at + first * kind.itemsize)
    table = np.frombuffer(f.read((last - first) * kind.itemsize), kind)
    heap = plane.at + int(h.get("THEAP", int(h["NAXIS1"]) * int(h["NAXIS2"])))
    bitpix, method = int(h["ZBITPIX"]), h["ZCMPTYPE"]
    params = {h[f"ZNAME{i}"]: int(h[f"ZVAL{i}"]) for i in range(1, 9) if f"ZNAME{i}" in h}
    high = [min(plane.tile_rows, plane.height - k * plane.tile_rows) for k in range(first, last)]
    out: list = [None] * len(table)

    def stored(name: str, k: int) -> bytes:
        n, at = table[name][k].tolist() if name in table.dtype.names else (0, 0)
        if not n:
            return b""
        f.seek(heap + at)
        return f.read(n)

    code = [stored("COMPRESSED_DATA", k) for k in range(len(table))]
    quantised = bitpix < 0 and ("ZSCALE" in table.dtype.names or "ZSCALE" in h)
    size = params.get("BYTEPIX", 4 if quantised else abs(bitpix) // 8)
    by_rows: dict[int, list[int]] = {}
    for k, c in enumerate(code):
        if not c:  # a tile that was kept in gzip, as its pixels are
            out[k] = np.frombuffer(zlib.decompress(stored("GZIP_COMPRESSED_DATA", k), 47), PIXELS[bitpix]).reshape(high[k], w)
        elif method in ("RICE_1", "RICE_ONE"):
            by_rows.setdefault(high[k], []).append(k)
        elif method == "GZIP_1":
            out[k] = np.frombuffer(zlib.decompress(c, 47), ">i4" if quantised else PIXELS[bitpix]).reshape(high[k], w)
        elif method == "GZIP_2":  # bytes by their place in a pixel
            item = 4 if quantised else abs(bitpix) // 8
            mixed = np.frombuffer(zlib.decompress(c, 47), np.uint8).reshape(item, -1).T
            out[k] = np.frombuffer(mixed.tobytes(), ">i4" if quantised else PIXELS[bitpix]).reshape(high[k], w)
        else:
            raise ValueError(f"tiles are packed by {method}")
    for n, ks in by_rows.items():
        for k, tile in zip(ks, rice_decode([code[k] for k in ks], n * w, size, params.get("BLOCKSIZE", 32)), strict=True):
            out[k] = tile.reshape(n, w)
    if not quantised:
        return out
    rule, start = h.get("ZQUANTIZ", "NO_DITHER"), int(h.get("ZDITHER0", 1))
    for k in range(len(out)):
        if code[k]:
            own = [float(table[c][k]) if c in table.dtype.names else float(h[c]) for c in ("ZSCALE", "ZZERO")]
            q = out[k].astype(np.int64)
            less = dither(first + k, q.size, start).reshape(q.shape) - 0.5 if rule.startswith("SUBTRACTIVE") else 0.0
            v = (q - less) * own[0] + own[1]
            if rule == "SUBTRACTIVE_DITHER_2":
                v = np.where(q == ZERO, 0.0, v)
            out[k] = np.where(q == int(h.get("ZBLANK", NULL)), np.nan, v)
        out[k] = out[k].astype(np.float32 if bitpix == -32 else np.float64)
    return out


def _card(key: str, value) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, str):
        text = f"'{value.replace(chr(39), chr(39) * 2):<8}'"
    else:
        text = f"{value!r:>20}"
    return f"{key:<8}= {text}".ljust(CARD)[:CARD].encode("ascii", "replace")


def _head(cards: list[tuple]) -> bytes:
    raw = b"".join(_card(k, v) for k, v in cards) + b"END".ljust(CARD)
    return raw + b" " * (_padded(len(raw)) - len(raw))


def _block(raw: bytes) -> bytes:
    return raw + bytes(_padded(len(raw)) - len(raw))


def image_hdu(name: str, v: np.ndarray, cards: list[tuple] = (), packed: str | None = None, primary: bool = False) -> bytes:
    """An image: plain, or (two axes, no primary one) in tiles of one row, packed by RICE_1 or GZIP_1 (floats by GZIP_1, without loss)."""
    kind = {"f": {4: -32, 8: -64}, "i": {1: 16, 2: 16, 4: 32, 8: 64}, "u": {1: 8}}[v.dtype.kind][v.dtype.itemsize]
    v = v.astype(PIXELS[kind])
    if packed is None or primary or v.ndim > 2:
        axes = [("NAXIS", v.ndim), *((f"NAXIS{k}", n) for k, n in enumerate(v.shape[::-1], 1))]
        first, counts = (("SIMPLE", True), [("EXTEND", True)]) if primary else (("XTENSION", "IMAGE"), [("PCOUNT", 0), ("GCOUNT", 1)])
        return _head([first, ("BITPIX", kind), *axes, *counts, ("EXTNAME", name), *cards]) + _block(v.tobytes())
    h, w = v.shape
    if packed == "RICE_1" and kind in (8, 16, 32):
        code = rice_encode(v)
    else:
        packed, code = "GZIP_1", [gzip.compress(row.tobytes(), mtime=0) for row in v]
    sizes = np.array([len(c) for c in code], np.int64)
    table = np.stack([sizes, np.cumsum(sizes) - sizes], axis=1).astype(">i8").tobytes()
    heap = b"".join(code)
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 16), ("NAXIS2", h), ("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", 1), ("TTYPE1", "COMPRESSED_DATA"), ("TFORM1", f"1QB({int(sizes.max(initial=0))})")]
    head += [("ZIMAGE", True), ("ZCMPTYPE", packed), ("ZBITPIX", kind), ("ZNAXIS", 2), ("ZNAXIS1", w), ("ZNAXIS2", h), ("ZTILE1", w), ("ZTILE2", 1)]
    head += [("ZNAME1", "BLOCKSIZE"), ("ZVAL1", 32), ("ZNAME2", "BYTEPIX"), ("ZVAL2", abs(kind) // 8)] if packed == "RICE_1" else []
    return _head([*head, ("EXTNAME", name), *cards]) + _block(table + heap)


def _value(text: str) -> int | float | str:
    """A card's value: a number if the text is one."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def fits_file(hdus: list[bytes], cards: list[tuple] = ()) -> bytes:
    """A file with an empty primary header (but for cards) and extensions."""
    return _head([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True), *cards]) + b"".join(hdus)


# --- Spark


@dataclass
class _Share(InputPartition):
    """What a task reads: of each file, one of so many equal shares of its rows."""

    shares: list[tuple[str, int, int]]

    def __post_init__(self):
        super().__init__(self.shares)


def _files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of the FITS files at path, which are listed and not opened."""
    kind = re.compile(r"\.fits(\.fz|\.gz)?$")
    if re.match(r"^(?!file:)[a-z][a-z0-9+.-]*:", path):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        found = system.get_file_info(root)
        scheme = path[: path.index(root)] if root in path else path.split(":")[0] + "://"
        every = [found] if found.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((scheme + i.path, i.size) for i in every if i.is_file and (found.is_file or kind.search(i.path)))
    root = re.sub(r"^file:(//)?", "", path)
    if os.path.isfile(root):
        return [(root, os.path.getsize(root))]
    return sorted((p, os.path.getsize(p)) for d, _, names in os.walk(root) for n in names if kind.search(n) for p in [os.path.join(d, n)])


class ImageReader(DataSourceReader):
    """Partitions are ranges of rows of single planes: those that the options name, or filters where they are pushed."""

    def __init__(self, options: dict):
        self.files = _files(options["path"])
        self.names: set[str] | None = set(options["planes"].split(",")) if options.get("planes") else None
        self.only: set[str] | None = None
        self.lo, self.hi = int(options.get("from", 0)), int(options["to"]) if "to" in options else None

    def partitions(self):
        out: list[_Share] = []
        held = SHARE
        for path, size in self.files:
            if self.only is not None and path not in self.only:
                continue
            n = 1 if path.endswith(".gz") else max(1, -(-size // SHARE))  # a file that is packed as a whole is read by one task
            for k in range(n):
                if held + size // n > SHARE or len(out[-1].shares) >= FILES:
                    out.append(_Share([]))
                    held = 0
                out[-1].shares.append((path, k, n))
                held += size // n
        return out or [_Share([])]

    def read(self, part):
        for path, k, n in part.shares:
            with opened(path) as f:
                for p in planes(f):
                    if self.names is not None and p.name not in self.names:
                        continue
                    t = p.tile_rows
                    lo, hi = (min(p.height, -(-p.height * i // (n * t)) * t) for i in (k, k + 1))  # shares end where tiles do
                    lo, hi = max(lo, self.lo), hi if self.hi is None else min(hi, self.hi)
                    for y, v in enumerate(rows(f, p, lo, hi).astype(np.float64).tolist() if hi > lo else (), lo):
                        yield path, p.name, y, p.width, v


class PushedImageReader(ImageReader):
    """Filters on file, plane and y leave other files out of the plan, and other planes and tiles unread."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in ("plane", "file") and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                held = self.names if column == "plane" else self.only
                wanted = wanted if held is None else held & wanted
                self.names, self.only = (wanted, self.only) if column == "plane" else (self.names, wanted)
            elif column == "y" and isinstance(f, EqualTo):
                self._between(f.value, f.value + 1)
            elif column == "y" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self._between(f.value + isinstance(f, GreaterThan), None)
            elif column == "y" and isinstance(f, (LessThan, LessThanOrEqual)):
                self._between(0, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def _between(self, lo: int, hi: int | None) -> None:
        self.lo = max(self.lo, lo)
        self.hi = hi if self.hi is None else self.hi if hi is None else min(self.hi, hi)


class FitsImages(DataSource):
    """Options: path (a file or folder), planes (names by commas), from and to (rows), pushdown (true where the session pushes
    filters into Python data sources, spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "fits-image"

    def schema(self) -> str:
        return "file string, plane string, y int, width int, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PushedImageReader if options.get("pushdown") == "true" else ImageReader)(options)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class PlanesWriter(DataSourceArrowWriter):
    """Writes a row (file, planes, cards of the first one) as a file under path.

    Tasks write beside the files under names of their own; only the commit gives files their names, one rename each, and an
    abort takes what tasks have written away.  A run again gives the same files.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.root = re.sub(r"^file:(//)?", "", options["path"])
        self.packed, self.primary, self.stage = options.get("packed"), options.get("primary") == "true", f".stage-{uuid.uuid4().hex}"

    def write(self, iterator) -> WriterCommitMessage:
        made = []
        for file, planes, cards in (row for batch in iterator for row in self._rows(batch)):
            cards = [(k.upper()[:8], _value(v)) for k, v in sorted(cards.items()) if v is not None]
            hdus = []
            for i, (name, kind, width, depth, pixels) in enumerate(planes):
                v = pixels.astype(kind)
                v = v.reshape(-1, width) if depth == 1 else v.reshape(depth, -1, width)
                hdus.append(image_hdu(name, v, cards if i == 0 else (), self.packed, primary=self.primary and i == 0))
            draft = os.path.join(self.root, self.stage, f"{uuid.uuid4().hex}.part")
            os.makedirs(os.path.dirname(draft), exist_ok=True)
            with open(draft, "wb") as f:
                f.write(b"".join(hdus) if self.primary else fits_file(hdus))
            made.append((draft, os.path.join(self.root, file)))
        return _Written(made)

    @staticmethod
    def _rows(batch):
        """(file, planes, cards) of a batch's rows, their pixels as they lie in it: no Python object is made for a pixel."""
        for i in range(batch.num_rows):
            p = batch.column("planes")[i].values
            head = (p.field(c).to_pylist() for c in ("name", "kind", "width", "depth"))
            pixels = [x.values for x in p.field("pixels")]
            planes = list(zip(*head, [x.to_numpy(zero_copy_only=False) for x in pixels], strict=True))
            if any(x.null_count and np.dtype(one[1]).kind in "iu" for x, one in zip(pixels, planes, strict=True)):
                raise ValueError(f"null pixels in a plane of integers of {batch.column('file')[i].as_py()}")
            yield batch.column("file")[i].as_py(), planes, dict(batch.column("cards")[i].as_py() or ())

    def commit(self, messages) -> None:
        for m in messages:
            for draft, path in m.files if m else []:
                os.makedirs(os.path.dirname(path), exist_ok=True)
                os.replace(draft, path)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        stage = os.path.join(self.root, self.stage)
        if os.path.isdir(stage):
            for name in os.listdir(stage):
                os.remove(os.path.join(stage, name))
            os.rmdir(stage)


class FitsPlanes(DataSource):
    """Options: path (a folder that driver and executors share), packed (RICE_1 or GZIP_1; none: plain images), primary (true: the
    first plane is the file's first image; else that is empty)."""

    @classmethod
    def name(cls) -> str:
        return "fits-planes"

    def schema(self) -> str:
        return "file string, planes array<struct<name:string,kind:string,width:int,depth:int,pixels:array<double>>>, cards map<string,string>"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PlanesWriter(dict(self.options), overwrite)


def register(spark) -> None:
    spark.dataSource.register(FitsImages)
    spark.dataSource.register(FitsPlanes)


def save(rows, path: str, **options: str) -> None:
    """rows into files under path by the sink "fits-planes", so that a task holds the planes of AT_ONCE files at a time."""
    spark, name = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    register(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(AT_ONCE, int(before)) if int(before) > 0 else AT_ONCE))
    try:
        rows.write.format("fits-planes").mode("append").option("path", path).options(**options).save()
    finally:
        spark.conf.set(name, before)


def images(spark, path: str, planes: tuple = (), lo: int = 0, hi: int | None = None):
    """(file, plane, y, width, values) of the files at path: of some planes and rows alone, by which tiles are left out unread."""
    register(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    read = spark.read.format("fits-image").option("path", path).option("from", lo).option("pushdown", pushed)
    if planes:
        read = read.option("planes", ",".join(planes))
    return (read if hi is None else read.option("to", hi)).load()
