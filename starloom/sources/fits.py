"""A data source for FITS binary tables, by the published standard: 2880-byte blocks, 80-byte cards, big-endian rows."""

from __future__ import annotations

import gzip
import io
import re
import zlib

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK, CARD = 2880, 80
#: Rows of a partition, about.
ROWS = 100_000
#: Column codes of the standard.
KINDS = {"L": ("S1", "boolean"), "B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "float"), "D": (">f8", "double")}


def _open(path: str):
    path = re.sub(r"^file:(//)?", "", path)
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


def header(f) -> dict[str, str] | None:
    """Cards of the header at the file's position as text; None at the end of the file."""
    cards: dict[str, str] = {}
    while block := f.read(BLOCK):
        for at in range(0, len(block), CARD):
            card = block[at : at + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] == "= ":
                value = card[10:].strip()
                cards[key] = value[1:].split("'")[0].rstrip() if value.startswith("'") else value.split("/")[0].strip()
    return cards or None


def _padded(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def _size(h: dict[str, str]) -> int:
    n = abs(int(h.get("BITPIX", 8))) // 8 if int(h.get("NAXIS", 0)) else 0
    for k in range(1, int(h.get("NAXIS", 0)) + 1):
        n *= int(h[f"NAXIS{k}"])
    return n + int(h.get("PCOUNT", 0)) if n else 0


def table(path: str) -> tuple[int, int, np.dtype, list[tuple[str, str, int]]]:
    """(offset, rows, row type, columns as name, SQL type, repeat) of the first binary table of a file."""
    with _open(path) as f:
        while (h := header(f)) is not None:
            if h.get("XTENSION") == "BINTABLE":
                fields, columns = [], []
                for k in range(1, int(h["TFIELDS"]) + 1):
                    repeat, code = re.match(r"(\d*)([A-Z])", h[f"TFORM{k}"]).groups()
                    n = int(repeat or 1)
                    name = h.get(f"TTYPE{k}", f"col{k}")
                    if code == "A":
                        fields.append((name, f"S{n}"))
                        columns.append((name, "string", 1))
                    elif code in KINDS:
                        kind, sql = KINDS[code]
                        fields.append((name, kind) if n == 1 else (name, kind, (n,)))
                        columns.append((name, sql if n == 1 else f"array<{sql}>", n))
                    else:
                        raise ValueError(f"{path}: column {name} has the code {code}")
                return f.tell(), int(h["NAXIS2"]), np.dtype(fields), columns
            f.seek(_padded(_size(h)), 1)
    raise ValueError(f"{path} has no binary table")


def whole(path: str) -> bool:
    """Whether a file, whatever its name, is FITS (or FITS in gzip) all of whose headers end and whose blocks are all there."""
    try:
        with open(path, "rb") as f:
            packed = f.read(2) == b"\x1f\x8b"
        with gzip.open(path, "rb") if packed else open(path, "rb") as f:
            if f.read(9) != b"SIMPLE  =":
                return False
            f.seek(0)
            while block := f.read(BLOCK):
                cards = block
                while len(block) == BLOCK and not any(block[at : at + 8] == b"END     " for at in range(0, BLOCK, CARD)):
                    block = f.read(BLOCK)
                    cards += block
                if len(block) < BLOCK:
                    return False
                left = _padded(_size(header(io.BytesIO(cards))))
                while left > 0:
                    if not (block := f.read(min(left, 1 << 20))):
                        return False
                    left -= len(block)
        return True
    except (OSError, EOFError, ValueError, KeyError, zlib.error):
        return False


class _Rows(InputPartition):
    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        n = table(self.path)[1]
        return [_Rows(a, min(ROWS, n - a)) for a in range(0, n, ROWS)] or [_Rows(0, 0)]

    def read(self, part):
        offset, _, kind, columns = table(self.path)
        with _open(self.path) as f:
            f.seek(offset + part.first * kind.itemsize)
            rows = np.frombuffer(f.read(part.n * kind.itemsize), kind)
        out = []
        for name, sql, n in columns:
            v = rows[name]
            if sql == "string":
                out.append([x.decode("ascii", "replace").rstrip("\0 ") for x in v.tolist()])
            elif sql == "boolean":
                out.append([x == b"T" for x in v.tolist()])
            else:
                out.append(v.tolist())
        yield from zip(*out, strict=True)


class FitsTable(DataSource):
    """spark.read.format("fits-table").load(path): the first binary table of a file that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "fits-table"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t, _ in table(self.options["path"])[3])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
