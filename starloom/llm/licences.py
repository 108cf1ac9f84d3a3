"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

A file's lines, its paragraphs (lines up to an empty one, as a header or a comment block has them) and its whole text are
compared with licence templates as sparse vectors of words, weighted by their rarity among the lines of all files.  A
file without a licence of its own takes that of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, tidy, written
from .decontaminate import _bitmap, _probe
from .textops import ALNUM, pieces, words

#: Cosine at which a line, a paragraph or a text counts as a licence.
COSINE = 0.6
#: Buckets in which the lines that hold a word are counted; template words are counted apart.
BUCKETS = 1 << 18
#: Names of licences and the wording of their headers.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)


class _Templates:
    """Words of the templates (sorted hashes) and, once weighed, unit vectors over them."""

    def __init__(self, templates):
        self.names = [n for n, _ in templates]
        column = pa.array([t for _, t in templates], pa.large_string())
        h, first = [], [0]
        for _, data, offsets in pieces(column):
            got, _, _, at = words(data, offsets, ALNUM)
            h.append(got)
            first += (at[1:] + first[-1]).tolist()
        h = np.concatenate(h)
        self.words, self.bits = np.unique(h), _bitmap(np.unique(h))
        self.counts = np.zeros((len(self.names), len(self.words)))
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            np.add.at(self.counts[i], np.searchsorted(self.words, h[a:b]), 1)

    def weigh(self, lines: int, found: dict[int, int], buckets: np.ndarray) -> None:
        """Rarity of the words among so many lines: found has the lines with each template word, buckets those of all words."""
        n = np.array([found.get(w, 0) for w in self.words.view(np.int64).tolist()], float)
        self.idf = np.log((lines + 1) / (n + 1)) + 1
        self.others = np.log((lines + 1) / (np.minimum(buckets, lines) + 1)) + 1
        v = np.log1p(self.counts) * self.idf
        self.unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _units(data: np.ndarray, offsets: np.ndarray):
    """(hash of each word, for each kind of unit the number of its own, text of each unit): lines, paragraphs, texts."""
    h, start, _, _ = words(data, offsets, ALNUM)
    breaks = np.flatnonzero(data == 10) + 1
    # A paragraph ends with a line of no words.
    line = np.unique(np.concatenate([offsets[:-1], breaks]))
    used = np.bincount(np.searchsorted(line, start, "right") - 1, minlength=len(line)) > 0
    paragraph = np.unique(np.concatenate([offsets[:-1], line[1:][~used[:-1]] if len(line) else line]))
    out = []
    for begins in (line, paragraph, np.unique(offsets[:-1])):
        out.append((np.searchsorted(begins, start, "right") - 1, np.searchsorted(offsets, begins, "right") - 1))
    return h, out


def _statistics(files: DataFrame, t: _Templates) -> tuple[int, dict[int, int], np.ndarray]:
    """Lines with words of all files, in how many of them each template word is, and the sums of those by buckets of all words."""

    def count(batches):
        n, total, every = 0, np.zeros(len(t.words), np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in pieces(batch.column(0), 1 << 21):
                h, ((line, _), *_) = _units(data, offsets)
                n += len(np.unique(line))
                at = _probe(t.words, t.bits, h)
                pair = np.unique(line[at] * np.int64(len(t.words)) + np.searchsorted(t.words, h[at]))
                total += np.bincount(pair % len(t.words), minlength=len(t.words))
                every += np.bincount(np.unique(line * np.int64(BUCKETS) + _bucket(h)) % BUCKETS, minlength=BUCKETS)
        some = np.flatnonzero(every)
        yield pa.record_batch({"word": pa.array(np.concatenate([t.words.view(np.int64), [0], some])), "n": pa.array(np.concatenate([total, [n], every[some]])), "kind": pa.array([0] * len(total) + [1] + [2] * len(some), pa.int32())})

    got = files.select("text").mapInArrow(tidy(count), "word long, n long, kind int").groupBy("word", "kind").agg(F.sum("n").alias("n")).toArrow()  # a row for each template word and bucket
    word, n, kind = (got.column(c).to_numpy() for c in ("word", "n", "kind"))
    every = np.zeros(BUCKETS, np.int64)
    every[word[kind == 2]] = n[kind == 2]
    return int(n[kind == 1].sum()), dict(zip(word[kind == 0].tolist(), n[kind == 0].tolist(), strict=True)), every


def _best(t: _Templates, data: np.ndarray, offsets: np.ndarray, cosine: float):
    """(template or -1, cosine) of the best line, paragraph or whole of each text; the first template of equals."""
    n = len(offsets) - 1
    which, score = np.full(n, -1), np.zeros(n)
    h, units = _units(data, offsets)
    if not len(h):
        return which, score
    for line, text in units:
        _best_of(t, h, line, text, cosine, which, score)
    return which, score


def _best_of(t: _Templates, h: np.ndarray, line: np.ndarray, text: np.ndarray, cosine: float, which: np.ndarray, score: np.ndarray) -> None:
    """Enters the best of units, by the number of each word's unit and each unit's text, where it is better than what is there."""
    at = _probe(t.words, t.bits, h)
    # A unit's words that are in no template only add to its length; those in one are counted word by word.
    width = len(t.words)
    pair, times = np.unique(line[at] * np.int64(width) + np.searchsorted(t.words, h[at]), return_counts=True)
    row, word = pair // width, pair % width
    hot = np.unique(row)
    value = np.log1p(times) * t.idf[word]
    others = np.ones(len(h), bool)
    others[at] = False
    is_hot = np.zeros(len(text), bool)
    is_hot[hot] = True
    outside = np.flatnonzero(others)[is_hot[line[others]]]
    place = np.searchsorted(hot, row)
    length = np.bincount(place, value**2, len(hot))
    if len(outside):
        own, mine = h[outside], np.searchsorted(hot, line[outside])
        order = np.lexsort((own, mine))
        own, mine = own[order], mine[order]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (mine[1:] != mine[:-1])]))
        many = np.diff(np.append(new, len(own)))
        length += np.bincount(mine[new], (np.log1p(many) * t.others[_bucket(own[new])]) ** 2, len(hot))
    for at in range(0, len(hot), 4096):
        lo, hi = np.searchsorted(place, [at, at + 4096])
        v = np.zeros((min(4096, len(hot) - at), width))
        v[place[lo:hi] - at, word[lo:hi]] = value[lo:hi]
        close = (v @ t.unit.T) / np.sqrt(length[at : at + len(v)])[:, None]
        best = close.argmax(axis=1)
        top = np.round(close.max(axis=1), 9)
        owner = text[hot[at : at + len(v)]]
        for k in np.flatnonzero(top >= cosine).tolist():
            d = owner[k]
            if (top[k], -best[k]) > (score[d], -which[d] if which[d] >= 0 else -np.inf):
                which[d], score[d] = best[k], top[k]


def scan(files: DataFrame, templates=TEMPLATES, cosine: float = COSINE, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Columns keep of files, own_license and own_score: the template closest to any line, paragraph or the whole of the text, null and 0 below the threshold."""
    t = _Templates(templates)
    t.weigh(*_statistics(files, t))
    flow = files.select("text", *keep)

    def make(batches):
        for batch in batches:
            name, score = [], []
            for _, data, offsets in pieces(batch.column(0), 1 << 21):
                which, best = _best(t, data, offsets, cosine)
                name += [t.names[i] if i >= 0 else None for i in which.tolist()]
                score.append(best)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(name, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], names=[*keep, "own_license", "own_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flow.schema.fields[1:])
    return flow.mapInArrow(tidy(make), f"{kinds}, own_license string, own_score double")


def inherited(files: DataFrame, licence_file: str = r"(?i)(^|/)(licen[cs]e|copying)(\.[a-z]+)?$") -> DataFrame:
    """Adds license and license_from to files (path, own_license, own_score): a file's own licence (from: its path), else that
    of the nearest directory above it with a licence file that has one, else null.

    Of several licence files in a directory the best score counts, then the smallest path.  A null path inherits nothing.
    Directories, not files, are joined with their ancestors.  Columns license and license_from of the input give way.
    """
    parent = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), ""))
    own, columns = "__starloom_dir", files.columns
    files = files.withColumn(own, parent)
    best = F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license"))
    granted = files.where(F.col("path").rlike(licence_file) & F.col("own_license").isNotNull()).groupBy(own).agg(best.alias("x")).select(F.col(own).alias("above"), F.col("x.own_license").alias("above_license"))
    granted = written(granted, "granted", True)
    part = F.split(own, "/")
    up = F.when(F.col(own) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(part)), lambda n: F.concat_ws("/", F.slice(part, F.lit(1), n)))))
    dirs = files.select(own).where(F.col(own).isNotNull()).distinct().select(own, F.posexplode(up).alias("depth", "above"))
    nearest = dirs.join(granted, "above").groupBy(own).agg(F.max(F.struct("depth", "above", "above_license")).alias("x"))
    nearest = written(nearest.select(own, F.col("x.above").alias("__starloom_above"), F.col("x.above_license").alias("__starloom_license")), "nearest", True)
    rows = files.join(nearest, own, "left")
    found = {"license": F.coalesce("own_license", "__starloom_license"), "license_from": F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("__starloom_above"))}
    return rows.select(*[c for c in columns if c not in found], *(v.alias(k) for k, v in found.items()))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: a directory for each source, in it one for each thousand ids and in that for each
    hundred; the first twenty documents of a hundred are licence files, of a thousand in the directory above."""
    n = F.col("doc_id")
    name = F.when(n % 100 < 20, F.lit("LICENSE")).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    deep = F.when(n % 1000 < 20, F.concat(F.lit("t"), F.floor(n / 1000).cast("string"))).otherwise(F.concat(F.lit("t"), F.floor(n / 1000).cast("string"), F.lit("/h"), F.floor(n / 100).cast("string")))
    return docs.select("doc_id", "text", F.concat_ws("/", F.lit("src"), F.coalesce("source", F.lit("none")), deep, name).alias("path"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = as_files(read(spark, sf_dir, "documents"))
    found = inherited(written(scan(files, keep=("doc_id", "path")), "scanned"))
    return found.select("doc_id", "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", "license_from")
