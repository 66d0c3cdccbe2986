"""Operator 5: licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common

# fixed values: notices by which common licences are declared, and the wording of licences and of their file headers
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]
#: file names by which licence files are known
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
TOKEN = re.compile(r"[^\W_]+|\n")
MATCH_AT = 0.75


class Matcher:
    """TF-IDF cosine of lines and of whole texts to the templates, over the templates' own terms.

    A term of a template weighs log((1 + N) / (1 + df)) + 1, with df counted over all N files; each other word of a
    line counts as a term of its own with the root mean square weight of the templates' terms, so a notice inside a
    long line of prose scores low, and a verdict hangs on the terms' shares of the files and not on their number.
    """

    def __init__(self, templates: list[tuple[str, str]], df: dict[str, int], files: int) -> None:
        self.names = [n for n, _ in templates]
        split = [[t for t in TOKEN.findall(text.lower()) if t != "\n"] for _, text in templates]
        self.terms = {t: i for i, t in enumerate(sorted({t for s in split for t in s}))}
        weight = [np.log((1 + files) / (1 + df.get(t, 0))) + 1 for t in self.terms]
        self.idf = np.array(weight, float)
        self.other = float(np.sqrt(np.mean(self.idf**2))) if weight else 1.0
        m = np.zeros((len(self.terms), len(split)))
        for j, s in enumerate(split):
            for t in s:
                m[self.terms[t], j] += self.idf[self.terms[t]]
        self.matrix = m / np.maximum(np.linalg.norm(m, axis=0), 1e-12)

    def codes(self, text: str) -> np.ndarray:
        """-1 for a line end, -2 for words of no template, else the term."""
        get = self.terms.get
        return np.array([-1 if t == "\n" else get(t, -2) for t in TOKEN.findall(text.lower())], np.int64)

    def lines(self, codes: np.ndarray) -> np.ndarray:
        """Cosines, lines by templates; only lines with a template's term have one above 0."""
        return self._units(codes, np.cumsum(codes == -1))

    def blocks(self, codes: np.ndarray) -> np.ndarray:
        """Cosines of blocks of lines between blank lines, as of a header."""
        end = codes == -1
        return self._units(codes, np.cumsum(end & np.concatenate([[False], end[:-1]])))

    def _units(self, codes: np.ndarray, line: np.ndarray) -> np.ndarray:
        n = int(line[-1]) + 1 if len(line) else 1
        known, width = codes >= 0, len(self.terms)
        key, count = np.unique(line[known] * width + codes[known], return_counts=True)
        at, term = key // width, key % width
        value = count * self.idf[term]
        norm = np.bincount(at, value**2, n) + np.bincount(line[codes == -2], minlength=n) * self.other**2
        dot = np.zeros((n, self.matrix.shape[1]))
        if len(at):  # entries come by unit
            there, first = np.unique(at, return_index=True)
            dot[there] = np.add.reduceat(value[:, None] * self.matrix[term], first, axis=0)
        return dot / np.sqrt(np.maximum(norm, 1e-12))[:, None]

    def whole(self, codes: np.ndarray) -> np.ndarray:
        return self.lines(codes[codes != -1])[0]


def template_frequencies(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[dict[str, int], int]:
    """Files that hold each template term (as many numbers as there are terms), and all files; over whole texts."""
    matcher = Matcher(templates, {}, 1)
    names = list(matcher.terms)

    def count(batches):
        seen, total = np.zeros(len(names), np.int64), 0
        for b in batches:
            total += len(b)
            for t in b.text:
                c = matcher.codes(common.as_text(t))
                seen[np.unique(c[c >= 0])] += 1
        yield pd.DataFrame({"term": [*names, ""], "n": [*seen.tolist(), total]})

    got = files.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in got}
    total = found.pop("", 0)
    return found, total


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, match_at: float = MATCH_AT) -> DataFrame:
    """One row per row of files (file_id, path, is_license_file, text) with its own licence and the inherited one.

    own_license is the template with the largest cosine over all lines, blocks between blank lines, and the whole text,
    if that is at least match_at; ties go to the earlier template.  A licence file is one that is_license_file says is,
    or whose whole text matches; where is_license_file is null, its name tells.  A file without a licence takes that of the best licence
    file (largest cosine, then smallest path) in the nearest directory at or above its own; distance counts the
    directories between (0: the same directory, null: own or none).  A null text is empty, a null path stands in no
    directory and neither gives nor takes; repeated rows are judged one by one.
    Directories are joined, not files with files: each directory meets its ancestors once.
    """
    common.small_batches(files.sparkSession)
    df, total = template_frequencies(files, templates)
    matcher = Matcher(templates, df, total)

    def own(batches):
        def one(b):
            names, scores, files = [], [], []
            for text, said in zip(b.text, b.is_license_file, strict=True):
                codes = matcher.codes(common.as_text(text))
                best = whole = np.zeros(len(matcher.names))
                if (codes >= 0).any():
                    whole = matcher.whole(codes)
                    best = np.maximum(np.maximum(matcher.lines(codes).max(axis=0), matcher.blocks(codes).max(axis=0)), whole)
                j = int(best.argmax())
                names.append(matcher.names[j] if best[j] >= match_at else None)
                scores.append(float(best[j]))
                files.append(bool(said) or bool(whole.max() >= match_at))
            return b.drop(columns=["text", "is_license_file"]).assign(is_license_file=files, own_license=names, own_score=scores)[
                ["file_id", "path", "is_license_file", "own_license", "own_score"]]

        return common.frames(batches, one)

    rows = files.select(
        F.col("file_id").cast("long"), "path", F.coalesce("is_license_file", F.rlike("path", F.lit(LICENSE_FILE)), F.lit(False)).alias("is_license_file"), "text")
    found = rows.mapInPandas(
        own, "file_id long, path string, is_license_file boolean, own_license string, own_score double")
    found = common.materialize(found.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")), "licences")
    givers = found.where("is_license_file AND own_license IS NOT NULL AND path IS NOT NULL").groupBy("dir").agg(
        F.min(F.struct((-F.col("own_score")).alias("rank"), "path", "own_license")).alias("best"))
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    # the root directory is '' and an ancestor of all
    above = found.where("path IS NOT NULL").select("dir").distinct().select(
        "dir", depth.alias("depth"), F.explode(F.sequence(F.lit(0), depth)).alias("level")).select(
        "dir", (F.col("depth") - F.col("level")).alias("distance"),
        F.when(F.col("level") == 0, "").otherwise(F.array_join(F.slice(parts, F.lit(1), F.col("level")), "/")).alias("up"))
    nearest = above.join(givers.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(
        F.min(F.struct("distance", "best")).alias("near"))
    joined = found.join(nearest, "dir", "left")
    takes = F.col("own_license").isNull() & F.col("path").isNotNull()
    return joined.select(
        "file_id", "path", "is_license_file", "own_license", "own_score",
        F.coalesce("own_license", F.when(takes, F.col("near.best.own_license"))).alias("license"),
        F.when(takes, F.col("near.best.path")).alias("license_from"),
        F.when(takes, F.col("near.distance")).cast("int").alias("distance"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/lang/<id div 512>/<id div 64>: every 64th is its directory's LICENSE, every
    512th that of the directory above; the others stand below as <id div 8>/<id>."""
    documents = common.table(spark, sf_dir, "documents")
    i = F.col("doc_id")

    def below(*steps: int):
        return [F.floor(i / n).cast("string") for n in steps]

    name = F.concat(F.lit("LICENSE."), i.cast("string"))
    place = F.when(i % 512 == 0, F.concat_ws("/", "source", "lang", *below(512), name)).when(
        i % 64 == 0, F.concat_ws("/", "source", "lang", *below(512, 64), name)).otherwise(
        F.concat_ws("/", "source", "lang", *below(512, 64, 8), i.cast("string")))
    files = documents.select(i.alias("file_id"), place.alias("path"), F.lit(None).cast("boolean").alias("is_license_file"), "text")
    return scan(files).withColumnRenamed("file_id", "doc_id")
