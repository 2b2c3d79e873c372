r"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory (DataFrame functions only).

Every file is looked at in three sizes, as a licence may be a line, a comment of several lines, or the whole file: its lines, its blocks (lines up to one without letters and
digits) and all of it. Each of these is a sparse vector: a distinct term (letters and digits, lower case) weighs its idf, ln(1 + files / files with it); terms
that no template has weigh as if one file had them. A vector whose cosine to a template is at least ``threshold`` states that licence; an SPDX line must match its template almost
exactly, as such lines differ in a name alone. The
templates' terms are few, so document frequencies are a table of their size. A vector can reach the threshold only if at least
threshold^2 of its terms are templates' terms, as no other term weighs less; those that can't are left out before any shuffle. One pass over the texts finds both, and is written.

A file's own licence is its best statement. A licence file (by its name, or because stating lines, or a block or all of it with a cosine of FILE_COSINE, make up at least half of its words) gives its
licence to its directory. A file without its own takes that of the nearest directory above it that has one: directories, not files, are
expanded to their ancestors and joined by path, and files are then joined to their directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, loose, read, text_of

#: A block or a whole file is nothing but a licence from the second cosine on.
THRESHOLD, FILE_COSINE = 0.75, 0.9
#: Parts that licence texts share.
AS_IS_MIT = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
AS_IS_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GPL_GRANT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
BSL_GRANT = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Names of licences with statements of them as headers and first lines of licence files have them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("All-rights-reserved", "All rights reserved."),
    ("All-rights-reserved", "Copyright (c) All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *((name, GPL_GRANT.format(kind=kind, v=v)) for name, kind, v in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"))),
    *((name, GPL_GRANT.format(kind=kind, v=v) + f" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details. You should have received a copy of the GNU {kind} General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.")
      for name, kind, v in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"))),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + AS_IS_MIT),
    ("ISC", "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) All rights reserved. {BSD_HEAD} {AS_IS_BSD}"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) All rights reserved. {BSD_HEAD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {AS_IS_BSD}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003 {BSL_GRANT} The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or later (the \"Licence\"); You may not use this work except in compliance with the Licence."),
    ("EUPL-1.2", "European Union Public Licence v. 1.2"),
    ("Apache-2.0 OR MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("Apache-2.0 OR MIT", "Licensed under the Apache License, Version 2.0 or the MIT license, at your option. This file may not be copied, modified, or distributed except according to those terms."),
)
#: Identifiers of SPDX lines, and the choices between two of them that are common (words have no order here, so each stands for both orders).
IDENTIFIERS = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MPL-2.0", "Unlicense", "Zlib", "EUPL-1.2", "Apache-2.0 OR MIT", "GPL-2.0 OR MIT", "GPL-2.0-only OR MIT", "GPL-2.0-or-later OR MIT", "MIT OR Unlicense", "BSD-3-Clause OR GPL-2.0", "BSD-3-Clause OR MIT", "Apache-2.0 OR BSD-3-Clause",
    "Apache-2.0 WITH LLVM-exception",
)
FIRST_SPDX, SPDX_THRESHOLD = len(TEMPLATES), 0.95
TEMPLATES = (*TEMPLATES, *((x.replace("-only", "").replace("-or-later", ""), f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS))
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


def _words(text: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"[0-9a-z]+", text.lower())))


VOCABULARY = sorted({w for _, t in TEMPLATES for w in _words(t)})


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits and of non-ASCII characters, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")), "")


#: No group repeats here: the matcher of the JVM would call itself for each line.
BLOCKS = r"\n[^\p{L}\p{N}]*\n"


def _size(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda x: x != ""))


def candidates(files: DataFrame, threshold: float) -> DataFrame:
    """``file``, ``known`` (terms of it that templates have) and ``parts``: (at, own terms, number of others, share of the file's words) of lines, blocks and the whole that may state a licence."""
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    pieces = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("l")))
    blocks = F.filter(F.split("text", BLOCKS), lambda x: F.contains(x, F.lit("\n")))
    more = F.transform(F.when(F.size(F.split("text", BLOCKS)) > 1, F.concat(blocks, F.array("text"))).otherwise(blocks), lambda x, i: F.struct((-1 - i).alias("at"), x.alias("l")))

    def part(x: Column) -> Column:
        t = terms(x["l"])
        return F.struct(x["at"].alias("at"), x["l"].alias("l"), F.array_intersect(t, vocabulary).alias("own"), F.size(t).alias("n"))

    read_ = files.select("file", "text", F.transform(pieces, part).alias("lines"), F.transform(more, part).alias("more"))
    good = lambda x: (F.size(x["own"]) > 0) & (F.size(x["own"]) >= threshold * threshold * x["n"] - 1e-9)
    words = _size(F.col("text"))
    said = F.transform(F.filter(F.concat("lines", "more"), good), lambda x: F.struct(x["at"].alias("at"), x["own"].alias("own"), (x["n"] - F.size(x["own"])).alias("others"), (_size(x["l"]) / words).alias("share")))
    return read_.select("file", F.array_distinct(F.flatten(F.transform("lines", lambda x: x["own"]))).alias("known"), said.alias("parts"))


def statements(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``file``, ``at`` (a line's number; below 0 for blocks and the whole), ``licence``, ``cosine`` (6 digits) and ``share`` (of the file's words) of parts that state a licence: the best template of each."""
    spark = files.sparkSession
    found = cut(candidates(files, threshold), "licence_parts")
    n = found.agg(F.count("*").alias("n_files"))
    df = found.select(F.explode("known").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # one row for each term of the templates, whatever the corpus
    known = spark.createDataFrame([(w,) for w in VOCABULARY], "term string").join(df, "term", "left").crossJoin(n)
    weights = cut(known.select("term", F.ln(1 + F.col("n_files") / F.greatest(F.coalesce("df", F.lit(1)), F.lit(1))).alias("w"), F.ln(1 + F.col("n_files")).alias("w_other")).coalesce(1), "licence_weights")
    need = lambda i: SPDX_THRESHOLD if i >= FIRST_SPDX else threshold
    vectors = spark.createDataFrame([(i, name, w, need(i)) for i, (name, t) in enumerate(TEMPLATES) for w in _words(t)], "template int, licence string, term string, need double").join(F.broadcast(weights), "term")
    norms = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vectors = vectors.join(F.broadcast(norms), "template")
    sparse = found.select("file", F.explode("parts").alias("p")).select("file", "p.at", "p.others", "p.share", F.explode("p.own").alias("term"))
    size = sparse.join(F.broadcast(weights), "term").groupBy("file", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w")) + F.first(F.col("others") * F.col("w_other") * F.col("w_other"))).alias("size"), F.first("share").alias("share"))
    dots = sparse.join(F.broadcast(vectors), "term").groupBy("file", "at", "template", "licence", "need", "norm").agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
    scored = dots.join(size, ["file", "at"]).select("file", "at", "licence", "need", "share", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6).alias("cosine")).where(F.col("cosine") >= F.col("need"))
    best = scored.groupBy("file", "at").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"), F.first("share").alias("share"))
    return best.select("file", "at", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), "share")


def inherit(own: DataFrame) -> DataFrame:
    """From ``file``, ``dir`` (its path without the last part), ``licence``, ``is_file`` and ``cosine`` to all of these with ``how`` and ``distance``.

    ``how``: file, header, inherited, or null; ``distance``: directories between a file and the one that its licence is from, 0 for its own directory.
    """
    given = own.where("is_file AND licence IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")).select(F.col("dir").alias("above"), F.col("b.licence").alias("given"))
    dirs = own.where("licence IS NULL").select("dir").distinct()
    # the directory itself, then its ancestors up to the root, which is empty
    parts = F.split("dir", "/")
    chain = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    found = dirs.select("dir", F.posexplode(chain).alias("distance", "above")).join(given, "above").groupBy("dir").agg(F.min(F.struct("distance", "given")).alias("b"))
    out = own.join(loose(found).select(F.col("dir").alias("_dir"), "b"), (F.col("dir") == F.col("_dir")) & F.col("licence").isNull(), "left")
    how = F.when(F.col("licence").isNotNull() & F.col("is_file"), "file").when(F.col("licence").isNotNull(), "header").when(F.col("b").isNotNull(), "inherited")
    return out.select("file", "dir", F.coalesce("licence", "b.given").alias("licence"), how.alias("how"), F.col("b.distance").alias("distance"), "cosine")


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``path``, ``licence``, ``how``, ``distance`` and ``cosine`` of every file.

    Null or empty text states nothing, and its file may inherit. A null path counts as empty, in the root directory. Rows that repeat a path and text are
    reported once each; equal paths with different texts are different files. Of statements that are as good, the first name in order is taken.
    """
    f = files.select(F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), text_of(text_col).alias("text"))
    f = f.withColumn("file", F.struct("path", F.xxhash64("text").alias("hash")))
    said = cut(statements(f.select("file", "text"), threshold), "licence_statements")
    best = said.groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"), F.greatest(F.sum(F.when(F.col("at") >= 0, F.col("share")).otherwise(0.0)), F.max(F.when(F.col("cosine") >= FILE_COSINE, F.col("share")))).alias("share"))
    own = f.select("file").join(best, "file", "left")
    path = F.col("file.path")
    named = path.rlike(LICENCE_FILE)
    own = own.select(
        "file", F.regexp_replace(path, r"/?[^/]*$", "").alias("dir"), F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), (named | F.coalesce(F.col("share") >= 0.5, F.lit(False))).alias("is_file")
    )
    return inherit(own).select(F.col("file.path").alias("path"), "licence", "how", "distance", "cosine")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    d = scan(read(spark, sf_dir, "documents").select(path.alias("path"), "text"))
    return d.select(F.regexp_extract("path", "([^/]*)$", 1).cast("long").alias("doc_id"), "licence", "how", F.coalesce(F.col("distance"), F.lit(-1)).cast("long").alias("distance"))


def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    vectors = ", ".join(f"({i}, {quote(name)}, {quote(w)})" for i, (name, t) in enumerate(TEMPLATES) for w in _words(t))
    split = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> ''))"
    words = lambda c: f"len(list_filter(regexp_split_to_array({c}, '[ \\t-\\r]+'), lambda x: x <> ''))"
    return f"""
WITH v(template, licence, term) AS (VALUES {vectors}),
f AS MATERIALIZED (SELECT row_number() OVER () AS file, doc_id, concat_ws('/', source, lang) AS dir, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS n FROM f),
ft AS (SELECT file, unnest({split("text")}) AS term FROM f),
w AS MATERIALIZED (SELECT term, ln(1 + n / greatest(df, 1)) AS w FROM (SELECT v.term, count(ft.term) AS df FROM (SELECT DISTINCT term FROM v) v LEFT JOIN ft ON ft.term = v.term GROUP BY v.term), n),
l AS (SELECT file, {words("text")} AS words, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS line FROM f
      UNION ALL SELECT file, words, unnest(p) AS l, unnest(list_transform(range(len(p)), lambda i: -1 - i)) AS line FROM (SELECT file, {words("text")} AS words, list_filter(regexp_split_to_array(text, '{BLOCKS}'), lambda x: contains(x, chr(10))) || CASE WHEN len(regexp_split_to_array(text, '{BLOCKS}')) > 1 THEN [text] ELSE [] END AS p FROM f)),
lx AS (SELECT file, line, words, l, {split("l")} AS ts FROM l),
lt AS MATERIALIZED (SELECT file, line, {words("l")} / words AS share, unnest(ts) AS term FROM lx WHERE len(list_intersect(ts, [{", ".join(map(quote, VOCABULARY))}])) >= {THRESHOLD**2} * len(ts) - 1e-9 AND len(ts) > 0),
s AS (SELECT file, line, any_value(share) AS share, sqrt(sum(coalesce(w, ln(1 + n)) ** 2)) AS size FROM lt LEFT JOIN w ON lt.term = w.term, n GROUP BY file, line HAVING count(w) > 0),
vn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM v JOIN w ON v.term = w.term GROUP BY template),
d AS (SELECT file, line, v.template, licence, sum(w * w) AS dot FROM lt JOIN v ON lt.term = v.term JOIN w ON w.term = v.term GROUP BY ALL),
c AS (SELECT d.file, d.line, d.template, licence, share, round(dot / (norm * size), 6) AS cosine FROM d JOIN s ON d.file = s.file AND d.line = s.line JOIN vn ON vn.template = d.template),
b AS (SELECT file, line, any_value(share) AS share, max(cosine) AS cosine, arg_min(licence, {{'c': -cosine, 'l': licence}}) AS licence FROM c WHERE cosine >= CASE WHEN template >= {FIRST_SPDX} THEN {SPDX_THRESHOLD} ELSE {THRESHOLD} END GROUP BY file, line),
o AS MATERIALIZED (SELECT f.file, doc_id, dir, licence, cosine, coalesce(share >= 0.5, false) AS is_file FROM f LEFT JOIN (SELECT file, greatest(sum(CASE WHEN line >= 0 THEN share ELSE 0 END), max(CASE WHEN cosine >= {FILE_COSINE} THEN share END)) AS share, max(cosine) AS cosine, arg_min(licence, {{'c': -cosine, 'l': licence}}) AS licence FROM b GROUP BY file) g ON f.file = g.file),
g AS (SELECT dir AS above, arg_min(licence, {{'c': -cosine, 'l': licence}}) AS given FROM o WHERE is_file AND licence IS NOT NULL GROUP BY dir),
a AS (SELECT dir, unnest(range(len(string_split(dir, '/')) + 1)) AS distance FROM (SELECT DISTINCT dir FROM o)),
i AS (SELECT dir, min(distance) AS distance, arg_min(given, distance) AS given FROM a JOIN g ON g.above = array_to_string(string_split(dir, '/')[1 : len(string_split(dir, '/')) - distance], '/') GROUP BY dir)
SELECT doc_id, coalesce(licence, given) AS licence, CASE WHEN licence IS NOT NULL AND is_file THEN 'file' WHEN licence IS NOT NULL THEN 'header' WHEN given IS NOT NULL THEN 'inherited' END AS how,
       CASE WHEN licence IS NULL THEN coalesce(distance, -1) ELSE -1 END AS distance
FROM o LEFT JOIN i ON o.dir = i.dir"""
