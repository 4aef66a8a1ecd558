"""License scan: sparse TF-IDF cosine to templates, then inheritance along directories. Spark expressions only.

A passage is a line, a paragraph (lines up to an empty one, so wrapped headers are whole) or a whole text
that has a word of licensing (CUES) and does not say that something is not licensed (DENIED). Templates are notices, titles, SPDX tags and
licence texts. Passages and templates become sparse vectors over the templates' terms, weighted by term
count times log((1 + N) / (1 + df)) + 1, where df counts all documents that have the term. A passage takes the
template of largest cosine if that is `min_cosine` or more, and a document the license of its best
passage. A passage of one SPDX tag with one license takes only that; a tag with an expression (OR, AND, WITH) of licenses that are all
known gives the expression, with cosine 1.

A document is a licence file of its directory if its name says so (LICENSE, COPYING, ...) or its
passages make up `file_share` or more of its words. Documents without a license of their own take
that of the nearest directory upwards that has a licence file. That is computed for distinct
directories: each is expanded to its ancestors, joined by path with the licence files'
directories, and the deepest match goes back to the documents.

Edge cases: null or empty text has no passage and can only inherit; a null path has no directory and
inherits nothing; ties between templates, passages or licence files of a directory go to the larger
cosine, then the smaller license name; repeated rows get a row each; an empty table gives an empty
result; only id, path and text columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupsight.sources.store import cut


# The notices by which licenses are commonly declared.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 public domain"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "Copyright. All rights reserved"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("ISC", "ISC License"),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions "
        "of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions "
        "of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither "
        "the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission.",
    ),
]
_SPDX = r"(?i)spdx-license-identifier:[ \t]*(\(?[a-z0-9.+-]+(?:[ \t]+(?:or|and|with)[ \t]+[a-z0-9.+-]+|[ \t]+(?:or|and)[ \t]+\([a-z0-9.+ -]+\))*\)?)"
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES} - {"Proprietary"})]
CUES = r"(?i)licen[cs]|copyright|spdx|redistribut|permission (is hereby|to use)|public domain|creative commons|free software"
DENIED = r"(?i)\b(not|never|no longer)\s+(be\s+)?(licen[cs]ed|released|distributed|available|covered)\b"
_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice)(\.[a-z]+)?$"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; version numbers keep their points."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9])\."), lambda t: t != "")


def _passages(docs: DataFrame, names: list[str]) -> DataFrame:
    """(row, line, kind, tag, expression, terms) of lines (kind 0), paragraphs (1) and whole texts (2) with a cue; tag: the license of an SPDX tag; expression: that of a tag that names several, all known."""
    fits = lambda x: x.rlike(CUES) & ~x.rlike(DENIED)
    with_cue = lambda kind, parts: F.transform(F.filter(parts, fits), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
    parts = F.concat(with_cue(0, F.split("t", "\n")), with_cue(1, F.split("t", r"\n[ \t\r]*\n")), with_cue(2, F.array("t")))
    rows = docs.select("row", F.posexplode(F.when(F.col("t").rlike(CUES), parts)).alias("line", "x"))
    rows = rows.withColumn("tags", F.regexp_extract_all("x.text", F.lit(_SPDX), 1))
    said = F.when(F.size("tags") == 1, F.lower(F.regexp_replace(F.col("tags")[0], "[()]", "")))
    plain = lambda c: F.regexp_replace(c, "-only$|-or-later$|[+]$", "")
    words = F.filter(F.split(said, r"\s+"), lambda w: w != "")
    proper = F.create_map(*[x for n in names for x in (F.lit(n.lower()), F.lit(n))])
    # after WITH comes an exception, which is kept as it is
    told = F.transform(words, lambda w, i: F.when(w.isin("or", "and", "with"), F.upper(w)).when((i > 0) & (F.try_element_at(words, i) == "with"), w).otherwise(proper[plain(w)]))
    several = (F.size(words) > 1) & F.forall(told, lambda w: w.isNotNull())
    return rows.select(
        "row", "line", "x.kind", F.when(F.size(words) == 1, plain(words[0])).when(F.size(words) > 1, said).alias("tag"), F.when(several, F.array_join(told, " ")).alias("expression"),
        terms(F.col("x.text")).alias("terms"),
    )


def _weighted(rows: DataFrame, keys: list[str], idf: DataFrame) -> DataFrame:
    """(keys, term, w): unit vectors over the templates' terms, from rows with an array of terms."""
    tf = rows.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    w = tf.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))  # idf has the templates' terms only
    norm = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, keys).select(*keys, "term", (F.col("w") / F.col("norm")).alias("w"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
    min_cosine: float = 0.8, file_share: float = 0.05,
) -> DataFrame:
    """(id, path, own_license, cosine, license_file, license, inherited_from): a row per document."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("t"))
    known = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates or TEMPLATES)], "template int, name string, t string")
    known = known.select("template", "name", terms(F.col("t")).alias("terms")).persist()
    vocabulary = sorted(r.term for r in known.select(F.explode("terms").alias("term")).distinct().collect())  # fixed templates' terms
    wanted = F.array(*[F.lit(t) for t in vocabulary])
    words = F.split(F.col("t"), r"[\x20\x09-\x0D]+")
    light = rows.select(
        "row", "id", "path", F.size(F.filter(words, lambda x: x != "")).alias("n_words"), F.when(F.col("t").rlike(CUES), F.col("t")).alias("t"),
        F.array_intersect(terms(F.coalesce("t", F.lit(""))), wanted).alias("has"),
    )
    light = cut(light, "licence_lines")  # row numbers are fixed from here on; texts without a cue are left behind
    total = light.count()
    df = light.select(F.explode("has").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = spark.createDataFrame([(t,) for t in vocabulary], "term string").join(df, "term", "left")
    idf = cut(idf.select("term", (F.log((1 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")), "idf")

    passages = cut(_passages(light, sorted({n for n, _ in templates or TEMPLATES})), "passages")
    mine = _weighted(passages, ["row", "line"], idf)
    theirs = _weighted(known, ["template", "name"], idf).withColumnRenamed("w", "v")
    cosines = mine.join(F.broadcast(theirs), "term").groupBy("row", "line", "template", "name").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))
    cosines = cosines.withColumn("cosine", F.round("cosine", 9)).where(F.col("cosine") >= min_cosine).join(passages.select("row", "line", "tag"), ["row", "line"])
    cosines = cosines.where(F.col("tag").isNull() | (F.col("tag") == F.lower("name")))
    told = passages.where("expression IS NOT NULL").select("row", "line", F.col("expression").alias("name"), F.lit(1.0).alias("cosine"))
    cosines = cosines.select("row", "line", "name", "cosine").unionByName(told)
    best = cosines.groupBy("row", "line").agg(F.min_by("name", F.struct(-F.col("cosine"), "name")).alias("name"), F.max("cosine").alias("cosine"))
    sizes = passages.select("row", "line", "kind", F.size("terms").alias("size"))
    of_kind = lambda k: F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0))
    own = best.join(sizes, ["row", "line"]).groupBy("row").agg(
        F.min_by("name", F.struct(-F.col("cosine"), "name")).alias("own_license"), F.max("cosine").alias("cosine"), F.greatest(of_kind(0), of_kind(1), of_kind(2)).alias("license_words")
    )
    dir_of = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), "")
    is_file = F.col("own_license").isNotNull() & (F.coalesce(F.col("path").rlike(_FILE_NAME), F.lit(False)) | (F.col("license_words") >= file_share * F.col("n_words")))
    found = light.select("row", "id", "path", "n_words", dir_of.alias("dir")).join(own, "row", "left").withColumn("license_file", is_file)
    found = cut(found.drop("row", "n_words", "license_words"), "own_licenses")

    files = found.where("license_file").groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("cosine"), "own_license")).alias("dir_license"))
    dirs = found.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    above = dirs.select("dir", F.explode(up).alias("x")).select("dir", "x.*").where("depth > 0 OR above = ''")
    nearest = above.join(files.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(
        F.max_by("dir_license", "depth").alias("dir_license"), F.max_by("above", "depth").alias("inherited_from")
    )
    out = found.join(nearest, "dir", "left")
    inherits = F.col("own_license").isNull()
    return out.select(
        "id", "path", "own_license", "cosine", "license_file", F.coalesce("own_license", "dir_license").alias("license"),
        F.when(inherits, F.col("inherited_from")).alias("inherited_from"),
    )


def op9_license(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # documents have no path of their own: source, then the id's thousands and hundreds, as directories
    bucket = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", "source", bucket(1000), bucket(100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.withColumn("path", path)).withColumnRenamed("id", "doc_id")
