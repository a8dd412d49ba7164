"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance by path.

A header is a line with a word that any licence notice has, alone and together with the lines about
it, up to ``NOTICE_LINES``, for a notice may be wrapped. A text whose paragraphs with such words make
up ``FILE_SHARE`` of it, or whose file name says so, is compared as a whole too. Each distinct header
and text is compared with every template by the cosine of their sparse TF-IDF vectors, inverse
frequencies being those of the corpus' header lines; a document's own licence is that of its best
header or text, if that reaches the threshold.

A document with a licence of its own is a licence file for its directory if its name says so, its
header lines make up FILE_SHARE of its text, or its text as a whole reaches the threshold. A document
that states no licence of its own takes that of the licence file of the nearest directory above it;
one whose own licence no template covers has none. DataFrame and SQL functions only.

Defined results: null texts and paths count as empty; an empty path lies in the root directory. Of
headers or files that tie, the higher score, then the lesser licence name, then the lesser path
holds. Rows that repeat are scanned alike. A text of any length is one row's work. Columns besides
don't matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, text_key, text_or_empty, written

#: Licence and notice, as their publishers word them (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work. CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", """MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """BSD 3-Clause License Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without
        modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name
        of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("LGPL-3.0", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU Affero General Public License for more details."""),
    ("BSD-2-Clause", """BSD 2-Clause License Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without
        modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS
        PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
)
#: A line without any of these is no header (fixed values).
MARKERS = "licen[cs]|copyright|spdx|public domain|hereby granted|redistribution and use"
#: A header with one of these states a licence, known or not; a mere mention or a copyright doesn't (fixed values).
STATED = r"licen[cs]ed\s+(?:under|to|by|as|for)\b|\bunder\b.*\blicen[cs]es?\b|licen[cs]e(?:-identifier)?\s*[:=]|spdx|public domain|hereby granted|redistribution and use"
FILE_NAMES = "^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
THRESHOLD = 0.6
FILE_SHARE = 0.5
#: Lines that a wrapped notice may have, and characters of one without a word that makes it a header.
NOTICE_LINES = 4
LINE_CHARS = 200
#: Directories whose licences are sent to every task; more are joined by merge.
DIRECTORIES = 200_000
_MARKED = "(?i)" + MARKERS


def terms(col: Column) -> Column:
    """Lower-case runs of letters and digits, a version's dots included."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"), F.lit(0))


def headers(rows: DataFrame) -> DataFrame:
    """``key, kind, header, share`` of each row of ``key, path, text``: lines with a marker, what they are
    wrapped in, and texts as a whole that may be licence files."""
    text, name = F.col("text"), F.lower(F.element_at(F.split("path", "/"), -1))
    found = rows.filter(text.rlike(_MARKED)).select("key", name.rlike(FILE_NAMES).alias("named"), "text", F.split("text", "\n", -1).alias("lines"))
    lines, chars = F.col("lines"), F.length("text")
    at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(_MARKED))
    about = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")) for n in range(2, NOTICE_LINES + 1) for s in range(1 - n, 1)])
    places = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(about, lambda o: F.struct((i + o["s"]).alias("s"), o["n"].alias("n"))))))
    places = F.filter(places, lambda p: (p["s"] >= 0) & (p["s"] + p["n"] <= F.size(lines)))
    blocks = F.transform(places, lambda p: F.slice(lines, p["s"] + 1, p["n"]))
    blocks = F.filter(blocks, lambda b: F.forall(b, lambda x: (F.trim(x) != "") & ((F.length(x) <= LINE_CHARS) | x.rlike(_MARKED))))
    marked = F.filter(F.split("text", r"\n\s*\n", -1), lambda p: p.rlike(_MARKED))
    of_marked = F.aggregate(marked, F.lit(0), lambda s, p: s + F.length(p))
    whole = F.when((F.size(lines) > 1) & (F.col("named") | (of_marked >= FILE_SHARE * chars)), F.array("text")).otherwise(F.array().cast("array<string>"))

    def units(kind: str, own: Column) -> Column:
        return F.transform(own, lambda h: F.struct(F.lit(kind).alias("kind"), F.trim(h).alias("header"), (F.length(h) / chars).alias("share")))

    alone = F.transform(at, lambda i: F.get(lines, i))
    joined = F.transform(blocks, lambda b: F.array_join(F.transform(b, F.trim), " "))
    return found.select("key", F.inline(F.concat(units("line", alone), units("block", joined), units("text", whole))))


def scores(found: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``digest, license, score``: each distinct header's best template, from rows of ``digest, kind, header``.

    A term that no header line has weighs most; a line in n documents counts n times in frequencies.
    Rows of terms name their header by its digest, for a header may be a long text.
    """
    spark = found.sparkSession
    distinct = found.groupBy("digest").agg(F.count_if(F.col("kind") == "line").alias("n"), F.min("header").alias("header"))
    by_term = distinct.select("digest", "n", F.explode(terms(F.col("header"))).alias("term")).groupBy("digest", "n", "term").agg(F.count("*").alias("tf"))
    total = distinct.agg(F.sum("n").cast("double").alias("total"))
    df = by_term.groupBy("term").agg(F.sum("n").alias("df"))
    notices = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, license string, notice string")
    notice_terms = notices.select("t", F.explode(terms(F.col("notice"))).alias("term")).groupBy("t", "term").agg(F.count("*").alias("ntf"))
    idf = F.log((1 + F.coalesce("total", F.lit(0.0))) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weighed = by_term.join(df, "term").join(F.broadcast(total)).select("digest", "term", (F.col("tf") * idf).alias("w"))
    norms = weighed.groupBy("digest").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # the templates' terms are a fixed few hundred rows
    notice_w = notice_terms.join(df, "term", "left").join(F.broadcast(total)).select("t", "term", (F.col("ntf") * idf).alias("nw"))
    notice_norm = notice_w.groupBy("t").agg(F.sqrt(F.sum(F.col("nw") * F.col("nw"))).alias("nnorm"))
    notice_w = notice_w.join(notice_norm, "t").join(notices.select("t", "license"), "t")
    dots = weighed.join(F.broadcast(notice_w), "term").groupBy("digest", "t", "license", "nnorm").agg(F.sum(F.col("w") * F.col("nw")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("nnorm")), 6)
    by_license = dots.join(norms, "digest").select("digest", "license", cosine.alias("score"))
    return by_license.groupBy("digest").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")).select("digest", "best.license", (-F.col("best.s")).alias("score"))


def scan(docs: DataFrame, path: Column, templates=TEMPLATES, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """One row a document: ``doc_id, path, own_license, own_score, license, inherited_from``.

    license is the document's own one or the inherited one; inherited_from is the directory.
    """
    rows = docs.select("doc_id", F.coalesce(path, F.lit("")).alias("path"), text_key().alias("text_key"), text_or_empty().alias("text"))
    found, found_at = written(headers(rows.select(F.struct("doc_id", "path", "text_key").alias("key"), "path", "text")).withColumn("digest", F.md5("header")), "licence-headers")
    best = scores(found, templates).filter(F.col("score") >= threshold)
    ranked = F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "license"))
    is_line = F.col("kind") == "line"
    # rows that repeat have their lines several times over
    rows_of = rows.select(F.struct("doc_id", "path", "text_key").alias("key")).groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    share = F.sum(F.when(is_line, F.col("share")).otherwise(0.0))
    as_whole = F.max((F.col("kind") == "text") & F.col("score").isNotNull())
    stated = F.max(is_line & F.col("header").rlike("(?i)" + STATED))
    own = found.join(best, "digest", "left").groupBy("key").agg(F.min(ranked).alias("best"), stated.alias("stated"), share.alias("share"), as_whole.alias("as_whole"))
    own = own.join(rows_of, "key", "left").withColumn("share", F.when(F.col("as_whole"), 1.0).otherwise(F.col("share") / F.coalesce("times", F.lit(1))))
    own = own.select(F.col("key.doc_id").alias("_d"), F.col("key.path").alias("_p"), F.col("key.text_key").alias("_k"), F.col("best.license").alias("own_license"), (-F.col("best.s")).alias("own_score"), "share", "stated")
    own, _ = written(own, "licence-own")
    drop_table(docs.sparkSession, found_at)
    slim = rows.select("doc_id", "path", "text_key")
    met = slim["doc_id"].eqNullSafe(own["_d"]) & (slim["path"] == own["_p"]) & (slim["text_key"] == own["_k"])
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    every = slim.join(own, met, "left").select("doc_id", "path", "own_license", "own_score", F.coalesce("stated", F.lit(False)).alias("stated"), directory.alias("directory"))
    name = F.lower(F.element_at(F.split("_p", "/"), -1))
    files = own.filter("own_license is not null").filter(name.rlike(FILE_NAMES) | (F.col("share") >= file_share)).select(F.regexp_extract("_p", r"^(.*)/[^/]*$", 1).alias("above"), F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("license"), F.col("_p").alias("path")).alias("file"))
    files = files.groupBy("above").agg(F.min("file").alias("file")).select("above", F.col("file.license").alias("file_license"))
    # directories and all those above them, the root being the empty path
    parts = F.split("directory", "/")
    depths = F.when(F.col("directory") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    above = slim.select(directory.alias("directory")).distinct().withColumn("depth", F.explode(depths)).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(files, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "file_license")).alias("near"))
    nearest, _ = written(nearest, "licence-directories")
    nearest = F.broadcast(nearest) if nearest.count() <= DIRECTORIES else nearest.hint("merge")
    out = every.join(nearest, "directory", "left")
    inherits = F.col("own_license").isNull() & ~F.col("stated")
    return out.select("doc_id", "path", "own_license", "own_score", F.when(inherits, F.col("near.file_license")).otherwise(F.col("own_license")).alias("license"), F.when(inherits, F.col("near.above")).alias("inherited_from"))
