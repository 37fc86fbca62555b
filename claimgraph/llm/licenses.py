"""License scans (DataFrame operations only): sparse TF-IDF cosine to templates, then inheritance from directories.

A file's candidate statements are its headers (neighbouring paragraphs that name a licence, comment marks stripped), their
paragraphs, and their sentences and lines that name a licence (all of a licence file's text is one more). A header that is like
a template goes before its paragraphs, and these before their lines; of several headers the most alike counts.
Equal statements are scored once: their words, weighted by tf-idf with document frequencies over the templates, so that a
header scores alike in any corpus, are compared with every template by cosine. A file without a licence of its own takes that of
the nearest ancestor directory with a licence file, found by joining each file's ancestors with the directories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, written

#: Licence notices as they are commonly written, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3. AGPL-3.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution."),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. BSD Zero Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License. Simplified BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. New BSD License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License. CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal public domain dedication."),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0. You may not use this file except in compliance with the License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, EUPL, version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2."),
    ("GPL-2.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. ISC License."),
    ("LGPL-2.1", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 2.1."),
    ("LGPL-2.1-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the Software without restriction. MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. The Software is provided as is, without warranty of any kind. MIT No Attribution."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MS-PL", "This source is subject to the Microsoft Public License. MS-PL. All other rights reserved."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. The Unlicense."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "This program is free software. It comes without any warranty. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely. zlib License."),
)
TRIGGER = r"(?i)licen[sc]|copyright|spdx|public\s+domain|free\s+software|redistribut|permission\s+is\s+hereby|waived\s+all|creative\s+commons|CC[ -]BY"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([-_.](txt|md|rst|html|lesser|[a-z]*[0-9.]*(clause)?))*$"
LEAST = 0.55
OUTPUTS = ("license", "score", "origin", "from_path")


def _terms(text: Column) -> Column:
    """Lower-case words and version numbers, ends of sentences dropped."""
    found = F.regexp_extract_all(ascii_lower(text), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return found


def _weights(rows: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """(key, term, tf) to unit vectors (key, term, w); a term that no template has weighs as little as one that all have."""
    idf = F.when(F.col("df").isNull(), 1.0).otherwise(F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    weighed = rows.join(F.broadcast(df), "term", "left").withColumn("w", (1 + F.log("tf")) * idf)  # df: the templates' words
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return weighed.select("key", "term", (F.col("w") / norm).alias("w"))


def similar(statements: DataFrame, least: float = LEAST) -> DataFrame:
    """statements (key, statement), each once, to (key, license, score): the nearest template, if its cosine is least at least.

    Ties go to the identifier that sorts first.
    """
    spark = statements.sparkSession
    templates = spark.createDataFrame([(f"template {i}", name, text) for i, (name, text) in enumerate(TEMPLATES)], "key string, license string, statement string")
    both = statements.select("key", "statement").union(templates.select("key", "statement"))
    tf = written(both.select("key", F.explode(_terms(F.col("statement"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf")), "license-terms")
    is_template = F.col("key").startswith("template ")
    df = tf.where(is_template).groupBy("term").agg(F.count("*").alias("df"))
    vectors = _weights(tf, df, len(TEMPLATES))
    known = written(vectors.where(is_template).join(templates.select("key", "license"), "key").select(F.col("key").alias("template"), "license", "term", F.col("w").alias("v")), "license-templates")
    dots = vectors.where(~is_template).join(F.broadcast(known), "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("score"))  # known: a few hundred rows
    best = dots.groupBy("key").agg(F.max(F.struct(F.round("score", 9).alias("score"))).alias("b"), F.collect_list(F.struct(F.round("score", 9).alias("score"), "license")).alias("all"))
    first = F.array_min(F.transform(F.filter("all", lambda x: x["score"] == F.col("b.score")), lambda x: x["license"]))
    return best.select("key", first.alias("license"), F.col("b.score").alias("score")).where(F.col("score") >= least)


def _ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, with their distance; '' is the top."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.struct((F.size(parts) - k).alias("far"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))


def _statements(text: Column) -> Column:
    """Array of (run, level, statement): of each run of paragraphs that hold a trigger the whole (3), the paragraphs (2) and
    the sentences and lines with a trigger (1). A paragraph also ends where marked comment lines begin or end."""
    marked = F.regexp_replace(text, r"(?m)^[ \t]*(?:/\*+|<!--+|[\"']{3}|\*+/?)|[ \t]*(?:\*+/|--+>)[ \t]*$", "\x02")
    marked = F.regexp_replace(marked, r"(?m)^[ \t]*(?:#+|//+|;+|--+|%+)", "\x01")
    marked = F.regexp_replace(marked, r"(?m)^(\x01.*)\n(?=[^\x01\x02\n])", "$1\n\n")
    marked = F.regexp_replace(marked, r"(?m)^([^\x01\x02\n].*)\n(?=\x01)", "$1\n\n")
    paragraphs = F.split(F.translate(marked, "\x01\x02\x03\x04", ""), r"\n(?:[ \t\r]*\n)+")
    held = F.array_join(F.transform(paragraphs, lambda x: F.when(x.rlike(TRIGGER), x).otherwise(F.lit("\x03"))), "\x04")
    runs = F.filter(F.split(held, "\x03"), lambda x: x.rlike(TRIGGER))
    plain = lambda x: F.btrim(F.regexp_replace(x, r"[\s\x04]+", " "), F.lit(SPACES + "#*/-"))

    def of(run: Column, k: Column) -> Column:
        lines = F.filter(F.split(run, r"[\n\x04]|(?<=[.!?;])[ \t]+(?=[A-Z#*/])"), lambda x: x.rlike(TRIGGER))
        row = lambda level, x: F.struct(k.alias("run"), F.lit(level).alias("level"), plain(x).alias("statement"))
        parts = F.concat(F.transform(F.split(run, "\x04"), lambda x: row(2, x)), F.transform(lines, lambda x: row(1, x)))
        return F.concat(F.array(row(3, run)), F.filter(parts, lambda x: (x["statement"] != plain(run)) & x["statement"].rlike(TRIGGER)))

    return F.flatten(F.transform(runs, of))


def scan(files: DataFrame, path: str = "path", text_col: str = "text", license_file: Column | None = None, least: float = LEAST, keep: list[str] | None = None) -> DataFrame:
    """files (or its columns `keep`) with license, score, origin ('file', 'header', 'inherited' or null) and from_path.

    license_file: which rows are their directory's licence file (by base name unless given). Of several in a directory,
    the highest score counts, then the smallest path. Null and empty texts have no licence of their own; a null path inherits
    nothing. Repeated rows each get a row. An empty table gives no rows. Input columns named like an output are replaced.
    """
    names = [c for c in (files.columns if keep is None else keep) if c.lower() not in OUTPUTS]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    is_file = F.coalesce(F.element_at(F.split(F.col(f"`{path}`"), "/"), -1).rlike(LICENSE_FILE) if license_file is None else license_file, F.lit(False))
    shape = "array<struct<run:int,level:int,statement:string>>"
    whole = F.array(F.struct(F.lit(-1).alias("run"), F.lit(1).alias("level"), F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(SPACES + "#*/-")).alias("statement"))).cast(shape)
    found = F.when(text.rlike(TRIGGER), F.concat(_statements(text).cast(shape), F.when(is_file, whole).otherwise(F.array().cast(shape)))).otherwise(F.array().cast(shape))
    base = files.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{path}`").alias("path"), is_file.alias("is_file"), F.array_distinct(found).alias("found")).withColumn("id", F.monotonically_increasing_id())
    base = written(base, "license-files")
    mention = base.select("id", F.inline("found")).withColumn("key", F.sha2("statement", 256))
    scored = written(similar(mention.select("key", "statement").dropDuplicates(["key"]), least), "license-scores")
    headers = mention.select("id", "run", "level", "key").join(scored, "key").groupBy("id", "run").agg(F.max(F.struct("level", "score", "license")).alias("h"))
    own = headers.groupBy("id").agg(F.max(F.struct(F.col("h.score").alias("score"), F.col("h.license").alias("license"))).alias("own"))
    judged = written(base.drop("found").join(own, "id", "left"), "license-own")
    parents = F.regexp_replace("path", r"/?[^/]*$", "")
    held = judged.where("is_file and own is not null and path is not null").select(parents.alias("dir"), F.col("own.score").alias("score"), F.col("own.license").alias("license"), F.col("path").alias("from_path"))
    dirs = held.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("back"), "from_path", "license")).alias("d"))
    without_own = judged.where("own is null and path is not null").select("id", "path")
    # Files of a directory share their ancestors, so ancestors are joined once per directory, not per file.
    places = without_own.select(parents.alias("place")).distinct()
    up = places.select("place", F.explode(_ancestors(F.concat("place", F.lit("/x")))).alias("a")).select("place", "a.far", F.when(F.col("place") == "", F.lit("")).otherwise(F.col("a.dir")).alias("dir"))
    nearest = up.join(dirs, "dir").groupBy("place").agg(F.min(F.struct("far", "d")).alias("n")).select("place", F.col("n.d").alias("d"))
    # Written, so that a directory with a third of all files can be split in the join; own licences do not look at what is found.
    out = judged.withColumn("place", parents).join(written(nearest, "license-places"), "place", "left")
    own_col, inherited = F.col("own").isNotNull(), F.col("d").isNotNull()
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        F.coalesce("own.license", "d.license").alias("license"),
        F.coalesce("own.score", -F.col("d.back")).alias("score"),
        F.when(own_col & F.col("is_file"), "file").when(own_col, "header").when(inherited, "inherited").alias("origin"),
        F.when(own_col, F.col("path")).otherwise(F.col("d.from_path")).alias("from_path"),
    )
