"""License scans: notices against templates by sparse TF-IDF cosine, then inheritance from the nearest directory."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# Identifiers of licences, and sentences by which files and their licence texts name them.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."],
    "MIT-0": ["Licensed under the MIT No Attribution License, MIT-0."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Distributed under Apache 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "Apache-1.1": ["Licensed under the Apache Software License, Version 1.1."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under GPL 3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under GPL 2.0.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-4-Clause": ["Licensed under the BSD 4-Clause License.", "All advertising materials mentioning features or use of this software must display the following acknowledgement."],
    "0BSD": ["Licensed under the Zero-Clause BSD License, 0BSD."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["Licensed under the zlib License.", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1; you may not use this file except in compliance with the License."],
    "EPL-2.0": ["Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"],
    "EPL-1.0": ["Licensed under the Eclipse Public License, version 1.0.", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution."],
    "CDDL-1.0": ["Licensed under the Common Development and Distribution License, version 1.0.", "The contents of this file are subject to the terms of the Common Development and Distribution License."],
    "EUPL-1.2": ["Licensed under the European Union Public Licence, EUPL, version 1.2."],
    "Artistic-2.0": ["Licensed under the Artistic License, version 2.0.", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."],
    "Artistic-1.0": ["Licensed under the Artistic License, version 1.0."],
    "AFL-3.0": ["Licensed under the Academic Free License, version 3.0."],
    "OSL-3.0": ["Licensed under the Open Software License, version 3.0."],
    "MS-PL": ["Licensed under the Microsoft Public License, Ms-PL."],
    "MS-RL": ["Licensed under the Microsoft Reciprocal License, Ms-RL."],
    "PSF-2.0": ["Licensed under the Python Software Foundation License, version 2."],
    "PostgreSQL": ["Licensed under the PostgreSQL License.", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted."],
    "NCSA": ["Licensed under the University of Illinois NCSA Open Source License."],
    "UPL-1.0": ["Licensed under the Universal Permissive License, UPL, version 1.0."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "ODbL-1.0": ["This database is made available under the Open Database License, ODbL 1.0."],
    "WTFPL": ["Do What The Fuck You Want To Public License, Version 2."],
    "BUSL-1.1": ["Licensed under the Business Source License 1.1."],
    "SSPL-1.0": ["Licensed under the Server Side Public License, version 1."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."],
}
TERM = re.compile(r"[a-z]+|[0-9]+")
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([.-][^/]*)?$"
#: Parts of a folder's files in the last join.
SALTS = 32
#: Cosines of different licences that are nearer than this decide nothing.
MARGIN = 0.02


def terms(text: str) -> Counter[str]:
    return Counter(TERM.findall(text.lower()))


VOCABULARY = sorted({t for notices in TEMPLATES.values() for n in notices for t in terms(n)})


def candidates(text: str) -> Iterator[str]:
    """Lines, and the paragraphs of more than one."""
    paragraph: list[str] = []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            paragraph.append(line)
            yield line
        else:
            if 1 < len(paragraph):
                yield " ".join(paragraph)
            paragraph = []


class Matcher:
    """Finds a text's best notice: (licence, cosine, share of the text's words in the notice).

    Notices are held to each line and paragraph whole, and to each window of their own number of words in it. Of equal
    cosines the longer notice counts. Where a notice of another licence comes within MARGIN on some of the same words, and
    its words are not all in the first, nothing is decided and the text has no licence. The share is that of the largest
    line, paragraph or window that reaches the threshold for the licence. Terms without idf weigh rare; those of what reaches the threshold are put into
    strange.
    """

    def __init__(self, idf: dict[str, float], rare: float, threshold: float = 0.6, strange: set[str] | None = None):
        self.idf, self.rare, self.threshold, self.strange = idf, rare, threshold, strange
        self.names, self.rows, self.sizes = [], [], []
        for name, notices in TEMPLATES.items():
            for n in notices:
                self.names.append(name)
                self.rows.append(_weights(terms(n), idf, rare))
                self.sizes.append(sum(terms(n).values()))
        self.index: dict[str, list[tuple[int, float]]] = {}
        for k, row in enumerate(self.rows):
            for t, w in row.items():
                self.index.setdefault(t, []).append((k, w))
        self.place = {t: i for i, t in enumerate(self.index)}
        self.squares = np.zeros((len(self.names), len(self.place) + 1))
        for k, row in enumerate(self.rows):
            for t, w in row.items():
                self.squares[k, self.place[t]] = w * w
        self.floor = threshold * threshold - 1e-9
        #: Of each notice its heaviest terms, so many that the squares of the others stay below the floor. By Cauchy and
        #: Schwarz a cosine is at most the norm of the weights of the terms that both hold, so what has none of these
        #: terms cannot reach the threshold.
        self.anchors: set[str] = set()
        for row in self.rows:
            rest = 0.0
            for t, w in sorted(row.items(), key=lambda x: (x[1], x[0])):
                rest += w * w
                if rest >= self.floor:
                    self.anchors.add(t)

    def spans(self, words: list[str]) -> Iterator[tuple[int, float, int, int]]:
        """(notice, cosine, first word, words) of the line or paragraph, and of its windows, where the threshold is reached."""
        counted = Counter(words)
        if self.anchors.isdisjoint(counted):
            return
        # By Cauchy and Schwarz again, now with all terms that both hold.
        at = np.array([self.place[t] for t in counted if t in self.place], np.int64)
        hopeful = np.flatnonzero(self.squares[:, at].sum(1) >= self.floor)
        if not len(hopeful):
            return
        whole = _weights(counted, self.idf, self.rare)
        code = None
        for k in hopeful.tolist():
            row, n = self.rows[k], self.sizes[k]
            s = sum(w * row[t] for t, w in whole.items() if t in row)
            if s >= self.threshold:
                if self.strange is not None:
                    self.strange.update(t for t in counted if t not in self.idf)
                yield k, float(s), 0, len(words)
            if n >= len(words):
                continue
            if code is None:
                code = np.array([self.place.get(t, len(self.place)) for t in words])
            total = np.cumsum(np.append(0, self.squares[k, code]))
            for x in np.flatnonzero(total[n:] - total[:-n] >= self.floor).tolist():
                part = Counter(words[x : x + n])
                s = sum(row.get(t, 0.0) * w for t, w in _weights(part, self.idf, self.rare).items())
                if s >= self.threshold:
                    if self.strange is not None:
                        self.strange.update(t for t in part if t not in self.idf)
                    yield k, float(s), x, n

    def __call__(self, text: str) -> tuple[str | None, float, float]:
        hits = []
        for at, c in enumerate(candidates(text)):
            hits += [(round(s, 9), self.sizes[k], -k, at, x, n) for k, s, x, n in self.spans(TERM.findall(c.lower()))]
        if not hits:
            return None, 0.0, 0.0
        score, size, k, *_ = max(hits)
        name, mine = self.names[-k], self.rows[-k].keys()
        first = [h for h in hits if h[:3] == (score, size, k)]
        for s, _, m, at, x, n in hits:
            if s > score - MARGIN and self.names[-m] != name and not self.rows[-m].keys() < mine and any(h[3] == at and h[4] < x + n and x < h[4] + h[5] for h in first):
                return None, score, 0.0
        return name, score, max(h[5] for h in hits if self.names[-h[2]] == name) / max(sum(terms(text).values()), 1)


def _weights(counted: Counter[str], idf: dict[str, float], rare: float) -> dict[str, float]:
    row = {t: (1 + np.log(n)) * idf.get(t, rare) for t, n in counted.items()}
    norm = np.sqrt(sum(w * w for w in row.values()))
    return {t: w / norm for t, w in row.items()} if norm else {}


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """(id, path, license, score, origin, source_path) of every row.

    Every line of every text is held to the templates (see Matcher).

    A file's own licence is that of the template with the largest TF-IDF cosine to one of its lines or paragraphs, or to
    as many successive words in one as the template has, if it reaches the threshold. Idf comes from how many of all
    texts hold a term. A file named as a licence file, or of which a notice makes up file_share, declares its directory's
    licence; of several the best score, then the smallest path. A file without its own takes that of the nearest
    directory above, by joins on the directories of its path. origin is own, inherited or null.

    Null and empty texts have no own licence, a null path no directory; repeated rows give repeated rows; other columns
    are ignored. Only counts of the templates' terms, and of those that stand beside what may be a notice, reach the driver.
    """
    spark = files.sparkSession
    scratch = C.Scratch(spark, "licenses")
    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))

    def holders(known: set[str]) -> dict[str, int]:
        """How many texts hold each of the terms; the empty one stands for all texts."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, held = 0, Counter()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    n += 1
                    if text:
                        held.update(known.intersection(TERM.findall(text.lower())))
            yield pa.RecordBatch.from_arrays([pa.array(["", *held]), pa.array([n, *held.values()], pa.int64())], ["term", "n"])

        return dict(rows.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n")).toLocalIterator())

    def weighed(counts: dict[str, int], held: list[str]) -> dict[str, float]:
        return {t: float(np.log((number + 1) / (counts.get(t, 0) + 1)) + 1) for t in held}

    counts = holders(set(VOCABULARY))
    number = counts.get("", 0)
    idf = weighed(counts, VOCABULARY)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strange: set[str] = set()
        best = Matcher(idf, 1.0, threshold, strange)  # no term weighs less: what fails now fails with all counts
        for batch in batches:
            for t in batch.column("text").to_pylist():
                if t:
                    best(t)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(strange), pa.string())], ["term"])

    strange = [r["term"] for r in rows.select("text").mapInArrow(beside, "term string").distinct().toLocalIterator()]
    if strange:
        idf |= weighed(holders(set(strange)), strange)
    shared = spark.sparkContext.broadcast((idf, float(np.log(number + 1) + 1), threshold))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Matcher(*shared.value)
        for batch in batches:
            found = [best(t) if t else (None, 0.0, 0.0) for t in batch.column("text").to_pylist()]
            own = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("path"), pa.array(own, pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())], ["id", "path", "own", "score", "share"]
            )

    told = scratch.write(rows.mapInArrow(match, f"id {kind}, path string, own string, score double, share double"), "told")
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    declared = told.where(F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(FILE_NAME) | (F.col("share") >= file_share)))
    declared = declared.groupBy(parent.alias("dir")).agg(F.min_by(F.struct("own", "score", "path"), F.struct(-F.col("score"), "path")).alias("d"))
    told = told.withColumn("dir", F.when(F.col("path").isNotNull(), parent))
    seen = told.where("own is null and dir is not null").select(F.col("dir").alias("of")).distinct()
    parts = F.split("of", "/")
    above = seen.select("of", F.explode(F.when(F.col("of") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth"), parts.alias("parts"))
    above = above.select("of", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("dir"))
    nearest = scratch.write(above.join(declared, "dir").groupBy(F.col("of").alias("dir")).agg(F.max_by("d", "depth").alias("d")), "nearest")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")  # a folder may hold a large share of all files
    told = told.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return told.join(nearest.select("dir", "d", salt), ["dir", "salt"], "left").select(
        "id",
        "path",
        F.coalesce("own", F.when(F.col("own").isNull(), F.col("d.own"))).alias("license"),
        F.when(F.col("own").isNotNull(), F.col("score")).otherwise(F.col("d.score")).alias("score"),
        F.when(F.col("own").isNotNull(), F.lit("own")).when(F.col("d.own").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("d.path")).alias("source_path"),
    )
