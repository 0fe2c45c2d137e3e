"""License scans with DataFrame functions only: a sparse n-gram logistic regression over paragraphs, with an unknown
class, whose predictions a comparison with the family's templates confirms.

The model is small and fixed by the templates below: it is fitted on the driver from them and from negatives made of
their words and of plain prose, never from the corpus. Scoring is a join of the paragraphs' n-grams with its weights.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Notices of the licence families: titles, grants and first sentences of their terms, and names in short.
TEMPLATES = {
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Zero-Clause BSD License.", "SPDX-License-Identifier: 0BSD"),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GNU Affero General Public License version 3.", "Licensed under the AGPLv3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0"),
    "Artistic-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", "Licensed under the Artistic License.", "SPDX-License-Identifier: Artistic-2.0"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "This software is released under the BSD License.", "Available under the BSD terms.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-NC-ND": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal public domain dedication.", "SPDX-License-Identifier: CC0-1.0"),
    "CDDL-1.0": ("The contents of this file are subject to the terms of the Common Development and Distribution License.", "Licensed under the CDDL 1.0.", "SPDX-License-Identifier: CDDL-1.0"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "EUPL-1.2": ("Licensed under the EUPL, Version 1.2 or later.", "Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2"),
    "GFDL-1.3": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3.", "Licensed under the GNU Free Documentation License.", "SPDX-License-Identifier: GFDL-1.3-only"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GPL version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "Released under the GPLv2 or later.", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Released under the GPLv3 or later.", "SPDX-License-Identifier: GPL-3.0-only"),
    "ISC": ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License.", "Licensed under the LGPL.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the terms of the Mozilla Public License.", "SPDX-License-Identifier: MPL-2.0"),
    "MS-PL": ("This license governs use of the accompanying software. If you use the software, you accept this license.", "Licensed under the Microsoft Public License.", "SPDX-License-Identifier: MS-PL"),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the SIL Open Font License.", "SPDX-License-Identifier: OFL-1.1"),
    "PSF-2.0": ("Licensed under the Python Software Foundation License Version 2.", "SPDX-License-Identifier: PSF-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"),
    "WTFPL": ("Licensed under the WTFPL version 2.", "SPDX-License-Identifier: WTFPL"),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved.", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
#: Plain sentences for the unknown class, some with licence words in other senses.
PROSE = (
    "The driver lost his license after the accident.", "All people have equal rights under the law.", "A table was reserved for four people.", "The public was invited to the general meeting.",
    "Version 3 of the program adds new features.", "The author of the book wrote the following chapter.", "Students at MIT built a new machine.", "She studied physics at MIT for three years.", "The source of the river is in the mountains.",
    "She released the film last year.", "This work is subject to change.", "You need a license to fish in this river.", "He was granted permission to leave.", "The library is open to any person free of charge.",
    "The artistic director opened the public foundation.", "A boost in sales is expected by the authors of the report.", "The eclipse was seen in the European Union.", "The font of the document is in the first version.",
    "Any use of this road is at your own risk.", "The zero clause in the contract was removed.", "Python is a programming language.", "The board shall publish copies of the report in writing.", "No license is required to modify your house.",
    "The terms of the contract were agreed in public.", "The sale is subject to the terms of the agreement.", "Licensed under the Sample License 2.0.", "Licensed under the terms of the vendor license.", "Distributed under the house license, version 1.",
    "See the file LICENSE for details.", "All copies of the notice were distributed to the workers.",
)
#: Frequent words: n-grams of these alone are no features of the model.
COMMON = "the and that this you or all by for to of a in is with are may not has any use free public version without an as at be can from if it no on one our out under was we which who will 0 1 2 3 4".split()
UNKNOWN, GRAMS = "unknown", (1, 2, 3)
#: What ends a paragraph: blank lines, and a newline behind a sentence's end. A line that ends otherwise is wrapped and goes
#: on in the next one. Each run of blanks is tried from its first character only and never given back.
PARAGRAPHS = r"(?<![ \t\r])[ \t\r]*+\n(?:[ \t\r]*+\n)+|(?<=[.!?:;])[ \t\r]*+\n"
#: Share of a template's n-grams that a paragraph must hold to confirm a prediction.
CONFIRMED = 0.7
SEED = 11


def grams(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in GRAMS for i in range(len(words) - n + 1)})


def tokens(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", "".join(c.lower() if c.isascii() else c for c in text))


@lru_cache(maxsize=1)
def model() -> tuple[list[str], list[str], np.ndarray, np.ndarray, float]:
    """Families (the unknown class last), n-grams, weights (n-grams x families), biases and the temperature that
    calibrates probabilities on held-out variants."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    families = [*TEMPLATES, UNKNOWN]
    known = [(tokens(t), i) for i, f in enumerate(TEMPLATES) for t in TEMPLATES[f]]
    prose = [tokens(t) for t in PROSE]
    pool = [w for ws, _ in known for w in ws]
    rows: list[tuple[list[str], int]] = []
    for ws, i in known:
        rows += [(ws, i)] * 4
        for _ in range(14):  # variants: words in front and behind, a name and a year, one word lost
            noise = [prose[k][j] for k, j in ((rng.integers(len(prose)), 0), (rng.integers(len(prose)), -1))]
            kept = [w for w in ws if len(ws) < 6 or rng.random() > 0.06]
            rows.append(([*noise[: rng.integers(3)], *kept, *noise[: rng.integers(2)]], i))
    rows += [(p, len(families) - 1) for p in prose for _ in range(12)]
    for _ in range(700):  # licence words in no order
        rows.append(([str(w) for w in rng.choice(pool, rng.integers(2, 14))], len(families) - 1))
    rows += [([w], len(families) - 1) for w in sorted(set(pool) - set(COMMON))]  # nor does a word alone, unless it names a family
    names = sorted({g for ws, _ in known for g in grams(ws) if not set(COMMON).issuperset(g.split())})
    at = {g: k for k, g in enumerate(names)}
    x, y = np.zeros((len(rows), len(names)), dtype=np.float32), np.array([i for _, i in rows])
    for r, (ws, _) in enumerate(rows):
        found = [at[g] for g in grams(ws) if g in at]
        x[r, found] = 1 / np.sqrt(max(1, len(found)))
    part = rng.random(len(rows)) < 0.8
    w, b = np.zeros((len(names), len(families)), dtype=np.float32), np.zeros(len(families), dtype=np.float32)
    target, fitted = np.eye(len(families), dtype=np.float32)[y][part], x[part]
    for step in range(300):
        z = fitted @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - target) / len(target)
        rate = np.float32(40.0 / (1 + step / 200))
        w -= rate * (fitted.T @ d + np.float32(1e-5) * w)
        b -= rate * d.sum(0)
    w, b = w.astype(np.float64), b.astype(np.float64)
    z = x[~part] @ w + b

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(s)), y[~part]] - np.log(np.exp(s).sum(1))).mean())

    return families, names, w, b, min((0.25 * 1.2**k for k in range(16)), key=loss)


@lru_cache(maxsize=1)
def terms() -> str:
    """A regular expression for the paragraphs (in lower case) that may belong to a family: the model's words but for a set
    whose n-grams, in whatever number and choice, leave the unknown class ahead of every family. It loses nothing."""
    _, names, w, b, _ = model()
    lead, behind = w[:, :-1] - w[:, -1:], b[-1] - b[:-1]

    def unknown_wins(words: set[str]) -> bool:
        at = [k for k, g in enumerate(names) if words.issuperset(g.split())]
        best = np.cumsum(-np.sort(-lead[at], axis=0), axis=0)  # of n n-grams, for each family
        return bool((behind > 1e-6).all() and (best < behind * np.sqrt(np.arange(1, len(at) + 1))[:, None] - 1e-6).all())

    single = {g: k for k, g in enumerate(names) if " " not in g}
    idle = set(COMMON)  # these may stand between others in an n-gram
    for word in sorted(single, key=lambda g: ((lead[single[g]] - behind).max(), g)):
        if unknown_wins(idle | {word}):
            idle.add(word)
    return rf"(?<![0-9a-z])(?:{'|'.join(sorted(single.keys() - idle))})(?![0-9a-z])"


def __getattr__(name: str) -> str:
    if name == "TERMS":  # fits the model, so not on import
        return terms()
    raise AttributeError(name)


def words_of(paragraph: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(paragraph), F.lit("[0-9a-z]+"), F.lit(0))


def grams_of(words: Column) -> Column:
    none = F.array().cast("array<string>")
    parts = [F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), _joined(words, n))).otherwise(none) for n in GRAMS]
    return F.array_distinct(F.concat(*parts))


def _joined(words: Column, n: int):
    return lambda i: F.concat_ws(" ", *[F.get(words, i + (k - 1)) for k in range(n)])


def scan(docs: DataFrame, confirmed: float = CONFIRMED) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_share, confirmed): the paragraphs (of the whole text,
    counted from 0) that the classifier gives to a licence family.

    Texts are cut at PARAGRAPHS; null and empty texts have no paragraphs; a paragraph of equal probabilities goes to the
    first family in the order of the templates; repeated rows give repeated results; an empty table gives no rows.
    `template_share` is the largest share of one of the family's templates' n-grams that the paragraph holds.
    """
    spark = docs.sparkSession
    families, names, w, b, heat = model()
    lines = docs.select(F.col("doc_id").alias("doc_id"), F.posexplode(F.split("text", PARAGRAPHS, -1)).alias("paragraph", "line"))
    near = lines.where(ascii_lower(F.col("line")).rlike(terms())).select("doc_id", "paragraph", words_of(F.col("line")).alias("words"))
    # words are a column of their own: inside the n-grams' lambda (or in a filter on them, which Spark pushes down) they
    # would be extracted anew for every n-gram
    near = near.select("doc_id", "paragraph", grams_of(F.col("words")).alias("grams"))
    # one row per n-gram of the model: its weights, and the templates that hold it (fixed size: bounded by the templates)
    held = {g: [] for g in names}
    templates = [(f, k, [g for g in grams(tokens(t)) if g in held]) for f in TEMPLATES for k, t in enumerate(TEMPLATES[f])]
    for i, (_, _, gs) in enumerate(templates):
        for g in gs:
            held[g].append(i)
    weights = spark.createDataFrame([(g, [float(v) for v in w[k]], held[g]) for k, g in enumerate(names)], "gram string, weights array<double>, templates array<int>")
    spread = near.withColumn("at", F.monotonically_increasing_id()).select("doc_id", "paragraph", "at", F.explode("grams").alias("of_gram"))
    joined = spread.join(F.broadcast(weights), F.col("of_gram") == F.col("gram"))
    sums = [F.sum(F.get("weights", F.lit(i))).alias(f"s{i}") for i in range(len(families))]
    shares = [F.sum(F.array_contains("templates", i).cast("int")).alias(f"t{i}") for i in range(len(templates))]
    per = joined.groupBy("doc_id", "paragraph", "at").agg(F.count("*").alias("n"), *sums, *shares)
    logits = F.array(*[(F.col(f"s{i}") / F.sqrt("n") + float(b[i])) / heat for i in range(len(families))])
    share = F.array(*[F.greatest(F.lit(0.0), *[F.col(f"t{j}") / float(len(gs)) for j, (g, _, gs) in enumerate(templates) if g == f]) for f in TEMPLATES], F.lit(0.0))
    got = per.select("doc_id", "paragraph", logits.alias("z"), share.alias("share")).withColumn("top", F.array_max("z"))
    at = (F.array_position(F.col("z"), F.col("top")) - 1).cast("int")
    total = F.aggregate(F.transform("z", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda a, v: a + v)
    got = got.select("doc_id", "paragraph", F.get(F.array(*map(F.lit, families)), at).alias("family"), F.round(1 / total, 6).alias("probability"), F.get("share", at).alias("template_share"))
    return got.where(F.col("family") != UNKNOWN).select("*", (F.col("template_share") >= confirmed).alias("confirmed"))
