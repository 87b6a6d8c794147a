"""License scans in DataFrame operations: MinHash bands retrieve templates, shingles verify.

Texts and templates become words and five-word shingles.  The texts' shingles are joined with
those of the templates; what meets is a *hit*, a place in a text.  A text is read in windows of
``WINDOW`` words that begin every ``STRIDE`` words; a template in windows that begin at every
word, or whole if it is shorter.  A text's window inside a copy of a template is one of
the template's windows, and a template of up to ``WINDOW - STRIDE + 1`` words lies whole in
some window, with a Jaccard similarity of a third or more for eight words.  With ``BANDS``
bands of one hash such a window is retrieved with probability 1 - (2/3)^48 > 1 - 1e-8.

Windows are hashed by their hits only: shingles that no template has can't be the least hash
of a template, and without them windows are only more alike.  Retrieved templates are verified
by the exact share of their shingles in a stretch of their own length, counted by running
sums over the hits, so that the work grows with the hits however long a template is.

Where stretches of several templates overlap by more than half of the shorter one, the *best*
has the greatest share, then the most shingles.  Only *early* stretches are compared, which
begin so early in the template that the share can follow in its order; others begin in one
copy of a notice and end in the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetables.llm.common import pick, settled

SHINGLE = 5
WINDOW = 16
STRIDE = 8
BANDS = 48
#: Words of a block in which overlapping stretches meet.
BLOCK = 64
#: Share of a template's shingles that a match has.
CONTAINED = 0.8

#: Names, notices and texts of public licenses; the texts end in their disclaimers.
TEMPLATES: dict[str, str] = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "Apache-1.1-notice": "The Apache Software License, Version 1.1",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "Artistic-2.0": "Licensed under the Artistic License 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"
    ),
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-2.0": "This work is licensed under a Creative Commons Attribution 2.0 Generic License.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-name": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    ),
    "CC-BY-ND-4.0-name": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."
    ),
    "CC-BY-SA-3.0-name": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-name": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work."
    ),
    "EPL-1.0-notice": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License v1.0 which accompanies this distribution"
    ),
    "EPL-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at"
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "ISC-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted"
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-distributed": "Distributed under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction"
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "MPL-1.1-notice": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not "
        "use this file except in compliance with the License."
    ),
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "Zlib-text": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely"
    ),
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")


def _words(text: str) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def _shingles(words: str) -> Column:
    """Hash of every five words in a row; of all words where there are fewer."""
    n = F.greatest(F.lit(1), F.size(words) - SHINGLE + 1)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.when(F.size(words) > 0, each).otherwise(F.array().cast("array<bigint>"))


def _windows(shingles: str, first: Column) -> Column:
    """The shingles of the window that begins at word ``first`` (from 0)."""
    return F.slice(shingles, first + 1, WINDOW - SHINGLE + 1)


def _bands(shingles: str) -> Column:
    """(band, least hash) of a window's shingles, an array."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*(F.struct(F.lit(b).alias("band"), least(b).alias("least")) for b in range(BANDS)))


def _prepared(templates: DataFrame) -> DataFrame:
    rows = pick(templates, license="string", text="string").withColumn("words", _words("text"))
    rows = rows.where((F.size("words") > 0) & F.col("license").isNotNull()).withColumn("all_shingles", _shingles("words"))
    return rows.select(
        "license",
        F.size("words").alias("length"),
        "all_shingles",
        F.array_distinct("all_shingles").alias("wanted"),
        F.xxhash64("license", "text").alias("template"),
    )


def _once(value: Column, name: str) -> Column:
    """The value through a generator, so that later filters do not compute it again."""
    return F.explode(F.array(value)).alias(name)


def _hits(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc`` (id and hash of the text), ``i`` and ``h`` of every shingle that a template has.

    The templates' shingles are a table of known size, so that Spark broadcasts them while
    they are few and joins by shuffling beyond that.
    """
    texts = pick(docs, doc_id="bigint", text="string")
    texts = texts.select(F.struct("doc_id", F.xxhash64("text").alias("rid")).alias("doc"), "text")
    worded = texts.select("doc", _once(_words("text"), "words"))
    each = worded.select("doc", F.posexplode(_shingles("words")).alias("i", "h"))
    return each.join(wanted.select("h").distinct(), "h").select("doc", "i", "h").distinct()


def _retrieved(hits: DataFrame, known: DataFrame) -> DataFrame:
    """``doc`` and ``template`` of which a window of each shares a band."""
    firsts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all_shingles") - (WINDOW - SHINGLE + 1)))
    parts = known.select("template", "all_shingles", F.explode(firsts).alias("first"))
    parts = parts.select("template", _once(_windows("all_shingles", F.col("first")), "part"))
    retrieving = parts.select("template", F.explode(_bands("part")).alias("b"))
    retrieving = retrieving.select("template", "b.band", "b.least").distinct()
    # Windows that hold a hit: those that begin up to WINDOW - SHINGLE words before it.
    holding = F.sequence(
        F.greatest(F.lit(0), F.ceil((F.col("i") - (WINDOW - SHINGLE)) / STRIDE)).cast("int"),
        F.floor(F.col("i") / STRIDE).cast("int"),
    )
    windows = (
        hits.select("doc", "h", F.explode(holding).alias("no"))
        .groupBy("doc", "no")
        .agg(F.collect_set("h").alias("part"))
    )
    return (
        windows.select("doc", F.explode(_bands("part")).alias("b"))
        .select("doc", "b.band", "b.least")
        .join(retrieving, ["band", "least"])
        .select("doc", "template")
        .distinct()
    )


def license_stretches(docs: DataFrame, templates: DataFrame | None = None, contained: float = CONTAINED) -> DataFrame:
    """``doc``, ``template``, ``license``, ``first``, ``end``, ``containment``, ``size``, ``early`` of every stretch.

    A stretch begins at a hit, is as long as the template and has a share of ``contained`` or
    more of the template's shingles; ``end`` is where its last hit ends.
    """
    spark = docs.sparkSession
    known = settled(_prepared(default_templates(spark) if templates is None else templates), "templates")
    placed = known.select(
        "template", "license", "length", F.size("wanted").alias("size"),
        F.size("all_shingles").alias("places"), F.posexplode("all_shingles").alias("place", "h"),
    )
    early = F.min("place") <= F.col("places") - contained * F.col("size") + 1e-6
    wanted = settled(
        placed.groupBy("template", "license", "length", "size", "places", "h").agg(early.alias("early")),
        "template-shingles",
    )
    hits = settled(_hits(docs, wanted), "license-hits")
    mine = hits.join(_retrieved(hits, known), "doc").join(wanted, ["template", "h"])
    # A hit counts for the stretches that begin after the same shingle's last place and reach it.
    before = F.lag("i").over(W.partitionBy("doc", "template", "h").orderBy("i"))
    since = F.greatest(F.coalesce(before + 1, F.lit(0)), F.col("i") - F.col("length") + 1, F.lit(0))

    def event(pos: Column, more: int, asks: str | None = None, seen: Column | None = None) -> Column:
        return F.struct(
            pos.alias("pos"),
            F.lit(more).alias("more"),
            F.lit(asks).cast("string").alias("asks"),
            (F.lit(None) if seen is None else seen).cast("int").alias("seen"),
        )

    i = F.col("i")
    events = F.array(
        event(F.col("since"), 1), event(i + 1, -1), event(i, 0, "share", i), event(i + F.col("length") - 1, 0, "last")
    )
    upto = W.partitionBy("doc", "template").orderBy("pos").rangeBetween(W.unboundedPreceding, W.currentRow)
    ran = (
        mine.withColumn("since", since)
        .select("doc", "template", "license", "size", "early", "i", F.explode(events).alias("e"))
        .select("doc", "template", "license", "size", "early", "i", "e.*")
        .select(
            "doc", "template", "license", "size", "early", "i", "asks",
            F.sum("more").over(upto).alias("covered"), F.max("seen").over(upto).alias("latest"),
        )
    )
    return (
        ran.where("asks is not null")
        .groupBy("doc", "template", F.col("i").alias("first"))
        .agg(
            F.first("license").alias("license"),
            F.first("size").alias("size"),
            F.first("early").alias("early"),
            F.max(F.when(F.col("asks") == "share", F.col("covered"))).alias("covered"),
            (F.max(F.when(F.col("asks") == "last", F.col("latest"))) + SHINGLE).alias("end"),
        )
        .withColumn("containment", F.col("covered") / F.col("size"))
        .where(F.col("containment") >= contained)
        .select("doc", "template", "license", "first", "end", "containment", "size", "early")
    )


def license_matches(docs: DataFrame, templates: DataFrame | None = None, contained: float = CONTAINED) -> DataFrame:
    """``doc_id``, ``rid`` (hash of the text), ``license``, ``containment`` and ``best`` of every match.

    ``best``: one of the license's early stretches shares half of its words or less (or of the
    other's, if that is shorter) with each early stretch of another license that has a greater
    containment, or with the same one more shingles, or then the smaller name.
    """
    found = settled(license_stretches(docs, templates, contained), "license-stretches")
    early = found.where("early")
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("block")
    placed = early.select("*", blocks)
    other = placed.select(*(F.col(c).alias(f"o_{c}") for c in placed.columns))
    rank, o_rank = (F.struct(f"{o}containment", f"{o}size") for o in ("", "o_"))
    better = (o_rank > rank) | ((o_rank == rank) & (F.col("o_license") < F.col("license")))
    shared = F.least("end", "o_end") - F.greatest("first", "o_first")
    shorter = F.least(F.col("end") - F.col("first"), F.col("o_end") - F.col("o_first"))
    beaten = (
        placed.join(
            other,
            (F.col("doc") == F.col("o_doc")) & (F.col("block") == F.col("o_block"))
            & (F.col("license") != F.col("o_license")) & (2 * shared > shorter) & better,
            "left_semi",
        )
        .select("doc", "template", "first")
        .distinct()
    )
    best = early.join(beaten, ["doc", "template", "first"], "left_anti").select("doc", "license", F.lit(True).alias("best"))
    return (
        found.select("doc", "license", "containment", F.lit(False).alias("best"))
        .unionByName(best.withColumn("containment", F.lit(0.0)))
        .groupBy("doc", "license")
        .agg(F.max("containment").alias("containment"), F.max("best").alias("best"))
        .select("doc.doc_id", "doc.rid", "license", "containment", "best")
    )


def license_scan(docs: DataFrame, templates: DataFrame | None = None, contained: float = CONTAINED) -> DataFrame:
    """``doc_id``, ``n_licenses``, ``licenses`` and ``best`` (both sorted, comma-joined) of every row.

    ``licenses`` are all whose templates the text contains, ``best`` those of them that are
    the best in some stretch.  Null and empty texts have no license.  A null id is an id of its own;
    rows of one id and text have the same result and are all returned.  Templates without words
    or name are left out; two of one name count as one license.  Other columns are ignored.
    """
    found = (
        license_matches(docs, templates, contained)
        .groupBy(F.col("doc_id").alias("_doc"), F.col("rid").alias("_rid"))
        .agg(
            F.array_sort(F.collect_set("license")).alias("names"),
            F.array_sort(F.collect_set(F.when(F.col("best"), F.col("license")))).alias("best_names"),
        )
    )
    every = pick(docs, doc_id="bigint", text="string").select("doc_id", F.xxhash64("text").alias("rid"))
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("rid") == F.col("_rid")), "left")
    names, best = (F.coalesce(c, F.array().cast("array<string>")) for c in ("names", "best_names"))
    return joined.select(
        "doc_id",
        F.size(names).cast("bigint").alias("n_licenses"),
        F.concat_ws(",", names).alias("licenses"),
        F.concat_ws(",", best).alias("best"),
    )
