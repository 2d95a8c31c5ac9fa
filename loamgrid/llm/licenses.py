"""License scans by MinHash bands over overlapping windows.

Documents and templates are cut into overlapping windows of WINDOW word
shingles, and windows that agree in a MinHash band retrieve templates; a band is
the least hash of a window in one of BANDS orders. A whole copy of a template of
WINDOW + STEP - 1 shingles or more holds one of its windows whole, which agrees
in all bands; a shorter template meets a window that shares three in five of
their shingles, so that it is missed with a probability of 0.4 ** BANDS.
Templates of fewer than WINDOW shingles are retrieved by windows of one shingle,
whose bands all agree or all differ, and those of fewer than SHINGLE words have
shingles of their own length. Of what is retrieved, those match whose shingles
the document contains to a large part, counted exactly. Only DataFrame functions
are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import table
from loamgrid.llm.decontam import bound, grams, grams_of, hashes_of, with_found, words_of
from loamgrid.llm.linking import sized
from loamgrid.session import durable

#: Words in a shingle; bands of one hash; least containment.
SHINGLE, BANDS, CONTAINMENT = 5, 8, 0.8
#: Shingles in a window, and from one window's start to the next one's in documents.
WINDOW, STEP = 8, 4

#: Fixed texts: notices by which works state their license.
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mit-short": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
}


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(license_id, text), as constants of the plan."""
    rows = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in templates.items()])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.*")


def in_order(band: int) -> Callable[[Column], Column]:
    """Puts hashes into another order for each band, by exclusive or."""
    x = (band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return lambda h: h.bitwiseXOR(F.lit(x - (1 << 64) if x >> 63 else x))


def band_keys(shingles: Column, step: int) -> Column:
    """A key for each band of each window of ``shingles``, ``step`` apart, and of one that ends with the last; one window if there are few."""
    last = F.greatest(F.size(shingles) - (WINDOW - 1), F.lit(1))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(step)), F.array(last)))
    least = lambda w: F.array(*[F.xxhash64(F.lit(k), F.array_min(F.transform(w, in_order(k)))) for k in range(BANDS)])
    keys = F.flatten(F.transform(starts, lambda i: bound(F.slice(shingles, i, WINDOW), least)))
    return F.when(F.size(shingles) > 0, keys).otherwise(F.array().cast("array<bigint>"))


def single_keys(shingles: Column) -> Column:
    return F.transform(shingles, lambda x: F.xxhash64(F.lit("single"), x))


def scan_licenses(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, text_hash, license_id, n_shared, n_template, containment) of documents and the templates they contain.

    ``templates(license_id, text)``. Templates without a word and null or empty
    texts match nothing. Rows that repeat a doc_id and a text count once.
    Documents without a match have no row.
    """
    key = ["doc_id", "text_hash"]
    words = templates.select("license_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    words = durable(words.withColumn("length", F.least(F.size("words"), F.lit(SHINGLE))))
    short = sorted(r["length"] for r in words.where(F.col("length") < SHINGLE).select("length").distinct().collect())
    sizes = [SHINGLE, *short]
    own = F.coalesce(*[F.when(F.col("length") == n, bound(hashes_of(F.col("words")), grams_of(n))) for n in sizes])
    known = durable(words.select("license_id", own.alias("in_order"), F.array_distinct(own).alias("of_template")))
    long_enough = F.size("in_order") >= WINDOW
    wanted = known.select("license_id", F.explode(F.when(long_enough, band_keys(F.col("in_order"), 1)).otherwise(single_keys(F.col("in_order")))).alias("key")).distinct()

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sets = lambda h: F.struct(grams(h, SHINGLE).alias("shingles"), F.concat(*[grams(h, n) for n in sizes]).alias("all"))
    keys = lambda s: F.concat(band_keys(s["shingles"], STEP), single_keys(s["all"]))
    every = texts.select(*key, F.explode_outer(bound(bound(hashes_of(words_of(F.col("text"))), sets), keys)).alias("key"))
    retrieved = durable(every.join(sized(wanted), "key").select(*key, "license_id").distinct())

    asked = retrieved.groupBy(*key).agg(F.collect_list("license_id").alias("licenses"))
    again = with_found(texts, asked).select(*key, "licenses", bound(bound(hashes_of(words_of(F.col("text"))), sets), lambda s: F.array_distinct(s["all"])).alias("all"))
    pairs = again.select(*key, F.explode("licenses").alias("license_id"), "all").join(sized(known.select("license_id", "of_template")), "license_id")
    counted = pairs.select(*key, "license_id", F.size(F.array_intersect("all", "of_template")).cast("long").alias("n_shared"), F.size("of_template").cast("long").alias("n_template")).distinct()
    return counted.where(F.col("n_shared") >= CONTAINMENT * F.col("n_template")).withColumn("containment", F.round(F.col("n_shared") / F.col("n_template"), 6))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), template_table(spark)).drop("text_hash")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH t(license_id, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}),
ts AS (SELECT DISTINCT license_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT license_id, w, unnest(range(1, len(w) - 3)) AS p FROM (SELECT license_id, {_WORDS} AS w FROM t) WHERE len(w) >= 5)),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 5)),
tn AS (SELECT license_id, count(*) AS n_template FROM ts GROUP BY license_id)
SELECT doc_id, license_id, count(*) AS n_shared, n_template, round(count(*) / n_template, 6) AS containment
FROM ds JOIN ts USING (s) JOIN tn USING (license_id) GROUP BY doc_id, license_id, n_template HAVING count(*) >= 0.8 * n_template
"""
