"""Operator 11: license texts in documents by diagonal voting.

Every k-gram of words of every document is hashed and joined by Spark with the hashes of the templates' k-grams. A hit at word
w of a document and word t of a template votes for the diagonal w - t, where the template would begin. Votes are grouped by
diagonal; neighbouring diagonals of a template (words inserted or left out move the rest by as much) are merged; and a
merged span is verified by how many of the template's words its equal k-grams, compared as text, cover. A span is taken
from ``COVERAGE`` on. A phrase is a template whose diagonals are not merged and which has to be covered whole: a place where
its words stand one after the other.

Words are runs of ASCII letters (A-Z as a-z), digits and code points beyond ASCII. The templates are few and short, whatever the
number of documents; their table is broadcast up to ``BROADCAST_ROWS`` rows, a counted size, and joined by a shuffle beyond.

Edge cases: a null or empty text has no words, no spans and score 0; repeated rows get the same spans and stay as many rows;
rows without an id are kept apart by their texts; an empty table gives no rows; other columns are ignored. Texts of any
length are read in pieces. Spans of one document are gathered in one row, so their number is limited by its own text.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionspark.llm.common import ship_package
from motionspark.llm.words import blanked, pieces

GRAM = 3
#: Share of a template's words from which a merged span is taken.
COVERAGE = 0.8
#: Neighbouring diagonals are this many words apart at most, or a tenth of the template.
SHIFT = 3
BROADCAST_ROWS = 200_000
WORD = blanked((string.ascii_letters + string.digits).encode())

#: The phrases of the base rules and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public license texts, or the notice by which a license asks to be named.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
        the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software."""),
    ("mit", "Released under the MIT License."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of
        source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
        Software Foundation; either version 3 of the License, or (at your option) any later version."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
        at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


TEMPLATES = tuple(Template(label, text, True) for text, label in PHRASES.items()) + tuple(Template(label, text) for label, text in TEXTS)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD).split()


def gram_array(words: bytes, k: int) -> pa.Array:
    """The k-grams of ``words``, which end in one blank each: strings of k words that end in a blank."""
    ends = np.flatnonzero(np.frombuffer(words, np.uint8) == 32) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    each = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words)])
    if len(each) < k:
        return each[:0]
    return pc.binary_join_element_wise(*(each[i : len(each) - k + 1 + i] for i in range(k)), b"")


def template_grams(spark: SparkSession, templates, k: int = GRAM) -> DataFrame:
    """template, label, phrase, size (words), shift, at (word of the template), template_gram, h. A template of fewer than k words is an error."""
    rows = []
    for i, t in enumerate(templates):
        words = words_of(t.text)
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {t.text}")
        shift = 0 if t.phrase else max(SHIFT, len(words) // 10)
        rows += [(i, t.label, t.phrase, len(words), shift, at, (b" ".join(words[at : at + k]) + b" ").decode("utf-8", "replace")) for at in range(len(words) - k + 1)]
    df = spark.createDataFrame(rows, "template int, label string, phrase boolean, size int, shift int, at int, template_gram string")
    df = df.withColumn("h", F.xxhash64("template_gram"))
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def document_grams(docs: DataFrame, id_col: str, text_col: str, k: int = GRAM, rows: int = 50_000) -> DataFrame:
    """doc_id, row_key (of the text and the task), word, gram: every k-gram of every text, and for each row one entry without a gram whose
    ``word`` is the number of words."""
    names, kinds = ["doc_id", "row_key", "word", "gram"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        task, held, size = TaskContext.get().partitionId(), [], 0

        def taken():
            ids = pa.array([x[0] for x in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), [len(x[2]) for x in held])))
            keys = np.repeat(np.array([x[1] for x in held]), [len(x[2]) for x in held])
            return pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array(np.concatenate([x[2] for x in held])), pa.concat_arrays([x[3] for x in held])], names=names)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = raw or b""
                row_key = np.array(xxh3_64_intdigest(raw, seed=task), np.uint64).astype(np.int64)
                n, tail = 0, b""
                for piece in pieces(raw.translate(WORD)):
                    words = piece.split()
                    if not words:
                        continue
                    joined = tail + b" ".join(words) + b" "
                    grams = gram_array(joined, k)
                    at = n - tail.count(b" ")
                    n += len(words)
                    held.append((doc_id, row_key, np.arange(at, at + len(grams)), grams))
                    tail = b"".join(w + b" " for w in joined.split()[-(k - 1) :]) if k > 1 else b""
                    size += len(grams)
                    if size >= rows:
                        yield taken()
                        held, size = [], 0
                held.append((doc_id, row_key, np.array([n]), pa.nulls(1, pa.binary())))
                size += 1
                if size >= rows:
                    yield taken()
                    held, size = [], 0
        if held:
            yield taken()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return texts.mapInArrow(run, ", ".join(f"{n} {'binary' if kind == pa.binary() else 'long'}" for n, kind in zip(names, kinds, strict=True)))


def scan(docs: DataFrame, templates=TEMPLATES, k: int = GRAM, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, score and spans of every row: spans are (first_word, end_word, label, phrase, coverage) in that order; score is the
    largest coverage of any template, taken or not."""
    ship_package(docs.sparkSession)
    known = template_grams(docs.sparkSession, templates, k)
    grams = document_grams(docs, id_col, text_col, k).withColumn("gram", F.col("gram").cast("string"))
    hits = grams.withColumn("h", F.when(F.col("gram").isNotNull(), F.xxhash64("gram"))).join(known, "h", "left").filter("gram is null or template is not null")

    row = ["doc_id", "row_key"]
    dealt = hits.select(*row, "word", "gram", "template", "label", "phrase", "size", "shift", "at", (F.col("gram") == F.col("template_gram")).alias("equal"), (F.col("word") - F.col("at")).alias("diagonal"))
    votes = dealt.repartition(*row).groupBy(*row, "template", "label", "phrase", "size", "shift", "diagonal").agg(
        F.count_if(F.col("gram").isNull()).alias("rows"), F.max(F.when(F.col("gram").isNull(), F.col("word"))).alias("n_words"), F.collect_set(F.when(F.col("equal"), F.col("at"))).alias("at")
    )
    along = Window.partitionBy(*row, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("shift"), F.lit(False))
    merged = votes.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(along)).groupBy(*row, "template", "label", "phrase", "size", "group").agg(
        F.sum("rows").alias("rows"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("first_word"), F.max(F.col("diagonal") + F.array_max("at") + k).alias("end_word"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + (k - 1)))))) / F.col("size")
    verified = merged.withColumn("coverage", covered)
    taken = F.when(F.col("coverage") >= F.when(F.col("phrase"), 1.0).otherwise(coverage), F.struct("first_word", "end_word", "label", "phrase", "coverage"))
    found = verified.groupBy(*row).agg(F.sum("rows").alias("rows"), F.max("n_words").alias("n_words"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"), F.array_sort(F.collect_list(taken)).alias("spans"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("doc_id", "n_words", "score", "spans")
