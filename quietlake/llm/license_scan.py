"""License scans with a positional rare-token index, in DataFrame functions only.

The corpus is notices of licences, cut into passages; each has a label and mandatory key
phrases. Document frequencies of the corpus's words, counted over all documents, give each
word its IDF. The index holds, for every passage, the highest-IDF words of its key phrases,
as postings (passage, offset from the first key phrase). Each file's rare licence words are
looked up in it: a posting at a word's place moved back by its offset is a place where that
passage may stand, and the places on which two different rare words agree, sorted and
intersected, go on. There all key phrases are verified word by word, and the passage's words
around them are weighed by IDF. Bare phrases (``BASE``) run through the same index, which
loses no place of theirs: a phrase stands only where all of its words agree.

Scale: two passes over the text without shuffling it; the only exchange is the counts of
the fixed vocabulary. Rows are independent, so no source or copied text makes a hot task.

Edge cases: null text counts as empty and has no words, places or labels, and score 0; a
null doc_id is kept; repeated rows are scanned each; an empty table gives an empty result;
texts are read whole; columns other than the two named are ignored.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Phrase and label.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Passage, its key phrases in order, label. Words as the scan sees them: lower case, without marks.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", ["gnu general public license"], "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["redistribute it and or modify it", "gnu general public license"], "gpl"),
    ("you should have received a copy of the gnu general public license along with this program if not see", ["received a copy of the gnu general public license"], "gpl"),
    ("this library is licensed under the gnu lesser general public license version 2 1", ["gnu lesser general public license"], "lgpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ["redistribute it and or modify it", "gnu lesser general public license"], "lgpl"),
    ("licensed under the gnu affero general public license version 3", ["gnu affero general public license"], "agpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["redistribute it and or modify it", "gnu affero general public license"], "agpl"),
    ("licensed under the apache license version 2 0", ["apache license"], "apache"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache license version 2 0", "except in compliance with the license"], "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["agreed to in writing software distributed under the license", "without warranties or conditions of any kind"], "apache"),
    ("released under the mit license", ["mit license"], "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["hereby granted free of charge"], "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["hereby granted free of charge", "to deal in the software without restriction"], "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included in all copies"], "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"], "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"], "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["to endorse or promote products derived from this software"], "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted", "appear in all copies"], "isc"),
    ("subject to the terms of the mozilla public license version 2 0", ["mozilla public license"], "mpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["source code form is subject to the terms of the mozilla public license"], "mpl"),
    ("licensed under the eclipse public license version 2 0", ["eclipse public license"], "epl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ["accompanying materials", "eclipse public license"], "epl"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["granted to anyone to use this software for any purpose", "alter it and redistribute it freely"], "zlib"),
    ("distributed under the boost software license version 1 0", ["boost software license"], "bsl"),
    ("licensed under cc by 4 0", ["cc by 4 0"], "cc-by"),
    ("licensed under cc by nc 4 0", ["cc by nc"], "cc-by-nc"),
    ("cc by nc 4 0", ["cc by nc"], "cc-by-nc"),
    ("licensed under cc by sa 4 0", ["cc by sa"], "cc-by-sa"),
    ("cc by sa 4 0", ["cc by sa"], "cc-by-sa"),
    ("cc by nd 4 0", ["cc by nd"], "cc-by-nd"),
    ("licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"], "cc-by"),
    ("this work is licensed under the creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"], "cc-by-sa"),
    ("this work is licensed under the creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"], "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"], "unlicense"),
]
#: Everything in ASCII but digits and letters separates words.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _fold(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _among(word: Column, words: list[str]) -> Column:
    """Whether a word is one of some ASCII words but for the case of ASCII letters; the first, wider test is the cheaper one."""
    return F.lower(word).isin(words) & _fold(word).isin(words)


def _with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, words: in the case they have; only words that are looked at get folded."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.array_remove(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _SEPARATORS), "").alias("words"))


def _vocabulary(templates, base) -> list[str]:
    return sorted({w for t in templates for w in t[0].split()} | {w for p, _ in base for w in p.split()})


def idf_table(docs: DataFrame, templates=TEMPLATES, base=BASE, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """IDF of the fixed vocabulary: ln((documents + 1) / (documents with the word + 1))."""
    words = _vocabulary(templates, base)
    known = F.array_distinct(F.transform(F.filter("words", lambda w: _among(w, words)), _fold))
    counts = _with_words(docs, id_col, text_col).select(F.explode(F.array_append(known, F.lit(""))).alias("word")).groupBy("word").count()
    got = {r["word"]: r["count"] for r in counts.collect()}  # one row per word of the fixed vocabulary at most
    return {w: math.log((got.get("", 0) + 1) / (got.get(w, 0) + 1)) for w in words}


class Passage(NamedTuple):
    """A phrase or a template: its words and those of its key phrases, each with its offset from the first key phrase."""

    label: str
    words: list[tuple[int, str]]
    keys: list[tuple[int, str]]


def _passage(text: str, phrases: list[str], label: str) -> Passage:
    words, keys, at = text.split(), [], 0
    for phrase in (p.split() for p in phrases):
        at = next(i for i in range(at, len(words)) if words[i : i + len(phrase)] == phrase)
        keys += [(at + j, w) for j, w in enumerate(phrase)]
        at += len(phrase)
    first = keys[0][0]
    return Passage(label, [(i - first, w) for i, w in enumerate(words)], [(i - first, w) for i, w in keys])


def _index(passages: list[Passage], idf: dict[str, float], most: int = 2) -> dict[str, list[tuple[int, int]]]:
    """Postings (passage, offset) of the ``most`` highest-IDF words of each passage's key phrases, where each first stands."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, passage in enumerate(passages):
        first: dict[str, int] = {}
        for offset, word in passage.keys:
            first.setdefault(word, offset)
        if len(first) < most:
            raise ValueError(f"a key phrase needs {most} different words: {passage.keys}")
        for word in sorted(first, key=lambda w: (-idf[w], w))[:most]:
            postings.setdefault(word, []).append((number, first[word]))
    return postings


def _constant(rows: list[list[tuple]], names: str) -> Column:
    """An array of arrays of structs, as a constant."""
    return F.from_json(F.lit(json.dumps([[dict(zip(names.split(), x, strict=True)) for x in row] for row in rows])), f"array<array<struct<{', '.join(f'{n}:{t}' for n, t in zip(names.split(), ('int', 'string', 'double'), strict=False))}>>>")


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SHIFT = 40


def _agreed(hits: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """Numbers passage << 40 | place on which two rare words of the passage agree."""
    entries = [x for word, own in postings.items() for x in (F.lit(word), F.array(*(F.struct(F.lit(n).cast("long").alias("n"), F.lit(o).alias("o")) for n, o in own)))]
    table = F.create_map(*entries)
    moved = F.flatten(F.transform(hits, lambda h: F.transform(F.filter(F.element_at(table, h["w"]), lambda x: h["p"] >= x["o"]), lambda x: F.shiftleft(x["n"], _SHIFT) + h["p"] - x["o"])))
    twice = lambda v: F.filter(F.zip_with(v, F.slice(v, F.lit(2), F.greatest(F.size(v), F.lit(1))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    return F.when(F.size(hits) > 1, _bound(F.array_sort(moved), twice)).otherwise(F.array().cast("array<bigint>"))


def license_scan(docs: DataFrame, templates=TEMPLATES, base=BASE, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text", idf: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    ``labels`` adds to the base labels those of every template of which a share ``least`` of
    the IDF weight stands in place around its verified key phrases; ``score`` is the highest
    such share. ``places`` lists (label, start) of the base phrases.
    """
    idf = idf or idf_table(docs, templates, base, id_col, text_col)
    passages = [_passage(p, [p], label) for p, label in base] + [_passage(*t) for t in templates]
    postings = _index(passages, idf)
    weights = [[(o, w, max(idf[w], 1e-9)) for o, w in p.words] for p in passages]
    keys, words, totals = _constant([p.keys for p in passages], "o w"), _constant(weights, "o w x"), F.array(*(F.lit(sum(x for *_, x in own)) for own in weights))
    labels = F.array(*(F.lit(p.label) for p in passages))

    found = _with_words(docs, id_col, text_col).withColumn("n_words", F.size("words").cast("long"))
    at = F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    found = found.withColumn("hits", F.transform(F.filter(at, lambda i: _among(F.get("words", i), sorted(postings))), lambda i: F.struct(i.alias("p"), _fold(F.get("words", i)).alias("w"))))

    number, place = lambda c: F.shiftright(c, _SHIFT).cast("int"), lambda c: c.bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int")
    stands = lambda c, x: F.coalesce(_fold(F.get("words", place(c) + x["o"])) == x["w"], F.lit(False))
    verified = F.filter(_agreed(F.col("hits"), postings), lambda c: F.forall(F.get(keys, number(c)), lambda x: stands(c, x)))
    share = lambda c: F.round(F.aggregate(F.get(words, number(c)), F.lit(0.0), lambda a, x: a + F.when(stands(c, x), x["x"]).otherwise(0.0)) / F.get(totals, number(c)), 6)
    found = found.withColumn("verified", F.transform(verified, lambda c: F.struct(number(c).alias("n"), place(c).cast("long").alias("start"), F.get(labels, number(c)).alias("label"), F.when(number(c) >= len(base), share(c)).alias("share"))))

    found = found.withColumn("places", F.transform(F.filter("verified", lambda v: v["n"] < len(base)), lambda v: F.struct(v["label"].alias("label"), v["start"].alias("start"))))
    found = found.withColumn("shares", F.filter("verified", lambda v: v["share"] >= least))
    base_labels = F.array_distinct(F.col("places.label"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("shares.label"))), ",").alias("labels"),
        F.coalesce(F.array_max("shares.share"), F.lit(0.0)).alias("score"),
        "places",
    )


def oracle_sql(templates=TEMPLATES, base=BASE, least: float = 0.7) -> str:
    """The same result in DuckDB SQL, which tries every place of every first key phrase instead of an index."""
    phrases = ", ".join(f"({label!r}, {p.split()!r})" for p, label in base)
    listed = lambda values: repr(list(values))
    rows = ", ".join(f"({i}, {p.label!r}, {listed(w for _, w in p.words)}, {listed(o for o, _ in p.words)}, {t[1][0].split()!r}, {listed(w for _, w in p.keys)}, {listed(o for o, _ in p.keys)})" for i, t in enumerate(templates) for p in [_passage(*t)])
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
base(label, p) AS (VALUES {phrases}),
tmpl(tid, label, t, o, k, kw, ko) AS (VALUES {rows}),
hit AS (SELECT rid, base.label, unnest(list_filter(range(len(w) - len(p) + 1), lambda i: w[i+1:i+len(p)] = p)) AS s FROM d, base WHERE list_has_all(w, p)),
b AS (SELECT rid, count(*) AS n, min(s) AS lo, max(s) AS hi, list_distinct(list(label)) AS labels FROM hit GROUP BY rid),
vocab AS (SELECT DISTINCT unnest(t) AS word FROM tmpl UNION SELECT DISTINCT unnest(p) FROM base),
df AS (SELECT word, count(rid) AS n FROM vocab LEFT JOIN (SELECT DISTINCT rid, unnest(w) AS x FROM d) q ON q.x = vocab.word GROUP BY word),
idf AS (SELECT word, greatest(ln(((SELECT count(*) FROM d) + 1) / (n + 1)), 1e-9) AS x FROM df),
weight AS (SELECT tid, j, word, x FROM (SELECT tid, unnest(t) AS word, unnest(o) AS j FROM tmpl) q JOIN idf USING (word)),
must AS (SELECT tid, unnest(kw) AS word, unnest(ko) AS j FROM tmpl),
first AS (SELECT rid, w, tid, tmpl.label, unnest(list_filter(range(len(w) - len(k) + 1), lambda i: w[i+1:i+len(k)] = k)) AS s FROM d, tmpl WHERE list_has_all(w, kw)),
found AS (SELECT rid, w, first.tid, label, s FROM first JOIN must USING (tid) GROUP BY ALL HAVING bool_and(coalesce(w[s+j+1] = word, false))),
share AS (
  SELECT rid, found.tid, found.label, s, round(sum(CASE WHEN s + j >= 0 AND w[s+j+1] = weight.word THEN x ELSE 0 END) / sum(x), 6) AS share
  FROM found JOIN weight USING (tid) GROUP BY ALL),
m AS (SELECT rid, list_distinct(list(label)) AS labels, max(share) AS share FROM share WHERE share >= {least} GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, lo AS first_word, hi AS last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(m.labels, []))), ',') AS labels,
       coalesce(m.share, 0.0) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)
"""
