"""License scans with a positional rare-token index, in DataFrame operations only.

A template is a licence notice or a whole licence text with its mandatory key
phrase.  Document frequencies of all template words, counted over all documents,
give their IDF.  The index holds postings as data: a word's (template, offset)
pairs, for the highest-IDF word of every key phrase; and for each template its
words, their weights and its ``RARE`` highest-IDF words.

A file's indexed words are looked up; the difference of positions aligns a
template with the file.  The template's rare words are intersected with the
file's words at their relative positions, and an alignment of which less than
``least`` of their weight agrees is given up; then the key phrase is verified,
and the share of all the template's weight that agrees is the alignment's
score, ``least`` at least.  Since a key phrase can't stand anywhere without its
rarest word, no place is missed.  Notices have ``least`` 0: their key phrase
decides.  Whole texts share words like their own with others, so half of their
weight must agree.

Base phrases are templates whose key phrase is the phrase; their places are
the base matches.  A file's score is the best of its alignments.

Words are runs of digits, letters and characters beyond ASCII, with A-Z folded.

Defined results: a null text has no words, no labels and score 0; a text of any
length is scanned whole; repeated rows are judged each; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: label, words, key phrase, whether it is a base phrase, the least share of weight that agrees.  Fixed values.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license", True, 0.0),
    ("apache", "licensed under the apache license version 2 0", "apache license", True, 0.0),
    ("gpl", "licensed under the gnu general public license version 3", "general public license", True, 0.0),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "lesser general public license", False, 0.0),
    ("agpl", "licensed under the gnu affero general public license version 3", "affero general public license", False, 0.0),
    ("mpl", "licensed under the mozilla public license version 2 0", "mozilla public license", False, 0.0),
    ("epl", "licensed under the eclipse public license version 2 0", "eclipse public license", False, 0.0),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", False, 0.0),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", False, 0.0),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
        "permission is hereby granted free of charge",
        False,
        0.5,
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "permission to use copy modify and or distribute",
        False,
        0.5,
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
        False,
        0.5,
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product "
        "an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "this notice may not be removed or altered from any source distribution",
        "in no event will the authors be held liable",
        False,
        0.5,
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software",
        False,
        0.5,
    ),
]
RARE = 5

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(folded, _SPLIT), lambda w: w != "")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those with each word of the vocabulary."""
    met = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))
    counts = docs.select(F.explode(F.concat(met, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return found.pop("", 0), found


def index(docs: DataFrame, templates=None) -> tuple[dict[str, list[dict]], list[dict]]:
    """Postings (word: template number and offset) and templates with IDF weights, rare words and key phrase bounds."""
    templates = templates or TEMPLATES
    vocabulary = sorted({w for _, text, *_ in templates for w in text.split()})
    n, df = document_frequencies(docs, vocabulary)
    idf = {w: 1 + math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}
    postings: dict[str, list[dict]] = {}
    out = []
    for t, (label, text, key, base, least) in enumerate(templates):
        terms, phrase = text.split(), key.split()
        at = next(i for i in range(len(terms)) if terms[i : i + len(phrase)] == phrase)
        rarest = sorted(range(len(terms)), key=lambda i: (-idf[terms[i]], i))
        anchor = next(i for i in rarest if at <= i < at + len(phrase))
        postings.setdefault(terms[anchor], []).append({"t": t, "off": anchor})
        weights = [idf[w] for w in terms]
        out.append({"label": label, "base": base, "terms": terms, "weights": weights, "total": sum(weights), "at": at, "size": len(phrase), "rare": rarest[:RARE], "least": least})
    return postings, out


_POSTINGS = "map<string,array<struct<t:int,off:int>>>"
_TEMPLATES = "array<struct<label:string,base:boolean,terms:array<string>,weights:array<double>,total:double,at:int,size:int,rare:array<int>,least:double>>"
_MATCHES = "array<struct<label:string,base:boolean,start:bigint,score:double>>"


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """One row for each document: doc_id, n_words, matches (array of label, base, start, score)."""
    postings, known = index(docs, templates)
    # Constants of the plan, a few KB for each template.
    posting = F.from_json(F.lit(json.dumps(postings)), _POSTINGS)
    template = F.from_json(F.lit(json.dumps(known)), _TEMPLATES)
    words = docs.select("doc_id", words_of(F.col("text")).alias("__tq_words"))
    numbered = F.transform("__tq_words", lambda w, i: F.when(w.isin(sorted(postings)), F.struct(w.alias("w"), i.alias("i"))))
    rare = words.select("doc_id", "__tq_words", F.filter(numbered, lambda x: x.isNotNull()).alias("__tq_rare"))
    agrees = lambda t, start, i: F.coalesce(F.get("__tq_words", start + i) == F.get(t["terms"], i), F.lit(False))
    weight = lambda t, start, i: F.when(agrees(t, start, i), F.get(t["weights"], i)).otherwise(F.lit(0.0))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def alignment(x, p):
        return F.struct(F.get(template, p["t"]).alias("t"), (x["i"] - p["off"]).alias("start"))

    def near(a):
        """Whether the template's rare words agree, by weight."""
        t = a["t"]
        return add(F.transform(t["rare"], lambda i: weight(t, a["start"], i))) >= t["least"] * add(F.transform(t["rare"], lambda i: F.get(t["weights"], i)))

    def verified(a):
        t, first = a["t"], a["start"] + a["t"]["at"]
        return F.when(first >= 0, F.slice("__tq_words", first + 1, t["size"]) == F.slice(t["terms"], t["at"] + 1, t["size"])).otherwise(F.lit(False))

    def described(a):
        t = a["t"]
        score = add(F.transform(t["terms"], lambda _, i: weight(t, a["start"], i))) / t["total"]
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), (a["start"] + t["at"]).cast("long").alias("start"), score.alias("score"), t["least"].alias("least"))

    found = F.flatten(F.transform("__tq_rare", lambda x: F.transform(F.element_at(posting, x["w"]), lambda p: alignment(x, p))))
    whole = F.transform(F.filter(found, lambda a: verified(a) & near(a)), described)
    matches = F.transform(F.filter(whole, lambda m: m["score"] >= m["least"]), lambda m: m.dropFields("least"))
    return rare.select("doc_id", F.size("__tq_words").cast("long").alias("n_words"), F.coalesce(F.when(F.size("__tq_rare") > 0, matches), F.from_json(F.lit("[]"), _MATCHES)).alias("matches"))


def digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels("matches").alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)), 6).alias("score"),
    )


def oracle() -> str:
    """The query's rows in SQL."""
    rows = []
    for t, (label, text, key, base, least) in enumerate(TEMPLATES):
        terms, phrase = text.split(), key.split()
        at = next(i for i in range(len(terms)) if terms[i : i + len(phrase)] == phrase)
        rows += [f"({t}, '{label}', {str(base).lower()}, {least}, {at}, {i}, '{w}', {str(at <= i < at + len(phrase)).lower()})" for i, w in enumerate(terms)]
    return rf"""
WITH template(t, label, base, least, key_at, off, word, in_key) AS (VALUES {", ".join(rows)}),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
known AS (SELECT * FROM places WHERE word IN (SELECT word FROM template)),
frequency AS (SELECT word, count(DISTINCT doc_id) AS df FROM known GROUP BY word),
weighted AS (
  SELECT template.*, 1 + ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1)) AS idf
  FROM template LEFT JOIN frequency USING (word)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY idf DESC, off) <= {RARE} AS rare FROM weighted),
whole AS (SELECT t, sum(idf) AS total, sum(idf) FILTER (WHERE rare) AS rare_total, sum(CAST(in_key AS INT)) AS key_size FROM ranked GROUP BY t),
aligned AS (
  SELECT doc_id, t, label, base, least, i - off + key_at AS start, sum(idf) AS agree, coalesce(sum(idf) FILTER (WHERE rare), 0) AS rare_agree, sum(CAST(in_key AS INT)) AS met
  FROM known JOIN ranked USING (word) GROUP BY doc_id, t, label, base, least, i - off + key_at),
found AS (
  SELECT aligned.*, agree / total AS score
  FROM aligned JOIN whole USING (t) WHERE met = key_size AND rare_agree >= least * rare_total AND agree / total >= least),
by_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
FROM docs LEFT JOIN by_doc USING (doc_id)
"""
