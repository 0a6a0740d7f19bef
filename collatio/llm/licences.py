"""License scans by sentence rules, with DataFrame functions only.

A text is lower-cased and reduced to its words (runs of letters and digits; ``https`` counts as ``http``); before words
that begin a line or follow ``.``, ``!``, ``?``, ``;`` or ``:`` and white space, or two white spaces, there is a border. Numbers and letters of
lists that stand between two borders are left out, and so are statements whose copyright it is. A known licence sentence
stands where its words stand one after another from border to border, whatever borders lie inside: so wrapped lines,
comment marks, "WARRANTY; without even" and "v. 2.0" don't matter. A number or letter of a list may stand between the
border and the sentence. Known sentences inside a longer one don't count.

Identifiers of sentences that directly follow each other are matched against rules, which are ordered lists of
identifiers. Matches that lie inside a longer match are dropped.

Texts without one of a few words, of which each known sentence has one, are passed over; in the others each border is
looked up in the table of known sentences, a constant. Only found sentences, few of all, are shuffled.

Defined cases: null and empty texts and documents without a known sentence give no row; repeated rows give
repeated matches only once; sentences may be of any length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Sentences of public licences and their usual notices, normalised, by identifier.
SENTENCES = {
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-2": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-notice": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-ref": "licensed under cc by 4 0",
    "cc-by-sa-ref": "licensed under cc by sa 4 0",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "cc-by-nd-ref": "licensed under cc by nd 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-if-a": "if a copy of the mpl was not distributed with this file you can obtain one at http www mozilla org mpl 2 0",
    "lgpl3-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl21-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "lgpl-copy": "you should have received a copy of the gnu lesser general public license along with this program",
    "lgpl21-copy": "you should have received a copy of the gnu lesser general public license along with this library",
    "agpl3-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "agpl-copy": "you should have received a copy of the gnu affero general public license along with this program",
    "isc-title": "isc license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "epl-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    "unlicense-public": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "all-rights": "all rights reserved",
}
# Rules, as (rule, licence, sentence identifiers in order).
RULES = [
    ("mit-reference", "MIT", ["mit-ref"]),
    ("mit-reference-2", "MIT", ["mit-ref-2"]),
    ("mit-title", "MIT", ["mit-title"]),
    ("mit-title-2", "MIT", ["mit-title-2"]),
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("mit-text-titled", "MIT", ["mit-title-2", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("apache-reference", "Apache-2.0", ["apache-ref"]),
    ("apache-header", "Apache-2.0", ["apache-notice", "apache-comply", "apache-obtain", "apache-as-is", "apache-see"]),
    ("gpl-3-reference", "GPL-3.0", ["gpl3-ref"]),
    ("gpl-3-notice", "GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope", "gpl-see"]),
    ("gpl-3-notice-copy", "GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope", "gpl-see", "gpl-copy"]),
    ("gpl-2-notice", "GPL-2.0-or-later", ["gpl2-redistribute", "gpl-hope", "gpl-see"]),
    ("gpl-2-notice-copy", "GPL-2.0-or-later", ["gpl2-redistribute", "gpl-hope", "gpl-see", "gpl-copy"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("cc-by-reference", "CC-BY-4.0", ["cc-by-ref"]),
    ("cc-by-work", "CC-BY-4.0", ["cc-by-work"]),
    ("cc-by-sa-reference", "CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("cc-by-sa-work", "CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("cc-by-nc-reference", "CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("cc-by-nc-work", "CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("cc-by-nd-reference", "CC-BY-ND-4.0", ["cc-by-nd-ref"]),
    ("mpl-2-header", "MPL-2.0", ["mpl-subject", "mpl-copy"]),
    ("mpl-2-header-www", "MPL-2.0", ["mpl-subject", "mpl-if-a"]),
    ("lgpl-3-notice", "LGPL-3.0-or-later", ["lgpl3-redistribute", "gpl-hope", "lgpl-see"]),
    ("lgpl-3-notice-copy", "LGPL-3.0-or-later", ["lgpl3-redistribute", "gpl-hope", "lgpl-see", "lgpl-copy"]),
    ("lgpl-2.1-notice", "LGPL-2.1-or-later", ["lgpl21-redistribute", "lgpl21-hope", "lgpl-see"]),
    ("lgpl-2.1-notice-copy", "LGPL-2.1-or-later", ["lgpl21-redistribute", "lgpl21-hope", "lgpl-see", "lgpl21-copy"]),
    ("agpl-3-notice", "AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-hope", "agpl-see"]),
    ("agpl-3-notice-copy", "AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-hope", "agpl-see", "agpl-copy"]),
    ("isc-text", "ISC", ["isc-grant", "isc-as-is", "isc-liability"]),
    ("isc-text-titled", "ISC", ["isc-title", "isc-grant", "isc-as-is", "isc-liability"]),
    ("bsd-2-text-whole", "BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    ("bsd-3-text-whole", "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability"]),
    ("bsd-2-text-reserved", "BSD-2-Clause", ["all-rights", "bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    ("bsd-3-text-reserved", "BSD-3-Clause", ["all-rights", "bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability"]),
    ("epl-2-notice", "EPL-2.0", ["epl-terms"]),
    ("unlicense-text", "Unlicense", ["unlicense-public", "unlicense-anyone"]),
    ("all-rights-reserved", "proprietary", ["all-rights"]),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_steps(spark: SparkSession) -> DataFrame:
    rows = [(r, licence, len(ids), step, s) for r, licence, ids in RULES for step, s in enumerate(ids)]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({_quoted(r)}, {_quoted(lic)}, {n}, {k}, {_quoted(s)})" for r, lic, n, k, s in rows) + " AS t(rule_id, license_id, steps, step, sentence_id)")


#: Each known sentence has one of these words.
TOLD_BY = ["licen", "warrant", "redistribut", "permission", "reserved", "liable", "mpl", "endorse", "public domain", "distribute"]
#: A number or letter of a list.
LISTED = "([0-9]{1,2}|[a-z]|[ivx]{1,4})"
#: What stands between two borders and is left out: a number or letter of a list, and whose copyright it is.
LEFT_OUT = [f"^{LISTED}$", r"^copyright( c)? [0-9]{4}\b"]
#: Replacements, in order, that leave words, blanks and ``\x01`` for borders of a lower-cased text.
TO_WORDS = [(r"[.!?;:]\s|\n|\s\s", "\x01"), ("[^a-z0-9\x01]+", " "), (r"\bhttps\b", "http")]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """The words of a lower-cased text, those after a border with ``\x01`` before them; the first has a border too."""
    out = text
    for pattern, by in TO_WORDS:
        out = F.regexp_replace(out, pattern, by)
    parts = F.transform(F.split(out, "\x01"), lambda p: F.trim(p))
    parts = F.filter(parts, lambda p: (p != "") & ~reduce(or_, [p.rlike(x) for x in LEFT_OUT]))
    return F.split(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("\x01"), p)), " "), " ")


def hits_of(words: Column) -> Column:
    """Known sentences in words: identifier, first word, the word where what belongs to it begins, the word after it."""
    known = F.array(*[F.struct(F.lit(k).alias("id"), F.split(F.lit(v), " ").alias("w"), F.lit(len(v.split())).alias("n")) for k, v in SENTENCES.items()])
    begins = F.array(*map(F.lit, sorted({" ".join(v.split()[:2]) for v in SENTENCES.values()})))
    bordered = lambda i: F.startswith(F.get(words, i), F.lit("\x01"))
    listed = lambda i: F.get(words, i).rlike(f"^\x01{LISTED}$")

    def at_start(plain: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(plain) - 1), lambda i: (bordered(i) | F.coalesce(listed(i - 1), F.lit(False))) & F.array_contains(begins, F.concat_ws(" ", F.get(plain, i), F.get(plain, i + 1))))
        meets = lambda i, k: (F.slice(plain, i + 1, k["n"]) == k["w"]) & ((i + k["n"] == F.size(plain)) | bordered(i + k["n"]))
        found = lambda i: F.transform(F.filter(known, lambda k: meets(i, k)), lambda k: F.struct(k["id"].alias("sentence_id"), i.alias("at"), F.when(bordered(i), i).otherwise(i - 1).alias("begin"), (i + k["n"]).alias("end")))
        return F.flatten(F.transform(places, found))

    return let(F.transform(words, lambda w: F.translate(w, "\x01", "")), at_start)


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, version, sentence_id, at, begin, end, seq) of known sentences; seq of two that follow each other differs by 1."""
    text = docs["text"].cast("string")
    told = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).where(F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in TOLD_BY])))
    hits = told.select("doc_id", F.xxhash64("text").alias("version"), F.explode(let(words_of(F.lower("text")), hits_of)).alias("x")).select("doc_id", "version", "x.*").distinct()
    in_text = Window.partitionBy("doc_id", "version")
    before = in_text.orderBy("at", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("covered", F.max("end").over(before)).where("covered is null or end > covered").drop("covered")
    last = F.lag("end").over(in_text.orderBy("at"))
    return hits.withColumn("gap", F.when(last == F.col("begin"), 1).otherwise(2)).withColumn("seq", F.sum("gap").over(in_text.orderBy("at"))).drop("gap")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license_id, rule_id, first_word, last_word) of every match that no longer one holds.

    Words are counted from 0, without those that are left out.
    """
    spark = docs.sparkSession
    # every known sentence, as each step it could be of each rule; the table is a constant of this module
    steps = sentences(docs).join(F.broadcast(rule_steps(spark)), "sentence_id").withColumn("first", F.col("seq") - F.col("step"))
    whole = (
        steps.groupBy("doc_id", "version", "rule_id", "license_id", "steps", "first")
        .agg(F.countDistinct("step").alias("got"), F.min("at").alias("first_word"), (F.max("end") - 1).alias("last_word"))
        .where("got = steps")
        .drop("got")
    )
    # every sentence that a match covers, with the longest match over it; a match stays if none longer is over some of its sentences
    over_all = F.explode(F.sequence("first", F.col("first") + F.col("steps") - 1))
    covered = whole.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), F.col("steps").alias("_n"), over_all.alias("_at"))
    over = covered.groupBy("_d", "_v", "_at").agg(F.max("_n").alias("most"))
    held = (
        whole.select("*", over_all.alias("at"))
        .join(over, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("version") == F.col("_v")) & (F.col("at") == F.col("_at")))
        .groupBy("doc_id", "version", "rule_id", "license_id", "first", "first_word", "last_word", "steps")
        .agg(F.min("most").alias("least"))
    )
    return held.where("least <= steps").select("doc_id", "license_id", "rule_id", "first_word", "last_word").distinct()


def _sql_words() -> str:
    out = "lower(text)"
    for pattern, by in TO_WORDS:
        mark = lambda x: "'" + x.replace("\x01", "' || chr(1) || '") + "'"
        out = f"regexp_replace({out}, {mark(pattern)}, {mark(by)}, 'g')"
    left_out = " OR ".join(f"regexp_matches(p, '{x}')" for x in LEFT_OUT)
    parts = f"list_filter(list_transform(string_split({out}, chr(1)), lambda p: trim(p)), lambda p: p <> '' AND NOT ({left_out}))"
    return f"string_split(array_to_string(list_transform({parts}, lambda p: chr(1) || p), ' '), ' ')"


ORACLE_SQL = (
    "WITH known(sentence_id, norm) AS (VALUES "
    + ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in SENTENCES.items())
    + "), steps(rule_id, license_id, steps, step, sentence_id) AS (VALUES "
    + ", ".join(f"({_quoted(r)}, {_quoted(lic)}, {len(ids)}, {k}, {_quoted(s)})" for r, lic, ids in RULES for k, s in enumerate(ids))
    + f"""), cut AS MATERIALIZED (SELECT DISTINCT doc_id, text, {_sql_words()} AS w FROM documents WHERE text IS NOT NULL),
word AS (SELECT doc_id, text, w, unnest(w) AS marked, generate_subscripts(w, 1) - 1 AS pos FROM cut),
start AS (
  SELECT doc_id, text, w, pos, replace(marked, chr(1), '') AS head, starts_with(marked, chr(1)) AS own FROM word
  WHERE starts_with(marked, chr(1)) OR (pos > 0 AND regexp_full_match(w[pos], chr(1) || '{LISTED}'))),
found AS (
  SELECT doc_id, text, w, pos, CASE WHEN own THEN pos ELSE pos - 1 END AS begun, sentence_id, pos + len(string_split(norm, ' ')) AS fin
  FROM start JOIN known ON split_part(norm, ' ', 1) = head
  AND replace(array_to_string(w[pos + 1 : pos + len(string_split(norm, ' '))], ' '), chr(1), '') = norm),
hits AS (
  SELECT doc_id, text, pos, begun, sentence_id, fin FROM found f WHERE (fin = len(w) OR starts_with(w[fin + 1], chr(1)))),
alone AS (
  SELECT *, lag(fin) OVER (PARTITION BY doc_id, text ORDER BY pos) AS was FROM (
    SELECT *, max(fin) OVER (PARTITION BY doc_id, text ORDER BY pos, fin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM hits)
  WHERE covered IS NULL OR fin > covered),
told AS (SELECT *, sum(CASE WHEN was = begun THEN 1 ELSE 2 END) OVER (PARTITION BY doc_id, text ORDER BY pos) AS seq FROM alone),
whole AS (
  SELECT doc_id, text, rule_id, license_id, steps.steps AS steps, seq - step AS first, min(pos) AS first_word, max(fin) - 1 AS last_word
  FROM told JOIN steps USING (sentence_id)
  GROUP BY doc_id, text, rule_id, license_id, steps.steps, seq - step HAVING count(DISTINCT step) = steps.steps)
SELECT DISTINCT doc_id, license_id, rule_id, CAST(first_word AS INTEGER) AS first_word, CAST(last_word AS INTEGER) AS last_word
FROM whole w WHERE EXISTS (
  SELECT 1 FROM range(CAST(w.first AS BIGINT), CAST(w.first + w.steps AS BIGINT)) r(p)
  WHERE NOT EXISTS (SELECT 1 FROM whole o WHERE o.doc_id IS NOT DISTINCT FROM w.doc_id AND o.text = w.text AND o.steps > w.steps AND r.p >= o.first AND r.p < o.first + o.steps))"""
)
