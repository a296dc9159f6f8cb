"""License scans by sentence rules.

A text is cut into sentences, each is normalised, and known ones become
identifiers; the sequence of identifiers is then matched against licence rules
in order. A rule that matches takes its identifiers out of the sequence, so that
a longer rule (three clauses) goes before a shorter one (two clauses) and what
no rule explains stays visible.

Licences come wrapped at any word and with titles that no full stop ends, so a
sentence ends at punctuation or a blank line only, and a sentence of several
lines is looked up by runs of its lines: of the runs that start at a line the
longest known one counts.

All of it happens within a row, in DataFrame expressions; there is no shuffle
(unless the table of known sentences is too large to go along with each task).
Every sentence of every text is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import LOWER, UPPER, let, table

# Sentences of public licences and notices, normalised, with our names for them.
_VERSIONS = ("1", "2", "2 1", "3")
_CC = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
SENTENCES: dict[str, str] = {
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    **{f"{title}{x}": "mit-title" for title in ("mit license", "the mit license") for x in ("", " mit")},
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    **{f"in no event shall the copyright {holder} or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability" for holder in ("holder", "holders", "owner")},
    "loss of use data or profits": "bsd-loss",
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-interruption",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    **{f"{scheme} www apache org licenses license 2 0": "apache-url" for scheme in ("http", "https")},
    "apache license version 2 0 january 2004": "apache-title",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    **{f"this {work} is distributed in the hope that it will be useful but without any warranty": "gpl-hope" for work in ("program", "library")},
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    **{f"see the gnu {kind}general public license for more details": "gpl-see" for kind in ("", "lesser ", "affero ")},
    **{f"you should have received a copy of the gnu {kind}general public license along with this {work}": "gpl-copy" for kind in ("", "lesser ", "affero ") for work in ("program", "library")},
    **{f"if not see {scheme} www gnu org licenses": "gpl-if-not" for scheme in ("http", "https")},
    **{f"this {work} is free software": "gpl-free" for work in ("program", "library")},
    **{f"you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation": f"{name}-redistribute" for kind, name in (("", "gpl"), ("lesser ", "lgpl"), ("affero ", "agpl"))},
    **{f"either version {v} of the license or at your option any later version": f"later-{v.replace(' ', '.')}" for v in _VERSIONS},
    **{f"you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {v} of the license or at your option any later version": f"{name}-{v.replace(' ', '.')}+" for kind, name in (("", "gpl"), ("lesser ", "lgpl"), ("affero ", "agpl")) for v in _VERSIONS},
    "gnu general public license version 2 june 1991": "gpl-2-title",
    "gnu general public license version 3 29 june 2007": "gpl-3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl-2.1-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3-title",
    "gnu affero general public license version 3 19 november 2007": "agpl-3-title",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "the origin of this software must not be misrepresented": "zlib-origin",
    "you must not claim that you wrote the original software": "zlib-claim",
    "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required": "zlib-product",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-free",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-anyone",
    "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain": "unlicense-dedicate",
    "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors": "unlicense-benefit",
    "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law": "unlicense-intend",
    **{f"for more information please refer to {scheme} unlicense org": "unlicense-url" for scheme in ("http", "https")},
    "this source code form is subject to the terms of the mozilla public license v": "mpl-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-copy",
    "mozilla public license version 2 0": "mpl-2-title",
    "2 0": "two-nought",
    **{f"this program and the accompanying materials are made available under the terms of the eclipse public license {v}": "epl-2" for v in ("2 0", "v2 0", "v 2 0", "2 0 which is available at https www eclipse org legal epl 2 0", "2 0 which accompanies this distribution and is available at https www eclipse org legal epl 2 0")},
    "eclipse public license v 2 0": "epl-2-title",
    "cc0 1 0 universal": "cc0-title",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waived",
    "boost software license version 1 0 august 17th 2003": "bsl-title",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    **{f"{start}the mit license": "mit" for start in ("released under ", "licensed under ", "this work is licensed under ", "distributed under ")},
    **{f"{start}apache license version 2 0": "apache-2" for start in ("released under the ", "licensed under the ", "this work is licensed under the ")},
    "licensed under the apache license version 2 0 the license": "apache-2",
    **{f"{start}the gnu {kind}general public license version {v}": f"{name}-{v.replace(' ', '.')}" for start in ("released under ", "licensed under ", "this work is licensed under ") for kind, name in (("", "gpl"), ("lesser ", "lgpl"), ("affero ", "agpl")) for v in _VERSIONS},
    **{f"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {v} of the license or at your option any later version": f"gpl-{v}+" for v in ("1", "2", "3")},
    **{f"{start}{k} {v} 0": f"cc-{k.replace(' ', '-')}-{v}" for start in ("licensed under cc ", "this work is licensed under cc ", "released under cc ") for k in _CC for v in ("1", "2", "3", "4")},
}
#: Licences by the sequences that show them, tried in this order. A name ending in ? may be missing.
_LATER = ("gpl-hope?", "gpl-implied?", "gpl-warranty?", "gpl-see?", "gpl-copy?", "gpl-if-not?")
_BSD_END = ("bsd-warranty?", "bsd-liability?", "bsd-loss?", "bsd-interruption?")
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-title?", "copyright?", "reserved?", "mit-grant", "mit-notice", "mit-warranty", "mit-liability?")),
    ("ISC", ("copyright?", "reserved?", "isc-grant", "isc-warranty?", "isc-liability?")),
    ("BSD-3-Clause", ("copyright?", "reserved?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names", *_BSD_END)),
    ("BSD-2-Clause", ("copyright?", "reserved?", "bsd-grant", "bsd-source", "bsd-binary", *_BSD_END)),
    ("Apache-2.0", ("copyright?", "apache-2", "apache-use?", "apache-copy?", "apache-url?", "apache-warranty?", "apache-see?")),
    *((f"{name.upper()}-{full}-or-later", (*found, *_LATER)) for name in ("gpl", "lgpl", "agpl") for v, full in (("1", "1.0"), ("2", "2.0"), ("2.1", "2.1"), ("3", "3.0")) for found in (("gpl-free", f"{name}-{v}+"), ("gpl-free", f"{name}-redistribute", f"later-{v}"))),
    *((f"GPL-{v}.0-or-later", (f"gpl-{v}+", "gpl-warranty?", "gpl-see?")) for v in ("1", "2", "3")),
    *((f"{name.upper()}-{v.replace(' ', '.')}", (f"{name}-{v.replace(' ', '.')}",)) for name in ("gpl", "lgpl", "agpl") for v in _VERSIONS),
    ("Zlib", ("copyright?", "reserved?", "zlib-warranty?", "zlib-liability?", "zlib-grant", "zlib-origin", "zlib-claim", "zlib-product?", "zlib-altered", "zlib-notice")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone", "unlicense-dedicate?", "unlicense-benefit?", "unlicense-intend?")),
    ("MPL-2.0", ("mpl-form", "two-nought", "mpl-2-copy?")),
    ("EPL-2.0", ("epl-2",)),
    ("BSL-1.0", ("bsl-title?", "bsl-grant")),
    ("CC0-1.0", ("cc0-waived",)),
    ("MIT", ("mit",)),
    *((f"CC-{k.upper().replace(' ', '-')}-{v}.0", (f"cc-{k.replace(' ', '-')}-{v}",)) for k in _CC for v in ("1", "2", "3", "4")),
    *((name, (title,)) for name, title in (("Apache-2.0", "apache-title"), ("GPL-2", "gpl-2-title"), ("GPL-3", "gpl-3-title"), ("LGPL-2.1", "lgpl-2.1-title"), ("LGPL-3", "lgpl-3-title"), ("AGPL-3", "agpl-3-title"), ("MPL-2.0", "mpl-2-title"), ("EPL-2.0", "epl-2-title"), ("CC0-1.0", "cc0-title"))),
    ("Proprietary", ("copyright?", "reserved")),
]
_OTHER, _TAKEN = "<x>", "<t>"
#: Known sentences that go along with each task, at most; a larger table is joined.
MOST_SENTENCES = 5000
#: Characters by which it is told whether a known sentence could start at a line.
_START = 8
_BREAK = "\x01"
_COPYRIGHT = "^copyright( c)?( [0-9]+)+( .*)?$"
_ENUMERATOR = "^([0-9]{1,2}|[a-z]|[ivx]{1,5})$"


def _pattern(sequence: tuple[str, ...]) -> str:
    quoted = lambda name: "<" + name.replace(".", "\\.").replace("+", "\\+") + ">"
    return "".join(f"(?:{quoted(s[:-1])})?" if s.endswith("?") else quoted(s) for s in sequence)


# (pattern, replacement): enumerators in brackets go; blank lines, and the space after . ! ? ; : and closing quotes, become breaks.
_CUTS = (
    ("(^|\n)[^A-Za-z0-9\n]*[0-9A-Za-z]{1,3}\\)[ \t]+", "$1"),
    ("\n([^A-Za-z0-9\n]*\n)+", _BREAK),
    ("([.!?;:][\"')\\]]*)[ \t\r\n]+", "$1" + _BREAK),
)


def sentences(text: Column) -> Column:
    """Sentences of a text, line feeds inside them kept: they end at a blank line, and after . ! ? ; : before a space or a line's end."""
    for pattern, replacement in _CUTS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.split(text, _BREAK)


def normalised(sentence: Column) -> Column:
    """Lower-case words of letters and digits joined by single spaces."""
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def _lines(sentence: Column) -> Column:
    """The normalised lines of a sentence that have a word."""
    return F.filter(F.transform(F.split(sentence, "\n"), normalised), lambda x: x != "")


def _marked(lines: Column, names: Column, starts: Column | None, most_lines: int | Column) -> Column:
    """Identifiers in brackets of a sentence given by its normalised lines, with _OTHER for lines that no known run covers.

    A run that starts inside an earlier known run doesn't count. starts: the beginnings of known sentences, if they are few.
    """
    n = F.size(lines)
    name = lambda x: F.try_element_at(names, x)
    of_line = lambda x: name(F.regexp_replace(x, _COPYRIGHT, "copyright"))
    bracketed = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    other = F.array(F.lit(_OTHER))
    single = F.when(lines[0].rlike(_ENUMERATOR), F.array().cast("array<string>")).otherwise(F.array(F.coalesce(bracketed(of_line(lines[0])), F.lit(_OTHER))))

    def run_at(i: Column) -> Column:
        """The longest known run from line i: (i, length, id)."""
        joined = lambda m: F.when(m == 1, of_line(F.get(lines, i))).otherwise(name(F.array_join(F.slice(lines, i + 1, m), " ")))
        runs = F.transform(F.sequence(F.lit(1), F.least(F.lit(most_lines) if isinstance(most_lines, int) else most_lines, n - i)), lambda m: F.struct(i.alias("i"), m.alias("m"), joined(m).alias("id")))
        return F.array_max(F.filter(runs, lambda r: r["id"].isNotNull()))

    def could_start(i: Column) -> Column:
        return F.lit(True) if starts is None else F.array_contains(starts, F.left(F.array_join(F.slice(lines, i + 1, F.lit(_START)), " "), F.lit(_START)))

    places = F.filter(F.sequence(F.lit(0), n - 1), could_start)
    runs = F.filter(F.transform(places, run_at), lambda r: r.isNotNull())
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("ids"))

    def step(state: Column, run: Column) -> Column:
        gap = F.when(run["i"] > state["next"], other).otherwise(F.array().cast("array<string>"))
        ids = F.when(run["i"] >= state["next"], F.concat(state["ids"], gap, F.array(bracketed(run["id"])))).otherwise(state["ids"])
        return F.struct(F.greatest(state["next"], run["i"] + run["m"]).alias("next"), ids.alias("ids"))

    several = F.aggregate(runs, start, step, lambda state: F.when(state["next"] < n, F.concat(state["ids"], other)).otherwise(state["ids"]))
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, single).otherwise(several)


def _found(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, names map<string, string>): of each distinct text of docs (text) the known sentences in it, by a join with known (sentence, id).

    For tables too large for a literal. Runs of a sentence's lines that have more words than any known sentence aren't looked up.
    """
    longest = int(known.agg(F.max(F.size(F.split("sentence", " ")))).first()[0] or 1)
    several = lambda lines: F.flatten(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(lines) - i)), lambda m: F.array_join(F.slice(lines, i + 1, m), " "))))
    asked = lambda lines: F.when(F.size(lines) > 0, F.concat(several(lines), F.transform(lines, lambda x: F.regexp_replace(x, _COPYRIGHT, "copyright")))).otherwise(F.array().cast("array<string>"))
    texts = docs.filter("text IS NOT NULL").select(F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["digest"])
    each = texts.select("digest", F.explode(sentences(F.col("text"))).alias("s")).select("digest", F.explode(let(_lines(F.col("s")), asked)).alias("sentence"))
    hits = each.distinct().join(known.select("sentence", "id").dropDuplicates(["sentence"]), "sentence")
    return hits.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("sentence", "id"))).alias("names"))  # no more than the text has


def scan(docs: DataFrame, known: dict[str, str] | DataFrame | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """Adds sentence_ids, licenses (array<string>) and unmatched (long) to every row of docs (text, ...).

    known: normalised sentences and their ids, as a dict or as a table (sentence, id); a table, or a dict of
    more than MOST_SENTENCES, is joined. sentence_ids: identifiers of known sentences in the order of the
    text, repeats included. licenses: names by rule order, each once. unmatched: known sentences that no rule
    took. A sentence that is a number, a letter or a Roman numeral is an enumerator and passed over. Null,
    empty and other texts without known sentences have empty arrays and 0. Rows stay as many; other columns
    stay, whatever their names, and those named like an added one are replaced.
    """
    known, rules = {"copyright": "copyright", **SENTENCES} if known is None else known, RULES if rules is None else rules
    own = [c for c in docs.columns if c not in ("sentence_ids", "licenses", "unmatched")]
    rows = docs.select(F.struct(*own).alias("row"))
    if isinstance(known, dict) and len(known) <= MOST_SENTENCES:
        names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<string,string>")
        starts = F.array(*[F.lit(x) for x in sorted({k[:_START] for k in known})]) if all(len(k) >= _START for k in known) else None
        most_lines = max((k.count(" ") + 1 for k in known), default=1)
    else:
        table_ = known if isinstance(known, DataFrame) else docs.sparkSession.createDataFrame(list(known.items()), "sentence string, id string")
        rows = rows.withColumn("digest", F.sha2("row.text", 256)).join(_found(docs.select("text"), table_), "digest", "left")
        names, starts = F.coalesce("names", F.create_map().cast("map<string,string>")), None
        most_lines = F.coalesce(F.array_max(F.transform(F.map_keys(names), lambda k: F.size(F.split(k, " ")))), F.lit(1))
    parts = sentences(F.col("row.text"))
    ids = F.flatten(F.transform(parts, lambda s: let(_lines(s), lambda lines: _marked(lines, names, starts, most_lines))))
    ordered = F.array(*[F.struct(F.lit(license_).alias("name"), F.lit(_pattern(sequence)).alias("pattern")) for license_, sequence in rules])

    def step(state: Column, rule: Column) -> Column:
        hit = F.regexp_like(state["rest"], rule["pattern"])
        return F.when(hit, F.struct(F.regexp_replace(state["rest"], rule["pattern"], F.lit(_TAKEN)).alias("rest"), F.concat(state["names"], F.array(rule["name"])).alias("names"))).otherwise(state)

    def matched(at: Column) -> Column:
        hits = F.filter(at, lambda x: x != _OTHER)
        start = F.struct(F.regexp_replace(F.array_join(at, ""), f"({_OTHER})+", _OTHER).alias("rest"), F.array().cast("array<string>").alias("names"))
        of = F.when(F.size(hits) > 0, F.aggregate(ordered, start, step))
        return F.struct(F.transform(hits, lambda x: F.regexp_replace(x, "[<>]", "")).alias("ids"), of.alias("state"))

    scanned = rows.select("row", let(ids, matched).alias("scan"))
    none = F.array().cast("array<string>")
    return scanned.select(
        *[F.col("row")[c].alias(c) for c in own], F.coalesce("scan.ids", none).alias("sentence_ids"), F.coalesce(F.array_distinct("scan.state.names"), none).alias("licenses"),
        F.coalesce(F.regexp_count(F.col("scan.state.rest"), F.lit("<[^<>]{2,}>")), F.lit(0)).cast("long").alias("unmatched"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned by SENTENCES and RULES; identifiers and names joined by commas."""
    scanned = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "unmatched")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = {"copyright": "copyright", **SENTENCES}
    most = max(k.count(" ") + 1 for k in known)
    cut = "text"
    for pattern, replacement in _CUTS:
        cut = f"regexp_replace({cut}, {quoted(pattern)}, {quoted(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    line = f"trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    steps = [f"r0 AS (SELECT n, regexp_replace(string_agg(id, '' ORDER BY pos, i, kind), '(<x>)+', '<x>', 'g') AS rest, []::VARCHAR[] AS names FROM named GROUP BY n HAVING bool_or(id <> '<x>'))"]
    for k, (name, sequence) in enumerate(RULES):
        p = quoted(_pattern(sequence))
        steps.append(f"r{k + 1} AS (SELECT n, regexp_replace(rest, {p}, '<t>', 'g') AS rest, CASE WHEN regexp_matches(rest, {p}) THEN list_append(names, {quoted(name)}) ELSE names END AS names FROM r{k})")
    return f"""
WITH known(sentence, id) AS (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in known.items())}),
d AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
p AS (SELECT n, unnest(string_split({cut}, chr(1))) AS s, generate_subscripts(string_split({cut}, chr(1)), 1) AS pos FROM d WHERE text IS NOT NULL),
l AS (SELECT n, pos, list_filter(list_transform(string_split(s, chr(10)), lambda x: {line}), lambda x: x <> '') AS ls FROM p),
m AS (SELECT *, len(ls) AS m FROM l WHERE len(ls) > 0 AND NOT (len(ls) = 1 AND regexp_matches(ls[1], {quoted(_ENUMERATOR)}))),
a AS (SELECT n, pos, m, ls, unnest(range(1, m + 1)) AS i FROM m),
c AS (SELECT n, pos, i, unnest(range(1, least({most}, m - i + 1) + 1)) AS len, ls FROM a),
h AS (SELECT n, pos, i, max(len) AS len, max_by(id, len) AS id FROM c JOIN known ON sentence = CASE WHEN len = 1 THEN regexp_replace(ls[i], {quoted(_COPYRIGHT)}, 'copyright') ELSE array_to_string(ls[i : i + len - 1], ' ') END GROUP BY n, pos, i),
w AS (SELECT *, coalesce(max(i + len) OVER (PARTITION BY n, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS nxt FROM h),
named AS (SELECT n, pos, i, 0 AS kind, '<x>' AS id FROM w WHERE i > nxt UNION ALL SELECT n, pos, i, 1, '<' || id || '>' FROM w WHERE i >= nxt
  UNION ALL SELECT m.n, m.pos, m.m + 1, 0, '<x>' FROM m LEFT JOIN (SELECT n, pos, max(i + len) AS e FROM h GROUP BY n, pos) g ON g.n = m.n AND g.pos = m.pos WHERE coalesce(g.e, 1) < m.m + 1),
{', '.join(steps)},
ids AS (SELECT n, string_agg(replace(replace(id, '<', ''), '>', ''), ',' ORDER BY pos, i, kind) FILTER (WHERE id <> '<x>') AS ids FROM named GROUP BY n)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS licenses, coalesce(len(regexp_extract_all(rest, '<[^<>][^<>]+>')), 0)::BIGINT AS unmatched
FROM d LEFT JOIN ids USING (n) LEFT JOIN r{len(RULES)} USING (n)
"""


OP3_SQL = _sql()
