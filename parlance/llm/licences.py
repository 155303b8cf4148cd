"""Licence scans by sentence rules.

A text is cut into sentences at line breaks and after . ; ! ? with white space, and normalised
(ASCII letters and digits in lower case, everything else, comment leaders too, one space). Known
licence sentences are found where they begin and end at a cut; a single line break may stand for
any of their spaces, so wrapped texts count, but a blank line always ends one. The identifiers
found, in the order of the text, are matched against ordered rules: a rule is a run of
identifiers and names a licence; what it matches is consumed before the next rule. Copyright lines are recognised by their form.

Everything is built-in column functions within a row: nothing is shuffled. Null and empty texts
have no sentences and no licences. Repeated rows and null ids each give a row. Extra columns of
the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Sentences of public licence texts and notices, normalised, by identifier.
SENTENCES = {
    "copyright": "copyright",
    "all_rights": "all rights reserved",
    "apache2_under": "licensed under the apache license version 2 0",
    "apache2_under_the_license": "licensed under the apache license version 2 0 the license",
    "apache2_comply": "you may not use this file except in compliance with the license",
    "apache2_copy_at": "you may obtain a copy of the license at",
    "mit_released": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl2_work": "this work is licensed under the gnu general public license version 2",
    "gpl3_program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl2_program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "agpl3_program": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_library": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_library": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl_warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "apache2_unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2_see": "see the license for the specific language governing permissions and limitations under the license",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd_as_is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "mpl2_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2_source": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_4": "licensed under cc by 4 0",
    "cc_by_sa_4": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "spdx_mit": "spdx license identifier mit",
    "spdx_apache2": "spdx license identifier apache 2 0",
    "spdx_gpl3": "spdx license identifier gpl 3 0 or later",
}
# Rules in order: longer runs stand before the runs that they contain.
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "as_is"]), ("MIT", ["mit_grant", "mit_notice"]), ("MIT", ["mit_grant"]), ("MIT", ["mit_released"]),
    ("MIT", ["mit_licensed"]), ("MIT", ["spdx_mit"]), ("ISC", ["isc_grant", "isc_as_is"]), ("ISC", ["isc_grant"]),
    ("Zlib", ["zlib_as_is", "zlib_grant"]), ("Zlib", ["zlib_grant"]), ("BSL-1.0", ["boost_grant"]), ("Unlicense", ["unlicense_free", "unlicense_anyone"]), ("Unlicense", ["unlicense_free"]),
    ("BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_name", "bsd_as_is"]), ("BSD-3-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_name"]),
    ("BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_as_is"]), ("BSD-2-Clause", ["bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("BSD", ["bsd_redistribution"]),
    ("Apache-2.0", ["apache2_under_the_license", "apache2_comply", "apache2_copy_at", "apache2_unless", "apache2_see"]), ("Apache-2.0", ["apache2_under_the_license", "apache2_comply", "apache2_copy_at"]),
    ("Apache-2.0", ["apache2_under_the_license"]), ("Apache-2.0", ["apache2_under"]), ("Apache-2.0", ["spdx_apache2"]),
    ("GPL-3.0-or-later", ["gpl3_program", "gpl_warranty"]), ("GPL-3.0-or-later", ["gpl3_program"]), ("GPL-3.0-or-later", ["spdx_gpl3"]),
    ("GPL-2.0-or-later", ["gpl2_program", "gpl_warranty"]), ("GPL-2.0-or-later", ["gpl2_program"]), ("AGPL-3.0-or-later", ["agpl3_program", "gpl_warranty"]), ("AGPL-3.0-or-later", ["agpl3_program"]),
    ("LGPL-2.1-or-later", ["lgpl21_library", "lgpl_warranty"]), ("LGPL-2.1-or-later", ["lgpl21_library"]), ("LGPL-3.0-or-later", ["lgpl3_library", "lgpl_warranty"]), ("LGPL-3.0-or-later", ["lgpl3_library"]),
    ("GPL-3.0", ["gpl3_work"]), ("GPL-2.0", ["gpl2_work"]), ("MPL-2.0", ["mpl2_source", "mpl2_copy"]), ("MPL-2.0", ["mpl2_source"]), ("CC-BY-NC-4.0", ["cc_by_nc_4"]), ("CC-BY-SA-4.0", ["cc_by_sa_4"]),
    ("CC-BY-4.0", ["cc_by_4"]), ("CC0-1.0", ["cc0"]), ("Proprietary", ["copyright", "all_rights"]), ("Proprietary", ["all_rights"]),
]
#: Every known sentence holds one of these, so texts without them need no cutting.
ANCHORS = "licen|copyright|permission|redistribution|provided as is|all rights reserved|without any warranty|unencumbered|anyone is free|mozilla org mpl"
COPYRIGHT = "^(copyright )(c |[0-9]{4}).*$"
#: What stands for the end of a sentence and for a blank line in a marked text; a line feed is a single line break.
END, BLANK = "\x01", "\x02"
#: Usual texts have an end mark after these words of a known sentence.
INNER = (("without any warranty", "without even"), ("license v", "2 0"), ("free software", "you can"), ("software foundation", "either version"))


def run_text(ids: list[str]) -> str:
    return "".join(f" {i} " for i in ids)


def _pattern() -> str:
    """Any known sentence between cuts, the longest first."""
    forms = [f"copyright (?:c |[0-9]{{4}})[^\n{END}{BLANK}]*"]
    for sentence in sorted(SENTENCES.values(), key=len, reverse=True):
        for before, after in INNER:
            sentence = sentence.replace(f"{before} {after}", f"{before}{END}{after}")
        forms.append(sentence.replace(" ", "[ \n]").replace(END, f"[ \n{END}]"))
    cut = f"[\n{END}{BLANK}]"
    return f"(?<={cut})(?:{'|'.join(forms)})(?={cut})"


def marked(text: Column) -> Column:
    """The normalised text with its cuts as single marks, and one at either end."""
    out = F.lower(F.translate(text, END + BLANK, "--"))
    for pattern, new in (
        ("\r\n?", "\n"), ("[.;!?][ \t\n]+", END), (f"[^a-z0-9\n{END}]+", " "), (f" *{END}[ \n{END}]*", END), (" *\n *\n[ \n]*", BLANK), (" *\n *", "\n"),
    ):
        out = F.regexp_replace(out, pattern, new)
    return F.concat(F.lit(BLANK), F.trim(out), F.lit(BLANK))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licences): both arrays, in the order of the text and of the rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")).rlike(ANCHORS)
    hits = F.when(held, F.regexp_extract_all(marked(text), F.lit(_pattern()), F.lit(0))).otherwise(F.array().cast("array<string>"))
    formed = F.transform(hits, lambda s: F.regexp_replace(F.translate(s, f"\n{END}", "  "), COPYRIGHT, "copyright"))
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    found = docs.select(F.col(id_col).alias("doc_id"), F.array_compact(F.transform(formed, lambda s: F.try_element_at(known, s))).alias("sentence_ids"))
    rest, named = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit(" "), i, F.lit(" "))), ""), []
    step = found.withColumn("_0", rest)
    for k, (licence, ids) in enumerate(RULES):
        run = run_text(ids)
        named.append(F.when(F.contains(F.col(f"_{k}"), F.lit(run)), F.lit(licence)))
        step = step.withColumn(f"_{k + 1}", F.replace(F.col(f"_{k}"), F.lit(run), F.lit("|")))
    return step.select("doc_id", "sentence_ids", F.array_distinct(F.array_compact(F.array(*named))).alias("licences"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    steps, named, before = [], [], "hits"
    for k, (licence, ids) in enumerate(RULES):
        steps.append(f"r{k} AS (SELECT *, CASE WHEN contains(s{k}, '{run_text(ids)}') THEN '{licence}' END AS l{k}, replace(s{k}, '{run_text(ids)}', '|') AS s{k + 1} FROM {before})")
        named.append(f"l{k}")
        before = f"r{k}"
    uniq = f"list_filter([{', '.join(named)}], lambda x: x IS NOT NULL)"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
numbered AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
sentences AS (
  SELECT rid, unnest(parts) AS s, generate_subscripts(parts, 1) AS place
  FROM (SELECT rid, regexp_split_to_array(regexp_replace(text, '([.;!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '[\\r\\n]+') AS parts FROM numbered)
),
normal AS (SELECT rid, place, regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), '{COPYRIGHT}', 'copyright') AS sentence FROM sentences),
matched AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY place) AS ids, string_agg(' ' || id || ' ', '' ORDER BY place) AS s0 FROM normal JOIN known USING (sentence) GROUP BY rid),
hits AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(s0, '') AS s0 FROM numbered LEFT JOIN matched USING (rid)),
{", ".join(steps)},
lists AS (SELECT doc_id, n_sentences, sentence_ids, {uniq} AS xs FROM {before})
SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), ',') AS licences FROM lists
"""


SQL = _sql()
