"""License scans by sentence-rule recognition, on built-in functions only.

A text is cut into pieces at line ends and behind closing punctuation (but not behind the colon of a license tag or the
point of "v. 2.0"). Pieces that one sentence was wrapped into are joined: a sentence ends with closing punctuation, at a line without ASCII letters and digits, and before a line that opens
a known sentence. What may speak of a license is normalised and mapped to known identifiers. A joined sentence that is
known counts as one, unless a piece of it is known as something else; else its pieces count each. The identifiers of a document, in order, are matched against ordered
rules: a rule that finds its sequence takes those identifiers out and adds its license, so that longer rules win
over the shorter ones behind them. A license tag gives one identifier for each license of its expression, whatever joins them. All of it happens inside the row: no shuffle, no join.

Defined cases: NULL and empty texts have no sentences and no license; a sentence that speaks of a license but is not
known counts as unknown and breaks sequences; each license is named once, in rule order; repeated rows get the same
result; an empty table gives no rows; a very long text is cut and matched inside its row, a text without any keyword not at
all; of overlapping rules the first in order takes its identifiers; extra columns are ignored under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.text import whole

#: What a sentence needs to be looked at.
KEYWORDS = "licen[cs]|copyright|warrant|redistribut|permission|public domain|spdx|all rights|liab"

#: Identifier and the pattern of the whole normalised sentence; the first that fits counts.
SENTENCES = [
    ("copyright", r"(?:c )?copyright .*|.*all rights reserved"),
    ("mit-name", r"(?:(?:this .* is )?(?:released|licensed|distributed|available) under )?the mit license"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy .*"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included .*"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose .*"),
    ("apache-2-name", r"(?:(?:this .* is )?(?:released|licensed|distributed|available) under )?the apache license version 2 0(?: the license)?"),
    ("apache-2-comply", r"you may not use this file except in compliance with the license"),
    ("gpl-2-later", r".*gnu general public license.* version 2.* any later version"),
    ("gpl-3-later", r".*gnu general public license.* version 3.* any later version"),
    ("lgpl-2.1", r".*gnu lesser general public license.* version 2 1"),
    ("lgpl-3", r".*gnu lesser general public license.* version 3"),
    ("agpl-3", r".*gnu affero general public license.* version 3"),
    ("gpl-2", r".*gnu general public license.* version 2"),
    ("gpl-3", r".*gnu general public license.* version 3"),
    ("cc-by-4", r"(?:.*licensed under )?(?:a )?cc by 4 0"),
    ("cc-by-sa-4", r"(?:.*licensed under )?(?:a )?cc by sa 4 0"),
    ("cc-by-nc-4", r"(?:.*licensed under )?(?:a )?cc by nc 4 0"),
    ("cc0", r".*(?:cc0 1 0|dedicated to the public domain).*"),
    ("mpl-2", r".*mozilla public license (?:v|version )?2 0"),
    ("bsd-redistribute", r"redistribution and use in source and binary forms .* are permitted .*"),
    ("bsd-source", r"(?:1 )?redistributions of source code must retain .*"),
    ("bsd-binary", r"(?:2 )?redistributions in binary form must reproduce .*"),
    ("bsd-endorse", r"(?:3 )?neither the name of .* may be used to endorse .*"),
    ("as-is", r"(?:this|the) software is provided .*as is.*"),
    ("no-liability", r"in no event shall .* liable .*"),
]

#: License and the identifiers that stand for it, in the order of the trial.
RULES = [
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse", "as-is", "no-liability"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "as-is", "no-liability"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant", "as-is"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-2-name", "apache-2-comply"]),
    ("Apache-2.0", ["apache-2-name"]),
    ("MIT", ["mit-name"]),
    ("GPL-2.0-or-later", ["gpl-2-later"]),
    ("GPL-3.0-or-later", ["gpl-3-later"]),
    ("LGPL-2.1", ["lgpl-2.1"]),
    ("LGPL-3.0", ["lgpl-3"]),
    ("AGPL-3.0", ["agpl-3"]),
    ("GPL-2.0", ["gpl-2"]),
    ("GPL-3.0", ["gpl-3"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC0-1.0", ["cc0"]),
    ("MPL-2.0", ["mpl-2"]),
]

#: More fixed values, tried after those above: what stands around the sentences above in the usual license texts.
MORE_SENTENCES = [
    ("mit-name", r"(?:the )?mit license(?: mit)?"),
    ("isc-name", r"(?:the )?isc license(?: isc)?"),
    ("bsd-3-name", r"(?:the )?(?:bsd 3 clause|new bsd|modified bsd|3 clause bsd)(?: new or revised)? license"),
    ("bsd-2-name", r"(?:the )?(?:bsd 2 clause|simplified bsd|2 clause bsd)(?: simplified)? license"),
    ("isc-grant", r"permission to use copy modify and distribute this software for any purpose with or without fee .*"),
    ("apache-2-name", r"apache license version 2 0 january 2004(?: https? www apache org licenses)?"),
    ("apache-2-copy", r"you may obtain a copy of the license at(?: https? www apache org licenses license 2 0)?"),
    ("apache-2-address", r"https? www apache org licenses license 2 0"),
    ("apache-2-basis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis .*"),
    ("apache-2-limits", r"see the license for the specific language governing permissions and limitations under the license"),
    ("lgpl-2.1-later", r".*gnu lesser general public license.* version 2 1.* any later version"),
    ("lgpl-3-later", r".*gnu lesser general public license.* version 3.* any later version"),
    ("agpl-3-later", r".*gnu affero general public license.* version 3.* any later version"),
    ("gpl-2", r"gnu general public license version 2 june 1991"),
    ("gpl-3", r"gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", r"gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", r"gnu affero general public license version 3 19 november 2007"),
    ("gpl-terms", r".*under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl-terms", r".*under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("2-later", r"either version 2 of the license or at your option any later version"),
    ("2.1-later", r"either version 2 1 of the license or at your option any later version"),
    ("3-later", r"either version 3 of the license or at your option any later version"),
    ("2-only", r"version 2(?: of the license)?"),
    ("3-only", r"version 3(?: of the license)?"),
    ("gpl-hope", r"this (?:program|library|software) is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-details", r"see the gnu (?:lesser |affero )?general public license for more details"),
    ("gpl-copy", r"you should have received a copy of the gnu (?:lesser |affero )?general public license along with this (?:program|library|software).*"),
    ("gpl-address", r"if not (?:see|write to) .*"),
    ("bsd-endorse", r"nor the names? of .* may be used to endorse .*"),  # behind "Neither the name of X Inc."
    ("no-liability", r"in no event will the authors? be held liable .*"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications .*"),
    ("mit-name", r"(?:.* )?(?:released|licensed|distributed|available) under (?:the terms of )?the mit license(?: mit)?(?: see .*)?"),
    ("mit-name", r"(?:the )?mit license see .*"),
    ("apache-2-name", r"(?:or|and)(?: at your option)? the apache license version 2 0"),
    ("apache-2-name", r"(?:.* )?(?:released|licensed|distributed|available) under (?:the terms of )?(?:the )?apache (?:license )?(?:version |v )?2 0(?: license)?(?: see .*)?"),
    ("cc-by-sa-4", r"(?:.*licensed under )?(?:a |the )?creative commons attribution sharealike 4 0(?: international)?(?: public)?(?: license)?"),
    ("cc-by-nc-4", r"(?:.*licensed under )?(?:a |the )?creative commons attribution noncommercial 4 0(?: international)?(?: public)?(?: license)?"),
    ("cc-by-4", r"(?:.*licensed under )?(?:a |the )?creative commons attribution 4 0(?: international)?(?: public)?(?: license)?"),
    ("lgpl-3-later", r"(?:.* )?gnu lesser general public license v ?3(?: 0)? or later"),
    ("agpl-3-later", r"(?:.* )?gnu affero general public license v ?3(?: 0)? or later"),
    ("gpl-2-later", r"(?:.* )?gnu general public license v ?2(?: 0)? or later"),
    ("gpl-3-later", r"(?:.* )?gnu general public license v ?3(?: 0)? or later"),
    ("lgpl-2.1", r"(?:.* )?gnu lesser general public license v ?2 1(?: only)?"),
    ("lgpl-3", r"(?:.* )?gnu lesser general public license v ?3(?: 0)?(?: only)?"),
    ("agpl-3", r"(?:.* )?gnu affero general public license v ?3(?: 0)?(?: only)?"),
    ("gpl-2", r"(?:.* )?gnu general public license v ?2(?: 0)?(?: only)?"),
    ("gpl-3", r"(?:.* )?gnu general public license v ?3(?: 0)?(?: only)?"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license (?:v |v|version )2 0"),
    ("epl-2", r".*eclipse public license (?:v |v|version )?2 0.*"),
    ("epl-1", r".*eclipse public license (?:v |v|version )?1 0.*"),
    ("boost-name", r"(?:.* )?boost software license version 1 0.*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("liability-theory", r"or business interruption however caused and on any theory of liability .*"),
]

#: More fixed values: rules behind those above.
MORE_RULES = [
    ("GPL-2.0-or-later", ["gpl-terms", "2-later"]),
    ("GPL-3.0-or-later", ["gpl-terms", "3-later"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "2.1-later"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "3-later"]),
    ("GPL-2.0", ["gpl-terms", "2-only"]),
    ("GPL-3.0", ["gpl-terms", "3-only"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-later"]),
    ("LGPL-3.0-or-later", ["lgpl-3-later"]),
    ("AGPL-3.0-or-later", ["agpl-3-later"]),
    ("BSD-3-Clause", ["bsd-3-name"]),
    ("BSD-2-Clause", ["bsd-2-name"]),
    ("ISC", ["isc-name"]),
    ("Zlib", ["as-is", "no-liability", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("EPL-2.0", ["epl-2"]),
    ("EPL-1.0", ["epl-1"]),
    ("BSL-1.0", ["boost-name"]),
    ("Unlicense", ["unlicense"]),
]

#: Licenses that a tag may name, under names of their own.
SPDX = (
    "0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 "
    "CC0-1.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 ISC MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL "
    "PostgreSQL Python-2.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1 AGPL-3.0 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0"
).split()
#: Of these a tag says `-only` (or nothing), or `-or-later` (or +).
LATER = ("AGPL-", "GPL-", "LGPL-")
#: Lower-case names in tags, and the license that each stands for.
TAGS = {
    name.lower(): license_name
    for base in SPDX
    for name, license_name in (
        [(base, base), (f"{base}-only", base), (f"{base}-or-later", f"{base}-or-later"), (f"{base}+", f"{base}-or-later")]
        if base.startswith(LATER)
        else [(base, base), (f"{base}+", base)]
    )
}
TAG_RULES = [(license_name, [f"spdx-{name}"]) for name, license_name in TAGS.items()]
ALL_RULES = RULES + MORE_RULES + TAG_RULES

#: What a normalised line begins with if a sentence of its own begins there.
OPENINGS = (
    r"permission (?:is hereby granted|to use copy)|"
    r"(?:[0-9] )?redistributions? (?:and use in source|of source code|in binary form)|(?:[0-9] )?neither the name of|"
    r"the above copyright notice and this permission notice|(?:this|the) software is provided|in no event shall|spdx license|"
    r"all rights reserved|unless required by applicable law|(?:this .* is )?(?:released|licensed|distributed|available) under (?:the (?:mit|apache|gnu|mozilla)|a |cc )"
)

#: How a line of a copyright begins, and what is none for all that.
COPYRIGHT, NO_COPYRIGHT = r"(?:c )?copyright ", r"(?:c )?copyright (?:notice|holder|owner|law|licen|and |or |statement)"

#: A license tag, the expression behind it, an exception in that, and what joins its licenses.
TAG = r"(?i)spdx-license-identifier"
EXPRESSION = TAG + r"[: \t]+([A-Za-z0-9.+() -]+)"
EXCEPTION, JOINT = r"(?i)\s+with\s+[A-Za-z0-9.-]+", r"(?i)\s+(?:and|or)\s+|[()\s]+"
#: What isn't cut: the colon of a tag, the point of an abbreviated version.
UNCUT = ((TAG + r":[ \t]*", "SPDX-License-Identifier "), (r"\b([vV]|[vV]ers?)\.[ \t]+([0-9])", "{1} {2}"))

UNKNOWN = "unknown"
#: Before a piece that begins a sentence, and before one that goes on with it.
BEGINS, GOES_ON = "\x01", "\x02"


def sentences(text: Column) -> Column:
    kept = whole(text)
    for pattern, whole_form in UNCUT:
        kept = F.regexp_replace(kept, pattern, whole_form.format("", "$1", "$2"))
    return F.split(F.regexp_replace(kept, r"([.!?;:])[ \t]+", "$1\n"), "\n")


def _tagged(sentence: Column) -> Column:
    """Identifiers of the licenses in a tag's expression."""
    names = F.split(F.regexp_replace(F.regexp_extract(sentence, EXPRESSION, 1), EXCEPTION, ""), JOINT)
    known = F.create_map(*[F.lit(x) for name in TAGS for x in (name, f"spdx-{name}")])
    return F.transform(F.array_remove(names, ""), lambda n: F.coalesce(F.try_element_at(known, F.lower(n)), F.lit(UNKNOWN)))


def normalised(sentence: Column) -> Column:
    """Small ASCII letters and digits, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _identifier(sentence: Column) -> Column:
    known = F.lit(UNKNOWN)
    for name, pattern in reversed(SENTENCES + MORE_SENTENCES):
        known = F.when(sentence.rlike(f"^(?:{pattern})$"), name).otherwise(known)
    return known


def _marked(pieces: str) -> Column:
    """The pieces in one text, each behind a mark that tells whether it begins a sentence."""

    def mark(piece: Column, i: Column) -> Column:
        before = F.get(F.col(pieces), i - 1)
        begins = (
            (i == 0)
            | before.rlike(r"""[.!?;:]["')\]]*[ \t\r]*$""")
            | ~before.rlike("[a-zA-Z0-9]")
            | ~piece.rlike("[a-zA-Z0-9]")
            | normalised(piece).rlike(f"^(?:{OPENINGS})")
            | (normalised(piece).rlike(f"^{COPYRIGHT}") & ~normalised(piece).rlike(f"^{NO_COPYRIGHT}"))
        )
        return F.concat(F.when(begins, BEGINS).otherwise(GOES_ON), F.translate(piece, BEGINS + GOES_ON, "  "))

    return F.array_join(F.transform(F.col(pieces), mark), "")


def _identifiers(sentence: Column) -> Column:
    """Identifiers of a sentence: one if it is known as a whole, else those of its pieces."""
    speaks = lambda s: s.rlike(f"(?i){KEYWORDS}")
    pieces = F.filter(F.split(sentence, GOES_ON), speaks)
    each = F.transform(F.transform(pieces, normalised), _identifier)
    joined = F.translate(sentence, GOES_ON, " ")
    known = F.when(F.contains(sentence, F.lit(GOES_ON)) & speaks(joined), _identifier(normalised(joined)))
    # Computed once: the fields of a one-element array.
    both = F.array(F.struct(each.alias("each"), F.coalesce(known, F.lit(UNKNOWN)).alias("known")))

    def chosen(b: Column) -> Column:
        fits = F.forall(b["each"], lambda i: i.isin(UNKNOWN, "copyright") | (i == b["known"]) | (F.concat(i, F.lit("-later")) == b["known"]))
        return F.when(~b["known"].isin(UNKNOWN, "copyright") & fits, F.array(b["known"])).otherwise(b["each"])

    return F.when(joined.rlike(TAG), _tagged(joined)).otherwise(F.flatten(F.transform(both, chosen)))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, sentence_ids, licenses (arrays), n_unknown."""
    # A text without any keyword has no sentence to cut.
    cut = F.when(whole(F.col("text")).rlike(f"(?i){KEYWORDS}"), sentences(F.col("text"))).otherwise(F.array().cast("array<string>"))
    marked = docs.select("doc_id", cut.alias("pieces")).select("doc_id", _marked("pieces").alias("marked"))
    spoken = F.filter(F.split("marked", BEGINS), lambda s: F.translate(s, GOES_ON, " ").rlike(f"(?i){KEYWORDS}"))
    found = marked.select("doc_id", F.flatten(F.transform(spoken, _identifiers)).alias("sentence_ids"))
    rules = F.array(
        *[F.struct(F.lit(name).alias("license"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in ALL_RULES]
    )
    start = F.struct(
        F.concat_ws("", F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">")))).alias("left"),
        F.array().cast("array<string>").alias("licenses"),
    )
    step = lambda acc, rule: F.when(
        F.instr(acc["left"], rule["ids"]) > 0,
        F.struct(
            F.replace(acc["left"], rule["ids"], F.lit("|")).alias("left"),
            F.array_append(acc["licenses"], rule["license"]).alias("licenses"),
        ),
    ).otherwise(acc)
    matched = F.aggregate(rules, start, step)
    return found.select(
        "doc_id",
        "sentence_ids",
        F.when(F.size("sentence_ids") > 0, F.array_distinct(matched["licenses"])).otherwise(F.array().cast("array<string>")).alias("licenses"),
        F.size(F.filter("sentence_ids", lambda i: i == UNKNOWN)).cast("long").alias("n_unknown"),
    )
