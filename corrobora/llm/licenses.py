"""Licence scanning by sentence rules, in native Spark functions only.

Every text is cut into sentences (at a full stop, question or exclamation mark
before white space, and at empty lines; semicolons and line ends keep a notice
whole). Each is normalised to lower-case letters and digits with single spaces
and mapped to the identifier of a known licence sentence (the first match in a
fixed order), to UNKNOWN if it speaks of licensing itself, or to nothing, as are
lines that hold an address alone. The sequence of identifiers is matched against
ordered rules: each rule is a run of identifiers, some of them optional, with
copyright lines before it taken along; where it occurs, its licence is found and
the run is consumed, so a longer rule placed earlier wins over a shorter one.
No row is shuffled.

Patterns are matched at word borders, and versions are read as numbers: version
1.1 of a licence is not its version 2. Each pattern has a stem, a part of a word
that any match contains; sentences and whole texts without a stem are not looked
at, which changes no result.

Defined results: a null or empty text, and one without a sentence of either
kind, has no identifiers and no licences; licences are in the order of the rules, each once; a null doc_id is kept; repeated
rows get repeated results; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sentence that matches this speaks of licensing; each alternative's stem.
SPEAKS = "licen[cs]|copyright|public domain|warrant|permission|redistribut|free software|merchantab|without restriction|gnu |cc0|rights reserved"
SPEAKS_STEMS = ["licen", "copyright", "domain", "warrant", "permission", "distribut", "software", "merchantab", "restriction", "gnu", "cc", "reserved"]

_L = "licen[cs]e"


def _v(major: int, minor: str = "( 0)?") -> str:
    """A version number, not followed by further digits."""
    return rf"(version |vers |v ?)?{major}{minor}(?! \d\b)"


#: Identifiers of known licence sentences, their stems and their patterns over normalised text, at word borders.
SENTENCES: list[tuple[str, str, str]] = [
    ("GPL_SEE", "licen", rf"see the gnu ((lesser|library|affero) )?general public {_L} for more details"),
    ("GPL_RECEIVED", "licen", rf"you should have received a copy of the .*{_L}"),
    ("GPL_HOPE", "distribut", "distributed in the hope that it will be useful"),
    ("AGPL3_LATER", "licen", rf"affero general public {_L}.*version 3(?! \d\b).*any later version"),
    ("AGPL_REF", "licen", rf"affero general public {_L}"),
    ("LGPL21_LATER", "licen", rf"(lesser|library) general public {_L}.*version 2 1.*any later version"),
    ("LGPL3_LATER", "licen", rf"(lesser|library) general public {_L}.*version 3(?! \d\b).*any later version"),
    ("LGPL2_LATER", "licen", rf"(lesser|library) general public {_L}.*version 2(?! \d\b).*any later version"),
    ("LGPL_REF21", "licen", rf"(lesser|library) general public {_L}.*(version |v)2 1"),
    ("LGPL_REF3", "licen", rf"(lesser|library) general public {_L}.*(version |v)3(?! [1-9]\b)"),
    ("LGPL_REF", "licen", rf"(lesser|library) general public {_L}"),
    ("GPL3_LATER", "licen", rf"general public {_L}.*version 3(?! [1-9]\b).*any later version"),
    ("GPL2_LATER", "licen", rf"general public {_L}.*version 2(?! [1-9]\b).*any later version"),
    ("GPL_REF3", "licen", rf"gnu general public {_L}.*(version |v)3(?! [1-9]\b)"),
    ("GPL_REF2", "licen", rf"gnu general public {_L}.*(version |v)2(?! [1-9]\b)"),
    ("GPL_REF", "licen", rf"gnu general public {_L}"),
    ("SPDX_GPL3_LATER", "licen", "spdx license identifier gpl 3 0 (or later|only or later)"),
    ("SPDX_GPL3", "licen", "spdx license identifier gpl 3 0"),
    ("SPDX_GPL2_LATER", "licen", "spdx license identifier gpl 2 0 or later"),
    ("SPDX_GPL2", "licen", "spdx license identifier gpl 2 0"),
    ("SPDX_MIT", "licen", "spdx license identifier mit"),
    ("SPDX_APACHE2", "licen", "spdx license identifier apache 2 0"),
    ("SPDX_BSD3", "licen", "spdx license identifier bsd 3 clause"),
    ("SPDX_BSD2", "licen", "spdx license identifier bsd 2 clause"),
    ("SPDX_MPL2", "licen", "spdx license identifier mpl 2 0"),
    ("GFDL_REF", "licen", rf"gnu free documentation {_L}"),
    ("APACHE2_REF", "licen", rf"apache( software)? {_L} {_v(2)}"),
    ("APACHE11_REF", "licen", rf"apache( software)? {_L} {_v(1, ' 1')}"),
    ("APACHE_COMPLY", "licen", rf"you may not use this file except in compliance with the {_L}"),
    ("APACHE_OBTAIN", "licen", rf"you may obtain a copy of the {_L}"),
    ("APACHE_ASIS", "applicable", "unless required by applicable law or agreed to in writing"),
    ("APACHE_GOVERN", "licen", rf"see the {_L} for the specific language governing permissions"),
    ("MIT_GRANT", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("MIT_NOTICE", "permission", "above copyright notice and this permission notice shall be included"),
    ("MIT_REF", "licen", rf"(mit|expat) {_L}"),
    ("X11_REF", "licen", rf"x11 {_L}"),
    ("ISC_GRANT", "permission", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided"),
    ("ZERO_BSD_GRANT", "permission", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("POSTGRES_GRANT", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("ISC_REF", "licen", rf"isc {_L}"),
    ("BSD_GRANT", "distribut", "redistribution and use in source and binary forms"),
    ("BSD_SOURCE", "distribut", "redistributions of source code must retain"),
    ("BSD_BINARY", "distribut", "redistributions in binary form must reproduce"),
    ("BSD_ADVERT", "software", "all advertising materials mentioning features or use of this software must display"),
    ("BSD_NAMES", "neither", "neither the names? of"),
    ("BSD_REF3", "bsd", rf"(3|three) clause bsd|(new|modified|revised) bsd {_L}|bsd (3|three)( clause)?"),
    ("BSD_REF2", "bsd", rf"(2|two) clause bsd|simplified bsd {_L}|bsd (2|two)( clause)?"),
    ("BSD_REF4", "bsd", rf"(4|four) clause bsd|original bsd {_L}|bsd (4|four)( clause)?"),
    ("BSD_REF", "licen", rf"bsd {_L}"),
    ("MPL2_REF", "licen", rf"mozilla public {_L} {_v(2)}"),
    ("MPL11_REF", "licen", rf"mozilla public {_L} {_v(1, ' 1')}"),
    ("MPL_OBTAIN", "distribut", "copy of the mpl was not distributed with this file"),
    ("EPL2_REF", "licen", rf"eclipse public {_L} {_v(2)}"),
    ("EPL1_REF", "licen", rf"eclipse public {_L} {_v(1)}"),
    ("EPL_REF", "licen", rf"eclipse public {_L}"),
    ("CDDL_REF", "licen", rf"common development and distribution {_L}"),
    ("UNLICENSE_REF", "software", "this is free and unencumbered software released into the public domain"),
    ("WTFPL_REF", "licen", rf"do what the fuck you want to public {_L}"),
    ("ZLIB_ORIGIN", "software", "origin of this software must not be misrepresented"),
    ("ZLIB_MARKED", "altered", "altered source versions must be plainly marked"),
    ("ZLIB_NOTICE", "altered", "this notice may not be removed or altered from any source distribution"),
    ("ZLIB_REF", "licen", rf"zlib( libpng)? {_L}"),
    ("BOOST_REF", "licen", rf"boost software {_L}"),
    ("ARTISTIC2_REF", "licen", rf"artistic {_L} {_v(2)}"),
    ("PYTHON_REF", "licen", rf"python software foundation {_L}"),
    ("OFL_REF", "licen", rf"sil open font {_L}"),
    ("EUPL_REF", "licen", rf"european union public {_L}"),
    ("MSPL_REF", "licen", rf"microsoft public {_L}"),
    ("POSTGRES_REF", "licen", rf"postgresql {_L}"),
    ("ODBL_REF", "licen", rf"open (data commons open )?database {_L}"),
    ("CC0_REF", "cc", "cc0( 1 0)?"),
    ("CC_ZERO_REF", "commons", "creative commons zero"),
    ("CC_BY_NC_SA_SHORT", "cc", "cc by nc sa"), ("CC_BY_NC_ND_SHORT", "cc", "cc by nc nd"), ("CC_BY_NC_SHORT", "cc", "cc by nc"), ("CC_BY_SA_SHORT", "cc", "cc by sa"), ("CC_BY_ND_SHORT", "cc", "cc by nd"), ("CC_BY_SHORT", "cc", "cc by"),
    ("CC_BY_NC_SA", "attribution", "attribution non ?commercial share ?alike"),
    ("CC_BY_NC_ND", "attribution", "attribution non ?commercial no ?deriv(ative)?s?( works)?"),
    ("CC_BY_NC", "attribution", "attribution non ?commercial"),
    ("CC_BY_SA", "attribution", "attribution share ?alike"),
    ("CC_BY_ND", "attribution", "attribution no ?deriv(ative)?s?( works)?"),
    ("CC_BY", "attribution", "creative commons attribution"),
    ("PUBLIC_DOMAIN", "domain", "(in|into|to) the public domain"),
    ("ASIS", "provided", "provided (by .* )?as is"),
    ("NO_LIABILITY", "shall", "in no event shall"),
    ("RIGHTS_RESERVED", "reserved", "all rights reserved"),
    ("COPYRIGHT", "copyright", "copyright"),
]

_GNU = "GPL_HOPE? GPL_SEE? GPL_RECEIVED?"
#: Licences and the runs of identifiers that name them, in order; ``?`` marks one that may be missing.
RULES: list[tuple[str, str]] = [
    ("AGPL-3.0-or-later", f"AGPL3_LATER {_GNU}"),
    ("AGPL-3.0", f"AGPL_REF {_GNU}"),
    ("LGPL-2.1-or-later", f"LGPL21_LATER {_GNU}"),
    ("LGPL-3.0-or-later", f"LGPL3_LATER {_GNU}"),
    ("LGPL-2.0-or-later", f"LGPL2_LATER {_GNU}"),
    ("LGPL-2.1", f"LGPL_REF21 {_GNU}"),
    ("LGPL-3.0", f"LGPL_REF3 {_GNU}"),
    ("LGPL", f"LGPL_REF {_GNU}"),
    ("GPL-3.0-or-later", f"GPL3_LATER {_GNU}"),
    ("GPL-3.0-or-later", "SPDX_GPL3_LATER"),
    ("GPL-2.0-or-later", f"GPL2_LATER {_GNU}"),
    ("GPL-2.0-or-later", "SPDX_GPL2_LATER"),
    ("GPL-3.0", f"GPL_REF3 {_GNU}"),
    ("GPL-3.0", "SPDX_GPL3"),
    ("GPL-2.0", f"GPL_REF2 {_GNU}"),
    ("GPL-2.0", "SPDX_GPL2"),
    ("GPL", f"GPL_REF {_GNU}"),
    ("GPL", "GPL_SEE"),
    ("GFDL", "GFDL_REF"),
    ("Apache-2.0", "APACHE2_REF APACHE_COMPLY? APACHE_OBTAIN? APACHE_ASIS? APACHE_GOVERN?"),
    ("Apache-2.0", "SPDX_APACHE2"),
    ("Apache-1.1", "APACHE11_REF"),
    ("MIT", "MIT_GRANT MIT_NOTICE ASIS? NO_LIABILITY?"),
    ("MIT", "MIT_REF"),
    ("MIT", "SPDX_MIT"),
    ("X11", "X11_REF"),
    ("ISC", "ISC_GRANT ASIS? NO_LIABILITY?"),
    ("ISC", "ISC_REF"),
    ("0BSD", "ZERO_BSD_GRANT ASIS? NO_LIABILITY?"),
    ("PostgreSQL", "POSTGRES_GRANT"),
    ("PostgreSQL", "POSTGRES_REF"),
    ("BSD-4-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ADVERT BSD_NAMES? ASIS? NO_LIABILITY?"),
    ("BSD-3-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_NAMES ASIS? NO_LIABILITY?"),
    ("BSD-2-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY ASIS? NO_LIABILITY?"),
    ("BSD-3-Clause", "BSD_REF3"),
    ("BSD-3-Clause", "SPDX_BSD3"),
    ("BSD-2-Clause", "BSD_REF2"),
    ("BSD-2-Clause", "SPDX_BSD2"),
    ("BSD-4-Clause", "BSD_REF4"),
    ("BSD", "BSD_REF"),
    ("MPL-2.0", "MPL2_REF MPL_OBTAIN?"),
    ("MPL-2.0", "SPDX_MPL2"),
    ("MPL-1.1", "MPL11_REF"),
    ("EPL-2.0", "EPL2_REF"),
    ("EPL-1.0", "EPL1_REF"),
    ("EPL", "EPL_REF"),
    ("CDDL", "CDDL_REF"),
    ("Unlicense", "UNLICENSE_REF ASIS? NO_LIABILITY?"),
    ("WTFPL", "WTFPL_REF"),
    ("Zlib", "ASIS? NO_LIABILITY? ZLIB_ORIGIN ZLIB_MARKED? ZLIB_NOTICE?"),
    ("Zlib", "ZLIB_REF"),
    ("BSL-1.0", "BOOST_REF"),
    ("Artistic-2.0", "ARTISTIC2_REF"),
    ("PSF-2.0", "PYTHON_REF"),
    ("OFL-1.1", "OFL_REF"),
    ("EUPL", "EUPL_REF"),
    ("MS-PL", "MSPL_REF"),
    ("ODbL", "ODBL_REF"),
    ("CC0-1.0", "CC0_REF"),
    ("CC0-1.0", "CC_ZERO_REF"),
    ("CC-BY-NC-SA", "CC_BY_NC_SA"), ("CC-BY-NC-SA", "CC_BY_NC_SA_SHORT"),
    ("CC-BY-NC-ND", "CC_BY_NC_ND"), ("CC-BY-NC-ND", "CC_BY_NC_ND_SHORT"),
    ("CC-BY-NC", "CC_BY_NC"), ("CC-BY-NC", "CC_BY_NC_SHORT"),
    ("CC-BY-SA", "CC_BY_SA"), ("CC-BY-SA", "CC_BY_SA_SHORT"),
    ("CC-BY-ND", "CC_BY_ND"), ("CC-BY-ND", "CC_BY_ND_SHORT"),
    ("CC-BY", "CC_BY"), ("CC-BY", "CC_BY_SHORT"),
    ("Public-Domain", "PUBLIC_DOMAIN"),
    ("Proprietary", "RIGHTS_RESERVED"),
]
#: Stems one of which is in every text with a sentence of either kind.
STEMS = sorted({s for _, s, _ in SENTENCES} | set(SPEAKS_STEMS))
#: The lines before a run that belong to its notice; not those of a run that is such a line itself.
_HEAD = "(?: (?:COPYRIGHT|RIGHTS_RESERVED) )*"


def run_pattern(run: str) -> str:
    """A rule's run as a pattern over identifiers that stand between single spaces each."""
    parts = [f"(?: {x[:-1]} )?" if x.endswith("?") else f" {x} " for x in run.split()]
    return (_HEAD if run != "RIGHTS_RESERVED" else "(?: COPYRIGHT )*") + "".join(parts)


def _any(text: Column, stems: list[str]) -> Column:
    out = F.contains(text, F.lit(stems[0]))
    for s in stems[1:]:
        out = out | F.contains(text, F.lit(s))
    return out


def _sentences(text: Column) -> Column:
    """Sentences: ended by a full stop, question or exclamation mark and white space (not "v. 2"), or an empty line; lines of an address alone are empty."""
    cut = F.regexp_replace(text, r"(?m)^[ \t]*(?:[*#;]+|//+|--+)?[ \t]*<?(?:https?://|www\.)\S+>?[ \t]*$", "\n\n")
    cut = F.regexp_replace(cut, r"(?m)^[ \t]*(?:[*#;]+|//+|--+)[ \t]*", "")
    cut = F.regexp_replace(cut, r"(?i)\b(v|vers|no)\.[ \t\r\n]+(?=\d)", "$1 ")
    cut = F.regexp_replace(cut, r"([.!?])[ \t\r\n]+|\r?\n[ \t]*\r?\n", "$1\u001f")
    return F.split(cut, "\u001f", -1)


def _normal(sentence: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _identifier(normal: Column) -> Column:
    found = None
    for name, stem, pattern in SENTENCES:
        match = F.contains(normal, F.lit(stem)) & normal.rlike(rf"\b(?:{pattern})\b")
        found = F.when(match, F.lit(name)) if found is None else found.when(match, F.lit(name))
    return F.when(_any(normal, STEMS), found.when(_any(normal, SPEAKS_STEMS) & normal.rlike(SPEAKS), F.lit("UNKNOWN")))


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, the licence sentences' identifiers in order, the licences found and the sentences left over."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spoken = F.transform(F.array(F.lower(text)), lambda t: _any(t, STEMS))[0]  # bound once: the text is made lower-case once
    text = F.when(spoken, text).otherwise("")
    known = F.filter(F.transform(F.transform(_sentences(text), _normal), _identifier), lambda x: x.isNotNull())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), known.alias("ids"))
    # identifiers stand between single spaces; a consumed run leaves one mark
    left, found = F.when(F.size("ids") > 0, F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))).otherwise(""), F.array().cast("array<string>")
    rows = rows.select("doc_id", "ids", F.struct(left.alias("left"), found.alias("found")).alias("s"))
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(run_pattern(r)).alias("run"), F.lit(_key(r)).alias("key")) for n, r in RULES))
    state = F.when(
        F.size("ids") > 0,
        F.aggregate(
            rules,
            F.col("s"),
            lambda s, r: F.when(
                F.contains(s["left"], r["key"]) & F.regexp_like(s["left"], r["run"]),
                F.struct(F.regexp_replace(s["left"], r["run"], F.lit(" # ")).alias("left"), F.array_append(s["found"], r["name"]).alias("found")),
            ).otherwise(s),
        ),
    ).otherwise(F.col("s"))
    rows = rows.select("doc_id", "ids", state["found"].alias("found"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_license_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("found"), ",").alias("licenses"),
        F.size(F.filter("ids", lambda x: x == "UNKNOWN")).cast("long").alias("n_unknown"),
    )


def _key(run: str) -> str:
    """The first identifier that a run can't miss."""
    return f" {next(x for x in run.split() if not x.endswith('?'))} "


def licenses_found(docs: DataFrame) -> DataFrame:
    """doc_id and the licences found, in alphabetical order."""
    return license_report(docs).select("doc_id", F.array_join(F.array_sort(F.split("licenses", ",")), ",").alias("licenses"))


#: The licences of each text in DuckDB, from the wording of notices and references alone: whole normalised texts, no sentences, no rules.
LICENSE_SQL = r"""
WITH n AS (SELECT doc_id, ' ' || regexp_replace(regexp_replace(lower(coalesce(text, '')), '\bv\.\s+', 'v ', 'g'), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM documents),
f AS (SELECT doc_id, t,
  regexp_matches(t, ' affero general public licen[cs]e ') AS agpl, regexp_matches(t, ' (lesser|library) general public licen[cs]e ') AS lgpl, regexp_matches(t, ' gnu general public licen[cs]e ') AS gpl,
  contains(t, ' any later version ') AS later, regexp_matches(t, ' gnu general public licen[cs]e .*?(version |v)3 ') AS three, regexp_matches(t, ' gnu general public licen[cs]e .*?(version |v)2 ') AS two,
  contains(t, ' redistribution and use in source and binary forms ') AND contains(t, ' redistributions of source code must retain ') AND contains(t, ' redistributions in binary form must reproduce ') AS bsd FROM n),
l AS (SELECT doc_id, list_filter([
  CASE WHEN agpl THEN CASE WHEN later THEN 'AGPL-3.0-or-later' ELSE 'AGPL-3.0' END END,
  CASE WHEN gpl AND three THEN CASE WHEN later THEN 'GPL-3.0-or-later' ELSE 'GPL-3.0' END WHEN gpl AND two THEN CASE WHEN later THEN 'GPL-2.0-or-later' ELSE 'GPL-2.0' END WHEN gpl THEN 'GPL' END,
  CASE WHEN lgpl THEN 'LGPL' END,
  CASE WHEN regexp_matches(t, ' apache licen[cs]e (version |v ?)?2 ') THEN 'Apache-2.0' END,
  CASE WHEN regexp_matches(t, ' mit licen[cs]e ') OR regexp_matches(t, ' permission is hereby granted free of charge to any person obtaining a copy .* above copyright notice and this permission notice shall be included ') THEN 'MIT' END,
  CASE WHEN bsd AND regexp_matches(t, ' neither the names? of ') OR regexp_matches(t, ' (3|three) clause bsd ') THEN 'BSD-3-Clause' WHEN bsd THEN 'BSD-2-Clause' WHEN regexp_matches(t, ' bsd licen[cs]e ') THEN 'BSD' END,
  CASE WHEN regexp_matches(t, ' mozilla public licen[cs]e (version |v ?)?2 ') THEN 'MPL-2.0' END,
  CASE WHEN regexp_matches(t, ' cc0 ') OR contains(t, ' creative commons zero ') THEN 'CC0-1.0' END,
  CASE WHEN regexp_matches(t, ' (cc by|attribution) (nc|non ?commercial) (sa|share ?alike) ') THEN 'CC-BY-NC-SA' WHEN regexp_matches(t, ' (cc by|attribution) (nc|non ?commercial) (nd|no ?deriv)') THEN 'CC-BY-NC-ND' WHEN regexp_matches(t, ' (cc by|attribution) (nc|non ?commercial) ') THEN 'CC-BY-NC'
    WHEN regexp_matches(t, ' (cc by|attribution) (sa|share ?alike) ') THEN 'CC-BY-SA' WHEN regexp_matches(t, ' (cc by|attribution) (nd|no ?deriv)') THEN 'CC-BY-ND' WHEN regexp_matches(t, ' (cc by|creative commons attribution) ') THEN 'CC-BY' END,
  CASE WHEN regexp_matches(t, ' (in|into|to) the public domain ') THEN 'Public-Domain' END,
  CASE WHEN contains(t, ' all rights reserved ') THEN 'Proprietary' END], lambda x: x IS NOT NULL) AS found FROM f)
SELECT doc_id, array_to_string(list_sort(found), ',') AS licenses FROM l
"""


def license_sql() -> str:
    return LICENSE_SQL
