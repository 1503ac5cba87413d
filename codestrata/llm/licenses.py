"""Licence recognition by sentence rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of licence texts and notices, by identifier; wordings of one identifier are equivalent.
SENTENCES = {
    "apache-short": ("licensed under the apache license version 2 0", "released under the apache license version 2 0", "distributed under the apache license version 2 0"),
    "apache-you-may-not": ("you may not use this file except in compliance with the license",),
    "apache-obtain": ("you may obtain a copy of the license at",),
    "apache-as-is": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "apache-copyright": ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",),
    "apache-patent": ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work",),
    "mit-short": ("released under the mit license", "distributed under the mit license", "available under the mit license"),
    "mit-licensed": ("licensed under the mit license", "licensed under the terms of the mit license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-as-is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "0bsd-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "bsd-redistribution": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-advertising": ("all advertising materials mentioning features or use of this software must display the following acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgment"),
    "bsd-no-endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    "gpl2-preamble": ("the licenses for most software are designed to take away your freedom to share and change it",),
    "gpl2-scope": ("activities other than copying distribution and modification are not covered by this license they are outside its scope",),
    "gpl2-subject": ("this license applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public license",),
    "lgpl21-applies": ("this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it",),
    "gpl3-preamble": ("the gnu general public license is a free copyleft license for software and other kinds of works",),
    "agpl3-preamble": ("the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",),
    "gpl3-granted": ("all rights granted under this license are granted for the term of copyright on the program and are irrevocable provided the stated conditions are met",),
    "lgpl3-incorporates": ("this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",),
    "gpl3-short": ("this work is licensed under the gnu general public license version 3",),
    "gpl2-short": ("this work is licensed under the gnu general public license version 2",),
    "mpl2-form": ("this source code form is subject to the terms of the mozilla public license v",),
    "mpl2-obtain": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    "mpl2-title": ("mozilla public license version 2 0",),
    "mpl2-grant": ("each contributor hereby grants you a world wide royalty free non exclusive license",),
    "epl2-notice": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0"),
    "epl1-notice": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",),
    "epl2-title": ("eclipse public license v 2 0",),
    "epl-accompanying": ("the accompanying program is provided under the terms of this eclipse public license agreement", "the accompanying program is provided under the terms of this eclipse public license"),
    "unlicense-free": ("this is free and unencumbered software released into the public domain",),
    "unlicense-anyone": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "cc0-waived": ("has waived all copyright and related or neighboring rights to",),
    "cc0-title": ("cc0 1 0 universal",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "zlib-origin": ("the origin of this software must not be misrepresented you must not claim that you wrote the original software",),
    "boost-grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "boost-short": ("distributed under the boost software license version 1 0",),
    "psf-grant": ("psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly prepare derivative works distribute and otherwise use python alone or in any derivative version",),
    "wtfpl": ("you just do what the fuck you want to",),
}
#: Notices of the GNU family are made by a rule: a licence's name, its SPDX stem and its versions.
GNU = (("general", "GPL", ("1", "2", "3")), ("lesser general", "LGPL", ("2.1", "3")), ("library general", "LGPL", ("2",)), ("affero general", "AGPL", ("3",)))
#: Creative Commons notices are made from elements and versions; SPDX tags from identifiers.
ELEMENTS = {"BY": "attribution", "SA": "sharealike", "NC": "noncommercial", "ND": "noderivatives"}
COMMONS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
TAGGED = ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "Zlib", "BSL-1.0")
#: Ordered rules: the first in this list wins where two match the same sentences; longer sequences come before their parts.
RULES = [
    ("Apache-2.0", ("apache-short", "apache-you-may-not", "apache-obtain", "apache-as-is")),
    ("Apache-2.0", ("apache-copyright", "apache-patent")),
    ("Apache-2.0", ("apache-short",)),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-no-endorse")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-no-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("LGPL-2.1-only", ("gpl2-preamble", "lgpl21-applies", "gpl2-scope")),
    ("LGPL-2.1-only", ("gpl2-preamble", "lgpl21-applies")),
    ("GPL-2.0-only", ("gpl2-preamble", "gpl2-subject", "gpl2-scope")),
    ("AGPL-3.0-only", ("agpl3-preamble", "gpl3-granted")),
    ("GPL-3.0-only", ("gpl3-preamble", "gpl3-granted")),
    ("LGPL-3.0-only", ("lgpl3-incorporates",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-obtain")),
    ("MPL-2.0", ("mpl2-title", "mpl2-grant")),
    ("EPL-2.0", ("epl2-notice",)),
    ("EPL-1.0", ("epl1-notice",)),
    ("EPL-2.0", ("epl2-title", "epl-accompanying")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-waived",)),
    ("CC0-1.0", ("cc0-title",)),
    ("Zlib", ("zlib-grant", "zlib-origin")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-short",)),
    ("PSF-2.0", ("psf-grant",)),
    ("WTFPL", ("wtfpl",)),
]


def _words(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


for _version in ("1", "2", "2.1", "3"):
    SENTENCES[f"gnu-{_version}-later"] = (f"either version {_words(_version)} of the license or at your option any later version", f"either version {_words(_version)} or at your option any later version")
    SENTENCES[f"gnu-{_version}"] = (f"version {_words(_version)} of the license", f"version {_words(_version)} as published by the free software foundation")
for _name, _stem, _versions in GNU:
    _free = f"gnu-{_name.replace(' ', '-')}-free"
    SENTENCES[_free] = tuple(f"this {x} is free software you can redistribute it and or modify it under the terms of the gnu {_name} public license" for x in ("program", "library", "file"))
    for _version in _versions:
        _long = _version if "." in _version else f"{_version}.0"
        RULES += [(f"{_stem}-{_long}-or-later", (_free, f"gnu-{_version}-later")), (f"{_stem}-{_long}-only", (_free, f"gnu-{_version}"))]
for _name in COMMONS:
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        SENTENCES[f"cc-{_name}-{_version}"] = (f"licensed under cc {_words(_name)} {_words(_version)}", *([f"licensed under a creative commons {' '.join(ELEMENTS[x] for x in _name.split('-'))} 4 0 international license"] if _version == "4.0" else []))
        RULES.append((f"CC-{_name}-{_version}", (f"cc-{_name}-{_version}",)))
for _name in TAGGED:
    SENTENCES[f"spdx-{_name}"] = (f"spdx license identifier {_words(_name)}",)
    RULES.append((_name, (f"spdx-{_name}",)))
#: A line break with the next line's indent, comment mark and list number; two in a row are a blank line.
BREAK = r"(?:\r\n|\r|\n)[ \t]*+(?:[#*/;%>!-]++[ \t]*+)?+(?:\(?[0-9]{1,2}[.)][ \t]++)?+"
#: Sentences end at blank lines and at . ! ? before white space or the end.
ENDS = r"\n\n+|[.!?]+(?=\s|$)"
#: Parts of words, of which every sentence of the table has one; other texts are not searched.
HINT = r"(?i)licen|permi|redistribut|copyright|software|version|mozilla|domain|cc0|fuck"
_NAMES = tuple(SENTENCES)
_WORDINGS = {text: name for name, texts in SENTENCES.items() for text in texts}


#: The table's sentences as whole words, the longest first; not denied, nor widened to later versions.
FOUND = r"(?<![a-z0-9])(?<!\bnot )(?<!\bnever )(" + "|".join(sorted(_WORDINGS, key=lambda x: (-len(x), x))) + r")(?![a-z0-9])(?! or (?:at your option )?(?:any )?later)"


def normalised(text: Column) -> Column:
    """Words of a-z and 0-9 with a space between two and a | between sentences."""
    lines = F.regexp_replace(F.translate(F.lower(text), "|", " "), BREAK, "\n")
    words = F.regexp_replace(F.regexp_replace(lines, ENDS, "|"), "[^a-z0-9|]+", " ")
    # licences put their own holder's name here
    return F.regexp_replace(words, "neither the name of (?:[a-z0-9]+[ |]+){1,12}nor the names of", "neither the name of the copyright holder nor the names of")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (recognised sentences in order), licenses (distinct, sorted), n_matches.

    Lines are joined, so notices may be wrapped and inside comments; a sentence of the table counts wherever it stands as
    whole words inside one sentence of the text. A rule matches where its identifiers follow one another in the sequence of
    recognised sentences; other sentences between them do not count. A sentence is used once: rules are tried in order and what one matched is taken out.
    Null or empty text gives empty arrays and 0; rows are independent; other columns are ignored. One projection: no
    shuffle, no Python.
    """
    text = F.coalesce("text", F.lit(""))
    table, place = F.array(*map(F.lit, _WORDINGS)), F.array(*[F.lit(_NAMES.index(n) + 1) for n in _WORDINGS.values()])
    ids = F.transform(F.regexp_extract_all(normalised(text), F.lit(FOUND), F.lit(1)), lambda s: F.element_at(place, F.array_position(table, s).cast("int")))
    rows = docs.select("doc_id", F.when(F.regexp_like(F.lower(text), F.lit(HINT)), ids).otherwise(F.array().cast("array<int>")).alias("ids"))
    # identifiers as text, |3||4|, so that a rule is a substring; a matched rule becomes a # that no later one crosses
    written = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("|"), i.cast("string"), F.lit("|"))), "")
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{_NAMES.index(s) + 1}|" for s in rule)).alias("mark")) for name, rule in RULES])
    none = F.expr("cast(array() as array<struct<name:string,n:bigint>>)")

    def match(acc, rule):
        n = ((F.length(acc["left"]) - F.length(F.replace(acc["left"], rule["mark"], F.lit("")))) / F.length(rule["mark"])).cast("long")
        hit = F.concat(acc["hits"], F.array(F.struct(rule["name"].alias("name"), n.alias("n"))))
        return F.struct(F.replace(acc["left"], rule["mark"], F.lit("#")).alias("left"), F.when(n > 0, hit).otherwise(acc["hits"]).alias("hits"))

    hits = F.when(F.size("ids") > 0, F.aggregate(rules, F.struct(written.alias("left"), none.alias("hits")), match, lambda acc: acc["hits"])).otherwise(none)
    names = F.array(*map(F.lit, _NAMES))
    rows = rows.withColumn("hits", hits)
    return rows.select("doc_id", F.transform("ids", lambda i: F.element_at(names, i)).alias("sentence_ids"), F.array_sort(F.array_distinct(F.transform("hits", lambda c: c["name"]))).alias("licenses"), F.aggregate("hits", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n_matches"))
