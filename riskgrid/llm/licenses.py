"""License scan by ordered signature rules. DataFrame functions only.

The rules are names in three forms, SPDX ids in identifier lines, short names in notices, and sentences of license
bodies. A rule is a regular expression over words with one of them, its keyword, in angle brackets. The words of a text that
are keywords are looked up first; only around them are rules tried, each on a window with the keyword marked. So a
rule's match always spans its keyword, every occurrence is tried on its own, and a text without keywords costs one
search. Of overlapping detections, one that lies inside another of higher priority (then longer, then earlier in the
list) is suppressed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 16  # words to each side of a keyword; no rule reaches farther

# Licenses by the words of their names, as text has them in lower case with other signs dropped.
VERSION = "(?: version)? (?:v ?)?"  # and then the number
NAMES = (
    ("afl-3.0", f"<academic> free license{VERSION}3 0"),
    ("agpl", "gnu <affero> general public license"),
    ("agpl-3.0", f"gnu <affero> general public license{VERSION}3(?: 0)?"),
    ("agpl-3.0", f"<agpl>{VERSION}3(?: 0)?"),
    ("agpl-3.0", "<agplv3>"),
    ("apache", "<apache>(?: software)? licen[cs]e"),
    ("apache-1.1", f"<apache>(?: software)?(?: licen[cs]e)?{VERSION}1 1"),
    ("apache-2.0", f"<apache>(?: software)?(?: licen[cs]e)?{VERSION}2(?: 0)?"),
    ("apsl-2.0", f"<apple> public source license(?:{VERSION}2 0)?"),
    ("artistic", "<artistic> licen[cs]e"),
    ("artistic-2.0", f"<artistic> licen[cs]e{VERSION}2(?: 0)?"),
    ("beerware", "<beerware>(?: licen[cs]e)?"),
    ("bsd", "<bsd>(?: style)? licen[cs]e"),
    ("bsd-2-clause", "(?:2|two) clause <bsd>(?: licen[cs]e)?"),
    ("bsd-2-clause", "simplified <bsd>(?: licen[cs]e)?"),
    ("bsd-2-clause", "<bsd> 2 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "(?:3|three) clause <bsd>(?: licen[cs]e)?"),
    ("bsd-3-clause", "(?:new|modified|revised) <bsd>(?: licen[cs]e)?"),
    ("bsd-3-clause", "<bsd> 3 clause(?: licen[cs]e)?"),
    ("bsd-4-clause", "(?:4|four) clause <bsd>(?: licen[cs]e)?"),
    ("bsd-4-clause", "original <bsd> licen[cs]e"),
    ("bsl-1.0", f"<boost> software license(?:{VERSION}1 0)?"),
    ("busl-1.1", "business source <license>(?: 1 1)?"),
    ("0bsd", "zero clause <bsd>(?: licen[cs]e)?"),
    ("0bsd", "<0bsd>(?: licen[cs]e)?"),
    ("cc", "<creative> commons licen[cs]e"),
    ("cc-by", f"creative commons <attribution>(?: licen[cs]e)?(?:{VERSION}[1234] [05])?"),
    ("cc-by", "<cc> by [1234] [05]"),
    ("cc-by-sa", "creative commons attribution <sharealike>(?: licen[cs]e)?(?: [1234] [05])?"),
    ("cc-by-sa", "creative commons attribution share <alike>(?: licen[cs]e)?(?: [1234] [05])?"),
    ("cc-by-sa", "<cc> by sa(?: [1234] [05])?"),
    ("cc-by-nd", "<cc> by nd(?: [1234] [05])?"),
    ("cc-by-nd", "creative commons attribution <noderivatives>(?: [1234] [05])?"),
    ("cc-by-nc", "<cc> by nc(?: [1234] [05])?"),
    ("cc-by-nc", "creative commons attribution <noncommercial>(?: [1234] [05])?"),
    ("cc-by-nc", "creative commons attribution non <commercial>(?: [1234] [05])?"),
    ("cc-by-nc-sa", "<cc> by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "<cc> by nc nd(?: [1234] [05])?"),
    ("cc0-1.0", "<cc0>(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons <zero>(?: v)?(?: 1 0)?"),
    ("cddl-1.0", f"common development and <distribution> license(?:{VERSION}1 0)?"),
    ("cddl-1.0", "<cddl>(?: licen[cs]e)?(?: 1 0)?"),
    ("cecill-2.1", "<cecill>(?: licen[cs]e)?(?: 2 1)?"),
    ("cpl-1.0", f"common public <license>(?:{VERSION}1 0)?"),
    ("ecl-2.0", f"<educational> community license(?:{VERSION}2 0)?"),
    ("efl-2.0", "<eiffel> forum license(?: 2)?"),
    ("epl-1.0", f"<eclipse> public license{VERSION}1(?: 0)?"),
    ("epl-2.0", f"<eclipse> public license{VERSION}2(?: 0)?"),
    ("epl", "<eclipse> public license"),
    ("epl-2.0", "<epl> 2 0"),
    ("eupl-1.2", f"<european> union public licen[cs]e(?:{VERSION}1 [12])?"),
    ("eupl-1.2", "<eupl>(?: v)?(?: 1 [12])?"),
    ("fdl-1.3", f"<gnu> free documentation license(?:{VERSION}1 [123])?"),
    ("fdl-1.3", "<gfdl>(?: 1 [123])?"),
    ("gpl", "<gnu> general public license"),
    ("gpl", "gnu <gpl>"),
    ("gpl-1.0", f"<gnu> general public license{VERSION}1(?: 0)?"),
    ("gpl-2.0", f"<gnu> general public license{VERSION}2(?: 0)?(?: or (?:any|at your option any) later(?: version)?)?"),
    ("gpl-3.0", f"<gnu> general public license{VERSION}3(?: 0)?(?: or (?:any|at your option any) later(?: version)?)?"),
    ("gpl-2.0", f"<gpl>{VERSION}2(?: 0)?"),
    ("gpl-3.0", f"<gpl>{VERSION}3(?: 0)?"),
    ("gpl-2.0", "<gplv2>"),
    ("gpl-3.0", "<gplv3>"),
    ("hpnd", "<historical> permission notice and disclaimer"),
    ("ibm-pibs", "<ibm> power initialization"),
    ("icu", "<icu> licen[cs]e"),
    ("ijg", "independent <jpeg> group(?: licen[cs]e)?"),
    ("ipl-1.0", f"<ibm> public license(?:{VERSION}1 0)?"),
    ("isc", "<isc> licen[cs]e"),
    ("json", "shall be used for good not <evil>"),
    ("lgpl", "<gnu> (?:lesser|library) general public license"),
    ("lgpl-2.1", f"<gnu> (?:lesser|library) general public license{VERSION}2(?: [01])?"),
    ("lgpl-3.0", f"<gnu> lesser general public license{VERSION}3(?: 0)?"),
    ("lgpl-2.1", f"<lgpl>{VERSION}2(?: [01])?"),
    ("lgpl-3.0", f"<lgpl>{VERSION}3(?: 0)?"),
    ("lpl-1.02", "<lucent> public license(?: 1 02?)?"),
    ("lppl-1.3c", f"<latex> project public license(?:{VERSION}1 3c?)?"),
    ("mit", "<mit>(?: x11)? licen[cs]e"),
    ("mit", "<expat> licen[cs]e"),
    ("mit-0", "<mit> no attribution(?: licen[cs]e)?"),
    ("mpl", "<mozilla> public licen[cs]e"),
    ("mpl-1.1", f"<mozilla> public licen[cs]e{VERSION}1 [01]"),
    ("mpl-2.0", f"<mozilla> public licen[cs]e{VERSION}2(?: 0)?"),
    ("mpl-2.0", f"<mpl>{VERSION}2(?: 0)?"),
    ("ms-pl", "<microsoft> public license"),
    ("ms-rl", "<microsoft> reciprocal license"),
    ("mulan-psl-2.0", "<mulan> (?:psl|permissive software license)(?: v)?(?: ?2)?"),
    ("ncsa", "university of illinois <ncsa>(?: open source license)?"),
    ("odbl-1.0", "open <database> license(?: v)?(?: 1 0)?"),
    ("ofl-1.1", f"sil open <font> license(?:{VERSION}1 1)?"),
    ("openssl", "<openssl> licen[cs]e"),
    ("osl-3.0", f"open software <license>(?:{VERSION}3 0)?"),
    ("php-3.01", f"<php> license(?:{VERSION}3 01?)?"),
    ("postgresql", "<postgresql> licen[cs]e"),
    ("psf-2.0", "<python> software foundation license(?: version 2)?"),
    ("public-domain", "(?:in|into|to) the public <domain>"),
    ("public-domain", "dedicated to the public <domain>"),
    ("qpl-1.0", "q public <license>(?: 1 0)?"),
    ("ruby", "<ruby> licen[cs]e"),
    ("sleepycat", "<sleepycat> licen[cs]e"),
    ("sspl-1.0", "server side public <license>(?: 1 0)?"),
    ("tcl", "<tcl> tk licen[cs]e"),
    ("unicode", "<unicode> licen[cs]e agreement"),
    ("unlicense", "<unlicense>"),
    ("upl-1.0", "universal <permissive> license(?: 1 0)?"),
    ("vim", "<vim> licen[cs]e"),
    ("w3c", "<w3c> software (?:and document )?(?:notice and )?licen[cs]e"),
    ("wtfpl", "<wtfpl>"),
    ("x11", "<x11> licen[cs]e"),
    ("zlib", "<zlib>(?: libpng)? licen[cs]e"),
    ("zpl-2.1", f"<zope> public license(?:{VERSION}2 [01])?"),
    ("proprietary", "all rights <reserved>"),
    ("proprietary", "<proprietary> and confidential"),
)

# How a name is used: what stands before it, and the priority and confidence that gives. Later forms rank higher.
VERB = "(?:licen[cs]ed|released|distributed|available|provided|published|covered|redistributed|governed|made available)"
FORMS = (
    ("name", "", 20, 0.5),
    ("notice", f"{VERB} (?:under|by|with|on) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", 40, 0.9),
    ("identifier", "spdx licen[cs]e identifier ", 60, 1.0),
)


# SPDX short ids, as identifier lines have them.
SPDX = """
0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0
APSL-1.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent
BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSD-4-Clause-UC BSL-1.0 BUSL-1.1 bzip2-1.0.6 CAL-1.0 CC-BY-1.0 CC-BY-2.0
CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-NC-2.0
CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-PDDC CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-1.0
CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.0 EUPL-1.1 EUPL-1.2
FSFAP FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only
GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND IBM-pibs ICU IJG ImageMagick IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.0-only
LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later libpng-2.0 libtiff LPL-1.0 LPL-1.02
LPPL-1.0 LPPL-1.3a LPPL-1.3c MIT MIT-0 MIT-CMU MirOS MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-1.0
MulanPSL-2.0 NAIST-2003 NASA-1.3 NCSA NPL-1.1 ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OGL-UK-3.0 OLDAP-2.8 OpenSSL OSL-1.0 OSL-2.1 OSL-3.0
PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 Ruby SGI-B-2.0 Sleepycat SISSL SPL-1.0 SSPL-1.0 TCL
Unicode-DFS-2016 Unicode-3.0 Unlicense UPL-1.0 Vim W3C W3C-20150513 Watcom-1.0 WTFPL X11 Xnet Zend-2.0 Zlib zlib-acknowledgement ZPL-2.0
ZPL-2.1
""".split()

# Short names that stand after a notice's verb. The second kind means nothing else, so "under the" is enough before it.
SHORT = (
    ("mit", "<mit>"), ("x11", "<x11>"), ("isc", "<isc>"), ("zlib", "<zlib>"), ("bsd", "<bsd>"), ("apache", "<apache>"),
    ("artistic", "<artistic>"), ("bsl-1.0", "<boost>"), ("vim", "<vim>"), ("php-3.01", "<php>"), ("ruby", "<ruby>"),
    ("openssl", "<openssl>"), ("postgresql", "<postgresql>"), ("ncsa", "<ncsa>"), ("psf-2.0", "<psf>"), ("json", "<json>"),
)
PLAIN = (
    ("gpl", "<gpl>"), ("lgpl", "<lgpl>"), ("agpl", "<agpl>"), ("mpl", "<mpl>"), ("epl", "<epl>"), ("cddl-1.0", "<cddl>"),
    ("eupl-1.2", "<eupl>"), ("ofl-1.1", "<ofl>"), ("cc0-1.0", "<cc0>"), ("unlicense", "<unlicense>"), ("wtfpl", "<wtfpl>"),
    ("fdl-1.3", "<gfdl>"), ("mit", "<mit> licen[cs]e"), ("isc", "<isc> licen[cs]e"), ("bsd", "<bsd> licen[cs]e"),
)

# Sentences that only one license's own text has: label, rule, and a text it must find.
BODIES = (
    ("mit", "permission is <hereby> granted free of charge to any person obtaining a copy of this", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsl-1.0", "permission is <hereby> granted free of charge to any person or organization obtaining a copy", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("x11", "the name of the x <consortium> shall not be used", "Except as contained in this notice, the name of the X Consortium shall not be used in advertising"),
    ("bsd", "<redistribution> and use in source and binary forms with or without modification are permitted", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("bsd-3-clause", "may be used to <endorse> or promote products derived from this software without", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-4-clause", "all <advertising> materials mentioning features or use of this software must display", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("isc", "permission to use copy modify and(?: or)? <distribute> this software for any purpose with or without fee is hereby granted provided", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"),
    ("0bsd", "permission to use copy modify and(?: or)? <distribute> this software for any purpose with or without fee is hereby granted(?! provided)", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE"),
    ("postgresql", "permission to use copy modify and <distribute> this software and its documentation for any purpose without fee", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement"),
    ("zlib", "the origin of this software must not be <misrepresented>", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("apache-2.0", "you may not use this file except in <compliance> with the license", "you may not use this file except in compliance with the License."),
    ("apache-2.0", "required by applicable law or agreed to in <writing> software distributed under the license is distributed", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis"),
    ("gpl", "free software you can <redistribute> it and or modify it under the terms of the gnu general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"),
    ("lgpl", "free software you can <redistribute> it and or modify it under the terms of the gnu (?:lesser|library) general public license", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "free software you can <redistribute> it and or modify it under the terms of the gnu affero general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("gpl-2.0", "gnu general public license as published by the free software <foundation> (?:either )?version 2", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3.0", "gnu general public license as published by the free software <foundation> (?:either )?version 3", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-2.1", "gnu (?:lesser|library) general public license as published by the free software <foundation> (?:either )?version 2", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3.0", "gnu lesser general public license as published by the free software <foundation> (?:either )?version 3", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3.0", "gnu affero general public license as published by the free software <foundation> (?:either )?version 3", "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3.0", "the gnu general public license is a free <copyleft> license for software", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("lgpl-3.0", "gnu lesser general public license <incorporates> the terms and conditions of version 3", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of"),
    ("agpl-3.0", "all users <interacting> with it remotely through a computer network", "must prominently offer all users interacting with it remotely through a computer network"),
    ("mpl-2.0", "source code form is <subject> to the terms of the mozilla public license v 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-1.1", "contents of this file are <subject> to the mozilla public license version 1 1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License)"),
    ("unlicense", "this is free and <unencumbered> software released into the public domain", "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", "the person who <associated> a work with this deed has dedicated the work", "The person who associated a work with this deed has dedicated the work to the public domain"),
    ("wtfpl", "you just do what the <fuck> you want to", "0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("ofl-1.1", "the goals of the open font license ofl are to <stimulate> worldwide development", "The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects"),
    ("artistic", "the <intent> of this document is to state the conditions under which a package may be copied", "The intent of this document is to state the conditions under which a Package may be copied"),
    ("openssl", "this product includes software developed by the <openssl> project", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"),
    ("beerware", "you can buy me a <beer> in return", "If we meet some day, and you think this stuff is worth it, you can buy me a beer in return."),
    ("vim", "there are no restrictions on distributing unmodified copies of <vim>", "There are no restrictions on distributing unmodified copies of Vim except that"),
    ("lppl-1.3c", "may be distributed and or modified under the conditions of the <latex> project public license", "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License"),
    ("psf-2.0", "psf is making <python> available to licensee on an as is basis", "PSF is making Python available to Licensee on an AS IS basis."),
    ("w3c", "by obtaining using and or <copying> this work you the licensee agree", "By obtaining, using and/or copying this work, you (the licensee) agree"),
)

UNDER = "under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
FIRST = "spdx licen[cs]e identifier "
# The id after the first "or" or "and" of an identifier line. Its match spans the first id, so it ranks lower.
SECOND = FIRST + "(?:or later |(?!or |and )[^ ]+ ){1,6}(?:or|and) "


def spdx_label(short: str) -> str:
    """The label that the names above give the same license."""
    label = re.sub("-only$|-or-later$", "", short.lower())
    label = re.sub(r"^(cc-by.*)-[0-9.]+$", r"\1", label).replace("mulanpsl", "mulan-psl")
    return re.sub("^gfdl", "fdl", label)


def rules() -> list[dict]:
    """All rules in order: id, form, label, keyword, pattern, priority, confidence, and a text that must be found, if given."""
    found = []

    def add(form: str, label: str, before: str, name: str, priority: int, sure: float, sample: str | None = None) -> None:
        keyword = re.search("<(.+?)>", name).group(1)
        pattern = f"(?<=^| ){before}{name}(?=$| )"
        found.append(
            {"id": len(found), "form": form, "label": label, "keyword": keyword, "pattern": pattern, "priority": priority, "sure": sure, "sample": sample}
        )

    # Ids come first: of two rules of one span and priority, the earlier holds.
    for short in SPDX:
        word, _, rest = " ".join(re.findall("[0-9a-z]+", short.lower())).partition(" ")
        name = f"<{word}>{' ' if rest else ''}{rest}"
        add("identifier", spdx_label(short), FIRST, name, 60, 1.0, f"// SPDX-License-Identifier: {short}")
        add("identifier", spdx_label(short), SECOND, name, 59, 1.0, f"// SPDX-License-Identifier: Foo-1.0-or-later OR {short}")
    for form, before, priority, sure in FORMS:
        for label, name in NAMES:
            add(form, label, before, name, priority, sure)
    for label, name in SHORT:
        add("notice", label, f"{VERB} {UNDER}", name, 38, 0.9, f"Licensed under {re.search('<(.+?)>', name).group(1).upper()}.")
    for label, name in PLAIN:
        sample = name.replace("<", "").replace(">", "").replace("[cs]", "c").upper()
        add("notice", label, UNDER, name, 38, 0.9, f"You may use it under the {sample}.")
    for label, sentence, sample in BODIES:
        add("body", label, "", sentence, 50, 0.95, sample)
    return found


# Phrases whose every place is counted; fixed values of the report.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # in text as it is; capitals will be small letters


def _literal(value: str) -> str:
    return "r'" + value.replace("'", "\\x27") + "'"


def _rule_map() -> str:
    """SQL map literal: keyword -> its rules."""
    by_word: dict[str, list[dict]] = {}
    for rule in rules():
        by_word.setdefault(rule["keyword"], []).append(rule)
    entries = []
    for word, own in by_word.items():
        structs = ", ".join(
            f"named_struct('id', {r['id']}, 'label', {_literal(r['label'])}, 'pattern', {_literal(r['pattern'])}, 'priority', {r['priority']}, 'sure', {r['sure']}D)"
            for r in own
        )
        entries.append(f"{_literal(word)}, array({structs})")
    return f"map({', '.join(entries)})"


def keywords() -> list[str]:
    return sorted({r["keyword"] for r in rules()} | {p.split()[-1] for p, _ in PHRASES})


def gate(text: Column) -> Column:
    """Whether any keyword stands in the text, in either case; one search, no array."""
    inside = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    return text.rlike(f"(?<!{inside})(?i:" + "|".join(map(re.escape, keywords())) + f")(?!{inside})")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base and detections of each row of (doc_id, text).

    Words are runs of digits, a-z (A-Z lower-cased) and all beyond ASCII. `base` has (start, end, label) of every
    place of a base phrase; `detections` has (start, end, label, priority, sure, id) of the rules that are left after
    suppression, places counted in words from 0. Null and empty texts have no words; rows that repeat are scanned like
    any other; an empty table gives no rows; other columns are ignored. A row's work needs the row only: no shuffle.
    """
    plain = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.when(gate(F.col("text")), F.filter(F.split(plain, SEPARATOR), lambda w: w != "")).alias("words"),
    )
    wanted = ", ".join(_literal(k) for k in keywords())
    rows = rows.withColumn(
        "at", F.expr(f"filter(sequence(0, greatest(size(words) - 1, 0)), i -> coalesce(array_contains(array({wanted}), get(words, i)), false))")
    )
    base = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        n = len(parts) - 1
        test = " AND ".join(f"coalesce(get(words, i - {n - k}) = {_literal(p)}, false)" for k, p in enumerate(parts))
        base.append(f"transform(filter(at, i -> {test}), i -> named_struct('start', i - {n}, 'end', i, 'label', {_literal(label)}))")
    window = (
        "concat_ws(' ', slice(words, greatest(i - {c}, 0) + 1, least(i, {c})), array(concat('<', get(words, i), '>')), slice(words, i + 2, {c}))"
    ).format(c=CONTEXT)
    rows = rows.withColumn("base", F.expr(f"concat({', '.join(base)})")).withColumn(
        "windows", F.expr(f"transform(at, i -> named_struct('at', i, 'word', get(words, i), 'text', {window}))")
    )
    tried = (
        "flatten(transform(windows, w -> filter(transform(coalesce(try_element_at({rules}, w.word), array()), "
        "r -> named_struct('at', w.at, 'hit', regexp_extract(w.text, r.pattern, 0), 'rule', r)), x -> x.hit != '')))"
    ).format(rules=_rule_map())
    rows = rows.select("doc_id", "n_words", "base", F.expr(tried).alias("hits"))
    spaces = "(length({0}) - length(replace({0}, ' ', '')))"
    start = f"x.at - {spaces.format('substring_index(x.hit, \"<\", 1)')}"
    found = (
        f"array_sort(transform(hits, x -> named_struct('start', {start}, 'end', {start} + {spaces.format('x.hit')}, 'label', x.rule.label, "
        "'priority', x.rule.priority, 'sure', x.rule.sure, 'id', x.rule.id)))"
    )
    rows = rows.select("doc_id", "n_words", "base", F.expr(found).alias("found"))
    # What contains a detection starts at most two contexts before it, so only so many neighbours are looked at.
    most = max(sum(r["keyword"] == k for r in rules()) for k in keywords())
    reach = (2 * CONTEXT + 1) * most
    left = (
        f"filter(found, (d, n) -> NOT exists(slice(found, greatest(n - {reach}, 0) + 1, {2 * reach + 1}), e -> e.start <= d.start AND e.end >= d.end "
        "AND (e.priority > d.priority OR (e.priority = d.priority AND (e.end - e.start > d.end - d.start "
        "OR (e.end - e.start = d.end - d.start AND e.id < d.id))))))"
    )
    return rows.select("doc_id", "n_words", F.coalesce("base", F.array()).alias("base"), F.coalesce(F.expr(left), F.array()).alias("detections"))
