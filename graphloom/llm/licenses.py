"""License detection by ordered signature rules, in DataFrame functions only.

Each license has hand-written signatures: its names, its identifier and its address; forms of reference (a tag, a
sentence that grants it, a bare mention) turn each into rules, several hundred in all. A keyword gate runs first: one
regex for the corpus, made from the rules, then one substring test a rule, and only rules whose keyword occurs are
matched. A detection that
lies within another of the same or a better priority is suppressed: a version-less name inside of a versioned one, a
mention inside of a grant.

The base phrases of the contract are found on words and always stay.

Defined results: a null text is empty; no word, no label and score 0 for it; repeated rows are treated alike; of equal
intervals the rule of better priority, then the earlier rule stays. Only the result's columns are returned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import let
from graphloom.llm.spans import find

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: label, a word that every match of the name holds, identifier, name, address; a name with another word has a row of
#: its own, without what the first row gives. Spaces stand for any blank space; the text is matched without case.
LICENSES = (
    ("mit", "mit", "mit(?:-0)?", "mit licen[cs]e", "opensource.org/licenses/mit"),
    ("apache-2.0", "apache", "apache-2.0", "apache(?: software)? licen[cs]e,?(?: version| v\\.?)? ?2(?:\\.0)?", "apache.org/licenses/license-2.0"),
    ("apache-1.1", "apache", "apache-1.1", "apache(?: software)? licen[cs]e,?(?: version| v\\.?)? ?1\\.1", "apache.org/licenses/license-1.1"),
    ("gpl-2.0", "gnu", "gpl-2.0(?:-only|-or-later|\\+)?", "gnu general public licen[cs]e,?(?: version| v\\.?)? ?2", "gnu.org/licenses/old-licenses/gpl-2.0"),
    ("gpl-3.0", "gnu", "gpl-3.0(?:-only|-or-later|\\+)?", "gnu general public licen[cs]e,?(?: version| v\\.?)? ?3", "gnu.org/licenses/gpl-3.0"),
    ("lgpl-2.1", "gnu", "lgpl-2.1(?:-only|-or-later|\\+)?", "gnu lesser general public licen[cs]e,?(?: version| v\\.?)? ?2\\.1", "gnu.org/licenses/old-licenses/lgpl-2.1"),
    ("lgpl-3.0", "gnu", "lgpl-3.0(?:-only|-or-later|\\+)?", "gnu lesser general public licen[cs]e,?(?: version| v\\.?)? ?3", "gnu.org/licenses/lgpl-3.0"),
    ("agpl-3.0", "gnu", "agpl-3.0(?:-only|-or-later|\\+)?", "gnu affero general public licen[cs]e,?(?: version| v\\.?)? ?3", "gnu.org/licenses/agpl-3.0"),
    ("gfdl-1.3", "gnu", "gfdl-1.3(?:-only|-or-later)?", "gnu free documentation licen[cs]e,?(?: version| v\\.?)? ?1\\.3", "gnu.org/licenses/fdl-1.3"),
    ("bsd-2-clause", "bsd", "bsd-2-clause", "(?:simplified bsd|bsd 2-clause|2-clause bsd|freebsd) licen[cs]e", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", "bsd-3-clause", "(?:new bsd|modified bsd|bsd 3-clause|3-clause bsd) licen[cs]e", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd", "bsd-4-clause", "(?:original bsd|bsd 4-clause|4-clause bsd) licen[cs]e", "spdx.org/licenses/bsd-4-clause"),
    ("isc", "isc", "isc", "isc licen[cs]e", "opensource.org/licenses/isc"),
    ("mpl-1.1", "mozilla", "mpl-1.1", "mozilla public licen[cs]e,?(?: version| v\\.?)? ?1\\.1", "mozilla.org/mpl/1.1"),
    ("mpl-2.0", "mozilla", "mpl-2.0", "mozilla public licen[cs]e,?(?: version| v\\.?)? ?2(?:\\.0)?", "mozilla.org/mpl/2.0"),
    ("epl-1.0", "eclipse", "epl-1.0", "eclipse public licen[cs]e,?(?: version| v\\.?)? ?1(?:\\.0)?", "eclipse.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", "epl-2.0", "eclipse public licen[cs]e,?(?: version| v\\.?)? ?2(?:\\.0)?", "eclipse.org/legal/epl-2.0"),
    ("cddl-1.0", "distribution", "cddl-1.0", "common development and distribution licen[cs]e(?: \\(cddl\\))?,?(?: version| v\\.?)? ?1\\.0", "opensource.org/licenses/cddl-1.0"),
    ("cpl-1.0", "common", "cpl-1.0", "common public licen[cs]e,?(?: version| v\\.?)? ?1\\.0", "opensource.org/licenses/cpl-1.0"),
    ("artistic-2.0", "artistic", "artistic-2.0", "artistic licen[cs]e,?(?: version| v\\.?)? ?2(?:\\.0)?", "opensource.org/licenses/artistic-2.0"),
    ("zlib", "zlib", "zlib", "zlib(?:/libpng)? licen[cs]e", "opensource.org/licenses/zlib"),
    ("bsl-1.0", "boost", "bsl-1.0", "boost software licen[cs]e,?(?:[ -]+version| v\\.?)? ?1\\.0", "boost.org/license_1_0"),
    ("unlicense", "unlicen", "unlicense", "(?:the )?unlicen[cs]e", "unlicense.org"),
    ("wtfpl", "what", "wtfpl", "do what the f.{1,8} you want to public licen[cs]e", "wtfpl.net"),
    ("psf-2.0", "python", "python-2.0", "python(?: software foundation)? licen[cs]e", "docs.python.org/3/license"),
    ("psf-2.0", "psf", "psf-2.0", "psf licen[cs]e", ""),
    ("php-3.01", "php", "php-3.01", "php licen[cs]e,?(?: version| v\\.?)? ?3\\.01", "php.net/license"),
    ("ruby", "ruby", "ruby", "ruby licen[cs]e", "ruby-lang.org/en/about/license"),
    ("postgresql", "postgresql", "postgresql", "postgresql licen[cs]e", "opensource.org/licenses/postgresql"),
    ("openssl", "openssl", "openssl", "openssl licen[cs]e", "openssl.org/source/license"),
    ("ofl-1.1", "sil", "ofl-1.1", "sil open font licen[cs]e,?(?: version| v\\.?)? ?1\\.1", "scripts.sil.org/ofl"),
    ("eupl-1.2", "european", "eupl-1.2", "european union public licen[cs]e,?(?: version| v\\.?)? ?1\\.2", "joinup.ec.europa.eu/collection/eupl"),
    ("ms-pl", "microsoft", "ms-pl", "microsoft public licen[cs]e", "opensource.org/licenses/ms-pl"),
    ("ms-rl", "microsoft", "ms-rl", "microsoft reciprocal licen[cs]e", "opensource.org/licenses/ms-rl"),
    ("afl-3.0", "academic", "afl-3.0", "academic free licen[cs]e,?(?: version| v\\.?)? ?3(?:\\.0)?", "opensource.org/licenses/afl-3.0"),
    ("osl-3.0", "software", "osl-3.0", "open software licen[cs]e,?(?: version| v\\.?)? ?3(?:\\.0)?", "opensource.org/licenses/osl-3.0"),
    ("cc0-1.0", "cc0", "cc0-1.0", "cc0(?: 1\\.0)?(?: universal)?", "creativecommons.org/publicdomain/zero/1.0"),
    ("cc-by-4.0", "cc", "cc-by-4.0", "cc(?: |-)by(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", "creativecommons.org/licenses/by/4.0"),
    ("cc-by-4.0", "creative", "", "creative commons attribution(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", ""),
    ("cc-by-3.0", "cc", "cc-by-3.0", "cc(?: |-)by(?: licen[cs]e)?(?: |-)?(?:3\\.0)(?: unported)?", "creativecommons.org/licenses/by/3.0"),
    ("cc-by-3.0", "creative", "", "creative commons attribution(?: licen[cs]e)?(?: |-)?(?:3\\.0)(?: unported)?", ""),
    ("cc-by-sa-4.0", "cc", "cc-by-sa-4.0", "cc(?: |-)by-sa(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", "creativecommons.org/licenses/by-sa/4.0"),
    ("cc-by-sa-4.0", "creative", "", "creative commons attribution-share-?alike(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", ""),
    ("cc-by-nc-4.0", "cc", "cc-by-nc-4.0", "cc(?: |-)by-nc(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", "creativecommons.org/licenses/by-nc/4.0"),
    ("cc-by-nc-4.0", "creative", "", "creative commons attribution-non-?commercial(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", ""),
    ("cc-by-nd-4.0", "cc", "cc-by-nd-4.0", "cc(?: |-)by-nd(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", "creativecommons.org/licenses/by-nd/4.0"),
    ("cc-by-nd-4.0", "creative", "", "creative commons attribution-no-?deriv(?:ative)?s(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", ""),
    ("cc-by-nc-sa-4.0", "cc", "cc-by-nc-sa-4.0", "cc(?: |-)by-nc-sa(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", "creativecommons.org/licenses/by-nc-sa/4.0"),
    ("cc-by-nc-sa-4.0", "creative", "", "creative commons attribution-non-?commercial-share-?alike(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", ""),
    ("cc-by-nc-nd-4.0", "cc", "cc-by-nc-nd-4.0", "cc(?: |-)by-nc-nd(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", "creativecommons.org/licenses/by-nc-nd/4.0"),
    ("cc-by-nc-nd-4.0", "creative", "", "creative commons attribution-non-?commercial-no-?deriv(?:ative)?s(?: licen[cs]e)?(?: |-)?(?:4\\.0)(?: international)?", ""),
    ("gpl", "general", "gpl", "(?:gnu )?general public licen[cs]e", "gnu.org/licenses/gpl"),
    ("lgpl", "lesser", "lgpl", "(?:gnu )?lesser general public licen[cs]e", "gnu.org/licenses/lgpl"),
    ("agpl", "affero", "agpl", "(?:gnu )?affero general public licen[cs]e", "gnu.org/licenses/agpl"),
    ("apache", "apache", "apache", "apache licen[cs]e", "apache.org/licenses"),
    ("bsd", "bsd", "bsd", "bsd licen[cs]e", "freebsd.org/copyright"),
    ("mpl", "mozilla", "mpl", "mozilla public licen[cs]e", "mozilla.org/mpl"),
    ("cc", "creative", "cc", "creative commons(?: licen[cs]e)?", "creativecommons.org/licenses"),
    ("proprietary", "proprietary", "proprietary", "proprietary and confidential", ""),
    ("proprietary", "reserved", "", "all rights reserved, confidential", ""),
    ("public-domain", "domain", "public-domain", "(?:dedicated to|released into|placed in|in) the public domain", "creativecommons.org/publicdomain/mark"),
)
#: Sentences of license texts and notices: label, a word that every match holds, regex. They tell a license by its own
#: words, where it is not named. Fixed values, as the licenses have them.
NOTICES = (
    ("mit", "permission", "permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation"),
    ("mit", "sublicense", "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"),
    ("mit", "substantial", "permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("bsd-2-clause", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", "neither the names? of .{1,80} nor the names of (?:its|their) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "permission", "permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("zlib", "express", "this software is provided 'as-is', without any express or implied warranty"),
    ("bsl-1.0", "organization", "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", "changing", "everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "conditions", "terms and conditions for use, reproduction, and distribution"),
    ("apache-2.0", "perpetual", "grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|patent) license"),
    ("apache-1.1", "jakarta", "products derived from this software may not be called .{1,40}jakarta"),
    ("gpl", "redistribute", "is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license"),
    ("gpl-2.0", "version", "gnu general public license as published by the free software foundation[;,] either version 2"),
    ("gpl-3.0", "version", "gnu general public license as published by the free software foundation[;,] either version 3"),
    ("gpl-2.0", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "version", "gnu lesser general public license as published by the free software foundation[;,] either version 2\\.1"),
    ("lgpl-3.0", "version", "gnu lesser general public license as published by the free software foundation[;,] either version 3"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "affero", "gnu affero general public license as published by the free software foundation[;,] either version 3"),
    ("gfdl-1.3", "invariant", "with no invariant sections, no front-cover texts,? and no back-cover texts"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1\\.1"),
    ("mpl-2.0", "source", "this source code form is subject to the terms of the mozilla public license, v\\. ?2\\.0"),
    ("mpl-2.0", "incompatible", "this source code form is .?incompatible with secondary licenses"),
    ("epl-1.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v1\\.0"),
    ("epl-2.0", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v\\.)? 2\\.0"),
    ("epl-1.0", "eclipse", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", "common", "the accompanying program is provided under the terms of this common public license"),
    ("cddl-1.0", "common", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("artistic-2.0", "artistic", "the artistic license 2\\.0 copyright \\(c\\) 2000-2006, the perl foundation"),
    ("artistic-2.0", "artistic", "the copyright holder maintains some artistic control over the development of that package"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "font", "neither the font software nor any of its individual components.{1,40} may be sold by itself"),
    ("php-3.01", "php", "products derived from this software may not be called .?php.?, nor may .?php.? appear in their name"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "openssl", "the names .?openssl toolkit.? and .?openssl project.? must not be used to endorse"),
    ("openssl", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("postgresql", "postgresql", "postgresql database management system \\(formerly known as postgres"),
    ("psf-2.0", "python", "this license agreement is between the python software foundation"),
    ("psf-2.0", "psf", "psf hereby grants licensee a nonexclusive, royalty-free, world-wide license"),
    ("ruby", "bsdl", "you may redistribute it and/or modify it under either the terms of the 2-clause bsdl"),
    ("ms-pl", "reproduction", "the terms .?reproduce,.? .?reproduction,.? .?derivative works,.? and .?distribution.? have the same meaning here as under u\\.s\\. copyright law"),
    ("ms-rl", "reciprocal", "\\(a\\) reciprocal grants"),
    ("eupl-1.2", "eupl", "licensed under the eupl,? (?:version |v\\. ?)?1\\.2"),
    ("afl-3.0", "academic", "licensed under the academic free license version 3\\.0"),
    ("osl-3.0", "software", "licensed under the open software license version 3\\.0"),
    ("cc0-1.0", "waive", "overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders"),
    ("cc0-1.0", "waive", "has waived all copyright and related or neighboring rights"),
    ("cc", "redistribute", "you are free to share .{1,3} copy and redistribute the material in any medium or format"),
    ("cc-by-sa-4.0", "sharealike", "this work is licensed under a creative commons attribution-sharealike 4\\.0"),
    ("cc-by-4.0", "attribution", "this work is licensed under a creative commons attribution 4\\.0"),
    ("cc", "commons", "some rights reserved.{1,20}creative commons"),
    ("public-domain", "domain", "this (?:work|file|software|code) (?:is|has been) (?:released into|placed in|dedicated to) the public domain"),
    ("public-domain", "disclaim", "the authors? disclaims? copyright to this source code"),
    ("proprietary", "unauthorized", "unauthorized copying of this file,? via any medium,? is strictly prohibited"),
    ("proprietary", "confidential", "confidential and proprietary information of"),
    ("proprietary", "permission", "may not be (?:copied|reproduced|distributed).{1,60} without (?:the )?(?:prior |express )?(?:written )?permission of"),
)
#: Forms of reference: regex around the signature, priority (0 is best), confidence, the part that it needs.
FORMS = (
    (r"spdx-license-identifier: ?\(? ?{}(?![a-z0-9.-])", 0, 1.0, "spdx", 2),
    (r"(?<![a-z0-9])(?:or|and|with) ?\(? ?{}(?![a-z0-9.-])", 1, 0.9, "spdx-license-identifier", 2),
    (r"(?:licen[cs]ed|released|distributed|available|provided)(?: to you)? under (?:the )?(?:terms of (?:the )?)?{}(?![a-z0-9])", 0, 0.95, "under", 3),
    (r"licen[cs]e ?[:=] ?[\"']?{}(?![a-z0-9.-])", 1, 0.9, "licen", 2),
    (r"https?://(?:www\.)?{}", 1, 0.9, "http", 4),
    (r"(?<![a-z0-9]){}(?![a-z0-9])", 2, 0.7, "", 3),
)


def _blanks(regex: str) -> str:
    return regex.replace(" ", r"\s{1,4}").replace(r"\s{1,4}?", r"\s{0,4}")


def _gate() -> str:
    """What every match of any rule holds: "licen" where the rule cannot do without, else the name as far as it must
    stand, or the address. Identifiers only stand in forms that hold "licen"."""
    names, places = [], []
    for row in LICENSES:
        name = row[3].partition("(?: licen[cs]e)?")[0]
        names += [name] if "licen" not in name else []
        places += [row[4].replace(".", r"\.")] if row[4] and "licen" not in row[4] else []
    names += [regex for _, _, regex in NOTICES if "licen" not in re.sub("\\(\\?:[^()]*\\)\\?", "", regex)]
    names = [n for n in dict.fromkeys(names) if not any(n != x and n.startswith(x) for x in names)]
    return _blanks(_by_letters(["licen", *names, "https?://(?:www\\.)?" + _by_letters(list(dict.fromkeys(places)))]))


def _by_letters(regexes: list[str], depth: int = 3) -> str:
    """The alternation of ``regexes``, those of the same first letter together, so that a place of the text is mostly
    left after a look at its letter."""
    groups: dict[str, list[str]] = {}
    for x in regexes:
        plain = depth and x[:1].isalnum() and x[1:2] not in ("?", "*", "+", "{")
        groups.setdefault(x[0] if plain else x, []).append(x[1:] if plain else "")
    parts = [k if rest == [""] else k + _by_letters(rest, depth - 1) for k, rest in groups.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


#: A lower-case text without any of these has no rule's match.
GATE = _gate()


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(label, keyword, second keyword, regex, priority, confidence), in order. Every match holds both keywords: the
    identifier's plain beginning, the name's word or the whole address, and what the form needs."""
    out = []
    for row in LICENSES:
        for form, priority, confidence, also, part in FORMS:
            if not row[part]:
                continue
            signature = row[part].replace(".", r"\.") if part == 4 else row[part]
            regex = "(?i)" + _blanks(form.replace("{}", f"(?:{signature})"))
            key = row[1] if part == 3 else re.match("[a-z0-9-]+", signature)[0] if part == 2 else row[part]
            out.append((row[0], key, also, regex, priority, confidence))
    return out + [(label, key, "", "(?i)" + _blanks(regex), 1, 0.9) for label, key, regex in NOTICES]


def _rule_table() -> Column:
    names = ("label", "key", "also", "regex", "priority", "weight")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)], F.lit(i).alias("i")) for i, r in enumerate(rules())])


def detections(text: Column) -> Column:
    """Labels and confidences of the detections that no better one contains: array<struct<label, weight>>."""
    low = F.lower(text)

    def hits(t: Column) -> Column:
        open_rules = F.filter(_rule_table(), lambda r: t.contains(r["key"]) & t.contains(r["also"]))
        one = lambda r: F.transform(find(t, r["regex"]), lambda s: F.struct(s["start"].alias("a"), (-s["stop"]).alias("b"), r["priority"].alias("p"), r["i"].alias("i"), r["label"].alias("label"), r["weight"].alias("weight")))
        return F.sort_array(F.flatten(F.transform(open_rules, one)))

    def survive(found: Column) -> Column:
        """In the order of start, longest first: contained is what ends by an earlier one's end of no worse priority."""
        kind = "array<struct<label:string,weight:double>>"
        start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in range(3)], F.array().cast(kind).alias("out"))

        def step(acc: Column, d: Column) -> Column:
            stop = -d["b"]
            ends = [acc[f"e{p}"] for p in range(3)]
            inside = F.greatest(*[F.when(d["p"] >= p, ends[p]).otherwise(-1) for p in range(3)]) >= stop
            hit = F.struct(d["label"].alias("label"), d["weight"].cast("double").alias("weight"))
            new = ~inside & ~F.array_contains(acc["out"], hit)
            after = [F.when(d["p"] == p, F.greatest(ends[p], stop)).otherwise(ends[p]).alias(f"e{p}") for p in range(3)]
            return F.struct(*after, F.when(new, F.array_append(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(found, start, step, lambda acc: acc["out"])

    empty = F.array().cast("array<struct<label:string,weight:double>>")
    return let(low, lambda t: F.when(t.rlike(GATE), let(hits(t), survive)).otherwise(empty))


def base_places(text: Column) -> Column:
    """(start word, label) of each place where a base phrase stands, in the order of start."""
    kind = "array<struct<start:long,label:string>>"

    def places(w: Column) -> Column:
        def at(i: Column) -> Column:
            out = F.lit(None).cast("string")
            for phrase, label in reversed(BASE):
                each = phrase.split()
                same = F.get(w, i) == each[0]
                for k, x in enumerate(each[1:], 1):
                    same = same & (F.get(w, i + k) == x)
                out = F.when(same, F.lit(label)).otherwise(out)
            return F.struct(i.cast("long").alias("start"), out.alias("label"))

        return F.filter(F.transform(w, lambda x, i: F.when(x.isin(*{p.split()[0] for p, _ in BASE}), at(i))), lambda s: s["label"].isNotNull())

    words = F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    return F.when(text.rlike("(?i)license"), let(words, places)).otherwise(F.array().cast(kind))


def report(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("_t"))
    found = found.select("doc_id", F.regexp_count("_t", F.lit(WORD)).cast("long").alias("n_words"), base_places(F.col("_t")).alias("_b"), detections(F.col("_t")).alias("_d"))
    base = F.array_sort(F.array_distinct(F.transform("_b", lambda s: s["label"])))
    labels = F.array_sort(F.array_union(F.transform("_b", lambda s: s["label"]), F.transform("_d", lambda s: s["label"])))
    weight = F.aggregate(F.transform("_d", lambda s: s["weight"]), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return found.select(
        "doc_id",
        "n_words",
        F.size("_b").cast("long").alias("n_base"),
        F.get("_b", F.lit(0))["start"].alias("first_word"),
        F.try_element_at("_b", F.lit(-1))["start"].alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(weight, F.when(F.size("_b") > 0, F.lit(0.7)).otherwise(F.lit(0.0))).alias("score"),
    )
