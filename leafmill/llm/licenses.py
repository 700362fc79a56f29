"""License scans by ordered signature rules.

A text is reduced to its words (ASCII lower case, every other ASCII sign a gap). Each rule has keywords, a
regular expression over the words joined by single spaces, a label, a priority and a confidence. A rule's expression
runs only where all its keywords occur. Detections are then resolved by priority: one whose interval
of words lies within the interval of a kept detection of better priority is suppressed. Rules of
priority 0 (the base rules) are always kept. The scan is map-only: no shuffle, memory for one text.

Null and empty texts have no words and no detections; repeated rows give repeated results; an empty table gives an empty one. The time for a text
grows with its length and its detections, not with their product. ``keep`` names the columns that are carried along; others don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: ASCII letters to lower case, digits kept, other ASCII to a space; bytes of other characters are word bytes.
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float


#: Phrases that are always reported, by label.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: label, names as regular expressions over words (most specific first), SPDX ids as words
FAMILIES = (
    ("mit", ("mit license", "mit licence", "expat license"), ("mit",)),
    ("mit-0", ("mit no attribution(?: license)?", "mit 0 license"), ("mit 0",)),
    ("x11", ("x11 license", "x consortium license"), ("x11",)),
    ("apache-1.1", ("apache software license(?: version)? 1 1",), ("apache 1 1",)),
    ("apache-2", ("apache(?: software)? license,? ?(?:version |v ?)?2(?: 0)?", "apache 2(?: 0)?", "al ?2 0"), ("apache 2 0",)),
    ("bsd-0", ("(?:zero clause|0 clause) bsd", "bsd zero clause"), ("0bsd",)),
    ("bsd-2", ("(?:2|two) clause bsd", "simplified bsd", "freebsd license", "bsd 2 clause"), ("bsd 2 clause",)),
    ("bsd-3", ("(?:3|three) clause bsd", "(?:new|revised|modified) bsd", "bsd 3 clause"), ("bsd 3 clause",)),
    ("bsd-4", ("(?:4|four) clause bsd", "original bsd", "bsd 4 clause"), ("bsd 4 clause",)),
    ("isc", ("isc license", "internet systems consortium license"), ("isc",)),
    ("gpl-1", ("gnu general public license,? ?(?:version |v ?)1(?: 0)?",), ("gpl 1 0(?: only| or later)?",)),
    ("gpl-2", ("gnu general public license,? ?(?:version |v ?)2(?: 0)?",), ("gpl 2 0(?: only| or later)?",)),
    ("gpl-3", ("gnu general public license,? ?(?:version |v ?)3(?: 0)?",), ("gpl 3 0(?: only| or later)?",)),
    ("gpl", ("gplv?[123](?: 0)?", "gpl(?: version)? [123](?: 0)?", "gnu gpl"), ("gpl",)),
    ("gpl-any", ("gnu general public license", "general public license"), ("gpl any",)),
    ("lgpl-2.1", ("gnu lesser general public license,? ?(?:version |v ?)2 1",), ("lgpl 2 1(?: only| or later)?",)),
    ("lgpl-3", ("gnu lesser general public license,? ?(?:version |v ?)3(?: 0)?",), ("lgpl 3 0(?: only| or later)?",)),
    ("lgpl", ("(?:gnu )?lesser general public license", "(?:gnu )?library general public license"), ("lgpl",)),
    ("agpl-3", ("gnu affero general public license,? ?(?:version |v ?)3(?: 0)?",), ("agpl 3 0(?: only| or later)?",)),
    ("agpl", ("(?:gnu )?affero general public license",), ("agpl",)),
    ("fdl-1.3", ("gnu free documentation license(?: version 1 [123])?", "free documentation license"), ("gfdl 1 [123](?: only| or later)?",)),
    ("mpl-1.1", ("mozilla public license,? ?(?:version |v ?)1 1",), ("mpl 1 1",)),
    ("mpl-2", ("mozilla public license,? ?(?:version |v ?)?2(?: 0)?", "mozilla public license"), ("mpl 2 0",)),
    ("epl-1", ("eclipse public license,? ?(?:version |v ?)1(?: 0)?",), ("epl 1 0",)),
    ("epl-2", ("eclipse public license,? ?(?:version |v ?)?2(?: 0)?", "eclipse public license"), ("epl 2 0",)),
    ("edl-1", ("eclipse distribution license(?: version 1 0)?",), ("edl 1 0",)),
    ("cddl-1", ("common development and distribution license",), ("cddl 1 [01]",)),
    ("cpl-1", ("common public license(?: version 1 0)?",), ("cpl 1 0",)),
    ("eupl", ("european union public licen[cs]e(?: version 1 [012])?",), ("eupl 1 [012]",)),
    ("artistic-1", ("artistic license 1 0",), ("artistic 1 0",)),
    ("artistic-2", ("(?:the )?artistic license(?: version)?(?: 2 0)?",), ("artistic 2 0",)),
    ("zlib", ("zlib(?: libpng)? license",), ("zlib",)),
    ("libpng", ("libpng license", "png reference library license"), ("libpng 2 0",)),
    ("boost-1", ("boost software license(?: version 1 0)?",), ("bsl 1 0",)),
    ("unlicense", ("the unlicense", "unlicense org"), ("unlicense",)),
    ("wtfpl", ("do what the f[a-z]* you want to public license",), ("wtfpl",)),
    ("cc0", ("cc0(?: 1 0)?(?: universal)?", "creative commons zero"), ("cc0 1 0",)),
    ("cc-by-nc-nd", ("cc by nc nd(?: [1-4] 0)?", "attribution non ?commercial no ?deriv(?:ative)?s"), ("cc by nc nd [1-4] 0",)),
    ("cc-by-nc-sa", ("cc by nc sa(?: [1-4] 0)?", "attribution non ?commercial share ?alike"), ("cc by nc sa [1-4] 0",)),
    ("cc-by-nc", ("cc by nc(?: [1-4] 0)?", "attribution non ?commercial"), ("cc by nc [1-4] 0",)),
    ("cc-by-nd", ("cc by nd(?: [1-4] 0)?", "attribution no ?deriv(?:ative)?s"), ("cc by nd [1-4] 0",)),
    ("cc-by-sa", ("cc by sa(?: [1-4] 0)?", "attribution share ?alike"), ("cc by sa [1-4] 0",)),
    ("cc-by", ("cc by(?: [1-4] 0)?", "creative commons attribution"), ("cc by [1-4] 0",)),
    ("odbl", ("open (?:data commons open )?database license",), ("odbl 1 0",)),
    ("odc-by", ("open data commons attribution license",), ("odc by 1 0",)),
    ("pddl", ("public domain dedication and licen[cs]e",), ("pddl 1 0",)),
    ("ofl-1.1", ("(?:sil )?open font license(?: version)?(?: 1 1)?",), ("ofl 1 1",)),
    ("ms-pl", ("microsoft public license",), ("ms pl",)),
    ("ms-rl", ("microsoft reciprocal license",), ("ms rl",)),
    ("afl-3", ("academic free license(?: version)?(?: [123] [01])?",), ("afl [123] [01]",)),
    ("osl-3", ("open software license(?: version)?(?: [123] [01])?",), ("osl [123] [01]",)),
    ("python-2", ("python software foundation license(?: version 2)?", "psf license"), ("psf 2 0", "python 2 0")),
    ("ruby", ("ruby license", "ruby s licen[cs]e"), ("ruby",)),
    ("php-3", ("php license(?: version)?(?: 3 0[01]?)?",), ("php 3 0[01]?",)),
    ("openssl", ("openssl license",), ("openssl",)),
    ("curl", ("curl license",), ("curl",)),
    ("postgresql", ("postgresql licen[cs]e",), ("postgresql",)),
    ("ncsa", ("(?:university of )?illinois ncsa open source license",), ("ncsa",)),
    ("w3c", ("w3c software (?:notice and )?license",), ("w3c",)),
    ("sleepycat", ("sleepycat license",), ("sleepycat",)),
    ("beerware", ("beer ware license", "beerware license"), ("beerware",)),
    ("busl-1.1", ("business source license(?: 1 1)?",), ("busl 1 1",)),
    ("sspl-1", ("server side public license",), ("sspl 1 0",)),
    ("elastic-2", ("elastic license(?: version)?(?: 2 0)?",), ("elastic 2 0",)),
    ("upl-1", ("universal permissive license",), ("upl 1 0",)),
    ("blueoak-1", ("blue oak model license",), ("blueoak 1 0 0",)),
    ("openrail", ("(?:creativeml )?open ?rail(?: m)?(?: license)?", "responsible ai license"), ("openrail",)),
    ("proprietary", ("all rights reserved",), ("proprietary",)),
    ("public-domain", ("(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain work"), ("public domain",)),
)

#: Sentences of the licenses' own texts, with keyword, label and expression.
SENTENCES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "warranty", "the software is provided as is without warranty of any kind"),
    ("isc", "purpose", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd-3", "endorse", "names? of its contributors may be used to endorse or promote products"),
    ("bsd-2", "redistribution", "redistribution and use in source and binary forms"),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license"),
    ("gpl-any", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "lesser", "under the terms of the gnu lesser general public license"),
    ("agpl", "affero", "under the terms of the gnu affero general public license"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "freely", "alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("boost-1", "boost", "distributed under the boost software license"),
    ("cc-by", "attribution", "licensed under a creative commons attribution"),
    ("proprietary", "confidential", "proprietary and confidential"),
    ("mit", "merge", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "noninfringement", "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "disclaims", "the author disclaims all warranties with regard to this software"),
    ("isc", "hereby", "with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-2", "reproduce", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-2", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3", "neither", "neither the name of (?:the )?[a-z0-9 ]{1,60} nor the names of its contributors may be used"),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-0", "without", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("apache-2", "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2", "unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "foundation", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl-2", "either", "published by the free software foundation either version 2 of the license"),
    ("gpl-3", "either", "published by the free software foundation either version 3 of the license"),
    ("gpl-any", "hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-any", "received", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-any", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("lgpl", "library", "this library is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("lgpl", "received", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("lgpl-2.1", "either", "gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("agpl", "remotely", "interacting with it remotely through a computer network"),
    ("agpl-3", "affero", "gnu affero general public license as published by the free software foundation either version 3"),
    ("fdl-1.3", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("fdl-1.3", "document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "obtain", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "initial", "the initial developer of the original code is"),
    ("mpl-1.1", "contents", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1", "contents", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("artistic-2", "package", "this package is free software you can redistribute it and or modify it under the terms of the artistic license"),
    ("artistic-1", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("libpng", "libpng", "this code is released under the libpng license"),
    ("boost-1", "machine", "unless such copies or derivative works are solely in the form of machine executable object code"),
    ("unlicense", "dedication", "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("wtfpl", "everyone", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights"),
    ("cc0", "jurisdictions", "statement of purpose the laws of most jurisdictions throughout the world automatically confer exclusive copyright"),
    ("cc-by-nc-nd", "noncommercial", "licensed under a creative commons attribution noncommercial no ?derivatives"),
    ("cc-by-nc-sa", "commercial", "licensed under a creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "transform", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", "contributions", "you must distribute your contributions under the same license as the original"),
    ("cc-by", "appropriate", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("odbl", "database", "this database is made available under the open database license"),
    ("odc-by", "commons", "this data is made available under the open data commons attribution license"),
    ("pddl", "dedication", "this data is made available under the public domain dedication and license"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "reserved", "with reserved font name"),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("afl-3", "academic", "licensed under the academic free license version 3 0"),
    ("osl-3", "open", "licensed under the open software license version 3 0"),
    ("python-2", "psf", "psf is making python available to licensee on an as is basis"),
    ("php-3", "php", "products derived from this software may not be called php"),
    ("php-3", "php", "this product includes php software freely available from"),
    ("ruby", "verbatim", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("curl", "distribute", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("postgresql", "university", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ncsa", "deal", "to deal with the software without restriction"),
    ("w3c", "holders", "this work is being provided by the copyright holders under the following license by obtaining using and or copying this work"),
    ("sleepycat", "accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("busl-1.1", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl-1.1", "change", "effective on the change date"),
    ("sspl-1", "service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("upl-1", "larger", "any software distributed with the software or a larger work to which the software is contributed"),
    ("blueoak-1", "contributor", "each contributor licenses you to do everything with this software that would otherwise infringe that contributor s copyright"),
    ("openrail", "use", "use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
    ("public-domain", "domain", "the authors? ha(?:s|ve) placed this work in the public domain"),
    ("public-domain", "domain", "has been dedicated to the public domain by the authors?"),
    ("public-domain", "disclaims", "the author disclaims copyright to this source code"),
    ("proprietary", "unauthori", "unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
    ("proprietary", "reproduced", "no part of this (?:publication|document|work) may be reproduced (?:distributed )?(?:or transmitted )?in any form"),
    ("proprietary", "written", "may not be (?:copied|reproduced|used|redistributed) without (?:the )?(?:prior |express )?written (?:permission|consent)"),
    ("proprietary", "trade", "contains trade secrets and confidential information"),
    ("proprietary", "evaluation", "for evaluation purposes only"),
)


def literal(name: str) -> str:
    """The longest run of signs that every match of a name holds: what stands outside groups, classes and optional letters."""
    outside = re.sub(r"\(\?:[^()]*\)\??", "\0", name)
    return max((run.strip() for run in re.sub(r"\[[^\]]*\][*?]?|.[*?]", "\0", outside).split("\0")), key=len)


def default_rules() -> tuple[Rule, ...]:
    """The rules in order of priority: base phrases, SPDX tags, license sentences, granting phrases, links, bare names."""
    rules = [Rule(f"base:{label}", label, phrase, tuple(phrase.split()), 0, 1.0) for label, phrase in BASE]
    for label, names, ids in FAMILIES:
        rules.append(Rule(f"spdx:{label}", label, f"spdx license identifier (?:{'|'.join(ids)})", ("spdx",), 1, 0.99))
        # a rule for each name: its gate holds only what the name itself holds
        for name in names:
            rules += [
                Rule(f"grant:{label}", label, f"(?:licensed|released|distributed|available|provided|published) under (?:the (?:terms of the )?|an? )?(?:{name})(?: license)?", ("under", literal(name)), 3, 0.95),
                Rule(f"name:{label}", label, f"(?:{name})(?: license)?", (literal(name),), 6, 0.7),
            ]
        rules += [Rule(f"field:{label}:{i}", label, f"licen[cs]e (?:is |id |name )?(?:{one})", ("licen", one.split()[0]), 4, 0.9) for i, one in enumerate(ids)]
    rules += [Rule(f"text:{label}:{i}", label, sentence, (keyword,), 2, 0.97) for i, (label, keyword, sentence) in enumerate(SENTENCES)]
    rules += [Rule(f"link:cc-{kind}", f"cc-{kind}", f"creativecommons org licenses {kind.replace('-', ' ')}", ("creativecommons",), 5, 0.9) for kind in ("by-nc-nd", "by-nc-sa", "by-nc", "by-nd", "by-sa", "by")]
    rules += [Rule("link:gpl", "gpl-any", "gnu org licenses gpl", ("gnu", "licenses"), 5, 0.85), Rule("link:apache", "apache-2", "apache org licenses license 2 0", ("apache", "licenses"), 5, 0.9), Rule("link:mit", "mit", "opensource org licenses mit", ("opensource", "mit"), 5, 0.9)]
    return tuple(sorted(rules, key=lambda r: r.priority))


class Scanner:
    """The rules, compiled; built once in each Python worker."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(b"(?<= )(?:" + r.pattern.encode() + b")(?= )"), frozenset(k.encode() for k in r.keywords)) for r in rules]
        self.keywords = sorted({k for *_, keys in self.rules for k in keys})

    def words(self, text: bytes) -> list[bytes]:
        return text.translate(_WORD).split()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, Rule]]:
        """Kept detections as first word, word after the last, rule; in order of place and priority."""
        joined = b" " + b" ".join(words) + b" "
        present = {k for k in self.keywords if k in joined}
        spans = [(m.start(), m.end(), rule) for rule, pattern, keys in self.rules if keys <= present for m in pattern.finditer(joined)]
        if not spans:
            return []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # of the space behind each word
        first = np.searchsorted(ends, [a for a, *_ in spans], side="right")
        last = np.searchsorted(ends, [b for _, b, _ in spans], side="left")
        found = sorted(((int(a), int(b) + 1, rule) for a, b, (*_, rule) in zip(first, last, spans, strict=True)), key=lambda d: (d[2].priority, d[0], -d[1], d[2].name))
        kept: list[tuple[int, int, Rule]] = []
        # kept intervals that lie in no other, in order of begin and so of end
        begins: list[int] = []
        stops: list[int] = []
        for begin, end, rule in found:
            i = bisect_right(begins, begin) - 1
            inside = i >= 0 and stops[i] >= end
            if inside and rule.priority:
                continue
            kept.append((begin, end, rule))
            if not inside:
                i = bisect_left(begins, begin)
                j = i
                while j < len(stops) and stops[j] <= end:
                    j += 1
                begins[i:j], stops[i:j] = [begin], [end]
        return sorted(kept, key=lambda d: (d[0], d[1], d[2].priority, d[2].name))


_scanners: dict[tuple[Rule, ...], Scanner] = {}

SCHEMA = "n_words long, detections array<struct<rule:string,label:string,priority:int,confidence:double,first_word:long,last_word:long,first_char:long,end_char:long,span:string>>"


def _offsets(text: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_WORD))]


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """``keep`` columns, n_words, and the kept detections of each row, with words counted from 0 and characters of the text."""
    rules = default_rules() if rules is None else tuple(sorted(rules, key=lambda r: r.priority))
    kept = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], common.text_bytes(text).alias("text"))
    schema = ", ".join([*(f"k{i} {kept.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), SCHEMA])
    arrow = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("first_char", pa.int64()), ("end_char", pa.int64()), ("span", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.setdefault(rules, None) or Scanner(rules)
        _scanners[rules] = scanner
        for batch in batches:
            counts, found = [], []
            for value in batch.column(len(keep)):
                raw = value.as_py() or b""
                words = scanner.words(raw)
                counts.append(len(words))
                rows = scanner.scan(words)
                at = _offsets(raw) if rows else []
                spans = [(at[b][0], at[e - 1][1]) for b, e, _ in rows]
                # characters before each byte
                chars = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)]) if rows else None
                found.append([
                    {"rule": r.name, "label": r.label, "priority": r.priority, "confidence": r.confidence, "first_word": b, "last_word": e - 1, "first_char": int(chars[x]), "end_char": int(chars[y]), "span": raw[x:y].decode(errors="replace")}
                    for (b, e, r), (x, y) in zip(rows, spans, strict=True)
                ])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(found, arrow)], [*(f"k{i}" for i in range(len(keep))), "n_words", "detections"])

    return kept.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def labels_of(detections: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))))


def digest(docs: DataFrame) -> DataFrame:
    """The scan of ``documents`` reduced to one row of counts and labels for each document."""
    base = F.filter("detections", lambda d: d["priority"] == 0)
    found = scan_licenses(docs).withColumn("base", base)
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["first_word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["first_word"])).alias("last_word"),
        labels_of(F.col("base")).alias("base_labels"), labels_of(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
