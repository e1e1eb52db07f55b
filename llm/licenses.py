"""Licence scans by sentence rules (operator 7).

Texts are cut into sentences at blank lines and at stops before a space. A notice may be wrapped over
lines of its sentence, with comment marks, or stand on some lines or between semicolons and bars of it; it is
normalised to its lower-case words. The known licence sentences are a dictionary of normalised sentences, made from
templates: words, ``{this|that}``, ``[optional]``, and ``...`` for an open end. Each leads to an
identifier; a text becomes the sequence of the identifiers of its known sentences, in
order, and the licence rules are matched against that sequence: a rule is an ordered list
of identifiers, which must occur in that order with at most ``GAP`` unknown sentences between
neighbours. Longer rules win: a sentence that serves a rule serves no shorter one.

A text is looked at only if it has one of the ``MARKS``, words picked so that every known sentence has one, so
nothing is missed. Null and empty texts have no licences; very long texts are scanned
whole; ids may be null or repeat (each row is scanned); empty tables give empty results;
further columns are kept, and one that has the result's name is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.keys import small_batches

GAP = 3
#: Words that are one to the rules.
SAME = {"released": "licensed", "distributed": "licensed", "available": "licensed", "published": "licensed", "v": "version", "licence": "license"}
SAME |= dict.fromkeys(("program", "project", "software", "library", "file", "text", "article", "content", "image", "package", "code", "module"), "work")
SAME |= {f"{v}{n}{z}": n for n in "1234" for v in ("", "v") for z in ("", ".0")}
_IT = "[this work is] [dual] licensed under [the terms of]"
_GNU = "{|the} {|gnu}"
_LATER_ON = "[only|or later|or any later version|or at your option any later version]"
#: Sentence identifier and template. Public licence notices, in lower case, without punctuation but for stops inside words.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("apache-notice", _IT + " the apache [software] license [version] 2 [the license]"),
    ("apache-title", "apache license [version] 2 [january 2004]"),
    ("apache-condition", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at ..."),
    ("apache-warranty", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis ..."),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-asf", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-asf-notice", "the asf licenses this file to you under the apache license version 2.0 the license"),
    ("mit-notice", _IT + " the {mit|expat|mit x11} license"),
    ("mit-title", "[the] {mit|expat} license [mit]"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software ..."),
    ("mit-condition", "the above copyright notice and this permission notice shall be included in all copies ..."),
    ("as-is", "the software is provided as is without warranty of any kind ..."),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability ..."),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted ..."),
    ("bsd-source", "redistributions of source code must retain the above copyright notice ..."),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice ..."),
    ("bsd-names", "neither the name of ... may be used to endorse or promote products"),
    ("bsd-advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement ..."),
    ("bsd-as-is", "this software is provided by the {copyright holders and contributors|regents and contributors|author|authors|contributors} as is and any express or implied warranties ..."),
    ("bsd-notice", _IT + " {a|the} {bsd|bsd style|new bsd|modified bsd|simplified bsd|2 clause bsd|3 clause bsd|bsd 2 clause|bsd 3 clause} license"),
    ("gpl3-notice", _IT + " " + _GNU + " {gpl|general public license} [license] [version] 3 " + _LATER_ON),
    ("gpl2-notice", _IT + " " + _GNU + " {gpl|general public license} [license] [version] 2 " + _LATER_ON),
    ("gpl-free", "this work is free software you can redistribute it and or modify it under the terms of the gnu general public license ..."),
    ("gpl-3-or", "either version 3 of the license or ..."),
    ("gpl-2-or", "either version 2 of the license or ..."),
    ("gpl-hope", "this work is distributed in the hope that it will be useful but without any warranty ..."),
    ("gpl-received", "you should have received a copy of the gnu [lesser|affero|library] general public license along with this ..."),
    ("lgpl-notice", _IT + " " + _GNU + " {lgpl|lesser general public license} [license] [version] {2|2.1|3} " + _LATER_ON),
    ("lgpl-free", "this work is free software you can redistribute it and or modify it under the terms of the gnu {lesser|library} general public license ..."),
    ("agpl-notice", _IT + " " + _GNU + " {agpl|affero general public license} [license] [version] 3 " + _LATER_ON),
    ("agpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license ..."),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license version 2"),
    ("mpl-obtain", "if a copy of the mpl was not distributed with this file you can obtain one at ..."),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license {2|version 2} ..."),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license {1|version 1} ..."),
    ("isc-grant", "permission to use copy modify and {or|distribute|or distribute} [distribute] this software for any purpose with or without fee is hereby granted provided that ..."),
    ("0bsd-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties ..."),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications ..."),
    ("zlib-origin", "the origin of this software must not be misrepresented ..."),
    ("zlib-altered", "altered source versions must be plainly marked as such ..."),
    ("zlib-notice", "this notice may not be removed or altered from any source distribution"),
    ("boost-notice", "distributed under the boost software license version 1.0"),
    ("boost-title", "boost software license [version] 1.0 [august 17th 2003]"),
    ("boost-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license ..."),
    ("cddl-notice", "the contents of this file are subject to the terms of [either the gnu general public license version 2 only gpl or] the common development and distribution license ..."),
    ("cddl-1.0", "common development and distribution license [cddl] version 1.0"),
    ("cddl-1.1", "common development and distribution license [cddl] version 1.1"),
    ("eupl-1.1", _IT + " the {eupl|european union public license|european union public license eupl} [version] 1.1 ..."),
    ("eupl-1.2", _IT + " the {eupl|european union public license|european union public license eupl} [version] 1.2 ..."),
    ("eupl-1.1-title", "european union public license [version|eupl] [version] 1.1"),
    ("eupl-1.2-title", "european union public license [version|eupl] [version] 1.2"),
    ("gpl-3-title", "gnu general public license version 3 29 june 2007"),
    ("gpl-2-title", "gnu general public license version 2 june 1991"),
    ("lgpl-3-title", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.1-title", "gnu lesser general public license version 2.1 february 1999"),
    ("agpl-3-title", "gnu affero general public license version 3 19 november 2007"),
    ("artistic-title", "[the] artistic license [version] 2.0"),
    ("perl-notice", "this {is|work is} free software you can redistribute it and or modify it under the same terms as perl ..."),
    ("artistic-notice", _IT + " the artistic license [version] 2"),
    ("ofl-notice", "this font software is licensed under the sil open font license version {1.0|1.1}"),
    ("wtfpl-title", "do what the fuck you want to public license [version 2]"),
    ("wtfpl-grant", "you just do what the fuck you want to"),
    ("cc-by-nc-sa", "[this work is] licensed under {a|the|} {cc|creative commons} {by nc sa|attribution noncommercial sharealike|attribution non commercial share alike} [1|2|2.5|3|4] [international|unported] [license]"),
    ("cc-by-nc-nd", "[this work is] licensed under {a|the|} {cc|creative commons} {by nc nd|attribution noncommercial noderivatives|attribution non commercial no derivatives} [1|2|2.5|3|4] [international|unported] [license]"),
    ("cc-by-nc", "[this work is] licensed under {a|the|} {cc|creative commons|creative commons cc} {by nc|attribution noncommercial|attribution non commercial} [1|2|2.5|3|4] [international|unported] [license]"),
    ("cc-by-nd", "[this work is] licensed under {a|the|} {cc|creative commons} {by nd|attribution noderivatives|attribution no derivatives} [1|2|2.5|3|4] [international|unported] [license]"),
    ("cc-by-sa", "[this work is] licensed under {a|the|} {cc|creative commons} {by sa|attribution sharealike|attribution share alike} [1|2|2.5|3|4] [international|unported] [license]"),
    ("cc-by", "[this work is] licensed under {a|the|} {cc|creative commons} {by|attribution} [1|2|2.5|3|4] [international|unported] [license]"),
    ("cc0", "[this work is] {licensed under|dedicated to the public domain under} {cc0|creative commons zero} [1.0] [universal]"),
    *((f"{kind}-url", f"[http|https] {{creativecommons.org|www.creativecommons.org}} licenses {kind[3:].replace('-', ' ')} {{1|2|2.5|3|4}} [deed.en|legalcode]") for kind in ("cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd")),
    ("cc0-url", "[http|https] {creativecommons.org|www.creativecommons.org} publicdomain zero 1 [deed.en|legalcode]"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "anyone is free to copy modify publish use compile sell or distribute this software ..."),
    ("public-domain", "[this work is] {licensed into|dedicated to|placed in|in} the public domain"),
    ("spdx", "spdx license identifier ..."),
)
#: Licence: ordered sentence identifiers.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-asf", "apache-asf-notice", "apache-condition", "apache-copy", "apache-warranty", "apache-see")),
    ("Apache-2.0", ("apache-asf", "apache-asf-notice", "apache-condition", "apache-copy")),
    ("Apache-2.0", ("apache-notice", "apache-condition", "apache-copy", "apache-warranty", "apache-see")),
    ("Apache-2.0", ("apache-notice", "apache-condition", "apache-copy", "apache-warranty")),
    ("Apache-2.0", ("apache-notice", "apache-condition", "apache-copy")),
    ("Apache-2.0", ("apache-asf-notice",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-title",)),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "as-is", "mit-liability")),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT-0", ("mit-grant", "as-is")),
    # the grant alone licenses, whatever became of its conditions
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-notice",)),
    ("GPL-3.0", ("gpl-free", "gpl-3-or", "gpl-hope", "gpl-received")),
    ("GPL-2.0", ("gpl-free", "gpl-2-or", "gpl-hope", "gpl-received")),
    ("LGPL", ("lgpl-free", "gpl-3-or", "gpl-hope", "gpl-received")),
    ("LGPL", ("lgpl-free", "gpl-2-or", "gpl-hope", "gpl-received")),
    ("AGPL-3.0", ("agpl-free", "gpl-3-or", "gpl-hope", "gpl-received")),
    ("GPL-3.0", ("gpl-free", "gpl-3-or")),
    ("GPL-2.0", ("gpl-free", "gpl-2-or")),
    ("LGPL", ("lgpl-free", "gpl-3-or")),
    ("LGPL", ("lgpl-free", "gpl-2-or")),
    ("AGPL-3.0", ("agpl-free", "gpl-3-or")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("GPL", ("gpl-free",)),
    ("LGPL", ("lgpl-notice",)),
    ("LGPL", ("lgpl-free",)),
    ("AGPL-3.0", ("agpl-notice",)),
    ("AGPL-3.0", ("agpl-free",)),
    ("MPL-2.0", ("mpl-notice", "mpl-obtain")),
    ("MPL-2.0", ("mpl-notice",)),
    ("EPL-2.0", ("epl-2",)),
    ("EPL-1.0", ("epl-1",)),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant", "as-is")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-notice",)),
    ("BSL-1.0", ("boost-title",)),
    ("Artistic-Perl", ("perl-notice",)),
    ("Artistic-2.0", ("artistic-notice",)),
    ("Artistic-2.0", ("artistic-title",)),
    ("CDDL-1.0", ("cddl-1.0",)),
    ("CDDL-1.1", ("cddl-1.1",)),
    ("CDDL", ("cddl-notice",)),
    ("EUPL-1.1", ("eupl-1.1",)),
    ("EUPL-1.1", ("eupl-1.1-title",)),
    ("EUPL-1.2", ("eupl-1.2",)),
    ("EUPL-1.2", ("eupl-1.2-title",)),
    ("GPL-3.0", ("gpl-3-title",)),
    ("GPL-2.0", ("gpl-2-title",)),
    ("LGPL", ("lgpl-3-title",)),
    ("LGPL", ("lgpl-2.1-title",)),
    ("AGPL-3.0", ("agpl-3-title",)),
    ("OFL", ("ofl-notice",)),
    ("WTFPL", ("wtfpl-title", "wtfpl-grant")),
    ("WTFPL", ("wtfpl-title",)),
    ("CC-BY-NC-SA", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND", ("cc-by-nc-nd",)),
    ("CC-BY-NC", ("cc-by-nc",)),
    ("CC-BY-ND", ("cc-by-nd",)),
    ("CC-BY-SA", ("cc-by-sa",)),
    ("CC-BY", ("cc-by",)),
    ("CC0", ("cc0",)),
    *((kind.upper(), (f"{kind}-url",)) for kind in ("cc-by-nc-sa", "cc-by-nc-nd", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by", "cc0")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant", "as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense", "unlicense-anyone")),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public-domain",)),
    ("SPDX", ("spdx",)),
)


def expand(template: str) -> set[str]:
    """All sentences of a template."""
    done, todo = set(), [template]
    while todo:
        t = todo.pop()
        m = re.search(r"\{([^][{}]*)\}|\[([^][{}]*)\]", t)
        if not m:
            done.add(" ".join(SAME.get(w, w) for w in t.split()))
            continue
        choices = m[1].split("|") if m[1] is not None else ["", *m[2].split("|")]
        todo += [t[: m.start()] + c + t[m.end() :] for c in choices]
    return done


def _dictionary() -> tuple[dict[str, str], dict[str, tuple[str, str]], set[str]]:
    """(whole sentences, beginnings of open ones with what must follow, all their shorter beginnings)."""
    exact: dict[str, str] = {}
    opens: dict[str, tuple[str, str]] = {}
    begun: set[str] = set()
    for name, template in SENTENCES:
        for sentence in expand(template):
            start, dots, rest = sentence.partition(" ...")
            if dots:
                opens.setdefault(start, (name, rest.strip()))
            else:
                exact.setdefault(start, name)
            words = start.split()
            begun.update(" ".join(words[:k]) for k in range(1, len(words)))
    return exact, opens, begun


def _marks(sentences: Iterable[str]) -> str:
    """A pattern of a few words so that each sentence has one; those of many sentences first; short and common ones are not picked."""
    left = [set(s.split()) for s in sentences]
    out = []
    while left:
        counts = Counter(w for s in left for w in s if (len(w) > 5 or w in _SHORT) and w not in _COMMON)
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        out.append(best)
        left = [s for s in left if best not in s]
    return r"(?i)(?<!\w)(?:" + "|".join(re.escape(x) for w in out for x in (w, *(k for k, v in SAME.items() if v == w))) + r")(?!\w)"


#: Words of known sentences that ordinary texts are full of.
_COMMON = {"licensed", "version", "option", "either", "without", "public", "general", "source", "following", "received", "should", "useful", "notice", "international", "unported"}
#: Short words that few other texts have.
_SHORT = {"gpl", "lgpl", "agpl", "gnu", "eupl", "cc", "cc0", "mit", "mpl", "fuck"}
EXACT, OPEN, _BEGUN = _dictionary()
#: Every known sentence has one of these words, in some case.
MARKS = _marks([*EXACT, *OPEN])
#: Stops of these are none of the sentence.
_SHORTENED = re.compile(r"(?i)\b(?:v|ver|vers|e\.g|i\.e)\.$")
_CUT = re.compile(r"\n|;|\||(?<=[.!?])(?<!\b[Vv]\.)(?<!\b[Vv]er\.)(?<!\b[Vv]ers\.)(?<!\b[Ee]\.g\.)(?<!\b[Ii]\.e\.)\s|\.(?=$)")
#: The number of a list, before a sentence.
_NUMBER = re.compile(r"^(?:\d{1,2}|[b-d]|i{1,3}) (?=\S)")
_LATER = re.compile(r"either version ([23]) of the license\b")
#: Licences joined by AND, OR and WITH, with brackets.
_NAMED = re.compile(r"(?i:spdx-license-identifier):\s*([( \t]*[\w.+:-]+(?:[ \t)]+(?:AND|OR|WITH)[ \t(]+[\w.+:-]+)*)")
_ORDERED = sorted(range(len(RULES)), key=lambda i: (-len(RULES[i][1]), i))


def normalise(sentence: str) -> str:
    """Lower-case words, those of ``SAME`` as one; stops stay inside words only."""
    words = [w.strip(".") for w in re.findall(r"[\w.+]+", sentence.lower().replace("_", " "))]
    return " ".join(SAME.get(w, w) for w in words if w)


def sentence_ids(text: str) -> list[tuple[int, str, int, int, str]]:
    """(number of the sentence, identifier, start, stop, licence named by it) of all known sentences."""
    out: list[tuple[int, str, int, int, str]] = []
    number, start = 0, 0
    lines: list[tuple[int, int, str]] = []  # of the sentence: start, stop, words
    for stop, after in [*((m.start(), m.end()) for m in _CUT.finditer(text)), (len(text), len(text))]:
        plain = normalise(text[start:stop])
        if plain:
            lines.append((start, stop, plain))
        # a line end, semicolon or bar inside a sentence is none of its own
        ended = text[start:stop].rstrip()
        soft = plain and text[stop:after] in ("\n", ";", "|") and (ended[-1] not in ".!?" or _SHORTENED.search(ended[-8:]))
        if lines and not soft:
            out.extend(_in_sentence(text, lines, number))
            number += 1
            lines = []
        start = after
    return out


def _known(lines: list[tuple[int, int, str]], i: int) -> tuple[str, int, bool] | None:
    """(identifier, last line, whether its end is open) of the longest known sentence that begins with line i."""
    best: tuple[str, int, bool] | None = None
    words: list[str] = []
    pending: tuple[str, str] | None = None
    for j in range(i, len(lines)):
        before = len(words)
        words += (_NUMBER.sub("", lines[j][2]) if j == i else lines[j][2]).split()
        for k in range(before + 1, len(words) + 1):
            if pending is None:
                pending = OPEN.get(" ".join(words[:k]))
        whole = " ".join(words)
        if pending and pending[1] in whole:
            return pending[0], j, True
        if whole in EXACT:
            best = EXACT[whole], j, False
        if pending is None and whole not in _BEGUN:
            break
    return best


def _in_sentence(text: str, lines: list[tuple[int, int, str]], number: int) -> Iterator[tuple[int, str, int, int, str]]:
    """The notices on the lines of one sentence; one with an open end goes on to the next notice."""
    hits, i = [], 0
    while i < len(lines):
        known = _known(lines, i)
        if known:
            hits.append((i, *known))
            i = known[1]
        i += 1
    for (i, name, j, going), end in zip(hits, [*(h[0] for h in hits[1:]), len(lines)], strict=False):
        start, stop = lines[i][0], lines[end - 1 if going else j][1]
        named = _NAMED.search(text, start, stop) if name == "spdx" else None
        yield number, name, start, stop, named[1] if named else ""
        later = _LATER.search(normalise(text[start:stop])) if name.endswith("-free") else None
        if later:
            yield number, f"gpl-{later[1]}-or", start, stop, ""


def licences_named(expression: str) -> list[str]:
    """The licences of an SPDX expression, each once, in order; an exception stays with its licence."""
    parts = re.split(r"\s+(?:AND|OR)\s+", " ".join(re.sub(r"[()]", " ", expression).split()))
    return list(dict.fromkeys(p for p in parts if p))


def match_rules(found: list[tuple[int, str, int, int, str]]) -> list[dict]:
    """Licences in order of their place; longer rules first, each sentence used once."""
    used: set[int] = set()
    hits = []
    for i in _ORDERED:
        licence, rule = RULES[i]
        for first in range(len(found)):
            chain: list[int] = []
            for j in range(first, len(found)):
                if j in used or found[j][1] != rule[len(chain)]:
                    if chain and j not in used and found[j][0] - found[chain[-1]][0] > GAP + 1:
                        break
                    if not chain:
                        break
                    continue
                if chain and found[j][0] - found[chain[-1]][0] > GAP + 1:
                    break
                chain.append(j)
                if len(chain) == len(rule):
                    break
            if len(chain) == len(rule):
                used.update(chain)
                for named in licences_named(found[chain[0]][4]) or [licence]:
                    hits.append({"license": named, "sentences": [found[j][1] for j in chain], "start": found[chain[0]][2], "stop": found[chain[-1]][3]})
    return sorted(hits, key=lambda h: (h["start"], h["license"]))


def scan_licenses(docs: DataFrame, text_col: str = "text", out_col: str = "licenses") -> DataFrame:
    """``docs`` with the licences of each whole text: (license, sentences, start, stop), in characters."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)
    arrow = pa.list_(pa.struct([("license", pa.string()), ("sentences", pa.list_(pa.string())), ("start", pa.int64()), ("stop", pa.int64())]))
    kind = "array<struct<license:string,sentences:array<string>,start:bigint,stop:bigint>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = re.compile(MARKS)
        for batch in batches:
            out = []
            for text in batch.column(at):
                value = text.as_py()
                out.append(match_rules(sentence_ids(value)) if value and marked.search(value) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, docs.withColumn(out_col, F.lit(None).cast(kind)).schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs)
    return found.select(
        "doc_id",
        F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x.license))).alias("licenses"),
        F.transform("licenses", lambda x: F.struct(x.start.alias("start"), x.stop.alias("stop"))).alias("spans"),
        F.transform("licenses", lambda x: F.array_join(x.sentences, ">")).alias("rules"),
    )
