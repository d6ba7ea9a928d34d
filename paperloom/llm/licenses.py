"""Operator 7: licence scans by canonical digest lookup; DataFrame functions only.

A text unit is brought to a canonical form: lower case, copyright lines out, equivalent spellings made one, runs of
anything but letters and digits one space. Its digest is hash-joined to the digests of known licence texts, so a
unit is either a known text as a whole or not; there is no partial match. The units of a document are its whole
text, each of its lines, so that a notice line within prose is found too, and runs of paragraphs, so that a licence within a
longer text is. Paragraphs end at lines without letters or digits; those that are empty in canonical form do not count. A run
has as many paragraphs as some known text that begins with the same one; it is neither the whole document nor a single line,
as these are units already, and a document that is a known text as a whole has none. Licences that share a paragraph with other text are not found. A document's result has a row for each
licence and kind of unit with the number of units.

Results in special cases. Null or empty text, and units without letters or digits: match nothing. Empty table: no rows. Very long texts: whole, each line
is a unit. Repeated rows, and rows with equal or null doc_ids: counted each, in one row of their doc_id. Ties, a text that is known under two
names: a row for each. Extra columns, also of names used here, are ignored.

`known` may be any table (license, text); the built-in one has KNOWN and the files of licence_texts and is broadcast, a larger one
is left to Spark's own choice of join. The hashes of the paragraphs of each known text go to the driver.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bind, whole_text

#: Texts and notices of well-known licences, as their publishers word them.
KNOWN = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "BSD-3-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    ],
    "BSL-1.0": [
        """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org>"""
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "all-rights-reserved": ["All rights reserved."],
}
#: Spellings that count as one.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("favour", "favor"), ("neighbour", "neighbor"), ("organisation", "organization"), ("non-infringement", "noninfringement"), ("https://", "http://"))
#: A copyright line, and the reservation of all rights that may follow it, of lower-cased texts. Such a reservation belongs to the line; one that stands alone is a notice.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*(\n[ \t]*all rights reserved[.]?[ \t]*)?$"
OTHER = r"[^\p{L}\p{N}]+"
#: What stands between paragraphs.
BREAK = r"\n[^\p{L}\p{N}]*\n"


def canonical(text: Column) -> Column:
    """The canonical form of a unit of text."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, OTHER, " "))


def known_digests(known: DataFrame) -> DataFrame:
    """license, digest and n (the canonical length) of each known text; a text that two licences share names both."""
    form = known.select("license", canonical(F.col("text")).alias("c")).where("c <> ''")
    return form.select("license", F.sha2("c", 256).alias("digest"), F.length("c").alias("n")).distinct()


def builtin(spark) -> DataFrame:
    rows = [(k, t) for k, v in KNOWN.items() for t in v]
    rows.append(("MIT", KNOWN["MIT"][-1].split("\n", 1)[1]))  # without its title, as in file headers
    rows += [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    return spark.createDataFrame(rows, "license string, text string")


def paragraphs(text: Column) -> Column:
    """Structs of the canonical form of each paragraph and the paragraph itself."""
    parts = F.transform(F.split(text, BREAK, -1), lambda p: F.struct(canonical(p).alias("c"), p.alias("raw")))
    return F.filter(parts, lambda p: p["c"] != "")


def _several(paragraph: Column) -> Column:
    """Whether more than one line has a canonical form."""
    return F.regexp_replace(F.lower(paragraph), COPYRIGHT_LINE, " ").rlike(r"[\p{L}\p{N}][^\n]*\n[^\p{L}\p{N}]*[\p{L}\p{N}]")


def runs(text: Column, heads: dict[int, set[int]], wholes: set[int]) -> Column:
    """The canonical forms of the runs of paragraphs that begin like a known text, but for texts whose own hash is in `wholes`.

    heads: paragraph counts by hash of the first.
    """
    if not heads:
        return F.array().cast("array<string>")
    table = F.create_map(*(x for h, ks in heads.items() for x in (F.lit(h), F.array(*map(F.lit, sorted(ks))))))

    def at(ps: Column, i: Column) -> Column:
        fit = F.filter(table[F.xxhash64(ps[i]["c"])], lambda k: (i + k <= F.size(ps)) & (k < F.size(ps)) & ((k > 1) | _several(ps[i]["raw"])))
        return F.transform(fit, lambda k: F.array_join(F.slice(ps["c"], i + 1, k), " "))

    def found(ps: Column) -> Column:
        begun = F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: F.array_contains(F.array(*map(F.lit, heads)), F.xxhash64(ps[i]["c"])))
        return F.when((F.size(ps) > 1) & ~F.xxhash64(F.array_join(ps["c"], " ")).isin(*wholes), F.flatten(F.transform(begun, lambda i: at(ps, i)))).otherwise(F.array().cast("array<string>"))

    return bind(paragraphs(text), found)


def licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, license, unit ('text', 'line' or 'paragraphs') and n_units, for documents with known units."""
    table = builtin(docs.sparkSession) if known is None else known
    digests = known_digests(table)
    forms = table.select("license", bind(paragraphs(F.col("text")), lambda ps: F.struct(F.transform(ps["c"], lambda c: F.xxhash64(c)).alias("hs"), F.xxhash64(F.array_join(ps["c"], " ")).alias("h"))).alias("x"))
    forms = [(r["license"], tuple(r["hs"]), r["h"]) for r in forms.where("size(x.hs) > 0").select("license", "x.hs", "x.h").distinct().collect()]
    ends = {(name, hs) for name, hs, _ in forms}
    heads: dict[int, set[int]] = {}
    for name, hs, _ in forms:
        if not any((name, hs[k:]) in ends for k in range(1, len(hs))):  # else the end is what counts, once
            heads.setdefault(hs[0], set()).add(len(hs))
    text = whole_text()
    lines = F.transform(F.split(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), "\n", -1), lambda x: F.struct(F.lit("line").alias("unit"), x.alias("t")))
    whole = F.array(F.struct(F.lit("text").alias("unit"), text.alias("t")))
    # a text of one line is a unit of either kind
    units = docs.select("doc_id", F.explode(F.concat(whole, lines)).alias("u")).select("doc_id", "u.unit", canonical(F.col("u.t")).alias("c"))
    units = units.union(docs.select("doc_id", F.lit("paragraphs"), F.explode(runs(text, heads, {h for *_, h in forms}))))
    # a digest can only be known if some known text has as many characters, which is cheaper to see
    lengths = digests.agg(F.collect_set("n").alias("ns"))
    sizes = [r for r in lengths.first()["ns"]] if known is None else None
    if sizes is not None:
        units = units.where(F.length("c").isin(sizes))
        digests = F.broadcast(digests)
    found = units.select("doc_id", "unit", F.sha2("c", 256).alias("digest")).join(digests, "digest")
    return found.groupBy("doc_id", "license", "unit").agg(F.count("*").alias("n_units"))


def oracle() -> str:
    """The same for the built-in texts, for DuckDB."""
    quote = lambda t: t.replace("'", "''")
    rows = ", ".join(f"('{k}', '{quote(t)}')" for k, v in KNOWN.items() for t in v)

    def form(c: str) -> str:
        out = rf"regexp_replace(lower({c}), '{COPYRIGHT_LINE}', ' ', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

    return f"""
    WITH known AS (SELECT DISTINCT k.license, {form('k.t')} AS c FROM (VALUES {rows}) AS k(license, t)),
    units AS (
      SELECT doc_id, 'text' AS unit, coalesce(text, '') AS t FROM documents
      UNION ALL SELECT doc_id, 'line', unnest(string_split(regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT_LINE}', ' ', 'g'), chr(10))) FROM documents),
    forms AS (SELECT doc_id, unit, {form('t')} AS c FROM units)
    SELECT f.doc_id, k.license, f.unit, count(*) AS n_units FROM forms f JOIN known k ON f.c = k.c
    WHERE k.c <> '' GROUP BY ALL"""
