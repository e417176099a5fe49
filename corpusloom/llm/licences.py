"""Licence scans by canonical digests.

Texts are brought to one canonical form, in which case, punctuation, white
space, copyright notices and equivalent spellings of whole words don't count. A notice is a line
that begins with one, or what stands in a line from it to the licence's own words. Whole texts, and each
single line of them, are then looked up by digest among known licences and known
licence statements. The known side is a table built here, of fixed size, and is
broadcast; no text is ever compared with another.

``LICENCE_DIGESTS`` holds the SHA-256 of whole licences in canonical form.
Statements such as "Licensed under ..." are built from their parts by rule.

Defined cases: a null text counts as empty and matches nothing; repeated rows
are each reported; an empty table gives an empty result; extra columns stay
out of the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, let, row_keys

#: Spellings that count as equal, after the matching guidelines of the public licence list.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisation": "capitalization",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasise": "emphasize",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "honour": "honor",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "maximise": "maximize",
    "modelled": "modeled",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "non commercial": "noncommercial",
    "per cent": "percent",
    "copyright owner": "copyright holder",
    "https": "http",
}

#: SHA-256 of whole licences in canonical form (see ``canonical_text``).
LICENCE_DIGESTS = {
    "Apache-2.0": "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37",
    "Artistic-1.0": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "BSD-2-Clause": "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2",
    "BSD-2-Clause (untitled)": "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30",
    "BSD-3-Clause": "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15",
    "BSD-3-Clause (untitled)": "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
    "GFDL-1.3": "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "5fc5b48e8eeed6e5e77c32ad8641a6bc04d25011d6b500aa7dc7f3183ab812ea",
    "ISC": "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee",
    "ISC (untitled)": "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MIT": "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164",
    "MIT (untitled)": "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c",
    "MPL-1.1": "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
}

#: Names under which statements call a licence.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause"],
    "ISC": ["ISC License", "ISC"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"],
} | {f"CC-{k}-{v}": [f"CC {k} {v}", f"CC-{k}-{v}", f"Creative Commons {n} {v} International License", f"Creative Commons {n} {v} License"] for v in ("3.0", "4.0") for k, n in (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))}
_SUBJECTS = ("", "this work is ", "this software is ", "this program is ", "this file is ", "this text is ", "this document is ", "this page is ", "the text is ", "the content is ", "content is ", "code is ")
_VERBS = ("licensed under", "released under", "distributed under", "available under", "made available under", "published under")
_OPENINGS = ("", "the terms of ", "a ")


#: How licences and statements go on after a copyright notice in the same line.
_BODY = r"(?:permission is (?:hereby )?granted|permission to use|redistribution and use|licensed under|released under|this (?:software|program|work|library) is)"
#: Copyright lines; what a notice in a line stands before stays.
_NOTICE_LINE = rf"(?m)^[ \t>*#/;-]*(?:copyright\b(?! (?:notice|holder|owner|law|and|license|statement))|©|\(c\))(?:(?!{_BODY}).)*|^[ \t]*all rights reserved\.?[ \t]*$"
_NOTICE_INSIDE = rf"(?:copyright (?:\(c\)|©|\d{{4}})|©|\(c\) \d{{4}})(?:(?!{_BODY}).)*(?={_BODY})"


def canonical(text: Column) -> Column:
    """The text in canonical form, line by line. Each word stands between spaces of its own, so that only whole words are replaced."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for notice in (_NOTICE_LINE, _NOTICE_INSIDE):
        out = F.regexp_replace(out, notice, "")
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", "  "), "\n", " \n "), F.lit(" "))
    for spelt, plain in EQUIVALENT.items():
        for ending in ("", "s"):
            out = F.replace(out, F.lit(f" {spelt}{ending} ".replace(" ", "  ")[1:-1]), F.lit(f" {plain}{ending} ".replace(" ", "  ")[1:-1]))
    return out


def _joined(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"\s+", " "))


def digest(canonical_text: Column) -> Column:
    return F.sha2(_joined(canonical_text), 256)


def statements() -> list[tuple[str, str]]:
    """Licence and statement, of each combination of subject, verb, opening and name."""
    out = [(i, f"{s}{v} {o}{name}") for i, names in NAMES.items() for name in names for s in _SUBJECTS for v in _VERBS for o in (*_OPENINGS, "the ", "the terms of the ")]
    return out + [(i, f"spdx-license-identifier: {i}") for i in NAMES] + [(i, f"license: {name}") for i, names in NAMES.items() for name in names]


def known(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Digests of whole licences (digest, licence), and of statements (digest, licence, length in canonical form)."""
    whole = spark.createDataFrame(sorted((d, i) for i, d in LICENCE_DIGESTS.items()), "digest string, licence string")
    rows = spark.createDataFrame(statements(), "licence string, statement string")
    form = rows.select(_joined(canonical(F.col("statement"))).alias("form"), "licence")
    lines = form.groupBy(F.sha2("form", 256).alias("digest"), F.char_length("form").alias("length")).agg(F.min("licence").alias("licence"))
    return whole, lines


def scan(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Of every row: doc, digest (of its whole text), licence (null if it isn't one), statements (licences named in its lines, sorted).

    Texts are brought to canonical form once. Lines longer than every statement can't be one and aren't hashed.
    """
    whole, lines = known(docs.sparkSession)
    longest = lines.agg(F.max("length")).first()[0]
    k1, k2 = row_keys(doc, text)

    def digests(of: Column) -> Column:
        near = F.filter(F.split(of, "\n"), lambda x: F.char_length(x).between(1, 2 * longest + 4))  # in canonical form two spaces stand for one
        short = F.filter(F.transform(near, _joined), lambda x: F.char_length(x).between(1, longest))
        return F.struct(digest(of).alias("digest"), F.transform(short, lambda x: F.sha2(x, 256)).alias("lines"))

    rows = docs.select(F.col(doc).alias("doc"), k1.alias("k1"), k2.alias("k2"), let(canonical(F.col(text)), digests).alias("d"))
    base = cut(rows.select("doc", "k1", "k2", "d.digest", "d.lines"), "digests")
    each = base.select("k1", "k2", F.explode("lines").alias("digest"))
    hits = each.join(F.broadcast(lines.select("digest", "licence")), "digest").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("licence")).alias("statements"))
    out = base.drop("lines").join(F.broadcast(whole), "digest", "left").join(hits, ["k1", "k2"], "left")
    return out.select(F.col("doc").alias(doc), "digest", "licence", F.coalesce("statements", F.array().cast("array<string>")).alias("statements"))
