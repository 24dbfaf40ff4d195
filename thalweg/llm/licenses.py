"""Licence scans by canonical digest lookup, with DataFrame functions only.

A text is put into canonical form: lower case; lines that state a copyright gone (a year, a sign or a place holder after the
word; "copyright notice" in the middle of a sentence stays); punctuation and white space to one blank; equivalent spellings
made one, of one word or two; a leading title such as "The MIT License (MIT)" gone. Its SHA-256 is joined with the digests
of known licences. So a text matches if the whole of it is a known licence, up to those differences. Short licences are held
as texts, long ones as the digests of their canonical forms; more can be given as a table (`known_texts` reads a folder).

Cases: a null or blank text has the canonical form '' and no licence; rows that repeat are looked up each; two known
texts with one digest give the smaller name; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as one, as in the public matching guidelines for licence lists.
SPELLINGS = {
    "acknowledgment": "acknowledgement", "analog": "analogue", "analyze": "analyse", "artifact": "artefact", "authorization": "authorisation",
    "authorized": "authorised", "caliber": "calibre", "canceled": "cancelled", "capitalizations": "capitalisations", "catalog": "catalogue",
    "categorize": "categorise", "center": "centre", "emphasized": "emphasised", "favor": "favour",
    "favorite": "favourite", "fulfill": "fulfil", "fulfillment": "fulfilment", "initialize": "initialise", "judgement": "judgment",
    "labeling": "labelling", "labor": "labour", "license": "licence", "licensed": "licenced", "licenses": "licences", "maximize": "maximise",
    "modeled": "modelled", "modeling": "modelling", "offense": "offence", "optimize": "optimise",
    "organization": "organisation", "organize": "organise", "practice": "practise", "program": "programme", "realize": "realise",
    "recognize": "recognise", "signaling": "signalling", "utilization": "utilisation", "while": "whilst", "wilfull": "wilful",
    "https": "http", "noncommercial": "non commercial", "owner": "holder", "owners": "holders", "percent": "per cent", "sublicence": "sub licence",
    "sublicense": "sub licence", "sublicensed": "sub licenced", "sublicenses": "sub licences", "sublicensing": "sub licensing",
}

# Texts of known licences, without their copyright lines.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
KNOWN = {
    "0BSD": f"{_ISC_GRANT}.\n{_ISC_DISCLAIMER}",
    "BSD-2-Clause": f"{_BSD_HEAD}{_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_HEAD}{_BSD_THIRD}{_BSD_DISCLAIMER}",
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_DISCLAIMER}",
    "MIT": f"{_MIT_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_MIT_DISCLAIMER}",
    "MIT-0": f"{_MIT_GRANT}.\n{_MIT_DISCLAIMER}",
    "Zlib": _ZLIB,
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
}

# SHA-256 of the canonical forms of longer licences, as published with common distributions.
DIGESTS = {
    "Apache-2.0": "34d468f911c9677f3ccf5df383f43f03f2983b72765e02730c65e52df2f6b17a",
    "Apache-2.0 (terms only)": "ab10da7ce2b99967e861ac8f106f2328e347a8041c34d157f259e85c80e23261",
    "Apache-2.0 (terms)": "03f4f4255290173e2d06703e59eabf41771525f53b2fc722c8b7737fef7b6b38",
    "Artistic-1.0-Perl": "c784e0da5405a00ec2f4d4e49af5461b756a0e0466993da83ea3d23f64a70c98",
    "CC0-1.0": "c0a61b376872966900679abb3ebd3a084b202332acbc7b5c91c9d724768c5a88",
    "GFDL-1.2": "6f5276b3e493a4f0c673115464f9d170d6297349824d56dd0ffc904b85b414e9",
    "GFDL-1.3": "654e6a469b9c4ffdcb455961e36c8103a5f3c32297982f7afc46e57d1fdeddad",
    "GPL-1.0": "bb8b1773592fefb979dc35641aed7c19069610238a530d5a74649238b225f046",
    "GPL-1.0 (terms only)": "9ac75ade4900db333c54a073d6ec9d2a845ff6ace557dd57e57d7a7a845d8db3",
    "GPL-1.0 (terms)": "5a109269d350af0dbc0f93771c14e18b0b95f625cafbf903df767622cbb9f907",
    "GPL-2.0": "2680e9ce76ec25d530eb1ec63ba9cf9260889e39eb80bd5ed0ad08379cceb94c",
    "GPL-2.0 (terms only)": "cf822330359204d95f389dbd53ad4eadd377f5d601d494a214c887d13fa00884",
    "GPL-2.0 (terms)": "f525b519478650a85948b2336ebc95535975c60f9fb5cfb8be9c0f4ddd557adb",
    "GPL-3.0": "f3a97601b288bf40c74e2a1d42fe482e93265c2fbad41c5af36d1ed9eb5c7eca",
    "GPL-3.0 (terms only)": "8e4f4d808c97b9eba19fb2b45a00d5397017c7fe03c2855b860d9b9cc37d61da",
    "GPL-3.0 (terms)": "365d5dad9460d88b866fd2a2327f90a283b78fffd69cf23ac12dd05c58c22518",
    "LGPL-2.0": "280dbb7ff57d57641d9b8550a0b73280579a01e326a165898ecae679612576c7",
    "LGPL-2.0 (terms only)": "2730741337eca0090ec6932482e5d74fa7caba6de15efd26bd43afbc686f534b",
    "LGPL-2.0 (terms)": "b48e8a91ba761013282ea0d09c31d5fde33679b3c799471205c09ddf78453c0b",
    "LGPL-2.1": "13e15ddb02ee150c68720a5e2e513ca7a44520c2786eca058b10ce2a92724c44",
    "LGPL-2.1 (terms only)": "4f6e434ec8ed6fd73f47498f0159bae74538b334b59f6c9a9a2b61b4b5d55867",
    "LGPL-2.1 (terms)": "a468b8b6d15cb3df8d275676e680c8005483217b8df038c6852d9988a989ea19",
    "LGPL-3.0": "7d6e51c6bb80fc7a025c16e64157adf9c280c58dee4c4b2bf73e596166a2a08f",
    "MPL-1.1": "ea4b7e0c894f0093ff1e0bd614c173f7c0a2764587d5dba15503ddf97a73d022",
    "MPL-2.0": "44c665f5cf6527017e026a9f619d691dadb5acd6f984359e97249d402a6ad7af",
}

#: Both engines read these alike: lines that state a copyright, what is neither letter nor digit, and titles.
COPYRIGHT = r"(?m)^[^a-z\n]{0,8}(?:(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|:|by\b|[0-9]{4}|[<\[{])|copyright[^\n]{1,80}[^0-9\n](?:19|20)[0-9]{2}\b|all rights reserved\.?[ \t\r]*$)[^\n]*$"
OTHER = r"[^a-z0-9\x{00c0}-\x{024f}\x{0370}-\x{fffd}]+"
TITLE = r"^(?:the )?(?:mit|isc|expat|zlib|0bsd|mit 0|(?:(?:new|simplified|modified|revised|zero clause) )?bsd(?: [0-4] clause)?|[0-4] clause bsd)(?: (?:new|simplified|original|revised|modified|no attribution))? licence(?: (?:mit|isc|bsd|zlib))? "


def canonical(text: Column) -> Column:
    """The canonical form of a text; '' for null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, ""), OTHER, " ")
    same = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    words = F.transform(F.split(F.trim(plain), " "), lambda w: F.when(w.isin(*SPELLINGS), F.try_element_at(same, w)).otherwise(w))
    out = F.array_join(words, " ")
    return F.regexp_replace(out, TITLE, "")


def known_texts(spark: SparkSession, path: str) -> DataFrame:
    """licence (the file's name without its ending), body: a row for each file of a folder of licence texts."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.(?:txt|md))?$", 1)
    return files.select(name.alias("licence"), F.col("value").alias("body"))


def scan(spark: SparkSession, docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """docs: doc_id, text; known: licence, body of more licences. Returns doc_id, digest (of the canonical form), licence
    (null: none is known)."""
    own = spark.createDataFrame(sorted(KNOWN.items()), "licence string, body string").select("licence", F.sha2(canonical(F.col("body")), 256).alias("known"))
    own = own.union(spark.createDataFrame(sorted(DIGESTS.items()), "licence string, known string"))
    if known is not None:
        own = own.union(known.select("licence", F.sha2(canonical(F.col("body")), 256)))
    own = own.groupBy("known").agg(F.min("licence").alias("licence"))
    digests = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    # the licences of this module are literals, so they can be broadcast; a table that is given has any size
    own = F.broadcast(own) if known is None else own
    return digests.join(own, F.col("digest") == F.col("known"), "left").select("doc_id", "digest", "licence")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """canonical() for DuckDB."""
    keys, values = ", ".join(map(_quoted, SPELLINGS)), ", ".join(map(_quoted, SPELLINGS.values()))
    plain = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT)}, '', 'g'), {_quoted(OTHER)}, ' ', 'g')"
    out = f"array_to_string(list_transform(string_split(trim({plain}), ' '), lambda w: coalesce(map([{keys}], [{values}])[w], w)), ' ')"
    return f"regexp_replace({out}, {_quoted(TITLE)}, '')"


def scan_sql() -> str:
    rows = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(KNOWN.items()))
    more = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(DIGESTS.items()))
    return f"""
        WITH every AS (SELECT sha256({canonical_sql("body")}) AS known, licence FROM (VALUES {rows}) t(licence, body) UNION ALL SELECT known, licence FROM (VALUES {more}) t(licence, known)),
        known AS (SELECT known, min(licence) AS licence FROM every GROUP BY 1),
        found AS (SELECT doc_id, sha256({canonical_sql("text")}) AS digest FROM documents)
        SELECT doc_id, digest, licence FROM found LEFT JOIN known ON digest = known"""
