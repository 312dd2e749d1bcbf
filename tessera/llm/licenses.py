"""Licence scans by canonical digest (DataFrame functions only).

A text is brought to a canonical form in which differences of case, punctuation, spacing,
copyright lines and equivalent spellings vanish. The SHA-256 of the form is looked up among the
digests of known licence texts with a hash join. The same lookup runs over each line, which
finds notices and texts laid out as one line inside a longer document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, small, stored

# Words that count as one another, as in the public licence matching guidelines.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "per cent": "percent",
    "sub license": "sublicense", "non commercial": "noncommercial", "copyright owner": "copyright holder",
    "https": "http",
}

# Licence texts and customary one-line notices.
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n"
)
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.\n"
)
_ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
_AUTHOR = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not "
    "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
    "the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must "
    "not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
    "obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
    "implied. See the License for the specific language governing permissions and limitations under the License."
)
KNOWN = [
    ("MIT", "MIT License\n" + _PERMISSION), ("MIT", _PERMISSION), ("BSD-2-Clause", _REDISTRIBUTION + _AS_IS),
    ("BSD-3-Clause", _REDISTRIBUTION + _ENDORSEMENT + _AS_IS), ("ISC", _ISC + _AUTHOR), ("0BSD", _ZERO + _AUTHOR), ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
]


# Digests of the canonical forms of whole licences, as published and as Linux distributions carry them.
WHOLE = [
    ("Apache-2.0", "98d1daef46ab1ed2ff297cc712d8cdb3e6f2d49bf60699ed6549287155ed6dda"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "093bb37bff6533bc1f91f57d671e3e2cc9e4e27afc1293808fddc861a6d15329"),
    ("LGPL-2.0", "148f4708fdb34267f108b3467504e464cf0c00e2c6b6ebafc1a45e2e5c4506b9"),
    ("LGPL-2.1", "c3acda00b8ee9c98becbe30fce8f159cc6a985b3b9dc521e37d9ab2f241463b2"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]

#: What stands for the copyright notice of a line, at its beginning.
_OWNED = r"(?md)^[^\p{L}\p{N}\n]*(copyright(?! (holder|owner|notice))(?![\p{L}\p{N}])|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form: lower case, no copyright lines, words of letters and digits, one spelling, single spaces."""
    low = F.lower(text)
    kept = let(low, lambda x: F.when(F.contains(x, F.lit("copyright")) | F.contains(x, F.lit("(c)")) | F.contains(x, F.lit("©")), F.regexp_replace(x, _OWNED, " ")).otherwise(x))
    bare = F.btrim(F.regexp_replace(kept, r"[^\p{L}\p{N}]+", " "))
    any_ = "(^| )(" + "|".join([*SPELLINGS, "all rights reserved"]) + ")( |$)"

    def spelt(x: Column) -> Column:
        # each word has its own two blanks, so neighbours can both be replaced
        x = F.concat(F.lit(" "), F.replace(x, F.lit(" "), F.lit("  ")), F.lit(" "))
        for a, b in {**SPELLINGS, "all rights reserved": ""}.items():
            x = F.replace(x, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} "))
        return F.btrim(F.regexp_replace(x, " +", " "))

    return let(bare, lambda x: F.when(F.rlike(x, F.lit(any_)), spelt(x)).otherwise(x))


def digests_of(texts: DataFrame) -> DataFrame:
    """Rows (digest, license_id), a digest once, from a table (license_id, text); empty forms name nothing."""
    form = texts.select("license_id", canonical(F.coalesce("text", F.lit(""))).alias("form")).where("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_licenses(spark: SparkSession) -> DataFrame:
    """The digests of ``KNOWN`` and of the whole licences in ``WHOLE``."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in KNOWN])
    whole = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(i).alias("license_id")) for i, d in WHOLE])
    one = spark.range(1)
    return digests_of(one.select(F.inline(rows))).unionByName(one.select(F.inline(whole))).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (doc_id, canon_sha256, license_id, notices), one for each document.

    ``license_id`` names the known text equal to the whole document, else null; ``notices`` the
    known texts equal to one of its lines, sorted and comma-joined. Null texts count as empty;
    the empty form matches nothing. ``known`` (digest, license_id) may have any length: it is
    broadcast only after a count, and an id listed for two equal texts counts once. Repeated rows
    each have their row, equal ones alike; an empty table gives none.
    """
    known = small(known.where(F.col("digest") != F.sha2(F.lit(""), 256)).select(F.col("digest").alias("known"), "license_id"))
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    part = F.xxhash64("text").alias("part")
    lines = read.select("doc_id", part, F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("line <> ''")
    hits = lines.join(known, F.sha2(canonical(F.col("line")), 256) == F.col("known")).groupBy("doc_id", "part").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("found"))
    hits = small(stored(hits)).withColumnsRenamed({"doc_id": "at", "part": "own"})
    whole = read.select("doc_id", part, F.sha2(canonical(F.col("text")), 256).alias("canon_sha256"))
    named = whole.join(known, F.col("canon_sha256") == F.col("known"), "left")
    joined = named.join(hits, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("part") == F.col("own")), "left")
    return joined.select("doc_id", "canon_sha256", "license_id", F.coalesce("found", F.lit("")).alias("notices"))
