"""Licence scans by canonical digest, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digest tables of at most this many rows are broadcast; beyond it, Spark joins by shuffle.
BROADCAST_LICENSES = 10_000

#: Spellings that licence texts use alike; each is the beginning of a word, or whole words where it ends with a space.
SPELLINGS = {
    "licence": "license",
    "sublicence": "sublicense",
    "sub license": "sublicense",
    "acknowledgement": "acknowledgment",
    "non commercial": "noncommercial",
    "merchantibility": "merchantability",
    "favour": "favor",
    "honour": "honor",
    "organisation": "organization",
    "authorisation": "authorization",
    "analogue": "analog",
    "fulfilment": "fulfillment",
    "judgement": "judgment",
    "per cent ": "percent ",
    "copyright owner": "copyright holder",
    "https": "http",
}

MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
)
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
BSD_BINARY = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n"
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n"
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies.\n\n"
ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
    "and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that "
    "you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may "
    "not be removed or altered from any source distribution."
)
#: Known licences, whole texts and the notices that stand for them.
KNOWN = {
    "MIT": "MIT License\n\nCopyright (c) 2020 Holder\n\n" + MIT_GRANT + MIT_NOTICE + MIT_WARRANTY,
    "MIT (untitled)": MIT_GRANT + MIT_NOTICE + MIT_WARRANTY,
    "MIT-0": "MIT No Attribution\n\nCopyright (c) 2020 Holder\n\n" + MIT_GRANT.replace(", subject to the following conditions:", ".") + MIT_WARRANTY,
    "BSD-2-Clause": BSD_HEAD + BSD_SOURCE + BSD_BINARY + BSD_WARRANTY,
    "BSD-3-Clause": BSD_HEAD + BSD_SOURCE + BSD_BINARY + BSD_NAMES + BSD_WARRANTY,
    "ISC": "ISC License\n\nCopyright (c) 2020 Holder\n\n" + ISC_GRANT + ISC_NOTICE + ISC_WARRANTY,
    "ISC (untitled)": ISC_GRANT + ISC_NOTICE + ISC_WARRANTY,
    "0BSD": ISC_GRANT + ".\n\n" + ISC_WARRANTY,
    "Zlib": ZLIB,
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "MIT (notice)": "Released under the MIT License.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
}


#: Digests of the canonical() whole texts of longer licences, also as far as the end of their terms.
DIGESTS = {
    "Apache-2.0": "84ed161685d232dab5187a7a7101279668d583e8fcead2d41433e4fd4a1dbe68",
    "Apache-2.0 (terms)": "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
    "GFDL-1.3": "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-1.0 (terms)": "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-2.0 (terms)": "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "GPL-3.0 (terms)": "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.0 (terms)": "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-2.1 (terms)": "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61",
    "MPL-2.0": "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56",
}


def canonical(text: Column) -> Column:
    """A text in lower case without copyright lines, punctuation and repeated white space, in one spelling of each word."""
    t = F.lower(text)
    notice = r"(?m)^[^\p{L}\p{N}\n]*(?:(?:copyright|©)[^\n]*\d{4}|\(c\)[^\n]*|©[^\n]*|copyright\s*(?:\(c\)|©)[^\n]*|all rights reserved)[^\n]*$"
    any_of = t.contains("copyright") | t.contains("©") | t.contains("(c)") | t.contains("all rights reserved")
    t = F.when(any_of, F.regexp_replace(t, notice, " ")).otherwise(t)
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in SPELLINGS.items():
        for _ in range(1 + a.endswith(" ")):  # neighbours share a space
            t = F.replace(t, F.lit(f" {a}"), F.lit(f" {b}"))
    return F.trim(t)


def known_digests(spark, known: Mapping[str, str] = KNOWN, digests: Mapping[str, str] = DIGESTS) -> DataFrame:
    """(digest, license_id) of texts, canonicalised by the same expression as the documents, and of digests. Of licences with one digest, the first by name."""
    texts = spark.createDataFrame(sorted(known.items()), "license_id string, license_text string")
    rows = texts.select("license_id", F.sha2(canonical(F.col("license_text")), 256).alias("digest"))
    rows = rows.unionByName(spark.createDataFrame(sorted(digests.items()), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame, n_known: int) -> DataFrame:
    """Each document with the digest of its entire canonical text and the known licence of that digest, if any.

    Returns row (struct of all columns), digest, license_id. ``known`` is (digest, license_id) of distinct
    digests, n_known its rows: it is broadcast while that count is within BROADCAST_LICENSES.
    Null text: null digest and licence. Empty text, or one of nothing but punctuation: the digest of the
    empty string, which is no licence. Equal texts have equal digests. No rows: no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.sha2(canonical(F.col("text")), 256).alias("digest"))
    few = F.broadcast(known) if n_known <= BROADCAST_LICENSES else known
    return rows.join(few, "digest", "left").select("row", "digest", "license_id")
