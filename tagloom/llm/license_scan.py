r"""License scans by ordered signature rules, in DataFrame functions only.

Words are runs of ASCII letters (lowered), digits and non-ASCII characters.  A document without any of the rules' keywords, as a
whole word, is passed over.  In the others, every place of a keyword gives a context: the words around it, with ``@`` before the
keyword.  Rules with that keyword, hand-written regular expressions over such contexts, are matched there; a match is an interval of
words with the rule's priority and label.  A context reaches further than any rule can (LEFT words before the keyword, RIGHT from it
on: the tests count the words of the longest rule), so it cuts no match.  An interval inside another one of the same or a higher
priority is suppressed; of equal ones the first label stays.  Suppression is a running maximum over the intervals of a document in
order of their starts.

Three base phrases are counted at all their places, apart from the rules.  ``labels`` joins their labels with those of the
unsuppressed rules; ``score`` is the share of words that these cover, at most 1.

Edge cases: null or empty texts have no words, no labels and score 0; repeated documents (same doc_id and text) each keep their row;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Base phrases: words and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Rules: label, priority (3 a grant or tag, 2 a license with its version or terms, 1 a mention), and an expression over words
#: with @ before its keyword. "license" stands for "licence", too.
RULES = r"""
apache-2 3 @spdx license identifier apache 2 0
apache-1.1 3 @spdx license identifier apache 1 [01]
mit 3 @spdx license identifier mit
mit-0 3 @spdx license identifier mit 0
bsd-2 3 @spdx license identifier bsd 2 clause(?: patent| views)?
bsd-3 3 @spdx license identifier bsd 3 clause(?: clear| lbnl)?
bsd-4 3 @spdx license identifier bsd 4 clause(?: uc)?
bsd-0 3 @spdx license identifier 0bsd
gpl-1 3 @spdx license identifier gpl 1 0(?: only| or later)?
gpl-2 3 @spdx license identifier gpl 2 0(?: only| or later)?
gpl-2-classpath 3 @spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
gpl-3 3 @spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2 3 @spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 3 @spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 3 @spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3 3 @spdx license identifier agpl 3 0(?: only| or later)?
gfdl 3 @spdx license identifier gfdl 1 [123](?: only| or later)?
mpl-1.1 3 @spdx license identifier mpl 1 [01]
mpl-2 3 @spdx license identifier mpl 2 0(?: no copyleft exception)?
epl-1 3 @spdx license identifier epl 1 0
epl-2 3 @spdx license identifier epl 2 0
cddl 3 @spdx license identifier cddl 1 [01]
eupl 3 @spdx license identifier eupl 1 [012]
isc 3 @spdx license identifier isc
zlib 3 @spdx license identifier zlib
boost 3 @spdx license identifier bsl 1 0
unlicense 3 @spdx license identifier unlicense
artistic-1 3 @spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-2 3 @spdx license identifier artistic 2 0
ofl 3 @spdx license identifier ofl 1 [01]
wtfpl 3 @spdx license identifier wtfpl
cc0 3 @spdx license identifier cc0 1 0
cc-by 3 @spdx license identifier cc by [1-4] [05]
cc-by-sa 3 @spdx license identifier cc by sa [1-4] [05]
cc-by-nc 3 @spdx license identifier cc by nc [1-4] [05]
cc-by-nd 3 @spdx license identifier cc by nd [1-4] [05]
cc-by-nc-sa 3 @spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd 3 @spdx license identifier cc by nc nd [1-4] [05]
odbl 3 @spdx license identifier odbl 1 0
upl 3 @spdx license identifier upl 1 0
ms-pl 3 @spdx license identifier ms pl
psf 3 @spdx license identifier (?:psf|python) 2 0
postgresql 3 @spdx license identifier postgresql
ncsa 3 @spdx license identifier ncsa
apache-2 3 licensed under the @apache license(?: version)? 2 0(?: the license)?
apache-2 3 (?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?@apache(?: software)?(?: license)?(?: version| v)? 2 0(?: license)?
apache-2 3 subject to the (?:terms of the )?@apache license version 2 0
apache-2 2 @apache(?: software)? license(?: version| v)? 2(?: 0)?
apache-2 2 @apache(?: software)? license v2(?: 0)?
apache-2 2 @apache 2(?: 0)?(?: licensed| license)?
apache-2 2 @apache2(?: 0)?(?: licensed| license)?
apache-2 2 @asl 2 0
apache-1.1 2 @apache(?: software)? license(?: version| v)? 1 [01]
apache 1 @apache(?: software foundation| software)? license
apache-2 3 you may obtain a copy of the license at https? www @apache org licenses license 2 0
mit 3 (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit(?: x11| expat)? @license
mit 2 under the mit @license
mit 1 mit(?: x11| expat| style)? @license
mit 1 (?:expat|x11) @license
mit-0 2 mit no attribution @license
mit 3 permission is @hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
mit 2 the above @copyright notice and this permission notice shall be included in all copies(?: or substantial portions of the software)?
mit 2 opensource org @licenses mit
bsd-2 3 (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:simplified|2 clause|two clause) @bsd(?: license)?
bsd-3 3 (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:new|modified|revised|3 clause|three clause) @bsd(?: license)?
bsd 3 (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:a )?@bsd(?: style)?(?: license)?
bsd-2 2 @bsd 2 clause(?: license)?
bsd-2 2 (?:simplified|freebsd|2 clause|two clause) @bsd license
bsd-3 2 @bsd 3 clause(?: license)?
bsd-3 2 (?:new|modified|revised|3 clause|three clause) @bsd license
bsd-4 2 @bsd 4 clause(?: license)?
bsd-4 2 (?:original|old|4 clause|four clause) @bsd license
bsd-4 2 all @advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd 1 @bsd(?: style| like)? license
bsd 2 @redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd 2 @redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?
bsd 2 @redistributions in binary form must reproduce the above copyright notice(?: this list of conditions and the following disclaimer)?
bsd-3 2 neither the name of (?:[^ ]+ ){1,8}nor the names of (?:its|the) contributors may be used to @endorse or promote products
gpl-3 3 @gnu general public license as published by the free software foundation (?:either )?version 3(?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
gpl-2 3 @gnu general public license as published by the free software foundation (?:either )?version 2(?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
gpl-1 3 @gnu general public license as published by the free software foundation (?:either )?version 1(?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
gpl 3 under the terms of the @gnu general public license(?: as published by the free software foundation)?
gpl-3 2 @gnu general public license(?: gpl)?(?: version| v)? 3(?: 0)?(?: only| or later)?
gpl-2 2 @gnu general public license(?: gpl)?(?: version| v)? 2(?: 0)?(?: only| or later)?
gpl-3 2 @gnu general public license(?: gpl)? v3(?: 0)?(?: only| or later)?
gpl-2 2 @gnu general public license(?: gpl)? v2(?: 0)?(?: only| or later)?
gpl 1 @gnu general public license
gpl 1 general public @license
gpl-3 2 (?:gnu )?@gpl(?: version| v)? 3(?: 0)?(?: only| or later| or any later version)?
gpl-2 2 (?:gnu )?@gpl(?: version| v)? 2(?: 0)?(?: only| or later| or any later version)?
gpl-3 2 (?:gnu )?@gpl v3(?: 0)?(?: only| or later| or any later version)?
gpl-2 2 (?:gnu )?@gpl v2(?: 0)?(?: only| or later| or any later version)?
gpl-3 2 (?:gnu )?@gplv3(?: 0)?(?: only| or later| or any later version| licensed)?
gpl-2 2 (?:gnu )?@gplv2(?: 0)?(?: only| or later| or any later version| licensed)?
gpl-3 2 @gpl3(?: 0)?(?: only| or later)?
gpl-2 2 @gpl2(?: 0)?(?: only| or later)?
gpl 1 (?:gnu )?@gpl(?: licensed| license| compatible)?
gpl 1 gnu @copyleft
gpl 3 (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?@gpl
gpl-2-classpath 2 gpl(?: version| v)?(?: 2| v2)? with (?:the )?@classpath exception
gpl 2 you should have received a copy of the @gnu general public license(?: along with this program)?
gpl 1 this program is free software you can @redistribute it and or modify it
gpl 1 either version [123] of the @license or at your option any later version
gpl-2 2 free software foundation inc 5[19] (?:franklin street|temple place) (?:[^ ]+ ){0,4}@boston
lgpl-3 3 @gnu lesser general public license as published by the free software foundation (?:either )?version 3(?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl-2.1 3 @gnu lesser general public license as published by the free software foundation (?:either )?version 2 1(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl-2 3 @gnu library general public license as published by the free software foundation (?:either )?version 2(?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl-3 2 @gnu lesser general public license(?: lgpl)?(?: version| v)? 3(?: 0)?(?: only| or later)?
lgpl-2.1 2 @gnu lesser general public license(?: lgpl)?(?: version| v)? 2 1(?: only| or later)?
lgpl-2 2 @gnu library general public license(?: lgpl)?(?: version| v)? 2(?: 0)?(?: only| or later)?
lgpl 1 @gnu (?:lesser|library) general public license
lgpl-3 2 @lgpl(?: version| v)? 3(?: 0)?(?: only| or later)?
lgpl-2.1 2 @lgpl(?: version| v)? 2 1(?: only| or later)?
lgpl-3 2 @lgplv3(?: 0)?(?: only| or later)?
lgpl-2.1 2 @lgplv2 1(?: only| or later)?
lgpl-3 2 @lgpl3(?: 0)?
lgpl 1 @lgpl(?: license| licensed)?
lgpl 1 @lgplv2
lgpl 3 (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?@lgpl
agpl-3 3 @gnu affero general public license as published by the free software foundation (?:either )?version 3(?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
agpl-3 2 @gnu affero general public license(?: agpl)?(?: version| v)? 3(?: 0)?(?: only| or later)?
agpl 1 @gnu affero general public license
agpl-3 2 @agpl(?: version| v)? 3(?: 0)?(?: only| or later)?
agpl-3 2 @agplv3(?: 0)?(?: only| or later)?
agpl-3 2 @agpl3
agpl 1 @agpl(?: license| licensed)?
sspl 2 server side public @license(?: version 1)?
sspl 1 @sspl(?: 1 0| v1)?
gfdl 3 (?:copy distribute and or modify this document )?under the terms of the @gnu free documentation license(?: version 1 [123])?(?: or any later version)?
gfdl 2 @gnu free documentation license(?: version)? 1 [123]
gfdl 1 @gnu free documentation license
gfdl 1 @gfdl(?: 1 [123])?
mpl-2 3 this source code form is subject to the terms of the @mozilla public license(?: v| version)?(?: 2 0)?
mpl-2 3 (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?@mozilla public license(?: v| version)? 2 0
mpl-1.1 3 the contents of this file are subject to the @mozilla public license version 1 [01]
mpl-2 2 @mozilla public license(?: mpl)?(?: version| v)? 2(?: 0)?
mpl-1.1 2 @mozilla public license(?: mpl)?(?: version| v)? 1 [01]
mpl-2 2 @mozilla public license(?: mpl)? v2(?: 0)?
mpl 1 @mozilla public license
mpl-2 2 @mpl(?: version| v)? 2(?: 0)?
mpl-1.1 2 @mpl(?: version| v)? 1 [01]
mpl-2 2 @mplv2(?: 0)?
mpl-2 2 if a copy of the @mpl was not distributed with this file you can obtain one at
epl-2 3 made available under the terms of the @eclipse public license(?: version| v)? 2 0
epl-1 3 made available under the terms of the @eclipse public license(?: version| v)? 1 0
epl-2 2 @eclipse public license(?: version| v)? 2(?: 0)?
epl-1 2 @eclipse public license(?: version| v)? 1(?: 0)?
epl-2 2 @eclipse public license v2(?: 0)?
epl 1 @eclipse public license
epl-2 2 @epl 2 0
epl-1 2 @epl 1 0
edl 1 eclipse distribution license(?: v)? 1 0 @bsd
cddl 2 common development and distribution @license(?: cddl)?(?: version)?(?: 1 [01])?
cddl 1 @cddl(?: 1 [01])?
cpl 1 common public @license(?: version)?(?: 1 0)?
cpal 1 common public attribution @license(?: version)?(?: 1 0)?
ibm-pl 1 ibm public @license(?: version)?(?: 1 0)?
eupl 2 european union public @license(?: eupl)?(?: v| version)?(?: 1 [012])?
eupl 1 @eupl(?: v)?(?: 1 [012])?
cecill 2 @cecill(?: free software)? license(?: agreement)?(?: version)?(?: 2 [01])?
cecill 1 @cecill(?: [bc])?
isc 3 permission to use copy modify and or distribute this software for any purpose with or without fee is @hereby granted
isc 3 (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?isc @license
isc 1 isc @license
zlib 3 (?:licensed|released|distributed) under (?:the )?(?:terms of (?:the )?)?@zlib(?: libpng)? license
zlib 1 @zlib(?: libpng)? license
zlib 2 altered source versions must be plainly marked as such and must not be @misrepresented
libpng 1 @libpng license(?: version 2)?
boost 3 distributed under the @boost software license(?: version 1 0)?
boost 2 @boost software license(?: version)? 1 0
boost 1 @boost software license
unlicense 2 this is free and @unencumbered software released into the public domain
unlicense 1 (?:the )?@unlicense
artistic-2 2 @artistic license(?: version| v)? 2(?: 0)?
artistic-1 2 @artistic license(?: version| v)? 1(?: 0)?
artistic 1 (?:clarified )?@artistic license
perl 2 under the same terms as @perl(?: itself)?
ruby 1 ruby @license
php 2 php @license(?: version)? 3 0(?: 1)?
php 1 php @license
psf 2 python software foundation @license(?: version)?(?: 2(?: 0)?)?
psf 1 @psf license
w3c 2 @w3c software(?: notice)?(?: and)?(?: document)?(?: notice and)? license
openssl 1 (?:dual )?@openssl(?: ssleay)? license
curl 1 curl @license
postgresql 1 @postgresql license
ncsa 1 (?:university of illinois )?@ncsa open source license
ms-pl 2 microsoft public @license(?: ms pl)?
ms-rl 2 microsoft reciprocal @license(?: ms rl)?
upl 2 universal permissive @license(?: upl)?(?: version| v)?(?: 1 0)?
afl 2 academic free @license(?: afl)?(?: version| v)?(?: [123] [01])?
osl 2 open software @license(?: osl)?(?: version| v)?(?: [123] [01])?
nasa 2 @nasa open source agreement(?: 1 3)?
ecl 2 educational community @license(?: version)?(?: [12] 0)?
sleepycat 1 @sleepycat(?: public)? license
beerware 2 the @beer ware license(?: revision 42)?
beerware 1 @beerware(?: license)?
wtfpl 2 do what the fuck you want to public @license(?: version 2)?
wtfpl 1 @wtfpl(?: version 2| v2)?
ofl 3 this font software is @licensed under the sil open font license(?: version 1 1)?
ofl 2 sil open font @license(?: ofl)?(?: version| v)?(?: 1 1)?
ofl 1 open font @license
cc0 3 (?:waived|dedicated) (?:[^ ]+ ){0,8}to the public @domain(?: under)?(?: cc0)?
cc0 2 @cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0 2 @creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?
cc-by-nc-nd 2 @cc by nc nd(?: [1-4] [05])?(?: international| unported)?
cc-by-nc-sa 2 @cc by nc sa(?: [1-4] [05])?(?: international| unported)?
cc-by-nc 2 @cc by nc(?: [1-4] [05])?(?: international| unported)?
cc-by-nd 2 @cc by nd(?: [1-4] [05])?(?: international| unported)?
cc-by-sa 2 @cc by sa(?: [1-4] [05])?(?: international| unported)?
cc-by 2 @cc by(?: [1-4] [05])?(?: international| unported)?
cc-by-nc-nd 2 @creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-nc-sa 2 @creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-nc 2 @creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-nd 2 @creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-sa 2 @creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by 2 @creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc 1 @creative commons(?: license)?
cc-by 2 creativecommons org @licenses by(?: [1-4] [05])?
cc-by-sa 2 creativecommons org @licenses by sa(?: [1-4] [05])?
cc-by-nc 2 creativecommons org @licenses by nc(?: [1-4] [05])?
cc-by-nc-sa 2 creativecommons org @licenses by nc sa(?: [1-4] [05])?
cc0 2 @creativecommons org publicdomain zero(?: 1 0)?
odbl 2 open (?:data commons open )?database @license(?: odbl)?(?: v| version)?(?: 1 0)?
odbl 1 @odbl(?: 1 0)?
odc-by 2 open data commons attribution @license(?: v| version)?(?: 1 0)?
pddl 2 public domain dedication and @license(?: pddl)?
ogl 2 open government @license(?: version| v)?(?: [123] 0)?
ogl 2 contains public sector information @licensed under the open government license
public-domain 3 (?:placed|released|put|dedicated) (?:[^ ]+ ){0,3}(?:in|into|to) the public @domain
public-domain 2 (?:is|are) in the public @domain
public-domain 1 public @domain
proprietary 3 @proprietary and confidential
proprietary 2 unauthori[sz]ed (?:copying|use|distribution|reproduction) (?:[^ ]+ ){0,8}(?:is )?strictly @prohibited
proprietary 1 @proprietary (?:software|license|information)
proprietary 2 no part of this (?:publication|document|work|book|file) may be @reproduced(?: stored| distributed| transmitted| copied)?
proprietary 2 end user @license agreement
proprietary 1 @eula
trade-secret 2 @confidential and proprietary(?: trade secrets?)?
reserved 1 all rights @reserved
reserved 2 copyright (?:c )?(?:[0-9]{4} )(?:[^ ]+ ){1,6}all rights @reserved
reserved 1 tous droits @réservés
reserved 1 alle rechte @vorbehalten
reserved 1 todos los derechos @reservados
reserved 2 some rights @reserved
reserved 2 no rights @reserved
copyright 1 @copyright (?:c )?[0-9]{4}(?: [0-9]{4})?
copyright 2 @copyright (?:c )?[0-9]{4}(?: [0-9]{4})? (?:by )?the [^ ]+(?: [^ ]+)? (?:authors|contributors|project|foundation)
copyright 1 @copyright c
copyright 2 see the @copyright notice
no-warranty 2 without @warranty of any kind(?: express or implied)?
no-warranty 2 without even the implied @warranty of merchantability(?: or fitness for a particular purpose)?
no-warranty 1 without (?:any )?(?:express or implied )?@warranty
no-warranty 2 without @warranties or conditions of any kind(?: either express or implied)?
no-warranty 1 comes with absolutely no @warranty
as-is 2 the software is @provided as is(?: without warranty of any kind)?
as-is 2 provided by the (?:[^ ]+ ){1,6}as is and any express or implied @warranties
as-is 1 distributed on an as is @basis
no-liability 2 in no event shall (?:[^ ]+ ){1,12}be @liable
no-liability 1 not be held @liable
patent 2 @patent license(?: to make)?
non-commercial 2 for non @commercial (?:use|purposes|research)(?: only)?
non-commercial 2 for @noncommercial (?:use|purposes|research)(?: only)?
non-commercial 1 not for @commercial use
research-only 2 for @research (?:use|purposes) only
research-only 2 for @educational (?:use|purposes) only
dual 2 dual @licensed under(?: the)?
see-file 2 see (?:the )?(?:accompanying )?(?:file )?@license(?: txt| md)?(?: file)? for (?:details|more information|the full license(?: text)?)
see-file 1 see (?:the )?@copying(?: file| lesser)?
contributor 1 contributor @license agreement
notice 2 this notice may not be removed or @altered(?: from any source distribution)?
"""

#: Words that a context holds before the keyword, and from it on: more than any rule takes.
LEFT, RIGHT = 26, 32


def rules() -> list[tuple[str, int, str, str]]:
    """keyword, priority, label, expression over contexts."""
    out = []
    for line in RULES.strip().split("\n"):
        label, priority, rule = line.split(" ", 2)
        keyword = rule.split("@")[1].split(" ")[0].split("(")[0]
        out.append((keyword, int(priority), label, f"(?:^| ){rule}(?: |$)"))
    return out


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_WORD_OR_UPPER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _either(words: list[str]) -> str:
    """An expression for one of the words, by their first letters."""
    by: dict[str, list[str]] = {}
    for w in sorted(words):
        by.setdefault(w[:1], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest, reverse=True))})" for c, rest in by.items()) + ")"


def scan(docs: DataFrame) -> DataFrame:
    """The digest of every document: see the module's text."""
    rule_list = rules()
    keywords = sorted({k for k, *_ in rule_list})
    heads = {p.split(" ")[0] for p, _ in BASE}
    spelled = {*keywords, *(k.replace("license", "licence") for k in keywords)}
    # A text with a base phrase has its rarest word: cc and license are keywords, and so is reserved.
    gate = _either(sorted(spelled))
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), _NOT_WORD_OR_UPPER, " ")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.trim(norm).alias("norm"))
    blanks = F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit("")))
    n_words = F.when(F.col("norm") == "", 0).otherwise(blanks + 1).cast("long")
    gated = F.col("norm").rlike(f"(?i)(?:^| ){gate}(?: |$)")
    rows = rows.select("doc_id", "h", n_words.alias("n_words"), F.when(gated, F.col("norm")).alias("norm"))
    kept = rows.withColumn("w", F.when(F.col("norm").isNotNull(), F.split(F.translate("norm", _UPPER, _LOW), " "))).drop("norm")
    # The words of gated documents only, and the places of keywords and of base phrases' first words in them.
    some = ", ".join(f"'{k}'" for k in sorted(spelled | heads))
    kept = kept.withColumn("at", F.expr(f"filter(sequence(0, size(w) - 1), i -> w[i] IN ({some}))"))
    places = []
    for phrase, _ in BASE:
        test = " AND ".join(f"get(w, i + {k}) = '{x}'" for k, x in enumerate(phrase.split(" ")))
        places.append(F.expr(f"filter(at, i -> {test})"))
    kept = kept.select("*", *(F.when(F.col("w").isNotNull(), p).alias(f"b{k}") for k, p in enumerate(places)))
    every = F.concat(*(F.coalesce(f"b{k}", F.expr("array()").cast("array<int>")) for k in range(len(BASE))))
    label = F.array_compact(F.array(*(F.when(F.size(f"b{k}") > 0, F.lit(x)) for k, (_, x) in enumerate(BASE))))
    kept = kept.select("doc_id", "h", "n_words", "w", "at", every.alias("places"), label.alias("base"))
    kept = kept.select("doc_id", "h", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), "base", "w", "at")
    kept = materialize(kept, "licenses")
    spark = docs.sparkSession
    # The rules are a parameter of a fixed size.
    table_ = F.broadcast(spark.createDataFrame(rule_list, "kw string, priority int, label string, rule string"))
    where = kept.where("w IS NOT NULL").select("doc_id", "h", "w", F.explode("at").alias("i"))
    context = F.expr(f"concat(array_join(slice(w, greatest(i - {LEFT}, 0) + 1, least(i, {LEFT})), ' '), ' @', array_join(slice(w, i + 1, {RIGHT}), ' '))")
    where = where.select("doc_id", "h", "i", F.replace(F.expr("w[i]"), F.lit("licence"), F.lit("license")).alias("kw"), F.replace(context, F.lit("licence"), F.lit("license")).alias("context"))
    found = where.join(table_, "kw").where(F.expr("context rlike rule"))
    match = F.trim(F.expr("regexp_extract(context, rule, 0)"))
    found = found.select("doc_id", "h", "i", "priority", "label", F.substring_index(match, "@", 1).alias("before"), F.substring_index(match, "@", -1).alias("rest"))
    spaces = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit("")))
    found = found.select("doc_id", "h", "priority", "label", (F.col("i") - spaces("before")).alias("start"), (F.col("i") + spaces("rest") + 1).alias("stop")).distinct()
    w = Window.partitionBy("doc_id", "h").orderBy("start", F.desc("stop"), F.desc("priority"), "label").rowsBetween(Window.unboundedPreceding, -1)
    tops = found.select("*", *(F.max(F.when(F.col("priority") >= p, F.col("stop"))).over(w).alias(f"top{p}") for p in (1, 2, 3)))
    top = F.coalesce(F.when(F.col("priority") == 1, F.col("top1")).when(F.col("priority") == 2, F.col("top2")).otherwise(F.col("top3")), F.lit(-1))
    stay = tops.where(top < F.col("stop"))
    by = stay.groupBy("doc_id", "h").agg(F.collect_set("label").alias("more"), F.sum(F.col("stop") - F.col("start")).alias("covered"))
    by = by.withColumnsRenamed({"doc_id": "d", "h": "g"})
    out = kept.drop("w", "at").join(by, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    none = F.expr("array()").cast("array<string>")
    score = F.when(F.col("n_words") > 0, F.least(F.coalesce("covered", F.lit(0)), F.col("n_words")).cast("double") / F.col("n_words")).otherwise(F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"), score.alias("score")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join("('{}', {}, '{}', '{}')".format(*(str(x).replace("'", "''") for x in r)) for r in rules())
    base = " UNION ALL ".join(f"SELECT r, i, '{label}' AS label FROM k WHERE " + " AND ".join(f"w[i + {n + 1}] = '{x}'" for n, x in enumerate(phrase.split(" "))) for phrase, label in BASE)
    return rf"""
WITH rules(kw, priority, label, rule) AS (VALUES {values}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '{_NOT_WORD}'), lambda x: x <> '') AS w FROM documents),
k AS MATERIALIZED (SELECT r, w, unnest(range(0, len(w))) AS i FROM d),
b AS ({base}),
bb AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list(DISTINCT label)) AS l FROM b GROUP BY r),
c AS (SELECT r, i, replace(w[i + 1], 'licence', 'license') AS kw, replace(array_to_string(list_slice(w, greatest(i - {LEFT}, 0) + 1, i), ' ') || ' @' || array_to_string(list_slice(w, i + 1, i + {RIGHT}), ' '), 'licence', 'license') AS context FROM k WHERE replace(w[i + 1], 'licence', 'license') IN (SELECT kw FROM rules)),
m AS (SELECT r, i, priority, label, trim(regexp_extract(context, rule, 0)) AS m FROM c JOIN rules USING (kw) WHERE regexp_matches(context, rule)),
f AS (SELECT DISTINCT r, priority, label, i - len(split_part(m, '@', 1)) + len(replace(split_part(m, '@', 1), ' ', '')) AS a, i + 1 + len(split_part(m, '@', 2)) - len(replace(split_part(m, '@', 2), ' ', '')) AS z FROM m),
s AS (SELECT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.r = x.r AND y.a <= x.a AND y.z >= x.z AND y.priority >= x.priority AND (y.a < x.a OR y.z > x.z OR y.priority > x.priority OR y.label < x.label))),
ss AS (SELECT r, list(DISTINCT label) AS l, sum(z - a) AS covered FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(array_to_string(bb.l, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(bb.l, ss.l))), ','), '') AS labels,
  CASE WHEN len(w) > 0 THEN CAST(least(coalesce(covered, 0), len(w)) AS DOUBLE) / len(w) ELSE 0.0 END AS score
FROM d LEFT JOIN bb USING (r) LEFT JOIN ss USING (r)"""


ORACLE_SQL = {"op5_license_scan": _sql()}
