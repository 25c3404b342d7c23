"""License scans: ordered signature rules behind a keyword prefilter, on native expressions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.columns import kept_names, quoted, spare

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Of a rule: how sure its detection is, and which detection suppresses those inside it.
IDENTIFIER, NAMED, MENTION = 3, 2, 1
CONFIDENCE = {IDENTIFIER: 1.0, NAMED: 0.9, MENTION: 0.6}
PHRASE_CONFIDENCE = 0.5
#: Rows of one text meet what is known of it in so many places.
SALTS = 64


@dataclass(frozen=True)
class Signature:
    """``pattern`` is matched against the lower-cased words joined by spaces; ``keyword`` must stand in that text."""

    label: str
    priority: int
    keyword: str
    pattern: str


#: Phrases whose every place counts, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License families as (label, name patterns, versions).
_GNU = [("gpl", r"gnu general public licen[sc]e", ("1", "2", "3")), ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e", ("2", "2 1", "3")), ("agpl", r"gnu affero general public licen[sc]e", ("1", "3")), ("gfdl", r"gnu free documentation licen[sc]e", ("1 1", "1 2", "1 3"))]
_VERSIONED = [
    ("apache", r"apache (?:software )?licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mpl", r"mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("epl", r"eclipse public licen[sc]e", ("1 0", "2 0")),
    ("cddl", r"common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("eupl", r"european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("afl", r"academic free licen[sc]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", r"open software licen[sc]e", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("artistic", r"artistic licen[sc]e", ("1 0", "2 0")),
    ("cecill", r"cecill licen[sc]e", ("1 0", "1 1", "2 0", "2 1")),
    ("ofl", r"sil open font licen[sc]e", ("1 0", "1 1")),
    ("lppl", r"latex project public licen[sc]e", ("1 0", "1 1", "1 2", "1 3a", "1 3c")),
    ("zpl", r"zope public licen[sc]e", ("1 1", "2 0", "2 1")),
    ("php", r"php licen[sc]e", ("3 0", "3 01")),
    ("bsl", r"boost software licen[sc]e", ("1 0",)),
    ("odc-by", r"open data commons attribution licen[sc]e", ("1 0",)),
    ("odbl", r"open database licen[sc]e", ("1 0",)),
    ("ms-pl", r"microsoft public licen[sc]e", ("1 0",)),
    ("cpl", r"common public licen[sc]e", ("1 0",)),
    ("ipl", r"ibm public licen[sc]e", ("1 0",)),
]
_NAMED = [
    ("mit", r"mit licen[sc]e"), ("mit", r"(?:x11|expat) licen[sc]e"), ("mit", r"licen[sc]ed under (?:the )?mit"), ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", r"bsd licen[sc]e"), ("bsd", r"redistribution and use in source and binary forms"), ("bsd-2-clause", r"(?:2|two) clause bsd"), ("bsd-3-clause", r"(?:3|three) clause bsd"), ("bsd-4-clause", r"(?:4|four) clause bsd"),
    ("bsd-2-clause", r"(?:simplified|freebsd) (?:bsd )?licen[sc]e"), ("bsd-3-clause", r"(?:new|modified|revised) bsd licen[sc]e"), ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors"),
    ("isc", r"isc licen[sc]e"), ("isc", r"permission to use copy modify and or distribute this software for any purpose"), ("zlib", r"zlib (?:libpng )?licen[sc]e"), ("unlicense", r"(?:the )?unlicen[sc]e"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"), ("wtfpl", r"do what the fuck you want to public licen[sc]e"), ("cc0", r"cc0 1 0 universal"), ("cc0", r"creative commons zero"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"), ("all-rights-reserved", r"all rights reserved"), ("psf", r"python software foundation licen[sc]e"), ("ncsa", r"university of illinois ncsa open source licen[sc]e"),
    ("beerware", r"beer ware licen[sc]e"), ("openssl", r"openssl licen[sc]e"), ("ruby", r"ruby licen[sc]e"), ("postgresql", r"postgresql licen[sc]e"), ("vim", r"vim licen[sc]e"), ("json", r"the software shall be used for good not evil"),
    ("proprietary", r"proprietary and confidential"), ("licensed", r"licen[sc]ed under(?: the)?(?: terms of)?"), ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
]
# Further licenses and clauses, each by a phrase of its own.
#: Grants, notices, conditions and headers as licenses word them, with the variants that are in use.
_CLAUSES = [
    # MIT and its kin
    ("mit", r"deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies"),
    ("mit", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit-advertising", r"except as contained in this notice the names? of (?:\S+ ){1,8}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the (?:copyright holders?|authors?)"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee|is hereby granted without fee)"),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("smlnj", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both the copyright notice and this permission notice and warranty disclaimer"),
    ("icu", r"provided that the above copyright notice s and this permission notice appear in all copies of the software and that both the above copyright notice s and this permission notice appear in supporting documentation"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode )?data files and any associated documentation"),
    ("x11", r"permission is hereby granted free of charge to any person obtaining a copy of this software (?:\S+ ){0,80}?shall not be used in advertising or otherwise to promote the sale"),
    ("ncsa", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e"),
    ("json", r"the software shall be used for good not evil"),
    ("bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("bsl", r"the copyright notices in the software and this entire statement including the above licen[sc]e grant this restriction and the following disclaimer must be included in all copies"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this licen[sc]e text"),
    # BSD
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", r"neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", r"the names? of the authors? (?:may|must) not be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment this product includes software developed by (?:\S+ ){1,20}contributors"),
    ("bsd-disclaimer", r"this software is provided by the (?:copyright holders?|regents|authors?) and contributors as is and any express or implied warranties"),
    ("bsd-disclaimer", r"in no event shall (?:the )?(?:copyright (?:owner|holder)s?|regents|authors?) or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause-clear", r"no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    ("bsd-2-clause-patent", r"each copyright holder and contributor hereby grants to those receiving rights under this licen[sc]e a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("bsd-style", r"use of this source code is governed by a bsd style licen[sc]e that can be found in the licen[sc]e file"),
    ("mit-style", r"use of this source code is governed by an? mit style licen[sc]e that can be found in the licen[sc]e file"),
    ("bsd-1-clause", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following condition is met"),
    ("bsd-protection", r"redistribution and use in source and binary forms with or without modification are permitted subject to the limitations"),
    # Apache
    ("apache-2.0", r"licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at http(?:s)? www apache org licen[sc]es licen[sc]e 2 0"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2.0", r"see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("apache-2.0", r"licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-2.0", r"see the notice file distributed with this work for additional information regarding copyright ownership"),
    ("apache-2.0", r"grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", r"products derived from this software may not be called apache nor may apache appear in their names? without prior written permission"),
    # GNU
    ("gpl", r"this (?:program|software|library|package|file|code) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
    ("gpl-or-later", r"gnu general public licen[sc]e as published by the free software foundation either version [123] of the licen[sc]e or at your option any later version"),
    ("gpl-only", r"gnu general public licen[sc]e (?:version [123] )?(?:only )?as published by the free software foundation version [123] only"),
    ("gpl-2.0", r"under the terms of (?:the )?(?:version 2 of the gnu general public licen[sc]e|the gnu general public licen[sc]e version 2)"),
    ("gpl-3.0", r"under the terms of (?:the )?(?:version 3 of the gnu general public licen[sc]e|the gnu general public licen[sc]e version 3)"),
    ("gpl-notice", r"you should have received a copy of the gnu general public licen[sc]e along with this (?:program|software|library|package|file)"),
    ("gpl-warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e for more details"),
    ("gpl-files", r"this file (?:is part of (?:\S+ ){1,5})?is free software .{0,200}?gnu general public licen[sc]e"),
    ("lgpl", r"under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation"),
    ("lgpl-notice", r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this (?:program|software|library|package)"),
    ("lgpl-or-later", r"gnu (?:lesser|library) general public licen[sc]e as published by the free software foundation either version [23](?: [01])? of the licen[sc]e or at your option any later version"),
    ("agpl", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation"),
    ("agpl-notice", r"you should have received a copy of the gnu affero general public licen[sc]e along with this (?:program|software)"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("gpl-classpath-exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-font-exception", r"as a special exception if you create a document which uses this font .{0,200}?gnu general public licen[sc]e"),
    ("gpl-bison-exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton .{0,200}?licen[sc]e"),
    ("gpl-autoconf-exception", r"as a special exception the free software foundation gives unlimited permission to copy distribute and modify the configure scripts"),
    ("gcc-exception", r"under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
    ("openssl-exception", r"permission to link the code of (?:portions of )?this program with the openssl library"),
    ("fsf-unlimited", r"the free software foundation gives unlimited permission to copy and or distribute it with or without modifications as long as this notice is preserved"),
    ("fsf-all-permissive", r"copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    # file-scoped licenses
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?2 0"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1 the licen[sc]e"),
    ("mpl-tri", r"alternatively the contents of this file may be used under the terms of either the gnu general public licen[sc]e version 2 or later"),
    ("mpl-rights", r"software distributed under the licen[sc]e is distributed on an as is basis without warranty of any kind either express or implied see the licen[sc]e for the specific language governing rights and limitations"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v(?:ersion)? ?)?2 0"),
    ("cddl", r"the contents of this file are subject to the terms of (?:either the gnu general public licen[sc]e .{0,80}?or )?the common development and distribution licen[sc]e"),
    ("cddl", r"you can obtain a copy of the licen[sc]e at usr src opensolaris licen[sc]e or http www opensolaris org os licensing"),
    ("cpl", r"this program and the accompanying materials are made available under the terms of the common public licen[sc]e"),
    ("npl", r"the contents of this file are subject to the netscape public licen[sc]e"),
    ("apsl", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[sc]e"),
    ("sissl", r"the contents of this file are subject to the sun (?:industry )?standards source licen[sc]e"),
    ("osl", r"licen[sc]ed under the open software licen[sc]e version [123] 0"),
    ("afl", r"licen[sc]ed under the academic free licen[sc]e version [123] [012]"),
    ("eupl", r"licen[sc]ed under the eupl (?:version |v )?1 [012]"),
    ("cecill", r"this software is governed by the cecill(?: [abc])? licen[sc]e under french law"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e (?:ms rl )?this licen[sc]e governs use of the accompanying software"),
    ("ms-pl", r"this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e"),
    # public domain and waivers
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("cc0", r"to the extent possible under law (?:the person who associated cc0 with this work|the authors?|(?:\S+ ){1,8})(?:has|have) (?:waived|dedicated) all copyright and related (?:or|and) neighboring rights"),
    ("public-domain", r"this (?:file|code|software|work|program) (?:is|has been|was) (?:hereby )?(?:placed|put|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", r"(?:the )?authors? disclaims? (?:all )?copyrights? to this (?:source )?(?:code|software|file)"),
    ("pddl", r"public domain dedication and licen[sc]e"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed as long as the name is changed"),
    ("wtfpl", r"do what the (?:fuck|f ck|hell) you want to public licen[sc]e"),
    ("beerware", r"(?:the )?beer ?ware licen[sc]e .{0,200}?you can buy me a beer"),
    # creative commons
    ("cc-by", r"this work is licen[sc]ed under (?:a|the) creative commons attribution (?:[1234] 0 )?(?:international|unported|generic) ?licen[sc]e"),
    ("cc-by-sa", r"this work is licen[sc]ed under (?:a|the) creative commons attribution share ?alike"),
    ("cc-by-nc", r"this work is licen[sc]ed under (?:a|the) creative commons attribution non ?commercial"),
    ("cc-by-nd", r"this work is licen[sc]ed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-text", r"text is available under the creative commons attribution share ?alike licen[sc]e"),
    ("cc-content", r"except where otherwise noted (?:the )?content (?:on|of|in) this (?:site|page|wiki|document|work) is licen[sc]ed under"),
    # others
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("libpng", r"permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee"),
    ("artistic", r"(?:you may distribute it|you can redistribute it and or modify it) under the same terms as perl itself .{0,120}?licen[sc]e"),
    ("perl", r"under the terms of either the gnu general public licen[sc]e .{0,120}?or the artistic licen[sc]e"),
    ("ruby", r"you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl) .{0,80}?(?:licen[sc]e|conditions below) .{0,200}?copyright"),
    ("python", r"psf hereby grants licen[sc]ee a nonexclusive royalty free world wide licen[sc]e to reproduce analyze test perform and or display publicly"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit .{0,80}?(?:licen[sc]e|permission|copyright)"),
    ("ssleay", r"this product includes cryptographic software written by eric young .{0,200}?copyright"),
    ("ofl", r"this font software is licen[sc]ed under the sil open font licen[sc]e version 1 [01]"),
    ("ofl", r"permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell"),
    ("bitstream-vera", r"permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this licen[sc]e"),
    ("w3c", r"permission to copy modify and distribute this (?:software and its documentation|work) with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("ijg", r"permission is hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee subject to these conditions"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code for the .{0,60}?software .{0,400}?copyright"),
    ("odbl", r"this .{0,40}?is made available under the open database licen[sc]e"),
    ("sspl", r"under the terms of the server side public licen[sc]e version 1"),
    ("elastic", r"licen[sc]ed under the elastic licen[sc]e (?:version )?2 0 you may not use this file except in compliance"),
    ("busl", r"use of this software is governed by the business source licen[sc]e"),
    ("commons-clause", r"the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell the software"),
    ("proprietary", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited proprietary and confidential"),
    ("proprietary", r"this (?:software|document|file) (?:contains|is) (?:the )?(?:confidential and )?proprietary .{0,60}?confidential"),
    ("all-rights-reserved", r"copyright (?:c )?(?:\d{4} )+(?:\S+ ){1,8}all rights reserved"),
    ("oracle", r"oracle proprietary confidential use is subject to licen[sc]e terms"),
    ("contributor-agreement", r"(?:by submitting|by contributing) .{0,80}?you agree that your contributions? (?:will be|is|are) licen[sc]ed under"),
    ("dual", r"(?:is|are) dual licen[sc]ed under (?:the )?(?:terms of )?(?:both )?(?:the )?(?:mit|bsd|apache|gpl|lgpl|mpl)"),
    ("choice", r"licen[sc]ed under either of (?:the )?apache licen[sc]e version 2 0 .{0,120}?or mit licen[sc]e .{0,80}?at your option"),
]
_FURTHER = [
    ("aal", r"attribution assurance licen[sc]e"), ("abstyles", r"abstyles licen[sc]e"), ("adsl", r"amazon digital services licen[sc]e"), ("afmparse", r"afmparse licen[sc]e"),
    ("aladdin", r"aladdin free public licen[sc]e"), ("amdplpa", r"amd s? ?plpa map c licen[sc]e"), ("apl", r"adaptive public licen[sc]e"),
    ("apsl", r"apple public source licen[sc]e"), ("app-s2p", r"app s2p licen[sc]e"), ("arphic", r"arphic public licen[sc]e"), ("bahyph", r"bahyph licen[sc]e"),
    ("barr", r"barr licen[sc]e"), ("bittorrent", r"bittorrent open source licen[sc]e"), ("blessing", r"may you do good and not evil"), ("blueoak", r"blue oak model licen[sc]e"),
    ("borceux", r"borceux licen[sc]e"), ("bzip2", r"bzip2 and libbzip2 licen[sc]e"), ("caldera", r"caldera licen[sc]e"), ("catosl", r"computer associates trusted open source licen[sc]e"),
    ("cdla-permissive", r"community data licen[sc]e agreement permissive"), ("cdla-sharing", r"community data licen[sc]e agreement sharing"), ("cern-ohl", r"cern open hardware licen[sc]e"), ("clartistic", r"clarified artistic licen[sc]e"),
    ("condor", r"condor public licen[sc]e"), ("cpal", r"common public attribution licen[sc]e"), ("cpol", r"code project open licen[sc]e"), ("crossword", r"crossword licen[sc]e"),
    ("crystalstacker", r"crystalstacker licen[sc]e"), ("cua-opl", r"cua office public licen[sc]e"), ("cube", r"cube licen[sc]e"), ("curl", r"curl licen[sc]e"),
    ("d-fsl", r"german free software licen[sc]e"), ("diffmark", r"diffmark licen[sc]e"), ("doc", r"doc software licen[sc]e"), ("dotseqn", r"dotseqn licen[sc]e"),
    ("dsdp", r"dsdp licen[sc]e"), ("ecl", r"educational community licen[sc]e"), ("efl", r"eiffel forum licen[sc]e"), ("egenix", r"egenix com public licen[sc]e"),
    ("elastic", r"elastic licen[sc]e"), ("entessa", r"entessa public licen[sc]e"), ("epics", r"epics open licen[sc]e"), ("erlpl", r"erlang public licen[sc]e"),
    ("eudatagrid", r"eu datagrid software licen[sc]e"), ("eurosym", r"eurosym licen[sc]e"), ("fair", r"fair licen[sc]e"), 
    ("frameworx", r"frameworx open licen[sc]e"), ("freeimage", r"freeimage public licen[sc]e"), ("ftl", r"freetype project licen[sc]e"), ("giftware", r"giftware licen[sc]e"),
    ("gl2ps", r"gl2ps licen[sc]e"), ("glide", r"3dfx glide licen[sc]e"), ("glulxe", r"glulxe licen[sc]e"), ("gnuplot", r"gnuplot licen[sc]e"),
    ("gsoap", r"gsoap public licen[sc]e"), ("haskellreport", r"haskell language report licen[sc]e"), ("hippocratic", r"hippocratic licen[sc]e"), ("hpnd", r"historical permission notice and disclaimer"),
    ("icu", r"icu licen[sc]e"), ("ijg", r"independent jpeg group licen[sc]e"), ("imagemagick", r"imagemagick licen[sc]e"),
    ("imlib2", r"imlib2 licen[sc]e"), ("info-zip", r"info zip licen[sc]e"), ("intel", r"intel open source licen[sc]e"),
    ("interbase", r"interbase public licen[sc]e"), ("ipa", r"ipa font licen[sc]e"), ("jasper", r"jasper licen[sc]e"), ("jpnic", r"japan network information center licen[sc]e"),
    ("lal", r"(?:licen[sc]e art libre|free art licen[sc]e)"), ("leptonica", r"leptonica licen[sc]e"), ("libpng", r"(?:libpng licen[sc]e|png reference library licen[sc]e)"), ("libtiff", r"libtiff licen[sc]e"),
    ("liliq-p", r"licen[sc]e libre du qu.bec permissive"), ("linux-openib", r"linux kernel variant of openib org licen[sc]e"), ("lpl", r"lucent public licen[sc]e"), ("makeindex", r"makeindex licen[sc]e"),
    ("miros", r"miros licen[sc]e"), ("motosoto", r"motosoto licen[sc]e"), ("mpich2", r"mpich2 licen[sc]e"), ("ms-rl", r"microsoft reciprocal licen[sc]e"),
    ("ms-rsl", r"microsoft reference source licen[sc]e"), ("mtll", r"matrix template library licen[sc]e"), ("mulanpsl", r"mulan permissive software licen[sc]e"), ("multics", r"multics licen[sc]e"),
    ("naist", r"nara institute of science and technology licen[sc]e"), ("nasa", r"nasa open source licen[sc]e"), ("naumen", r"naumen public licen[sc]e"), ("nbpl", r"net boolean public licen[sc]e"),
    ("netcdf", r"netcdf licen[sc]e"), ("newsletr", r"newsletr licen[sc]e"), ("ngpl", r"nethack general public licen[sc]e"), ("nlod", r"norwegian licen[sc]e for open government data"),
    ("nokia", r"nokia open source licen[sc]e"), ("nosl", r"netizen open source licen[sc]e"), ("noweb", r"noweb licen[sc]e"), ("npl", r"netscape public licen[sc]e"),
    ("nposl", r"non profit open software licen[sc]e"), ("ntp", r"ntp licen[sc]e"), ("nvidia", r"nvidia software licen[sc]e"), ("oclc", r"oclc research public licen[sc]e"),
    ("ogc", r"ogc software licen[sc]e"), ("ogl-uk", r"open government licen[sc]e"), ("ogtsl", r"open group test suite licen[sc]e"), ("oldap", r"(?:open ldap public licen[sc]e|openldap public licen[sc]e)"),
    ("openpub", r"open publication licen[sc]e"), ("opl", r"open public licen[sc]e"), ("oset", r"oset public licen[sc]e"), ("parity", r"parity public licen[sc]e"),
    ("pddl", r"public domain dedication and licen[sc]e"), ("plexus", r"plexus classworlds licen[sc]e"), ("polyform-nc", r"polyform noncommercial licen[sc]e"), ("polyform-sb", r"polyform small business licen[sc]e"),
    ("qhull", r"qhull licen[sc]e"), ("qpl", r"q public licen[sc]e"), ("rdisc", r"rdisc licen[sc]e"), ("rhecos", r"red hat ecos public licen[sc]e"),
    ("rpl", r"reciprocal public licen[sc]e"), ("rpsl", r"realnetworks public source licen[sc]e"), ("rsa-md", r"rsa message digest licen[sc]e"), ("rscpl", r"ricoh source code public licen[sc]e"),
    ("saxpath", r"saxpath licen[sc]e"), ("scea", r"scea shared source licen[sc]e"), ("sendmail", r"sendmail licen[sc]e"), ("sgi-b", r"sgi free software licen[sc]e b"),
    ("simpl", r"simple public licen[sc]e"), ("sissl", r"sun industry standards source licen[sc]e"), ("sleepycat", r"sleepycat licen[sc]e"), ("smlnj", r"standard ml of new jersey licen[sc]e"),
    ("snia", r"snia public licen[sc]e"), ("spencer", r"(?:henry spencer licen[sc]e|spencer licen[sc]e)"), ("spl", r"sun public licen[sc]e"), ("sspl", r"server side public licen[sc]e"),
    ("sugarcrm", r"sugarcrm public licen[sc]e"), ("swl", r"scheme widget library licen[sc]e"), ("tapr-ohl", r"tapr open hardware licen[sc]e"), ("tcl", r"(?:tcl tk licen[sc]e|tcl licen[sc]e)"),
    ("tmate", r"tmate open source licen[sc]e"), ("torque", r"torque software licen[sc]e"), ("tosl", r"trusster open source licen[sc]e"), ("unicode", r"unicode licen[sc]e agreement"),
    ("upl", r"universal permissive licen[sc]e"), ("vostrom", r"vostrom public licen[sc]e"), ("vsl", r"vovida software licen[sc]e"), ("w3c", r"w3c software (?:notice and )?licen[sc]e"),
    ("watcom", r"sybase open watcom public licen[sc]e"), ("wsuipa", r"wsuipa licen[sc]e"), ("xerox", r"xerox licen[sc]e"), ("xfree86", r"xfree86 licen[sc]e"),
    ("xinetd", r"xinetd licen[sc]e"), ("xnet", r"x net licen[sc]e"), ("xpp", r"indiana university extreme lab software licen[sc]e"), ("ypl", r"yahoo public licen[sc]e"),
    ("zed", r"zed licen[sc]e"), ("zend", r"zend licen[sc]e"), ("zimbra", r"zimbra public licen[sc]e"),
    ("gpl-exception-linking", r"special exception .{0,80}? ?permission to link"), ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"), ("apache-2.0", r"you may not use this file except in compliance with the licen[sc]e"), ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[sc]e"), ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"), ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("ofl", r"this font software is licen[sc]ed under the sil open font licen[sc]e"), ("bsd", r"this list of conditions and the following disclaimer .{0,40}? ?redistributions in binary form"), ("non-commercial", r"(?:licen[sc]ed )?for non ?commercial use only .{0,20}? ?licen[sc]e"),
]
_SPDX = "mit isc zlib unlicense wtfpl ncsa 0bsd bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause cc0-1.0 bsl-1.0 apache-1.0 apache-1.1 apache-2.0 mpl-1.0 mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cddl-1.1 artistic-1.0 artistic-2.0 ofl-1.1 afl-3.0 osl-3.0 eupl-1.1 eupl-1.2 ms-pl ms-rl psf-2.0 postgresql python-2.0 ruby x11 odbl-1.0 odc-by-1.0 pddl-1.0 upl-1.0 vim w3c zpl-2.1 openssl php-3.01".split()


def _words_of(label: str) -> str:
    return label.replace("-", " ").replace(".", " ")


def _label(name: str, version: str) -> str:
    return f"{name}-{version.replace(' ', '.')}" + (".0" if " " not in version else "")


def signatures() -> list[Signature]:
    """All rules, in order: of equal detections the earlier rule's stands."""
    out = []
    for name, pattern, versions in _GNU:
        for v in versions:
            v_pattern = v + ("(?: 0)?" if " " not in v else "")
            for words in (rf"{pattern} (?:as published by the free software foundation )?(?:either )?(?:version |v )?{v_pattern}", rf"version {v_pattern} of the {pattern}", rf"{name} ?v?{v_pattern}"):
                keyword = "gnu" if "gnu" in words else name
                out.append(Signature(f"{_label(name, v)}-or-later", IDENTIFIER, keyword, rf"{words} (?:of the licen[sc]e )?(?:or (?:at your option )?any later version|or (?:later|newer)|plus)"))
                out.append(Signature(f"{_label(name, v)}-only", IDENTIFIER, keyword, rf"{words} only"))
                out.append(Signature(_label(name, v), NAMED, keyword, words))
            for tail, ending in (("only", "-only"), ("or later", "-or-later"), ("", "")):
                out.append(Signature(_label(name, v) + ending, IDENTIFIER, "spdx", f"spdx licen[sc]e identifier {name} {v_pattern} {tail}".rstrip()))
        out.append(Signature(name, MENTION, "gnu", pattern))
    for name, pattern, versions in _VERSIONED:
        for v in versions:
            out.append(Signature(_label(name, v), NAMED, "licen", rf"{pattern} (?:version |v )?{v}"))
            out.append(Signature(_label(name, v), NAMED, "licen", rf"version {v} of the {pattern}"))
        out.append(Signature(name, MENTION, "licen", pattern))
    for parts, v in product(("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")):
        out.append(Signature(_label(f"cc-{parts.replace(' ', '-')}", v), IDENTIFIER, "cc by", rf"cc {parts} {v}"))
    for parts, words in (("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative|ativ)e?s"), ("by-nc", "attribution non ?commercial"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative|ativ)e?s"), ("by", "attribution")):
        out.append(Signature(f"cc-{parts}", NAMED, "creative commons", rf"creative commons {words}"))
        out.append(Signature(f"cc-{parts}", NAMED, "cc by", rf"cc {parts.replace('-', ' ')}"))
    out += [Signature(x, IDENTIFIER, "spdx", f"spdx licen[sc]e identifier {_words_of(x)}") for x in _SPDX]
    out += [Signature(label, NAMED if label not in ("licensed", "copyright", "all-rights-reserved") else MENTION, _keyword(pattern), pattern) for label, pattern in _NAMED]
    out += [Signature(label, NAMED, _keyword(pattern), pattern) for label, pattern in [*_CLAUSES, *_FURTHER]]
    return out


def _keyword(pattern: str) -> str:
    for word in ("licen", "permission", "redistribution", "clause bsd", "contributors", "cc0", "creative commons", "public domain", "rights reserved", "confidential", "copyright", "not evil", "gnu", "gpl", "apache"):
        if word in pattern.replace("licen[sc]", "licen"):
            return word
    raise ValueError(pattern)


#: What a text must hold, whatever its case and between its words, for any rule or phrase to match.
GATE = ("licen", "gnu", "apache", "spdx", "gpl", "gfdl", "permission", "redistribution", "bsd", "contributors", "cc0", "creative", "domain", "reserved", "confidential", "copyright", "evil")
GATE_PAIR = r"cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == part)
        return out

    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def needed_literal(pattern: str) -> str:
    """The longest run of letters, digits and spaces that every match has: outside groups and classes, and not optional."""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        plain = depth == 0 and (c.isalnum() or c == " ") and pattern[i + 1 : i + 2] not in ("?", "*", "{")
        run = run + c if plain else ""
        runs.append(run)
        if c == "|" and depth == 0:
            return ""
        if c == "[":
            i = pattern.index("]", i)
        elif c == "\\":
            i += 1
        depth += (c == "(") - (c == ")")
        i += 1
    return max(runs, key=len, default="")


def _gate(rule: Signature) -> str:
    literal = needed_literal(rule.pattern)
    if len(literal) < 4:
        return f" {rule.keyword}" if rule.keyword[0] != "l" else rule.keyword
    return f" {literal}" if rule.pattern.startswith(literal) else literal


def _rule_table(rules: list[Signature]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(_gate(r)).alias("keyword"), F.lit(rf"(?<= ){r.pattern}(?= )").alias("pattern")) for i, r in enumerate(rules)])


def detections(texts: DataFrame, rules: list[Signature]) -> DataFrame:
    """``(key, label, priority, start, end)`` of ``(key, joined)``: what stands after suppression, as places in ``joined``.

    A detection inside another of equal or higher priority goes; of equal ones, the later rule's. Patterns run
    where the texts are read; only the lengths of what they found go over the network, once for equal keys
    of a task.
    """
    gated = texts.select("key", "joined", F.explode(F.filter(_rule_table(rules), lambda r: F.contains("joined", r["keyword"]))).alias("r")).select("key", "joined", "r.*")
    sizes = lambda c: F.transform(c, F.length)
    hits = gated.withColumn("hits", sizes(F.expr("regexp_extract_all(joined, pattern, 0)"))).where(F.size("hits") > 0)
    found = hits.select("key", "rule", "label", "priority", sizes(F.expr("split(joined, pattern, -1)")).alias("gaps"), "hits")
    once = found.groupBy("key", "rule").agg(*[F.first(c).alias(c) for c in ("label", "priority", "gaps", "hits")])
    each = once.select("key", "rule", "label", "priority", F.posexplode(F.arrays_zip("gaps", "hits"))).where(F.col("col.hits").isNotNull())
    each = each.select("key", "rule", "label", "priority", "pos", F.col("col.gaps").alias("gap"), F.col("col.hits").alias("hit"))
    upto = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("key", "rule").orderBy("pos"))
    each = each.withColumn("end", upto).withColumn("start", F.col("end") - F.col("hit"))
    before = Window.partitionBy("key").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = {p: F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before) for p in CONFIDENCE}
    each = each.withColumns({f"reach_{p}": c for p, c in reach.items()})
    inside = F.lit(False)
    for p in CONFIDENCE:
        inside = F.when(F.col("priority") == p, F.coalesce(F.col(f"reach_{p}") >= F.col("end"), F.lit(False))).otherwise(inside)
    return each.where(~inside).select("key", "label", "priority", "start", "end")


RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def license_scan(docs: DataFrame, text_col: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """``docs`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score``; equal names are replaced.

    Words are runs of ASCII letters, digits and non-ASCII text with A-Z lower-cased; a null text is empty.
    Places of PHRASES give ``n_base``, the first and last word index (null without places) and ``base_labels``
    (sorted array); ``labels`` adds those of the signature rules that are left after suppression; ``score`` is
    the confidence of the surest of them, 0 without labels. Rows are judged by their texts alone: repeated rows
    and null ids get what their text gets. All other columns stay, whatever their names.
    """
    rules = signatures() if rules is None else rules
    names = kept_names(docs, RESULTS)
    words_, joined_, key_, places_, found_, score_, salt_ = spare(docs, "words", "joined", "key", "places", "found", "score", "salt")
    text = F.coalesce(quoted([text_col])[0].cast("string"), F.lit(""))
    lower = F.lower(text)
    gate = lower.rlike(GATE_PAIR)
    for part in GATE:
        gate = F.contains(lower, F.lit(part)) | gate
    ascii_lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.when(gate, F.filter(F.split(ascii_lower, NOT_WORD), lambda w: w != ""))
    rows = docs.select(*quoted(names), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), words.alias(words_))
    places = F.when(F.col(words_).isNotNull(), _let(F.col(words_), lambda w: F.array(*[_places(w, p) for p in PHRASES])))
    rows = rows.withColumns({places_: places, joined_: F.when(F.col(words_).isNotNull(), F.concat(F.lit(" "), F.concat_ws(" ", words_), F.lit(" ")))}).drop(words_)
    # A row that the gate stops has a key of its own, so that such rows don't meet in one task of the join.
    rows = rows.withColumn(key_, F.coalesce(F.sha2(joined_, 256), F.concat(F.lit("-"), F.monotonically_increasing_id())))
    texts = rows.where(F.col(joined_).isNotNull()).select(F.col(key_).alias("key"), F.col(joined_).alias("joined"))
    of_text = detections(texts, rules).groupBy(F.col("key").alias(key_)).agg(F.collect_set("label").alias(found_), F.max(_confidence()).alias(score_))

    every = F.flatten(places_)
    own = F.array_compact(F.array(*[F.when(F.size(F.get(places_, F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    # Rows of one text are as many as its copies: what is known of it stands once for each salt, and they are dealt over these.
    of_text = of_text.withColumn(salt_, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.drop(joined_).withColumn(salt_, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(of_text, [key_, salt_], "left")
    none = F.array().cast("array<string>")
    return out.select(
        *quoted(names),
        "n_words",
        F.size(F.coalesce(every, F.array().cast("array<int>"))).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.coalesce(F.sort_array(own), none).alias("base_labels"),
        F.sort_array(F.array_union(F.coalesce(own, none), F.coalesce(found_, none))).alias("labels"),
        F.greatest(F.coalesce(score_, F.lit(0.0)), F.when(F.size(F.coalesce(own, none)) > 0, PHRASE_CONFIDENCE).otherwise(0.0)).alias("score"),
    )


def _confidence() -> Column:
    out = F.lit(0.0)
    for p, c in CONFIDENCE.items():
        out = F.when(F.col("priority") == p, c).otherwise(out)
    return out
