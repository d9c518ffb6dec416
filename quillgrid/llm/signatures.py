"""Hand-written license signatures, in words: abbreviations, sentences of license texts and notices, and further licenses.

Fixed values.  Each row holds a label, the keywords of which any match holds one, a pattern, a priority and a score.
"""

from __future__ import annotations

#: Abbreviated names with their versions, as they stand in manifests and prose.
ABBREVIATIONS = [
    ("gpl-1.0", "gpl gplv1 gpl1", r"(?:gpl v1|gpl version 1|gplv1|gpl1|gpl 1 0)(?: only| or later)?", 55, 0.8),
    ("gpl-2.0", "gpl gplv2 gpl2", r"(?:gpl v2|gpl version 2|gplv2|gpl2|gpl 2 0|gpl 2)(?: only| or later)?", 55, 0.8),
    ("gpl-3.0", "gpl gplv3 gpl3", r"(?:gpl v3|gpl version 3|gplv3|gpl3|gpl 3 0|gpl 3)(?: only| or later)?", 55, 0.8),
    ("lgpl-2.0", "lgpl lgplv2 lgpl2", r"(?:lgpl v2|lgpl version 2|lgplv2|lgpl2|lgpl 2 0)(?! 1)(?: only| or later)?", 55, 0.8),
    ("lgpl-2.1", "lgpl lgplv2 lgpl2", r"(?:lgpl v2 1|lgpl version 2 1|lgplv2 1|lgpl2 1|lgpl 2 1)(?: only| or later)?", 56, 0.8),
    ("lgpl-3.0", "lgpl lgplv3 lgpl3", r"(?:lgpl v3|lgpl version 3|lgplv3|lgpl3|lgpl 3 0|lgpl 3)(?: only| or later)?", 55, 0.8),
    ("agpl-1.0", "agpl agplv1", r"(?:agpl v1|agplv1|agpl 1 0)(?: only| or later)?", 55, 0.8),
    ("agpl-3.0", "agpl agplv3 agpl3", r"(?:agpl v3|agpl version 3|agplv3|agpl3|agpl 3 0|agpl 3)(?: only| or later)?", 55, 0.8),
    ("gfdl-1.2", "gfdl fdl", r"(?:gfdl|gnu fdl) (?:v|version )?1 2", 55, 0.8),
    ("gfdl-1.3", "gfdl fdl", r"(?:gfdl|gnu fdl) (?:v|version )?1 3", 55, 0.8),
    ("gpl", "gpl gpled", r"(?:gpl licen[cs]ed?|under the gpl|under gpl|gpled)", 40, 0.7),
    ("lgpl", "lgpl", r"(?:lgpl licen[cs]ed?|under the lgpl|under lgpl)", 41, 0.7),
    ("agpl", "agpl", r"(?:agpl licen[cs]ed?|under the agpl|under agpl)", 41, 0.7),
    ("apache-2.0", "apache apache2 apachev2 asl", r"(?:apache v2|apache2|apachev2|apache 2|asl 2)(?: 0)?(?: licen[cs]ed?)?", 55, 0.8),
    ("apache-1.1", "apache asl", r"(?:apache v1 1|apache 1 1|asl 1 1)", 55, 0.8),
    ("mit", "mit", r"mit licen[cs]ed", 45, 0.75),
    ("mit", "mit", r"mit (?:style|type|like) licen[cs]e", 44, 0.7),
    ("mit", "x11 mit", r"(?:mit x11|x11 mit|x11) licen[cs]e", 46, 0.75),
    ("mit-0", "mit", r"(?:mit no attribution|mit 0)(?: licen[cs]e)?", 72, 0.85),
    ("bsd-2-clause", "bsd bsd2", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|bsd2)(?: licen[cs]e)?", 56, 0.8),
    ("bsd-3-clause", "bsd bsd3", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|bsd3)(?: licen[cs]e)?", 56, 0.8),
    ("bsd-4-clause", "bsd bsd4", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|bsd4)(?: licen[cs]e)?", 56, 0.8),
    ("0bsd", "0bsd", r"0bsd(?: licen[cs]e)?", 56, 0.85),
    ("bsd", "bsd", r"(?:bsd licen[cs]ed|under bsd|under the bsd)", 31, 0.65),
    ("isc", "isc", r"isc licen[cs]ed?", 50, 0.8),
    ("mpl-1.1", "mpl mplv1", r"(?:mpl v1 1|mplv1 1|mpl 1 1)", 55, 0.8),
    ("mpl-2.0", "mpl mplv2 mpl2", r"(?:mpl v2|mplv2|mpl2|mpl 2)(?: 0)?", 55, 0.8),
    ("epl-1.0", "epl eplv1", r"(?:epl v1|eplv1|epl 1)(?: 0)?", 55, 0.8),
    ("epl-2.0", "epl eplv2", r"(?:epl v2|eplv2|epl 2)(?: 0)?", 55, 0.8),
    ("cddl-1.0", "cddl", r"cddl(?: v?1 0)?", 50, 0.7),
    ("cddl-1.1", "cddl", r"cddl v?1 1", 55, 0.8),
    ("eupl-1.1", "eupl", r"eupl v?1 1", 55, 0.8),
    ("eupl-1.2", "eupl", r"eupl v?1 2", 55, 0.8),
    ("cecill-2.1", "cecill", r"cecill(?: free software licen[cs]e agreement)?(?: version)? v?2 1", 56, 0.8),
    ("cecill-b", "cecill", r"cecill b", 56, 0.8),
    ("cecill-c", "cecill", r"cecill c", 56, 0.8),
    ("cecill", "cecill", r"cecill", 40, 0.7),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl v?1 1", 55, 0.8),
    ("zpl-2.1", "zpl", r"zpl v?2 1", 55, 0.8),
    ("osl-3.0", "osl", r"osl v?3(?: 0)?", 50, 0.7),
    ("cc-by-4.0", "cc", r"cc by 4 0(?: international)?", 57, 0.85),
    ("cc-by-3.0", "cc", r"cc by 3 0(?: unported)?", 57, 0.85),
    ("cc-by-2.0", "cc", r"cc by 2 [05]", 57, 0.8),
    ("cc-by-sa-4.0", "cc", r"cc by sa 4 0(?: international)?", 58, 0.85),
    ("cc-by-sa-3.0", "cc", r"cc by sa 3 0(?: unported)?", 58, 0.85),
    ("cc-by-sa-2.0", "cc", r"cc by sa 2 [05]", 58, 0.8),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4 0(?: international)?", 58, 0.85),
    ("cc-by-nc-3.0", "cc", r"cc by nc 3 0(?: unported)?", 58, 0.85),
    ("cc-by-nd-4.0", "cc", r"cc by nd 4 0(?: international)?", 58, 0.85),
    ("cc-by-nc-sa-4.0", "cc", r"cc by nc sa 4 0(?: international)?", 59, 0.85),
    ("cc-by-nc-sa-3.0", "cc", r"cc by nc sa 3 0(?: unported)?", 59, 0.85),
    ("cc-by-nc-nd-4.0", "cc", r"cc by nc nd 4 0(?: international)?", 59, 0.85),
    ("cc-by-nc-nd-3.0", "cc", r"cc by nc nd 3 0(?: unported)?", 59, 0.85),
    ("cc-by", "cc", r"cc by(?: licen[cs]e)?", 40, 0.6),
    ("cc-by-sa", "cc", r"cc by sa(?: licen[cs]e)?", 41, 0.65),
    ("cc-by-nc", "cc", r"cc by nc(?: licen[cs]e)?", 41, 0.65),
    ("cc-by-nd", "cc", r"cc by nd(?: licen[cs]e)?", 41, 0.65),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: licen[cs]e)?", 42, 0.65),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: licen[cs]e)?", 42, 0.65),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?", 45, 0.8),
    ("wtfpl", "wtfpl", r"wtfpl", 45, 0.8),
]

#: Sentences of license texts, of the notices that they prescribe, and addresses.
SENTENCES = [
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software", 95, 0.95),
    ("mit", "liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 94, 0.85),
    ("mit", "mit", r"opensource org licenses? mit(?: license)?(?: php| html)?", 85, 0.95),
    ("mit-0", "restriction", r"permission is hereby granted free of charge to any person obtaining a copy of this software .{1,80}? to deal in the software without restriction .{1,160}? to whom the software is furnished to do so the software is provided", 101, 0.9),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used", 95, 0.95),
    ("mit-old-style", "royalty", r"permission is hereby granted without written agreement and without licen[cs]e or royalty fees", 95, 0.85),
    ("hpnd", "fee", r"permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose (?:and without fee is hereby granted|is hereby granted without fee)", 95, 0.9),
    ("postgresql", "agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 97, 1.0),
    ("0bsd", "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 101, 0.95),
    ("isc", "author", r"the software is provided as is and the author disclaims all warranties with regard to this software", 92, 0.85),
    ("isc", "isc", r"the software is provided as is and isc disclaims all warranties", 93, 0.95),
    ("curl", "fee", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 96, 0.9),
    ("bsd", "contributors", r"this software is provided by the (?:copyright holders?|author|regents) and contributors as is and any express or implied warranties", 90, 0.9),
    ("bsd-2-clause", "author", r"this software is provided by the author as is and any express or implied warranties", 89, 0.8),
    ("bsd", "exemplary", r"be liable for any direct indirect incidental special exemplary or consequential damages", 60, 0.6),
    ("bsd", "procurement", r"procurement of substitute goods or services loss of use data or profits", 59, 0.6),
    ("bsd-3-clause", "endorse", r"the names? of (?:the author|its contributors|its author) may (?:not )?be used to endorse or promote products derived from this software", 92, 0.9),
    ("bsd-4-clause", "california", r"this product includes software developed by the university of california", 96, 0.95),
    ("bsd-source-code", "retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 88, 0.85),
    ("bsd", "reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", 88, 0.85),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license", 98, 0.95),
    ("bsd-2-clause-patent", "receiving", r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights", 98, 0.95),
    ("apache-2.0", "agreed", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 96, 0.9),
    ("apache-2.0", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements", 96, 0.95),
    ("apache-2.0", "asf", r"the asf licenses this file to you under the apache license version 2 0", 97, 1.0),
    ("apache-2.0", "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 96, 0.95),
    ("apache-2.0", "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license", 96, 0.95),
    ("apache-2.0", "reproduction", r"terms and conditions for use reproduction and distribution", 70, 0.75),
    ("apache-2.0", "derivative", r"you may reproduce and distribute copies of the work or derivative works thereof in any medium", 94, 0.9),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 80, 0.75),
    ("apache-1.0", "apache", r"this product includes software developed by the apache group", 92, 0.9),
    ("apache-1.1", "apache", r"products derived from this software may not be called apache nor may apache appear in their name", 96, 0.95),
    ("gpl", "hope", r"this (?:program|library|software|file|package) is distributed in the hope that it will be useful but without any warranty", 60, 0.8),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose", 58, 0.7),
    ("gpl-2.0", "option", r"either version 2 of the license or at your option any later version", 66, 0.85),
    ("gpl-3.0", "option", r"either version 3 of the license or at your option any later version", 66, 0.85),
    ("lgpl-2.1", "option", r"either version 2 1 of the license or at your option any later version", 67, 0.85),
    ("gpl-2.0", "version", r"under the terms of version 2 of the gnu general public license", 92, 0.95),
    ("gpl-3.0", "version", r"under the terms of version 3 of the gnu general public license", 92, 0.95),
    ("gpl", "foundation", r"write to the free software foundation inc", 50, 0.7),
    ("gpl", "gnu", r"see the gnu general public license for more details", 55, 0.75),
    ("lgpl", "gnu", r"see the gnu lesser general public license for more details", 56, 0.8),
    ("lgpl-2.0", "gnu", r"see the gnu library general public license for more details", 56, 0.8),
    ("agpl-3.0", "affero", r"see the gnu affero general public license for more details", 56, 0.85),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 60, 0.8),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 100, 1.0),
    ("gpl-2.0", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it", 98, 0.95),
    ("gpl-3.0", "practical", r"the licenses for most software and other practical works are designed to take away your freedom to share and change the works", 98, 1.0),
    ("agpl-3.0", "affero", r"the gnu affero general public license is a free copyleft license for software and other kinds of works", 101, 1.0),
    ("agpl-3.0", "remotely", r"all users interacting with it remotely through a computer network", 90, 0.85),
    ("lgpl", "library", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 70, 0.9),
    ("lgpl-3.0", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 101, 1.0),
    ("lgpl-2.1", "successor", r"this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license version 2", 101, 1.0),
    ("gfdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 92, 0.95),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", 80, 0.85),
    ("classpath-exception-2.0", "linking", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 96, 0.95),
    ("gcc-exception-3.1", "gcc", r"gcc runtime library exception(?: version 3 1)?", 90, 0.9),
    ("autoconf-exception", "autoconf", r"if you distribute this file as part of a program that contains a configuration script generated by autoconf", 95, 0.95),
    ("bison-exception-2.2", "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 95, 0.95),
    ("font-exception", "font", r"as a special exception if you create a document which uses this font", 95, 0.95),
    ("linux-syscall-note", "syscall", r"linux syscall note", 80, 0.9),
    ("llvm-exception", "llvm", r"(?:apache 2 0 with )?llvm exceptions?", 85, 0.85),
    ("gpl", "gnu", r"www gnu org licenses(?: gpl)?(?: html| txt)?", 45, 0.7),
    ("gpl-2.0", "gnu", r"www gnu org licenses (?:old licenses )?gpl 2 0", 88, 0.95),
    ("gpl-3.0", "gnu", r"www gnu org licenses gpl 3 0", 88, 0.95),
    ("lgpl-2.1", "gnu", r"www gnu org licenses (?:old licenses )?lgpl 2 1", 88, 0.95),
    ("lgpl-3.0", "gnu", r"www gnu org licenses lgpl 3 0", 88, 0.95),
    ("agpl-3.0", "gnu", r"www gnu org licenses agpl 3 0", 88, 0.95),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 97, 0.95),
    ("mpl-2.0", "incompatible", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0", 101, 1.0),
    ("mpl-1.1", "mpl", r"the contents of this file may be used under the terms of either the gpl or the lgpl .{1,80}? under the terms of the mpl", 92, 0.9),
    ("mpl-1.1", "governing", r"see the license for the specific language governing rights and limitations under the license", 60, 0.6),
    ("mpl", "mozilla", r"www mozilla org mpl(?: 2 0| mpl 1 1)?", 70, 0.8),
    ("npl-1.1", "netscape", r"(?:the )?netscape public license(?: version)?(?: v?1 [01])?", 72, 0.85),
    ("epl-1.0", "epl", r"www eclipse org legal epl v10(?: html)?", 95, 1.0),
    ("epl-2.0", "epl", r"www eclipse org legal epl 2 0", 95, 1.0),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 80, 0.85),
    ("cddl-1.0", "cddl distribution", r"the contents of this file are subject to the terms of the common development and distribution license", 92, 0.9),
    ("cpl-1.0", "common", r"made available under the terms of the common public license", 90, 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 98, 1.0),
    ("zlib", "freely", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 98, 1.0),
    ("zlib", "liable", r"in no event will the authors be held liable for any damages arising from the use of this software", 93, 0.85),
    ("bsl-1.0", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 100, 1.0),
    ("bsl-1.0", "boost", r"www boost org license 1 0", 95, 1.0),
    ("artistic-1.0", "package", r"the intent of this document is to state the conditions under which a package may be copied", 97, 0.95),
    ("artistic-2.0", "establishes", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 97, 1.0),
    ("perl", "perl", r"(?:under )?the same terms as (?:the )?perl(?: 5)?(?: programming language)?(?: system)? itself", 88, 0.9),
    ("python-2.0", "psf", r"psf is making python available to licensee on an as is basis", 97, 1.0),
    ("python-2.0", "psf", r"psf licen[cs]e(?: agreement)?", 60, 0.8),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 98, 1.0),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young", 98, 0.95),
    ("openssl", "openssl", r"openssl licen[cs]e", 60, 0.85),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license", 97, 1.0),
    ("ofl-1.1", "fonts", r"the fonts including any derivative works can be bundled embedded redistributed and or sold with any software", 96, 0.95),
    ("cc0-1.0", "extent", r"to the extent possible under law .{1,80}? waived all copyright and related or neighboring rights", 96, 0.95),
    ("cc0-1.0", "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives", 97, 1.0),
    ("cc", "commons", r"creative commons corporation is not a law firm and does not provide legal services", 60, 0.7),
    ("cc", "commons", r"licensed under a creative commons", 50, 0.6),
    ("cc-by-nc-nd-4.0", "creativecommons", r"creativecommons org licenses by nc nd 4 0", 100, 1.0),
    ("cc-by-nc-nd-3.0", "creativecommons", r"creativecommons org licenses by nc nd 3 0", 100, 1.0),
    ("cc-by-nc-sa-3.0", "creativecommons", r"creativecommons org licenses by nc sa 3 0", 100, 1.0),
    ("cc-by-nc-3.0", "creativecommons", r"creativecommons org licenses by nc 3 0", 100, 1.0),
    ("cc-by-nc-nd-4.0", "commons", r"creative commons attribution non ?commercial no ?deriv(?:atives|s)(?: version)? 4 0", 73, 0.95),
    ("cc-by-sa-4.0", "commons", r"creative commons by sa 4 0", 73, 0.9),
    ("unlicense", "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software", 98, 1.0),
    ("unlicense", "unlicense", r"(?:www )?unlicense org", 90, 0.95),
    ("wtfpl", "fuck", r"you just do what the fuck you want to", 97, 1.0),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 97, 1.0),
    ("json", "evil", r"the software shall be used for good not evil", 99, 1.0),
    ("beerware", "beer", r"(?:if we meet some day and you think this stuff is worth it )?you can buy me a beer in return", 97, 0.95),
    ("beerware", "beerware beer", r"(?:beerware|beer ware) licen[cs]e", 70, 0.9),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", 97, 1.0),
    ("ftl", "freetype", r"portions of this software are copyright .{1,40}? the freetype project", 96, 0.95),
    ("ftl", "freetype", r"(?:the )?freetype (?:project )?licen[cs]e", 70, 0.9),
    ("libpng", "png", r"the png reference library is supplied as is", 97, 1.0),
    ("libpng", "libpng", r"libpng licen[cs]e(?: version 2)?", 70, 0.9),
    ("info-zip", "zip", r"info zip licen[cs]e", 70, 0.9),
    ("imagemagick", "imagemagick", r"imagemagick licen[cs]e", 70, 0.9),
    ("icu", "icu", r"icu licen[cs]e", 70, 0.9),
    ("unicode", "unicode", r"unicode (?:inc )?licen[cs]e agreement(?: data files and software)?|unicode licen[cs]e v3", 72, 0.9),
    ("unicode-tou", "unicode", r"unicode terms of use", 70, 0.85),
    ("w3c", "w3c", r"w3c software (?:notice )?and (?:document )?(?:notice and )?licen[cs]e", 72, 0.95),
    ("w3c", "obtaining", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply", 96, 0.95),
    ("sleepycat", "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 97, 0.95),
    ("tcl", "authors", r"the authors hereby grant permission to use copy modify distribute and licen[cs]e this software and its documentation for any purpose", 97, 1.0),
    ("vim", "charityware", r"vim is charityware", 95, 0.95),
    ("ruby", "verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction", 92, 0.85),
    ("php-3.01", "php", r"this product includes php software freely available from", 96, 0.95),
    ("ncsa", "illinois", r"neither the names of .{1,80}? university of illinois .{1,60}? nor the names of its contributors may be used to endorse", 97, 0.95),
    ("mit-cmu", "cmu", r"cmu licen[cs]e|mit cmu", 60, 0.8),
    ("proprietary", "trade confidential proprietary", r"(?:contains|constitutes) (?:confidential|proprietary) (?:and proprietary )?(?:information|trade secrets?)", 55, 0.7),
    ("proprietary", "permission", r"may not be (?:reproduced|copied|distributed|disclosed).{0,60}? without (?:the )?(?:express |prior |written )*permission", 54, 0.7),
    ("public-domain", "waive waives", r"(?:i|we|the authors?) (?:hereby )?waives? (?:all )?copyright", 70, 0.85),
    ("public-domain", "domain", r"public domain (?:dedication|software|work)", 45, 0.6),
    ("unknown-license", "licence license", r"(?:license|licence) (?:information|details|terms) (?:can be found|see|are) in", 15, 0.35),
    ("unknown-license", "dual", r"dual licen[cs]ed", 35, 0.5),
    ("unknown-license", "copying", r"see (?:the )?(?:file )?copying(?: file)?(?: for (?:details|more information))?", 15, 0.4),
]

#: Licenses known by name alone: label, keywords, name.
OTHERS = [
    ("aladdin", "aladdin", r"aladdin free public licen[cs]e"), ("apsl-2.0", "apple", r"apple public source licen[cs]e"), ("adobe-source", "adobe", r"adobe systems (?:incorporated )?open source licen[cs]e"),
    ("blueoak-1.0.0", "oak", r"blue oak model licen[cs]e"), ("cal-1.0", "cryptographic", r"cryptographic autonomy licen[cs]e"), ("catosl", "catosl trusted", r"computer associates trusted open source licen[cs]e|catosl"),
    ("cern-ohl", "cern", r"cern open hardware licen[cs]e"), ("commons-clause", "clause", r"commons clause(?: licen[cs]e condition)?"), ("cockroach", "cockroach cockroachdb", r"cockroach(?:db)? community licen[cs]e"),
    ("confluent", "confluent", r"confluent community licen[cs]e"), ("cdla-permissive", "data", r"community data licen[cs]e agreement permissive"), ("cdla-sharing", "data", r"community data licen[cs]e agreement sharing"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e"), ("efl-2.0", "eiffel", r"eiffel forum licen[cs]e"), ("entessa", "entessa", r"entessa public licen[cs]e"), ("etalab", "etalab", r"etalab open licen[cs]e|licence ouverte etalab"),
    ("eudatagrid", "datagrid", r"eu datagrid software licen[cs]e"), ("fair", "fair", r"fair (?:source )?licen[cs]e"), ("frameworx", "frameworx", r"frameworx open licen[cs]e"), ("fsl-1.1", "functional", r"functional source licen[cs]e"),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e"), ("ibm-pl", "ibm", r"ibm public licen[cs]e"), ("intel", "intel", r"intel open source licen[cs]e"), ("ipa", "ipa", r"ipa font licen[cs]e"),
    ("jam", "jam", r"jam licen[cs]e"), ("lal-1.3", "libre art", r"licence art libre|free art licen[cs]e"), ("liliq", "liliq libre", r"licence libre du qu[^ ]*bec|liliq"), ("llama", "llama", r"llama (?:[0-9]+ )?(?:[0-9]+ )?community licen[cs]e"),
    ("lppl-1.3c", "latex", r"latex project public licen[cs]e"), ("lucent", "lucent", r"lucent public licen[cs]e"), ("miros", "miros", r"miros licen[cs]e"), ("motosoto", "motosoto", r"motosoto licen[cs]e"),
    ("mulan-psl", "mulan", r"mulan permissive software licen[cs]e|mulan psl"), ("multics", "multics", r"multics licen[cs]e"), ("nasa-1.3", "nasa", r"nasa open source agreement"), ("naumen", "naumen", r"naumen public licen[cs]e"),
    ("nethack", "nethack", r"nethack general public licen[cs]e"), ("ngpl", "nethack", r"nethack gpl"), ("nokia", "nokia", r"nokia open source licen[cs]e"), ("nposl-3.0", "profit", r"non profit open software licen[cs]e"),
    ("ntp", "ntp", r"ntp licen[cs]e"), ("oclc", "oclc", r"oclc research public licen[cs]e"), ("odc-by", "commons", r"open data commons attribution licen[cs]e"), ("pddl", "dedication", r"(?:open data commons )?public domain dedication and licen[cs]e"),
    ("ogl", "government", r"open government licen[cs]e(?: v?[123](?: 0)?)?"), ("openldap", "openldap", r"openldap public licen[cs]e"), ("openrail", "rail openrail", r"(?:bigscience |bigcode )?(?:open ?rail(?: m)?|rail) licen[cs]e"),
    ("opl", "publication", r"open publication licen[cs]e"), ("polyform-nc", "polyform", r"polyform noncommercial licen[cs]e"), ("polyform-sb", "polyform", r"polyform small business licen[cs]e"), ("qpl", "q qt", r"(?:q|qt) public licen[cs]e"),
    ("rpl", "reciprocal", r"reciprocal public licen[cs]e"), ("rpsl", "realnetworks", r"realnetworks public source licen[cs]e"), ("ricoh", "ricoh", r"ricoh source code public licen[cs]e"), ("rsal", "redis", r"redis source available licen[cs]e"),
    ("scea", "scea", r"scea shared source licen[cs]e"), ("simpl", "simple", r"simple public licen[cs]e"), ("sissl", "sun", r"sun industry standards source licen[cs]e"), ("spl", "sun", r"sun public licen[cs]e"),
    ("sgi-b", "sgi", r"sgi free software licen[cs]e b"), ("timescale", "timescale", r"timescale licen[cs]e"), ("tmate", "tmate", r"tmate open source licen[cs]e"), ("ucl", "upstream", r"upstream compatibility licen[cs]e"),
    ("vovida", "vovida", r"vovida software licen[cs]e"), ("vsl", "vovida", r"vovida licen[cs]e"), ("watcom", "watcom", r"sybase open watcom public licen[cs]e"), ("wxwindows", "wxwindows wxwidgets", r"(?:wxwindows|wxwidgets) (?:library )?licen[cs]e"),
    ("xnet", "net", r"x net licen[cs]e"), ("yahoo-pl", "yahoo", r"yahoo public licen[cs]e"), ("zend", "zend", r"zend (?:engine )?licen[cs]e"), ("zimbra", "zimbra", r"zimbra public licen[cs]e"), ("zpl", "zope", r"zope public licen[cs]e"),
    ("freebsd-doc", "freebsd", r"freebsd documentation licen[cs]e"), ("ldp", "linux", r"linux documentation project licen[cs]e"), ("anti-996", "996", r"anti 996 licen[cs]e"), ("eula", "eula user", r"end user licen[cs]e agreement|eula"),
]
SIGNATURES = ABBREVIATIONS + SENTENCES + [(label, keywords, rf"(?:the )?(?:{name})", 62, 0.85) for label, keywords, name in OTHERS]
