"""License detection by ordered signature rules, in DataFrame functions only.

A text's words are lower-cased runs of letters, digits and non-ASCII bytes,
joined by single spaces; rules are regular expressions over that, in order of
priority: the SPDX tag of each license of the table, sentences of license texts
and file headers, grants ("under the ..." and a license's name), and bare names.
A text that has none of the GATE words is not searched; in the others a rule runs only if one of its own keywords occurs, and
whatever a pattern matches holds one of its keywords and one of the gate's.  Detections
are word intervals.  One that lies within another, or shares its interval with
one of higher priority, is suppressed.

The base phrases are rules too and always count, suppressed or not.

Everything stays within a row: no shuffle, no Python.  Defined cases: a null or
empty text has no words, no labels ("") and score 0; repeated rows are judged
alike; ties of equal intervals go to the lower priority number, then the label;
an empty table gives an empty result; whole texts are searched, whatever their
length; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from kinspark.llm.urls import BIG, SMALL

#: label: (words of the SPDX tag, name, keywords of the name, apart by "|").  Names match normalised words.
LICENSES: dict[str, tuple[str, str, str]] = {
    "0bsd": ("0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: license)?", "bsd"),
    "afl-3": ("afl 3 0", r"academic free licen[sc]e(?: version| v)? ?3(?: 0)?", "academic"),
    "agpl-3": ("agpl 3 0(?: only| or later)?", r"(?:gnu )?affero general public licen[sc]e(?:,? version| v)? ?3(?: 0)?", "affero"),
    "agpl": ("agpl", r"(?:gnu )?affero general public licen[sc]e", "affero"),
    "apache-1": ("apache 1 [01]", r"apache (?:software )?licen[sc]e(?: version| v)? ?1(?: [01])?", "apache"),
    "apache-2": ("apache 2 0", r"apache (?:software )?licen[sc]e(?: version| v)? ?2(?: 0)?", "apache"),
    "apache": ("apache", r"apache (?:software )?licen[sc]e", "apache"),
    "artistic-1": ("artistic 1 0", r"artistic licen[sc]e(?: version)? 1(?: 0)?", "artistic"),
    "artistic-2": ("artistic 2 0", r"artistic licen[sc]e(?: version)? 2(?: 0)?", "artistic"),
    "beerware": ("beerware", r"beer ?ware licen[sc]e", "beer"),
    "blueoak-1": ("blueoak 1 0 0", r"blue oak model licen[sc]e", "blue oak"),
    "bsd-1": ("bsd 1 clause", r"(?:bsd 1 clause|1 clause bsd|one clause bsd)(?: license)?", "bsd"),
    "bsd-2": ("bsd 2 clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)?", "bsd"),
    "bsd-3": ("bsd 3 clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: license)?", "bsd"),
    "bsd-4": ("bsd 4 clause", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: license)?", "bsd"),
    "bsd": ("bsd", r"bsd (?:style )?licen[sc]e", "bsd"),
    "bsl-1": ("bsl 1 0", r"boost software licen[sc]e(?: version)?(?: 1(?: 0)?)?", "boost"),
    "busl-1": ("busl 1 1", r"business source licen[sc]e(?: version)?(?: 1(?: 1)?)?", "business source"),
    "cc0": ("cc0 1 0", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "cc0|cc zero|creative commons"),
    "cc-by": ("cc by [1-4](?: [05])?", r"(?:cc by(?! (?:nc|sa|nd))|creative commons attribution(?! (?:non ?commercial|share ?alike|no ?deriv)))(?: [1-4] [05])?", "cc by|creative commons"),
    "cc-by-sa": ("cc by sa [1-4](?: [05])?", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", "cc by|creative commons"),
    "cc-by-nd": ("cc by nd [1-4](?: [05])?", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1-4] [05])?", "cc by|creative commons"),
    "cc-by-nc": ("cc by nc [1-4](?: [05])?", r"(?:cc by nc(?! (?:sa|nd))|creative commons attribution non ?commercial(?! (?:share ?alike|no ?deriv)))(?: [1-4] [05])?", "cc by|creative commons"),
    "cc-by-nc-sa": ("cc by nc sa [1-4](?: [05])?", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", "cc by|creative commons"),
    "cc-by-nc-nd": ("cc by nc nd [1-4](?: [05])?", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4] [05])?", "cc by|creative commons"),
    "cddl-1": ("cddl 1 [01]", r"common development and distribution licen[sc]e(?: version)?(?: 1 [01])?", "common development"),
    "cecill-2": ("cecill 2 [01]", r"cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?(?: version)? 2(?: [01])?", "cecill"),
    "cecill": ("cecill", r"cecill(?: [bc])? licen[sc]e", "cecill"),
    "cpl-1": ("cpl 1 0", r"common public licen[sc]e(?: version)?(?: 1 0)?", "common public"),
    "cpal-1": ("cpal 1 0", r"common public attribution licen[sc]e(?: version)?(?: 1 0)?", "common public"),
    "ecl-2": ("ecl 2 0", r"educational community licen[sc]e(?: version)?(?: 2 0)?", "educational community"),
    "elastic-2": ("elastic 2 0", r"elastic licen[sc]e(?: version)?(?: 2(?: 0)?)?", "elastic"),
    "epl-1": ("epl 1 0", r"eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?", "eclipse"),
    "epl-2": ("epl 2 0", r"eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?", "eclipse"),
    "epl": ("epl", r"eclipse public licen[sc]e", "eclipse"),
    "edl-1": ("edl 1 0", r"eclipse distribution licen[sc]e(?: version| v)?(?: 1 0)?", "eclipse"),
    "eupl-1": ("eupl 1 [012]", r"european union public licen[sc]e(?: version| v)?(?: 1 [012])?", "european union"),
    "fsfap": ("fsfap", r"fsf all permissive licen[sc]e", "all permissive"),
    "ftl": ("ftl", r"freetype (?:project )?licen[sc]e", "freetype"),
    "gfdl-1": ("gfdl 1 [123]", r"gnu free documentation licen[sc]e(?: version| v)?(?: 1 [123])?", "free documentation"),
    "gpl-1": ("gpl 1 0(?: only| or later)?", r"(?:gnu )?(?<!lesser )(?<!affero )general public licen[sc]e(?: version| v) ?1(?: 0)?", "general public"),
    "gpl-2": ("gpl 2 0(?: only| or later)?", r"(?:(?:gnu )?(?<!lesser )(?<!affero )(?<!library )general public licen[sc]e(?: version| v) ?2(?: 0)?|gplv2|gpl(?: version| v)? ?2(?: 0)?)", "g"),
    "gpl-3": ("gpl 3 0(?: only| or later)?", r"(?:(?:gnu )?(?<!lesser )(?<!affero )general public licen[sc]e(?: version| v) ?3(?: 0)?|gplv3|gpl(?: version| v)? ?3(?: 0)?)", "g"),
    "gpl": ("gpl", r"(?:gnu gpl|(?:gnu )?(?<!lesser )(?<!affero )(?<!library )general public licen[sc]e)", "g"),
    "hpnd": ("hpnd", r"historical permission notice and disclaimer", "historical permission"),
    "ibm-ipl-1": ("ipl 1 0", r"ibm public licen[sc]e(?: version)?(?: 1 0)?", "ibm"),
    "icu": ("icu", r"icu licen[sc]e", "icu"),
    "ijg": ("ijg", r"independent jpeg group licen[sc]e", "jpeg"),
    "isc": ("isc", r"isc licen[sc]e", "isc"),
    "json": ("json", r"json licen[sc]e", "json"),
    "lgpl-2": ("lgpl 2 [01](?: only| or later)?", r"(?:(?:gnu )?(?:lesser|library) general public licen[sc]e(?: version| v) ?2(?: [01])?|lgpl(?: version| v)? ?2(?: [01])?)", "l"),
    "lgpl-3": ("lgpl 3 0(?: only| or later)?", r"(?:(?:gnu )?lesser general public licen[sc]e(?: version| v) ?3(?: 0)?|lgpl(?: version| v)? ?3(?: 0)?)", "l"),
    "lgpl": ("lgpl", r"(?:gnu lgpl|(?:gnu )?(?:lesser|library) general public licen[sc]e)", "l"),
    "libpng": ("libpng(?: 2 0)?", r"(?:lib)?png reference library licen[sc]e", "png"),
    "llvm-exception": ("llvm exception", r"llvm exceptions?", "llvm"),
    "lppl-1": ("lppl 1 [0-3]c?", r"latex project public licen[sc]e(?: version)?(?: 1 [0-3]c?)?", "latex"),
    "mit": ("mit", r"(?:mit|expat|x11) licen[sc]e", "licen"),
    "mit-0": ("mit 0", r"mit no attribution(?: license)?", "no attribution"),
    "mpl-1": ("mpl 1 [01]", r"mozilla public licen[sc]e(?: version| v)? ?1(?: [01])?", "mozilla"),
    "mpl-2": ("mpl 2 0", r"mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?", "mozilla"),
    "mpl": ("mpl", r"mozilla public licen[sc]e", "mozilla"),
    "ms-pl": ("ms pl", r"microsoft public licen[sc]e", "microsoft"),
    "ms-rl": ("ms rl", r"microsoft reciprocal licen[sc]e", "microsoft"),
    "ncsa": ("ncsa", r"university of illinois(?: ncsa)? open source licen[sc]e", "illinois"),
    "odbl-1": ("odbl 1 0", r"open (?:data commons open )?database licen[sc]e(?: version| v)?(?: 1 0)?", "database"),
    "odc-by-1": ("odc by 1 0", r"open data commons attribution licen[sc]e(?: version| v)?(?: 1 0)?", "open data commons"),
    "pddl-1": ("pddl 1 0", r"(?:open data commons )?public domain dedication and licen[sc]e", "public domain"),
    "ofl-1": ("ofl 1 [01]", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1 [01])?", "open font"),
    "openssl": ("openssl", r"openssl licen[sc]e", "openssl"),
    "osl-3": ("osl 3 0", r"open software licen[sc]e(?: version| v)?(?: 3 0)?", "open software"),
    "php-3": ("php 3 01?", r"php licen[sc]e(?: version)?(?: 3 01?)?", "php"),
    "postgresql": ("postgresql", r"postgresql licen[sc]e", "postgresql"),
    "psf-2": ("psf 2 0", r"(?:python software foundation|psf) licen[sc]e(?: version)?(?: 2)?", "p"),
    "public-domain": ("public domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain"),
    "proprietary": ("licenseref proprietary", r"all rights reserved", "reserved"),
    "qpl-1": ("qpl 1 0", r"q public licen[sc]e", "q public"),
    "ruby": ("ruby", r"ruby licen[sc]e", "ruby"),
    "sissl": ("sissl", r"sun industry standards source licen[sc]e", "sun industry"),
    "sspl-1": ("sspl 1 0", r"server side public licen[sc]e(?: version| v)?(?: 1)?", "server side"),
    "unicode-3": ("unicode(?: dfs 2016| 3 0)?", r"unicode licen[sc]e(?: v3)?", "unicode"),
    "unlicense": ("unlicense", r"(?:the )?unlicen[sc]e", "unlicen"),
    "upl-1": ("upl 1 0", r"universal permissive licen[sc]e(?: version| v)?(?: 1 0)?", "universal permissive"),
    "vim": ("vim", r"vim licen[sc]e", "vim"),
    "w3c": ("w3c", r"w3c software(?: notice and)? licen[sc]e", "w3c"),
    "wtfpl": ("wtfpl", r"(?:wtfpl|do what the fuck you want to public licen[sc]e)", "w"),
    "zlib": ("zlib", r"(?:zlib|zlib libpng) licen[sc]e", "zlib"),
    "zpl-2": ("zpl 2 [01]", r"zope public licen[sc]e(?: version| v)?(?: 2 [01])?", "zope"),
    "aal": ("aal", r"attribution assurance licen[sc]e", "attribution assurance"),
    "abstyles": ("abstyles", r"abstyles licen[sc]e", "abstyles"),
    "adsl": ("adsl", r"amazon digital services licen[sc]e", "amazon"),
    "aladdin": ("aladdin", r"aladdin free public licen[sc]e", "aladdin"),
    "amazon-asl": ("amazon asl", r"amazon software licen[sc]e", "amazon"),
    "apsl-2": ("apsl 2 0", r"apple public source licen[sc]e(?: version)?(?: 2 0)?", "apple"),
    "bittorrent-1": ("bittorrent 1 [01]", r"bittorrent open source licen[sc]e", "bittorrent"),
    "bzip2": ("bzip2 1 0 [56]", r"bzip2(?: and libbzip2)? licen[sc]e", "bzip2"),
    "catosl-1": ("catosl 1 1", r"computer associates trusted open source licen[sc]e", "computer associates"),
    "cdla-permissive": ("cdla permissive [12] 0", r"community data licen[sc]e agreement permissive", "community data"),
    "cdla-sharing": ("cdla sharing 1 0", r"community data licen[sc]e agreement sharing", "community data"),
    "cern-ohl": ("cern ohl [12] [012]", r"cern open hardware licen[sc]e", "cern"),
    "clartistic": ("clartistic", r"clarified artistic licen[sc]e", "artistic"),
    "condor-1": ("condor 1 1", r"condor public licen[sc]e", "condor"),
    "cua-opl-1": ("cua opl 1 0", r"cua office public licen[sc]e", "cua office"),
    "curl": ("curl", r"curl licen[sc]e", "curl"),
    "ecos-2": ("ecos 2 0", r"ecos licen[sc]e(?: version)?(?: 2 0)?", "ecos"),
    "efl-2": ("efl [12] 0", r"eiffel forum licen[sc]e", "eiffel"),
    "entessa": ("entessa", r"entessa public licen[sc]e", "entessa"),
    "etalab-2": ("etalab 2 0", r"etalab open licen[sc]e", "etalab"),
    "eudatagrid": ("eudatagrid", r"eu datagrid software licen[sc]e", "datagrid"),
    "fair": ("fair", r"fair licen[sc]e", " fair "),
    "frameworx-1": ("frameworx 1 0", r"frameworx open licen[sc]e", "frameworx"),
    "giftware": ("giftware", r"giftware licen[sc]e", "giftware"),
    "gnuplot": ("gnuplot", r"gnuplot licen[sc]e", "gnuplot"),
    "imagemagick": ("imagemagick", r"imagemagick licen[sc]e", "imagemagick"),
    "intel": ("intel", r"intel open source licen[sc]e", "intel"),
    "jam": ("jam", r"jam stapl software licen[sc]e", "stapl"),
    "lal-1": ("lal 1 [23]", r"licence art libre", "art libre"),
    "free-art": ("lal 1 3", r"free art licen[sc]e", "free art"),
    "leptonica": ("leptonica", r"leptonica licen[sc]e", "leptonica"),
    "libtiff": ("libtiff", r"libtiff licen[sc]e", "libtiff"),
    "liliq": ("liliq (?:p|r|rplus) 1 1", r"licence libre du qu[eé]bec", "licence libre"),
    "lpl-1": ("lpl 1 0[2]?", r"lucent public licen[sc]e", "lucent"),
    "miros": ("miros", r"miros licen[sc]e", "miros"),
    "motosoto": ("motosoto", r"motosoto licen[sc]e", "motosoto"),
    "mulan-2": ("mulanpsl [12] 0", r"mulan permissive software licen[sc]e", "mulan"),
    "multics": ("multics", r"multics licen[sc]e", "multics"),
    "naist": ("naist 2003", r"nara institute of science and technology licen[sc]e", "nara institute"),
    "nasa-1": ("nasa 1 3", r"nasa open source agreement", "nasa"),
    "naumen": ("naumen", r"naumen public licen[sc]e", "naumen"),
    "netcdf": ("netcdf", r"netcdf licen[sc]e", "netcdf"),
    "ngpl": ("ngpl", r"nethack general public licen[sc]e", "nethack"),
    "nokia": ("nokia", r"nokia open source licen[sc]e", "nokia"),
    "nposl-3": ("nposl 3 0", r"non profit open software licen[sc]e", "non profit"),
    "ntp": ("ntp", r"ntp licen[sc]e", " ntp "),
    "oclc-2": ("oclc 2 0", r"oclc research public licen[sc]e", "oclc"),
    "ogl-uk": ("ogl uk [123] 0", r"open government licen[sc]e", "open government"),
    "ogtsl": ("ogtsl", r"open group test suite licen[sc]e", "open group"),
    "oldap-2": ("oldap 2 [0-8]", r"openldap public licen[sc]e", "openldap"),
    "oset-pl-2": ("oset pl 2 1", r"oset public licen[sc]e", "oset"),
    "polyform-nc": ("polyform noncommercial 1 0 0", r"polyform noncommercial licen[sc]e", "polyform"),
    "polyform-sb": ("polyform small business 1 0 0", r"polyform small business licen[sc]e", "polyform"),
    "rpl-1": ("rpl 1 [15]", r"reciprocal public licen[sc]e", "reciprocal"),
    "rpsl-1": ("rpsl 1 0", r"realnetworks public source licen[sc]e", "realnetworks"),
    "rscpl": ("rscpl", r"ricoh source code public licen[sc]e", "ricoh"),
    "sax-pd": ("sax pd", r"sax public domain notice", "public domain"),
    "sendmail": ("sendmail", r"sendmail licen[sc]e", "sendmail"),
    "sgi-b-2": ("sgi b 2 0", r"sgi free software licen[sc]e b", "free software"),
    "simpl-2": ("simpl 2 0", r"simple public licen[sc]e", "simple public"),
    "sleepycat": ("sleepycat", r"sleepycat licen[sc]e", "sleepycat"),
    "spencer": ("spencer (?:86|94|99)", r"spencer licen[sc]e", "spencer"),
    "spl-1": ("spl 1 0", r"sun public licen[sc]e", "sun public"),
    "tcl": ("tcl", r"tcl tk licen[sc]e", "tcl tk"),
    "ucl-1": ("ucl 1 0", r"upstream compatibility licen[sc]e", "upstream compatibility"),
    "vsl-1": ("vsl 1 0", r"vovida software licen[sc]e", "vovida"),
    "watcom-1": ("watcom 1 0", r"sybase open watcom public licen[sc]e", "watcom"),
    "x11": ("x11", r"x consortium licen[sc]e", "x consortium"),
    "xnet": ("xnet", r"x net licen[sc]e", "x net"),
    "xfree86-1": ("xfree86 1 1", r"xfree86 licen[sc]e", "xfree86"),
    "ypl-1": ("ypl 1 [01]", r"yahoo public licen[sc]e", "yahoo"),
    "zend-2": ("zend 2 0", r"zend(?: engine)? licen[sc]e", "zend"),
    "zimbra-1": ("zimbra 1 [34]", r"zimbra public licen[sc]e", "zimbra"),
}
#: Sentences of license texts and file headers: label, keywords (apart by "|"; every match holds one), pattern.
TEXTS: list[tuple[str, str, str]] = [
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "portions of the software", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "furnished to do so", r"and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("x11", "advertising", r"the name of the copyright holders? shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("icu", "data files", r"permission is hereby granted free of charge to any person obtaining a copy of the data files and any associated documentation"),
    ("unicode-3", "data files", r"to deal in the data files or software without restriction"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2", "source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2", "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", "endorse or promote", r"neither the names? of (?:the |its )?(?:copyright holders?|authors?|organization|university|company) nor the names of (?:its|their|the) contributors may be used to endorse or promote products"),
    ("bsd-3", "endorse or promote", r"the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "merchantability", r"any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "procurement", r"procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd-clear", "patent rights", r"no express or implied licenses to any partys patent rights are granted by this license"),
    ("0bsd", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "with or without fee", r"permission to use copy modify (?:and )?(?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc", "special direct indirect", r"in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use"),
    ("hpnd", "without fee is hereby granted", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", "suitability", r"makes no representations about the suitability of this software for any purpose"),
    ("hpnd", "publicity", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("ntp", "with or without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("ncsa", "deal with the software", r"to deal with the software without restriction including without limitation the rights to use copy modify"),
    ("apache-2", "in compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache", r"licensed under the apache license version 2 0 the license"),
    ("apache-2", "apache org", r"you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "grant of copyright license", r"grant of copyright license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-2", "grant of patent license", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-2", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1", "apache group", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "useful but without any warranty", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2", "foundation either version 2", r"general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-2", "license version 2", r"general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-2", "temple place", r"free software foundation inc 59 temple place suite 330 boston ma"),
    ("gpl-2", "franklin street", r"free software foundation inc 51 franklin street fifth floor boston ma"),
    ("gpl-2", "outside its scope", r"activities other than copying distribution and modification are not covered by this license they are outside its scope"),
    ("gpl-2", "translated into another language", r"a work containing the program or a portion of it either verbatim or with modifications and or translated into another language"),
    ("gpl-3", "foundation either version 3", r"general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-3", "anti circumvention", r"protecting users legal rights from anti circumvention law"),
    ("gpl-3", "convey verbatim", r"you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-3", "covered work", r"no covered work shall be deemed part of an effective technological measure"),
    ("gpl-3", "installation information", r"installation information for a user product means any methods procedures authorization keys or other information"),
    ("lgpl", "lesser general public", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2", "library general public", r"this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl-2", "foundation either version 2 1", r"lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-2", "work that uses the library", r"a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it is called a work that uses the library"),
    ("lgpl-3", "foundation either version 3", r"lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-3", "combined work", r"a combined work is a work produced by combining or linking an application with the library"),
    ("agpl-3", "affero", r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3", "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("agpl-3", "through a computer network", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl-1", "free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl-1", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("classpath-exception", "special exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gcc-exception", "runtime library exception", r"gcc runtime library exception"),
    ("bison-exception", "special exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", "special exception", r"as a special exception the free software foundation gives unlimited permission to copy distribute and modify the configure scripts"),
    ("openssl-exception", "openssl", r"permission to link (?:the code of )?(?:portions of )?this program with the openssl library"),
    ("linux-syscall-note", "system calls", r"this copyright does not cover user programs that use kernel services by normal system calls"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0"),
    ("mpl-2", "secondary licenses", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1", "initial developer", r"the initial developer of the original code is"),
    ("npl-1", "netscape", r"the contents of this file are subject to the netscape public license"),
    ("cddl-1", "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1", "eclipse org", r"which accompanies this distribution and is available at https? www eclipse org legal epl v10"),
    ("epl-2", "eclipse org", r"which (?:accompanies this distribution and )?is available at https? www eclipse org legal epl (?:v20|2 0)"),
    ("epl", "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cpl-1", "common public license", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("edl-1", "distribution license", r"this program and the accompanying materials are made available under the terms of the eclipse distribution license"),
    ("eupl-1", "eupl", r"licensed under the eupl(?: version)?(?: 1 [012])?"),
    ("cecill-2", "cecill", r"this software is governed by the cecill license under french law and abiding by the rules of distribution of free software"),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "png reference library|group 42", r"the contributing authors and group 42 inc assume no liability for direct indirect incidental special exemplary or consequential damages|the png reference library is supplied as is"),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"portions of this software are copyright (?:[0-9]{4} )?the freetype project"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young"),
    ("curl", "except as contained in this notice", r"except as contained in this notice the name of a copyright holder shall not be used in advertising"),
    ("bsl-1", "accompanying documentation covered by this license", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1", "boost org", r"see accompanying file license 1 0 txt or copy at https? www boost org license 1 0 txt"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate any and all copyright", r"dedicate any and all copyright interest in the software to the public domain"),
    ("cc0", "dedicated|waived", r"to the extent possible under law the author has (?:dedicated|waived) all copyright and related (?:and|or) neighboring rights"),
    ("cc0", "this deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("public-domain", "public domain", r"this (?:file|code|software|work|program) is (?:hereby )?in the public domain"),
    ("public-domain", "public domain", r"no copyright is claimed and this (?:file|code|software) is placed in the public domain"),
    ("us-government", "copyright protection in the united states", r"this work was prepared by an officer or employee of the united states government and is not subject to copyright protection in the united states"),
    ("us-government", "title 17", r"pursuant to title 17 section 105 of the united states code this software is not subject to copyright protection"),
    ("wtfpl", "what the fuck", r"you just do what the fuck you want to"),
    ("beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("cc-by", "appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pd-mark", "creativecommons org", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-sa", "distribute your contributions", r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", "commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "modified material", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by", "share copy and redistribute", r"you are free to share copy and redistribute the material in any medium or format"),
    ("ofl-1", "open font", r"this font software is licensed under the sil open font license"),
    ("ofl-1", "derivatives however", r"the fonts? and derivatives however cannot be released under any other type of license"),
    ("ofl-1", "reserved font name", r"no modified version of the font software may use the reserved font names?"),
    ("artistic-1", "standard version", r"you may make and give away verbatim copies of the source form of the standard version of this package without restriction"),
    ("artistic-2", "standard version", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("perl-5", "same terms as perl", r"you can redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ("ruby", "same terms as ruby", r"you can redistribute it and or modify it under the same terms as ruby"),
    ("python-2", "making python", r"psf is making python available to licensee on an as is basis"),
    ("cnri-python", "making python", r"cnri is making python 1 6 1 available to licensee on an as is basis"),
    ("php-3", "includes php software", r"this product includes php software freely available from https? www php net software"),
    ("postgresql", "written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("tcl", "existing copyright notices", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained"),
    ("sissl", "sun industry", r"the contents of this file are subject to the sun industry standards source license"),
    ("w3c", "w3c|by obtaining using", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms|this work is being provided by the copyright holders under the w3c license"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("vim", "charityware", r"vim is charityware"),
    ("imagemagick", "imagemagick studio", r"copyright (?:[0-9]{4} )?imagemagick studio llc"),
    ("ms-pl", "reproduce its contribution", r"each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution"),
    ("sspl-1", "service source code", r"if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("busl-1", "change date", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("busl-1", "additional use grant", r"additional use grant you may make use of the licensed work"),
    ("commons-clause", "commons clause", r"commons clause license condition"),
    ("elastic-2", "managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("osl-3", "open software license", r"licensed under the open software license version 3 0"),
    ("afl-3", "academic free license", r"licensed under the academic free license version (?:2 [01]|3 0)"),
    ("odbl-1", "open database", r"made available under the open database license"),
    ("odbl-1", "database contents", r"any rights in individual contents of the database are licensed under the database contents license"),
    ("ogl-uk", "public sector information", r"contains public sector information licensed under the open government licen[sc]e"),
    ("proprietary", "may be reproduced", r"no part of this (?:publication|document|work|software) may be reproduced (?:stored |transmitted )?(?:in any form )?without the (?:express|prior) written permission"),
    ("proprietary", "confidential", r"this (?:software|document|material) is the confidential and proprietary information of"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "personal use", r"for personal use only not for redistribution"),
    ("evaluation", "evaluation", r"this software is licensed for evaluation purposes only"),
    ("non-commercial", "non commercial", r"(?:free|licensed) for (?:personal and )?non commercial use only"),
    ("non-commercial", "research purposes", r"for academic and research purposes only commercial use is prohibited"),
    ("dual-license", "dual licensed", r"(?:is|are) dual licensed under"),
    ("fsfap", "copying and distribution of this file", r"copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("fsful", "unlimited permission", r"this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it"),
    ("nvidia-eula", "nvidia", r"nvidia software license agreement"),
    ("openrail", "creativeml", r"creativeml open ?rail m(?: license)?"),
    ("llama-community", "community license", r"llama [23] community license agreement"),
]
GRANT = r"(?:licen[sc]ed|released|distributed|available|provided|published|offered|used|covered|work is licen[sc]ed) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?"
#: Words, lower-cased; a text without any of these has no detection.
GATE = (
    "0bsd", "academic", "affero", "agpl", "anniversary", "apache", "beer", "bison", "bsd", "cc", "cc0", "cecill", "charityware", "circumvention", "commercial", "conditions", "consequential", "consortium",
    "contributors", "copyright", "covered", "creative", "creativecommons", "creativeml", "developer", "domain", "eclipse", "eupl", "expat", "font", "fonts", "freebsd", "fuck", "functionality", "gcc", "gpl", "gpl2", "gpl3",
    "gplv2", "gplv3", "historical", "installation", "interacting", "invariant", "lesser", "lgpl", "lgpl2", "lgpl3", "licence", "licences", "license", "licensed", "licensee", "licenses", "linking", "llvm", "merchantability",
    "mit", "mozilla", "nasa", "openrail", "openssl", "permission", "permitted", "png", "procurement", "proprietary", "publicdomain", "redistribute", "redistribution", "redistributions", "remix", "reserved", "royalty",
    "software", "spdx", "unauthorized", "unencumbered", "unlicence", "unlicense", "verbatim", "warranties", "warranty", "wtfpl", "x11", "linked",
)


def rule_table(base: dict[str, str]) -> list[tuple[int, str, list[str], str, float]]:
    """(priority, label, keywords, pattern, confidence), the base phrases first."""
    rules = [(0, label, [phrase], re.escape(phrase).replace(r"\ ", " "), 1.0) for phrase, label in base.items()]
    rules += [(1, label, ["spdx"], f"spdx licen[sc]e identifier {tag}", 1.0) for label, (tag, _, _) in LICENSES.items()]
    rules += [(2, label, keywords.split("|"), text, 0.9) for label, keywords, text in TEXTS]
    rules += [(3, label, keywords.split("|"), GRANT + name, 0.95) for label, (_, name, keywords) in LICENSES.items()]
    rules += [(4, label, keywords.split("|"), name, 0.6) for label, (_, name, keywords) in LICENSES.items()]
    return [(p, label, keywords, f"(?<= )(?:{pattern})(?= )", score) for p, label, keywords, pattern, score in rules]


def gate_words(base: dict[str, str]) -> list[str]:
    """GATE and a word of each base phrase."""
    return sorted({*GATE, *(max(phrase.split(), key=len) for phrase in base)})


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _detections(words: Column, rule: Column) -> Column:
    """Word intervals of a rule's matches: the text between matches gives their places."""
    found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    between = F.split(words, rule["pattern"], -1)
    empty = F.array().cast("array<struct<start:int,end:int,priority:int,label:string,score:double>>")

    def step(acc: Column, k: Column) -> Column:
        start = acc["at"] + _spaces(F.get(between, k))
        end = start + _spaces(F.get(found, k))
        one = F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(-1).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def _survivors(found: Column) -> Column:
    """Detections not within another; of equal intervals the first by priority and label.

    In order of start, then longest, then priority, a detection lies within an
    earlier one if and only if it ends no later than the furthest end so far.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label"), d["score"].alias("score"))))
    start = F.struct(F.lit(-1).alias("far"), F.array().cast("array<struct<start:int,back:int,priority:int,label:string,score:double>>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        new = -d["back"] > acc["far"]
        return F.struct(F.greatest(acc["far"], -d["back"]).alias("far"), F.when(new, F.concat(acc["out"], F.array(d))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def scan_licenses(docs: DataFrame, base: dict[str, str]) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    ``base``: phrase (lower-case words) to label.
    """
    rules = rule_table(base)
    literal = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(label).alias("label"), F.array(*map(F.lit, k)).alias("keywords"), F.lit(x).alias("pattern"), F.lit(s).alias("score")) for p, label, k, x, s in rules])
    apart = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    words = docs.select("doc_id", F.concat(F.lit(" "), F.trim(apart), F.lit(" ")).alias("words"))
    lower = F.lower("words")
    gate = F.arrays_overlap(F.split(lower, " "), F.array(*map(F.lit, gate_words(base))))
    words = words.select("doc_id", F.when(F.col("words") == "  ", 0).otherwise(_spaces(F.col("words")) - 1).cast("bigint").alias("n_words"), F.when(gate, F.translate("words", BIG, SMALL)).alias("words"))
    w = F.col("words")
    all_found = F.flatten(F.transform(F.filter(literal, lambda r: F.exists(r["keywords"], lambda k: F.contains(w, k))), lambda r: _detections(w, r)))
    none = F.array().cast("array<struct<start:int,end:int,priority:int,label:string,score:double>>")
    scanned = words.select("doc_id", "n_words", F.when(w.isNotNull(), all_found).otherwise(none).alias("found"))
    of_base = F.filter("found", lambda d: d["priority"] == 0)
    scanned = scanned.select("doc_id", "n_words", of_base.alias("base"), F.when(F.size("found") > 0, _survivors(F.col("found"))).alias("kept"))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base_labels = F.transform("base", lambda d: d["label"])
    kept_labels = F.coalesce(F.transform("kept", lambda d: d["label"]), F.array().cast("array<string>"))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).cast("bigint").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, kept_labels)).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["score"])), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda d: F.struct(d["label"].alias("label"), d["start"].alias("first_word"), (-d["back"]).alias("last_word"), d["score"].alias("score"))).alias("detections"),
    )
