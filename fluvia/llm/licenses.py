"""License scans with ordered signature rules.

Hand-written signatures (notices, headers, addresses, exceptions) and rules from a table of license names and a table of phrasings, several
hundred regexes in all, run over a text's words (lower-cased, one space apart). An Aho-Corasick automaton over the rules' keywords says which rules can match at all; most texts run none.
Detections overlap ("gnu general public license version 3" lies in "... 3 or later"), so each rule has a priority: of two
detections of which one interval contains the other, the one with the higher priority stays, and of equal ones the longer.

Edge cases: null or empty text has no words, null first_word and last_word, empty labels and score 0; a null doc_id stays null; repeated rows are
scanned each; very long texts are scanned whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import common
from fluvia.llm.encoding import slices

#: Base phrases, as words; always reported. Fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, name as words (a regex), versions; a version is appended to the label. Fixed values.
NAMES = [
    ("mit", r"(?:mit|expat)", ""),
    ("mit-0", r"mit no attribution", ""),
    ("x11", r"x11", ""),
    ("apache", r"apache(?: software)?", "1 1.1 2"),
    ("gpl", r"(?:gnu )?(?:general public|gpl)", "1 2 3"),
    ("lgpl", r"(?:gnu )?(?:lesser general public|library general public|lgpl)", "2 2.1 3"),
    ("agpl", r"(?:gnu )?(?:affero general public|agpl)", "1 3"),
    ("fdl", r"(?:gnu )?(?:free documentation|gfdl)", "1.1 1.2 1.3"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", ""),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", ""),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)", ""),
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", ""),
    ("bsd", r"bsd(?: style)?", ""),
    ("isc", r"isc", ""),
    ("mpl", r"(?:mozilla public|mpl)", "1 1.1 2"),
    ("epl", r"(?:eclipse public|epl)", "1 2"),
    ("cddl", r"(?:common development and distribution|cddl)", "1 1.1"),
    ("cpl", r"common public", "1"),
    ("eupl", r"(?:european union public|eupl)", "1.1 1.2"),
    ("osl", r"(?:open software|osl)", "1 2 2.1 3"),
    ("afl", r"(?:academic free|afl)", "1.1 2 3"),
    ("artistic", r"(?:perl )?artistic", "1 2"),
    ("zlib", r"(?:zlib|zlib libpng)", ""),
    ("libpng", r"libpng", "2"),
    ("boost", r"(?:boost software|bsl)", "1"),
    ("unlicense", r"(?:the )?unlicense", ""),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "2"),
    ("cc0", r"(?:cc0|creative commons zero)", "1"),
    ("cc-by", r"(?:cc by|creative commons attribution)", "1 2 2.5 3 4"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "1 2 2.5 3 4"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:atives|s))", "1 2 2.5 3 4"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", "1 2 2.5 3 4"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "1 2 2.5 3 4"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:atives|s))", "1 2 2.5 3 4"),
    ("odbl", r"(?:open database|odbl)", "1"),
    ("python", r"(?:python software foundation|psf)", "2"),
    ("php", r"php", "3 3.01"),
    ("ruby", r"ruby", ""),
    ("openssl", r"openssl", ""),
    ("ofl", r"(?:sil open font|ofl)", "1 1.1"),
    ("ms-pl", r"(?:microsoft public|ms pl)", ""),
    ("ms-rl", r"(?:microsoft reciprocal|ms rl)", ""),
    ("qpl", r"q public", "1"),
    ("ncsa", r"(?:university of illinois ncsa open source|ncsa)", ""),
    ("sspl", r"(?:server side public|sspl)", "1"),
    ("busl", r"(?:business source|busl)", "1.1"),
    ("elastic", r"elastic", "2"),
    ("upl", r"(?:universal permissive|upl)", "1"),
    ("cecill", r"cecill", "1 2 2.1"),
    ("vim", r"vim", ""),
    ("postgresql", r"postgresql", ""),
    ("w3c", r"w3c(?: software notice and)?", ""),
    ("ijg", r"independent jpeg group", ""),
    ("beerware", r"(?:beerware|beer ware)", "42"),
]

#: Phrasings: priority, confidence, keyword, pattern. {name}, {v} (version words), {id} (identifier words) and {any} (an operand of an SPDX expression)
#: are filled in. A group `at` is the interval of the detection, the whole match where there is none.
PHRASES = [
    (90, 1.0, " spdx ", r"spdx license identifier (?:{any} (?:and|or|with) ){{0,8}}(?P<at>{id})"),
    (80, 0.95, " under ", r"(?:licensed|released|distributed|published|available|provided) under (?:the |a )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[cs]e)?{v}"),
    (70, 0.9, " under ", r"under the {name} licen[cs]e{v}"),
    (70, 0.9, "licen", r"(?:subject to|governed by|in accordance with|according to) (?:the )?(?:terms of (?:the )?)?{name} licen[cs]e{v}"),
    (60, 0.8, "licen", r"{name} (?:public )?licen[cs]e{v}(?! (?:plates?|fees?|number|holders?|renewal) )"),
    (50, 0.7, "licen", r"licen[cs]e (?:is )?{name}{v}"),
]
#: Whole-text signatures: priority, confidence, label, pattern, keyword. Fixed values.
TEXTS = [
    (85, 0.9, "mit", r"permission is hereby granted free of charge to any person obtaining a copy", " hereby"),
    (85, 0.9, "isc", r"permission to use copy modify and or distribute this software for any purpose", " distribute"),
    (85, 0.9, "bsd", r"redistribution and use in source and binary forms with or without modification", " redistribution"),
    (85, 0.8, "gpl", r"this program is free software you can redistribute it and or modify", " redistribute"),
    (85, 0.9, "unlicense", r"this is free and unencumbered software released into the public domain", " unencumbered"),
    (85, 0.8, "gpl", r"this program is distributed in the hope that it will be useful but without any warranty", " hope"),
    (86, 0.9, "lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", " redistribute"),
    (84, 0.8, "gpl", r"you should have received a copy of the gnu general public license along with", " received"),
    (86, 0.85, "lgpl", r"you should have received a copy of the gnu lesser general public license along with", " received"),
    (86, 0.85, "agpl", r"you should have received a copy of the gnu affero general public license along with", " received"),
    (84, 0.9, "gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", " verbatim"),
    (85, 0.9, "fdl", r"permission is granted to copy distribute and or modify this document", " document"),
    (70, 0.6, "fdl", r"no invariant sections no front cover texts and no back cover texts", " invariant"),
    (80, 0.8, "mit", r"the above copyright notice and this permission notice shall be included in all copies", " notice"),
    (80, 0.7, "mit", r"the software is provided as is without warranty of any kind express or implied", " software"),
    (86, 0.85, "x11", r"except as contained in this notice the name of the x consortium shall not be used", " consortium"),
    (84, 0.9, "bsd", r"redistributions of source code must retain the above copyright notice", " redistributions"),
    (84, 0.85, "bsd", r"redistributions in binary form must reproduce the above copyright notice", " redistributions"),
    (86, 0.9, "bsd-3-clause", r"neither the name of .{1,120}? nor the names of (?:its|their|the) contributors may be used to endorse or promote products", " endorse"),
    (87, 0.9, "bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", " advertising"),
    (75, 0.6, "bsd", r"this software is provided by .{1,120}? as is and any express or implied warranties", " implied"),
    (85, 0.95, "apache-2", r"you may not use this file except in compliance with the license", " compliance"),
    (86, 0.95, "apache-2", r"you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0", " obtain"),
    (84, 0.9, "apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", " basis"),
    (85, 0.9, "apache-1.1", r"this product includes software developed by the apache software foundation", " developed"),
    (86, 0.95, "mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", " mozilla"),
    (85, 0.9, "mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", " mozilla"),
    (85, 0.9, "cddl", r"the contents of this file are subject to the terms of the common development and distribution license", " contents"),
    (85, 0.9, "epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", " accompanying"),
    (85, 0.85, "epl-2", r"which is available at (?:https? )?(?:www )?eclipse org legal epl 2 0", " eclipse"),
    (85, 0.9, "eupl", r"licensed under the eupl", " eupl"),
    (85, 0.9, "zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", " liable"),
    (84, 0.9, "zlib", r"altered source versions must be plainly marked as such", " altered"),
    (85, 0.9, "boost-1", r"boost software license version 1 0 (?:august 17th 2003)?", " boost"),
    (85, 0.9, "boost-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", " organization"),
    (86, 0.95, "wtfpl-2", r"do what the fuck you want to public license", " fuck"),
    (85, 0.9, "0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software", " fee"),
    (86, 0.9, "cc0-1", r"to the extent possible under law .{1,120}? has waived all copyright and related or neighbou?ring rights", " waived"),
    (84, 0.8, "cc0-1", r"creativecommons org publicdomain zero 1 0", " creativecommons"),
    (86, 0.9, "cc-by-sa-4", r"creativecommons org licenses by sa 4 0", " creativecommons"),
    (86, 0.9, "cc-by-sa-3", r"creativecommons org licenses by sa 3 0", " creativecommons"),
    (86, 0.9, "cc-by-4", r"creativecommons org licenses by 4 0", " creativecommons"),
    (86, 0.9, "cc-by-3", r"creativecommons org licenses by 3 0", " creativecommons"),
    (86, 0.9, "cc-by-nc-4", r"creativecommons org licenses by nc 4 0", " creativecommons"),
    (86, 0.9, "cc-by-nc-sa-4", r"creativecommons org licenses by nc sa 4 0", " creativecommons"),
    (86, 0.9, "cc-by-nc-nd-4", r"creativecommons org licenses by nc nd 4 0", " creativecommons"),
    (86, 0.9, "cc-by-nd-4", r"creativecommons org licenses by nd 4 0", " creativecommons"),
    (85, 0.9, "odbl-1", r"this .{1,60}? is made available under the open database license", " database"),
    (84, 0.8, "odbl", r"opendatacommons org licenses odbl", " opendatacommons"),
    (84, 0.8, "pddl", r"opendatacommons org licenses pddl", " opendatacommons"),
    (85, 0.9, "ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", " font"),
    (85, 0.9, "python-2", r"python software foundation license version 2", " python"),
    (85, 0.9, "php-3.01", r"this source file is subject to version 3 01 of the php license", " php"),
    (85, 0.9, "openssl", r"this product includes software developed by the openssl project", " openssl"),
    (85, 0.9, "ssleay", r"this product includes cryptographic software written by eric young", " cryptographic"),
    (85, 0.9, "artistic", r"the intent of this document is to state the conditions under which a package may be copied", " intent"),
    (85, 0.9, "ncsa", r"permission is hereby granted free of charge .{1,160}? to deal with the software without restriction", " deal"),
    (85, 0.9, "ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", " governs"),
    (85, 0.9, "json", r"the software shall be used for good not evil", " evil"),
    (85, 0.9, "beerware-42", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", " beer"),
    (85, 0.9, "busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", " licensor"),
    (85, 0.9, "sspl-1", r"offering the program as a service", " offering"),
    (85, 0.9, "elastic-2", r"you may not provide the software to third parties as a hosted or managed service", " hosted"),
    (85, 0.9, "postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", " documentation"),
    (85, 0.9, "ijg", r"this software is based in part on the work of the independent jpeg group", " jpeg"),
    (86, 0.9, "agpl", r"must prominently offer all users interacting with it remotely through a computer network", " remotely"),
    (84, 0.85, "gpl", r"the licen[cs]es for most software (?:and other practical works )?are designed to take away your freedom", " designed"),
    (84, 0.85, "gpl", r"general public license does not permit incorporating your program into proprietary programs", " incorporating"),
    (86, 0.9, "gpl-3", r"the gnu general public license is a free copyleft license for software and other kinds of works", " copyleft"),
    (86, 0.9, "agpl-3", r"the gnu affero general public license is a free copyleft license for software and other kinds of works", " copyleft"),
    (86, 0.9, "lgpl-3", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", " incorporates"),
    (86, 0.85, "lgpl", r"the (?:lesser|library) general public license applies to some specially designated", " designated"),
    (85, 0.9, "fdl", r"the purpose of this license is to make a manual textbook or other functional and useful document free", " textbook"),
    (85, 0.9, "apache-2", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", " irrevocable"),
    (85, 0.9, "apache-2", r"licensed to the apache software foundation asf under one or more contributor license agreements", " asf"),
    (85, 0.85, "apache-1.1", r"products derived from this software may not be called apache", " apache"),
    (85, 0.85, "php", r"products derived from this software may not be called php", " php"),
    (86, 0.9, "mpl-2", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license", " incompatible"),
    (86, 0.9, "mpl-1.1", r"alternatively the contents of this file may be used under the terms of either the gnu", " alternatively"),
    (84, 0.85, "epl", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", " recipient"),
    (86, 0.9, "cpl", r"the accompanying program is provided under the terms of this common public license", " accompanying"),
    (86, 0.9, "ipl", r"the accompanying program is provided under the terms of this ibm public license", " accompanying"),
    (85, 0.9, "afl-3", r"licensed under the academic free license version 3 0", " academic"),
    (85, 0.9, "osl-3", r"licensed under the open software license version 3 0", " open"),
    (80, 0.9, "ecl", r"educational community license", " educational"),
    (80, 0.9, "rpl", r"reciprocal public license", " reciprocal"),
    (80, 0.9, "cpal", r"common public attribution license", " attribution"),
    (80, 0.9, "apsl", r"apple public source license", " apple"),
    (80, 0.9, "sissl", r"sun industry standards source license", " industry"),
    (80, 0.9, "npl", r"netscape public license", " netscape"),
    (80, 0.9, "lpl", r"lucent public license", " lucent"),
    (80, 0.9, "nokia", r"nokia open source license", " nokia"),
    (80, 0.9, "watcom", r"sybase open watcom public license", " watcom"),
    (80, 0.9, "efl", r"eiffel forum license", " eiffel"),
    (80, 0.9, "aal", r"attribution assurance license", " assurance"),
    (80, 0.9, "sgi-b", r"sgi free software license b", " sgi"),
    (80, 0.9, "intel", r"intel open source license", " intel"),
    (80, 0.9, "ipa", r"ipa font license agreement", " ipa"),
    (80, 0.9, "zpl", r"zope public license", " zope"),
    (80, 0.9, "openldap", r"(?:the )?openldap public license", " openldap"),
    (80, 0.9, "mulan", r"mulan (?:permissive software|psl|public) license", " mulan"),
    (80, 0.9, "blueoak", r"blue oak model license", " oak"),
    (80, 0.9, "hippocratic", r"hippocratic license", " hippocratic"),
    (80, 0.9, "996", r"anti 996 license", " 996"),
    (80, 0.9, "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license", " polyform"),
    (80, 0.9, "confluent", r"confluent community license", " confluent"),
    (80, 0.9, "rsal", r"redis source available license", " redis"),
    (80, 0.9, "openrail", r"(?:creativeml |bigscience |bigcode )?open ?rail m(?: license)?", " open"),
    (80, 0.9, "llama", r"llama [0-9](?: [0-9])? community license agreement", " llama"),
    (80, 0.9, "cdla", r"community data license agreement (?:permissive|sharing)", " community"),
    (80, 0.9, "odc-by", r"open data commons attribution license", " commons"),
    (82, 0.9, "ogl-uk", r"contains public sector information licensed under the open government licence", " sector"),
    (80, 0.9, "etalab", r"licence ouverte(?: open licence)?", " ouverte"),
    (80, 0.9, "dl-de", r"datenlizenz deutschland", " datenlizenz"),
    (80, 0.9, "nlod", r"norwegian licen[cs]e for open government data", " norwegian"),
    (85, 0.9, "cecill", r"this software is governed by the cecill(?: [bc])? license under french law", " cecill"),
    (84, 0.85, "hpnd", r"distribute this software and its documentation for any purpose and without fee is hereby granted", " documentation"),
    (83, 0.8, "hpnd", r"not be used in advertising or publicity pertaining to distribution of the software", " publicity"),
    (86, 0.85, "curl", r"copyright and permission notice copyright (?:c )?1996 [0-9]{4} daniel stenberg", " stenberg"),
    (85, 0.9, "unicode", r"unicode inc license agreement data files and software", " unicode"),
    (85, 0.9, "libtiff", r"in no event shall sam leffler or silicon graphics be liable", " leffler"),
    (85, 0.9, "bzip2", r"this program bzip2 the associated library libbzip2", " libbzip2"),
    (85, 0.9, "info-zip", r"this is version .{1,60}? of the info zip (?:copyright and )?license", " info"),
    (85, 0.9, "libpng-2", r"png reference library license version 2", " png"),
    (85, 0.9, "sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code", " accompanied"),
    (85, 0.9, "bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license", " patent"),
    (85, 0.9, "bsd-2-clause-patent", r"hereby grants to those receiving rights under this license a perpetual worldwide", " receiving"),
    (85, 0.85, "ms-rl", r"for any file you distribute that contains code from the software in source code or binary format you must provide recipients", " recipients"),
    (85, 0.9, "artistic-2", r"this license establishes the terms under which a given free software package may be copied", " establishes"),
    (82, 0.85, "perl", r"(?:redistribute it and or modify it )?under the same terms as perl itself", " perl"),
    (85, 0.9, "ruby", r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl", " bsdl"),
    (85, 0.9, "vim", r"there are no restrictions on distributing unmodified copies of vim", " unmodified"),
    (85, 0.9, "w3c", r"w3c software (?:and document )?notice and license", " w3c"),
    (85, 0.9, "tcl", r"the following terms apply to all files associated with the software unless explicitly disclaimed in individual files", " disclaimed"),
    (85, 0.9, "fsfap", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", " royalty"),
    (85, 0.9, "fsful", r"the free software foundation gives unlimited permission to copy (?:and or )?distribute", " unlimited"),
    (85, 0.9, "lppl", r"distributed and or modified under the (?:conditions|terms) of the latex project public license", " latex"),
    (85, 0.9, "ofl", r"the fonts including any derivative works can be bundled embedded redistributed and or sold", " bundled"),
    (85, 0.9, "bitstream-vera", r"bitstream vera is a trademark of bitstream inc", " bitstream"),
    (85, 0.9, "cc0-1", r"the person who associated a work with this deed has dedicated the work to the public domain", " deed"),
    (86, 0.9, "cc-by-2", r"creativecommons org licenses by 2 0", " creativecommons"),
    (86, 0.9, "cc-by-2.5", r"creativecommons org licenses by 2 5", " creativecommons"),
    (86, 0.9, "cc-by-sa-2", r"creativecommons org licenses by sa 2 0", " creativecommons"),
    (86, 0.9, "cc-by-sa-2.5", r"creativecommons org licenses by sa 2 5", " creativecommons"),
    (86, 0.9, "cc-by-nc-3", r"creativecommons org licenses by nc 3 0", " creativecommons"),
    (86, 0.9, "cc-by-nc-sa-3", r"creativecommons org licenses by nc sa 3 0", " creativecommons"),
    (86, 0.9, "cc-by-nd-3", r"creativecommons org licenses by nd 3 0", " creativecommons"),
    (85, 0.9, "upl", r"and or data collectively the software free of charge and under any and all copyright rights", " collectively"),
    (85, 0.9, "apple-sample", r"in consideration of your agreement to (?:abide by )?the following terms", " consideration"),
    (85, 0.85, "ssleay", r"this library is free for commercial and non commercial use as long as the following conditions are adhered to", " commercial"),
    (85, 0.9, "blessing", r"may you find forgiveness for yourself and forgive others", " forgiveness"),
    (75, 0.7, "public-domain", r"the authors? (?:hereby )?disclaims? copyright to this source code", " disclaim"),
    (60, 0.7, "proprietary", r"use duplication or disclosure by the (?:u s |us |united states )?government is subject to restrictions", " duplication"),
    (60, 0.7, "proprietary", r"oracle binary code license agreement", " oracle"),
    (60, 0.7, "proprietary", r"licensed materials property of", " materials"),
    (55, 0.6, "proprietary", r"end user licen[cs]e agreement", " end"),
    (55, 0.6, "evaluation-only", r"for (?:internal )?evaluation (?:use|purposes) only", " evaluation"),
    (80, 0.8, "commons-clause", r"(?:the )?commons clause license condition v1 0", " clause"),
    (78, 0.8, "public-domain", r"(?:dedicated|released|placed|dedicate|release) (?:it |this |any and all copyright interest )?(?:in the software )?(?:in|into|to) the public domain", " domain"),
    (70, 0.7, "public-domain", r"no copyright is claimed", " claimed"),
    (60, 0.7, "proprietary", r"(?:confidential and proprietary|proprietary and confidential)", " proprietary"),
    (60, 0.7, "proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)", " unauthori"),
    (55, 0.6, "proprietary", r"(?:may not|must not) be (?:copied|reproduced|redistributed) without (?:the )?(?:prior |express |written )*permission", " permission"),
    (55, 0.6, "non-commercial", r"(?:for|to) non ?commercial (?:use|purposes)(?: only)?", "commercial"),
    (55, 0.6, "non-commercial", r"for personal(?: and| or) non ?commercial use", " personal"),
    (55, 0.5, "research-only", r"for (?:academic|research)(?: and (?:research|educational))? (?:use|purposes) only", " only"),
    (50, 0.5, "free-use", r"free (?:for|to) (?:use|copy) (?:and (?:distribute|modify) )?(?:by anyone )?for any purpose", " purpose"),
    (45, 0.5, "see-license", r"see (?:the )?(?:accompanying )?licen[cs]e (?:file )?for (?:details|more information|terms)", " see"),
    (60, 0.7, "public-domain", r"(?:in|into|to) the public domain", " domain"),
    (40, 0.6, "proprietary", r"all rights reserved", " reserved"),
    (40, 0.5, "warranty-disclaimer", r"without warranty of any kind", " warranty"),
    (30, 0.4, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", " copyright"),
]


@dataclass(frozen=True)
class Rule:
    """Runs only if the text has one of `names` and one of `keywords`."""

    label: str
    pattern: re.Pattern
    names: frozenset[str]
    keywords: frozenset[str]
    priority: int
    confidence: float


def _version(v: str) -> str:
    words = v.replace(".", " ")
    return rf"(?: version| v| ver)? v?{words}" + ("(?: 0)?" if " " not in words else "")


def _gates(name: str) -> frozenset[str]:
    """For each alternative of a name's pattern its longest literal word, as a whole word."""
    name = name.replace("(?:gnu )?", "")
    flat = re.sub(r"\((?:\?:)?[^()]*\)\??", lambda m: "|".join(m[0].strip("()?").removeprefix(":").split("|")) if name.startswith(m[0]) and m[0][-1] != "?" else " ", name)
    best = (max(re.findall(r"[a-z0-9]+(?![?a-z0-9])", alt), key=len, default="") for alt in flat.split("|"))
    return frozenset(f" {w}" for w in best if w)


#: Families whose grants name later versions, and what follows the version. Fixed values.
OPEN_ENDED = ("gpl", "lgpl", "agpl", "fdl")
TAILS = [("or-later", r" (?:license )?(?:or|and)(?: at your option| at your choice)? (?:any )?(?:later|newer|higher)(?: versions?)?"), ("only", r" (?:license )?only")]
#: Exceptions named after an expression. Fixed values.
EXCEPTIONS = [("classpath-exception", r"(?:with|plus) (?:the )?(?:gnu )?classpath(?: linking)? exception"), ("gcc-exception", r"(?:with|plus) (?:the )?gcc (?:runtime library )?exception"), ("linking-exception", r"(?:with|plus) (?:a |the )?(?:special )?linking exception"), ("llvm-exception", r"(?:with|plus) (?:the )?llvm exceptions?"), ("font-exception", r"(?:with|plus) (?:the )?font (?:embedding )?exception"), ("autoconf-exception", r"(?:with|plus) (?:the )?autoconf exception")]


def _operand() -> str:
    """An operand of an SPDX expression as words: an identifier in brackets or not, with its version, or an exception."""
    heads = sorted({label.replace("-", " ") for label, _, _ in NAMES}, key=lambda x: (-len(x), x))
    return rf"(?:(?:{'|'.join(heads)})(?: [0-9]+){{0,2}}(?: or later| only)?|[a-z]+(?: [a-z]+)? exception(?: [0-9]+){{0,2}})"


def rules() -> list[Rule]:
    """All rules in order: by priority, a rule with a version before the one without."""
    out = []
    operand = _operand()
    for label, name, versions in NAMES:
        gates = _gates(name)
        for v in [*versions.split(), ""]:
            full = f"{label}-{v}" if v else label
            ident = label.replace("-", " ") + (" " + v.replace(".", " ") if v else "")
            for priority, confidence, keyword, phrase in PHRASES:
                pattern = phrase.format(name=name, v=_version(v) if v else "", id=ident, any=operand)
                out.append(Rule(full, re.compile(rf"(?<= ){pattern}(?= )"), frozenset({" " + ident.split()[0]}) if "{id}" in phrase else gates, frozenset({keyword}), priority + bool(v), confidence))
            for suffix, tail in TAILS if label in OPEN_ENDED and v else []:
                whole = rf"{name}(?: licen[cs]e)?{_version(v)}{tail}"
                out.append(Rule(f"{full}-{suffix}", re.compile(rf"(?<= ){whole}(?= )"), gates, frozenset({" later", " newer", " higher"} if suffix == "or-later" else {" only"}), 95, 0.95))
            if label.startswith("cc-") and v:
                out.append(Rule(full, re.compile(rf"(?<= ){name}{_version(v)}(?= )"), frozenset({" cc ", " creative"}), frozenset({" cc ", " creative"}), 75, 0.9))
    for label, pattern in EXCEPTIONS:
        out.append(Rule(label, re.compile(rf"(?<= ){pattern}(?= )"), frozenset({" exception"}), frozenset({" exception"}), 75, 0.8))
    for priority, confidence, label, pattern, keyword in TEXTS:
        out.append(Rule(label, re.compile(rf"(?<= ){pattern}(?= )"), frozenset({keyword}), frozenset({keyword}), priority, confidence))
    for phrase, label in BASE.items():
        first, last = " " + phrase.split()[0] + " ", " " + phrase.split()[-1] + " "
        out.append(Rule(label, re.compile(rf"(?<= ){phrase}(?= )"), frozenset({last}), frozenset({first}), 65, 0.85))
    return sorted(out, key=lambda r: -r.priority)


#: Bytes to words: letters fall, all else below 0x80 but digits is white space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split()


def detected(rules: Iterable[Rule], text: str) -> list[tuple[int, int, str, int, float]]:
    """(start, end, label, priority, confidence) of every match of `rules`."""
    return [(*m.span("at" if "at" in r.pattern.groupindex else 0), r.label, r.priority, r.confidence) for r in rules for m in r.pattern.finditer(text)]


class Scanner:
    """The rules behind one automaton of their keywords."""

    def __init__(self) -> None:
        import ahocorasick

        self.rules = rules()
        self.gates = ahocorasick.Automaton()
        for k in sorted({k for r in self.rules for k in r.names | r.keywords}):
            self.gates.add_word(k, k)
        self.gates.make_automaton()
        self.first = sorted({k.encode() for r in self.rules for k in r.keywords})

    def detections(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, priority, confidence) in `text`, words one space apart, after suppression."""
        seen = {k for _, k in self.gates.iter(text)}
        return suppressed(detected((r for r in self.rules if not (r.keywords.isdisjoint(seen) or r.names.isdisjoint(seen))), text))

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        n = len(words)
        line = b" " + b" ".join(words) + b" "
        if not any(k in line for k in self.first):
            return n, 0, None, None, "", "", 0.0, 0
        s = line.decode("utf-8", "replace")
        hits: list[tuple[int, str]] = []
        for phrase, label in BASE.items():
            at = s.find(f" {phrase} ")
            while at >= 0:
                hits.append((at, label))
                at = s.find(f" {phrase} ", at + 1)
        base: list[tuple[int, str]] = []
        word = last = 0
        for at, label in sorted(hits):  # words before each place, in one pass
            word, last = word + s.count(" ", last, at), at
            base.append((word, label))
        kept = self.detections(s)
        miss = 1.0
        for c in {d[2]: d[4] for d in sorted(kept, key=lambda d: d[4])}.values():
            miss *= 1 - c
        labels = {d[2] for d in kept} | {x for _, x in base}
        starts = [w for w, _ in base]
        return n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(1 - miss, 6), len(kept)


def suppressed(found: list[tuple[int, int, str, int, float]]) -> list[tuple[int, int, str, int, float]]:
    """Drop each detection whose interval lies in, or holds, that of a stronger one (priority, then length, then place).

    No kept interval holds another, so in the order of their starts their ends rise too: only the last one that starts no later can
    hold a new one, and only the first that starts no earlier can lie in it.
    """
    places: list[tuple[int, int]] = []
    kept: list[tuple[int, int, str, int, float]] = []
    for d in sorted(set(found), key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
        k = bisect_right(places, (d[0], float("inf")))
        if k and places[k - 1][1] >= d[1]:
            continue
        k = bisect_left(places, (d[0], -1))
        if k < len(places) and places[k][1] <= d[1]:
            continue
        insort(places, d[:2])
        kept.append(d)
    return sorted(kept)


_scanner: list[Scanner] = []
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: see SCHEMA."""

    def run(batches):
        if not _scanner:
            _scanner.append(Scanner())
        for key, text in slices(batches, ["doc_id", "text"]):
            rows = [(k, *_scanner[0].scan(t or "")) for k, t in zip(key, text, strict=True)]
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=schema.names)

    n, s = pa.int64(), pa.string()
    schema = pa.schema(list(zip(("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"), (n, n, n, n, n, s, s, pa.float64(), n), strict=True)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.documents(spark, sf_dir))
