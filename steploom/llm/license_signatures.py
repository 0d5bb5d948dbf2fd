"""Signatures of licences: sentences of their texts, notices in headers, and terms, each written by hand.

Each is (label, keyword, expression, priority, weight) over the normal form of a text (lower case, one space between words,
no punctuation). The keyword is part of whatever the expression matches, but for two sentences that several licences share:
those ask for the name of one elsewhere in the text. Priority 1 tells one licence, 2 a family or a term, 3 hints at terms.
"""

from __future__ import annotations

SIGNATURES = (
    # MIT and its relatives
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
    ("mit", "without restriction", r"to deal in the software without restriction", 1, 0.9),
    ("mit", "sublicen", r"use copy modify merge publish distribute sublicen[sc]e and or sell copies", 1, 0.9),
    ("mit", "substantial portions", r"permission notice shall be included in all copies or substantial portions", 1, 0.9),
    ("mit-warranty", "warranty of any kind", r"the software is provided as is without warranty of any kind", 2, 0.7),
    ("mit-warranty", "liable for any claim", r"in no event shall the authors or copyright holders be liable for any claim", 2, 0.7),
    ("x11", "x consortium", r"name of the x consortium shall not be used in advertising", 1, 0.9),
    ("mit-feh", "authors credit", r"documentation and its copies provided authors credit", 1, 0.8),
    ("hpnd", "hereby granted without fee", r"for any purpose (?:and without fee )?is hereby granted without fee", 1, 0.8),
    ("hpnd", "supporting documentation", r"this permission notice appear in supporting documentation", 1, 0.8),
    ("hpnd", "pertaining to distribution", r"advertising or publicity pertaining to distribution of the software without specific", 1, 0.8),
    ("ntp", "suitability of this software", r"makes no representations about the suitability of this software", 2, 0.6),
    # BSD
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 1, 0.9),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice", 1, 0.9),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice", 1, 0.9),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software", 1, 0.9),
    ("bsd-3-clause", "neither the name", r"neither the name of the (?:copyright holder|university|author|company|project|organization) nor the names of its contributors", 1, 0.95),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software", 1, 0.95),
    ("bsd-4-clause", "following acknowledgement", r"must display the following acknowledgement", 1, 0.85),
    ("bsd-disclaimer", "copyright holders and contributors", r"provided by the copyright holders and contributors as is", 2, 0.7),
    ("bsd-disclaimer", "regents and contributors", r"provided by the regents and contributors as is", 2, 0.7),
    ("bsd-disclaimer", "any express or implied warranties", r"any express or implied warranties including but not limited to", 2, 0.6),
    ("bsd-disclaimer", "procurement of substitute", r"procurement of substitute goods or services", 2, 0.6),
    ("bsd-2-clause", "bsd 2", r"bsd 2 clause", 2, 0.6),
    ("bsd-3-clause", "bsd 3", r"bsd 3 clause", 2, 0.6),
    ("bsd-clear", "no express or implied", r"no express or implied licen[sc]es to any party s patent rights", 1, 0.9),
    ("bsd-header", "bsd style", r"governed by a bsd style licen[sc]e that can be found in the licen[sc]e file", 1, 0.9),
    ("0bsd", "with or without fee", r"for any purpose with or without fee is hereby granted the software", 1, 0.8),
    # ISC, zlib, boost, small permissive ones
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose", 1, 0.9),
    ("isc", "permission to use copy", r"permission to use copy modify and distribute this software for any purpose with or without fee", 1, 0.9),
    ("isc-disclaimer", "the author disclaims", r"the author disclaims all warranties with regard to this software", 2, 0.7),
    ("zlib", "held liable for any damages", r"will the authors be held liable for any damages arising from the use of this software", 1, 0.85),
    ("zlib", "including commercial applications", r"for any purpose including commercial applications and to alter it", 1, 0.9),
    ("zlib", "origin of this software", r"origin of this software must not be misrepresented", 1, 0.95),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 1, 0.95),
    ("bsl-1.0", "machine executable object", r"machine executable object code generated by a source language processor", 1, 0.95),
    ("bsl-1.0", "obtaining a copy of the software and accompanying", r"obtaining a copy of the software and accompanying documentation covered by this licen[sc]e", 1, 0.95),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain", 1, 0.95),
    ("unlicense", "detriment of our heirs", r"to the detriment of our heirs and successors", 1, 0.9),
    ("unlicense", "overt act of relinquishment", r"overt act of relinquishment in perpetuity", 1, 0.9),
    ("wtfpl", "what the fuck you want", r"do what the fuck you want to", 1, 0.95),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 1, 0.95),
    ("fair", "usage of the works", r"usage of the works is permitted provided that this instrument is retained", 1, 0.95),
    ("fsfap", "without royalty", r"are permitted in any medium without royalty", 1, 0.85),
    ("curl", "permission to use copy", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided", 1, 0.7),
    ("bzip2", "original software", r"you must not claim that you wrote the original software", 1, 0.8),
    ("ijg", "independent jpeg group", r"based in part on the work of the independent jpeg group", 1, 0.95),
    ("freetype", "freetype project", r"copyright (?:c )?the freetype project", 1, 0.9),
    ("freetype", "freetype project licen", r"the freetype project licen[sc]e", 1, 0.85),
    ("openssl", "openssl", r"software developed by the openssl project", 1, 0.9),
    ("ssleay", "eric young", r"cryptographic software written by eric young", 1, 0.9),
    ("php-3.01", "php", r"this product includes php software", 1, 0.9),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 1, 0.75),
    ("python-2.0", "beopen", r"beopen com licen[sc]e agreement for python", 1, 0.9),
    ("psf-2.0", "python software foundation", r"between the python software foundation psf and the individual or organization", 1, 0.95),
    ("postgresql", "without a written agreement", r"without fee and without a written agreement is hereby granted", 1, 0.9),
    ("ncsa", "deal with the software", r"to deal with the software without restriction", 1, 0.9),
    ("ncsa", "documentation and or other materials", r"in the documentation and or other materials provided with the distribution", 3, 0.4),
    ("unicode", "data files", r"to deal in the data files or software without restriction", 1, 0.9),
    ("icu", "icu licen", r"icu licen[sc]e", 1, 0.8),
    ("upl-1.0", "larger work", r"the software and the larger work", 1, 0.7),
    ("blueoak-1.0", "blue oak", r"blue oak model licen[sc]e", 1, 0.95),
    ("mulan-psl-2.0", "mulan", r"mulan (?:permissive software licen[sc]e|psl)", 1, 0.95),
    ("afl-3.0", "academic free", r"academic free licen[sc]e", 1, 0.9),
    ("ecl-2.0", "educational community", r"educational community licen[sc]e", 1, 0.9),
    ("osl-3.0", "open software licen", r"open software licen[sc]e(?: version)? 3 0", 1, 0.9),
    ("osl", "open software licen", r"licen[sc]ed under the open software licen[sc]e", 2, 0.7),
    ("artistic-1.0", "artistic control", r"some semblance of artistic control", 1, 0.95),
    ("artistic-2.0", "standard version", r"you may distribute verbatim copies of the source form of the standard version", 1, 0.9),
    ("perl", "perl", r"under the same terms as perl itself", 1, 0.9),
    ("ruby", "ruby", r"under the same terms as ruby(?: itself)?", 1, 0.85),
    ("vim", "vim", r"this licen[sc]e agreement applies to vim", 1, 0.9),
    ("tcl", "tcl", r"tcl tk licen[sc]e", 1, 0.85),
    ("json", "good not evil", r"shall be used for good not evil", 1, 0.95),
    # Apache
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the licen[sc]e", 1, 0.9),
    ("apache-2.0", "apache", r"licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements", 1, 0.95),
    ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e (?:v ?|version )?2(?: 0)?", 2, 0.75),
    ("apache-2.0", "apache 2", r"apache 2 0", 2, 0.6),
    ("apache-2.0", "apache org licen", r"www apache org licen[sc]es licen[sc]e 2 0", 1, 0.95),
    ("apache-2.0", "grant of patent licen", r"grant of patent licen[sc]e subject to the terms and conditions", 1, 0.85),
    ("apache-2.0", "grant of copyright licen", r"grant of copyright licen[sc]e subject to the terms and conditions", 1, 0.85),
    ("apache-2.0", "apache", r"terms and conditions for use reproduction and distribution", 1, 0.8),
    ("apache-notice", "as is basis", r"distributed under the licen[sc]e is distributed on an as is basis", 2, 0.7),
    ("apache-notice", "specific language governing", r"specific language governing permissions and limitations", 2, 0.7),
    # GNU
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it", 1, 0.9),
    ("gpl", "gpl", r"gnu gpl", 2, 0.6),
    ("gpl", "general public", r"gnu general public licen[sc]e", 2, 0.6),
    ("gpl-2.0", "version 2 of the licen", r"free software foundation either version 2 of the licen[sc]e", 1, 0.95),
    ("gpl-3.0", "version 3 of the licen", r"free software foundation either version 3 of the licen[sc]e", 1, 0.8),
    ("gpl-1.0", "version 1 or at your", r"either version 1 or at your option any later version", 1, 0.85),
    ("gpl-2.0", "version 2 or at your", r"either version 2 or at your option any later version", 1, 0.9),
    ("gpl-2.0", "gpl", r"(?:gnu )?gplv?2 only", 1, 0.9),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl (?:v|version )?2(?: 0)? (?:only|or later|or any later version)", 1, 0.9),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl (?:v|version )?3(?: 0)? (?:only|or later|or any later version)", 1, 0.9),
    ("gpl-2.0", "gplv2", r"gplv2(?: 0)?", 2, 0.7),
    ("gpl-3.0", "gplv3", r"gplv3(?: 0)?", 2, 0.7),
    ("gpl-2.0", "gpl2", r"gpl2", 2, 0.6),
    ("gpl-3.0", "gpl3", r"gpl3", 2, 0.6),
    ("gpl-2.0", "gpl", r"gpl (?:v ?|version )?2(?: 0)?", 2, 0.7),
    ("gpl-3.0", "gpl", r"gpl (?:v ?|version )?3(?: 0)?", 2, 0.7),
    ("gpl-2.0", "general public", r"general public licen[sc]e (?:v ?|version )2(?: 0)?", 2, 0.75),
    ("gpl-3.0", "general public", r"general public licen[sc]e (?:v ?|version )3(?: 0)?", 2, 0.75),
    ("gpl-2.0", "june 1991", r"gnu general public licen[sc]e version 2 june 1991", 1, 0.95),
    ("gpl-3.0", "june 2007", r"gnu general public licen[sc]e version 3 29 june 2007", 1, 0.95),
    ("gpl", "copy of the gnu general", r"you should have received a copy of the gnu general public licen[sc]e", 1, 0.9),
    ("gpl", "gnu org licen", r"www gnu org licen[sc]es gpl", 1, 0.85),
    ("gpl-2.0", "gnu org licen", r"www gnu org licen[sc]es (?:old licen[sc]es )?gpl 2 0", 1, 0.9),
    ("gpl-3.0", "gnu org licen", r"www gnu org licen[sc]es gpl 3 0", 1, 0.9),
    ("gpl-preamble", "freedom to share", r"designed to take away your freedom to share and change", 1, 0.9),
    ("gpl-preamble", "intended to guarantee", r"intended to guarantee your freedom to share and change", 1, 0.9),
    ("gpl-warranty", "implied warranty of", r"without even the implied warranty of merchantability or fitness for a particular purpose", 2, 0.7),
    ("gpl-later", "any later version", r"(?:or at your option )?any later version", 3, 0.4),
    ("gpl-exception", "as a special exception", r"as a special exception", 3, 0.4),
    ("gpl-classpath", "classpath", r"(?:gpl )?(?:with )?(?:the )?classpath exception", 1, 0.85),
    ("gpl-classpath", "independent modules", r"link this library with independent modules to produce an executable", 1, 0.9),
    ("gpl-gcc-exception", "runtime library exception", r"gcc runtime library exception", 1, 0.9),
    ("gpl-autoconf", "autoconf", r"contains a configuration script generated by autoconf", 1, 0.85),
    ("gpl-bison", "bison", r"special exception you may create a larger work that contains part or all of the bison parser skeleton", 1, 0.9),
    ("gpl-linking", "openssl", r"permission to link the code of (?:portions of )?this program with the openssl library", 1, 0.9),
    ("linux-syscall-note", "syscall", r"linux syscall note", 1, 0.9),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it", 1, 0.9),
    ("lgpl", "lesser general", r"gnu lesser general public licen[sc]e", 1, 0.7),
    ("lgpl", "library general", r"gnu library general public licen[sc]e", 1, 0.7),
    ("lgpl-2.1", "lgplv2", r"lgplv2 1", 2, 0.7),
    ("lgpl-2.0", "lgplv2", r"lgplv2(?: 0)?", 2, 0.6),
    ("lgpl-3.0", "lgplv3", r"lgplv3(?: 0)?", 2, 0.7),
    ("lgpl-2.1", "lgpl", r"lgpl (?:v ?|version )?2 1", 2, 0.7),
    ("lgpl-3.0", "lgpl", r"lgpl (?:v ?|version )?3(?: 0)?", 2, 0.7),
    ("lgpl-2.1", "lesser general", r"lesser general public licen[sc]e (?:v ?|version )2 1", 1, 0.8),
    ("lgpl-3.0", "lesser general", r"lesser general public licen[sc]e (?:v ?|version )3(?: 0)?", 1, 0.8),
    ("lgpl", "copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e", 1, 0.9),
    ("lgpl", "copy of the gnu library", r"you should have received a copy of the gnu library general public licen[sc]e", 1, 0.9),
    ("lgpl-2.1", "february 1999", r"gnu lesser general public licen[sc]e version 2 1 february 1999", 1, 0.95),
    ("lgpl", "uses the library", r"work that uses the library", 1, 0.8),
    ("agpl", "affero", r"gnu affero general public licen[sc]e", 1, 0.7),
    ("agpl-3.0", "agplv3", r"agplv3(?: 0)?", 2, 0.7),
    ("agpl-3.0", "agpl", r"agpl (?:v ?|version )?3(?: 0)?", 2, 0.7),
    ("agpl-3.0", "affero", r"affero general public licen[sc]e (?:v ?|version )3(?: 0)?", 1, 0.8),
    ("agpl-3.0", "november 2007", r"gnu affero general public licen[sc]e version 3 19 november 2007", 1, 0.95),
    ("agpl", "copy of the gnu affero", r"you should have received a copy of the gnu affero general public licen[sc]e", 1, 0.9),
    ("agpl", "interacting with it remotely", r"all users interacting with it remotely through a computer network", 1, 0.9),
    ("gfdl", "invariant sections", r"with no invariant sections no front cover texts", 1, 0.95),
    ("gfdl", "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 1, 0.95),
    ("gfdl", "gnu free documentation", r"gnu free documentation licen[sc]e", 2, 0.7),
    ("copyleft", "copyleft", r"copyleft", 3, 0.4),
    # Other reciprocal ones
    ("mpl-2.0", "mozilla public", r"subject to the terms of the mozilla public licen[sc]e v 2 0", 1, 0.95),
    ("mpl-2.0", "mozilla org mpl", r"mozilla org mpl 2 0", 1, 0.95),
    ("mpl-1.1", "mozilla public", r"subject to the mozilla public licen[sc]e version 1 1", 1, 0.95),
    ("mpl-2.0", "mpl", r"mpl (?:v ?|version )?2 0", 2, 0.6),
    ("mpl", "mozilla public", r"mozilla public licen[sc]e", 2, 0.6),
    ("mpl-1.1", "original code", r"the initial developer of the original code is", 1, 0.85),
    ("mpl-2.0", "incompatible with secondary", r"incompatible with secondary licen[sc]es", 1, 0.85),
    ("epl", "eclipse public", r"made available under the terms of the eclipse public licen[sc]e", 1, 0.85),
    ("epl", "eclipse org legal", r"www eclipse org legal epl", 1, 0.85),
    ("epl-1.0", "eclipse org legal", r"www eclipse org legal epl v10", 1, 0.95),
    ("epl-2.0", "eclipse org legal", r"www eclipse org legal epl (?:2 0|v20)", 1, 0.95),
    ("cpl-1.0", "common public", r"accompanying program is provided under the terms of this common public licen[sc]e", 1, 0.95),
    ("cddl-1.0", "cddl", r"cddl(?: 1 [01])?", 2, 0.6),
    ("cddl-1.0", "common development", r"subject to the terms of the common development and distribution licen[sc]e", 1, 0.95),
    ("cecill", "cecill", r"cecill(?: b| c)?(?: free software)? licen[sc]e", 1, 0.9),
    ("eupl-1.2", "eupl", r"licen[sc]ed under the eupl", 1, 0.9),
    ("ms-pl", "ms pl", r"ms pl", 3, 0.4),
    ("ms-pl", "accompanying software", r"this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e", 1, 0.85),
    ("qpl-1.0", "q public", r"the q public licen[sc]e", 1, 0.9),
    ("ibm-ipl", "ibm public", r"ibm public licen[sc]e", 1, 0.9),
    ("apsl-2.0", "apple public", r"apple public source licen[sc]e", 1, 0.9),
    ("rpl-1.5", "reciprocal public", r"reciprocal public licen[sc]e", 1, 0.9),
    ("sleepycat", "accompanying software that uses the db", r"any accompanying software that uses the db software", 1, 0.9),
    ("cpal-1.0", "common public attribution", r"common public attribution licen[sc]e", 1, 0.9),
    ("nposl-3.0", "non profit open", r"non profit open software licen[sc]e", 1, 0.9),
    ("parity", "parity public", r"parity public licen[sc]e", 1, 0.9),
    # Creative Commons and other licences for works and data
    ("cc", "creative commons", r"(?:licen[sc]ed|released|published|available) under (?:a|the) creative commons", 2, 0.7),
    ("cc", "creative commons corporation", r"creative commons corporation is not a law firm", 1, 0.85),
    ("cc-by", "commons org licen", r"creativecommons org licen[sc]es by", 1, 0.85),
    ("cc-by-2.0", "commons org licen", r"creativecommons org licen[sc]es by 2 0", 1, 0.95),
    ("cc-by-3.0", "commons org licen", r"creativecommons org licen[sc]es by 3 0", 1, 0.95),
    ("cc-by-4.0", "commons org licen", r"creativecommons org licen[sc]es by 4 0", 1, 0.95),
    ("cc-by-sa-3.0", "commons org licen", r"creativecommons org licen[sc]es by sa 3 0", 1, 0.95),
    ("cc-by-sa-4.0", "commons org licen", r"creativecommons org licen[sc]es by sa 4 0", 1, 0.95),
    ("cc-by-nc-3.0", "commons org licen", r"creativecommons org licen[sc]es by nc 3 0", 1, 0.95),
    ("cc-by-nc-4.0", "commons org licen", r"creativecommons org licen[sc]es by nc 4 0", 1, 0.95),
    ("cc-by-nc-sa-4.0", "commons org licen", r"creativecommons org licen[sc]es by nc sa 4 0", 1, 0.95),
    ("cc-by-nc-nd-4.0", "commons org licen", r"creativecommons org licen[sc]es by nc nd 4 0", 1, 0.95),
    ("cc-by-nd-4.0", "commons org licen", r"creativecommons org licen[sc]es by nd 4 0", 1, 0.95),
    ("cc0-1.0", "commons org publicdomain", r"creativecommons org publicdomain zero 1 0", 1, 0.95),
    ("public-domain", "commons org publicdomain", r"creativecommons org publicdomain mark 1 0", 1, 0.9),
    ("cc0-1.0", "waived all copyright", r"waived all copyright and related or neighboring rights", 1, 0.95),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?", 2, 0.7),
    ("cc-by-4.0", "by exercising the licen", r"by exercising the licen[sc]ed rights you accept and agree to be bound by the terms", 1, 0.8),
    ("cc-by-sa", "cc by sa", r"cc by sa", 2, 0.6),
    ("cc-by-nc", "cc by nc", r"cc by nc", 2, 0.6),
    ("cc-by-nd", "cc by nd", r"cc by nd", 2, 0.6),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa", 2, 0.65),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd", 2, 0.65),
    ("wikipedia", "text is available", r"text is available under the creative commons", 1, 0.8),
    ("stack-exchange", "user contributions licen", r"user contributions licen[sc]ed under cc by sa", 1, 0.85),
    ("odbl-1.0", "open database", r"made available under the open database licen[sc]e", 1, 0.95),
    ("odbl-1.0", "odbl", r"odbl", 2, 0.7),
    ("ogl-uk", "open government", r"open government licen[sc]e", 1, 0.9),
    ("gutenberg", "project gutenberg licen", r"under the terms of the project gutenberg licen[sc]e", 1, 0.9),
    ("lal-1.3", "free art", r"free art licen[sc]e", 1, 0.85),
    ("ofl-1.1", "reserved font name", r"with reserved font names?", 1, 0.85),
    ("cdla-permissive", "community data", r"community data licen[sc]e agreement permissive", 1, 0.95),
    ("cdla-sharing", "community data", r"community data licen[sc]e agreement sharing", 1, 0.95),
    # Source available and models
    ("commons-clause", "commons clause", r"commons clause(?: licen[sc]e)? condition", 1, 0.9),
    ("busl-1.1", "change licen", r"change licen[sc]e", 3, 0.3),
    ("busl-1.1", "additional use grant", r"additional use grant", 1, 0.85),
    ("elastic-2.0", "hosted or managed service", r"provide the software to third parties as a hosted or managed service", 1, 0.9),
    ("sspl-1.0", "functionality of the program", r"make the functionality of the program or a modified version available to third parties as a service", 1, 0.9),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[sc]e", 1, 0.95),
    ("confluent", "confluent community", r"confluent community licen[sc]e", 1, 0.9),
    ("fsl", "functional source", r"functional source licen[sc]e", 1, 0.9),
    ("rail-use", "use based restrictions", r"use based restrictions as referenced in", 1, 0.85),
    ("gemma", "gemma terms", r"gemma terms of use", 1, 0.9),
    ("llama", "llama materials", r"the llama materials", 1, 0.85),
    ("research-only", "research purposes only", r"for (?:academic )?research purposes only", 2, 0.6),
    ("research-only", "non commercial research", r"non commercial research (?:use|purposes)", 2, 0.6),
    # Public domain
    ("public-domain", "public domain", r"(?:released into|dedicated to|placed in|in) the public domain", 2, 0.7),
    ("public-domain", "public domain", r"public domain work", 2, 0.6),
    ("public-domain", "work of the united states government", r"work of the united states government", 2, 0.7),
    ("public-domain", "not subject to copyright", r"not subject to copyright(?: protection)?", 2, 0.6),
    ("public-domain", "no known copyright", r"no known copyright restrictions", 2, 0.6),
    # Closed and limited use
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 2, 0.7),
    ("proprietary", "trade secret", r"(?:contains|constitutes) (?:confidential information and )?trade secrets? of", 2, 0.6),
    ("proprietary", "proprietary software", r"this is (?:unpublished )?proprietary software", 2, 0.6),
    ("no-copying", "unauthorized copying", r"unauthorized copying of this (?:file|software|work)", 2, 0.7),
    ("no-copying", "without the prior written", r"without the prior written (?:permission|consent) of", 2, 0.5),
    ("no-copying", "no part of this", r"no part of this (?:publication|book|document|work|site|website) may be (?:reproduced|copied|used)", 2, 0.7),
    ("no-copying", "may not be reproduced", r"may not be reproduced (?:in whole or in part|without permission|in any form)", 2, 0.7),
    ("no-copying", "may not be published broadcast", r"may not be published broadcast rewritten or redistributed", 2, 0.7),
    ("no-copying", "unauthorized reproduction", r"unauthorized reproduction (?:is|or distribution)", 2, 0.6),
    ("no-training", "may not be used", r"may not be used (?:to train|for training) (?:machine learning |artificial intelligence |ai |language )?models?", 2, 0.7),
    ("non-commercial", "commercial use", r"(?:non commercial use only|not for commercial use|personal and non commercial use)", 2, 0.6),
    ("non-commercial", "commercial purposes", r"(?:for|not for) (?:any )?(?:non )?commercial purposes", 3, 0.4),
    ("personal-use", "personal use only", r"for (?:your )?personal use only", 2, 0.5),
    ("eula", "end user licen", r"end user licen[sc]e agreement", 2, 0.6),
    ("eula", "read this agreement", r"please read this agreement carefully", 3, 0.4),
    ("permission-needed", "with permission", r"(?:reprinted|reproduced|used) with permission", 3, 0.4),
    # Hints
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]", 3, 0.4),
    ("copyright-holder", "copyright", r"copyright (?:holder|owner|notice)s?", 3, 0.3),
    ("spdx-tag", "spdx", r"spdx licen[sc]e identifier", 3, 0.5),
    ("license-word", "licen", r"(?:this|the) (?:work|software|file|document|code) is licen[sc]ed", 3, 0.3),
    ("license-file", "licen", r"see (?:the )?(?:accompanying )?(?:licen[sc]e|copying)(?: txt| md)? file for licen[sc]e", 3, 0.4),
    ("license-file", "licen", r"licen[sc]e (?:that can be found|found) in the licen[sc]e file", 3, 0.4),
    ("license-file", "licen", r"see licen[sc]e(?: txt| md)? for (?:details|more information)", 3, 0.4),
    ("trademark", "trademark", r"(?:registered )?trademarks? of", 3, 0.2),
    ("no-derivatives", "derivative", r"no derivative works?", 3, 0.4),
    ("attribution-required", "attribution", r"attribution (?:is )?required", 3, 0.3),
    ("dual-license", "licen", r"dual licen[sc]ed", 3, 0.5),
    ("dual-license", "licen", r"licen[sc]ed under either of", 3, 0.5),
    ("royalty-free", "royalty free", r"(?:perpetual )?(?:worldwide )?(?:non exclusive )?(?:no charge )?royalty free", 3, 0.3),
    ("no-warranty", "warrant", r"(?:absolutely no warranty|without any warranty|no warranty of any kind)", 3, 0.3),
    ("no-warranty", "warrant", r"disclaimer of warranty", 3, 0.3),
    ("no-liability", "liab", r"limitation of liability", 3, 0.2),
)
