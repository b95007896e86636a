"""License scan: ordered signature rules over word sequences, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import documents

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and labels of the contract.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Rule families: label, keyword that every match holds, words of the rule as a regular expression over lower-case words with single
# spaces, priority (larger wins), confidence. ``{v}`` takes each version listed with the family, so the families give a few hundred rules.
_V = r"(?:version |v ?)?"
FAMILIES = [
    ("gpl", "general public license", "gnu general public license", 40, 0.9, [""]),
    ("gpl-{v}", "general public license", "(?:gnu )?general public license,? " + _V + "{v}", 60, 1.0, ["1", "2", "3", "1 0", "2 0", "3 0"]),
    ("gpl-{v}-or-later", "general public license", "(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?" + _V + "{v} (?:of the license )?or (?:at your option )?any later version", 80, 1.0, ["1", "2", "3", "2 0", "3 0"]),
    ("gpl-{v}", "gpl", "(?:gnu )?gpl " + _V + "{v}(?: 0)?(?: only)?", 60, 1.0, ["1", "2", "3"]),
    ("gpl-{v}-or-later", "gpl", "(?:gnu )?gpl " + _V + "{v}(?: 0)? or (?:any )?later(?: version)?", 80, 1.0, ["1", "2", "3"]),
    ("lgpl", "lesser general public license", "(?:gnu )?lesser general public license", 50, 1.0, [""]),
    ("lgpl", "library general public license", "(?:gnu )?library general public license", 50, 1.0, [""]),
    ("lgpl-{v}", "lesser general public license", "(?:gnu )?lesser general public license " + _V + "{v}", 70, 1.0, ["2 1", "3", "3 0"]),
    ("lgpl-{v}", "library general public license", "(?:gnu )?library general public license " + _V + "{v}", 70, 1.0, ["2", "2 0"]),
    ("lgpl-{v}-or-later", "lesser general public license", "(?:gnu )?lesser general public license " + _V + "{v} (?:of the license )?or (?:at your option )?any later version", 80, 1.0, ["2 1", "3", "3 0"]),
    ("lgpl-{v}", "lgpl", "(?:gnu )?lgpl " + _V + "{v}(?: only)?", 70, 1.0, ["2", "2 0", "2 1", "3", "3 0"]),
    ("agpl", "affero general public license", "(?:gnu )?affero general public license", 50, 1.0, [""]),
    ("agpl-{v}", "affero general public license", "(?:gnu )?affero general public license " + _V + "{v}", 70, 1.0, ["1", "3", "3 0"]),
    ("agpl-{v}", "agpl", "(?:gnu )?agpl " + _V + "{v}(?: only)?", 70, 1.0, ["1", "3", "3 0"]),
    ("gfdl", "free documentation license", "(?:gnu )?free documentation license", 50, 1.0, [""]),
    ("gfdl-{v}", "free documentation license", "(?:gnu )?free documentation license " + _V + "{v}", 70, 1.0, ["1 1", "1 2", "1 3"]),
    ("apache", "apache", "(?:the )?apache (?:software )?license", 40, 0.9, [""]),
    ("apache-{v}", "apache", "(?:the )?apache (?:software )?(?:license )?" + _V + "{v}(?: license)?", 60, 1.0, ["1 0", "1 1", "2 0"]),
    ("apache-2 0", "www apache org licenses", "http s? ?www apache org licenses license 2 0", 70, 1.0, [""]),
    ("mit", "mit license", "(?:the |expat )?mit license", 50, 1.0, [""]),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 60, 1.0, [""]),
    ("mit", "provided as is without warranty", "the software is provided as is without warranty of any kind", 30, 0.7, [""]),
    ("isc", "isc license", "(?:the )?isc license", 50, 1.0, [""]),
    ("isc", "permission to use copy modify", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee", 60, 1.0, [""]),
    ("bsd", "bsd", "(?:the )?bsd (?:style )?license", 40, 0.9, [""]),
    ("bsd-{v}-clause", "bsd", "bsd {v} clause(?: license)?", 60, 1.0, ["0", "1", "2", "3", "4"]),
    ("bsd-{v}-clause", "clause bsd", "{v} clause bsd(?: license)?", 60, 1.0, ["0", "1", "2", "3", "4"]),
    ("bsd-2-clause", "simplified bsd", "simplified bsd(?: license)?", 60, 1.0, [""]),
    ("bsd-3-clause", "bsd license", "(?:new|revised|modified) bsd license", 60, 0.9, [""]),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted", 50, 1.0, [""]),
    ("mpl", "mozilla public license", "mozilla public license", 40, 0.9, [""]),
    ("mpl-{v}", "mozilla public license", "mozilla public license " + _V + "{v}", 60, 1.0, ["1 0", "1 1", "2 0"]),
    ("mpl-{v}", "mpl", "mpl " + _V + "{v}", 60, 1.0, ["1 0", "1 1", "2 0"]),
    ("epl-{v}", "eclipse public license", "eclipse public license " + _V + "{v}", 60, 1.0, ["1 0", "2 0"]),
    ("epl", "eclipse public license", "eclipse public license", 40, 0.9, [""]),
    ("eupl-{v}", "european union public licen", "european union public licen[cs]e " + _V + "{v}", 60, 1.0, ["1 0", "1 1", "1 2"]),
    ("cddl-{v}", "common development and distribution", "common development and distribution license " + _V + "{v}", 60, 1.0, ["1 0", "1 1"]),
    ("artistic", "artistic license", "artistic license", 40, 0.9, [""]),
    ("artistic-{v}", "artistic license", "artistic license " + _V + "{v}", 60, 1.0, ["1 0", "2 0"]),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)? license", 50, 1.0, [""]),
    ("boost-1 0", "boost software license", "boost software license(?: " + _V + "1 0)?", 50, 1.0, [""]),
    ("unlicense", "unlicense", "(?:the )?unlicense", 50, 0.9, [""]),
    ("wtfpl", "do what the fuck you want", "do what the fuck you want to public license", 50, 1.0, [""]),
    ("psf-2 0", "python software foundation license", "python software foundation license(?: " + _V + "2(?: 0)?)?", 50, 1.0, [""]),
    ("openssl", "openssl license", "openssl license", 50, 1.0, [""]),
    ("ofl-{v}", "open font license", "(?:sil )?open font license " + _V + "{v}", 60, 1.0, ["1 0", "1 1"]),
    ("odbl", "open database license", "open database license", 50, 1.0, [""]),
    ("odc-by", "open data commons attribution", "open data commons attribution license", 50, 1.0, [""]),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 60, 1.0, [""]),
    ("cc0", "cc zero", "cc zero", 60, 0.9, [""]),
    ("cc-by-{v}", "cc by", "cc by {v}", 70, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", "cc by sa", "cc by sa", 60, 1.0, [""]),
    ("cc-by-sa-{v}", "cc by sa", "cc by sa {v}", 80, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", "cc by nd", "cc by nd", 60, 1.0, [""]),
    ("cc-by-nd-{v}", "cc by nd", "cc by nd {v}", 80, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", "cc by nc", "cc by nc", 60, 1.0, [""]),
    ("cc-by-nc-{v}", "cc by nc", "cc by nc {v}", 80, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", 65, 1.0, [""]),
    ("cc-by-nc-sa-{v}", "cc by nc sa", "cc by nc sa {v}", 85, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", 65, 1.0, [""]),
    ("cc-by-nc-nd-{v}", "cc by nc nd", "cc by nc nd {v}", 85, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", "creative commons attribution", "creative commons attribution(?: license)?", 50, 1.0, [""]),
    ("cc-by-{v}", "creative commons attribution", "creative commons attribution {v}(?: international| unported| generic)?(?: license)?", 70, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", "creative commons attribution share", "creative commons attribution share ?alike", 60, 1.0, [""]),
    ("cc-by-sa-{v}", "creative commons attribution share", "creative commons attribution share ?alike {v}(?: international| unported| generic)?(?: license)?", 80, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd-{v}", "creative commons attribution no", "creative commons attribution no ?derivatives {v}(?: international| unported| generic)?(?: license)?", 80, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-{v}", "creative commons attribution non", "creative commons attribution non ?commercial {v}(?: international| unported| generic)?(?: license)?", 80, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa-{v}", "creative commons attribution non", "creative commons attribution non ?commercial share ?alike {v}(?: international| unported| generic)?(?: license)?", 85, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd-{v}", "creative commons attribution non", "creative commons attribution non ?commercial no ?derivatives {v}(?: international| unported| generic)?(?: license)?", 85, 1.0, ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-{v}", "creativecommons org licenses", "creativecommons org licenses {v}(?: [1-4] [05])?", 85, 1.0, ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]),
    ("public-domain", "public domain", "(?:in|into|to|under) the public domain(?: dedication)?", 40, 0.8, [""]),
    ("spdx-{v}", "spdx license identifier", "spdx license identifier {v}", 90, 1.0, ["mit", "isc", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "mpl 2 0", "epl 2 0", "cc0 1 0", "unlicense", "zlib", "0bsd", "bsd 4 clause", "artistic 2 0", "bsl 1 0", "wtfpl", "cddl 1 0", "eupl 1 2", "ofl 1 1",
        "cc by 4 0", "cc by sa 4 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 or later", "psf 2 0", "python 2 0", "postgresql", "ncsa", "x11", "curl"]),
    ("reserved", "reserved", "(?:all|some) rights (?:are )?reserved", 30, 0.8, [""]),
    ("copyright-notice", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 20, 0.4, [""]),
    ("proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)", 45, 0.9, [""]),
    ("proprietary", "prior written", "without (?:the )?prior written (?:permission|consent)", 35, 0.6, [""]),
    ("eula", "end user license agreement", "end user license agreement", 45, 0.9, [""]),
    ("license-notice", "licensed under", "licensed under(?: the)?(?: terms of)?", 10, 0.3, [""]),
]

# Further rules, one written pattern each: label, keyword, pattern, priority, confidence. Patterns are over lower-case words with single spaces.
WRITTEN = [
    ("0bsd", "zero clause bsd", "(?:the )?zero clause bsd(?: license)?", 60, 1.0),
    ("0bsd", "free public license", "free public license(?: 1 0 0)?", 60, 0.9),
    ("aal", "attribution assurance license", "attribution assurance license", 50, 1.0),
    ("afl", "academic free license", "(?:the )?academic free license", 45, 0.9),
    ("afl-3.0", "academic free license", "academic free license (?:version |v ?)?3 0", 60, 1.0),
    ("afl-2.1", "academic free license", "academic free license (?:version |v ?)?2 1", 60, 1.0),
    ("afl-2.0", "academic free license", "academic free license (?:version |v ?)?2 0", 60, 1.0),
    ("afl-1.1", "academic free license", "academic free license (?:version |v ?)?1 1", 60, 1.0),
    ("apsl", "apple public source license", "apple public source license", 45, 0.9),
    ("apsl-2.0", "apple public source license", "apple public source license (?:version |v ?)?2 0", 60, 1.0),
    ("apsl-1.2", "apple public source license", "apple public source license (?:version |v ?)?1 2", 60, 1.0),
    ("apple-sample-code", "apple grants you", "in consideration of your agreement to abide by the following terms (?:and subject to these terms )?apple grants you", 55, 0.9),
    ("apl-1.0", "adaptive public license", "adaptive public license(?: 1 0)?", 50, 1.0),
    ("beerware", "beer ware license", "(?:the )?beer ware license(?: revision 42)?", 55, 1.0),
    ("bittorrent-1.1", "bittorrent open source license", "bittorrent open source license(?: version 1 1)?", 55, 1.0),
    ("bsd-3-clause-lbnl", "lawrence berkeley", "lawrence berkeley national labs? bsd(?: variant)? license", 60, 1.0),
    ("bsd-3-clause-clear", "clear bsd license", "(?:the )?clear bsd license", 62, 1.0),
    ("bsd-patent", "bsd", "bsd (?:2 clause )?plus patent license", 62, 1.0),
    ("bsd-4-clause", "bsd", "(?:original|old) bsd license", 60, 0.9),
    ("bsd-4-clause", "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 65, 1.0),
    ("bsd-3-clause", "may be used to endorse or promote", "neither the name of (?:the )?(?:copyright holder|author|university|company|organization) nor the names of (?:its|their|the) contributors may be used to endorse or promote", 55, 0.9),
    ("bsd-disclaimer", "by the copyright holders and contributors as is", "this software is provided by the copyright holders and contributors as is", 35, 0.7),
    ("busl-1.1", "business source license", "business source license 1 1", 60, 1.0),
    ("busl", "business source license", "business source license", 45, 0.9),
    ("bzip2", "bzip2", "bzip2 (?:and libbzip2 )?license", 50, 1.0),
    ("caldera", "caldera license", "caldera license", 45, 0.8),
    ("catosl-1.1", "computer associates trusted open source license", "computer associates trusted open source license(?: version)?(?: 1 1)?", 55, 1.0),
    ("cc-pddc", "creative commons public domain", "creative commons public domain dedication(?: and certification)?", 60, 1.0),
    ("cc0-1.0", "cc0", "creative commons (?:legal code )?cc0 1 0 universal", 70, 1.0),
    ("cc0", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0", 70, 1.0),
    ("cc-mark", "creativecommons org publicdomain mark", "creativecommons org publicdomain mark 1 0", 70, 1.0),
    ("cc-sampling", "creative commons sampling", "creative commons sampling plus?(?: 1 0)?", 60, 0.9),
    ("cdla-permissive-1.0", "community data license agreement", "community data license agreement permissive(?: version)?(?: 1 0)?", 60, 1.0),
    ("cdla-permissive-2.0", "community data license agreement", "community data license agreement permissive(?: version)? 2 0", 70, 1.0),
    ("cdla-sharing-1.0", "community data license agreement", "community data license agreement sharing(?: version)?(?: 1 0)?", 60, 1.0),
    ("cecill", "cecill", "(?:the )?cecill (?:free software )?license(?: agreement)?", 50, 0.9),
    ("cecill-2.1", "cecill", "cecill (?:version |v ?)?2 1", 60, 1.0),
    ("cecill-2.0", "cecill", "cecill (?:version |v ?)?2(?: 0)?", 58, 1.0),
    ("cecill-b", "cecill b", "cecill b(?: free software)?(?: license)?(?: agreement)?", 60, 1.0),
    ("cecill-c", "cecill c", "cecill c(?: free software)?(?: license)?(?: agreement)?", 60, 1.0),
    ("cern-ohl", "cern open hardware", "cern open hardware licen[cs]e", 50, 0.9),
    ("cern-ohl-p-2.0", "cern ohl p", "cern ohl p(?: v ?2)?", 60, 1.0),
    ("cern-ohl-s-2.0", "cern ohl s", "cern ohl s(?: v ?2)?", 60, 1.0),
    ("cern-ohl-w-2.0", "cern ohl w", "cern ohl w(?: v ?2)?", 60, 1.0),
    ("clartistic", "clarified artistic license", "clarified artistic license", 60, 1.0),
    ("cnri-python", "cnri python license", "cnri python license(?: agreement)?", 55, 1.0),
    ("commercial", "commercial license", "(?:under|requires?|with) a commercial license", 30, 0.6),
    ("condor-1.1", "condor public license", "condor public license(?: version)?(?: 1 1)?", 55, 1.0),
    ("cpal-1.0", "common public attribution license", "common public attribution license(?: version)?(?: 1 0)?", 55, 1.0),
    ("cpl-1.0", "common public license", "common public license(?: version| v)?(?: 1 0)?", 50, 1.0),
    ("cpol-1.02", "code project open license", "(?:the )?code project open license(?: 1 02)?", 55, 1.0),
    ("cua-opl-1.0", "cua office public license", "cua office public license(?: version)?(?: 1 0)?", 55, 1.0),
    ("curl", "curl license", "(?:the )?curl license", 50, 1.0),
    ("d-fsl-1.0", "deutsche freie software lizenz", "deutsche freie software lizenz", 55, 1.0),
    ("drl-1.0", "detection rule license", "detection rule license(?: drl)?(?: 1 0| 1 1)?", 55, 1.0),
    ("ecl-1.0", "educational community license", "educational community license(?: version| v)? 1 0", 60, 1.0),
    ("ecl-2.0", "educational community license", "educational community license(?: version| v)? 2 0", 60, 1.0),
    ("ecos-2.0", "ecos license", "ecos license(?: version)?(?: 2 0)?", 50, 1.0),
    ("efl-2.0", "eiffel forum license", "eiffel forum license(?: version| v)?(?: 2)?", 55, 1.0),
    ("elastic-2.0", "elastic license", "elastic license(?: version| v)?(?: 2 0)?", 55, 1.0),
    ("entessa", "entessa public license", "entessa public license(?: version)?(?: 1 0)?", 55, 1.0),
    ("erlpl-1.1", "erlang public license", "erlang public license(?: version)?(?: 1 1)?", 55, 1.0),
    ("etalab-2.0", "etalab", "(?:etalab open licen[cs]e|licence ouverte etalab)(?: 2 0)?", 55, 1.0),
    ("eudatagrid", "eu datagrid software license", "eu datagrid software license", 55, 1.0),
    ("fair", "fair license", "(?:the )?fair license", 40, 0.7),
    ("frameworx-1.0", "frameworx open license", "frameworx open license(?: 1 0)?", 55, 1.0),
    ("freetype", "freetype", "(?:the )?freetype (?:project )?license", 55, 1.0),
    ("fsf-all-permissive", "copying and distribution of this file", "copying and distribution of this file with or without modification are permitted in any medium without royalty", 60, 1.0),
    ("fsl-1.1", "functional source license", "functional source license(?: version)?(?: 1 1)?", 55, 1.0),
    ("gl2ps", "gl2ps license", "gl2ps license", 50, 1.0),
    ("gpl-warranty", "without even the implied warranty of", "without even the implied warranty of merchantability or fitness for a particular purpose", 25, 0.5),
    ("gpl-notice", "free software foundation", "(?:redistribute|distribute) it and or modify it under the terms of the gnu general public license as published by the free software foundation", 62, 1.0),
    ("gpl-exception", "classpath exception", "(?:with )?(?:the )?classpath exception(?: 2 0)?", 55, 0.9),
    ("gpl-exception", "gcc runtime library exception", "gcc runtime library exception(?: 3 1)?", 55, 0.9),
    ("gpl-exception", "autoconf exception", "autoconf exception(?: 2 0| 3 0)?", 55, 0.9),
    ("gpl-exception", "bison exception", "bison exception(?: 2 2)?", 55, 0.9),
    ("gpl-exception", "font exception", "(?:gpl )?font exception(?: 2 0)?", 50, 0.8),
    ("gpl-exception", "linking exception", "(?:static |gpl )?linking exception", 45, 0.7),
    ("gust-font", "gust font license", "gust font license", 55, 1.0),
    ("hpnd", "historical permission notice and disclaimer", "historical permission notice and disclaimer", 60, 1.0),
    ("hpnd", "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation", 50, 0.9),
    ("ibm-ipl-1.0", "ibm public license", "ibm public license(?: version)?(?: 1 0)?", 55, 1.0),
    ("icu", "icu license", "(?:the )?icu license", 50, 1.0),
    ("ijg", "independent jpeg group", "based in part on the work of the independent jpeg group", 60, 1.0),
    ("imagemagick", "imagemagick license", "(?:the )?imagemagick license", 55, 1.0),
    ("imlib2", "imlib2 license", "imlib2 license", 50, 1.0),
    ("intel-open-source", "intel open source license", "intel open source license", 55, 1.0),
    ("ipa", "ipa font license", "ipa font license(?: agreement)?(?: v1 0)?", 55, 1.0),
    ("jasper-2.0", "jasper license", "jasper license(?: version)?(?: 2 0)?", 50, 1.0),
    ("json", "good not evil", "(?:the )?software shall be used for good not evil", 60, 1.0),
    ("json", "json license", "(?:the )?json license", 50, 1.0),
    ("kastrup", "kastrup license", "kastrup license", 45, 0.8),
    ("lal-1.3", "licence art libre", "licence art libre(?: 1 3)?", 55, 1.0),
    ("lal", "free art license", "free art license(?: 1 3)?", 55, 1.0),
    ("libpng-2.0", "libpng license", "(?:the )?libpng license(?: version)?(?: 2)?", 55, 1.0),
    ("libtiff", "libtiff license", "libtiff license", 50, 1.0),
    ("liliq-p-1.1", "licence libre du quebec permissive", "licence libre du quebec permissive", 55, 1.0),
    ("lpl-1.02", "lucent public license", "lucent public license(?: version)?(?: 1 02| 1 0)?", 55, 1.0),
    ("lppl", "latex project public license", "latex project public license", 45, 0.9),
    ("lppl-1.3c", "latex project public license", "latex project public license(?: version| v)? 1 3c?", 60, 1.0),
    ("lppl-1.0", "latex project public license", "latex project public license(?: version| v)? 1 0", 60, 1.0),
    ("miros", "miros licen", "miros licen[cs]e", 50, 1.0),
    ("mit-0", "mit no attribution", "mit no attribution(?: license)?", 60, 1.0),
    ("mit-modern", "modern variant", "mit (?:license )?modern variant", 60, 1.0),
    ("mit", "dealt with in the software", "dealt with in the software without restriction", 40, 0.6),
    ("mit", "deal in the software without restriction", "to deal in the software without restriction including without limitation the rights", 58, 1.0),
    ("mit", "the above copyright notice and this permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 55, 0.9),
    ("motosoto", "motosoto open source license", "motosoto open source license", 55, 1.0),
    ("mpl-notice", "source code form is subject to", "this source code form is subject to the terms of the mozilla public license v 2 0", 65, 1.0),
    ("ms-lpl", "microsoft limited public license", "microsoft limited public license", 55, 1.0),
    ("ms-pl", "microsoft public license", "microsoft public license(?: ms pl)?", 55, 1.0),
    ("ms-rl", "microsoft reciprocal license", "microsoft reciprocal license(?: ms rl)?", 55, 1.0),
    ("ms-eula", "microsoft software license terms", "microsoft software license terms", 50, 0.9),
    ("mulanpsl-1.0", "mulan permissive software license", "mulan permissive software license(?: version| v)? ?1", 60, 1.0),
    ("mulanpsl-2.0", "mulan permissive software license", "mulan permissive software license(?: version| v)? ?2", 60, 1.0),
    ("multics", "multics license", "multics license", 50, 0.9),
    ("nasa-1.3", "nasa open source agreement", "nasa open source agreement(?: version)?(?: 1 3)?", 55, 1.0),
    ("naumen", "naumen public license", "naumen public license", 55, 1.0),
    ("ncsa", "university of illinois", "university of illinois (?:ncsa )?open source license", 60, 1.0),
    ("ngpl", "nethack general public license", "nethack general public license", 65, 1.0),
    ("nokos-1.0a", "nokia open source license", "nokia open source license(?: version)?(?: 1 0a)?", 55, 1.0),
    ("nosl-3.0", "netizen open source license", "netizen open source license", 55, 1.0),
    ("npl-1.1", "netscape public license", "netscape public license(?: version)?(?: 1 1| 1 0)?", 55, 1.0),
    ("npo-sl-3.0", "non profit open software license", "non profit open software license(?: 3 0)?", 65, 1.0),
    ("ntp", "ntp license", "(?:the )?ntp license", 50, 1.0),
    ("oclc-2.0", "oclc research public license", "oclc research public license(?: version)?(?: 2 0)?", 55, 1.0),
    ("odc-pddl", "public domain dedication and license", "(?:odc |open data commons )?public domain dedication and license(?: pddl)?", 62, 1.0),
    ("ofl", "open font license", "(?:sil )?open font license", 45, 0.9),
    ("ogl", "open government licen", "open government licen[cs]e(?: version| v)?(?: 1 0| 2 0| 3 0)?", 55, 1.0),
    ("ogl-game", "open game license", "open game license(?: version)?(?: 1 0a)?", 55, 1.0),
    ("oldap", "openldap public license", "openldap public license(?: version)?(?: 2 8)?", 55, 1.0),
    ("opl-1.0", "open publication license", "open publication license(?: version| v)?(?: 1 0)?", 55, 1.0),
    ("oset-pl-2.1", "oset public license", "oset public license(?: version)?(?: 2 1)?", 55, 1.0),
    ("osl", "open software license", "(?:the )?open software license", 45, 0.9),
    ("osl-3.0", "open software license", "open software license(?: version| v)? ?3 0", 60, 1.0),
    ("osl-2.1", "open software license", "open software license(?: version| v)? ?2 1", 60, 1.0),
    ("oracle-bcl", "oracle binary code license", "oracle binary code license agreement", 55, 1.0),
    ("parity-7.0", "parity public license", "(?:the )?parity public license(?: 7 0 0)?", 55, 1.0),
    ("php-3.01", "php license", "(?:the )?php license(?: version| v)? ?3 01", 60, 1.0),
    ("php-3.0", "php license", "(?:the )?php license(?: version| v)? ?3 0", 58, 1.0),
    ("php", "php license", "(?:the )?php license", 45, 0.9),
    ("polyform-nc-1.0", "polyform noncommercial license", "polyform noncommercial license(?: 1 0 0)?", 55, 1.0),
    ("polyform-sb-1.0", "polyform small business license", "polyform small business license(?: 1 0 0)?", 55, 1.0),
    ("postgresql", "postgresql licen", "(?:the )?postgresql licen[cs]e", 55, 1.0),
    ("python-2.0", "psf license agreement for python", "psf license agreement for python(?: [23] [0-9])?", 60, 1.0),
    ("qhull", "qhull license", "qhull license", 50, 1.0),
    ("qpl-1.0", "q public license", "(?:the )?q public license(?: version)?(?: 1 0)?", 55, 1.0),
    ("rpl-1.5", "reciprocal public license", "reciprocal public license(?: version)?(?: 1 5| 1 1)?", 55, 1.0),
    ("rpsl-1.0", "realnetworks public source license", "realnetworks public source license(?: version)?(?: 1 0)?", 55, 1.0),
    ("rscpl", "ricoh source code public license", "ricoh source code public license", 55, 1.0),
    ("ruby", "ruby license", "(?:the )?ruby license", 50, 0.9),
    ("sgi-b-2.0", "sgi free software license b", "sgi free software license b(?: version)?(?: 2 0| 1 1)?", 60, 1.0),
    ("simpl-2.0", "simple public license", "simple public license(?: 2 0)?", 50, 0.9),
    ("sissl", "sun industry standards source license", "sun industry standards source license(?: version)?(?: 1 1| 1 2)?", 55, 1.0),
    ("sleepycat", "sleepycat license", "(?:the )?sleepycat license", 55, 1.0),
    ("spl-1.0", "sun public license", "sun public license(?: version)?(?: 1 0)?", 55, 1.0),
    ("sspl-1.0", "server side public license", "server side public license(?: version| v)?(?: 1)?", 60, 1.0),
    ("tcl", "tcl tk license", "tcl tk license", 50, 1.0),
    ("tcp-wrappers", "tcp wrappers license", "tcp wrappers license", 50, 1.0),
    ("ucl-1.0", "upstream compatibility license", "upstream compatibility license(?: version| v)?(?: 1 0)?", 55, 1.0),
    ("unicode", "unicode license", "unicode license(?: agreement)?(?: v ?3)?", 55, 1.0),
    ("unlicense", "released into the public domain", "free and unencumbered software released into the public domain", 65, 1.0),
    ("upl-1.0", "universal permissive license", "universal permissive license(?: version| v)?(?: 1 0)?", 55, 1.0),
    ("vim", "vim license", "(?:the )?vim license", 50, 1.0),
    ("vostrom", "vostrom public license", "vostrom public license", 55, 1.0),
    ("vsl-1.0", "vovida software license", "vovida software license(?: version| v)?(?: 1 0)?", 55, 1.0),
    ("w3c", "w3c software", "w3c software (?:and document )?(?:notice and )?license", 55, 1.0),
    ("watcom-1.0", "sybase open watcom public license", "sybase open watcom public license(?: version)?(?: 1 0)?", 55, 1.0),
    ("wxwindows", "wxwindows library licen", "wxwindows library licen[cs]e(?: version)?(?: 3 1)?", 60, 1.0),
    ("x11", "x11 license", "(?:the )?x11 license", 50, 1.0),
    ("xfree86-1.1", "xfree86 license", "(?:the )?xfree86 license(?: 1 1)?", 55, 1.0),
    ("xnet", "x net license", "x net license", 45, 0.9),
    ("ypl-1.1", "yahoo public license", "yahoo public license(?: version)?(?: 1 1| 1 0)?", 55, 1.0),
    ("zend-2.0", "zend license", "zend license(?: version| v)?(?: 2 0)?", 50, 1.0),
    ("zimbra-1.4", "zimbra public license", "zimbra public license(?: version)?(?: 1 4| 1 3)?", 55, 1.0),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such", 58, 1.0),
    ("zpl-2.1", "zope public license", "zope public license(?: version| v)?(?: 2 1| 2 0| 1 1)?", 55, 1.0),
    ("no-warranty", "express or implied", "without (?:any )?warranty(?: of any kind)? (?:either )?express or implied", 25, 0.5),
    ("no-redistribution", "not redistribute", "(?:may|do|must) not redistribute(?: this)?(?: software| file| work)?", 35, 0.7),
    ("non-commercial", "non commercial use only", "(?:for )?non commercial use only", 40, 0.8),
    ("non-commercial", "personal use only", "(?:for )?(?:your )?(?:private |own )?personal use only", 35, 0.7),
    ("copyright-symbol", "copyright", "copyright (?:c )?by", 15, 0.3),
    ("dual-license", "dual licensed", "dual licensed(?: under)?", 30, 0.6),
    ("license-file", "see the license file", "see the license file(?: for details)?", 20, 0.5),
    ("license-file", "license for the specific language governing", "see the license for the specific language governing permissions and limitations", 45, 0.9),
    ("apache-2.0", "you may not use this file except in compliance", "you may not use this file except in compliance with the license", 50, 0.9),
]

#: Every keyword holds one of these, so one pass decides for most texts that no rule applies.
GATE = ["licen", "lizenz", "apple grants", "bzip2", "etalab", "free software foundation", "freetype", "lawrence berkeley", "source code form", "university of illinois", "w3c software", "exception", "bsd", "cecill", "cern o", "without royalty", "warranty", "jpeg group", "historical permission", "good not evil", "deal", "nasa open source", "mit no attribution", "modern variant", "to endorse or promote",
        "advertising materials mentioning", "contributors as is", "in consideration of your agreement", "this file", "altered source", "redistribute", "use only", "notice",  "reserved", "copyright", "public domain", "proprietary", "prior written", "cc by", "cc0", "cc zero", "permission ", "provided as is", "redistribution and", "bsd", "gpl",
        "mpl", "apache", "creativecommons", "creative commons", "zlib", "do what the fuck", "open data commons", "common development"]


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """The ordered rules: ``(rule, label, keyword, pattern, priority, confidence)``; an earlier rule wins among equals."""
    out = []
    for label, keyword, pattern, priority, confidence, versions in FAMILIES:
        for v in versions:
            body = pattern.replace("{v}", v).strip()
            out.append((len(out), label.replace("{v}", v).replace(" ", "." if v[:1].isdigit() else "-"), keyword, f"(?<= ){body}(?= )", priority, confidence))
    return out + [(len(out) + k, label, keyword, f"(?<= )(?:{pattern})(?= )", priority, confidence) for k, (label, keyword, pattern, priority, confidence) in enumerate(WRITTEN)]


#: No match has more words than this, so a detection is contained at most by one that starts within as many words before it.
REACH = 64


def word_text(text: Column) -> Column:
    """Words of the text in lower case, each after one space, with a space at the end ("" has none)."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK, " ")), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _spans(words: str, pattern: str) -> str:
    """SQL for the matches of a pattern column: array of ``(first, last)`` word numbers, from the texts between matches.

    Word counts are added up in runs of 256 matches and over the runs, so the work is in proportion to the matches of any text that fits a row.
    """
    spaces = lambda x: f"length({x}) - length(replace({x}, ' ', ''))"
    steps = f"""transform(filter(zip_with(split({words}, {pattern}, -1), regexp_extract_all({words}, {pattern}, 0), (g, h) -> struct(g AS gap, h AS hit)), x -> x.hit IS NOT NULL),
        x -> struct({spaces("x.gap")} AS before, {spaces("x.hit")} AS own))"""
    runs = f"transform(array({steps}), s -> transform(sequence(0, greatest(0, size(s) - 1) DIV 256), k -> slice(s, k * 256 + 1, 256)))[0]"
    started = f"""aggregate({runs}, struct(0 AS at, cast(array() AS array<struct<at: int, run: array<struct<before: int, own: int>>>>) AS runs),
        (a, r) -> struct(a.at + aggregate(r, 0, (n, x) -> n + x.before + x.own) AS at, array_append(a.runs, struct(a.at AS at, r AS run)) AS runs), a -> a.runs)"""
    return f"""flatten(transform({started}, b -> aggregate(b.run, struct(b.at AS at, cast(array() AS array<struct<first: int, last: int>>) AS spans),
        (a, x) -> struct(a.at + x.before + x.own AS at, array_append(a.spans, named_struct('first', a.at + x.before - 1, 'last', a.at + x.before + x.own - 1)) AS spans), a -> a.spans)))"""


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``.

    ``detections`` holds the rules left after suppression: a detection goes when another one's word interval contains it and that
    one has the higher priority, or the same priority and a longer interval or an earlier rule. Base phrases always keep
    their labels. ``score`` is the largest confidence of what is left (1 for a base phrase). A null or empty text has no words and no labels;
    repeated rows each get a row. Only texts that hold a keyword meet the rules, and only the rules of keywords that they hold.
    """
    keywords = sorted({r[2] for r in rules()} | {p for p, _ in BASE})
    held = F.array_compact(F.array(*[F.when(F.col("words").contains(k), F.lit(k)) for k in keywords]))
    d = documents(docs, "text").select("doc_id", word_text(F.col("text")).alias("words"))
    gate = reduce(or_, [F.col("words").contains(g) for g in GATE])
    n = F.when(F.col("words") == "  ", F.lit(0)).otherwise(_spaces(F.col("words")) - 1)
    d = d.select("doc_id", "words", n.cast("long").alias("n_words"), F.when(gate, held).otherwise(F.array().cast("array<string>")).alias("held"))
    constants = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(lb).alias("label"), F.lit(k).alias("keyword"), F.lit(p).alias("pattern"), F.lit(pr).alias("priority"), F.lit(c).alias("confidence")) for r, lb, k, p, pr, c in rules()])
    base = F.array(*[F.struct(F.lit(lb).alias("label"), F.concat(F.lit("(?<= )"), F.lit(p), F.lit("(?= )")).alias("pattern")) for p, lb in BASE])
    some = F.size("held") > 0
    d = d.withColumn("rules", F.when(some, F.filter(constants, lambda r: F.array_contains(F.col("held"), r["keyword"]))))
    d = d.withColumn("found", F.expr(f"flatten(transform(rules, r -> transform({_spans('words', 'r.pattern')}, s -> struct(s.first AS first, s.last AS last, r.rule AS rule, r.label AS label, r.priority AS priority, r.confidence AS confidence))))"))
    d = d.withColumn("base", F.when(some, base)).withColumn("places", F.expr(f"flatten(transform(base, b -> transform({_spans('words', 'b.pattern')}, s -> struct(s.first AS first, b.label AS label))))"))
    base_labels = F.array_join(F.coalesce(F.array_sort(F.array_distinct(F.expr("transform(places, p -> p.label)"))), F.array().cast("array<string>")), ",")
    d = d.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.greatest(F.coalesce(F.size("places"), F.lit(0)), F.lit(0)).cast("long").alias("n_base"),
        F.expr("array_min(transform(places, p -> p.first))").cast("long").alias("first_word"), F.expr("array_max(transform(places, p -> p.first))").cast("long").alias("last_word"),
        base_labels.alias("base_labels"), "found")
    return _suppressed(d)


def _suppressed(d: DataFrame) -> DataFrame:
    """Detections left of each row's ``found``. They meet by stretches of ``REACH`` words: what contains a detection starts in its own stretch or in the one
    before, so a text with very many of them is spread over tasks and none is compared with all others."""
    own = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    at = F.floor(F.col("x.first") / REACH)
    places = F.when(F.col("x").isNull(), F.array(F.struct(F.lit(-1).cast("long").alias("part"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(at.alias("part"), F.lit(True).alias("own")), F.struct((at + 1).alias("part"), F.lit(False).alias("own"))))
    rows = d.select(*own, F.explode_outer("found").alias("x")).select(*own, "x", F.explode(places).alias("p"))
    met = rows.groupBy(*own, "p.part").agg(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("x.*", F.col("p.own").alias("own")))).alias("peers"))
    left = F.expr(
        "filter(peers, d -> d.own AND NOT exists(peers, e -> e.rule <> d.rule AND e.first <= d.first AND e.last >= d.last AND (e.priority > d.priority OR e.priority = d.priority"
        " AND (e.last - e.first > d.last - d.first OR e.last - e.first = d.last - d.first AND e.rule < d.rule))))")
    kept = F.transform(left, lambda x: x.dropFields("own"))
    d = met.select(*own, kept.alias("kept")).groupBy(*own).agg(F.sort_array(F.flatten(F.collect_list("kept"))).alias("detections"))
    known = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_sort(F.array_distinct(F.concat(known, F.expr("transform(detections, d -> d.label)"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.expr("array_max(transform(detections, d -> d.confidence))"), F.lit(0.0)))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(labels, ",").alias("labels"), score.alias("score"), "detections")
