"""Ordered licence signatures: a keyword that gates each rule, a pattern, a label and a priority.

A gate stands in every text that its pattern matches, and at the start of a word.

Patterns run on a text's lower-cased words, joined by one space. Each licence has one line: label,
gate keyword, name pattern, and words of its short identifier ("" where it has none). The four forms
below make an identifier rule, a grant rule, a bare-name rule and a weak "released under" rule of each.
"""

LICENSES = [
    # label, gate, name, identifier
    ("mit", "mit", r"mit(?: expat)?", "mit"),
    ("mit-0", "mit", r"mit no attribution", "mit 0"),
    ("x11", "x11", r"x11", "x11"),
    ("isc", "isc", r"isc", "isc"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: license)? version 1 0", "apache 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)? version 1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)? 2 0", "apache 2 0"),
    ("apache", "apache", r"apache(?: software)?", ""),
    ("bsd-0-clause", "bsd", r"(?:zero|0) clause bsd", "0bsd"),
    ("bsd-1-clause", "bsd", r"(?:one|1) clause bsd", "bsd 1 clause"),
    ("bsd-2-clause", "bsd", r"(?:(?:two|2) clause|simplified|freebsd) bsd", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:three|3) clause|new|revised|modified) bsd", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:(?:four|4) clause|original|old) bsd", "bsd 4 clause"),
    ("bsd", "bsd", r"bsd(?: style)?", "bsd"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? 1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? 2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? 3(?: 0)?", "gpl 3 0"),
    ("gpl-short-2", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?", "gpl 2 0 only"),
    ("gpl-short-3", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?", "gpl 3 0 only"),
    ("gpl-2.0-later", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)? or (?:any )?later", "gpl 2 0 or later"),
    ("gpl-3.0-later", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)? or (?:any )?later", "gpl 3 0 or later"),
    ("gpl", "gpl", r"(?:gnu )?gpl", "gpl"),
    ("lgpl-2.0", "general public", r"(?:gnu )?(?:lesser|library) general public license(?: version)? 2(?: 0)?", "lgpl 2 0"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: version)? 2 1", "lgpl 2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: version)? 3(?: 0)?", "lgpl 3 0"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public", "lgpl"),
    ("lgpl-library", "library general", r"(?:gnu )?library general public", "lgpl 2 0 only"),
    ("lgpl-short", "lgpl", r"(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?", "lgpl 3 0 only"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version)? 3(?: 0)?", "agpl 3 0"),
    ("agpl", "affero", r"(?:gnu )?affero general public", "agpl"),
    ("agpl-short", "agpl", r"(?:gnu )?agpl(?: ?v?3(?: 0)?)?", "agpl 3 0 only"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", "gfdl 1 3"),
    ("mpl-1.0", "mozilla", r"mozilla public license(?: version)? 1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version| v)? 2 0", "mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public", "mpl"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version| v)? 1 0", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version| v)? 2 0", "epl 2 0"),
    ("epl", "eclipse", r"eclipse public", "epl"),
    ("edl", "eclipse", r"eclipse distribution", "edl 1 0"),
    ("cpl", "common public", r"common public", "cpl 1 0"),
    ("cpal", "attribution", r"common public attribution", "cpal 1 0"),
    ("cddl-1.0", "common development", r"common development and distribution license(?: version)? 1 0", "cddl 1 0"),
    ("cddl-1.1", "common development", r"common development and distribution license(?: version)? 1 1", "cddl 1 1"),
    ("cddl", "common development", r"common development and distribution", "cddl"),
    ("eupl", "european union", r"european union public", "eupl 1 2"),
    ("eupl-short", "eupl", r"eupl(?: ?v?1 [012])?", "eupl 1 1"),
    ("ms-pl", "microsoft", r"microsoft public", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal", "ms rl"),
    ("artistic-1.0", "artistic", r"artistic license(?: version)? 1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? 2 0", "artistic 2 0"),
    ("artistic", "artistic", r"artistic", "artistic"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", r"libpng", "libpng"),
    ("openssl", "openssl", r"openssl", "openssl"),
    ("curl", "curl", r"curl", "curl"),
    ("python", "python", r"python software foundation", "psf 2 0"),
    ("php", "php", r"php", "php 3 01"),
    ("ruby", "ruby", r"ruby", "ruby"),
    ("perl", "perl", r"perl(?: 5)?", "artistic 1 0 perl"),
    ("boost", "boost", r"boost software", "bsl 1 0"),
    ("busl", "business source", r"business source", "busl 1 1"),
    ("sspl", "server side", r"server side public", "sspl 1 0"),
    ("elastic", "elastic", r"elastic", "elastic 2 0"),
    ("unlicense", "unlicense", r"unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)?(?: open source)?", "ncsa"),
    ("afl", "academic free", r"academic free", "afl 3 0"),
    ("osl", "open software", r"open software", "osl 3 0"),
    ("apsl", "apple", r"apple public source", "apsl 2 0"),
    ("ibm", "ibm", r"ibm public", "ipl 1 0"),
    ("intel", "intel", r"intel open source", "intel"),
    ("nasa", "nasa", r"nasa open source", "nasa 1 3"),
    ("postgresql", "postgresql", r"postgresql", "postgresql"),
    ("qpl", "q public", r"q public", "qpl 1 0"),
    ("sil-ofl", "open font", r"(?:sil )?open font", "ofl 1 1"),
    ("sleepycat", "sleepycat", r"sleepycat", "sleepycat"),
    ("vim", "vim", r"vim", "vim"),
    ("w3c", "w3c", r"w3c(?: software)?", "w3c"),
    ("zpl", "zope", r"zope public", "zpl 2 1"),
    ("lppl", "latex", r"latex project public", "lppl 1 3c"),
    ("icu", "icu", r"icu", "icu"),
    ("unicode", "unicode", r"unicode", "unicode dfs 2016"),
    ("json", "json", r"json", "json"),
    ("odbl", "open database", r"open database", "odbl 1 0"),
    ("odc-by", "open data commons", r"open data commons attribution", "odc by 1 0"),
    ("pddl", "public domain dedication", r"public domain dedication and", "pddl 1 0"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", "cc by", r"cc by(?: [1234] [05])?", "cc by 4 0"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1234] [05])?", "cc by sa 4 0"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1234] [05])?", "cc by nd 4 0"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1234] [05])?", "cc by nc 4 0"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1234] [05])?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1234] [05])?", "cc by nc nd 4 0"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1234] [05])?(?: international)?", ""),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1234] [05])?(?: international)?", ""),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?(?: international)?", ""),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1234] [05])?(?: international)?", ""),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international)?", ""),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?(?: international)?", ""),
    ("creative-commons", "creative commons", r"creative commons", ""),
]

PHRASES = [
    # label, gate, pattern, priority, score
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0, 0.95),
    ("mit", "the above copyright", r"the above copyright notice and this permission notice shall be included", 1, 0.9),
    ("isc", "permission to use", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee", 0, 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 0, 0.95),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 1, 0.9),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 1, 0.9),
    ("bsd-3-clause", "neither the name", r"neither the name of(?: [^ ]++){1,50}? nor the names of its contributors may be used", 0, 0.95),
    ("bsd-4-clause", "all advertising", r"all advertising materials mentioning features or use of this software", 0, 0.95),
    ("apache-2.0", "compliance with the license", r"you may not use this file except in compliance with the license", 0, 0.95),
    ("apache-2.0", "apache org", r"apache org licenses license 2 0", 0, 0.95),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public", 0, 0.95),
    ("gpl", "gnu org", r"gnu org licenses gpl", 1, 0.9),
    ("lgpl", "gnu org", r"gnu org licenses lgpl", 1, 0.9),
    ("agpl", "gnu org", r"gnu org licenses agpl", 1, 0.9),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public", 0, 0.95),
    ("mpl", "mozilla org", r"mozilla org mpl", 1, 0.9),
    ("zlib", "without any express", r"this software is provided as is without any express or implied warranty in no event will the authors", 0, 0.95),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0, 0.95),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|in to|to) the public domain", 1, 0.8),
    ("public-domain", "public domain", r"public domain", 3, 0.5),
    ("wtfpl", "do what the", r"do what the [a-z]+ you want to public license", 0, 0.95),
    ("cc-by", "creativecommons", r"creativecommons org licenses by", 0, 0.95),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa", 0, 0.95),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd", 0, 0.95),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc", 0, 0.95),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa", 0, 0.95),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd", 0, 0.95),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero", 0, 0.95),
    ("proprietary", "all rights reserved", r"all rights reserved", 3, 0.5),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 1, 0.9),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|distribution|reproduction)(?: [^ ]++){0,50}? is (?:strictly )?prohibited", 1, 0.9),
    ("proprietary", "permission", r"(?:reproduced|redistributed|copied) (?:in any form )?without (?:prior )?(?:written )?permission", 2, 0.7),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?=19|20)[12][09][0-9]{2}(?= ))*+(?: by)?", 3, 0.4),
    ("non-commercial", "non commercial", r"(?:for )?non commercial (?:use|purposes)(?: only)?", 2, 0.6),
    ("non-commercial", "noncommercial", r"(?:for )?noncommercial (?:use|purposes)(?: only)?", 2, 0.6),
    ("research-only", "academic", r"(?:for )?academic (?:use|purposes) only", 2, 0.6),
    ("research-only", "research", r"(?:for )?research (?:use|purposes) only", 2, 0.6),
    ("no-warranty", "without warrant", r"without warrant(?:y|ies)(?: or conditions)? of any kind", 3, 0.4),
    ("eula", "end user license", r"end user license agreement", 2, 0.7),
    ("trial", "trial", r"trial (?:use|purposes|version) only", 2, 0.6),
    ("trial", "evaluation", r"evaluation (?:use|purposes|version) only", 2, 0.6),
    ("dual", "dual licensed", r"dual licensed under", 2, 0.6),
]


def rules() -> list[tuple[str, str, str, int, float]]:
    """All rules in order: label, gate, pattern, priority (0 is the highest), score."""
    made = []
    for label, gate, name, identifier in LICENSES:
        if identifier:
            made.append((label, "spdx", rf"spdx license identifier {identifier}", 0, 1.0))
        made.append((label, gate, rf"(?:licensed|distributed|available|redistribute[d]?|covered) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: license)?", 1, 0.95))
        made.append((label, gate, rf"(?:the )?{name}(?: license)?" if "license" in name else rf"(?:the )?{name} license", 2, 0.8))
        made.append((label, gate, rf"(?:released|published|provided|shared|offered) under (?:the |an? )?{name}", 2, 0.75))
    return made + PHRASES


def first_words() -> list[str]:
    """Words of which every text that a rule matches has one: the four forms' own, and the longest of a phrase's gate.

    A bare name whose "license" may be missing counts as a phrase.
    """
    bare = {gate for _, gate, name, _ in LICENSES if "(?: license)?" in name}
    return sorted({"license", "under", "spdx"} | {max(gate.split(), key=len) for gate in bare | {gate for _, gate, *_ in PHRASES}})
