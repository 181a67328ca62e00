"""Licence recognition by known sentences and ordered rules.

Native DataFrame operations only, one projection.  A text is split into sentences, each
sentence is normalised and mapped to the identifier of a known licence sentence, and the
sequence of identifiers is matched against rules: the first rule whose identifiers occur
in order takes them, and later rules see what is left.  Texts are read twice: line by
line, and with wrapped lines joined, as licence texts are often wrapped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences by identifier, as they are published.
SENTENCES = {
    "mit-title": ["The MIT License", "MIT License", "The MIT License (MIT)"],
    "mit-ref": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "no-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-ref": ["Released under the ISC License", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of <...> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-2-ref": ["Released under the BSD 2-Clause License", "Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-3-ref": ["Released under the BSD 3-Clause License", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "apache-header": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-limits": ["See the License for the specific language governing permissions and limitations under the License"],
    "apache-ref": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "Licensed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-free-2": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "gpl-3-ref": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0"],
    "gpl-2-ref": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"],
    "lgpl-3-ref": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0"],
    "agpl-3-ref": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0"],
    "mpl-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-ref": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0-ref": ["Released under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "bsd-as-is": ["THIS SOFTWARE IS PROVIDED BY <...> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "lgpl-free-21": ["This <...> is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl-free-3": ["This <...> is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl-details": ["See the GNU Lesser General Public License for more details"],
    "agpl-details": ["See the GNU Affero General Public License for more details"],
    "gpl-3-text": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "gpl-2-text": ["By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users"],
    "lgpl-3-text": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"],
    "lgpl-21-text": ["This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it"],
    "agpl-3-text": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"],
    "apache-text": ["\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document"],
    "mpl-text": ["\"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof"],
    "epl-ref": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at <...>", "SPDX-License-Identifier: EPL-2.0"],
    "epl-text": ["THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")"],
    "cc-by-text": ["By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\")"],
    "cc-by-sa-text": ["By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\")"],
    "cc-by-nc-text": ["By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License (\"Public License\")"],
    "closed": ["Proprietary and confidential", "Unauthorized copying of this file, via any medium is strictly prohibited", "Unauthorized copying of this file, via any medium, is strictly prohibited"],
    "reserved": ["All rights reserved"],
}

#: Mark of a name in a known sentence, which any words may take the place of.
HOLE = "<...>"

#: Rules in order: licence and the sentences that make it, one after the other.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "as-is", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is", "no-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-header", "apache-copy", "apache-limits"]),
    ("Apache-2.0", ["apache-header"]),
    ("GPL-3.0-only", ["gpl-3-text", "gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-only", ["gpl-3-text"]),
    ("GPL-2.0-only", ["gpl-2-text", "gpl-free-2", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-only", ["gpl-2-text"]),
    ("AGPL-3.0-only", ["agpl-3-text", "agpl-free", "gpl-hope", "agpl-details"]),
    ("AGPL-3.0-only", ["agpl-3-text"]),
    ("LGPL-2.1-only", ["lgpl-21-text", "lgpl-free-21", "lgpl-hope", "lgpl-details"]),
    ("LGPL-2.1-only", ["lgpl-21-text"]),
    ("LGPL-3.0-only", ["lgpl-3-text"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("LGPL-3.0-or-later", ["lgpl-free-3"]),
    ("LGPL-2.1-or-later", ["lgpl-free-21"]),
    ("Apache-2.0", ["apache-text", "apache-header", "apache-copy", "apache-limits"]),
    ("Apache-2.0", ["apache-text"]),
    ("MPL-2.0", ["mpl-text", "mpl-subject"]),
    ("MPL-2.0", ["mpl-text"]),
    ("EPL-2.0", ["epl-text"]),
    ("EPL-2.0", ["epl-ref"]),
    ("CC-BY-4.0", ["cc-by-text"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-text"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-text"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl-free-2", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-free-2"]),
    ("Apache-2.0", ["apache-ref"]),
    ("MIT", ["mit-ref"]),
    ("ISC", ["isc-ref"]),
    ("BSD-2-Clause", ["bsd-2-ref"]),
    ("BSD-3-Clause", ["bsd-3-ref"]),
    ("GPL-3.0-only", ["gpl-3-ref"]),
    ("GPL-2.0-only", ["gpl-2-ref"]),
    ("LGPL-3.0-only", ["lgpl-3-ref"]),
    ("AGPL-3.0-only", ["agpl-3-ref"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("Unlicense", ["unlicense"]),
    ("MIT", ["mit-title"]),
    ("Proprietary", ["closed"]),
    ("All-Rights-Reserved", ["reserved"]),
]
#: A notice that goes with any licence: told only of texts without another one.
NOTICE = "All-Rights-Reserved"

#: Every known sentence has one of these words, so texts without them need no closer look.
HINT = r"(?i)licen[sc]e|redistribut|permission|warranty|liable|unencumbered|rights reserved|CC0|CC BY|proprietary|unauthorized copying|covered software"


def normalise(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


#: Normalised sentence to identifier.
KNOWN = {normalise(s): i for i, group in SENTENCES.items() for s in group if HOLE not in s}
#: Patterns of normalised sentences with a hole, by identifier.
HOLED = [(i, "^" + " .+ ".join(map(normalise, s.split(HOLE))).strip() + "$") for i, group in SENTENCES.items() for s in group if HOLE in s]


def sentences(text: Column) -> Column:
    """Normalised sentences of a text; sentences end at ., ! or ?, at a colon that ends a line, and at line feeds."""
    marked = F.regexp_replace(text, r"(?<!\s\p{L})[.!?]+[\x22'’”)\]]*(\s|$)|:[ \t]*(\n|$)", "\n")
    return F.transform(F.split(marked, "\n"), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))


def _identifiers(units: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair))
    holed = lambda s: [F.when(s.rlike(pattern), F.lit(i)) for i, pattern in HOLED]
    return F.filter(F.transform(units, lambda s: F.coalesce(F.try_element_at(known, s), *holed(s))), lambda i: i.isNotNull())


def _licences(ids: Column) -> Column:
    """Licences of a sequence of identifiers: rules in order, each taking what it matches."""
    start = F.struct(F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).alias("left"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{i}|" for i in seq)).alias("seq")) for name, seq in RULES))

    def one(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["seq"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["seq"], F.lit("#"))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(rules, start, one, lambda s: s["found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``sentences`` (identifiers in order, as read line by line) and ``licences`` of every row.

    ``licences``: names in alphabetical order, each once, found on either reading; a mere
    reservation of all rights is named only where there is no licence.  A
    null, empty or unlicensed text has empty arrays.  Repeated rows come back as often as
    they came; other columns are not read.
    """
    text = F.col(text_col)
    some = docs.select(F.col(id_col).alias("doc_id"), F.when(text.rlike(HINT), text).alias("_text"))
    # comment signs at line starts go; a line feed that isn't next to another one is a wrap
    bare = F.regexp_replace("_text", r"(?m)^[ \t]*(?:[/*#;%]+|--|<!--)[ \t]*", "")
    unwrapped = F.regexp_replace(F.regexp_replace(bare, r"\r\n?", "\n"), r"(?<!\n)\n(?!\n)", " ")
    ids = some.select("doc_id", _identifiers(sentences(bare)).alias("lines"), _identifiers(sentences(unwrapped)).alias("wrapped"))
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_distinct(F.concat(_licences(F.col("lines")), _licences(F.col("wrapped")))))
    found = F.transform(F.array(both), lambda all_: F.when(F.size(all_) > 1, F.array_remove(all_, NOTICE)).otherwise(all_))[0]
    return ids.select("doc_id", F.coalesce("lines", none).alias("sentences"), F.coalesce(found, none).alias("licences"))
