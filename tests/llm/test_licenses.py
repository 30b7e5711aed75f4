from cardwatch.llm.licenses import rules, scan_licenses
from tests.llm import brute

TEXTS = [
    "", None, " ", "cc by", "CC-BY CC BY cc by.", "xcc by", "ccé by", "cc éby", "All  rights\n\nreserved all rights reserved",
    "GNU General Public License, version 3. general public license", "İ general publİc license", "mit mit mit", "a" * 5000 + " cc-by",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0. All rights reserved",
    "SPDX-License-Identifier: MPL-2.0", "Copyright 2020 by me", "released under mit", "cc by", "cc\x7fby", "1cc by2 cc by 2",
]


def test_places_match_brute_force_and_rules_find_families(spark):
    docs = spark.createDataFrame([(k, t, 0.0, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, score double, norm string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for k, t in enumerate(TEXTS):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    said = {t: got[k].labels for k, t in enumerate(TEXTS)}
    assert said["This work is licensed under the GNU General Public License, version 3."] == "gpl,gpl-3.0"
    assert said["Licensed under CC BY-NC 4.0."] == "cc-by,cc-by-nc-4.0"
    assert said["Released under the MIT License."] == said["released under mit"] == "mit"
    assert said["Licensed under the Apache License, Version 2.0. All rights reserved"] == "apache-2.0,reserved"
    assert said["SPDX-License-Identifier: MPL-2.0"] == "mpl-2.0"
    assert said["mit mit mit"] == ""


def test_contained_and_overlapping_detections(spark):
    text = "Licensed under the GNU Lesser General Public License version 3 license"
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(d.label, d.start, d.end) for d in r.detections] == [("lgpl-3.0", 1, 1 + len(text))]
    far = scan_licenses(spark.createDataFrame([(1, "mit license and isc license")], "doc_id long, text string")).first()
    assert far.labels == "isc,mit"


def test_table_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(texts[r.doc_id])
    assert scan_licenses(docs.limit(0)).count() == 0


def test_there_are_hundreds_of_rules():
    assert len(rules()) > 200


FORMS = {
    "gpl-3.0": ["licensed under GPLv3", "GPL v3", "the GPL-3.0", "GPL 3.0 or later", "GNU GPL version 3", "(gpl3)", "GPLv3+"],
    "gpl-2.0": ["under the GNU GPL version 2", "GPL v2", "gplv2 only", "GNU GPLv2", "Released under the GPL, version 2.0"],
    "gpl": ["licensed under the GPL", "GPL"], "lgpl": ["the GNU LGPL"], "lgpl-2.1": ["LGPL-2.1", "LGPLv2.1+", "lgpl version 2.1"], "lgpl-3.0": ["LGPLv3", "LGPL 3.0"],
    "agpl-3.0": ["AGPL", "AGPLv3", "GNU AGPL-3.0 or later", "Affero GPL v3"], "mpl-2.0": ["MPL 2.0", "MPL", "licensed under MPLv2"], "mpl-1.1": ["MPL 1.1"],
    "epl-2.0": ["EPL", "EPL-2.0"], "epl-1.0": ["EPL v1.0"], "cddl-1.0": ["CDDL", "CDDL 1.0"], "eupl-1.2": ["EUPL", "EUPL v1.2"], "gfdl-1.3": ["GFDL", "GNU FDL 1.3"],
    "cecill-2.1": ["CeCILL 2.1"], "lppl-1.3c": ["LPPL 1.3c"], "odbl-1.0": ["ODbL 1.0"], "wtfpl": ["WTFPL"], "cc0-1.0": ["CC0 1.0", "CC0"], "ms-pl": ["Ms-PL"], "ms-rl": ["MS-RL"],
    "apache-2.0": ["Apache 2.0", "Apache-2.0", "Apache v2"], "bsd-2-clause": ["BSD 2-Clause"], "bsd-3-clause": ["BSD-3-Clause", "3-clause BSD"], "mulanpsl-2.0": ["MulanPSL v2"],
    "afl-3.0": ["AFL 3.0"], "bsl-1.0": ["BSL-1.0"], "busl-1.1": ["BUSL 1.1"], "cpl-1.0": ["CPL 1.0"], "ecl-2.0": ["ECL 2.0"], "efl-2.0": ["EFL 2.0"], "ofl-1.1": ["OFL 1.1", "SIL OFL 1.1"],
    "osl-3.0": ["OSL 3.0"], "qpl-1.0": ["QPL 1.0"], "upl-1.0": ["UPL 1.0"], "zpl-2.1": ["ZPL 2.1"],
}


def test_short_forms_of_each_family(spark):
    texts = [(label, t) for label, forms in FORMS.items() for x in forms for t in (x, f"This code is {x}, as it says.")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert [(t, got[k].labels) for k, (_, t) in enumerate(texts)] == [(t, label) for label, t in texts]
    assert all(r.score > 0 for r in got.values())


#: (labels, text as it stands in real files).
NOTICES = [
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"),
    ("epl-2.0", "under the Eclipse Public License v2.0"), ("epl-1.0", "made available under the terms of the Eclipse Public License v1.0"),
    ("artistic-2.0", "Artistic License 2.0"), ("bsl-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("eupl-1.2", "European Union Public License 1.2"), ("eupl-1.2", "Licensed under the European Union Public Licence (EUPL) v1.2"), ("eupl-1.2", "Licensed under the European Union Public License 1.2"),
    ("mit", "It is MIT-licensed."), ("mit", "see https://opensource.org/licenses/MIT"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("gpl,lgpl-2.1", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("gpl,lgpl-2.1", "the GNU Library General Public License, version 2"), ("gpl,lgpl", "the GNU Lesser General Public License"),
    ("agpl-3.0,gpl", "GNU Affero General Public License version 3"), ("gpl,gpl-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)"),
    ("gpl,gpl-3.0", "the GNU General Public License v3.0"),
    ("cc-by-sa-4.0", "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-4.0", "under a Creative Commons Attribution 4.0 International License"), ("cc-by,cc-by-nc-nd-3.0", "CC BY-NC-ND 3.0"), ("cc-by,cc-by-4.0", "(CC BY 4.0)"),
    ("cc-by,cc-by-sa-2.5", "released under CC-BY-SA 2.5"), ("cc-by-nc-sa-3.0", "http://creativecommons.org/licenses/by-nc-sa/3.0/"), ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial"),
    ("apache-2.0", "you may not use this file except in compliance with the License. http://www.apache.org/licenses/LICENSE-2.0"), ("apache-2.0", "Apache License Version 2.0, January 2004"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement: warranty"),
    ("cddl-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("", "the license of the driver was public, and the mozilla in it is open"), ("", "a boost to software, licensed plumbers, an artistic licence"),
]


def test_notices_as_they_stand_in_files(spark):
    docs = spark.createDataFrame(list(enumerate(t for _, t in NOTICES)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in scan_licenses(docs).collect()}
    assert [(got[k], t) for k, (_, t) in enumerate(NOTICES)] == NOTICES
