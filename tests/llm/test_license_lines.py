"""The licence classifier: what it was not shown, what is not a licence, wrapped notices, and the plan against plain Python."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismflow.llm import license_scan

SF, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


def probabilities(model, text):
    z = np.array(model.bias)
    for g in license_scan.grams_of(license_scan.words_of(text)):
        z = z + np.array(model.weights.get(g, np.zeros(len(z))))
    e = np.exp((z - z.max()) / model.temperature)
    return e / e.sum()


def judged(model, text):
    """(family, probability, coverage) of a paragraph, None if it is plain text; plain Python."""
    p = probabilities(model, text)
    if p[-1] >= 0.5:
        return None
    at = int(np.argmax(p[:-1]))
    family, own, cover = license_scan.FAMILIES[at], set(license_scan.pairs_of(license_scan.words_of(text))), 0.0
    if family in license_scan.NOTICES:
        for t in license_scan.templates(family):
            pairs = set(license_scan.pairs_of(license_scan.words_of(t)))
            cover = max(cover, len(own & pairs) / min(len(own), len(pairs)))
    named = p[at] >= license_scan.LEAST and cover >= license_scan.COVER and not re.search(license_scan.DENIED, text)
    return family if named else license_scan.UNKNOWN, round(float(p[at]), 6), round(cover, 6)


def by_hand(rows):
    """The rule over whole texts, without a pattern that leaves lines out."""
    model, out = license_scan.model(), []
    for doc, text in rows:
        held = [(i, line, judged(model, line)) for i, line in enumerate((text or "").split("\n"))]
        held = [h for h in held if h[2]]
        for i, _, own in held:
            near = [line for j, line, its in held if abs(j - i) <= license_scan.CONTEXT and its[0] == license_scan.UNKNOWN]
            both = judged(model, " ".join(near)) if own[0] == license_scan.UNKNOWN and len(near) > 1 else None
            out.append((doc, i, *(both if both and both[0] != license_scan.UNKNOWN else own)))
    return sorted(out, key=repr)


def scanned(spark, rows):
    found = license_scan.licences(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(((r.doc_id, r.paragraph, r.family, r.probability, r.coverage) for r in found.collect()), key=repr)


def same(got, expected):
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert all(abs(a - b) < 2e-6 for g, e in zip(got, expected, strict=True) for a, b in zip(g[3:], e[3:], strict=True))


def test_names_and_wordings_that_were_held_out():
    assert license_scan.model().held_out_accuracy > 0.92


def test_other_licences_and_everyday_use(spark):
    lines = [
        "Licensed under the EUPL v1.2", "This is under the GNU Affero General Public License version 3.", "Eclipse Public License 2.0", "Licensed under CC BY-ND 4.0", "SPDX: ISC",
        "The MIT campus needs a parking license", "Licensed under the Foobar Public License", "All rights reserved.",
    ]
    assert [g[2] for g in scanned(spark, list(enumerate(lines)))] == ["unknown"] * len(lines)


def test_lines_that_name_a_family(spark):
    lines = {"Available under CC BY 4.0": "cc-by", "Distributed under Apache 2.0": "apache-2.0", "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit"}
    plain = ["Mit dem Hund.", "The end of the year.", "In the morning by the lake.", "It was as if all of this and that", "For the public of the country.", "", "x"]
    got = scanned(spark, list(enumerate([*lines, *plain])))
    assert [(g[0], g[2]) for g in got] == list(enumerate(lines.values()))


def test_denials_and_lines_with_two_names(spark):
    denied = ["This is not licensed under the MIT License.", "No longer released under the GPL version 2.", "It was never distributed under the terms of the LGPL."]
    named = {"Copyright 2020 Foo Inc. MIT licensed.": "mit", "MIT-Lizenz": "mit", "You may not use this file except in compliance with the License. Licensed under the Apache License, Version 2.0.": "apache-2.0"}
    found = license_scan.licences(spark.createDataFrame(list(enumerate([*denied, *named, "Dual licensed under MIT or Apache-2.0", "Mit Apache 2.0 lizenziert: Apache License 2.0"])), "doc_id long, text string"))
    got = {r.doc_id: r for r in found.collect()}
    assert [got[k].family for k in range(3)] == ["unknown"] * 3 and [got[3 + k].family for k in range(3)] == list(named.values())
    assert {got[6].family, *got[6].also} == {"mit", "apache-2.0"}
    assert got[7].family == "apache-2.0" and got[7].also == []


def test_no_made_up_word_is_a_feature():
    words = {w for g in license_scan.model().weights for w in g.split()}
    assert words <= license_scan._real_words() and not words & {"herd", "lake", "antelope", "city", "morning"}


def test_wrapped_notices(spark):
    text = "A story.\nThis file may be distributed\nunder the terms of the\nMozilla Public License\nversion 2.0, see there.\n\nThe end."
    rows = [(1, text), (2, "Licensed under CC BY-NC 4.0.\nAll rights reserved.\n" + "plain text\n" * 9 + "Released under the MIT License.")]
    got = scanned(spark, rows)
    same(got, by_hand(rows))
    assert {g[2] for g in got if g[0] == 1} >= {"mpl-2.0"}
    assert [g[1:3] for g in got if g[0] == 2] == [(0, "cc-by-nc"), (1, "unknown"), (11, "mit")]


def test_odd_texts_against_plain_python(spark):
    long = "word " * 40_000 + "license " * 2_000 + "\n" + "Released under the MIT License.\n" * 300
    notices = [t for f in license_scan.NOTICES for t in license_scan.templates(f)] + license_scan.OTHERS + license_scan.PLAIN
    rows = [(1, long), (2, None), (3, ""), (None, "Licensed under the GPL version 2."), (4, "\n".join(notices)), (4, "MIT"), (5, "\t\x00  é license")]
    same(scanned(spark, rows), by_hand(rows))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_query_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.paragraph, r.family, r.probability, r.coverage) for r in license_scan.licences(docs).collect()), key=repr)
    same(got, by_hand(rows))
    assert got


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_reserved_line_in_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).where("line = 'All rights reserved.'")
    expected = {(r.doc_id, r.paragraph) for r in lines.collect()}
    got = {(r.doc_id, r.paragraph) for r in license_scan.licences(docs).collect()}
    assert expected and expected <= got
