"""Licence paragraphs: notices that are not in the training texts word by word, unlisted licences, wrapped texts, rows of all kinds."""

import pytest

from obsflow.llm import licenses

#: Not in the training set as they stand.
SEEN_FAMILIES = [
    ("This module may be copied under the terms of the MIT License, see COPYING.", "mit"),
    ("All code here is under the GPLv3", "gpl"),
    ("Our library is available under GNU Lesser General Public License version 3.", "lgpl"),
    ("The data are published under the CC BY-SA 4.0", "cc-by-sa"),
    ("The pictures are published under CC BY-NC 4.0 by the museum", "cc-by-nc"),
    ("Files in this folder: the Mozilla licence", "mpl"),
    ("Released under the ISC License.", "isc"),
    ("Licensed under the Boost Software License, Version 1.0.", "boost"),
    ("The plugin is licensed under the Eclipse Public License.", "epl"),
    ("It is published under the Artistic License 2.0 as Perl is.", "artistic"),
    ("This file comes under the Apache License 2.0", "apache"),
    ("copies or substantial portions of the Software shall include the above copyright notice and this permission notice", "mit"),
    ("with or without modification, redistribution and use in source and binary forms are permitted", "bsd"),
]
UNLISTED = ["Licensed under the Academic Free License, version 3.0.", "Released under the Microsoft Public License.", "This work is licensed under the Ruby License.", "Licensed under the Open Data Commons License.", "Use is subject to the license terms of the vendor."]
CLEAN = ["The meeting was held under the bridge at noon.", "She released the bird and it flew to the public garden.", "You need a licence to drive.", "In general the terms of the peace were hard.", "mit dem Zug in die Stadt und zurück", "A copy of the letter was sent to any person who asked."]
WRAPPED = "Some prose before it.\n\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files, to deal in the Software without restriction\n\nProse again."


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark, licenses.PLAIN)


def found(spark, model, texts):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, family string, h int")
    out = {}
    for r in licenses.licenses(docs, model).collect():
        out.setdefault(r.doc_id, []).append((r.family, r.paragraph))
    return out


def test_families_of_unseen_notices(spark, model):
    got = found(spark, model, [t for t, _ in SEEN_FAMILIES])
    wrong = {k: (t, got.get(k)) for k, (t, family) in enumerate(SEEN_FAMILIES) if got.get(k) != [(family, 0)]}
    assert len(wrong) <= 1, wrong


def test_unlisted_licences_are_unknown(spark, model):
    got = found(spark, model, UNLISTED)
    wrong = {k: (t, got.get(k)) for k, t in enumerate(UNLISTED) if got.get(k) != [("unknown", 0)]}
    assert len(wrong) <= 1, wrong


def test_prose_has_no_licence(spark, model):
    assert found(spark, model, CLEAN) == {}


def test_wrapped_notice_is_one_paragraph(spark, model):
    assert found(spark, model, [WRAPPED]) == {0: [("mit", 2)]}


def test_rows_of_all_kinds(spark, model):
    text = "Released under the MIT License."
    long = "plain words " * 50_000 + "\n" + text
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "\n\n"), (5, long)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.paragraph, r.family) for r in licenses.licenses(docs, model).collect())
    assert got == [(0, 0, "mit"), (1, 0, "mit"), (1, 0, "mit"), (5, 1, "mit")]
    assert licenses.licenses(docs.where("false"), model).count() == 0
