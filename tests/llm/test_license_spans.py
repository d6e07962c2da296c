"""Verified spans of license wordings, by hand."""

import pytest

from spellframe.llm import licenses

CASES = [
    ("licensed under cc by nc", "cc-by,cc-by-nc"), ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"), ("licensed under cc by", "cc-by"),
    ("Released under that MIT license", "mit"), ("released under the mit license", "mit"), ("released under the BSD license", ""),
    ("license mit the under released", ""), ("under the stone the mit of it license under the river", ""), ("the mit license", "mit"),
    ("mit license is a word pair. far away, some other words, and then released under the sun", ""),
    ("permission is hereby granted free of any charge to a person obtaining a copy of the software", "mit"),
    ("This work is licensed under the GNU Lesser General Public License", "gpl,lgpl"), ("gnu affero general public license", "agpl,gpl"),
    ("Redistribution and use in source and binary forms, with or without any modification, are permitted", "bsd"),
    ("redistribution of binary forms", ""), ("use in source", ""), ("creative commons attribution noncommercial license", "cc-by-nc"),
    ("released into the public domain", "public-domain"), ("into the public", ""), ("", ""), ("by nc by nc by nc by nc", ""),
]


def test_telling_grams():
    rows = licenses.template_rows()
    assert all(r[4] <= r[3] + 1 for r in rows)
    for _, label, base, last, need, tells, w in rows:
        gram = w[tells:tells + licenses.K]
        if not base:
            assert " ".join(gram) == licenses.WORDINGS[" ".join(w)][1] and need >= 2
            assert label == "public-domain" or not any(gram == x[i:i + licenses.K] for _, other, b, *_, x in rows if not b and other != label for i in range(len(x) - 1))


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r for r in licenses.license_scan(frame).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_labels(found, case):
    assert found[case].labels == CASES[case][1], CASES[case][0]
    assert (found[case].score > 0) == bool(CASES[case][1])
