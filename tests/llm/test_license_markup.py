"""License texts with the license lists' markup, and whole texts from a folder."""

import os

import pytest

from keelson.llm import licenses

COMMON = "/usr/share/common-licenses"
MARKED = """<<beginOptional>>The Example License

<<endOptional>><<var;name="copyright";original="Copyright (c) <year> <owner>";match=".{0,40}">>

Permission is granted to <<var;name="who";original="any person";match="any|every">> person, <<beginOptional;name="more">>with
or <<beginOptional>>also <<endOptional>>without fee, <<endOptional>>to use <<var;name="what";original="it >> here";match=".+">> freely.
"""


def accepts(template, text):
    words = licenses.words_of(text.encode())
    return licenses.scan(words, b" ".join(words), licenses.compiled(template))[0]


def test_markup_becomes_a_template():
    template = licenses.from_markup(MARKED, longest=3)
    assert template == "[[ the example license ]] {3} permission is granted to {1:any|every} person [[ with or [[ also ]] without fee ]] to use {3} freely"
    for text in (
        "The Example License Copyright 2020 Someone. Permission is granted to any person, with or without fee, to use it freely.",
        "PERMISSION IS GRANTED to every person, with or also without fee, to use this software here freely",
        "see below: permission is granted to any person to use freely!",
    ):
        assert accepts(template, text)
    for text in (
        "permission is granted to some person to use it freely",
        "permission is granted to any person with fee to use it freely",
        "permission is granted to any person to use it as you may like freely",
        "permission is granted to any person to use it",
    ):
        assert not accepts(template, text)


def test_plain_texts_are_their_own_templates():
    assert licenses.from_markup("Some (plain) text, v2.0") == "some plain text v2 0"
    assert licenses.from_markup("") == ""


@pytest.mark.parametrize("broken", ["<<beginOptional>>never ended", "never begun<<endOptional>>", "<<beginOptional>>a<<endOptional>> b <<endOptional>>"])
def test_optional_parts_are_balanced(broken):
    with pytest.raises(ValueError):
        licenses.from_markup(broken)


def test_folder_of_texts(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "Example.template.txt").write_text(MARKED)
    (tmp_path / "l" / "Plain-1.0.txt").write_text("Do as you like.\n\nReally.")
    found = licenses.read_templates(spark, str(tmp_path / "l"), longest=3)
    assert sorted(found) == ["example", "plain-1.0"] and found["plain-1.0"] == "do as you like really"
    docs = spark.createDataFrame([(1, "Before. DO AS YOU LIKE - really, after"), (2, "do as you like, not really"), (3, None), (4, "permission is granted to any person to use it freely")], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_labels(docs, templates=found).collect()}
    assert got[1] == ("plain-1.0", 1.0) and got[3] == ("", 0.0) and got[4] == ("example", 1.0)
    assert got[2][0] == "" and 0 < got[2][1] < 1
    (tmp_path / "l" / "none.txt").write_text("<<beginOptional>>all optional<<endOptional>>")
    with pytest.raises(ValueError, match="none.txt"):
        licenses.read_templates(spark, str(tmp_path / "l"))


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no folder of license texts on this machine")
@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0"])
def test_whole_license_texts(name):
    with open(f"{COMMON}/{name}", encoding="utf-8") as f:
        text = f.read()
    template = licenses.from_markup(text)
    words = licenses.words_of(text.encode())
    automaton = licenses.compiled(template)
    scan = lambda w: licenses.scan(w, b" ".join(w), automaton)
    assert scan([b"before", *words, b"after"]) == ([1], 1.0)
    for k in (1, len(words) // 2, len(words) - 1):
        starts, share = scan(words[:k] + words[k + 1 :])
        assert starts == [] and share < 1
        assert scan([*words[:k], b"other", *words[k:]])[0] == []
