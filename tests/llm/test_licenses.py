import re

from medlake.llm import licenses as lic
from tests.llm.odd import base_rows, docs

_LOW = {i: i + 32 for i in range(65, 91)}
TEXTS = {
    100: ("Licensed under the MIT License. Again: under the mit license", "mit"),
    101: ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    102: ("CC-BY-NC 4.0 and CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
    103: ("GNU Lesser General Public License, version 3", "lgpl-3"),
    104: ("SPDX-License-Identifier: MPL-2.0", "mpl-2"),
    105: ("GPLv3 or Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa,gpl-3"),
    106: ("under the\nmit\tlicense é under the mit licenses, thunder the mit license", "mit"),
    107: ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    108: ("he submitted a license plate", ""),
}


def places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))
    return len(w), sorted((i, label) for p, label in lic.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


def test_base_and_labels(spark):
    rows = [(i, t, "en", "s", 1) for i, (t, _) in TEXTS.items()] + base_rows()
    got = {r["doc_id"]: r for r in lic.license_report(docs(spark, rows)).collect()}
    for i, t, *_ in rows:
        if i is None:
            continue
        n, base = places(t)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
        if i in TEXTS:
            assert r["labels"] == TEXTS[i][1], i
        else:
            assert r["labels"] == ""


def test_hundreds_of_rules_that_compile():
    rules = lic.rules()
    assert len(rules) > 300 and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


def test_keywords_are_necessary():
    """Dropping the prefilter must not add detections."""
    for t, _ in TEXTS.values():
        words = lic._WORD.findall(t.translate(_LOW))
        line = " ".join(words)
        for r in lic.rules():
            if r.regex.search(line):
                assert all(k in words for k in r.keywords) and any(s in t.lower() for s in lic.STEMS)


def test_containment():
    a, b, c = (20, 0, 9, "long", 0.5), (20, 2, 5, "inside", 0.5), (50, 3, 12, "over", 0.9)
    assert [k[2] for k in lic.suppress([a, b, c, b])] == ["long", "over"]
    assert [k[2] for k in lic.suppress([(20, 0, 3, "x", 0.5), (20, 0, 3, "y", 0.5)])] == ["x", "y"]


def test_empty_table(spark):
    assert lic.license_report(docs(spark, [])).count() == 0


def labels(text):
    """Labels with the cheap gates in front, as the scan has them."""
    return {k[2] for k in lic.detect(text).kept} if any(s in text.lower() for s in lic.STEMS) else set()


def test_gates_pass_what_every_rule_can_match():
    """Generated matches: all choices of a name, and all choices of a frame."""
    assert labels("OpenRAIL-M License") == {"rail"}
    for label, names in lic.FAMILIES.items():
        for name in names:
            some = lic.choices(name)
            lines = some + [f + some[k] for _, _, frame in lic.FRAMES for f in lic.choices(frame.replace("{}", "")) for k in (0, -1)]
            for line in lines:
                words = set(line.split())
                hit = [r for r in lic.rules() if r.label == label and r.regex.fullmatch(line)]
                assert hit and any(s in line for s in lic.STEMS), line
                assert all(k in words for r in hit for k in r.keywords), line
    for label, _, _, pattern in lic.GRANTS:
        for line in lic.choices(pattern):
            assert label in labels(line), line


def test_spdx_short_identifiers():
    assert set(lic.SPDX) == set(lic.FAMILIES)
    for label, names in lic.SPDX.items():
        for name in names:
            for words in lic.choices(name):
                assert labels("SPDX-License-Identifier: " + words.replace(" ", "-")) == {label}, words
    line = "// SPDX-License-Identifier: "
    for text, want in (("MIT", {"mit"}), ("Apache-2.0", {"apache-2"}), ("ISC", {"isc"}), ("Zlib", {"zlib"}), ("BSL-1.0", {"bsl-1"}),
                       ("OFL-1.1", {"ofl"}), ("GPL-2.0+", {"gpl-2"}), ("MIT OR Apache-2.0", {"mit", "apache-2"}),
                       ("(GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause OR MIT", {"gpl-2", "bsd-3", "mit"}),
                       ("LGPL-2.1-or-later AND (MIT OR CC-BY-NC-SA-4.0)", {"lgpl-2", "mit", "cc-by-nc-sa"})):
        assert labels(line + text) == want, text
    assert labels("they submit to the isc and the zlib of apache 2 0 under no license") == set()


def test_spdx_line_in_a_report(spark):
    rows = [(1, "SPDX-License-Identifier: MIT", "en", "s", 1), (2, "SPDX-License-Identifier: Apache-2.0 OR ISC", "en", "s", 1)]
    got = {r["doc_id"]: r for r in lic.license_report(docs(spark, rows)).collect()}
    assert got[1]["labels"] == "mit" and got[2]["labels"] == "apache-2,isc" and min(got[1]["score"], got[2]["score"]) > 0.9


def test_labels_of_written_texts():
    from tests.llm.license_texts import cases
    wrong = []
    for text, want in cases():
        got = {k[2] for k in lic.detect(text).kept} if lic.may_match(text) else set()
        if got != want:
            wrong.append((text, sorted(got), sorted(want)))
    assert not wrong, wrong


def test_declared_names_pass_the_gates():
    for label, names in lic.DECLARED.items():
        for name in names:
            for _, _, frame in lic.DECLARING:
                for line in lic.choices(frame.replace("{}", "@")):
                    for text in lic.choices(name):
                        text = line.replace("@", text)
                        assert lic.may_match(text), text
                        hit = [r for r in lic.rules() if r.label == label and r.regex.fullmatch(text)]
                        assert hit and all(k in text.split() for r in hit for k in r.keywords), text
