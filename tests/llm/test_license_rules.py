"""License rules against brute force: every pattern tried on every text."""

import re
from re import _constants as sre, _parser

from vessel_flow.llm import license_rules


def least(rx, pick=0, blank=" "):
    """A shortest text that ``rx`` matches; ``pick`` chooses between alternatives."""
    def of(tree):
        out = ""
        for op, arg in tree:
            if op is sre.LITERAL:
                out += chr(arg)
            elif op is sre.ANY:
                out += "x"
            elif op is sre.IN:
                kind, value = arg[0]
                out += chr(value if kind is sre.LITERAL else value[0]) if kind is not sre.CATEGORY else (
                    blank if value is sre.CATEGORY_SPACE else "x")
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                out += of(arg[2]) * arg[0]
            elif op is sre.SUBPATTERN:
                out += of(arg[3])
            elif op is sre.BRANCH:
                out += of(arg[1][pick])
        return out
    return of(_parser.parse(rx, re.ASCII))


def brute(text):
    found = sorted((m.start(), m.start() - m.end(), -r["prio"], r["o"], r["label"], r["gap"]) for r in license_rules.rule_table()
                   for m in re.finditer(r["rx"], text, re.ASCII))
    labels, best, gap_at, held = set(), 0, -1, None  # held: (end, priority, label)
    for s, length, prio, o, label, gap in found:
        overlaps = held is not None and s < held[0]
        if s == gap_at or overlaps and (s - length <= held[0] or -prio <= held[1]):
            continue
        if gap:
            gap_at, best = s, max(best, -prio)
            labels.add(label)
            continue
        if held and not overlaps:
            labels.add(held[2])
            best = max(best, held[1])
        held = (s - length, -prio, label)
    if held:
        labels.add(held[2])
        best = max(best, held[1])
    known = {ident.lower(): label for ident, label, _ in license_rules.names()}
    spdx = {known.get(re.sub(r"(-only|-or-later|\+|\.)+$", "", word)) for line in re.findall(
        r"spdx-license-identifier:[ \t]*([^\r\n]*)", text.lower()) for word in re.split(r"[^a-z0-9.+-]+", line)} - {None}
    return labels | spdx, 100 if spdx else best


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = license_rules.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        labels, best = brute(texts[r.doc_id])
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == labels | base, texts[r.doc_id]
        assert r.score == max(best, 60 if base else 0) / 100, texts[r.doc_id]
    return {texts[r.doc_id]: r.labels for r in rows}


def test_no_prefilter_hides_a_rule(spark):
    texts = []
    for r in license_rules.rule_table():
        for pick in (0, -1):
            text = least(r["rx"], pick)
            assert re.search(r["rx"], text, re.ASCII), r["rx"]
            assert all(w in text.lower() for w in r["kws"]), r["rx"]
            texts += [text, f"Some {text.upper()} here"]
    check(spark, texts)


def test_names_without_the_word_license(spark):
    got = check(spark, ["Released under GPLv3.", "CC0 1.0 Universal", "AGPL-3.0", "the 2-clause BSD", "0BSD",
                        "Creative Commons Attribution 4.0", "NASA Open Source Agreement", "nothing of it"])
    assert list(got.values()) == ["gpl-3.0", "cc0-1.0", "agpl-3.0", "bsd-2-clause", "bsd-0-clause", "cc-by-4.0",
                                  "nasa-1.3", ""]


def test_wrapped_texts_of_every_rule(spark):
    check(spark, [least(r["rx"], -1, "\n   ") for r in license_rules.rule_table()])


def test_white_space_and_gaps(spark):
    holder = "the " + "very long name of a holder " * 9000
    bsd = "Neither the name of\n%s nor the names of its\ncontributors may be\nused to endorse or promote products"
    got = check(spark, [
        "GNU General\nPublic License version 2", "GNU Lesser\nGeneral Public License, version  3",
        "either\nversion 2 of the License, or", "without\nwarranty of any kind", "Tcl/Tk License",
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "bsd  3-clause", bsd % "Foo", bsd % holder,
        "Copyright 2020 Foo\n\nAll rights reserved", "Copyright 2020 Foo, under the MIT License, all rights reserved",
        "copyright of all, neither the name of it " * 3000 + "rights reserved may be used to endorse or promote"])
    assert list(got.values())[:11] == [
        "gpl,gpl-2.0", "gpl,lgpl-3.0", "gpl-2.0", "no-warranty", "tcl", "cc-by-nc-sa-4.0", "bsd-3-clause", "bsd-3-clause",
        "bsd-3-clause", "proprietary", "mit,proprietary"]


def test_spdx_expressions_and_short_forms(spark):
    got = check(spark, [
        "SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: (GPL-2.0-or-later WITH x) AND BSD-3-Clause\nMPL",
        "GNU GPL v2", "GNU GPL version 3", "LGPL 2.1", "MPL 2.0", "Apache 2.0", "Licensed under Apache 2.0", "MIT licensed",
        "Licensed under CC BY 4.0", "licensed under a CC BY-SA 4.0", "CC-BY-4.0", "Lesser General Public License, version 2.1",
        "the 3-clause BSD license", "the JSON license", "confidential and proprietary " + "x " * 99 + "license",
        "simple example of emitted episodes"])
    assert list(got.values()) == [
        "apache-2.0,mit", "bsd-3-clause,gpl-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "mpl-2.0", "apache-2.0", "apache-2.0", "mit",
        "cc-by-4.0", "cc-by-sa-4.0", "cc-by-4.0", "gpl,lgpl-2.1", "bsd-3-clause", "json", "proprietary", ""]


def test_rules_are_written_by_hand():
    table = license_rules.rule_table()
    assert len(table) > 300 and len({r["rx"] for r in table}) == len(table)


def test_a_text_is_asked_only_for_the_rules_of_the_words_it_holds():
    table = license_rules.rule_table()
    chosen = license_rules.cover([r["kws"] for r in table])
    groups = {g["word"]: g["rules"] for g in license_rules.by_gate(table, chosen)}
    assert sorted(r["o"] for rules in groups.values() for r in rules) == [r["o"] for r in table]
    assert all(any(g in w for w in r["kws"]) for g, rules in groups.items() for r in rules)
    # words of everyday prose lead to a few rules, not to all
    assert all(len(groups.get(g, [])) <= 10 for g in ("mit", "beer", "osl", "asl", "nasa"))


def test_only_texts_with_a_base_phrase_are_walked_through(spark):
    texts = ["mit der license", "the MIT,\n License; mit license", "permit license", "General  Public License", "mit licensed", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in license_rules.scan(docs).collect()}
    empty = (0, None, None, "")
    assert rows == {0: empty, 1: (2, 1, 3, "mit"), 2: empty, 3: (1, 0, 0, "gpl"), 4: empty, 5: empty}
