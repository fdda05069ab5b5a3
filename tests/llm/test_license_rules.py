"""Each license rule on texts that hold nothing but what the rule itself accepts."""

import itertools
import re
from re import _constants as C
from re import _parser

from graphloom.llm import licenses


def accepted(regex, most=400):
    """Strings that a regex accepts: every alternative, each option with and without, blanks as a space and line-broken."""

    def each(node):
        kind, x = node
        if kind is C.LITERAL:
            return [chr(x)]
        if kind is C.ANY:
            return ["x"]
        if kind is C.IN:
            if any(k is C.CATEGORY for k, _ in x):
                return [" ", "\n"] + [chr(v) for k, v in x if k is C.LITERAL and chr(v) == "-"]
            return [chr(v) for k, v in x if k is C.LITERAL]
        if kind is C.SUBPATTERN:
            return of(x[-1])
        if kind is C.BRANCH:
            return [s for branch in x[1] for s in of(branch)]
        if kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, _, inner = x
            some = of(inner)
            return ([""] if least == 0 else []) + [s * max(1, least) for s in some]
        assert kind in (C.ASSERT, C.ASSERT_NOT, C.AT), kind
        return [""]

    def of(nodes):
        parts = [each(n) for n in nodes]
        # All alternatives in turn where the product is small, else each part's choices with the others at their first and last.
        size = 1
        for p in parts:
            size *= len(p)
        if size <= most:
            return ["".join(s) for s in itertools.product(*parts)]
        out = []
        for i, p in enumerate(parts):
            for edge in (0, -1):
                out += ["".join(q[edge] if k != i else s for k, q in enumerate(parts)) for s in p]
        return list(dict.fromkeys(out))

    return of(_parser.parse(regex))


def texts(rule):
    """What the rule accepts; the later names of an SPDX expression only count in a text that has the tag."""
    _, _, also, regex, _, _ = rule
    tag = f"{also}: x " if also == "spdx-license-identifier" else ""
    return [tag + s for s in accepted(regex)]


def test_gate_lets_every_rule_through():
    shut = [(rule[0], s) for rule in licenses.rules() for s in texts(rule) if not re.search(licenses.GATE, s)]
    assert not shut, (len(shut), shut[:5])


def test_references_without_the_word_license(spark):
    texts = {
        "https://www.mozilla.org/MPL/2.0/": "mpl-2.0",
        "https://www.eclipse.org/legal/epl-2.0/": "epl-2.0",
        "http://scripts.sil.org/OFL": "ofl-1.1",
        "https://creativecommons.org/publicdomain/zero/1.0/": "cc0-1.0",
        "http://www.wtfpl.net": "wtfpl",
        "Proprietary\nand confidential. All rights reserved": "proprietary",
        "CC\nBY 4.0": "cc-by-4.0",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.report(df).collect()}
    assert [found[i].labels for i in range(len(texts))] == list(texts.values())
    assert all(r.score > 0 for r in found.values())


def test_keywords_stand_in_every_match():
    shut = [(rule[0], s) for rule in licenses.rules() for s in texts(rule) if rule[1] not in s or rule[2] not in s]
    assert not shut, (len(shut), shut[:5])


def test_every_rule_fires_on_its_own_signature(spark):
    """Whole texts that one rule accepts, a few of each rule, get its label."""
    rows = []
    for rule in licenses.rules():
        label, some = rule[0], texts(rule)
        rows += [(label, s) for s in dict.fromkeys(some[:: max(1, len(some) // 6)] + some[-1:])]
    df = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.labels.split(",") for r in licenses.report(df).collect()}
    missed = [(label, s, found[i]) for i, (label, s) in enumerate(rows) if label not in found[i]]
    assert not missed, (len(missed), len(rows), missed[:5])


def test_labels_do_not_hang_on_unrelated_words(spark):
    text = "Licensed under the Creative Commons Attribution 4.0 International License"
    texts = [text, text + ". Success may occur.", "under the PSF\nLicense", "released into the public\ndomain", "Open\n  Software License v. 3.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.labels for r in licenses.report(df).collect()}
    assert [found[i] for i in range(len(texts))] == ["cc-by-4.0", "cc-by-4.0", "psf-2.0", "public-domain", "osl-3.0"]
