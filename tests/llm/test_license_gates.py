"""The gate of a licence rule is in every text that the rule matches."""

import random
import time
from re import _constants as c
from re import _parser

import pytest

from scenewright.llm import licenses


def sample(parsed, rng):
    out = ""
    for kind, x in parsed:
        if kind is c.LITERAL:
            out += chr(x)
        elif kind is c.IN:
            op, y = rng.choice(x)
            out += chr(y) if op is c.LITERAL else chr(rng.randint(*y)) if op is c.RANGE else {c.CATEGORY_WORD: "w", c.CATEGORY_DIGIT: "7"}[y]
        elif kind is c.ANY:
            out += "y"
        elif kind is c.BRANCH:
            out += sample(rng.choice(x[1]), rng)
        elif kind is c.SUBPATTERN:
            out += sample(x[3], rng)
        elif kind in (c.MAX_REPEAT, c.MIN_REPEAT):
            out += "".join(sample(x[2], rng) for _ in range(rng.randint(x[0], min(x[1], x[0] + 3))))
        else:
            assert kind in (c.AT, c.ASSERT, c.ASSERT_NOT)
    return out


def test_a_matched_text_holds_the_gate():
    rng = random.Random(9)
    for rule in licenses._LABEL_RULES:
        for _ in range(20):
            text = sample(_parser.parse(rule.pattern.pattern.decode()), rng).encode()
            if rule.pattern.search(text):
                assert rule.gate in licenses.gates(text), (rule.label, text)


@pytest.mark.parametrize(
    "text, label",
    [
        ("https://creativecommons.org/licenses/by/4.0/", "cc-by-4.0"),
        ("https://creativecommons.org/publicdomain/zero/1.0", "cc0-1.0"),
        ("scripts.sil.org/OFL", "ofl-1.1"),
        ("X11 License", "x11"),
        ("Internet Systems Consortium License", "isc"),
        ("CreativeML Open RAIL-M License", "openrail"),
        ("BigScience RAIL License", "openrail"),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0-or-later"),
    ],
)
def test_a_notice_alone_is_found(text, label):
    assert label in licenses.scan(text.encode())[5]


def test_detections_equal_brute_force():
    """All matches in rule order, each held against all that are kept."""
    rng = random.Random(4)
    parsed = [_parser.parse(r.pattern.pattern.decode()) for r in licenses._LABEL_RULES]
    kept_any = 0
    for _ in range(120):
        pieces = []
        for _ in range(rng.randint(1, 12)):
            x = sample(rng.choice(parsed), rng).split()
            cut = rng.randint(0, 2)
            pieces.append(" ".join(x[: len(x) - cut] if rng.random() < 0.3 else x))
            if rng.random() < 0.3:
                pieces.append(rng.choice(["ümit", "and", "version", "3", "license", "or later"]))
        line = b" ".join(licenses.words(" ".join(pieces).encode()))
        kept = []
        for rule in licenses._LABEL_RULES:
            for m in rule.pattern.finditer(line):
                a, b = m.span()
                assert (a == 0 or line[a - 1] == 0x20) and (b == len(line) or line[b] == 0x20)
                if all(b <= x or y <= a for x, y, _ in kept):
                    kept.append((a, b, rule.label))
        assert licenses.detections(line, licenses.gates(line)) == sorted(kept)
        kept_any += len(kept)
    assert kept_any > 300


def test_words_with_other_letters_are_not_split():
    assert licenses.scan("ñmit license".encode())[4:6] == ([], []) and "mit" in licenses.scan(b"the mit license")[5]


def test_many_hits_take_time_in_proportion():
    licenses.scan(b"mit license")
    began = time.process_time()
    found = licenses.scan(b"mit license " * 90_000)  # over 1 MB
    assert found[1] == 90_000 and found[3] == 179_998 and time.process_time() - began < 6
