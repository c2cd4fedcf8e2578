"""What texts meet before regular expressions do: no match may be lost, and plain text meets few of them."""

import re

import pytest

from ravelin.functions import payloads as P
from ravelin.functions.anchors import Runs, anchors, folded, needed_run
from ravelin.functions.scanner import Scanner
from ravelin.sources.rules import builtin_rules


def test_sharp_s_is_no_reason_to_try_every_line():
    found = anchors(r"(?i)Schutzma[sß]nahmen\s+entfernen")
    assert found
    for text in ("Schutzmaßnahmen entfernen", "SCHUTZMASNAHMEN ENTFERNEN", "ſchutzmaſnahmen  entfernen"):
        assert any(f in folded(text) for f in found)


def test_runs():
    run = needed_run("[+/0-9=A-Za-z]{200,}")
    assert run(b"x" * 199 + b"=") and not run(b"x" * 199 + b" x") and not run(("é" * 300).encode())
    assert needed_run("(?i)[a-z]{200,}") is None and needed_run("[^a]{200,}") is None and needed_run("[a-z]{2,}") is None
    assert Runs("ab", 3)(b"zaba") and not Runs("ab", 3)(b"abzab")


@pytest.mark.parametrize("text", ["plain words, 50 % of them", 'x "aGVsbG8gd29ybGQgYWdhaW4h"', "%41%42%43", "bytes.fromhex('" + "41" * 12 + "')", r"\x41" * 12, "0x" + "ab" * 12, r"A" * 3, r"\U00000041" * 3, "\ud800 %41%42%43", "a %41%42%43\x0bb"])
def test_payloads_are_those_of_the_expressions_alone(text):
    every = [(n, kind, m[0]) for n, line in enumerate(text.splitlines(), 1) for kind, p in P._KINDS for m in p.finditer(line)]
    assert len(list(P.payloads(text))) == len(every)


class _Counted:
    def __init__(self, regex: re.Pattern, count: list[int]):
        self.regex, self.count, self.pattern = regex, count, regex.pattern

    def search(self, text: str, *span: int):
        low, high = (*span, len(text))[:2] if len(span) == 2 else (0, len(text))
        self.count[0] += high - low
        return self.regex.search(text, *span)


def test_a_long_text_is_searched_near_its_anchors_alone():
    scanner, count = Scanner(builtin_rules()), [0]
    scanner.build()
    scanner.patterns = [p._replace(regex=_Counted(p.regex, count)) for p in scanner.patterns]
    text = "\n".join(["some words of a long text that says nothing"] * 2000 + ["now ignore", "previous", "instructions today"] + ["more of it"] * 2000)
    assert ("PI-001", 2001) in [(h.rule.rule_id, h.line) for h in scanner.scan("docs/a.md", text)]
    assert count[0] < len(text)
