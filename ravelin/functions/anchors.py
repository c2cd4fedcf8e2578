"""Which patterns can match a line at all: literal texts that every match must hold, found in one pass.

Nearly all lines match nothing, and hundreds of regular expressions for each of them would be
most of the work. For each pattern the set of texts is derived of which a match must hold one;
an Aho-Corasick automaton finds the texts of all patterns in whole batches. A pattern without
such texts is tried on every line. What is found is a superset, so results don't depend on it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as P

#: A class of more characters isn't spelled out; a set of more texts isn't used.
MOST_CHARACTERS, MOST_TEXTS = 24, 400
#: Of lines that are searched for anchors at once.
STEP_BYTES = 1 << 20


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    if a is None or b is None:
        return a if b is None else b
    key = lambda s: (min(map(len, s)), -len(s))
    return max(a, b, key=key)


def _plain(text: str) -> bool:
    """Whether simple lower() is all that regard to case means."""
    return all(len(c.lower()) == 1 and len(c.upper()) == 1 for c in text)


def _characters(items: Iterable) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < MOST_CHARACTERS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARACTERS and all(map(_plain, out)) else None


def _walk(tree) -> tuple[set[str] | None, set[str] | None]:
    """(texts of which a match must hold one, all texts that it can be); None where unknown."""
    best: set[str] | None = None
    run: set[str] | None = {""}

    def end() -> None:
        nonlocal best, run
        if run and "" not in run:
            best = _better(best, run)
        run = {""}

    for op, value in tree:
        must: set[str] | None = None
        whole: set[str] | None = None
        if op is C.LITERAL:
            # case folding that ASCII and simple lower() don't share would lose matches
            whole = {chr(value).lower()} if _plain(chr(value)) else None
        elif op is C.IN:
            whole = _characters(value)
        elif op is C.SUBPATTERN:
            must, whole = _walk(value[-1])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in value[1]]
            if all(m is not None for m, _ in parts):
                must = set().union(*(m for m, _ in parts))
            if all(w is not None for _, w in parts):
                whole = set().union(*(w for _, w in parts))
        elif op is C.AT or op in (C.ASSERT_NOT,):
            continue
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            if low:
                must, whole = _walk(inner)
                if high != 1:
                    whole = None
            elif high == 1:
                _, inside = _walk(inner)
                whole = None if inside is None else inside | {""}
        if whole is not None and len(run) * len(whole) <= MOST_TEXTS and (len(whole) == 1 or len(run) * len(whole) <= 64):
            run = {a + b for a in run for b in whole}
            continue
        end()
        if whole is not None and "" not in whole:
            best = _better(best, whole)
        if must is not None:
            best = _better(best, must)
    exact = run if best is None and len(run) else None
    whole_run = set(run)
    end()
    # exact only if nothing interrupted the run
    return best, (whole_run if exact is not None and _unbroken(tree) else None)


def _unbroken(tree) -> bool:
    return all(op in (C.LITERAL, C.IN, C.SUBPATTERN, C.BRANCH, C.AT, C.MAX_REPEAT, C.MIN_REPEAT) and (op not in (C.MAX_REPEAT, C.MIN_REPEAT) or value[1] == 1) for op, value in tree)


def anchors(pattern: str) -> set[str] | None:
    """Lower-case texts of which every match of the pattern holds one; None if there are none."""
    try:
        found, _ = _walk(P.parse(pattern))
    except (re.error, OverflowError):
        return None
    if not found or len(found) > MOST_TEXTS or any(not f.strip() for f in found):
        return None
    return found if all(_plain(f) for f in found) else None


def _needs(tree) -> list[set[str]]:
    out: list[set[str]] = []
    run = ""
    for op, value in [*tree, (None, None)]:
        if op is C.LITERAL and _plain(chr(value)) and value != 10:
            run += chr(value).lower()
            continue
        if run:
            out.append({run})
            run = ""
        if op is C.SUBPATTERN:
            out += _needs(value[-1])
        elif op is C.BRANCH:
            must = [_walk(x)[0] for x in value[1]]
            if all(m is not None for m in must):
                out.append(set().union(*must))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0]:
            out += _needs(value[2])
    return [texts for texts in out if len(texts) <= MOST_TEXTS and all(map(_plain, texts)) and not any("\n" in t for t in texts)]


#: Of texts in a set of needs(): to look for more takes longer than the expressions.
MOST_NEEDED = 12


def needs(pattern: str) -> list[tuple[str, ...]]:
    """Sets of few lower-case texts: besides one of anchors() every match of the pattern holds one of each of them."""
    try:
        found = _needs(P.parse(pattern))
    except (re.error, OverflowError):
        return []
    most = anchors(pattern)
    return sorted({tuple(sorted(texts)) for texts in found if texts != most and len(texts) <= MOST_NEEDED}, key=lambda t: (len(t), -len(t[0]), t))


def unlikely(low: str, which: Iterable[int], needed: list[list[tuple[str, ...]]] | dict[int, list[tuple[str, ...]]]) -> set[int]:
    """Those of some patterns that match nowhere in a folded text, as it lacks a text that they need."""
    return {i for i in which if not all(any(t in low for t in texts) for texts in needed[i])}


class Runs:
    """Whether a text has a run of at least ``least`` of some ASCII characters; asked of its UTF-8, in a pass without a regular expression."""

    def __init__(self, characters: Iterable[str], least: int):
        inside = {ord(c) for c in characters}
        self.table = bytes(1 if b in inside else 0 for b in range(256))
        self.run = b"\1" * least

    def __call__(self, data: bytes) -> bool:
        return self.run in data.translate(self.table)


#: Shorter runs are in too many texts to look for.
LEAST_RUN = 8


def needed_run(pattern: str) -> Runs | None:
    """The run of characters of a class that every match of the pattern holds, if it has regard to case and repeats one of ASCII."""
    try:
        tree = P.parse(pattern)
    except (re.error, OverflowError):
        return None
    if tree.state.flags & re.IGNORECASE:
        return None
    for op, value in tree:
        if op is C.MAX_REPEAT and value[0] >= LEAST_RUN and len(value[2]) == 1 and value[2][0][0] is C.IN:
            items = value[2][0][1]
            if all((o is C.LITERAL and v < 128) or (o is C.RANGE and v[1] < 128) for o, v in items):
                return Runs((chr(c) for o, v in items for c in ([v] if o is C.LITERAL else range(v[0], v[1] + 1))), value[0])
    return None


#: What matches s and i without regard to case, besides their capitals.
FOLDED = {0x17F: "s", 0x131: "i", 0x130: "i"}


def folded(text: str) -> str:
    """Lower case of the same length."""
    if not text.isascii():
        for c, plain in FOLDED.items():
            text = text.replace(chr(c), plain)
    return text.lower()


#: The commonest letters, most common first: a node of the automaton finds its children one after the other, as they were added.
COMMON = " enirtasdhuloc"


def automaton(words: dict[str, list[int]]) -> ahocorasick.Automaton:
    """An automaton of some texts, each with its numbers."""
    machine = ahocorasick.Automaton()
    for c in COMMON:
        machine.add_word(c + "\0", ())
    for t, which in words.items():
        machine.add_word(t, tuple(which))
    machine.make_automaton()
    return machine


def line_ends(lines: Iterable[str]) -> list[int]:
    """Where each line ends in the text of them all."""
    ends, at = [], -1
    for line in lines:
        at += len(line) + 1
        ends.append(at)
    return ends


def by_line(machine: ahocorasick.Automaton, low: str, ends: list[int]) -> dict[int, set[int]]:
    """The numbers of the texts that each line (from 0) of a folded text holds."""
    out: dict[int, set[int]] = {}
    line, of, last = 0, None, None
    for end, which in machine.iter(low):
        if ends[line] < end:
            line, of = bisect_left(ends, end, line + 1), None
        elif which is last and of is not None:
            continue
        if of is None:
            of = out.setdefault(line, set())
        of.update(which)
        last = which
    return out


#: What Python's expressions and Java's may take differently: beyond ASCII letters and blanks, and below them four signs that only Python has as blanks.
_UNLIKE = re.compile("[^\0-\t\x0b-\x1b -\x7f]")


class Prefilter:
    """Texts of all patterns in one automaton; travels as patterns, is built once a worker.

    What holds the texts of a pattern is tried with it too where Python and Java agree on every match,
    so that Java, which compiles a pattern anew whenever rows change it, sees few rows.
    """

    def __init__(self, patterns: list[tuple[int, str]]):
        self.patterns = patterns
        self.machine = None

    def __reduce__(self):
        return (Prefilter, (self.patterns,))

    def build(self) -> None:
        self.always, self.regex, self.needed = [], {}, {}
        by: dict[str, list[int]] = {}
        for pid, p in self.patterns:
            p = re.sub(r"^\(\?Uud\)", "", p)
            texts = anchors(p)
            if texts is None:
                self.always.append((pid, needed_run(p)))
            for t in texts or ():
                by.setdefault(t, []).append(pid)
            self.needed[pid] = needs(p)
            self.regex[pid] = re.compile(p) if p.isascii() else None
        self.machine = automaton(by)

    def _found(self, text: str, lines: list[str]) -> dict[int, list[int]]:
        """The patterns worth trying on each line of a text; lines without any aren't there."""
        low = folded(text)
        found = by_line(self.machine, low, line_ends(lines))
        if lost := unlikely(low, set().union(*found.values()), self.needed):
            found = {i: pids - lost for i, pids in found.items()}
        data = None
        for pid, run in self.always:
            if run:
                data = text.encode("utf-8", "surrogatepass") if data is None else data
                if not run(data):
                    continue
            for i, line in enumerate(lines):
                if line and (run is None or run(line.encode("utf-8", "surrogatepass"))):
                    found.setdefault(i, set()).add(pid)
        out = {}
        for i, pids in found.items():
            if left := self._left(lines[i], pids):
                out[i] = left
        return out

    def _left(self, line: str, pids: set[int]) -> list[int]:
        if _UNLIKE.search(line):
            return sorted(pids)
        return [pid for pid in sorted(pids) if (p := self.regex[pid]) is None or p.search(line)]

    def candidates(self, lines: pa.Array) -> pa.Array:
        """array<int> of each line: the patterns that could match."""
        if self.machine is None:
            self.build()
        out, low = [], 0
        # a batch has a number of lines, whatever their length; so that memory is bounded, those of some bytes are taken at once
        ends = np.cumsum(pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False))
        while low < len(lines):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + STEP_BYTES, "right")))
            texts = [t or "" for t in lines.slice(low, high - low).to_pylist()]
            found = self._found("\n".join(texts), texts)
            out.append(pa.array([found.get(i, []) for i in range(len(texts))], pa.list_(pa.int32())))
            low = high
        return pa.chunked_array(out, pa.list_(pa.int32())).combine_chunks() if out else pa.array([], pa.list_(pa.int32()))

    def lines_of(self, texts: pa.Array) -> pa.Array:
        """array<struct<line_no, line, pids>> of each text: its lines, from 1, that patterns could match."""
        if self.machine is None:
            self.build()
        out = []
        for t in texts:
            text = (t.as_py() or "").replace("\r\n", "\n").replace("\r", "\n")
            lines = text.split("\n")
            out.append([{"line_no": i + 1, "line": lines[i], "pids": pids} for i, pids in sorted(self._found(text, lines).items())])
        return pa.array(out, pa.list_(pa.struct([("line_no", pa.int32()), ("line", pa.string()), ("pids", pa.list_(pa.int32()))])))


def candidate_patterns(line: Column | str, patterns: list[tuple[int, str]]) -> Column:
    """array<int> column: numbers of the patterns worth trying on a line."""
    prefilter = Prefilter(patterns)

    @F.arrow_udf("array<int>")
    def find(lines: pa.Array) -> pa.Array:
        return prefilter.candidates(lines)

    return find(line)


def candidate_lines(text: Column | str, patterns: list[tuple[int, str]]) -> Column:
    """array<struct<line_no: int, line: string, pids: array<int>>> column: the lines of a text on which patterns are worth trying, and which; the other lines never leave Python."""
    prefilter = Prefilter(patterns)

    @F.arrow_udf("array<struct<line_no: int, line: string, pids: array<int>>>")
    def find(texts: pa.Array) -> pa.Array:
        return prefilter.lines_of(texts)

    return find(text)
