"""What every match of a pattern must hold: a native test in front of the exact regex lane."""

from __future__ import annotations

import functools
import re
import sys
from re import _constants as ops, _parser

#: Characters that a pattern accepts at one place, as the set of them.
Run = tuple[frozenset[str], ...]
#: Larger character classes end a run; they tell little and make long patterns.
WIDEST = 8


@functools.cache
def _alike(char: str) -> frozenset[str]:
    """All characters that match ``char`` where case is ignored."""
    return frozenset(re.findall(re.escape(char), _every_character(), re.IGNORECASE)) | {char}


@functools.cache
def _every_character() -> str:
    return "".join(map(chr, range(sys.maxunicode + 1)))


def required(pattern: str, ignore_case: bool) -> list[Run]:
    """Alternatives of which every match of ``pattern`` holds one; none at all if nothing is known.

    From the parse tree: characters in a row make a run; a group adds what it must hold, a repeat what its first round must
    hold, an alternation one run of each of its branches, and look-ahead and look-behind what they must see. Of all that a match must
    hold, the choice is the one whose shortest run is the longest. Back-references, optional parts and negations add nothing.
    """
    tree = _parser.parse(pattern, re.IGNORECASE if ignore_case else 0)
    found = _clauses(tree, ignore_case or bool(tree.state.flags & re.IGNORECASE))
    return max(found, key=_worth, default=[])


def _worth(clause: list[Run]) -> tuple[int, int]:
    return min(map(len, clause)), -len(clause)


def _clauses(items, ignore_case: bool) -> list[list[Run]]:
    """Every clause is a list of runs, one of which a match of ``items`` in a row must hold."""
    clauses: list[list[Run]] = []
    run: list[frozenset[str]] = []

    def close():
        if run:
            clauses.append([tuple(run)])
            run.clear()

    for op, value in items:
        chars = _characters(op, value, ignore_case)
        if chars:
            run.append(chars)
            continue
        if op is ops.AT:
            continue  # takes no characters, so the run goes on
        if op is ops.SUBPATTERN:
            _, added, removed, inner = value
            inside = ignore_case or bool(added & re.IGNORECASE) or bool(removed & re.IGNORECASE)
            if all(_characters(o, v, inside) for o, v in inner):
                run += [_characters(o, v, inside) for o, v in inner]  # a plain group of characters is part of the run
                continue
            close()
            clauses += _clauses(inner, inside)
            continue
        close()
        if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            if value[0] > 0:
                clauses += _clauses(value[2], ignore_case)
        elif op is ops.ATOMIC_GROUP:
            clauses += _clauses(value, ignore_case)
        elif op is ops.ASSERT:
            clauses += _clauses(value[1], ignore_case)
        elif op is ops.BRANCH:
            chosen = [max(_clauses(branch, ignore_case), key=_worth, default=None) for branch in value[1]]
            if all(chosen):
                clauses.append([run for clause in chosen for run in clause])
    close()
    return clauses


def _characters(op, value, ignore_case: bool) -> frozenset[str]:
    """What one place of the pattern accepts, if it is few characters."""
    if op is ops.LITERAL:
        found = {chr(value)}
    elif op is ops.IN and len(value) <= WIDEST and all(o is ops.LITERAL for o, _ in value):
        found = {chr(v) for _, v in value}
    else:
        return frozenset()
    return frozenset().union(*map(_alike, found)) if ignore_case else frozenset(found)


def java_test(runs: list[Run]) -> str:
    """A pattern for ``rlike`` that finds any of the runs; the same to every regex engine."""
    def place(chars: frozenset[str]) -> str:
        return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars)) + "]"

    return "|".join("".join(map(place, run)) for run in runs)
