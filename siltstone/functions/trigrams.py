"""Runs of three characters that a text must hold for a pattern to match at all."""

from __future__ import annotations

import re
from itertools import product

#: A condition: None for no condition, or ``("and" | "or", parts)`` whose parts are conditions or trigrams.
Condition = tuple | str | None
#: Spellings of a stretch of a pattern that are told apart; beyond that the stretch is cut.
MOST_SPELLINGS = 16


def folded(text: str) -> str:
    """A-Z in lower case, in which filters are kept; the long s and the sign of kelvin are s and k, as they match them where
    case counts for nothing."""
    return text.translate(_FOLD)


_FOLD = {c: c + 32 for c in range(65, 91)} | {0x17F: 115, 0x212A: 107}


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _all(parts: list[Condition]) -> Condition:
    known = [p for p in parts if p is not None]
    return ("and", known) if len(known) > 1 else (known[0] if known else None)


def _any(parts: list[Condition]) -> Condition:
    return None if not parts or any(p is None for p in parts) else (("or", parts) if len(parts) > 1 else parts[0])


def _of_spellings(spellings: list[str]) -> Condition:
    return _any([_all(sorted(trigrams(folded(s)))) for s in spellings])


def _letters(arg) -> list[str] | None:
    """Spellings of a class of characters, if they are few."""
    out: list[str] = []
    for op, value in arg:
        if str(op) == "LITERAL":
            out.append(chr(value))
        elif str(op) == "RANGE" and value[1] - value[0] < MOST_SPELLINGS:
            out += [chr(c) for c in range(value[0], value[1] + 1)]
        else:
            return None
    return sorted({folded(c) for c in out})


def _condition(parsed, ignore_case: bool) -> Condition:
    conditions, run = [], [""]

    def cut() -> None:
        nonlocal run
        if run != [""]:
            conditions.append(_of_spellings(run))
        run = [""]

    def grow(options: list[str]) -> None:
        nonlocal run
        if len(run) * len(options) > MOST_SPELLINGS:
            cut()
        run = [a + b for a, b in product(run, options)]

    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL" and (not ignore_case or arg < 128):
            grow([chr(arg)])
        elif name == "IN" and not ignore_case and (options := _letters(arg)):
            grow(options)
        elif name == "IN" and ignore_case and (options := _letters(arg)) and all(ord(c) < 128 for c in options):
            grow(options)
        elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
            cut()
            conditions.append(_condition(arg[3], ignore_case))
        elif name == "BRANCH":
            cut()
            conditions.append(_any([_condition(b, ignore_case) for b in arg[1]]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            cut()
            if arg[0] >= 1:
                conditions.append(_condition(arg[2], ignore_case))
        elif name != "AT":
            cut()
    cut()
    return _all(conditions)


def required(pattern: str, ignore_case: bool = False) -> Condition:
    """What a text must hold, in lower case, for ``pattern`` to match in it; None where nothing is known, as of patterns
    that this parser doesn't read."""
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, OverflowError):
        return None
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) or "(?" in pattern.replace("(?:", "") or "\\Q" in pattern or "&&" in pattern:
        return None
    return _condition(parsed, ignore_case)


def holds(condition: Condition, has) -> bool:
    """Whether a condition can hold where ``has(trigram)`` may be true by mistake, but never false by mistake."""
    if condition is None:
        return True
    if isinstance(condition, str):
        return has(condition)
    return (all if condition[0] == "and" else any)(holds(p, has) for p in condition[1])
