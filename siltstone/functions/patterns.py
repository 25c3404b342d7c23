"""Globs, literals and word borders as patterns that Catalyst can push down or compile once."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word border; Java's own counts accented letters as word characters.
BORDER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def normalize_glob(glob: str) -> str:
    """Shell globs for a matcher whose ``*`` also crosses ``/``: directories around ``**`` become optional."""
    glob = glob.removeprefix("**/").replace("/**/", "/")
    if glob.endswith("/**"):
        glob = glob[:-1]
    while "**" in glob:
        glob = glob.replace("**", "*")
    return glob.replace("//", "/")


def glob_regex(glob: str) -> str:
    """``*`` any run, ``?`` one character, ``[...]`` a class (``[^`` or ``[!`` negates), all else literal."""
    parts = []
    for piece in re.findall(r"\[[^\]]+\]|\*|\?|.", glob, flags=re.S):
        if piece == "*":
            parts.append(".*")
        elif piece == "?":
            parts.append(".")
        elif len(piece) > 1:
            body = piece[1:-1]
            negated = body[0] in "^!" and len(body) > 1
            body = body[1:] if negated else body
            parts.append(f"[{'^' if negated else ''}{body.replace(chr(92), chr(92) * 2).replace('[', chr(92) + '[')}]")
        else:
            parts.append(re.escape(piece))
    return f"(?s)^{''.join(parts)}$"


def matches_glob(path: Column, glob: str) -> Column:
    """A literal start is tested first, as a prefix that Parquet statistics can use."""
    glob = normalize_glob(glob)
    literal = re.match(r"[^*?\[]*", glob)[0]
    if literal == glob:
        return path == glob
    if glob == f"{literal}*":
        return path.startswith(literal)
    test = path.rlike(glob_regex(glob))
    return path.startswith(literal) & test if literal else test


def under(path: Column, scope: str) -> Column:
    """The path itself or anything below it."""
    scope = scope.strip("/")
    return (path == scope) | path.startswith(f"{scope}/") if scope else F.lit(True)


def line_pattern(needle: str, regex: bool = False, word: bool = False, ignore_case: bool = False) -> str:
    body = needle if regex else re.escape(needle)
    body = f"{BORDER}(?:{body}){BORDER}" if word else body
    return f"(?iu){body}" if ignore_case else body
