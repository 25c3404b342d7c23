"""Code without comments and strings, by a state machine that jumps from mark to mark."""

from __future__ import annotations

import re

# fixed values: words and characters after which a slash begins a pattern and isn't a division
PATTERN_WORDS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "do", "else", "yield", "await"}
PATTERN_MARKS = "=(,:;!&|?{}[+-*%<>~^"
_SCRIPT, _SLASHED = {"typescript", "javascript", "vue", "svelte"}, {"go", "rust", "swift", "c", "cpp", "objc", "java", "kotlin", "csharp", "scala", "php", "dart"}
_TRIPLE = {"python", "kotlin", "java", "swift", "scala", "csharp"}

_MARK = re.compile(r"//|/\*|/|\"{3}|'{3}|[\"'`{}#]")
_STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*{q}?", re.DOTALL) for q in "\"'"}
_CHARACTER = re.compile(r"'(?:\\[^\n]{1,10}?|[^'\\\n])'")
_PATTERN = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.DOTALL)
_LAST_WORD = re.compile(r"[A-Za-z_$]+$")
_FEEDS = re.compile(r"[^\n]+")


def _begins_pattern(before: str) -> bool:
    before = before.rstrip()
    word = _LAST_WORD.search(before)
    return not before or before[-1] in PATTERN_MARKS or (word is not None and word[0] in PATTERN_WORDS)


def blanked(text: str, language: str | None) -> str:
    """The text with comments, strings, patterns and templates gone, but for their line feeds and for the code within
    templates. What isn't closed goes on to the end of its line, or of the text where it may have several lines."""
    script, triple = language in _SCRIPT, language in _TRIPLE
    slashed = script or language in _SLASHED or language is None
    out: list[str] = []
    i, n, depth, outer, in_template = 0, len(text), 0, [], False

    def drop(upto: int) -> int:
        out.append(_FEEDS.sub("", text[i:upto]))
        return upto

    def end_of(mark: str, start: int) -> int:
        at = text.find(mark, start)
        return n if at < 0 else at + len(mark)

    while i < n:
        if in_template:
            m = _IN_TEMPLATE.search(text, i)
            i = drop(m.end() if m else n)
            if m and m[0] == "`":
                in_template = False
            elif m and m[0] == "${":
                outer.append(depth)
                depth, in_template = 0, False
            continue
        m = _MARK.search(text, i)
        out.append(text[i : m.start() if m else n])
        if not m:
            break
        i, mark = m.start(), m[0]
        if mark == "//" and slashed:
            i = drop(n if (at := text.find("\n", i)) < 0 else at)
        elif mark == "#" and language in ("python", "ruby", "shell", "yaml"):
            i = drop(n if (at := text.find("\n", i)) < 0 else at)
        elif mark == "/*" and slashed:
            i = drop(end_of("*/", i + 2))
        elif mark in ('"""', "'''") and triple:
            i = drop(end_of(mark, i + 3))
        elif mark == "`" and (script or language == "go"):
            if script:
                i, in_template = drop(i + 1), True
            else:
                i = drop(end_of("`", i + 1))
        elif mark[0] in "\"'":
            if mark[0] == "'" and language == "rust":
                m = _CHARACTER.match(text, i)
                if m:
                    i = drop(m.end())
                else:  # a lifetime
                    out.append("'")
                    i += 1
            else:
                i = drop(_STRING[mark[0]].match(text, i).end())
        elif mark[0] == "/" and script and _begins_pattern("".join(out[-3:])[-40:]) and (m := _PATTERN.match(text, i)):
            i = drop(m.end())
        elif mark == "}" and outer and depth == 0:
            depth, in_template, i = outer.pop(), True, i + 1
        else:
            depth += {"{": 1, "}": -1}.get(mark, 0)
            out.append(mark)
            i += len(mark)
    return "".join(out)
