"""Literals and comments of one line, for operators that read line by line; ``functions.lexer`` reads whole files."""

from __future__ import annotations

import re

#: After one of these words a slash begins an expression, not a division.
BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do")


def spans(line: str) -> list[tuple[int, int, str]]:
    """begin, end (exclusive) and kind of each literal and comment of a line: string, template, filled (a template with a value), regex, comment."""
    out: list[tuple[int, int, str]] = []
    i, last = 0, ""
    while i < len(line):
        c = line[i]
        if c in "\"'`":
            j = i + 1
            while j < len(line) and line[j] != c:
                j += 2 if line[j] == "\\" else 1
            kind = "string" if c != "`" else "filled" if "${" in line[i:j] else "template"
            out.append((i, min(j + 1, len(line)), kind))
            i, last = j + 1, c
        elif line.startswith("//", i) and last != ":" or line.startswith("/*", i):
            end = line.find("*/", i + 2) + 2 if line[i + 1] == "*" else len(line)
            out.append((i, end if end > 1 else len(line), "comment"))
            i = out[-1][1]
        elif c == "/" and (not last or last in "(,=:[!&|?{};+-*%<>~^" or re.search(rf"\b(?:{'|'.join(BEFORE_REGEX)})\s*$", line[:i])):
            j, inside = i + 1, False
            while j < len(line) and (line[j] != "/" or inside):
                if line[j] == "\\":
                    j += 1
                elif line[j] in "[]":
                    inside = line[j] == "["
                j += 1
            if j < len(line):
                out.append((i, j + 1, "regex"))
                i, last = j + 1, "/"
            else:  # a lone slash
                i, last = i + 1, c
        else:
            last = last if c.isspace() else c
            i += 1
    return out


def code_of(line: str) -> str:
    """A line with its comments, expressions and plain templates blanked out."""
    if "/" in line or "`" in line:
        for begin, end, kind in spans(line):
            if kind in HARMLESS:
                line = line[:begin] + " " * (end - begin) + line[end:]
    return line


#: What is no code.  Text in quotes may be: a password or a piece of SQL is text.
HARMLESS = ("regex", "comment", "template")
