"""Taint flow over the structure of a file: statements, scopes and call arguments, over as many lines as they take.

A file's pieces become a tree of brackets, statements and blocks that never
refuses a text: a bracket without a partner ends with its block.  Blocks open
scopes; a name belongs to the scope that declares it.  Walking the statements
in order, an assignment hands what its right side carries to its targets, and a
call (or an assignment to a property) that does harm takes what its arguments
carry.  Each file is independent, so files run in parallel on Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.functions.lexer import pieces
from codesift.operators.taint import CLEANSERS, SINKS, SOURCES, Taint

PAIRS = {"(": ")", "[": "]", "{": "}"}
INDENTED = ("python",)
WORDED = ("ruby",)
#: Languages in which a line feed ends a statement that could end there.
LINE_ENDED = ("javascript", "typescript", "python", "go", "kotlin", "swift", "ruby")
#: Languages whose names take a type after a colon.
COLON_TYPES = ("typescript", "python", "kotlin", "swift", "rust")
DECLARE = ("const", "let", "var", "val", "final", "auto", "my", "local")
HEADS = ("if", "for", "foreach", "while", "switch", "else", "try", "do", "catch", "except", "finally", "with", "using", "match", "when", "elif", "elsif", "unless", "until", "loop", "synchronized")
FUNCTIONS = ("function", "func", "fn", "fun", "def")
JOINS = (".", "?.", "::", "->")
#: A line that ends or begins with one of these goes on.
GOES_ON = frozenset("= + - * / % & | ^ < > ! ~ , ? : . \\".split()) | {"=>", "->", "&&", "||", "??", "==", ":=", "+=", "?.", "::"}
TAKES_ON = frozenset(". ? : + * / % & | ^ = , && || ?? ?. -> ::".split())
SIGNS = ("===", "!==", "**=", "<<=", ">>=", "...", "=>", "->", "::", "?.", "??", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", ".=", "|=", "&=", ":=", "++", "--")
ASSIGN = ("=", ":=", "+=", ".=", "-=", "*=", "/=", "|=", "&=", "??=", "||=")
COLUMNS = "path string, language string, source string, source_line int, sink string, sink_kind string, sink_line int, steps int, argument int"


@dataclass
class Token:
    kind: str  # word, sign, text, group, block
    text: str
    line: int
    items: list = field(default_factory=list)  # of a group: tokens; of a block: statements; of a text with values: tokens


@dataclass
class Statement:
    tokens: list[Token]
    block: list[Statement] | None = None  # statements that it heads, in a scope of their own


def tokens(language: str, text: str, line: int = 1) -> list[Token]:
    """Words, signs and texts; texts hold the tokens of the values that they take in."""
    out: list[Token] = []
    found = list(pieces(language, text))
    i = 0
    while i < len(found):
        kind, begin, end = found[i]
        piece = text[begin:end]
        if kind == "word":
            out.append(Token("word", piece, line))
        elif kind == "newline":
            # Indented lines tell their depth.
            after = found[i + 1] if i + 1 < len(found) else ("", 0, 0)
            out.append(Token("newline", text[after[1] : after[2]].expandtabs(8) if after[0] == "space" else "", line + 1))
        elif kind in ("string", "template", "filled", "regex"):
            values = interpolated(language, piece, out[-1].text if out and out[-1].kind == "word" and found[i - 1][0] == "word" else "") if kind != "regex" else []
            out.append(Token("text", piece, line, [t for v in values for t in tokens(language, v, line)]))
        elif kind in ("import", "type"):
            out.append(Token("import", piece, line))
        elif kind == "sign":
            sign = piece.strip()
            # Signs of several characters are pieces of one each: join those that stand together.
            while i + 1 < len(found) and found[i + 1][0] == "sign" and any(s.startswith(sign + text[found[i + 1][1]]) for s in SIGNS):
                i += 1
                sign += text[found[i][1] : found[i][2]]
            while sign and sign not in SIGNS and len(sign) > 1:  # a mere beginning of a sign
                sign, i = sign[:-1], i - 1
            if sign:
                out.append(Token("sign", sign, line))
            end = found[i][2]
        line += text.count("\n", begin, end)
        i += 1
    return out


def interpolated(language: str, piece: str, prefix: str) -> list[str]:
    """The values that a text takes in."""
    if piece.startswith("`") or language in ("kotlin",) and piece.startswith('"'):
        return braced(piece, "${") + (re.findall(r"\$(\w+)", piece) if language == "kotlin" else [])
    if language == "python" and "f" in prefix.lower() and len(prefix) <= 2:
        return braced(piece.replace("{{", "  "), "{")
    if language == "ruby" and piece.startswith('"'):
        return braced(piece, "#{")
    if language == "php" and piece.startswith('"'):
        return [*braced(piece, "{"), *re.findall(r"\$\w+", piece)]
    if language == "csharp" and prefix == "$" or language == "swift":
        return braced(piece, "{" if language == "csharp" else "\\(")
    return []


def braced(piece: str, opener: str) -> list[str]:
    """The texts between an opener and its closing bracket."""
    out, at = [], piece.find(opener)
    close = PAIRS[opener[-1]]
    while at >= 0:
        i, depth = at + len(opener), 1
        while i < len(piece) and depth:
            depth += (piece[i] == opener[-1]) - (piece[i] == close)
            i += 1
        out.append(piece[at + len(opener) : i - (not depth)])
        at = piece.find(opener, i)
    return out


class Reader:
    """Tokens to statements."""

    def __init__(self, language: str, found: list[Token]):
        self.language, self.found, self.at = language, found, 0
        self.lines = language in LINE_ENDED

    def statements(self, closer: str | None) -> list[Statement]:
        """Statements up to the closing bracket, which is taken, or the end."""
        out: list[Statement] = []
        now: list[Token] = []

        def end(block: list[Statement] | None = None) -> None:
            nonlocal now
            if now or block:
                out.append(Statement(now, block))
            now = []

        while self.at < len(self.found):
            t = self.found[self.at]
            self.at += 1
            if t.kind == "newline":
                if self.language in INDENTED and now and now[-1].text == "\\":
                    now.pop()
                elif self.language in INDENTED:
                    end()
                    out.append(Statement([t]))  # its depth is read by indented()
                elif self.ends(now):
                    end()
            elif t.kind == "import":
                end()
            elif t.text == ";" and t.kind == "sign":
                if self.language == "go" and now and now[0].text in HEADS:
                    now.append(t)  # a head of several clauses
                else:
                    end()
            elif t.kind == "sign" and t.text in PAIRS:
                if t.text == "{" and self.opens_block(now):
                    end(self.statements("}"))
                else:
                    now.append(self.group(t))
            elif t.kind == "sign" and t.text in PAIRS.values():
                if t.text == closer:
                    break
            else:
                now.append(t)
        end()
        return out

    def group(self, opener: Token) -> Token:
        """The tokens between two brackets; blocks in them are read as blocks."""
        items: list[Token] = []
        close = PAIRS[opener.text]
        while self.at < len(self.found):
            t = self.found[self.at]
            self.at += 1
            if t.kind in ("newline", "import"):
                continue
            if t.kind == "sign" and t.text in PAIRS:
                if t.text == "{" and items and (items[-1].text in ("=>", "->") or items[-1].text == "(" and items[-1].kind == "group" and self.language not in INDENTED):
                    items.append(Token("block", "{", t.line, self.statements("}")))
                else:
                    items.append(self.group(t))
            elif t.kind == "sign" and t.text in PAIRS.values():
                if t.text == close:
                    break
                if t.text == "}":  # the bracket was never closed: its block ends here
                    self.at -= 1
                    break
            else:
                items.append(t)
        return Token("group", opener.text, opener.line, items)

    def ends(self, now: list[Token]) -> bool:
        """Whether a line feed ends the statement."""
        if not self.lines or not now or now[-1].kind == "sign" and now[-1].text in GOES_ON:
            return False
        after = self.found[self.at] if self.at < len(self.found) else None
        return not (after and after.kind == "sign" and after.text in TAKES_ON)

    def opens_block(self, now: list[Token]) -> bool:
        """Whether a brace after these tokens opens a block rather than a value."""
        if self.language in INDENTED:
            return False
        if not now or now[-1].text in ("=>", "->") or now[0].text in HEADS or now[0].text in FUNCTIONS:
            return True
        assigned = any(t.kind == "sign" and t.text in ASSIGN for t in now)
        last = now[-1]
        if last.kind == "group" and last.text == "(":
            return self.language != "go" or not assigned
        return last.kind == "word" and last.text not in ("return", "yield", "await", *DECLARE) and not assigned


def indented(found: list[Statement]) -> list[Statement]:
    """Statements of an indented language as blocks: a head takes all that is deeper."""
    lines: list[tuple[int, Statement]] = []
    depth = 0
    for s in found:
        if len(s.tokens) == 1 and s.tokens[0].kind == "newline":
            depth = len(s.tokens[0].text)
        elif s.tokens:
            lines.append((depth, s))

    def take(i: int, least: int) -> tuple[list[Statement], int]:
        out: list[Statement] = []
        while i < len(lines) and lines[i][0] >= least:
            depth, s = lines[i]
            i += 1
            if i < len(lines) and lines[i][0] > depth:
                s.block, i = take(i, depth + 1)
            out.append(s)
        return out, i

    return take(0, 0)[0]


def worded(found: list[Statement]) -> list[Statement]:
    """Statements of a language whose blocks end with a word: definitions take all up to their end."""

    def take(i: int) -> tuple[list[Statement], int]:
        out: list[Statement] = []
        while i < len(found):
            s = found[i]
            i += 1
            first = s.tokens[0].text if s.tokens else ""
            if first == "end":
                break
            if first in (*FUNCTIONS, "class", "module", "begin", "case", *HEADS) and first not in ("else", "elsif", "when", "rescue", "ensure") or any(t.text == "do" and t.kind == "word" for t in s.tokens):
                s.block, i = take(i)
            out.append(s)
        return out, i

    out: list[Statement] = []
    i = 0
    while i < len(found):  # an end too many ends nothing
        more, i = take(i) if i == 0 else take(i)
        out += more
    return out


def structure(language: str, text: str) -> list[Statement]:
    found = Reader(language, tokens(language, text)).statements(None)
    return indented(found) if language in INDENTED else worded(found) if language in WORDED else found


@dataclass
class Chain:
    """A name with its members, as ``a.b``, and if it is called, its arguments."""

    name: str
    line: int
    call: Token | None = None
    rest: list[Token] = field(default_factory=list)  # indexes and values of a text


def chains(items: Sequence[Token], joins: Sequence[str] = JOINS) -> list[Chain]:
    """Names of an expression from left to right; a call ends a chain and members of its result begin one of their own."""
    out: list[Chain] = []
    i = 0
    while i < len(items):
        t = items[i]
        mark = t.text if t.kind == "sign" and t.text == "@" and i + 1 < len(items) and items[i + 1].kind == "word" else ""
        if t.kind == "word" or mark:
            i += bool(mark)
            name, rest = mark + items[i].text, []
            i += 1
            while i < len(items):
                if items[i].kind == "sign" and items[i].text in joins and i + 1 < len(items) and items[i + 1].kind == "word":
                    name += "." + items[i + 1].text
                    i += 2
                elif items[i].kind == "group" and items[i].text == "[":
                    rest.append(items[i])
                    i += 1
                else:
                    break
            call = items[i] if i < len(items) and items[i].kind == "group" and items[i].text == "(" else None
            i += call is not None
            out.append(Chain(name, t.line, call, rest))
        elif t.kind in ("group", "text") and t.items:
            out.append(Chain("", t.line, None, t.items))
            i += 1
        else:
            if t.kind == "sign" and t.text in joins and out and out[-1].call and i + 1 < len(items) and items[i + 1].kind == "word":
                # f(x).g(y): the method of a result.
                name = out[-1].name + "()." + items[i + 1].text
                i += 2
                call = items[i] if i < len(items) and items[i].kind == "group" and items[i].text == "(" else None
                i += call is not None
                out.append(Chain(name, t.line, call))
            else:
                i += 1
    return out


def parts(items: Sequence[Token], sign: str = ",") -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    for t in items:
        if t.kind == "sign" and t.text == sign:
            out.append([])
        else:
            out[-1].append(t)
    return out


def plain(needle: str) -> str:
    """A fixed name without its brackets, its members joined by points."""
    return re.sub(r"::|->", ".", re.sub(r"\(.*$", "", needle)).strip(" .")


def is_source(name: str, needle: str) -> bool:
    n = plain(needle)
    return name == n or name.startswith(n + ".") or n[:1].isupper() and "." in n and name.endswith("." + n.rsplit(".", 1)[1])


def is_call(name: str, needle: str) -> bool:
    n = plain(needle).removeprefix("new ")
    return name == n or name.endswith("." + n) or n[:1].isupper() and "." in n and name.endswith("." + n.rsplit(".", 1)[1])


def _words(needle: str) -> tuple[str, ...]:
    """Words that stand in a text wherever ``is_source`` or ``is_call`` finds a fixed name: of one in capitals the last member's, else all."""
    names = plain(needle).removeprefix("new ").split(".")
    return tuple(w for n in (names[-1:] if names[0][:1].isupper() else names) for w in re.findall(r"[\w$]+", n))


SOURCE_WORDS = {language: tuple(dict.fromkeys(map(_words, needles))) for language, needles in SOURCES.items()}
SINK_WORDS = {language: tuple(dict.fromkeys(_words(s)[-1] for s, _ in sinks)) for language, sinks in SINKS.items()}


def may_flow(language: str, text: str) -> bool:
    """False of texts that lack all words of any source, or of any sink: they need not be read."""
    return any(w in text for w in SINK_WORDS.get(language, ())) and any(all(w in text for w in ws) for ws in SOURCE_WORDS.get(language, ()))


class Scope:
    def __init__(self, outer: Scope | None, function: bool):
        self.outer, self.function = outer, function
        self.names: dict[str, list[Taint]] = {}

    def holder(self, name: str) -> Scope | None:
        scope: Scope | None = self
        while scope and name not in scope.names:
            scope = scope.outer
        return scope

    def carried(self, name: str) -> list[Taint]:
        """What a name or the nearest name that it is a member of carries."""
        while name:
            scope = self.holder(name)
            if scope:
                return scope.names[name]
            name = name.rpartition(".")[0]
        return []


class Walk:
    """The flows of one file."""

    def __init__(self, language: str, through_calls: bool = False):
        self.language, self.through = language, through_calls
        self.sources, self.sinks, self.cleansers = SOURCES[language], SINKS[language], CLEANSERS.get(language, ())
        self.flows: list[tuple[str, int, str, str, int, int, int]] = []

    def chains(self, items: Sequence[Token]) -> list[Chain]:
        # Where a point joins texts, members follow an arrow.
        return chains(items, ("->", "::", "?->") if self.language == "php" else JOINS)

    def carries(self, items: Sequence[Token], scope: Scope) -> list[Taint]:
        """What an expression carries: sources in it, and names that are not arguments of an unknown call."""
        out: list[Taint] = []
        for c in self.chains(items):
            if c.name:
                out += [Taint(s, c.line, 0, frozenset()) for s in self.sources if is_source(c.name, s)]
                clean = frozenset(k for needle, kinds in self.cleansers if c.call is not None and is_call(c.name, needle) for k in kinds)
                if c.call is None:
                    out += scope.carried(c.name)
                elif clean:
                    out += [Taint(t.source, t.line, t.steps, t.clean | clean) for t in self.carries(c.call.items, scope)]
                elif self.through:
                    out += scope.carried(c.name.rpartition(".")[0]) + self.carries(c.call.items, scope)
                else:
                    out += self.carries(c.call.items, Scope(None, False))  # sources alone
            out += self.carries(c.rest, scope)
        return list(dict.fromkeys(out))

    def blocks(self, items: Sequence[Token], scope: Scope) -> None:
        """Functions within an expression, each in its own scope."""
        for k, t in enumerate(items):
            if t.kind == "block":
                inner = Scope(scope, True)
                self.declare(items[:k], inner)
                self.run(t.items, inner, inner)
            elif t.kind == "group":
                self.blocks(t.items, scope)

    def declare(self, head: Sequence[Token], scope: Scope) -> None:
        """The parameters of a function: new names, tainted only if they are marked as a source."""
        group = next((t for t in reversed(head) if t.kind == "group" and t.text == "("), None)
        params = parts(group.items) if group else [[t] for t in head[-2:-1] if t.kind == "word"]
        for p in params:
            names = [c for c in self.chains(self.untyped(p)) if c.name and not c.name.startswith("@")]
            if names:
                marked = [Taint(s, p[0].line, 0, frozenset()) for c in self.chains(p) if c.name.startswith("@") for s in self.sources if is_source(c.name, s)]
                name = names[0] if self.language == "go" else names[-1]
                scope.names[name.name] = marked

    def untyped(self, items: Sequence[Token]) -> list[Token]:
        if self.language in COLON_TYPES:
            items = parts(items, ":")[0]
        return parts(items, "=")[0]

    def targets(self, left: Sequence[Token]) -> list[str]:
        """The names on the left of an assignment: one, several, or those of a pattern."""
        out = []
        for p in parts(self.untyped(left)):
            if p and p[-1].kind == "group" and p[-1].text in "{[(" and not any(t.kind == "word" and t.text not in DECLARE for t in p):
                out += [c.name for q in parts(p[-1].items) for c in self.chains(parts(q, "=")[0])[-1:] if c.name]
            else:
                out += [c.name for c in self.chains(p)[-1:] if c.name]
        return out

    def assign(self, names: Sequence[str], carried: list[Taint], scope: Scope, function: Scope, declared: bool, adds: bool) -> None:
        best: dict[tuple[str, int], Taint] = {}
        for t in carried:
            t = Taint(t.source, t.line, t.steps + 1, t.clean)
            # One chain of each source is enough: the least cleansed, then the shortest.
            key = (t.source, t.line)
            if key not in best or (len(t.clean), t.steps) < (len(best[key].clean), best[key].steps):
                best[key] = t
        # Where only functions have names of their own, a block's assignments go to the function.
        own = self.language in INDENTED or self.language in WORDED or self.language == "php"
        for name in names:
            owner = scope if declared and not own else function if own else scope.holder(name) or function
            # In a branch, what a name carried before may still hold after it.
            before = owner.names.get(name, []) if adds or owner is not scope and owner is not function or owner is function and scope is not function else []
            owner.names[name] = list(dict.fromkeys([*before, *best.values()]))

    def harm(self, items: Sequence[Token], scope: Scope) -> None:
        """Calls that do harm, wherever in the expression."""
        for k, t in enumerate(items):
            if t.kind == "word" and t.text == "echo" and any(s == "echo " for s, _ in self.sinks):
                self.report("echo ", t.line, 0, items[k + 1 :], scope)
        for c in self.chains(items):
            if c.call is not None:
                for needle, _ in self.sinks:
                    if needle.endswith("(") or "." in needle:
                        if is_call(c.name, needle):
                            for n, arg in enumerate(parts(c.call.items), 1):
                                self.report(needle, c.line, n, arg, scope)
                self.harm(c.call.items, scope)
            self.harm(c.rest, scope)

    def report(self, sink: str, line: int, argument: int, items: Sequence[Token], scope: Scope) -> None:
        kind = next(k for s, k in self.sinks if s == sink)
        for t in self.carries([t for t in items if t.kind != "block"], scope):
            if kind not in t.clean:
                self.flows.append((t.source, t.line, sink, kind, line, t.steps, argument))

    def run(self, statements: Sequence[Statement], scope: Scope, function: Scope) -> None:
        for s in statements:
            head = [t.text for t in s.tokens if t.kind == "word"]
            first = head[0] if head else ""
            # What a head declares is its block's.
            inner = Scope(scope, False) if s.block is not None and first in HEADS else scope
            if s.tokens:
                self.statement(s.tokens, inner, function, first)
                self.blocks(s.tokens, inner)
            if s.block is not None:
                named = any(w in FUNCTIONS for w in head) or first not in HEADS and any(t.kind == "group" and t.text == "(" for t in s.tokens) or any(t.text in ("=>", "->") for t in s.tokens)
                inner = Scope(scope, True) if named else Scope(scope, False) if inner is scope else inner
                if named:
                    self.declare([t for t in s.tokens if t.kind != "block"], inner)
                self.run(s.block, inner, inner if named else function)

    def statement(self, items: list[Token], scope: Scope, function: Scope, first: str) -> None:
        if first in ("for", "foreach"):
            inside = items[1].items if len(items) > 1 and items[1].kind == "group" else items[1:]
            for word in ("of", "in", "as"):
                at = next((k for k, t in enumerate(inside) if t.kind == "word" and t.text == word), None)
                if at is not None:
                    left, right = (inside[at + 1 :], inside[:at]) if word == "as" else (inside[:at], inside[at + 1 :])
                    self.assign(self.targets(left), self.carries(right, scope), scope, function, False, True)
                    break
        if first in HEADS and len(items) > 1 and items[1].kind == "group":
            items = [*items[1].items, *items[2:]]
        elif first in HEADS:
            items = items[1:]
        for clause in parts(items, ";") if first in HEADS else [items]:
            several = [p for p in parts(clause)]
            if sum(any(t.kind == "sign" and t.text in ASSIGN for t in p) for p in several) < 2:
                several = [clause]
            declared = False
            for p in several:
                at = next((k for k, t in enumerate(p) if t.kind == "sign" and t.text in ASSIGN), None)
                if at is None or any(t.text in FUNCTIONS for t in p[:at] if t.kind == "word"):
                    self.harm(p, scope)
                    continue
                left, sign, right = p[:at], p[at].text, p[at + 1 :]
                typed = len([t for t in parts(left, ":")[0] if t.kind == "word"]) > len([t for t in left if t.kind == "sign" and t.text in JOINS]) + 1 and not any(t.text == "," for t in left)
                declared = declared or sign == ":=" or typed or any(t.kind == "word" and t.text in DECLARE for t in left)
                self.harm(right, scope)
                names = self.targets(left)
                for name in names:
                    for needle, _ in self.sinks:
                        if not needle.endswith(("(", " ")) and name.endswith("." + needle):
                            self.report(needle, left[0].line, 0, right, scope)
                if any(t.kind == "sign" and t.text == "=>" for t in right):
                    continue  # a function, not its result
                self.assign(names, self.carries([t for t in right if t.kind != "block"], scope), scope, function, declared, sign not in ("=", ":="))


def structural_flows(language: str, content: str, through_calls: bool = False) -> list[tuple[str, int, str, str, int, int, int]]:
    """source, source line, sink, kind, sink line, steps and argument of every flow of one file, each once, by line of the sink."""
    walk = Walk(language, through_calls)
    top = Scope(None, True)
    walk.run(structure(language, content), top, top)
    return sorted(dict.fromkeys(walk.flows), key=lambda f: (f[4], f[2], f[6], f[1], f[0], f[5]))


def structure_flows(files: DataFrame, through_calls: bool = False) -> DataFrame:
    """path, language, source, source_line, sink, sink_kind, sink_line, steps and argument of each flow into a sink (path, language, content).

    Statements, scopes, patterns on the left, texts that take in values,
    functions within calls and calls over several lines are seen.  argument: the
    place of the call's argument that carries the data, 0 for a property or an
    output statement.  steps: the assignments between.  Arguments of unknown
    calls hand nothing to the call's result unless ``through_calls``; a source
    among them does.  An assignment replaces what a name carried, but in a branch
    it adds to it.  A cleanser ends the kinds of harm it cleanses.

    Null contents and languages without sources give no flows; a text with
    brackets that do not match is read as far as they do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                if may_flow(language, content):
                    rows += [(path, language, *f) for f in structural_flows(language, content, through_calls)]
            if rows:
                types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    # A source's members may stand on lines of their own, so its first name is looked for.
    first = F.create_map(*(F.lit(x) for language, values in SOURCES.items() for x in (language, "|".join(sorted({re.escape(v if "." not in v or v[0] == "$" else re.split(r"[.:(]", v)[-1] or v if v[0].isupper() else re.split(r"[.:(]", v)[0]) for v in (plain(s) for s in values)})))))
    some = files.where(F.rlike("content", F.try_element_at(first, F.col("language"))))
    return some.select("path", "language", "content").mapInArrow(run, COLUMNS)
