"""A tolerant tokenizer for C: tokens, comments and preprocessor lines with their places."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""
    (?:[ \t\r\f\v]|\\\r?\n)*+  # never given back, so that spaces at the end match nothing
    (?:
      (?P<newline>\n)
    | (?P<comment>//(?:\\\r?\n|[^\n])*|/\*.*?(?:\*/|\Z))
    | (?P<string>(?:u8|[LuU])?"(?:\\.|[^"\\\n])*"?)
    | (?P<char>(?:u8|[LuU])?'(?:\\.|[^'\\\n])*'?)
    | (?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)
    | (?P<ident>[^\W\d][\w$]*|\$[\w$]*)
    | (?P<punct>->|\+\+|--|<<=|>>=|\.\.\.|[-+*/%&|^=!<>]=|&&|\|\||<<|>>|.)
    )
    """,
    re.S | re.X,
)
_DIRECTIVE = re.compile(r'\#(?:\\\r?\n|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|//(?:\\\r?\n|[^\n])*|[^\n])*', re.S)
_HEAD = re.compile(r"#(?:[ \t]|\\\r?\n)*(\w*)")
_DEFINE = re.compile(r"#\s*define(?:[ \t]|\\\r?\n)+([A-Za-z_$][\w$]*)(\((?:\\\r?\n|[^)\n])*\))?((?:/(?!\*)|[^/])*)", re.S)


@dataclass(slots=True)
class Token:
    kind: str  # ident, number, string, char, punct
    text: str
    start: int
    end: int
    conditions: int  # index of its snapshot of the conditional stack
    before: int  # comments and preprocessor lines before it, in `Source.trivia`


@dataclass
class Define:
    name: str
    params: str | None
    body: str
    pos: int
    conditions: int


@dataclass
class Source:
    """The lexed text of a file."""

    text: str
    tokens: list[Token] = field(default_factory=list)
    trivia: list[tuple[str, int, int]] = field(default_factory=list)  # (comment or directive, start, end)
    stacks: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    defines: list[Define] = field(default_factory=list)
    tests: list[tuple[int, str]] = field(default_factory=list)  # offsets and texts of #if and #elif lines
    starts: list[int] = field(default_factory=list)

    def row(self, offset: int) -> int:
        """0-based line of an offset."""
        return bisect_right(self.starts, offset) - 1


def lex(text: str) -> Source:
    out = Source(text)
    out.starts = [0, *(m.end() for m in re.finditer("\n", text))]
    stack: list[tuple[str, bool]] = []  # (first line, opens a conditional)
    at, fresh, current = 0, True, 0
    token, tokens, trivia = _TOKEN.match, out.tokens, out.trivia
    while m := token(text, at):
        kind = m.lastgroup
        start, at = m.span(kind)
        if kind == "newline":
            fresh = True
        elif kind == "comment":
            trivia.append(("comment", start, at))
        elif fresh and kind == "punct" and text[start] == "#":
            at = _DIRECTIVE.match(text, start).end()
            current = _directive(out, stack, text[start:at], start, current)
            trivia.append(("directive", start, at))
        else:
            fresh = False
            tokens.append(Token(kind, m[kind], start, at, current, len(trivia)))
    return out


def _directive(out: Source, stack: list[tuple[str, bool]], line: str, at: int, current: int) -> int:
    """Takes note of a preprocessor line; returns the snapshot that holds after it."""
    word = _HEAD.match(line)[1]
    first = line.split("\n", 1)[0].strip()
    if word in ("if", "ifdef", "ifndef"):
        stack.append((first, True))
    elif word in ("elif", "else", "elifdef", "elifndef"):
        # the branches nest in the tree; lines of #elifdef are not named
        stack.append((first if word in ("elif", "else") else "", False))
    elif word == "endif":
        while stack and not stack.pop()[1]:
            pass
    elif word == "define":
        m = _DEFINE.match(line)
        if m:
            out.defines.append(Define(m[1], m[2], m[3].strip(), at + m.start(1), current))
    if word in ("if", "elif"):
        out.tests.append((at, line))
    if word in ("if", "ifdef", "ifndef", "elif", "else", "elifdef", "elifndef", "endif"):
        out.stacks.append(tuple(x for x, _ in stack if x))
        return len(out.stacks) - 1
    return current
