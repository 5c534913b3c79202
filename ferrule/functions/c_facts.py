"""Facts of one C file: functions, calls, symbols, types and file-scope variables.

Nothing is preprocessed: both branches of a conditional count, macros aren't expanded, and
text that is no valid C yields what can be made out of it.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from typing import NamedTuple

from ferrule.functions.c_tokens import Source, Token, lex

#: Longest value of a macro in bytes; a longer one is cut at a character and marked.
VALUE_BYTES = 200
#: Kinds of facts.
KINDS = ("function", "call", "symbol", "type", "global")
#: Fixed word lists of the language.
TYPE_WORDS = frozenset("void char short int long float double signed unsigned _Bool _Complex _Imaginary __int128 __signed__".split())
QUALIFIERS = frozenset("const volatile restrict _Atomic __restrict __restrict__ __const __volatile__ __extension__ _Noreturn noreturn __inline __inline__ inline static extern register auto _Thread_local thread_local __thread constexpr typedef struct union enum".split())
PRIMITIVE = frozenset(
    "bool char int float double void size_t ssize_t ptrdiff_t intptr_t uintptr_t charptr_t nullptr_t max_align_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t char8_t char16_t char32_t char64_t".split()
)
ATTRIBUTES = frozenset("__attribute__ __attribute __declspec __asm__ __asm asm _Alignas alignas __based".split())
STATEMENTS = frozenset("if else for while do switch case default return goto break continue".split())
NO_CALLS = STATEMENTS | ATTRIBUTES | QUALIFIERS | TYPE_WORDS | frozenset("sizeof alignof _Alignof __alignof__ offsetof _Generic defined typeof __typeof__ __typeof typeof_unqual __builtin_va_arg".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class Fact(NamedTuple):
    """fact, name, kind (of a call: its callee), line, pos, text, flag, conditions"""

    fact: str
    name: str
    kind: str | None
    line: int
    pos: int
    text: str | None
    flag: bool | None
    conditions: tuple[str, ...]


def trim_value(text: str) -> str:
    text = text.strip()
    raw = text.encode("utf-8", "surrogatepass")
    return text if len(raw) <= VALUE_BYTES else raw[:VALUE_BYTES].decode("utf-8", "ignore") + "…"


class _File:
    def __init__(self, source: str, kinds: Collection[str] = KINDS):
        self.src: Source = lex(source)
        self.tokens: list[Token] = self.src.tokens
        self.texts = [t.text for t in self.tokens]
        self.kinds = kinds
        self.match = self._matches()

    def _matches(self) -> list[int]:
        """Index of the partner of each bracket, or the number of tokens."""
        n = len(self.tokens)
        out, open_ = [n] * n, []
        for i, t in enumerate(self.tokens):
            if t.kind != "punct":
                continue
            if t.text in _PAIRS:
                open_.append(i)
            elif t.text in ")]}":
                # a closer matches the nearest opener of its kind; a brace closes what was left open in it
                for k in range(len(open_) - 1, -1, -1):
                    opener = self.tokens[open_[k]].text
                    if _PAIRS[opener] == t.text:
                        out[open_[k]] = i
                        out[i] = open_[k]
                        del open_[k:]
                        break
                    if opener == "{":
                        break
        return out

    def is_(self, i: int, text: str) -> bool:
        # no token of another kind has the text of a punctuator
        return 0 <= i < len(self.texts) and self.texts[i] == text

    def ident(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "ident"

    def plain(self, i: int) -> bool:
        """An identifier that is no word of the language."""
        return self.ident(i) and self.tokens[i].text not in NO_CALLS

    def conditions(self, i: int) -> tuple[str, ...]:
        return self.src.stacks[self.tokens[i].conditions]

    def line(self, i: int) -> int:
        return self.src.row(self.tokens[i].start) + 1

    def text(self, i: int, j: int) -> str:
        return self.src.text[self.tokens[i].start : self.tokens[j].end]

    def skip(self, i: int) -> int:
        """Index after token i, or after its group if it opens one."""
        return self.match[i] + 1 if self.texts[i] in _PAIRS else i + 1

    def bare(self, start: int, end: int) -> list[int]:
        """Top-level token indices of a range, without attributes and their groups; an opener stands for its group."""
        out, i, texts = [], start, self.texts
        while i < end:
            text = texts[i]
            if text in ATTRIBUTES:
                i += 1
                while i < end and self.ident(i) and self.tokens[i].text in ("volatile", "__volatile__", "goto"):
                    i += 1
                if i < end and self.is_(i, "("):
                    i = self.skip(i)
                continue
            after = self.match[i] + 1 if text in _PAIRS else i + 1
            if text != "[" or not self.is_(i + 1, "["):  # [[attribute]]
                out.append(i)
            i = after
        return out

    # --- any depth -----------------------------------------------------------------

    def symbols(self) -> Iterator[Fact]:
        for d in self.src.defines:
            line, conditions = self.src.row(d.pos) + 1, self.src.stacks[d.conditions]
            body = trim_value(d.body) if d.body else None
            if d.params is None:
                yield Fact("symbol", d.name, "define", line, d.pos, body, None, conditions)
            else:
                yield Fact("symbol", d.name, "macro_fn", line, d.pos, f"{d.params} {body}" if body else d.params, None, conditions)
        for i, t in enumerate(self.tokens):
            if t.kind == "ident" and t.text == "enum":
                _, brace = self._tag(i)
                if brace is not None:
                    yield from self._enumerators(brace)

    def _tag(self, i: int) -> tuple[int | None, int | None]:
        """(name, brace) of struct, union or enum at i; None for what it lacks."""
        own = self.bare(i + 1, min(len(self.tokens), i + 40))[:6]
        name = None
        for k, j in enumerate(own):
            if self.is_(j, "{"):
                return name, j
            if name is None and self.ident(j) and self.tokens[j].text not in QUALIFIERS:
                name = j
            elif name is not None and self.is_(j, ":"):  # enum with an underlying type
                rest = own[k + 1 :]
                return name, next((x for x in rest if self.is_(x, "{")), None)
            else:
                return name, None
        return name, None

    def _enumerators(self, brace: int) -> Iterator[Fact]:
        end, i = self.match[brace], brace + 1
        end = min(end, len(self.tokens))
        while i < end:
            if not self.ident(i):
                i = self.skip(i)
                continue
            name, value, i = i, None, i + 1
            first = None
            while i < end and not self.is_(i, ","):
                if self.is_(i, "=") and first is None:
                    first = i + 1
                i = self.skip(i)
            if first is not None and first < i:
                value = self.src.text[self.tokens[first].start : self.tokens[min(i, len(self.tokens)) - 1].end].strip()
            yield Fact("symbol", self.tokens[name].text, "enum_value", self.line(name), self.tokens[name].start, value, None, self.conditions(name))
            i += 1

    def types(self) -> Iterator[Fact]:
        for i, t in enumerate(self.tokens):
            if t.kind != "ident":
                continue
            if t.text in ("struct", "union", "enum"):
                name, brace = self._tag(i)
                if name is not None and brace is not None and self.match[brace] < len(self.tokens):
                    yield Fact("type", self.tokens[name].text, t.text, self.line(name), t.start, self.text(i, self.match[brace]), None, self.conditions(i))
            elif t.text == "typedef":
                yield from self._typedefs(i)

    def _end(self, i: int) -> int:
        """The semicolon that ends the statement at i, or the number of tokens."""
        while i < len(self.tokens) and not self.is_(i, ";"):
            if self.is_(i, "}"):
                return len(self.tokens)
            i = self.skip(i)
        return min(i, len(self.tokens))

    def _typedefs(self, i: int) -> Iterator[Fact]:
        end = self._end(i)
        if end >= len(self.tokens):
            return
        for k, part in enumerate(self._split(self.bare(i + 1, end))):
            # a bare name: nothing but specifiers before it in the first part, nothing at all in others
            last = part[-1] if part else None
            if last is None or not self.plain(last) or self.tokens[last].text in PRIMITIVE:
                continue
            if len(part) < 2 if k == 0 else len(part) != 1:
                continue
            before = part[:-1]
            if any(self.is_(j, "*") or self.is_(j, "(") or self.is_(j, "[") for j in before):
                continue
            if len(before) == 1 and self.tokens[before[0]].text in ("struct", "union", "enum"):
                continue
            yield Fact("type", self.tokens[last].text, "typedef", self.line(last), self.tokens[last].start, self.text(i, end), None, self.conditions(i))

    def _split(self, indices: list[int]) -> list[list[int]]:
        parts: list[list[int]] = [[]]
        for j in indices:
            if self.is_(j, ","):
                parts.append([])
            else:
                parts[-1].append(j)
        return parts

    # --- file scope ----------------------------------------------------------------

    def declarations(self) -> Iterator[Fact]:
        i, n = 0, len(self.tokens)
        while i < n:
            start = i
            while i < n:
                if self.is_(i, ";"):
                    if self._old_style(start, i):
                        i += 1
                        continue
                    if "global" in self.kinds:
                        yield from self._global(start, i)
                    i += 1
                    break
                if self.is_(i, "}"):  # the end of a linkage block, or a stray one
                    i += 1
                    break
                if self.is_(i, "{"):
                    head = self.bare(start, i)
                    if len(head) == 2 and self.tokens[head[0]].text == "extern" and self.tokens[head[1]].kind == "string":
                        i += 1  # its declarations are at file scope
                        break
                    name = self._function_name(head)
                    end = self.match[i]
                    if name is not None and not any(self.is_(j, "=") for j in head):
                        end = min(end, n - 1)
                        if "function" in self.kinds or "call" in self.kinds:
                            yield from self._function(start, name, end)
                        i = end + 1
                        break
                    tagged = any(self.ident(j) and self.tokens[j].text in ("struct", "union", "enum") for j in head[-4:]) or any(self.is_(j, "=") for j in head)
                    i = min(end, n - 1) + 1
                    if not tagged:
                        break
                    continue
                i = self.skip(i)

    def _function_name(self, head: list[int]) -> int | None:
        """The name that a parameter list follows, if a type stands before it and at most one star."""
        for k, j in enumerate(head):
            if not self.is_(j, "(") or k < 2 or not self.plain(head[k - 1]):
                continue
            before = head[: k - 1]
            stars = 0
            while before and self.is_(before[-1], "*"):
                stars += 1
                before = before[:-1]
            while before and self.ident(before[-1]) and self.tokens[before[-1]].text in ("const", "volatile", "restrict"):
                before = before[:-1]
            typed = any(self.ident(x) and (self.tokens[x].text not in QUALIFIERS) for x in before)
            if typed:
                return head[k - 1] if stars <= 1 else None
        return None

    def _old_style(self, start: int, semicolon: int) -> bool:
        """Whether parameter declarations go on here: int f(a) int a; { ... }"""
        head = self.bare(start, semicolon)
        if any(self.is_(j, "=") or self.is_(j, "{") for j in head):
            return False
        name = self._function_name(head)
        if name is None:
            return False
        after = head[head.index(name) + 2 :]
        if len(after) < 2 or not self.ident(after[0]) or self.is_(after[0], ","):
            return False
        i = semicolon + 1
        while i < len(self.tokens) and not self.is_(i, "{") and not self.is_(i, "}") and not self.is_(i, "(") and not self.is_(i, "="):
            i += 1
        return self.is_(i, "{")

    def _comments(self, i: int) -> tuple[str, int] | None:
        """Text and first row of the comments attached to the definition at token i: no blank line between."""
        found, row, k = [], self.src.row(self.tokens[i].start), self.tokens[i].before
        floor = self.tokens[i - 1].before if i else 0
        while k > floor:
            kind, start, end = self.src.trivia[k - 1]
            if kind != "comment" or row > self.src.row(max(start, end - 1)) + 1:
                break
            found.append(self.src.text[start:end].rstrip("\r"))
            row = self.src.row(start)
            k -= 1
        return ("".join(c + "\n" for c in reversed(found)), row) if found else None

    def _function(self, start: int, name: int, end: int) -> Iterator[Fact]:
        attached = self._comments(start)
        body = self.text(start, end)
        line = attached[1] + 1 if attached else self.line(name)
        source = (attached[0] if attached else "") + body
        static = any(self.ident(j) and self.tokens[j].text == "static" for j in self.bare(start, name))
        own = self.tokens[name].text
        yield Fact("function", own, None, line, self.tokens[start].start, source, static, self.conditions(start))
        for callee, pos in self._calls(start, name, end):
            if callee != own:
                yield Fact("call", own, callee, self.src.row(pos) + 1, pos, None, None, ())

    def _calls(self, start: int, name: int, end: int) -> list[tuple[str, int]]:
        found, statement = [], start
        for i in range(start, end + 1):
            t = self.tokens[i]
            if t.kind == "punct" and t.text in ";{}":
                statement = i + 1
            if i == name or t.kind != "ident" or not self.is_(i + 1, "(") or t.text in NO_CALLS:
                continue
            if self.is_(i - 1, ".") or self.is_(i - 1, "->"):
                continue
            if i > start and self.ident(i - 1) and self.tokens[i - 1].text not in STATEMENTS and self.tokens[i - 1].text not in ("sizeof", "__extension__", "asm", "volatile"):
                continue  # a prototype: a type stands before the name
            if self.is_(i - 1, "*") and i > name and self._declares(statement, i):
                continue
            found.append((t.text, t.start))
        low, high = self.tokens[start].start, self.tokens[end].end
        for at, line in self.src.tests:
            if low < at < high:
                inner = lex(re.sub(r"^#\s*\w+", lambda m: " " * len(m.group()), line)).tokens
                found += [(a.text, at + a.start) for a, b in zip(inner, inner[1:], strict=False) if a.kind == "ident" and a.text not in NO_CALLS and b.text == "("]
        return sorted(found, key=lambda x: x[1])

    def _declares(self, statement: int, i: int) -> bool:
        """Whether the tokens from the statement's start to i are a type and stars."""
        own = self.tokens[statement:i]
        return bool(own) and own[0].kind == "ident" and own[0].text not in STATEMENTS and all(t.kind == "ident" or t.text == "*" for t in own)

    def _global(self, start: int, end: int) -> Iterator[Fact]:
        own = self.bare(start, end)
        if not own or self.tokens[own[0]].text == "typedef" or any(self.ident(j) and self.tokens[j].text == "typedef" for j in own):
            return
        parts = self._split(own)
        first = self._declarator(parts[0])
        if first is None:
            return
        declarators = [first, *parts[1:]]
        if any(self._prototype(d) for d in declarators):
            return
        name = next((x for x in map(self._name, declarators) if x is not None), None)
        if name is not None:
            static = any(self.ident(j) and self.tokens[j].text == "static" for j in parts[0])
            yield Fact("global", self.tokens[name].text, None, self.line(start), self.tokens[start].start, self.text(start, end).strip(), static, self.conditions(start))

    def _declarator(self, part: list[int]) -> list[int] | None:
        """The part without its specifiers; None if it has no type or no declarator."""
        stop = next((k for k, j in enumerate(part) if self.tokens[j].kind == "punct" and self.tokens[j].text in "*([=:"), len(part))
        if stop < len(part) and self.is_(part[stop], ":"):
            return None
        k = stop
        if not (stop < len(part) and (self.is_(part[stop], "*") or self.is_(part[stop], "(") and not (stop and self.plain(part[stop - 1]) and stop >= 2))):
            k = stop - 1  # the name is the last identifier
        if k < 1 or k >= len(part):
            return None
        specifiers = part[:k]
        if not any(self.ident(j) and self.tokens[j].text not in QUALIFIERS for j in specifiers) and not any(self.is_(j, "{") for j in specifiers):
            return None
        words = [self.tokens[j].text for j in specifiers if not self.is_(j, "{")]
        tags = [w for w in words if w in ("struct", "union", "enum")]
        if tags and words[-1] in ("struct", "union", "enum") and not any(self.is_(j, "{") for j in specifiers):
            return None  # struct name;
        declarator = part[k:]
        if self.ident(declarator[0]) and not self.plain(declarator[0]):
            return None
        return declarator

    def _prototype(self, d: list[int]) -> bool:
        if any(self.is_(j, "=") for j in d):
            return False
        k = 1 if d and self.is_(d[0], "*") else 0
        while k < len(d) and self.ident(d[k]) and self.tokens[d[k]].text in QUALIFIERS:
            k += 1
        return k + 1 < len(d) and (self.plain(d[k]) or self.is_(d[k], "(")) and self.is_(d[k + 1], "(")

    def _name(self, d: list[int]) -> int | None:
        equals = next((k for k, j in enumerate(d) if self.is_(j, "=")), len(d))
        value = d[equals + 1 :]
        d = [j for j in d[:equals] if not self.is_(j, "*") and not (self.ident(j) and self.tokens[j].text in QUALIFIERS)]
        if d and self.plain(d[0]) and not (len(d) > 1 and self.is_(d[1], "(")):
            return d[0]
        if d and self.is_(d[0], "(") and len(d) > 1 and self.is_(d[1], "["):
            for j in d[1:]:  # the first size that is a name
                if self.is_(j, "[") and self.match[j] == j + 2 and self.plain(j + 1):
                    return j + 1
        return value[0] if len(value) == 1 and self.plain(value[0]) else None


def extract(source: str, kinds: Collection[str] = KINDS) -> list[Fact]:
    """The facts of a file's text that are of the given kinds, each kind in the order of its places."""
    file, found = _File(source, kinds), []
    if not {"function", "call", "global"}.isdisjoint(kinds):
        found += file.declarations()
    if "symbol" in kinds:
        found += file.symbols()
    if "type" in kinds:
        found += file.types()
    return sorted((f for f in found if f.fact in kinds), key=lambda f: (f.fact, f.pos))
