"""What the extractor finds in small pieces of C."""

import pyarrow as pa
import pytest

from ferrule.functions import c_facts
from ferrule.functions.c_facts import KINDS, Fact, extract, trim_value
from ferrule.functions.c_tokens import lex
from ferrule.operators import index
from ferrule.plans.adapters import C_FILE


def facts(text, kind):
    return [f for f in extract(text) if f.fact == kind]


def names(text, kind):
    return [f.name for f in facts(text, kind)]


def test_attached_comments_give_line_and_source():
    text = "/* a */\n// b\nstatic int *f(void) { g(); p->h(); (*k)(); f(); return 0; }"
    (f,) = facts(text, "function")
    assert (f.name, f.line, f.flag) == ("f", 1, True)
    assert f.text == text
    assert [(c.kind, c.line) for c in facts(text, "call")] == [("g", 3)]


def test_comment_behind_a_blank_line_is_not_attached():
    (f,) = facts("// far\n\nint f(void) {}", "function")
    assert f.line == 3 and f.text == "int f(void) {}"


def test_trailing_comment_of_the_line_above_is_attached():
    (f,) = facts("int x; // t\nint f(void) {}", "function")
    assert f.line == 1 and f.text.startswith("// t\n")


def test_comment_before_a_directive_is_not_attached():
    (f,) = facts("// a\n#include <x.h>\nint f(void) {}", "function")
    assert f.line == 3


def test_line_is_that_of_the_name():
    assert facts("static int\nf(void) {}", "function")[0].line == 2


@pytest.mark.parametrize("text", ["int **h(void) {}", "int (f)(void) {}", "FOO(x) { }", "int x = { 1 };", "struct s { int f(void); };"])
def test_no_function(text):
    assert names(text, "function") == []


@pytest.mark.parametrize(
    "text",
    [
        "int *f(void) {}", "inline int f(void) {}", "int f(a, b) int a; char b; { }", "struct s f(void) {}", "struct s *f(void) {}", "uint32_t f(void) __attribute__((noinline)) {}",
        '__attribute__((unused)) static int f(void) {}', 'extern "C" { int f(void) {} }', "#if A\nint f(void) {}\n#endif", "unsigned long long f(int (*cb)(int)) {}",
    ],
)
def test_function_forms(text):
    assert names(text, "function") == ["f"]


def test_calls():
    text = 'int f(void) {\n  int proto(int);\n  foo *decl(int);\n  return sizeof(int) + a * g(1) + s.m(2) + FOO("x(y)") + h(i(3)) + defined(X);\n}'
    assert [c.kind for c in facts(text, "call")] == ["g", "FOO", "h", "i"]


def test_calls_in_conditions_and_attributes():
    text = "__attribute__((format(printf, 1, 2))) int f(void) {\n#if BAR(1)\n x();\n#endif\n}"
    assert [(c.kind, c.line) for c in facts(text, "call")] == [("format", 1), ("BAR", 2), ("x", 3)]


def test_every_call_site_counts_and_self_calls_do_not():
    assert [c.kind for c in facts("int f(void) { g(); g(); f(); }", "call")] == ["g", "g"]


def test_macros():
    text = "#define E\n#define K 7\n#define M(a,b) ((a)+(b)) /* c */\n#define P()\n#define L 1 // x\n#define W a \\\n  b\nint f(void) {\n#define IN 2\n}"
    found = {f.name: (f.kind, f.text) for f in facts(text, "symbol")}
    assert found["E"] == ("define", None) and found["K"] == ("define", "7") and found["L"] == ("define", "1 // x") and found["IN"] == ("define", "2")
    assert found["M"] == ("macro_fn", "(a,b) ((a)+(b))") and found["P"] == ("macro_fn", "()")
    assert found["W"][1].startswith("a") and found["W"][1].endswith("b")


def test_long_values_are_cut_at_a_character():
    assert trim_value("x" * 200) == "x" * 200
    assert trim_value("x" * 201) == "x" * 200 + "…"
    assert trim_value("x" * 199 + "é" * 5) == "x" * 199 + "…"


def test_enumerators():
    found = [(f.name, f.text) for f in facts("enum { A, B = 2, C = (1 << 3), };\nvoid f(void) { enum e { D }; }", "symbol")]
    assert found == [("A", None), ("B", "2"), ("C", "(1 << 3)"), ("D", None)]
    assert names("enum { A, B };", "type") == []


def test_types():
    text = "typedef struct S { int x; } S;\nunion U { int i; };\nenum E { X };\nstruct fwd;\nstruct { int a; } v;\ntypedef unsigned W, V;"
    assert sorted((f.name, f.kind) for f in facts(text, "type")) == [("E", "enum"), ("S", "struct"), ("S", "typedef"), ("U", "union"), ("V", "typedef"), ("W", "typedef")]
    assert facts(text, "type")[0].text == "struct S { int x; }"


@pytest.mark.parametrize("text", ["typedef int *ip;", "typedef int (*cb)(int);", "typedef int a[3];", "typedef unsigned int uint32_t;", "struct fwd;"])
def test_no_types(text):
    assert facts(text, "type") == []


@pytest.mark.parametrize(
    "text, name",
    [
        ("int a, b;", "a"), ("extern int e;", "e"), ('char *s = "x";', "s"), ("int arr[3] = {1, 2};", "arr"), ("int (*fq)(void) = foo;", "foo"), ("int (*p)[N];", "N"),
        ("static const struct q z = { .a = 1 };", "z"), ("struct s { int x; } v;", "v"), ("foo_t x;", "x"), ("struct s *p;", "p"), ("int m = f(1);", "m"),
    ],
)
def test_globals(text, name):
    assert names(text, "global") == [name]
    assert facts(text, "global")[0].text == text


@pytest.mark.parametrize("text", ["int f(int);", "int *f(int);", "int (*fp)(void);", "struct s { int x; };", "void f(void) { int x; }", "typedef int t;", "MACRO(x);", ";", "int;"])
def test_no_globals(text):
    assert facts(text, "global") == []


def test_conditions_nest():
    text = "#ifndef H\n#if A\nint q;\n#elif B\nint r;\n#else\nint s;\n#endif\nint t;\n#endif\nint u;"
    assert [(f.name, f.conditions) for f in facts(text, "global")] == [
        ("q", ("#ifndef H", "#if A")), ("r", ("#ifndef H", "#if A", "#elif B")), ("s", ("#ifndef H", "#if A", "#elif B", "#else")), ("t", ("#ifndef H",)), ("u", ()),
    ]


@pytest.mark.parametrize("text", ["", "}}}}", "int f(void) {", '"', "/* open", "#define", "#if\n#else", "struct {", "enum E {", "(((", "\x00\xff", "typedef struct S {", "int f(int a", "'"])
def test_broken_text_never_fails(text):
    extract(text)


@pytest.mark.parametrize("kinds", [["global"], ["function", "symbol"], ["call"], ["type"], []])
def test_only_wanted_kinds_are_made(monkeypatch, kinds):
    text = C_FILE.replace("@", "7") + " x\nint x [[a]] = 1, *y;\n[[b]] int __attribute__((c)) z[2][3];"
    every = extract(text)
    assert {f.fact for f in every} == set(KINDS) and [f.name for f in every if f.fact == "global"] == ["count_7", "shared_7", "x", "z"]
    made = []
    monkeypatch.setattr(c_facts, "Fact", lambda *f: made.append(f[0]) or Fact(*f))
    assert extract(text, kinds) == [f for f in every if f.fact in kinds]
    assert set(made) <= set(kinds) | ({"function"} if "call" in kinds else set()) | ({"call"} if "function" in kinds else set())


def test_spaces_are_no_tokens_and_directives_stand_first_in_a_line():
    found = lex(" \\\n\t/* c */ # define A 1\n a # b \\\r\n  #\v")
    assert [(t.kind, t.text, t.before) for t in found.tokens] == [("ident", "a", 2), ("punct", "#", 2), ("ident", "b", 2), ("punct", "#", 2)]
    assert [d.name for d in found.defines] == ["A"] and [k for k, _, _ in found.trivia] == ["comment", "directive"]
    assert lex("a \t \\\n").tokens == lex("a").tokens


def test_facts_of_many_files_go_out_together(monkeypatch):
    """Small files share a batch, a limit of facts or characters ends one; all facts are there, in the files' order."""
    texts = [f"int a{k}, b;\nint f{k}(void) {{ g(); }}\n#define M{k}" for k in range(200)] + ["", "int last;"]
    batch = lambda own: pa.RecordBatch.from_pydict({"path": [str(k) for k, _ in own], "content": [t for _, t in own], "content_hash": [None] * len(own)})
    numbered = list(enumerate(texts))
    want = [(str(k), *f) for k, t in numbered for f in extract(t)]

    def run():
        out = list(index.fact_batches(map(batch, (numbered[:50], numbered[50:], []))))
        got = [(r["file"], r["fact"], r["name"], r["kind"], r["line"], r["pos"], r["text"], r["flag"], tuple(r["conditions"])) for b in out for r in b.to_pylist()]
        assert got == want
        return [b.num_rows for b in out]

    assert run() == [len(want)]
    monkeypatch.setattr(index, "BATCH_FACTS", 100)
    assert run() == [100] * 8 + [1]
    monkeypatch.setattr(index, "BATCH_FACTS", 4096)
    monkeypatch.setattr(index, "BATCH_CHARS", 1)
    assert len(run()) == 201
    assert list(index.fact_batches([])) == []
