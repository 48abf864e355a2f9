"""Problem 6: accepted and rejected texts per language, recovery, and the operator's cases."""

import pytest

from tesserine.llm.syntax import check, invalid_files, language_of, syntax_check, syntax_rates

GOOD = {
    "python": ["", "x = 1\n", "def f(a, /, b=1, *c, d, **e) -> int:\n    '''d'''\n    return [y for y in a if y]\n", "match x:\n    case [1, *_] | {'a': b} if b:\n        pass\n", "with (open(a) as f, b):\n  pass\n", "async def f():\n  async for x in y: await z\n", "@d(1)\nclass K(B, m=1):\n  x: int = 3; y = lambda a, *b: a\n", "if (n := 3) > 2: print(f'{n}')\nelif not a in b: pass\nelse:\n\tpass\n", "try:\n  x\nexcept* E as e:\n  raise A from b\nfinally:\n  pass\n", "a, *b = c = d\nx[1:2, ::3] += 1\nprint(*a, **b)\nglobal_ = yield_ = 1\n", "t = (\n  1,\n)\ns = 'a' \\\n  'b'\n"],
    "javascript": ["", "const {a, b: [c], ...d} = e; let f = async (x = 1, {y}) => { await x; };", "class A extends B { static #p = 1; get x() { return this.#p } async *g() {} static { q(); } }", "for (const x of y) if (a) b; else c\nlabel: while (1) { continue label }", "const r = a / b / c; const q = /[/]\\/x/g.test(s) ? `t${`n${1}`}` : x?.y ?? z", "export default function () {}\nexport * as n from 'm'\nimport a, {b as c} from 'd'\n", "var s = `<<<<<<< HEAD\n=======\n`", "const j = <div className=\"a\" {...p}>it's {x > 1 && <b/>}</div>;", "do x++; while (x < 3)\nswitch (a) { case 1: default: b }", "a = b\n(c)\nreturn_ = {async, get x() { return 1 }, [k]: v, 'q': 1, m() {}}"],
    "typescript": ["interface A<T = {}> extends B { readonly x?: T; m(): void; [k: string]: unknown }", "type F<T> = T extends (infer U)[] ? U : never; let x = <any>y as unknown as string[];", "export abstract class A<T> implements I { private constructor(readonly a: string, b?: number) { super(); } abstract m<K extends keyof T>(k: K): T[K]; }", "function f(this: A, x: Map<string, Array<number>> = new Map<string, Array<number>>()): x is B {}", "enum E { A = 1, B }\ndeclare module 'm' { export const x: number }\nnamespace N { }", "const f = async <T,>(x: T): Promise<T> => x!; let t: [a: number, b?: string]", "export type { A } from './a'; import type B from 'b'"],
    "go": ["package a\n", "package a\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\ntype T[K comparable] struct {\n\tBase\n\ta, b int `tag`\n}\nfunc (t *T[K]) M(x ...int) (r int, err error) { for i, v := range x { _ = v; r += i }; return }\n", "package a\nvar f = func(a int) map[string][]int { return map[string][]int{\"a\": {1, 2}} }\nfunc g() { if x := f(1); x != nil { go g() } else if y { defer g() }\n select { case c <- 1: case v := <-d: _ = v\n default: }\n switch t := z.(type) { case int, *T: _ = t } }\n", "package a\nconst (\n\tA = iota\n\tB\n)\ntype I interface { M(int) string; ~int | string }\n"],
    "java": ["", "package a.b; import static c.D.*; @A(x = {1, 2}) public final class K<T extends B & C> extends D<? super T> implements E, F { int[] a = {1, 2}, b; static { } K() { this(1); } <R> R m(final T... t) throws X { return null; } }", "sealed interface S permits A, B {} record R(int x) implements S { R { } } enum E { A(1) { void m() {} }, B; int v; E(int... v) {} }", "class A { void m() { var x = (List<String>) y; for (int i = 0, j = 1; i < 3; i++) {} for (String s : t) {} int k = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; Runnable r = () -> {}; f(A::new, (a, b) -> a > b ? 1 : 2); if (o instanceof B b && b.c()) {} try (var q = r()) { } catch (X | Y e) { } String s = \"\"\"\n a \"b\"\n \"\"\"; new int[3][]; a[1] >>>= 2; synchronized (this) {} do { } while (a < b); assert a : \"b\"; } }"],
    "rust": ["", "#![allow(x)]\n//! d\nuse a::{b, c::*, d as e};\npub(crate) struct S<'a, T: Clone + 'a, const N: usize>(pub T) where T: Fn(i32) -> i32;\n", "impl<T> A<T> for B where T: C { const X: i32 = 1; type O = T; fn f(&mut self, (a, b): (i32, &str), mut c: Vec<Vec<u8>>) -> Option<Box<dyn Fn() + Send>> { let Some(x) = a else { return None; }; match x { 0..=3 | 5 if b => {} A::B { c, .. } => 1, [a, .., z] => {} _ => {} } for i in 0.. { if i > 3 { break } } let s = S { a, b: 1, ..d }; v.iter().map(|x: &i32| -> i32 { *x }).collect::<Vec<_>>()?; unsafe { *p = !1 as u8 } } }", "macro_rules! m { ($x:expr) => { $x + 1 }; }\nfn f() { println!(\"{}\", 1); let r = r#\"a\"b\"#; 'l: loop { break 'l; } let c = 'x'; let b = b'\\n'; if let Some(x) = y && z {} x.await; a = b..=c; &mut *d; }\n"],
    "ruby": ["", "require 'a'\nmodule A\n  class B < C::D\n    include E\n    attr_reader :x, :y\n    def m(a, b = 1, *c, d:, e: 2, **f, &g)\n      return unless a\n      x = a ? b : c\n      y.each { |z, (q, r)| puts \"a #{z ? \"n\" : 1}\" } if b\n    rescue E => e\n      retry\n    ensure\n      z\n    end\n    def n = 1\n    private def o; end\n  end\nend\n", "a = [1, 2,\n  3].map do |x|\n  x + 1\nend\nh = { a: 1, 'b' => 2, c: }\ncase x\nwhen 1, 2 then y\nelse z\nend\nwhile i < 3 do i += 1 end\nputs a.b&.c(1) || d\n", "s = <<~EOS\n  text #{a}\n  end\nEOS\nb = %w[a b]\nc = /x#{y}/i =~ z\nraise ArgumentError, 'x' if a > 1\n5.times do |i|\n  next if i.zero?\nend\nf = ->(x) { x * 2 }\nx ||= y rescue nil\n"],
}
BAD = {
    "python": ["def f(:\n  pass\n", "if x:\npass\n", "x = (1,\n", "  x = 1\n", "f() = 1\n", "<<<<<<< HEAD\nx = 1\n", "x = 'a\n", "class A\n  pass\n", "for x in\n", "```python\nx\n```\n", "def f():\n    a\n  b\n", "return = 1", "x = 1 +", "else:\n  pass\n"],
    "javascript": ["function f() {", "const x = ;", "let a = (1 + ;", "<<<<<<< HEAD\na\n=======", "const x = `a", "class A { m( }", "import x from", "def f():\n    pass", "a b c", "const s = \"abc\n", "let x: number = 1;", "if (a { }", "1 = 2"],
    "typescript": ["interface A { x: }", "function f(a: ) {}", "type A = ;", "const x: number = ", "class A { private }}"],
    "go": ["", "func f() {}\n"][1:] + ["package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nfunc f() { a = }\n", "package a\nfunc f(a int\n) {}\nvar x = [\n", "package a\nimport fmt\n", "package a\nfunc f() { f(1,\n"],
    "java": ["class A { void m() { }", "class A { int x = ; }", "class A { void m() { int 1x; } }", "foo();", "class A { void m() { f(1, ; } }", "<<<<<<< HEAD\nclass A {}", "class A { void m() { \"abc } }", "<html></html>"],
    "rust": ["fn f() {", "fn f( -> i32 {}", "let x = 1;", "fn f() { let x = ; }", "fn f() { a b }", "package x;", "struct A { x }", "fn f() { \"abc }", "impl A { x }"],
    "ruby": ["def f\n", "class A\n  def b\nend\n", "x = (1 +\n", "if a\n", "end\n", "foo(1,\n", "x = [1, 2\n", "def f(\nend", "<<<<<<< HEAD\na\n", "x = \"abc\n", "1 +\n"],
}


@pytest.mark.parametrize("language", GOOD)
def test_accepted(language):
    for text in GOOD[language]:
        assert check(text, language, "x.tsx" if language == "javascript" else "") == [], text


@pytest.mark.parametrize("language", BAD)
def test_rejected(language):
    for text in BAD[language]:
        assert check(text, language), text


def test_python_agrees_with_the_interpreter():
    import ast

    for text in GOOD["python"]:
        ast.parse(text)
    for text in BAD["python"]:
        with pytest.raises(SyntaxError):
            ast.parse(text)


def test_all_errors_are_kept():
    errors = check("x = )\ny = 1\nz = (]\n", "python")
    assert len(errors) >= 2


def test_language():
    assert language_of("a/B.PY", "go") == "python" and language_of("x", " Go ") == "go" and language_of("x.zig", None) is None and language_of(None, None) is None


def test_deep_nesting_is_decided():
    assert check("x = " + "(" * 4000 + ")" * 4000, "python") == []
    assert check("x = " + "(" * 4000 + ")" * 3999, "python")


ELSE_IF = {
    "go": ("package a\nfunc f() { if a { b() }", " else if a { b() }", " }\n"),
    "java": ("class A { void m() { if (a) { b(); }", " else if (a) { b(); }", " } }"),
    "javascript": ("if (a) { b() }", " else if (a) { b() }", "\n"),
    "rust": ("fn f() { if a { b() }", " else if a { b() }", " }\n"),
}


@pytest.mark.parametrize("language", ELSE_IF)
def test_long_chains_are_decided(language):
    begin, branch, end = ELSE_IF[language]
    assert check(begin + branch * 3000 + end, language) == []
    assert check(begin + branch * 3000 + " else else" + end, language)


DEEP = {
    "go": ("package a\nvar x = ", "(", "1", ")", "\n"), "java": ("class A { int x = ", "(", "1", ")", "; }"), "javascript": ("x = ", "[", "1", "]", ";\n"), "typescript": ("", "{", "a", "}", ""),
    "rust": ("fn f() ", "{", "1", "}", "\n"), "ruby": ("x = ", "[", "1", "]", "\n"), "python": ("x = ", "(", "1", ")", "\n"),
}


@pytest.mark.parametrize("language", DEEP)
def test_deep_files_are_decided(language):
    begin, left, inner, right, end = DEEP[language]
    n = 600
    assert check(begin + left * n + inner + right * n + end, language) == []
    assert check(begin + left * n + inner + right * (n - 1) + end, language)


def test_errors_before_the_limit_count():
    assert check("<<<<<<< HEAD\nx = " + "(" * 4000 + ")" * 4000, "python")


def test_errors_in_indented_brackets_do_not_add_depth():
    text = "def f():\n" + "    x = (1 {{ 2 }})\n" * 400
    assert len(check(text, "python")) >= 400


def test_operator(spark):
    rows = [(1, "r", "a.py", "python", "x = ("), (1, "r", "a.py", "python", "x = ("), (2, "r", "b.py", None, None), (3, None, "c.zig", None, "("), (4, "r", "d", "go", "package a"), (5, "q", None, "ruby", "end"), (6, "r", "e.py", None, "x = 1\r\ny = 2\r\n" * 20000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "file_id bigint, repo string, path string, language string, content string, valid string")
    got = {r.file_id: (r.language, r.valid) for r in syntax_check(df).collect()}
    assert got == {1: ("python", False), 2: ("python", True), 3: (None, None), 4: ("go", True), 5: ("ruby", False), 6: ("python", True)}
    assert sorted(r.file_id for r in invalid_files(df).collect()) == [1, 5]
    rates = {(r.repo, r.language): (r.files, r.invalid_files) for r in syntax_rates(df).collect()}
    assert rates[("r", "python")] == (3, 1)
    assert invalid_files(df.limit(0)).count() == 0
