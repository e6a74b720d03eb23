"""Symbols and calls of hand-made sources, against what a reader finds in them."""

from __future__ import annotations

from palimpsest.operators import syntax as S

TS = '''\
/* class Ghost { no() {} } */
import { x } from "y"; // function ghost() {}
export default class Outer<T> extends Base implements I {
  private text = `a ${call(`inner ${deep(1)} function no() {}`)} b`;
  handler = () => { fire(); };
  constructor(private a: string, b = make("class Z {")) {
    super(b);
    this.run(a);
  }
  async run(a: string): Promise<void> {
    const local = () => nested(a);
    function hidden() { return buried(); }
    if (a) { return new Outer<T>(a).run?.(`x`); }
    for (const r of /[/{]+/g.exec(a)) { log(r); }
  }
  get size() { return count(this); }
  abstract later(): void;
}
interface Shape { area(): number }
export const pick = async (x: number): Promise<number> => {
  return pick2(x);
};
const short = x => twice(x)
const value = compute(1);
export function* walk(tree) {
  const s = "not a \\" string { call()";
  yield visit(tree);
}
var old = function () { legacy(); };
enum Color { Red }
parse<Foo>(text);
'''


def _symbols(path, text):
    return [(n, k, a, b) for n, k, a, b in S.parsed(path, text).symbols]


def _calls(path, text):
    return [(n, m, e) for n, m, _, e in S.parsed(path, text).calls]


def test_typescript():
    assert _symbols("a.ts", TS) == [
        ("Outer", "class", 3, 18), ("Outer.constructor", "method", 6, 9), ("Outer.run", "method", 10, 15), ("Outer.size", "method", 16, 16),
        ("Shape", "class", 19, 19), ("pick", "function", 20, 22), ("short", "function", 23, 23), ("walk", "function", 25, 28), ("old", "function", 29, 29), ("Color", "class", 30, 30),
    ]
    run = "Outer.run"
    assert _calls("a.ts", TS) == [
        ("call", False, None), ("deep", False, None), ("fire", False, None), ("make", False, None), ("run", True, "Outer.constructor"), ("nested", False, run), ("buried", False, run),
        ("Outer", False, run), ("exec", True, run), ("log", False, run), ("count", False, "Outer.size"), ("pick2", False, "pick"), ("twice", False, "short"),
        ("compute", False, None), ("visit", False, "walk"), ("legacy", False, "old"), ("parse", False, None),
    ]


PY = '''\
"""def ghost(): call()"""
import os

@decorate(arg("x"))
class Outer(Base, metaclass=Meta):
    """class Ghost:
def no(): pass
    """

    value = build(
1)

    class Inner:
        def deep(self): return helper(self.x).strip()

    @property
    async def go(self, a=default()):
        def nested():
            return buried()
        text = f"""
def ghost(): no()
"""
        return nested() # call()

def main(
    a,
):
    class Local:
        def method(self):
            pass
    if a: return \\
        run(a)

main()
'''


def test_python():
    assert _symbols("a.py", PY) == [
        ("Outer", "class", 5, 23), ("Inner", "class", 13, 14), ("Inner.deep", "method", 14, 14), ("Outer.go", "method", 17, 23), ("main", "function", 25, 32), ("Local.method", "method", 29, 30),
    ]
    assert _calls("a.py", PY) == [
        ("decorate", False, None), ("arg", False, None), ("build", False, None), ("helper", False, "Inner.deep"), ("strip", True, "Inner.deep"), ("default", False, "Outer.go"),
        ("buried", False, "Outer.go"), ("nested", False, "Outer.go"), ("run", False, "main"), ("main", False, None),
    ]


GO = '''\
package main
// func ghost() {}
type T struct { f func(int) string }
const raw = `func ghost() { no() }`
func (t *T) Run(a int) (string, error) {
	go work(a)
	r := '{'
	return fmt.Sprint(t.name(a)), nil
}
func main() {
	f := func() { inner() }
	f()
}
'''
RUST = '''\
/// fn ghost() {}
pub struct Point<'a> { x: &'a str }
struct Unit;
impl<'a> Point<'a> {
    pub fn new(x: &'a str) -> Self { make(x) }
}
fn main() {
    let s = r#"fn ghost() { "no()" }"#;
    let c = '{'; let t = "multi
line }";
    println!("{}", s);
    helper(s.len());
}
trait Shape { fn area(&self) -> f64; }
'''
JAVA = '''\
package a;
/* class Ghost {} */
public class Outer<T> extends Base {
  private int n = make(1);
  String text = """
    void ghost() { }
    """;
  @Override(x = 1)
  public Outer(int n) { this.n = n; }
  public <R> List<R> run(Map<String, R> m) throws Exception {
    Runnable r = new Runnable() { public void run() { } };
    char c = '"';
    return call(m);
  }
  abstract void later();
  enum Color { RED, GREEN }
}
interface Shape { double area(int x); }
'''
SH = '''\
#!/bin/bash
# ghost() { }
one() {
  echo "${x:-{}" 'two() {' # three() {
  cat <<EOF
ghost() {
EOF
  inner() { :; }
}
function four { echo "a
b() {"; }
'''


def test_go():
    assert _symbols("a.go", GO) == [("Run", "method", 5, 9), ("main", "function", 10, 13)]
    assert _calls("a.go", GO) == [("work", False, "Run"), ("inner", False, "main"), ("f", False, "main")]


def test_rust():
    assert _symbols("a.rs", RUST) == [("Point", "class", 2, 2), ("Unit", "class", 3, 3), ("new", "function", 5, 5), ("main", "function", 7, 13)]
    assert _calls("a.rs", RUST) == [("make", False, "new"), ("helper", False, "main")]


def test_java():
    assert [s[:3] for s in _symbols("A.java", JAVA)] == [
        ("Outer", "class", 3), ("Outer.Outer", "method", 9), ("Outer.run", "method", 10), ("Outer.later", "method", 15), ("Color", "class", 16), ("Shape", "class", 18), ("Shape.area", "method", 18),
    ]
    assert _calls("A.java", JAVA) == []


def test_shell():
    assert _symbols("a.sh", SH) == [("one", "function", 3, 9), ("four", "function", 10, 11)]


def test_broken_files_fail_open():
    for text in ("class A { run( { `${", '"""', "def f(:\n  g(", "}}}} function a() { b( }", "'" * 99, "/* class", "\x00﻿", "fn" * 9999):
        for path in ("a.ts", "a.py", "a.go", "a.rs", "a.java", "a.cs", "a.sh", "a.unknown", "none"):
            S.parsed(path, text)
    assert S.parsed("a.ts", "}}}} function a() { b(1); }").symbols == [["a", "function", 1, 1]]
    assert S.parsed("a.ts", None).symbols == []


def test_limits_of_a_file(spark):
    text = "".join(f"function f{i}() {{ g{i}(); }}\n" for i in range(3000))
    files = spark.createDataFrame([("a.ts", text), ("b.ts", None)], "id string, text string")
    assert S.definitions(files).count() == 80 and S.call_sites(files).count() == 2000
    calls = {r.name: r.enclosing for r in S.call_sites(files).collect()}
    assert calls["g79"] == "f79" and calls["g80"] is None
