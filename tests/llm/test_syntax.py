import ast
import sys
from pathlib import Path

import pytest

from millrace.llm.syntax import problems
from millrace.llm.unparsed import check_files, rates

JS = """a?.b?.[c]?.(d)|const {a=1,...b}=c;let [x,,y=2,...z]=w|label: for(;;){continue label}|async function* f(){for await(const x of y){yield* x}}
class A extends (b,c){#p=1;static{this.q=2}get x(){return this.#p}static async *g(){} "s"(){} [k]=3}|if(a)b\\nelse c|x=a\\n++b|`a${`b${c}`}d`|/[/]/g.test(x)?1:2
(a,b)=>({c})|async x=>await x|import a,{b as c} from "d";export * as e from "f";export default class{}|a??=b;c**=2;1_000n|({a,get b(){return 1},async *c(){},[d]:e,"f":g})
for(var i in o);for(let of of of);|switch(a){case 1:default:b()}|try{}catch{}finally{}|x = <div a="b" {...c}>{d}<></>text</div>|if (x) { } /re/.test(y)|a = b ? (c) : (d)|[a,b]=[b,a];({a}=b)|x = {if: 1, class: 2}.if""".replace("\n", "|").split("|")
TS = """interface A<T extends B=C> extends D,E{readonly [k:string]:any;m?<U>(a:U,...b:V[]):void;new(x:number):A;(y):z}~type X<T>=T extends (infer U)[]?U:never|keyof T&{a?:string}~enum E{A=1,B="x"}const enum F{}
declare module "x"{export function f(a:number):string}~abstract class A<T> implements B{private readonly x:number=1;constructor(private a:string,public b?:number){super()}abstract m():void;static s?:T;declare d:string}
function f<T>(this:Window,a?:number,...b:string[]):a is string{return true}~const x=y as unknown as Z<W>;let a=<any>b;c!.d;e satisfies F~f<string>(x);new Map<string,Array<number>>();~let a:(x:number)=>void;let b:[a:string,b?:number,...c:any[]];let c:typeof import("x")
type M={readonly [K in keyof T]-?:T[K]};type L=`a${string}`~import type {A} from "b";import {type C} from "d";export type {E};import x=require("y")~namespace A.B{export const c=1}~@dec() class A{@prop({a:1}) b!:string;@m() c(@p() d:string){}}
const f=async<T,>(x:T):Promise<T>=>x~let v=a<b;if(a<b&&c>d){}~const x = (a: number, b = 2): number => a + b~const a = b ? (c): d => e : f~type X = | "a" | "b\"""".replace("\n", "~").split("~")
GO = ["import (\"fmt\";. \"x\";_ \"y\")\nfunc main(){if x:=f();x>0{}else if y{}}", "type S[T any,U ~int|string] struct{A,B int `json:\"x\"`;*C;d.E}\nfunc (s *S[T,U]) M(a,b int,c ...string)(x int,err error){return}", "var x=map[string][]int{\"a\":{1,2},\"b\":nil,}\nconst (A=iota;B;C)", "func f(){for i:=0;i<10;i++{};for range x{};for k,v:=range y{_=k};for{};for a<b{}}", "func f(){switch x:=y.(type){case int,*T:default:};switch{case a>b:fallthrough;case c:}}", "func f(){select{case x:=<-c:case c<-1:default:};go func(){}();defer m.Unlock()}", "func f(){x:=[]T{{1},{2}};y:=&T{A:1};z:=[...]int{1:2};if v,ok:=m[T{1}];ok{}}", "func Map[T,U any](x []T,f func(T)U)[]U{return Map[int,string](nil,nil)}", "func f(){L:for{break L};goto L;x<<=2;a[1:2:3]=b;*p=1;<-c;a,b=b,a}", "func f() {\n\tx := foo.\n\t\tbar().\n\t\tbaz()\n\tfor _, s := range []string{\"a\"} {\n\t}\n}"]
BAD = {
    "x.js": ["a b", "function(){}", "const x", "if(", "{", "a=}", "foo(1,)2", "x=`abc", '"abc', "/* x", "class{}", "a => {", "var x:number", "<<<<<<< HEAD", "1=2", "a+", "for(;;", "({a b})", "x = {a:1,,}", "def f(): pass", "package main", "x ? y", "} x", "new", "let x = ;"],
    "x.ts": ["let x: = 1", "interface {", "type X", "function f(a: {b) {}", "enum {A}", "let x = y as", "class A { private x: }", "=======\n"],
    "x.go": ["x := 1", "package a\nfunc f( {", "package a\nfunc f(){ a b }", "package a\nx=1", "package a\nfunc f(){", "package a\nfunc f(){ if {} }", "package a\nimport x", "package a\nfunc f(){ 1=2 }", "package a\nclass A{}", "package a\nvar x = [1,2]", "package a\nfunc f()\n{\n}", "package a\nfunc f(){ for i in x {} }"],
    "x.py": ["def f(:\n pass", "if x\n  y", "x = = 1", "a b", "  x = 1", "def f():\nx", "print 'x'", "'abc", "f(a for)", "x = (1", "1 = x", "f'{'", "f'{a b}'", "def f(a=1, b): pass", "try:\n  pass\nx=1", "0777", "for x in y", "class A", "lambda x y: 1", "{1:2, 3}", "return = 1"],
}


def test_valid():
    for t in JS:
        assert problems(t.replace("\\n", "\n"), "a.js") == [], t
    for t in TS:
        assert problems(t, "a.ts") == [], t
    for t in GO:
        assert problems("package a\n" + t, "a.go") == [], t


def test_invalid():
    for path, texts in BAD.items():
        for t in texts:
            assert problems(t, path), (path, t)


def test_python_agrees_with_the_interpreter():
    here = Path(ast.__file__).parent
    texts = [p.read_text(errors="replace") for p in [*sorted(here.glob("*.py"))[:40], *Path(__file__).parents[2].joinpath("millrace").rglob("*.py")]]
    for t in texts:
        assert problems(t, "a.py") == []
    t = texts[0]
    for cut in range(50, len(t), max(1, len(t) // 60)):
        part = t[:cut]
        try:
            ast.parse(part)
            bad = False
        except SyntaxError:
            bad = True
        assert bool(problems(part, "a.py")) == bad, cut


def test_recovery_finds_later_errors_and_depth_is_bounded():
    assert [p.line for p in problems("x = = 1\ny = 2\nz = (\n1 2)\n", "a.py")][:2] == [1, 4]
    assert len(problems("a b\nlet x = 1\nfunction f() {}\nc d\n", "a.js")) == 2
    sys.setrecursionlimit(20_000)
    for path in ("a.py", "a.js", "a.ts", "a.go"):
        assert problems("(" * 50_000, path)
        assert problems("", path) == ([] if path else None)
    assert problems("x", "a.txt") is None and problems("x", "Makefile") is None


@pytest.mark.parametrize("n", [1])
def test_files(spark, n):
    df = spark.createDataFrame([("r", "a.PY", "x = 1\r\n", 1), ("r", "b.py", "x =", 2), (None, "c.go", None, 3), ("r", None, "x", 4), ("r", "d.yaml", ":", 5), ("r", "a.PY", "x = 1\r\n", 1)], "repo string, path string, text string, accepted int")
    got = check_files(df)
    assert sorted((r.path, r.accepted, r.language) for r in got.collect()) == [("a.PY", True, "python"), ("a.PY", True, "python"), ("b.py", False, "python"), ("c.go", True, "go")]
    assert {(r.repo, r.language): (r.n_files, r.n_failed) for r in rates(got).collect()} == {("r", "python"): (3, 1), (None, "go"): (1, 0)}
    names = spark.createDataFrame([("r", "b.py", "Py"), ("r", "b.py", "PYTHON "), ("r", "b.py", None)], "repo string, path string, language string")
    assert {(r.repo, r.language): r.n_failed for r in rates(got, names).collect()}["r", "python"] == 1
    assert check_files(df.limit(0)).count() == 0 and rates(check_files(df.limit(0))).count() == 0


def test_nesting_is_limited_as_the_languages_do():
    n = 3000
    for text, path in (("x=" + "a?b:" * n + "c", "a.js"), ("x=" + "(" * n + "1" + ")" * n, "a.js"), ("{" * n + "}" * n, "a.js"), ("let x:" + "[" * n + "A" + "]" * n, "a.ts"), ("x=" + "<a>" * n + "</a>" * n, "a.jsx"), ("package a\nvar x = " + "(" * n + "1" + ")" * n, "a.go"), ("package a\nvar x = T{" + "{" * n + "}" * n + "}", "a.go")):
        assert problems(text, path) == [], text[:20]
    assert problems("x=" + "(" * n, "a.js")
    for k, fine in ((199, True), (200, True), (201, False)):
        assert (problems("x = " + "(" * k + "1" + ")" * k, "a.py") == []) is fine, k
    for k, fine in ((99, True), (100, False)):
        assert (problems("".join(" " * i + "if a:\n" for i in range(k)) + " " * k + "pass\n", "a.py") == []) is fine, k
