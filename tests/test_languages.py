"""A corpus of small files in five languages: every symbol with its line and parent, and every call, as written beside each file.

Symbols are ``type name@line^parent``, calls ``caller>callee callee``; a file name may stand before the source.
"""

import random

import pytest

from loomgraph.sources.files import extract_source
from loomgraph.sources.tokens import Tokens

TYPESCRIPT = [
    ("const a = `x ${f(`y ${g(1)}`)} { function no() {} }`;\nfunction t() { return `a${u(`b${v()}`)}c`; }", "function t@2", "t>u v"),
    ("function d() { const r = /[/{\"']+\\//g.test(s()); return a / b / c(); }\nfunction e() {}", "function d@1; function e@2", "d>test s c"),
    ("function d() { if (x) /function q() {}/.exec(y); }", "function d@1", "d>exec"),
    ("m.tsx|export function V() {\n  return <div title='it' onClick={() => go(1)}>Don't {list.map(i => <Row key={i}>{fmt(i)}</Row>)} function no() {}</div>;\n}\nfunction after() {}", "function V@1; function after@4", "V>go list.map fmt"),
    ("m.tsx|const P = () => <><A.B x={{a: 1}} {...rest(1)} /><br/>{/* c */}</>;\nconst id = <T,>(x: T) => x;\nfunction k(): JSX.Element { return a < b ? <X/> : <Y<string> z='>'/>; }", "function k@3", ""),
    ("m.jsx|function J() { return ok && <p>{`${t('x')}`} a b's</p>; }\nclass K {}", "function J@1; class K@2", "J>t"),
    ("const c = <Foo>bar(1);\nfunction f() { return <any>g(2); }", "function f@2", "f>g"),
    ("class A<T extends { a: string }> extends B<T>(mix({})) implements C, D<E<F>> {\n  private x = { y() { return 1; } };\n  m<U>(a: U): { k: number } { return h<U>(a); }\n  n(): void;\n  n(a?: any): void { this.m(a); super.n(); }\n}", "class A@1; function m@3^A; function n@5^A", "m>h; n>this.m super.n"),
    ("abstract class A {\n  abstract q(): void;\n  static async *gen() { yield* z(); }\n  get v() { return this._v(); }\n  set v(x) {}\n  #p() { return p(); }\n  [Symbol.iterator]() { return it(); }\n  'quoted'() {}\n  static { init(); }\n  constructor(private a: string) { super(a); new W(b()); }\n}",
     "class A@1; function gen@3^A; function v@4^A; function v@5^A; function #p@6^A; function [Symbol.iterator]@7^A; function 'quoted'@8^A; function constructor@10^A", "gen>z; v>this._v; #p>p; [Symbol.iterator]>it; constructor>b"),
    ("@Component({ selector: 'x', f() {} })\nexport class X {\n  @Input() a: string;\n  @Out(make()) b = new E<string>();\n  @Host('c', ['$e'])\n  onC(e) { emit(e); }\n  f = () => { run(); }\n  g() {}\n}", "class X@2; function onC@6^X; function g@8^X", "onC>emit"),
    ("@D\nclass Y {}\n@A.b(1) @C\nabstract class Z {}", "class Y@1; class Z@3", ""),
    ("/** Doc */\nexport async function f() {}\n// line\nclass C {\n  /* m */\n  m() {}\n}", "function f@2; class C@4; function m@6^C", ""),
    ("import a from 'a';\nimport * as b from \"./b\";\nimport { c, d as e, type F } from '../x/c.ts';\nimport './side';\nimport type { G } from 'g';\nimport h, { i } from 'h';\nimport j = require('j');\nconst k = import('./lazy'), u = import.meta.url;",
     "import a.a@1; import p/b.b@2; import x/c.c@3; import x/c.e@3; import x/c.F@3; import p/side@4; import g.G@5; import h.h@6; import h.i@6; import j.j@7", ""),
    ("interface I<T> extends J { f(): void; g: { class: string } }\ntype U<T> = T extends string ? { a: T } : never;\ntype V = `a${string}`;\ndeclare type W = (x: number) => void\nconst type = 1; type.x = interface_;", "interface I@1; type U@2; type V@3; type W@4", ""),
    ("namespace N {\n  export function f() {}\n  export class C { m() {} }\n}\ndeclare module 'm' { export interface Q {} }", "function f@2; class C@3; function m@3^C; interface Q@5", ""),
    ("function outer() {\n  function inner() { deep(); }\n  const e = function named() { x(); };\n  class L { m() { y(); } }\n  return inner();\n}", "function outer@1; function inner@2; class L@4; function m@4^L", "outer>deep x y inner; inner>deep; m>y"),
    ("function over(a: string): void;\nfunction over(a: any) { a?.b?.(); a.b!.c(); x?.y(z); }\ndeclare function no(): void;", "function over@2", "over>a.b c x.y"),
    ("const o = { m() { f(); }, async n() {}, get p() { return 1; }, class: 2, function: 3 };\nexport default function () { g(); }\nexport default function* gen() { yield h(); }", "function gen@3", "gen>h"),
    ("function f(): (a: number) => { b: string } { return q(); }\nfunction g(x): x is Foo<Bar> { return r(x); }\nfunction h(): asserts x is T { s(); }\nfunction i(): typeof import_ | string[] { t(); }", "function f@1; function g@2; function h@3; function i@4", "f>q; g>r; h>s; i>t"),
    ("// function a() {}\n/* class B {} */\nconst s = 'function c() {}', t = \"class D {\";\nfunction real() { const u = '}'; }", "function real@4", ""),
    ("if (a) { function x() {} } else { class Y {} }\nlabel: for (;;) { function z() {} }", "function x@1; class Y@1; function z@2", ""),
    ("#!/usr/bin/env node\nfunction f() { tag`a${g()}`; arr[0](); (h)(); i()(); }", "function f@2", "f>tag g i"),
    ("function f() { return a < b && c > (d); }\nfunction g() { k<A, B<C>>(1); new Map<string, D>(e()); }", "function f@1; function g@2", "g>k e"),
    ("const x = 4 / 2; const y = x++ / 3; const re = [/a/, /b(/];\nfunction f() {}", "function f@2", ""),
    ("class A {\n  x = 1\n  y: string = 'a'\n  z\n  m() {}\n  'k' = 2\n  static s = class { n() {} }\n  async\n  get\n  o() {}\n}", "class A@1; function m@5^A; function o@9^A", ""),
    ("class get {}\nclass A { get() { a(); } static() {} async() {} set(x) {} }", "class get@1; class A@2; function get@2^A; function static@2^A; function async@2^A; function set@2^A", "get>a"),
    ("function broken( {\nclass C {}", "class C@2", ""),
    ("", "", ""), ("}}}} function f() {} {{{", "function f@1", ""), ("const é = 1; function naïve() { 日本(); }", "function naïve@1", "naïve>日本"),
    ("export const f = async <T,>(x: T) => { await g(x); };\nexport { f as default } from './y';\nexport * from 'z';", "", ""),
    ("function f({ a, b = c() }: P = {}, ...r: number[]): Promise<Array<{ x: 1 }>> { return d(); }", "function f@1", "f>d"),
]
GO = [
    ('package m\nimport "fmt"\nimport (\n\t"net/http"\n\tx "a/b/c"\n\t. "d"\n\t_ `e/f/`\n)', "import fmt@2; import http@4; import c@5; import d@6; import f@7", ""),
    ("package m\n// Doc of T\ntype T struct {\n\tf func(a int) struct{ b int }\n}\ntype I interface {\n\tM(x int) error\n}\ntype N map[string][]int\ntype A = T", "class T@3; interface I@6; type N@9; type A@10", ""),
    ("type (\n\tA struct{ x int }\n\tB interface{}\n\tC func(a struct{}) int\n\tD []struct {\n\t\ty int\n\t}\n\tE = A\n)", "class A@2; interface B@3; type C@4; type D@5; type E@8", ""),
    ("type S[T any, U comparable] struct{}\ntype Arr [5]int\ntype Arr2 [N]int\nfunc (s *S[T, U]) M(a T) { s.n(a) }\nfunc (S) V() {}", "class S@1; type Arr@2; type Arr2@3; function M@4^S; function V@5^S", "M>s.n"),
    ("func F[T any](x T, f func(int) bool) (a int, err error) {\n\tgo run(x)\n\tdefer mu.Unlock()\n\treturn g[T](x), nil\n}\nfunc G() interface{ M() } { return h() }\nfunc H() struct{ x int } { return k() }", "function F@1; function G@6; function H@7", "F>run mu.Unlock g; G>h; H>k"),
    ("func asm(x int) int\nfunc real() map[string]func() int {\n\ts := `func no() { x() }`\n\tr := '{'\n\tif v, ok := m[k(1)]; ok { v() }\n\treturn nil\n}", "function asm@1; function real@2", "real>k v"),
    ("var f = func() { a() }\nvar (\n\tg = func() { b() }\n)\nconst c = 1\nfunc init() { for i := range xs() { p(i) } }", "function init@6", "init>xs p"),
    ("func f() {\n\tb := []byte(s)\n\tswitch t := x.(type) {\n\tcase int: q(t)\n\t}\n\tfunc() { z() }()\n\tmake([]int, len(s))\n}", "function f@1", "f>q z make len"),
    ("/* block */\nfunc a() {}\n\n// first\n// second\nfunc b() {}\nvar x int\nfunc c() {}", "function a@2; function b@6; function c@8", ""),
    ("func (p *pkg.T) Odd() {}\nfunc (Plain) P() { a.b.c() }", "function Odd@1^T; function P@2^Plain", "P>a.b.c"),
    ('func f() { s := "// not a comment }" + "\\"{"; g(s) }\nfunc h() {}', "function f@1; function h@2", "f>g"),
    ("func f(\n\ta int,\n\tb string,\n) (\n\tint,\n\terror,\n) {\n\treturn g(a), nil\n}", "function f@1", "f>g"),
    ("type T struct {\n\tsync.Mutex\n\tX int `json:\"x}\"`\n}\nfunc (t T) String() string { return fmt.Sprintf(\"%v\", t.x()) }", "class T@1; function String@5^T", "String>fmt.Sprintf t.x"),
    ("func f() { ch <- g(); <-h(); x := &T{a: k()}; _ = x }", "function f@1", "f>g h k"),
    ("", "", ""), ("package p", "", ""), ("func broken( {\nfunc ok() {}", "function broken@1", ""), ("type X int; type Y string\nfunc main() {}", "type X@1; type Y@1; function main@2", ""),
    ("type G interface {\n\t~int | ~string\n\tf()\n}\nfunc Map[K comparable, V any](m map[K]V) []K { return keys(m) }", "interface G@1; function Map@5", "Map>keys"),
    ("func f() func(int) func() { return func(a int) func() { return g() } }", "function f@1", "f>g"),
]
RUST = [
    ("use std::io;\nuse a::{B, c::{D as E, self}, f::*};\npub(crate) use g::h as _;\nuse ::k;\nuse x::{self as y, Z};", "import io@1; import B@2; import E@2; import f@2; import k@4; import y@5; import Z@5", ""),
    ("/// One\n/// two\n#[derive(Debug, Clone)]\npub struct P<T> where T: X { a: fn(i32) -> T }\nstruct U;\nstruct V(i32, String);\npub enum E { A { x: i32 }, B(i32), C = 1 }", "class P@4; class U@5; class V@6; class E@7", ""),
    ("trait T: A + B {\n    fn req(&self) -> i32;\n    fn def(&self) { self.req(); }\n}\npub unsafe trait W {}\ntype A<T> = Vec<T>;\npub(super) type B = fn() -> i32;", "interface T@1; interface W@5; type A@6; type B@7", ""),
    ("impl<T: Fn() -> i32> S<T> where T: Clone {\n    const K: i32 = 1;\n    type O = i32;\n    pub async unsafe fn m<'a>(&'a self, f: impl Fn(i32) -> i32) -> Result<(), E> { self.go()?; Self::st(f(1)) }\n    fn n() {}\n}", "function m@4^S<T>; function n@5^S<T>; type O@3^S<T>", "m>self.go Self.st f"),
    ("impl fmt::Display for P<'_> { fn fmt(&self) { write!(f, \"{}\", no(1)); yes() } }\nimpl<'a> for<'b> Tr<'b> for &'a Q {\n fn q(&self) {}\n}", "function fmt@1^P<'_>; function q@3^&'a Q", "fmt>yes"),
    ("mod inner {\n    use super::*;\n    pub fn f() {}\n    mod deep { pub struct D; impl D { fn g(&self) {} } }\n}\nmod outside;", "function f@3^inner; class D@4^deep; function g@4^D", ""),
    ("fn main() {\n    fn nested() { a() }\n    struct Local;\n    let s = r#\"fn no() { \"quote\" }\"#;\n    let c = '{'; let l: &'static str = \"}\";\n    nested::<i32>(b'x');\n    foo::bar::<Vec<i32>>(1);\n    vec![in_macro(1)];\n    x.y().z();\n}", "function main@1", "main>a nested foo.bar x.y z"),
    ("macro_rules! m { ($x:expr) => { fn hidden() {} } }\nthread_local! { static A: i32 = f(); }\nconst fn k() -> i32 { 1 }\nconst C: fn() = || { g(); };\nstatic S: [i32; 2] = [1, 2];\nfn z() {}", "function k@3; function z@6", ""),
    ("fn f() {\n    if let Some(x) = g() { h(x) }\n    match k() { Ok(v) => l(v), Err(e) | Other(e) => m(e), _ => {} }\n    while let Node(n) = it.next() {}\n}", "function f@1", "f>g h k l m it.next"),
    ("/* outer /* inner fn no() {} */ still */\nfn f() {}\n//! inner\nfn g() {}\n#![allow(x)]\nextern crate c;\nextern \"C\" { fn ext(); }\npub extern \"C\" fn ex() {}\nasync fn a() { b().await }", "function f@2; function g@4; function ex@8; function a@9", "a>b"),
    ("fn f<const N: usize>(a: [u8; N]) -> impl Iterator<Item = u8> + '_ { a.into_iter().map(|x| g(x)) }\nfn r#type() {}", "function f@1; function r#type@2", "f>a.into_iter map g"),
    ("#[cfg(test)]\nmod tests {\n    use super::X;\n    #[test]\n    fn works() { assert_eq!(f(1), 2); check(1); }\n}", "import X@3; function works@5^tests", "works>check"),
    ("union U { a: i32 }\nstruct G<T = Vec<i32>> { t: T }\nfn w() where for<'a> F: Fn(&'a i32) -> i32 { q() }", "class G@2; function w@3", "w>q"),
    ("impl<T> Drop for W<T> { fn drop(&mut self) { drop_in(&mut self.0) } }\nimpl !Send for W<i32> {}\nunsafe impl Sync for Z {}\nfn last() {}", "function drop@1^W<T>; function last@4", "drop>drop_in"),
    ("", "", ""), ("}} fn f() {}", "function f@1", ""), ("fn a() { let x = 1..2; let y = x.0.1; b(1.0e-3) }", "function a@1", "a>b"), ("fn a() { let c = b\"br { \\\" x\"; let d = '\\u{7b}'; e() }\nfn g() {}", "function a@1; function g@2", "a>e"),
    ("pub fn f(x: i32) -> bool { x < y(1) && z > (w(2)) }", "function f@1", "f>y w"),
]
JAVA = [
    ("package a.b;\nimport java.util.List;\nimport static org.x.Y.z;\nimport java.io.*;\n", "import List@2; import z@3; import io@4", ""),
    ("/** The\n * class. */\n@Entity @Table(name = \"t{\")\npublic final class A<T extends B & C> extends D<T> implements E {\n  private static final Map<String, List<T>> M = new HashMap<>() {{ put(\"a\", f()); }};\n  static { init(); }\n  { inst(); }\n  public A(T t) { super(t); this.go(); }\n  @Override public <R> List<R> m(Function<T, R> f, int... n) throws X, Y { return f.apply(t).stream().map(this::k); }\n  int[] arr()[] { return new int[] { q() }; }\n  abstract void abs();\n  native int nat();\n}",
     "class A@3; function A@8^A; function m@9^A; function arr@10^A; function abs@11^A; function nat@12^A", "A>go; m>apply stream map; arr>q"),
    ("enum Color implements I {\n  RED(1) { @Override int f() { return a(); } }, BLUE;\n  private final int x;\n  Color(int x) { this.x = x; }\n  int g() { return b(x); }\n}\nenum Empty { A, B }", "class Color@1; function Color@4^Color; function g@5^Color; class Empty@7", "g>b"),
    ("interface Shape<T> {\n  double area();\n  default String n() { return name().trim(); }\n  static Shape of() { return new Circle(r()); }\n  class Inner { void deep() {} }\n  interface Sub { void s(); }\n}", "interface Shape@1; function area@2^Shape; function n@3^Shape; function of@4^Shape; class Inner@5^Shape; function deep@5^Inner; interface Sub@6^Shape; function s@6^Sub", "n>name trim; of>r"),
    ("record P(int x, List<String> y) implements Q {\n  P { check(x); }\n  static P of() { return make(); }\n}\n@interface Ann { String value() default \"x\"; int n() default 1; }\nclass Z {}", "class P@1; function of@3^P; class Z@6", "of>make"),
    ("class A {\n  String s = \"class B { void no() {} }\";\n  String t = \"\"\"\n    void no() { \"x\" }\n    \"\"\";\n  char c = '{';\n  // void no() {}\n  void yes() { Runnable r = () -> { run(); }; new Thread(new Runnable() { public void run2() { in(); } }).start(); }\n}", "class A@1; function yes@8^A", "yes>run in start"),
    ("class A { void m() { if (a < b && c > d) f(); for (int i = 0; i < n(); i++) g(); List<String> l = this.<String>h(); int x = (int) k(); assert ok(); synchronized (lock()) { } } }", "class A@1; function m@1^A", "m>f n g h k ok lock"),
    ("class A {\n  /** One. */\n  // but\n  void a() {}\n  /* no */\n  void b() {}\n  /** Yes. */\n  @Deprecated\n  void c() {}\n}", "class A@1; function a@4^A; function b@6^A; function c@8^A", ""),
    ("sealed interface S permits A, B {}\nnon-sealed class B implements S {}\nabstract class C { protected abstract <T> T get(Class<T> c) throws E; }", "interface S@1; class B@2; class C@3; function get@3^C", ""),
    ("class A { Map<String, Map<String, List<int[]>>> f(final @Nullable String... a) { return switch (x) { case 1 -> g(); default -> { yield h(); } }; } }", "class A@1; function f@1^A", "f>g h"),
    ("class A { int x = f(1), y = g(2); Runnable r = () -> { z(); }; void m() {} }", "class A@1; function m@1^A", ""),
    ("class Outer { class Inner { Inner() { a(); } static class Deep { void d() { Outer.this.b(); } } } void o() {} }", "class Outer@1; class Inner@1^Outer; function Inner@1^Inner; class Deep@1^Inner; function d@1^Deep; function o@1^Outer", "Inner>a; d>b"),
    ("", "", ""), ("class A { void m( { }\nclass B {}", "class A@1; function m@1^A", ""), ("class A { void m() { class L { void in() { x(); } } new L().in(); } }", "class A@1; function m@1^A", "m>x in"),
    ("public class G<T extends Comparable<? super T>> { public static <A, B extends A> Map<A, ? extends B> f(A... a) { return G.<A>k(a); } }", "class G@1; function f@1^G", "f>k"),
]
CSHARP = [
    ("using System;\nusing static System.Math;\nusing J = Newtonsoft.Json;\nglobal using A.B.C;\nnamespace N.M;\nclass C { void M() { using (var x = F()) { } using var y = G(); } }", "import System@1; import Math@2; import Json@3; import C@4; class C@6; function M@6^C", "M>F G"),
    ("namespace N {\n  /// <summary>The <c>class</c>.</summary>\n  /// More.\n  [Serializable, Attr(\"}\")]\n  public sealed partial class A<T> : B<T>, IC where T : class, new() {\n    private readonly Dictionary<string, List<T>> d = new() { [\"a\"] = F() };\n    public A(int x) : base(G(x)) { Init(); }\n    ~A() { Bye(); }\n    public static A<T> operator +(A<T> a, A<T> b) => Add(a, b);\n    public T this[int i] { get { return d[i]; } set { } }\n    public int P { get; private set; } = H();\n    public int Q => K();\n    [Fact] public async Task<(int, string)> M<U>(U u, params int[] n) where U : struct { await L(u); return (1, nameof(X)); }\n    (int a, int b) Pair() => (One(), 2);\n    void I.Explicit() { }\n    event Action E;\n    delegate void D(int x);\n    public event EventHandler Ev { add { } remove { } }\n  }\n}",
     "class A@4; function A@7^A; function M@13^A; function Pair@14^A; function Explicit@15^A", "A>Init; M>L; Pair>One"),
    ("struct S { public int X; public readonly int Get() => X; }\nrecord R(int A, string B);\nrecord struct T(int A) { public int Sum() { return Add(A); } }\npublic record class U;\nenum E : byte { A = 1, B }\ninterface I<in T> { void M(T t); int P { get; } static int D() { return Z(); } }", "class S@1; function Get@1^S; class R@2; class T@3; function Sum@3^T; class U@4; class E@5; interface I@6; function M@6^I; function D@6^I", "Sum>Add; D>Z"),
    ("class A {\n  string v = @\"C:\\x \"\"class No { }\"\" \";\n  string i = $\"{F(1)} {{class}} {x:0.0}\";\n  string r = \"\"\"\n    class No { }\n    \"\"\";\n  char c = '\"';\n  void M() { var s = $\"a{G($\"b{H()}\")}\"; var t = $@\"\\{K()}\"; var w = $$\"\"\" { } {{L()}} \"\"\"; }\n}", "class A@1; function M@8^A", "M>G H K L"),
    ("#region X\n#if DEBUG\nclass A { }\n#else\nclass B {\n#pragma warning disable\n  void M() {\n#if Y\n    F();\n#endif\n  }\n}\n#endif\n#endregion\nclass C {}", "class A@3; class B@5; function M@7^B; class C@15", "M>F"),
    ("class A { void M() { int Local(int x) { return F(x); } static void St() => G(); Local(1); var l = new List<int>(H()) { K() }; Foo<int>.Bar(); a?.B(); x!.C(); Generic<string, int>(2); if (a is B b && b.D()) {} } }", "class A@1; function M@1^A", "M>F G Local H K Bar a.B C Generic b.D"),
    ("/// One\n/// <param name=\"x\">two</param>\nclass A {\n  // no\n  void B() {}\n  /// yes\n  [X]\n  void C() {}\n}", "class A@3; function B@5^A; function C@7^A", ""),
    ("class P(int x) : Q(x) { public int Y => x; void M() { } }\nvar top = Run();\nvoid Script() { }\nclass Z { }", "class P@1; function M@1^P; class Z@4", ""),
    ("namespace A { namespace B { class C { class D { D() { E(); } } } } }", "class C@1; class D@1^C; function D@1^D", "D>E"),
    ("class A { public override bool Equals(object o) => o is A a && Check(a); public static implicit operator int(A a) => 1; ref int R() { return ref F(); } unsafe int* Ptr() { return G(); } }", "class A@1; function Equals@1^A; function R@1^A; function Ptr@1^A", "Equals>Check; R>F; Ptr>G"),
    ("class A { int f = F(); Func<int, int> g = x => { return G(x); }; static A() { H(); } int? N() { return x ? Y() : Z(); } int[,] Two() { return null; } }", "class A@1; function A@1^A; function N@1^A; function Two@1^A", "A>H; N>Y Z"),
    ("", "", ""), ("class A { void M( { } class B {}", "class A@1; function M@1^A", ""), ("class @class { void @if() { @new(); } }", "class @class@1; function @if@1^@class", "@if>@new"),
    ("class A { void M() { switch (x) { case 1 when F(): G(); break; default: H(); break; } var y = x switch { 1 => I(), _ => throw new E(J()) }; lock (K()) { } foreach (var z in L()) { } } }", "class A@1; function M@1^A", "M>F G H I J K L"),
]
CASES = [(language, *case) for language, cases in {"typescript": TYPESCRIPT, "go": GO, "rust": RUST, "java": JAVA, "csharp": CSHARP}.items() for case in cases]
SUFFIX = {"typescript": "ts", "go": "go", "rust": "rs", "java": "java", "csharp": "cs"}


def read(language, source, file=None):
    return extract_source(language, file or f"p/m.{SUFFIX[language]}", source.encode())


@pytest.mark.parametrize(("language", "source", "symbols", "calls"), CASES, ids=[f"{x[0]}-{k}" for k, x in enumerate(CASES)])
def test_corpus(language, source, symbols, calls):
    file = None
    if source.startswith("m.") and "|" in source[:8]:
        file, source = source.split("|", 1)
    found, called = read(language, source, file and f"p/{file}")
    got = sorted(f"{s['type']} {s['name']}@{s['line']}" + (f"^{s['parent']}" if s["parent"] else "") for s in found)
    assert got == sorted(x for x in symbols.split("; ") if x)
    by: dict[str, set] = {}
    for c in called:
        by.setdefault(c["caller_name"], set()).add(c["call_text"])
    assert by == {x.split(">")[0]: set(x.split(">")[1].split()) for x in calls.split("; ") if x}


def docs(language, source):
    out = {}
    for s in read(language, source)[0]:
        out.setdefault(s["name"], s["docstring"])
    return out


def test_docstrings():
    assert docs("typescript", TYPESCRIPT[11][0]) == {"f": "* Doc", "C": "line", "m": "m"}
    assert docs("go", GO[8][0]) == {"a": "/* block */", "b": "second", "c": None}
    assert docs("go", GO[1][0])["T"] == "Doc of T"
    assert docs("rust", RUST[1][0]) == {"P": "One two", "U": None, "V": None, "E": None}
    assert docs("rust", RUST[9][0])["g"] is None
    assert docs("java", JAVA[7][0]) == {"A": None, "a": None, "b": None, "c": "Yes."}
    assert docs("java", JAVA[1][0])["A"] == "The class."
    assert docs("csharp", CSHARP[6][0]) == {"A": "One two", "B": None, "C": "yes"}
    assert docs("csharp", CSHARP[1][0])["A"] == "The class. More."


def test_places():
    found = {s["name"]: s for s in read("java", JAVA[1][0])[0]}
    assert (found["A"]["line"], found["m"]["column"], found["m"]["end_line"]) in ((8, 2, 9), (3, 2, 9))
    found = {s["name"]: s for s in read("typescript", "/* é */ function f() {\n\n}\n")[0]}
    assert (found["f"]["line"], found["f"]["column"], found["f"]["end_line"]) == (1, 9, 3)  # columns are bytes


@pytest.mark.parametrize("language", SUFFIX)
def test_joined_files_give_what_they_give_apart(language):
    """Files without imports one after the other: the same symbols, lines moved."""
    whole, want, line = "", [], 0
    for lang, source, *_ in CASES:
        if lang != language or "broken" in source or "}}" in source[:3] or "|" in source[:8] or "#!" in source or "namespace N.M;" in source or "package" in source or "M( {" in source or "m( {" in source:
            continue
        for s in read(language, source)[0]:
            if s["type"] != "import":
                want.append((s["type"], s["name"], s["line"] + line, s["parent"]))
        whole += source + "\n"
        line += source.count("\n") + 1
    got = [(s["type"], s["name"], s["line"], s["parent"]) for s in read(language, whole)[0] if s["type"] != "import"]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("language", SUFFIX)
def test_any_text_is_read(language):
    """Cut and shuffled sources never fail or hang, and tokens cover the text in order."""
    r = random.Random(7)
    pool = [x[1] for x in CASES if x[0] == language]
    for _ in range(150):
        source = "".join(r.choice(pool)[slice(*sorted((r.randrange(60), r.randrange(200))))] for _ in range(3))
        read(language, source, "p/m.tsx" if r.random() < 0.5 else None)
        t = Tokens(source, language, True)
        assert all(a <= b for a, b in zip(t.start, t.end, strict=True)) and all(a <= b for a, b in zip(t.end, t.start[1:], strict=False))


def test_long_files():
    """Work grows with the text: a file of some megabytes is read in seconds."""
    import time

    began = time.time()
    for language, source in (("typescript", "function f%d() { return a < b; g(`x${h()}`) }\n"), ("java", "class C%d { void m() { if (a < b) f(); } }\n"), ("rust", "fn f%d() { if a < b { g() } }\n")):
        text = "".join(source % k for k in range(10000))
        assert len(read(language, text)[0]) in (10000, 20000)
    assert time.time() - began < 60
