from loomspan.sources.script import embedded, mock_sibling, read


def smells(source, kind, path="a.ts"):
    return [(s["detail"], s["line"]) for s in read(path, source).smells if s["kind"] == kind]


def test_expressions():
    found = lambda s: [d for d, _ in smells(s, "simplifiable-expression")]
    assert found("const a = b.c ? b.c : d;") == ["self-fallback-ternary"]
    assert found("const a = x && b ? b : d;") == []
    assert found("const a = f(x) ? true : false;") == ["ternary-returns-boolean"]
    assert found("type A<T> = T extends string ? true : false;") == []
    assert found("const a = !!b; const c = d!!;") == ["double-bang-boolean"]
    assert found("const a = b ?? null; const c = b ?? null.x;") == ["nullish-coalescing-with-nullish"]
    assert found("if (a.b !== null && a.b !== undefined) {}") == ["redundant-null-and-undefined-check"]
    assert found("if (a !== null && b !== undefined) {}") == []


def test_functions():
    found = lambda s: [d for d, _ in smells(s, "simplifiable-function")]
    assert found("const f = (a: number): string => { return a + 1; };") == ["block-arrow-single-return"]
    assert found("const f = (a) => { return { a }; };\nconst g = () => { return (<p/>); };") == []
    assert found("const f = (a) => { const b = a; return b; };") == []
    assert found("async function f(): Promise<T> { const x = await g(); return x; }") == ["redundant-await-return"]
    assert found("async function f() { try { const x = await g(); return x; } catch { } }") == []
    assert found("async function f() { return 1 }") == ["useless-async-no-await"]
    assert found("async function f(): Promise<number> { return 1 }\nasync function g() { return h(); }\nrun(async () => { x = 1 });") == []


def test_wrappers():
    found = lambda s: [d for d, _ in smells(s, "identity-wrapper")]
    assert found("const f = (a, b) => g.h(a, b);") == ["f -> g.h"]
    assert found("const f = function (a: number) { return g(a); };") == ["f -> g"]
    assert found("const f = (...r) => g(...r);") == ["f -> g"]
    assert found("const f = (a, b) => g(b, a);\nconst h = (a = 1) => g(a);\nconst i = async (a) => g(a);\nconst j = (a) => g(a).x;\nconst f = (a) => f(a);") == []


def test_assertions():
    found = lambda s, p="a.ts": [d for d, _ in smells(s, "unnecessary-assertion", p)]
    assert found("const a = b as any;") == ["assertion-to-any"]
    assert found("const a = b as unknown as T;") == ["redundant-double-assertion"]
    assert found("const a = b!!;") == ["double-non-null"]
    assert found("const a = 'x'!; const b = [1]!;") == ["redundant-non-null-on-literal"] * 2
    assert found("const a = <T>b;") == ["angle-bracket-assertion"]
    assert found("const a = <T>(b) => b; const c = d!.e; const g = !f;") == []
    assert found("const a = b as any;", "a.js") == []


def test_types_and_leaks():
    a = read("a.ts", "export interface A { x?: number; readonly y: string }\ntype C = string | null;\n").types
    b = read("b.ts", "interface B {\n  y: string\n  x: number\n}\ntype D = string | number\n").types
    assert [t["name"] for t in a + b] == ["A", "C", "B", "D"]
    assert a[0]["shape"] == b[0]["shape"] and a[1]["shape"] != b[1]["shape"]
    leaks = "interface P { a: 1 }\ninterface Q { b: 1 }\nexport { Q };\nexport function init(p: P, q: Q): P { return p }\nexport const go = (x: P) => x;\nfunction own(p: P) {}\n"
    assert [d for d, _ in smells(leaks, "private-type-leak")] == ["init:P", "go:P"]


def test_embedded_scripts_and_mocks():
    assert [i["specifier"] for i in read("a.vue", "<template><p/></template>\n<script setup lang=\"ts\">\nimport x from './x';\n</script>\n").imports] == ["./x"]
    assert read("a.svelte", "<script>\nimport x from './x';\n</script>\n<p/>").imports[0]["line"] == 2
    assert [i["specifier"] for i in read("a.astro", "---\nimport a from './a';\n---\n<p/>\n<script src=\"./b.js\"></script>\n<script>\nimport './c';\n</script>").imports] == ["./a", "./b.js", "./c"]
    assert [i["specifier"] for i in read("a.mdx", "import {\n  A\n} from './a'\n\n# Don't import this\n\n<A/>\n").imports] == ["./a"]
    assert embedded("a.ts", "x") == "x" and embedded("a.vue", "") == ""
    assert mock_sibling("./f/x") == "./f/__mocks__/x" and mock_sibling("x") is None
    assert [i["specifier"] for i in read("a.ts", "vi.mock('./x');\nvi.mock('./y', () => ({}));").imports] == ["./x", "./__mocks__/x", "./y"]


def test_odd_input():
    for s in ("", "}", "((((", "=>{return", "async", "export", "type A =", "interface B", "const f = (", "a ? b :", "!!", "export function"):
        read("a.ts", s)


def test_templates_and_declarations():
    f = read("a.ts", "import * as ns from './n';\nexport const { a, b: { c, d = 1 }, ...rest } = o, p = 1, [q, , r] = s;\nconst t = `x ${ns.b + `${used}`} y ${ns['z']}`;\nexport const g: Map<string, number> = new Map<string, number>(), h = 2;\n")
    assert [e["name"] for e in f.exports] == ["a", "c", "d", "rest", "p", "q", "r", "g", "h"]
    assert {(m["object"], m["member"]) for m in f.members} == {("ns", "b"), ("ns", "*")} and "used" in f.references
    assert read("a.ts", "const a = `${`${b}`}${'`'}`; import('./x');").imports[0]["specifier"] == "./x"


def test_default_exports_through_wrappers():
    local = lambda s: read("a.ts", s).exports[0]["local"]
    assert [local(f"export default {s}") for s in ("Foo", "memo(Foo)", "connect(map)(Foo)", "a.b(forwardRef(Bar))", "function go() {}", "class K extends L {}", "async function* gen() {}")] == ["Foo", "Foo", "map", "Bar", "go", "K", "gen"]
    assert [local(f"export default {s}") for s in ("function () {}", "class {}", "{ a: 1 }", "() => 1", "a.b")] == [None] * 5


def test_dynamic_imports():
    kinds = lambda s: [(i["specifier"], i["kind"]) for i in read("d/a.ts", s).imports]
    assert kinds("require.resolve('./a'); new URL('./w', import.meta.url); import(`./plain`); new URL('./n', base)") == [("./a", "dynamic"), ("./w", "url"), ("./plain", "dynamic")]
    assert kinds("import(`./p/${x}/i.ts`); import.meta.glob(['./a/*.ts', './b/**/*.{js,ts}']); require.context('./c', true, /\\.jsx?$/); require.context('./e', false, odd)") == [(r"^d/p/[^/]*/i\.ts$", "glob"), (r"^d/a/[^/]*\.ts$", "glob"), (r"^d/b/(?:.*/)?[^/]*\.(?:js|ts)$", "glob"), (r"^d/c/(?:.*/)?[^/]*\.(?:js|jsx)$", "glob")]
    assert kinds("@Component({ templateUrl: 'x.html', styleUrls: ['./a.css', 'b.css'] }) class A {}") == [("./x.html", "url"), ("./a.css", "url"), ("./b.css", "url")]
    assert [s["confidence"] for s in read("a.ts", "await import('./a'); import('./b').then(f); function g() { import('./c').catch(h) }").smells if s["kind"] == "lazy-import-top-level"] == ["high", "medium"]


def test_constants():
    found = lambda s: {(c["name"], c["literal"]) for c in read("a.ts", s).constants}
    assert found("const A = 'long enough', B = -1500;\nexport const C: string = `static text`;\nconst D = ['x', 1, null] as const;") == {("A", "long enough"), ("B", "-1500"), ("C", "`static text`"), ("D", "['x',1,null]")}
    assert found("const A = 'short'; const B = 999; const C = `a ${b} c long`; const D = ['x', y]; const metadata = 'long enough'; let E = 'long enough'; const F = 'long enough' + g; const H = 0x3e8;") == {("H", "1000")}


def test_complexity():
    of = lambda s: {f["name"]: (f["cyclomatic"], f["cognitive"], f["params"]) for f in read("a.ts", s).functions}
    assert of("function f(a, { b, c }, ...d) { if (a && b || c) { for (const x of d) { y?.z?.w() } } else if (q) { return r ? 1 : 2 } }") == {"f": (8, 10, 3)}
    assert of("class K { @Get() m<T>(a: T): T { switch (a) { case 1: case 2: break; default: } do { x() } while (y) } g = async (z) => { try { a() } catch { b() } } }") == {"m": (4, 3, 1), "g": (2, 1, 1)}
    assert of("const outer = (a) => items.map(x => { if (x) y() })") == {"outer": (1, 0, 1), "<arrow>": (2, 1, 1)}


def test_flags():
    of = lambda s: [(f["name"], f["kind"], f["provider"], f["guard_start"], f["guard_end"]) for f in read("a.ts", s).flags]
    assert of("if (process.env.FEATURE_A && isOn('b')) {\n  client.variation('c', u);\n}\nconst d = process.env['E'];") == [("FEATURE_A", "env-var", None, 1, 3), ("b", "sdk-call", "GrowthBook", 1, 3), ("c", "sdk-call", "LaunchDarkly", None, None), ("E", "env-var", None, None, None)]
    assert of("import { flag as f } from 'flags/next';\nexport const x = f({ key: 'new-nav' }) ?\n 1 : 2;\na.b.hasFeature('no'); page.evaluate('no');") == [("new-nav", "sdk-call", "Vercel Flags", 2, 3)]


def test_types_that_repeat():
    kinds = lambda s: [x["detail"] for x in read("a.ts", s).smells if x["kind"] == "redundant-type-pattern"]
    assert kinds("type A = B & {};\ntype C = 'x' | D | 'x';\ntype E = F & G & F;\ntype H = Readonly<Readonly<I>>;\ntype J = Pick<K, keyof K>;\ntype L = Omit<M, never>;\ninterface N extends O {}\n") == ["A:intersection-with-empty-object", "C:self-union", "E:self-intersection", "H:nested-readonly", "J:pick-all-keys", "L:omit-no-keys", "N:empty-interface-extends-one"]
    assert kinds("type A = B & { a: 1 };\ntype C = 'x' | 'y';\ntype H = Readonly<Partial<I>>;\ntype J = Pick<K, keyof L>;\ninterface N extends O, P {}\ninterface Q extends z.infer {}\ninterface R extends S { a: 1 }\n") == []
    inline = lambda s: [(t["context"], t["name"], t["preview"]) for t in read("a.ts", s).inline_types]
    assert inline("function f(p: { a: 1; b: 2; c: 3 }): Promise<{ x: 1, y: 2, z: 3 }> { const v: { q: 1; r: 2; s: 3; t: 4; u: 5 } = w; return { a: 1, b: 2, c: 3 } }\ninterface I { inner: { one: 1; two: 2; three: 3 } }\nclass K { prop: { d: 1; e: 2; f: 3 } = x; }\n") == [("function-parameter", "p", "{ a, b, c }"), ("function-return", None, "{ x, y, z }"), ("variable-annotation", "v", "{ q, r, s, t, +1 more }"), ("interface-property", "inner", "{ one, three, two }"), ("class-property", "prop", "{ d, e, f }")]
    assert inline("const a = { b: { c: 1, d: 2, e: 3 } }; f({ g: { h: 1, i: 2, j: 3 } }); const k = x ? { l: 1, m: 2, n: 3 } : { l: 1, m: 2, n: 3 };") == []


def test_members_and_uses():
    f = read("a.ts", "export enum E { A = 'a', B = 'b' }\nconst enum C { X }\nclass K extends L { #p = 1; private q = 2; static r() {} get s() { return 1 } @Get() t() {} render() {} constructor() {} u? = 3; }\n")
    assert [(m["owner"], m["member"], m["kind"], m["exported"]) for m in f.enum_members] == [("E", "A", "string", True), ("E", "B", "string", True), ("C", "X", "const", False)]
    assert [(m["member"], m["kind"], m["skipped"]) for m in f.class_members] == [("r", "method", False), ("s", "accessor", False), ("t", "method", True), ("render", "method", True), ("u", "property", False)]
    uses = {(u["name"], u["member"]): u["n"] for u in read("a.ts", "import { E, T } from './e';\nconst a: T = E.A;\nlog(E);\nE[x];\nfunction f(p: T): T { return p }\nexport { T };\nkey({ E: 1 });\n").uses}
    assert uses[("E", "A")] == 1 and uses[("E", "*")] == 1 and uses[("E", "[")] == 1 and uses[("T", "")] == 3
    assert [a["name"] for a in read("a.ts", "import { x } from './x';\nconst a = x;\nconst b = window;\nexport const c = x;\nconst d = x.y;\nconst e = x\n").aliases] == ["a", "e"]
