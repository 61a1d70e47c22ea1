"""Calls by syntax: cases, and random programs whose direct arguments are known from how they were made."""

import random

import pytest

from scansmith.operators.calls import NoProgram, Program, all_strings, call_strings

CASES = [
    ('a.replace(/"/g,"");fetch("/api/x")', ["/api/x"]),
    ('(a||b)("/api/x")', ["/api/x"]),
    ('f()("/api/x")', ["/api/x"]),
    ('arr[0]("/api/x")', ["/api/x"]),
    ('x["get"](`/api/m`)', ["/api/m"]),
    ("x[get](`/api/m`);x[a+get](`/api/no`)", ["/api/m"]),
    ('`${fetch("/api/x")}`', ["/api/x"]),
    ('new Foo("/api/x")', []),
    ('fetch("/api/" + id)', []),
    ('fetch(c ? "/api/a" : "/api/b")', []),
    ('function fetch(a="/api/d"){}', []),
    ('fetch(`/api/${a+`x${b("/api/in")}`}/rest`)', ["/api/", "/api/in", "/rest"]),
    ('var o={get(a="/api/n"){return f("/api/y")},post:g("/api/z")}', ["/api/y", "/api/z"]),
    ('class A extends B{x=f("/api/1")\n get(u){return this.get("/api/2",/[/"]/)}static{f("/api/3")}}', ["/api/1", "/api/2", "/api/3"]),
    ('if(a)/"/.test(b);f("/api/x")', ["/api/x"]),
    ('x=a/b/c;f("/api/x")', ["/api/x"]),
    ('(a)=>{f("/api/x")}\nasync()=>g("/api/y")', ["/api/x", "/api/y"]),
    ('new a.b.C("/api/no").get("/api/yes")', ["/api/yes"]),
    ('new (f("/api/x"))("/api/no")', ["/api/x"]),
    ('new new A()("/api/no");new B\nf("/api/x")', ["/api/x"]),
    ('new new A()("/api/no");new B;f("/api/x")', ["/api/x"]),
    ('hello world f("/api/x")', []),
    ('f("/api/x"', []),
    ('f("/api/x"])', []),
    ('f("/api/x");"open', []),
    ('f("/api/x");/* open', []),
    ('f(("/api/x"),["/api/no"],...["/api/q"])', ["/api/x"]),
    ('f(("a","/api/no"))', []),
    ('axios.get(`/api/a`,"/api/b");foo(`/api/c`)', ["/api/a", "/api/b"]),
    ('import("/api/x");import a from "/api/no"\nexport default {a:f("/api/y")}', ["/api/x", "/api/y"]),
    ('export {a as b} from "/api/no";export const c=f("/api/x");export function g(){h("/api/y")}', ["/api/x", "/api/y"]),
    ('switch(a){case "/api/no":f("/api/x");default:g("\\/api\\/y")}', ["/api/x", "/api/y"]),
    ('for(const x of f("/api/x"))g(x)\nlabel:for(;;){break label}\ndo{h("/api/y")}while(i("/api/z"))', ["/api/x", "/api/y", "/api/z"]),
    ('async function f(){await get("/api/x")}\n!function(){g("/api/y")}()', ["/api/x", "/api/y"]),
    ('a\n++b\nf("/api/x")', ["/api/x"]),
    ('x={get:1,set:2,async:3,function:4,[f("/api/k")]:5,"q":6,7:8,*g(){},async h(){},...r}', ["/api/k"]),
    ('tag`/api/t`;f(tag`/api/u`);fetch?.("/api/v");a?.b?.get(`/api/w`)', ["/api/v", "/api/w"]),
    ('try{a("/api/1")}catch{b("/api/2")}finally{c("/api/3")}', ["/api/1", "/api/2", "/api/3"]),
    ('const {a,b:{c}}=f("/api/x"),[d]=g("/api/y");let e=function(){return{get:h("/api/z")}}', ["/api/x", "/api/y", "/api/z"]),
    ("(fetch)(`/api/x`);(a,get)(`/api/no`);(b||get)(`/api/no`)", ["/api/x"]),
    ('<div class="a">f("/api/x")</div>', []),
    ('if (a) return f("/api/x")\nelse return /a"b/', ["/api/x"]),
    ('a=function*(){yield f("/api/x");yield* g("/api/y")}', ["/api/x", "/api/y"]),
    ("x='it''s';f('/api/x')", []),
    ('f("\\x2fapi\\u{2f}x", "/a\\\npi")', ["/api", "/api/x"]),
    ("", []),
    ("#" * 3, []),
]


@pytest.mark.parametrize("text, want", CASES, ids=range(len(CASES)))
def test_calls(text, want):
    assert sorted(v for v, _ in call_strings(text)) == sorted(want)


def test_lines_and_first_places():
    assert call_strings('f("/api/a");\n/*\n*/g(`x`,\r\n"/api/b","/api/a") h("/api/c")') == [("/api/a", 1), ("/api/b", 4), ("/api/c", 5)]
    assert all_strings('x = {"k": \'v\'};\ny("é")') == [("k", 1), ("v", 1), ("é", 2)]
    assert all_strings("not a program") == []


class _Maker:
    """Random programs; made holds the (value, whether found) of every endpoint that it writes."""

    def __init__(self, seed):
        self.rng, self.made, self.depth = random.Random(seed), [], 0

    def gap(self):
        return self.rng.choice(["", "", "", " ", " /* ) \" */ ", "  "])

    def value(self, found):
        self.made.append((f"/api/{len(self.made)}", found))
        return self.made[-1][0]

    def literal(self, found):
        quote, value = self.rng.choice("\"'"), self.value(found)
        return f"{quote}{value.replace('/', self.rng.choice(['/', chr(92) + '/']))}{quote}"

    def template(self, found):
        inner = self.rng.choice([lambda: "", lambda: f"${{{self.expression()}}}", lambda: "${`a}${" + self.expression() + "}`}"])
        head, middle = self.value(found), inner()
        return f"`{head}{middle}" + (self.rng.choice(["", "-'\"(\\`", "$", " / "]) if middle else "") + "`"

    def callee(self):
        r = self.rng
        name = r.choice(["fetch", "axios.get", "x.y.post", "$.ajax", "this.open", 'w["put"]', "foo", "a.b", "x[0]", "h()", "(a||get)", "(function(a){})", "obj.items[fetch(1)].run"])
        known = name in ("fetch", "axios.get", "x.y.post", "$.ajax", "this.open", 'w["put"]')
        return name, known

    def call(self):
        name, known = self.callee()
        out = []
        for _ in range(self.rng.randint(0, 3)):
            k = self.rng.randrange(5)
            out.append(self.literal(True) if k == 0 else self.template(known) if k == 1 else f"({self.literal(True)})" if k == 2 else self.expression())
        return f"{name}{self.gap()}({self.gap()}{(self.gap() + ',').join(out)}{self.gap()})"

    def expression(self):
        self.depth += 1
        r, deep = self.rng, self.depth > 5
        kinds = [lambda: "a", lambda: "1.5", lambda: "/[/\"'`(]\\/+/g.test(b)", lambda: "x / y / 2", lambda: f"b + {self.literal(False)}"]
        if not deep:
            e = self.expression
            kinds += [self.call, self.call, self.call, lambda: f"[{e()},{e()}]", lambda: f"({e()} , {e()})", lambda: f"c ? {e()} : {e()}", lambda: f"new Foo({self.literal(False)},{e()})", lambda: f"!({e()})"]
            kinds += [lambda: f"{{a:{e()}, get(b={self.literal(False)}){{{self.statement()}}}, 'c':{e()}}}", lambda: f"(p={self.literal(False)})=>{{{self.statement()}}}", lambda: f"function(){{{self.statement()}}}", lambda: f"typeof {e()}"]
            kinds += [lambda: f"({e()}) || /\\//", lambda: f"tag{self.template(False)}", lambda: f"x = {e()}"]
        out = r.choice(kinds)()
        self.depth -= 1
        return f"({out})" if r.random() < 0.3 and not out.startswith(('"', "'", "`", "/api")) else out

    def statement(self):
        r, e = self.rng, self.expression
        kinds = [lambda: f"v = {e()};", lambda: f"if ({e()}) /\"/.exec({e()});", lambda: f"return ({e()})\n", lambda: f"for (const q of [{e()}]) {{ u = {e()} }}\n", lambda: f"class K {{ m(a={self.literal(False)}) {{ return ({e()}) }} f = {e()};}}\n", lambda: f"var z = {e()}\n", lambda: f"do {{ t = {e()} }} while ({e()})\n", lambda: "// it's \"(\n"]
        return r.choice(kinds)()


@pytest.mark.parametrize("seed", range(300))
def test_random_programs(seed):
    maker = _Maker(seed)
    text = "".join(maker.statement() for _ in range(6))
    assert [v for v, _ in call_strings(text)] == [v for v, found in maker.made if found], text
    Program(text)


def test_deep_and_long_programs():
    deep = "(" * 20_000 + 'f("/api/x")' + ")" * 20_000
    assert call_strings(deep) == [("/api/x", 1)]
    assert len(call_strings("".join(f'f("/api/{i}");\n' for i in range(20_000)))) == 20_000
    with pytest.raises(NoProgram):
        Program(deep[:-1])
