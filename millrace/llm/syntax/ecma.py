"""JavaScript, JSX, TypeScript and TSX: recursive-descent statements, precedence-climbing expressions, recovery at the next
statement boundary. Tokens are cut on demand, since only the parser knows whether a slash begins a regular expression."""

from __future__ import annotations

import re

from millrace.llm.syntax.base import MOST_NESTED, Bad, Problem, at_lines

#: Reserved words and binary operators with their precedence (fixed values).
RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
STARTS = frozenset("var let const function class if for while do return switch try throw import export interface type enum".split())

_SPACE = re.compile(r"(?:[\s﻿]|//[^\r\n  ]*|/\*[\s\S]*?\*/)*")
_TOKEN = re.compile(
    r"""(?P<name>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<private>\#[^\W\d][\w$]*|\#[$][\w$]*)
    |(?P<num>(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*|\d(?:_?\d)*(?=n))n?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)
    |(?P<str>"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/([A-Za-z]*)")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")


class _Parser:
    def __init__(self, text: str, ts: bool, jsx: bool):
        self.text, self.ts, self.jsx = text, ts, jsx
        self.found: list[tuple[int, str]] = []
        self.deep = self.functions = self.loops = self.asyncs = self.generators = 0
        self.no_in = False
        self.end = 0
        self.closed: dict[int, int] = {}
        self.pos = re.match(r"#![^\n]*", text).end() if text.startswith("#!") else 0
        self.next()

    # tokens
    def next(self):
        self.end = self.pos
        text = self.text
        a = _SPACE.match(text, self.pos).end()
        gap = text[self.pos : a]
        self.nl = "\n" in gap or "\r" in gap or self.pos == 0
        self.start = a
        if a >= len(text):
            self.k, self.v, self.pos = "end", "", a
            return
        if text.startswith("/*", a):
            self.k, self.v, self.pos = "bad", "/*", len(text)
            return
        m = _TOKEN.match(text, a)
        if not m:
            self.k, self.v, self.pos = "bad", text[a], a + 1
            return
        self.k, self.v, self.pos = m.lastgroup, m[0], m.end()
        if self.k == "num" and self.pos < len(text) and (text[self.pos].isalnum() or text[self.pos] in "_$"):
            self.k = "bad"
        if self.k == "op" and self.v == "`" or self.k == "private":
            pass

    def save(self):
        return self.pos, self.start, self.end, self.k, self.v, self.nl, self.deep, self.functions, self.loops, self.no_in, self.asyncs, self.generators

    def load(self, s):
        self.pos, self.start, self.end, self.k, self.v, self.nl, self.deep, self.functions, self.loops, self.no_in, self.asyncs, self.generators = s

    def fail(self, msg: str = ""):
        raise Bad(self.start, msg or (f"unexpected {self.v!r}" if self.k != "end" else "unexpected end of file"))

    def is_(self, v: str) -> bool:
        return self.v == v and self.k in ("op", "name")

    def eat(self, v: str) -> bool:
        if self.v == v and self.k in ("op", "name"):
            self.next()
            return True
        return False

    def need(self, v: str):
        if not self.eat(v):
            self.fail(f"expected {v!r}" if self.k != "end" else "unexpected end of file")

    def ident(self):
        if self.k != "name" or self.v in RESERVED:
            self.fail("expected an identifier")
        self.next()

    def semicolon(self):
        if self.eat(";") or self.is_("}") or self.k == "end" or self.nl:
            return
        self.fail()

    def trial(self, f) -> bool:
        s = self.save()
        try:
            f()
            return True
        except Bad:
            self.load(s)
            return False

    def ahead(self) -> tuple[str, str, bool]:
        s = self.save()
        self.next()
        out = self.k, self.v, self.nl
        self.load(s)
        return out

    def split_gt(self):
        """Takes one > off a longer operator, for type arguments."""
        if self.k == "op" and self.v.startswith(">") and len(self.v) > 1:
            self.pos = self.start + 1
            self.v = ">"

    def close_angle(self):
        self.split_gt()
        self.need(">")

    # statements
    def file(self):
        while self.k != "end":
            self.guarded()

    def guarded(self):
        a = self.start
        depth = self.deep, self.functions, self.loops
        try:
            self.statement()
        except Bad as e:
            self.found.append((e.pos, e.message))
            self.deep, self.functions, self.loops = depth
            self.no_in = False
            if self.start == a:
                self.next()
            while self.k != "end" and not (self.nl and (self.v in STARTS or self.is_("}"))):
                if self.is_(";"):
                    self.next()
                    break
                self.next()
            if self.is_("}") and not self.deep:
                self.next()

    def block(self):
        self.need("{")
        self.deep += 1
        if self.deep > MOST_NESTED:
            self.fail("too deep")
        while not self.is_("}"):
            if self.k == "end":
                self.fail()
            self.statement()
        self.deep -= 1
        self.next()

    def statement(self):
        v = self.v if self.k in ("name", "op") else ""
        if self.k == "bad":
            self.fail("unterminated comment" if self.v == "/*" else f"invalid token {self.v!r}")
        if v == "{":
            return self.block()
        if v == ";":
            return self.next()
        f = getattr(self, f"s_{v}", None) if self.k == "name" else None
        if f:
            return f()
        if v == "@":
            self.decorators()
            if self.is_("export"):
                return self.s_export()
            self.eat("abstract")
            return self.class_()
        if self.k == "name":
            k, w, nl = self.ahead()
            if v == "let" and (k == "name" and w not in ("in", "instanceof", "of") or w in ("[", "{")):
                return self.s_const()
            if v == "async" and w == "function" and not nl:
                self.next()
                return self.function(True, is_async=True)
            if v == "using" and k == "name" and not nl and w not in ("in", "of", "instanceof", "as"):
                return self.s_const()
            if self.ts and self.ts_declaration(v, k, w, nl):
                return None
            if w == ":" and v not in RESERVED:
                self.next()
                self.next()
                return self.statement()
        self.expression()
        self.semicolon()

    def s_var(self):
        self.s_const()

    def s_const(self):
        word = self.v
        self.next()
        if self.ts and word == "const" and self.is_("enum"):
            return self.enum()
        self.bindings(word)
        self.semicolon()

    def bindings(self, word: str, in_for: bool = False):
        while True:
            pattern = self.is_("{") or self.is_("[")
            self.pattern()
            if self.ts:
                self.eat("!")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment()
            elif not in_for and (pattern or word == "const") and not (self.ts and self.ambient):
                self.fail("missing initializer")
            if not self.eat(","):
                return

    ambient = False

    def pattern(self):
        if self.eat("["):
            while not self.is_("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.pattern()
                if self.eat("="):
                    self.with_in(self.assignment)
                if not self.is_("]"):
                    self.need(",")
            self.next()
        elif self.eat("{"):
            while not self.is_("}"):
                if self.eat("..."):
                    self.pattern()
                else:
                    plain = self.k == "name" and self.v not in RESERVED
                    self.property_name()
                    if self.eat(":"):
                        self.pattern()
                    elif not plain:
                        self.fail()
                    if self.eat("="):
                        self.with_in(self.assignment)
                if not self.is_("}"):
                    self.need(",")
            self.next()
        else:
            self.ident()

    def with_in(self, f):
        old, self.no_in = self.no_in, False
        out = f()
        self.no_in = old
        return out

    def property_name(self):
        if self.eat("["):
            self.with_in(self.assignment)
            self.need("]")
        elif self.k in ("name", "str", "num", "private"):
            self.next()
        else:
            self.fail()

    def paren(self):
        self.need("(")
        self.with_in(self.expression)
        self.need(")")

    def s_if(self):
        self.next()
        self.paren()
        self.statement()
        if self.eat("else"):
            self.statement()

    def loop(self):
        self.loops += 1
        self.statement()
        self.loops -= 1

    def s_while(self):
        self.next()
        self.paren()
        self.loop()

    def s_do(self):
        self.next()
        self.loop()
        self.need("while")
        self.paren()
        self.eat(";")

    def s_with(self):
        self.next()
        self.paren()
        self.statement()

    def s_for(self):
        self.next()
        self.eat("await")
        self.need("(")
        if not self.is_(";"):
            self.no_in = True
            k, w, _ = self.ahead()
            if self.v in ("var", "const") or self.v == "let" and (k == "name" and w != "in" or w in ("[", "{")) or self.v == "using" and k == "name" and w not in ("of", "in"):
                word = self.v
                self.next()
                self.bindings(word, True)
            else:
                self.expression()
            self.no_in = False
            if self.eat("of"):
                self.assignment()
                self.need(")")
                return self.loop()
            if self.eat("in"):
                self.expression()
                self.need(")")
                return self.loop()
        self.need(";")
        if not self.is_(";"):
            self.expression()
        self.need(";")
        if not self.is_(")"):
            self.expression()
        self.need(")")
        self.loop()

    def s_return(self):
        if not self.functions:
            self.fail("return outside of a function")
        self.next()
        if not (self.is_(";") or self.is_("}") or self.k == "end" or self.nl):
            self.expression()
        self.semicolon()

    def s_throw(self):
        self.next()
        if self.nl:
            self.fail("newline after throw")
        self.expression()
        self.semicolon()

    def s_break(self):
        self.next()
        if self.k == "name" and not self.nl and self.v not in RESERVED:
            self.next()
        self.semicolon()

    s_continue = s_break

    def s_debugger(self):
        self.next()
        self.semicolon()

    def s_try(self):
        self.next()
        self.block()
        some = False
        if self.eat("catch"):
            some = True
            if self.eat("("):
                self.pattern()
                if self.ts and self.eat(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.eat("finally"):
            some = True
            self.block()
        if not some:
            self.fail("expected catch or finally")

    def s_switch(self):
        self.next()
        self.paren()
        self.need("{")
        self.loops += 1
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not (self.is_("case") or self.is_("default") or self.is_("}")):
                if self.k == "end":
                    self.fail()
                self.statement()
        self.loops -= 1

    def s_function(self):
        self.function(True)

    def s_class(self):
        self.class_()

    def s_import(self):
        _, w, _ = self.ahead()
        if w in ("(", "."):
            self.expression()
            return self.semicolon()
        if self.deep or self.functions:
            self.fail("import may only appear at the top level")
        self.next()
        if self.k == "str":
            self.next()
        else:
            if self.ts and self.is_("type"):
                k, w, _ = self.ahead()
                if w in ("{", "*") or k == "name" and w != "from":
                    self.next()
            if self.k == "name" and self.v not in RESERVED:
                self.next()
                if self.ts and self.eat("="):
                    if self.is_("require"):
                        self.expression()
                    else:
                        self.entity()
                    return self.semicolon()
                if self.eat(","):
                    self.import_rest()
            else:
                self.import_rest()
            self.need("from")
            if self.k != "str":
                self.fail("expected a module name")
            self.next()
        self.attributes()
        return self.semicolon()

    def attributes(self):
        if (self.is_("with") or self.is_("assert") and not self.nl) and self.ahead()[1] == "{":
            self.next()
            self.object()

    def import_rest(self):
        if self.eat("*"):
            self.need("as")
            self.ident()
        else:
            self.names(False)

    def names(self, export: bool):
        self.need("{")
        while not self.is_("}"):
            if self.ts and self.is_("type") and self.ahead()[1] not in (",", "}", "as"):
                self.next()
            if self.k not in ("name", "str"):
                self.fail()
            self.next()
            if self.eat("as"):
                if self.k not in ("name", "str"):
                    self.fail()
                self.next()
            if not self.is_("}"):
                self.need(",")
        self.next()

    def s_export(self):
        if (self.deep or self.functions) and not self.ts:
            self.fail("export may only appear at the top level")
        self.next()
        if self.eat("*"):
            if self.eat("as"):
                self.next()
            self.need("from")
            if self.k != "str":
                self.fail()
            self.next()
            self.attributes()
            return self.semicolon()
        if self.eat("default"):
            if self.is_("function"):
                return self.function(True, anonymous=True)
            if self.is_("async") and self.ahead()[1] == "function":
                self.next()
                return self.function(True, anonymous=True, is_async=True)
            if self.is_("@"):
                self.decorators()
            if self.is_("class") or self.ts and self.is_("abstract") and self.ahead()[1] == "class":
                self.eat("abstract")
                return self.class_(anonymous=True)
            if self.ts and self.is_("interface"):
                return self.statement()
            self.assignment()
            return self.semicolon()
        if self.ts and self.is_("type") and self.ahead()[1] in ("{", "*"):
            self.next()
            if self.eat("*"):
                if self.eat("as"):
                    self.next()
                self.need("from")
                self.next()
                return self.semicolon()
        if self.is_("{"):
            self.names(True)
            if self.eat("from"):
                if self.k != "str":
                    self.fail()
                self.next()
                self.attributes()
            return self.semicolon()
        if self.ts and self.eat("="):
            self.expression()
            return self.semicolon()
        if self.ts and self.is_("as") and self.ahead()[1] == "namespace":
            self.next()
            self.next()
            self.ident()
            return self.semicolon()
        if self.ts and self.is_("import"):
            return self.s_import()
        if self.v in ("var", "let", "const", "function", "class", "@") or self.is_("async") and self.ahead()[1] == "function":
            return self.statement()
        if self.ts and self.v in ("interface", "type", "enum", "namespace", "module", "declare", "abstract"):
            k, w, nl = self.ahead()
            if self.ts_declaration(self.v, k, w, nl):
                return None
        return self.fail()

    # functions and classes
    def function(self, declaration: bool, anonymous: bool = False, is_async: bool = False):
        self.need("function")
        star = self.eat("*")
        if self.k == "name" and self.v not in RESERVED:
            self.next()
        elif declaration and not anonymous:
            self.fail("expected a function name")
        self.signature_and_body(declaration and self.ts, is_async, star)

    def signature_and_body(self, may_lack: bool = False, is_async: bool = False, generator: bool = False):
        old = self.no_in, self.asyncs, self.generators
        self.no_in, self.asyncs, self.generators = False, is_async, generator
        if self.ts and self.is_("<"):
            self.type_parameters()
        self.parameters()
        if self.ts and self.eat(":"):
            self.return_type()
        if not self.is_("{") and may_lack:
            self.semicolon()
        else:
            self.body()
        self.no_in, self.asyncs, self.generators = old

    def body(self):
        self.functions += 1
        loops, self.loops = self.loops, 0
        self.block()
        self.loops = loops
        self.functions -= 1

    def parameters(self):
        self.need("(")
        while not self.is_(")"):
            if self.is_("@"):
                self.decorators()
            if self.ts:
                while self.v in ("public", "private", "protected", "readonly", "override") and self.ahead()[0] == "name" or self.v in ("public", "private", "protected", "readonly") and self.ahead()[1] in ("{", "["):
                    self.next()
                if self.is_("this"):
                    self.next()
                    if self.eat(":"):
                        self.type()
                    if not self.is_(")"):
                        self.need(",")
                    continue
            rest = self.eat("...")
            self.pattern()
            if self.ts:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.eat("=") :
                self.assignment()
            if not self.is_(")"):
                if rest:
                    self.fail("rest parameter must be last")
                self.need(",")
        self.next()

    def decorators(self):
        while self.eat("@"):
            if self.is_("("):
                self.paren()
            else:
                self.ident()
                while self.eat("."):
                    self.next()
                if self.ts and self.is_("<"):
                    self.trial(self.type_arguments)
                if self.is_("("):
                    self.arguments()

    def class_(self, anonymous: bool = False):
        self.need("class")
        if self.k == "name" and self.v not in RESERVED and self.v != "implements":
            self.next()
        elif not anonymous:
            self.fail("expected a class name")
        if self.ts and self.is_("<"):
            self.type_parameters()
        if self.eat("extends"):
            self.unary_member()
            if self.ts and self.is_("<"):
                self.type_arguments()
        if self.ts and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        self.deep += 1
        if self.deep > MOST_NESTED:
            self.fail("too deep")
        while not self.is_("}"):
            if self.k == "end":
                self.fail()
            if not self.eat(";"):
                self.member()
        self.deep -= 1
        self.next()

    def member(self):
        if self.is_("@"):
            self.decorators()
        modifiers = ["static", "async", "get", "set", "accessor"] + ["public", "private", "protected", "readonly", "abstract", "override", "declare"] * self.ts
        is_async = star = lacks = getset = False
        while self.k == "name" and self.v in modifiers:
            word = self.v
            k, w, nl = self.ahead()
            if w in ("(", "=", ";", "}", ":", "?", "!", "<", ",") and k == "op" or k == "end" or nl and word in ("get", "set", "async", "accessor"):
                break
            is_async |= word == "async"
            lacks |= word in ("abstract", "declare")
            getset |= word in ("get", "set")
            self.next()
            if word == "static" and self.is_("{"):
                return self.body()
        star = self.eat("*")
        if self.ts and self.is_("[") :
            s = self.save()
            self.next()
            if self.k == "name":
                self.next()
                if self.eat(":"):
                    self.type()
                    self.need("]")
                    if self.eat(":"):
                        self.type()
                    return self.semicolon()
            self.load(s)
        self.property_name()
        if self.ts and (self.is_("?") or self.is_("!")):
            self.next()
        if self.is_("(") or self.ts and self.is_("<"):
            return self.signature_and_body(self.ts or lacks, is_async, star)
        if star or is_async or getset:
            self.fail()
        if self.ts and self.eat(":"):
            self.type()
        if self.eat("="):
            self.functions += 1
            self.with_in(self.assignment)
            self.functions -= 1
        return self.semicolon()

    # expressions
    def expression(self):
        kind = self.assignment()
        while self.eat(","):
            self.assignment()
            kind = "sequence"
        return kind

    def arrow_body(self, is_async: bool):
        if self.nl:
            self.fail()
        self.need("=>")
        old, self.asyncs = self.asyncs, is_async
        if self.is_("{"):
            no_in, self.no_in = self.no_in, False
            self.body()
            self.no_in = no_in
        else:
            self.assignment()
        self.asyncs = old
        return "arrow"

    def arrow(self):
        """An arrow function with parenthesised parameters, or Bad."""
        if self.ts and self.is_("<"):
            self.type_parameters()
        self.with_in(self.parameters)
        if self.ts and self.eat(":"):
            self.return_type()
        if not self.is_("=>") or self.nl:
            self.fail()

    def looks_arrow(self) -> bool:
        """Whether the parenthesis here is closed before an arrow, a colon or a brace of a body."""
        if self.is_("<"):
            return True
        text, i, n = self.text, self.start, len(self.text)
        if i not in self.closed:
            open_at: list[int] = []  # what opens on the way is closed on the way, so that nesting is read once
            while i < n:
                c = text[i]
                if c in "([{":
                    open_at.append(i)
                elif c in ")]}":
                    self.closed[open_at.pop()] = i
                    if not open_at:
                        break
                elif c in "\"'`":
                    i += 1
                    while i < n and text[i] != c:
                        i += 2 if text[i] == "\\" else 1
                elif c == "/" and text[i + 1 : i + 2] in ("/", "*"):
                    i = _SPACE.match(text, i).end()
                    continue
                i += 1
            for k in open_at:
                self.closed[k] = n
        end = self.closed[self.start]
        if end >= n:
            return False
        j = _SPACE.match(text, end + 1).end()
        return text.startswith("=>", j) or self.ts and text.startswith(":", j)

    def assignment(self):
        self.deep += 1
        if self.deep > MOST_NESTED:
            self.fail("too deep")
        try:
            return self.assignment_()
        finally:
            self.deep -= 1

    def assignment_(self):
        if self.is_("async"):
            k, w, nl = self.ahead()
            if not nl and k == "name" and w not in RESERVED and w not in ("of", "in", "instanceof", "as", "satisfies"):
                s = self.save()
                self.next()
                self.next()
                if self.is_("=>"):
                    return self.arrow_body(True)
                self.load(s)
            if not nl and (w == "(" or w == "<" and self.ts):
                s = self.save()
                self.next()
                if self.looks_arrow() and self.trial(self.arrow):
                    return self.arrow_body(True)
                self.load(s)
        elif self.k == "name" and self.v not in RESERVED:
            s = self.save()
            self.next()
            if self.is_("=>"):
                return self.arrow_body(False)
            self.load(s)
            if self.v == "yield" and self.generators:
                self.next()
                if self.eat("*"):
                    return self.assignment()
                if not (self.nl or self.k == "end" or self.v in (")", "]", "}", ",", ";", ":") and self.k == "op"):
                    self.assignment()
                return "yield"
        elif (self.is_("(") or self.is_("<") and self.ts) and self.looks_arrow() and self.trial(self.arrow):
            return self.arrow_body(False)
        a = self.start
        kind = self.conditional()
        if self.k == "op" and self.v in ASSIGN:
            if kind not in ("target", "pattern") or kind == "pattern" and self.v != "=":
                raise Bad(a, "invalid assignment target")
            self.next()
            self.assignment()
            return "assign"
        if kind == "pattern" and self.cover:
            self.fail()
        return kind

    cover = False

    def conditional(self):
        kind = self.binary(1)
        if self.is_("?"):
            self.next()
            self.with_in(self.assignment)
            self.need(":")
            self.assignment()
            return "op"
        return kind

    def binary(self, least: int):
        kind = self.unary()
        while True:
            if self.ts and self.k == "name" and self.v in ("as", "satisfies") and not self.nl:
                self.next()
                if not self.eat("const"):
                    self.type()
                kind = "target" if kind == "target" else "op"
                continue
            p = BINARY.get(self.v, 0) if self.k == "op" or self.v in ("in", "instanceof") and self.k == "name" else 0
            if p < least or not p or self.no_in and self.v == "in":
                return kind
            right = self.v == "**"
            self.next()
            self.binary(p if right else p + 1)
            kind = "op"

    def unary(self):
        if self.k == "private":
            self.next()
            if not self.is_("in"):
                self.fail()
            return "op"
        if self.k == "op" and self.v in ("!", "~", "+", "-", "++", "--") or self.k == "name" and self.v in ("typeof", "void", "delete"):
            update = self.v in ("++", "--")
            self.next()
            kind = self.unary()
            if update and kind != "target":
                self.fail("invalid operand")
            return "op"
        if self.is_("await") and (self.asyncs or not self.functions):
            k, w, nl = self.ahead()
            if self.asyncs or k in ("name", "str", "num") and not nl or w in ("(", "[", "`"):
                self.next()
                self.unary()
                return "op"
        if self.ts and not self.jsx and self.is_("<"):
            self.next()
            if not self.eat("const"):
                self.type()
            self.close_angle()
            self.unary()
            return "op"
        kind = self.unary_member()
        if self.k == "op" and self.v in ("++", "--") and not self.nl:
            if kind != "target":
                self.fail("invalid operand")
            self.next()
            return "op"
        return kind

    def unary_member(self):
        kind = self.primary()
        while True:
            if self.k == "op":
                v = self.v
                if v == ".":
                    self.next()
                    if self.k not in ("name", "private"):
                        self.fail()
                    self.next()
                    kind = "target"
                    continue
                if v == "?.":
                    self.next()
                    if self.is_("("):
                        self.arguments()
                    elif self.eat("["):
                        self.with_in(self.expression)
                        self.need("]")
                    elif self.k in ("name", "private"):
                        self.next()
                    else:
                        self.fail()
                    kind = "op"
                    continue
                if v == "[":
                    self.next()
                    self.with_in(self.expression)
                    self.need("]")
                    kind = "target"
                    continue
                if v == "(":
                    self.arguments()
                    kind = "call"
                    continue
                if v == "`":
                    self.template()
                    kind = "op"
                    continue
                if v == "!" and self.ts and not self.nl:
                    self.next()
                    continue
                if v in ("<", "<<") and self.ts and kind != "literal":
                    s = self.save()
                    try:
                        self.type_arguments()
                        if not (self.k == "op" and self.v in ("(", "`", ")", "]", ",", ";", ":", "}", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "?", "=") or self.nl or self.k == "end"):
                            self.fail()
                        kind = "op"
                        continue
                    except Bad:
                        self.load(s)
            return kind

    def arguments(self):
        self.need("(")
        while not self.is_(")"):
            self.eat("...")
            self.with_in(self.assignment)
            if not self.is_(")"):
                self.need(",")
        self.next()

    def primary(self):
        k, v = self.k, self.v
        if k == "name":
            if v == "function":
                self.function(False)
                return "literal"
            if v == "async" and self.ahead()[1] == "function" and not self.ahead()[2]:
                self.next()
                self.function(False, is_async=True)
                return "literal"
            if v == "class":
                self.class_(anonymous=True)
                return "literal"
            if v == "new":
                self.next()
                if self.eat("."):
                    self.need("target")
                    return "op"
                self.new_target()
                return "call"
            if v in ("this", "null", "true", "false"):
                self.next()
                return "literal" if v != "this" else "this"
            if v == "super":
                self.next()
                if not (self.is_("(") or self.is_(".") or self.is_("[")):
                    self.fail()
                return "op"
            if v == "import":
                self.next()
                if self.eat("."):
                    self.next()
                elif not self.is_("("):
                    self.fail()
                return "op"
            if v in RESERVED:
                self.fail()
            self.next()
            return "target"
        if k in ("num", "str"):
            if k == "num" and re.fullmatch(r"0\d+", v) and False:
                self.fail()
            self.next()
            return "literal"
        if k == "op":
            if v == "(":
                self.next()
                old, self.no_in = self.no_in, False
                kind = self.expression()
                self.no_in = old
                self.need(")")
                return "target" if kind == "target" else "op"
            if v == "[":
                self.next()
                old, self.no_in = self.no_in, False
                while not self.is_("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assignment()
                    if not self.is_("]"):
                        self.need(",")
                self.next()
                self.no_in = old
                return "pattern"
            if v == "{":
                self.object()
                return "pattern"
            if v == "`":
                self.template()
                return "literal"
            if v in ("/", "/="):
                m = _REGEX.match(self.text, self.start)
                if not m or re.search(r"[^dgimsuvy]|(.).*\1", m[1]):
                    self.fail("invalid regular expression")
                self.pos = m.end()
                self.next()
                return "literal"
            if v == "<" and self.jsx:
                self.element()
                self.next()
                return "op"
            if v == "@":
                self.decorators()
                self.class_(anonymous=True)
                return "literal"
        self.fail(f"invalid token {v!r}" if k == "bad" else "")

    def new_target(self):
        if self.eat("new"):
            if self.eat("."):
                self.need("target")
            else:
                self.new_target()
        else:
            self.primary()
        while True:
            if self.eat("."):
                if self.k not in ("name", "private"):
                    self.fail()
                self.next()
            elif self.eat("["):
                self.expression()
                self.need("]")
            elif self.ts and self.is_("<") and self.trial(self.type_arguments):
                continue
            elif self.ts and self.is_("!") and not self.nl:
                self.next()
            else:
                break
        if self.is_("("):
            self.arguments()

    def object(self):
        self.need("{")
        old, self.no_in = self.no_in, False
        while not self.is_("}"):
            if self.eat("..."):
                self.assignment()
            else:
                is_async = star = getset = False
                while self.k == "name" and self.v in ("async", "get", "set"):
                    k, w, nl = self.ahead()
                    if k == "op" and w not in ("[", "*") or k == "end" or getset:
                        break
                    is_async |= self.v == "async"
                    getset |= self.v in ("get", "set")
                    self.next()
                star = self.eat("*")
                plain = self.k == "name" and self.v not in RESERVED and not star and not getset and not is_async
                if self.k == "private":
                    self.fail()
                self.property_name()
                if self.is_("(") or self.ts and self.is_("<"):
                    self.signature_and_body(False, is_async, star)
                elif star or getset or is_async:
                    self.fail()
                elif self.eat(":"):
                    self.assignment()
                elif not plain:
                    self.fail()
                elif self.eat("="):
                    self.assignment()
            if not self.is_("}"):
                self.need(",")
        self.next()
        self.no_in = old

    def template(self):
        """From its first backtick to behind the last."""
        i, text, begin = self.start + 1, self.text, self.start
        while True:
            m = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*").match(text, i)
            i = m.end()
            if i >= len(text):
                raise Bad(begin, "unterminated template")
            if text[i] == "`":
                self.pos = i + 1
                self.next()
                return
            if text[i] == "\\":
                raise Bad(begin, "unterminated template")
            self.pos = i + 2
            self.next()
            self.with_in(self.expression)
            if not self.is_("}"):
                self.fail()
            i = self.start + 1

    # JSX works on characters: self.start stands at <; afterwards self.pos is behind the element
    def element(self):
        text = self.text
        self.deep += 1
        if self.deep > MOST_NESTED:
            self.fail("too deep")
        i = _SPACE.match(text, self.start + 1).end()
        m = _JSX_NAME.match(text, i)
        name = m[0] if m else ""
        i = m.end() if m else i
        while True:
            i = _SPACE.match(text, i).end()
            if i >= len(text):
                raise Bad(self.start, "unterminated element")
            if text.startswith("/>", i) and name:
                self.pos = i + 2
                self.deep -= 1
                return
            if text[i] == ">":
                i += 1
                break
            if text[i] == "{" and name:
                i = self.braces(i, True)
                continue
            m = _JSX_NAME.match(text, i)
            if not m or not name:
                raise Bad(i, "unexpected character in an element")
            i = _SPACE.match(text, m.end()).end()
            if text.startswith("=", i):
                i = _SPACE.match(text, i + 1).end()
                if text[i : i + 1] in ("'", '"'):
                    z = text.find(text[i], i + 1)
                    if z < 0:
                        raise Bad(i, "unterminated attribute")
                    i = z + 1
                elif text[i : i + 1] == "{":
                    i = self.braces(i, False)
                elif text[i : i + 1] == "<":
                    self.start = i
                    self.element()
                    i = self.pos
                else:
                    raise Bad(i, "invalid attribute")
        while True:
            m = re.compile(r"[^<{}>]*").match(text, i)
            i = m.end()
            if i >= len(text):
                raise Bad(i, "unterminated element")
            c = text[i]
            if c == "{":
                i = self.braces(i, True)
            elif c in "}>":
                raise Bad(i, f"unexpected {c!r}")
            elif re.compile(r"<\s*/").match(text, i):
                m = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(text, i)
                if not m or m[1] != name:
                    raise Bad(i, "closing tag does not match")
                self.pos = m.end()
                self.deep -= 1
                return
            else:
                self.start = i
                self.element()
                i = self.pos

    def braces(self, i: int, child: bool) -> int:
        self.pos = i + 1
        self.next()
        if child and self.is_("}"):
            return self.start + 1
        if child:
            self.eat("...")
        self.with_in(self.expression)
        if not self.is_("}"):
            self.fail()
        return self.start + 1

    # types
    def ts_declaration(self, v: str, k: str, w: str, nl: bool) -> bool:
        """Whether a TypeScript declaration stood here and was read; (k, w, nl) is the token after its first word."""
        if v == "interface" and k == "name" and not nl:
            self.next()
            self.ident()
            if self.is_("<"):
                self.type_parameters()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            self.object_type()
            return True
        if v == "type" and k == "name" and not nl and w not in ("in", "of", "instanceof"):
            self.next()
            self.ident()
            if self.is_("<"):
                self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
            return True
        if v == "enum" and k == "name":
            self.enum()
            return True
        if v in ("namespace", "module") and (k == "name" or k == "str" and v == "module") and not nl:
            self.next()
            if self.k == "str":
                self.next()
            else:
                self.entity()
            if self.is_("{"):
                self.block()
            else:
                self.semicolon()
            return True
        if v == "declare" and k == "name" and not nl and w not in RESERVED - {"var", "const", "function", "class", "enum"}:
            self.next()
            if self.is_("global"):
                self.next()
                self.block()
                return True
            old, self.ambient = self.ambient, True
            try:
                self.statement()
            finally:
                self.ambient = old
            return True
        if v == "abstract" and w == "class" and not nl:
            self.next()
            self.class_()
            return True
        return False

    def s_enum(self):
        if not self.ts:
            self.fail()
        self.enum()

    def enum(self):
        self.need("enum")
        self.ident()
        self.need("{")
        while not self.is_("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if not self.is_("}"):
                self.need(",")
        self.next()

    def entity(self):
        self.ident()
        while self.eat("."):
            self.next()

    def type_parameters(self):
        self.need("<")
        while True:
            while self.v in ("const", "in", "out") and self.ahead()[0] == "name":
                self.next()
            self.ident()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            self.split_gt()
            if not self.eat(",") or self.is_(">"):
                break
        self.close_angle()

    def type_arguments(self):
        if self.v == "<<":
            self.pos, self.v = self.start + 1, "<"
        self.need("<")
        while True:
            self.type()
            if not self.eat(","):
                break
        self.close_angle()

    def return_type(self):
        if self.is_("asserts") and self.ahead()[0] == "name" and not self.ahead()[2]:
            self.next()
            self.next()
            if self.eat("is"):
                self.type()
            return
        self.type()
        if self.is_("is") and not self.nl:
            self.next()
            self.type()

    def type(self):
        self.deep += 1
        if self.deep > MOST_NESTED:
            self.fail("too deep")
        try:
            self.type_()
        finally:
            self.deep -= 1

    def type_(self):
        if self.is_("abstract") and self.ahead()[1] == "new":
            self.next()
        if self.eat("new") or self.is_("<") or self.is_("(") and self.function_type():
            if self.is_("<"):
                self.type_parameters()
            self.parameters()
            self.need("=>")
            self.return_type()
            return
        self.union()
        if self.is_("extends") and not self.nl and not self.no_conditional:
            self.next()
            old, self.no_conditional = self.no_conditional, True
            self.type()
            self.no_conditional = old
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    no_conditional = False

    def function_type(self) -> bool:
        s = self.save()
        try:
            self.parameters()
            return self.is_("=>")
        except Bad:
            return False
        finally:
            self.load(s)

    def union(self):
        if self.is_("|") or self.is_("&"):
            self.next()
        self.type_operator()
        while self.is_("|") or self.is_("&"):
            self.next()
            if self.is_("("):
                self.type() if self.function_type() else self.type_operator()
            else:
                self.type_operator()

    def type_operator(self):
        if self.k == "name" and self.v in ("keyof", "unique", "readonly") and (self.ahead()[0] in ("name", "str") or self.ahead()[1] in ("(", "[", "{")):
            self.next()
            return self.type_operator()
        if self.is_("infer") and self.ahead()[0] == "name":
            self.next()
            self.next()
            if self.is_("extends"):
                s = self.save()
                self.next()
                try:
                    self.union()
                    if self.is_("?"):
                        self.load(s)
                except Bad:
                    self.load(s)
            return None
        self.type_primary()
        while True:
            if self.is_("[") and not self.nl:
                self.next()
                if not self.eat("]"):
                    self.type()
                    self.need("]")
            else:
                return None

    def type_primary(self):
        k, v = self.k, self.v
        if k in ("str", "num"):
            return self.next()
        if k == "name":
            if v == "typeof":
                self.next()
                if self.is_("import"):
                    return self.type_primary()
                if self.eat("this"):
                    pass
                else:
                    self.next()
                while self.eat("."):
                    self.next()
                if self.is_("<") and not self.nl:
                    self.type_arguments()
                return None
            if v == "import":
                self.next()
                self.arguments()
                while self.eat("."):
                    self.next()
                if self.is_("<"):
                    self.type_arguments()
                return None
            if v in ("this", "null", "true", "false", "void"):
                return self.next()
            if v in RESERVED:
                self.fail()
            self.next()
            while self.eat("."):
                if self.k != "name":
                    self.fail()
                self.next()
            if (self.is_("<") or self.is_("<<")) and not self.nl:
                self.type_arguments()
            return None
        if k == "op":
            if v == "-":
                self.next()
                if self.k != "num":
                    self.fail()
                return self.next()
            if v == "(":
                self.next()
                old, self.no_conditional = self.no_conditional, False
                self.type()
                self.no_conditional = old
                return self.need(")")
            if v == "[":
                self.next()
                while not self.is_("]"):
                    self.eat("...")
                    if self.k == "name" and self.ahead()[1] in (":", "?"):
                        s = self.save()
                        self.next()
                        self.eat("?")
                        if not self.eat(":"):
                            self.load(s)
                    self.type()
                    self.eat("?")
                    if not self.is_("]"):
                        self.need(",")
                return self.next()
            if v == "{":
                return self.object_type()
            if v == "`":
                i = self.start + 1
                begin = self.start
                while True:
                    m = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*").match(self.text, i)
                    i = m.end()
                    if i >= len(self.text):
                        raise Bad(begin, "unterminated template")
                    if self.text[i] == "`":
                        self.pos = i + 1
                        return self.next()
                    self.pos = i + 2
                    self.next()
                    self.type()
                    if not self.is_("}"):
                        self.fail()
                    i = self.start + 1
        return self.fail()

    def object_type(self):
        self.need("{")
        while not self.is_("}"):
            if self.k == "end":
                self.fail()
            if self.k == "op" and self.v in ("+", "-"):
                self.next()
                if not self.is_("readonly"):
                    self.fail()
            if self.is_("readonly") and self.ahead()[1] not in (":", "?", "(", ";", ",", "}", "<"):
                self.next()
            if self.v in ("get", "set") and self.k == "name" and (self.ahead()[0] in ("name", "str", "num") or self.ahead()[1] == "["):
                self.next()
            self.eat("new") if self.is_("new") and self.ahead()[1] in ("(", "<") else None
            if not (self.is_("(") or self.is_("<")):
                if self.is_("["):
                    s = self.save()
                    self.next()
                    if self.k == "name" and self.ahead()[1] in (":", "in"):
                        self.next()
                        if self.eat("in"):
                            self.type()
                            if self.eat("as"):
                                self.type()
                        else:
                            self.next()
                            self.type()
                        self.need("]")
                    else:
                        self.load(s)
                        self.property_name()
                else:
                    self.property_name()
                if self.k == "op" and self.v in ("+", "-"):
                    self.next()
                    if not self.is_("?"):
                        self.fail()
                self.eat("?")
            if self.is_("<"):
                self.type_parameters()
            if self.is_("("):
                self.parameters()
            if self.eat(":"):
                self.return_type()
            if not (self.eat(";") or self.eat(",") or self.is_("}") or self.nl):
                self.fail()
        self.next()


def problems(text: str, ts: bool, jsx: bool) -> list[Problem]:
    p = _Parser(text, ts, jsx)
    try:
        p.file()
    except RecursionError:
        p.found.append((p.start, "too deep"))
    found = sorted(set(p.found))
    return at_lines(text, found)
