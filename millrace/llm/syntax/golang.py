"""Go: recursive-descent statements, precedence-climbing expressions, recovery at the next statement or declaration."""

from __future__ import annotations

import re

from millrace.llm.syntax.base import MOST_NESTED, Bad, Problem, at_lines

#: Reserved words and binary operators with their precedence (fixed values).
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())

_TOKEN = re.compile(
    r"""(?P<nl>\n)|(?P<ws>[ \t\r]+|//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<name>[^\W\d]\w*)
    |(?P<num>(?:0[xX](?:_?[\da-fA-F])*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)i?)
    |(?P<str>"(?:[^"\\\n]|\\(?:[abfnrtv\\"']|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))')
    |(?P<op>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!()\[\]{},;.:~])""",
    re.X,
)
_ENDS = frozenset("++ -- ) ] }".split())
_WORD_ENDS = frozenset("break continue fallthrough return".split())


def _tokens(text: str, found: list) -> list[tuple[str, str, int]]:
    out, pos, n = [], 0, len(text)

    def newline(p):
        if out and (out[-1][0] in ("name", "num", "str") or out[-1][1] in _ENDS or out[-1][1] in _WORD_ENDS):
            out.append(("op", ";", p))

    while pos < n:
        m = _TOKEN.match(text, pos)
        if not m:
            found.append((pos, f"invalid token {text[pos]!r}"))
            pos += 1
            if pos > 1 and text[pos - 1] in "\"'`":
                pos = (text.find("\n", pos) + 1 or n) - 1
            continue
        k, s = m.lastgroup, m[0]
        if k == "nl" or k == "block" and "\n" in s:
            newline(pos)
        elif k in ("name", "num", "str", "op"):
            if k == "num" and m.end() < n and (text[m.end()].isalpha() or text[m.end()] == "_"):
                found.append((pos, "invalid number"))
            out.append(("kw" if k == "name" and s in KEYWORDS else k, s, pos))
        pos = m.end()
    # reserved words that end a statement
    newline(n)
    out.append(("end", "", n))
    return out


class _Parser:
    def __init__(self, text: str):
        self.found: list[tuple[int, str]] = []
        self.t = _tokens(text, self.found)
        self.i, self.deep, self.level = 0, 0, 0  # level < 0: in the header of a statement, where a brace begins its block

    @property
    def v(self):
        k, s, _ = self.t[self.i]
        return s if k in ("op", "kw") else ""

    @property
    def k(self):
        return self.t[self.i][0]

    def fail(self, msg: str = ""):
        k, s, p = self.t[self.i]
        raise Bad(p, msg or (f"unexpected {s!r}" if k != "end" else "unexpected end of file"))

    def eat(self, s: str) -> bool:
        if self.v == s:
            self.i += 1
            return True
        return False

    def need(self, s: str):
        if not self.eat(s):
            self.fail(f"expected {s!r}" if self.k != "end" else "unexpected end of file")

    def name(self):
        if self.k != "name":
            self.fail("expected a name")
        self.i += 1

    def end(self):
        if self.v not in (")", "}"):
            if self.k == "end":
                return
            self.need(";")

    def names(self):
        self.name()
        while self.eat(","):
            self.name()

    # file
    def file(self):
        if self.k == "end":
            return
        try:
            self.need("package")
            self.name()
            self.end()
        except Bad as e:
            self.found.append((e.pos, e.message))
            self.skip()
        imports = True
        while self.k != "end":
            start = self.i
            try:
                self.deep = self.level = 0
                if self.v == "import":
                    if not imports:
                        self.fail("imports must come before other declarations")
                    self.i += 1
                    self.group(self.import_spec)
                elif self.eat(";"):
                    continue
                else:
                    imports = False
                    self.declaration()
                self.end()
            except Bad as e:
                self.found.append((e.pos, e.message))
                if self.i == start:
                    self.i += 1
                self.skip()

    def skip(self):
        while self.k != "end" and not (self.v in ("func", "type", "var", "const", "import") and self.t[self.i - 1][1] == ";"):
            self.i += 1

    def group(self, spec):
        if self.eat("("):
            while self.v != ")":
                spec()
                self.end()
            self.i += 1
        else:
            spec()

    def import_spec(self):
        if self.k == "name" or self.v == ".":
            self.i += 1
        if self.k != "str" or self.t[self.i][1][0] == "'":
            self.fail("expected an import path")
        self.i += 1

    def declaration(self):
        if self.eat("func"):
            if self.v == "(":
                self.parameters()
            self.name()
            if self.v == "[":
                self.type_params()
            self.signature()
            if self.v == "{":
                self.body()
        elif self.v in ("var", "const", "type"):
            self.simple_declaration()
        else:
            self.fail("expected a declaration")

    def simple_declaration(self):
        w = self.v
        self.i += 1
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[w])

    def var_spec(self):
        self.names()
        if self.v != "=":
            self.type()
        if self.eat("="):
            self.expressions()

    def const_spec(self):
        self.names()
        if self.v not in ("=", ";", ")"):
            self.type()
        if self.eat("="):
            self.expressions()

    def type_spec(self):
        self.name()
        if self.v == "[":
            at = self.i
            try:
                self.type_params()
                if self.v in (";", ")", "}"):
                    raise Bad(0, "")
            except Bad:
                self.i = at
        self.eat("=")
        self.type()

    def type_params(self):
        self.need("[")
        while True:
            self.names()
            self.constraint()
            if not self.eat(",") or self.v == "]":
                break
        self.need("]")

    def constraint(self):
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def signature(self):
        self.parameters()
        if self.v == "(":
            self.parameters()
        elif self.k == "name" or self.v in ("*", "[", "func", "map", "chan", "struct", "interface", "<-"):
            self.type()

    def parameters(self):
        self.need("(")
        named = lone = False
        while self.v != ")":
            self.eat("...")
            was_name = self.k == "name"
            self.type()
            if was_name and self.v not in (",", ")"):
                self.eat("...")
                self.type()
                named = True
            else:
                lone = lone or not was_name
            if not self.eat(","):
                break
        self.need(")")
        if named and lone:
            self.fail("mixed named and unnamed parameters")

    # types
    def type(self):
        self.deep += 1
        if self.deep > MOST_NESTED:
            self.fail("too deep")
        level, self.level = self.level, max(self.level, 0)
        v = self.v
        if self.k == "name":
            self.i += 1
            if self.v == "." and self.t[self.i + 1][0] == "name":
                self.i += 2
            if self.v == "[" and self.t[self.i + 1][1] != "]":
                at = self.i
                try:
                    self.i += 1
                    self.type()
                    while self.eat(","):
                        if self.v == "]":
                            break
                        self.type()
                    self.need("]")
                except Bad:
                    self.i = at
        elif v == "*":
            self.i += 1
            self.type()
        elif v == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif v == "[":
            self.i += 1
            if not self.eat("]"):
                if not self.eat("..."):
                    self.expression()
                self.need("]")
            self.type()
        elif v == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif v == "chan":
            self.i += 1
            self.eat("<-")
            self.type()
        elif v == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif v == "func":
            self.i += 1
            self.signature()
        elif v == "struct":
            self.i += 1
            self.need("{")
            while self.v != "}":
                if self.eat("*"):
                    self.type()
                elif self.v == "(":
                    self.type()
                else:
                    self.name()
                    if self.v == ".":
                        self.i += 1
                        self.name()
                        if self.v == "[":
                            self.i += 1
                            self.type()
                            while self.eat(","):
                                self.type()
                            self.need("]")
                    elif self.v not in (";", "}") and self.k != "str":
                        while self.eat(","):
                            self.name()
                        self.type()
                if self.k == "str":
                    self.i += 1
                self.end()
            self.i += 1
        elif v == "interface":
            self.i += 1
            self.need("{")
            while self.v != "}":
                if self.k == "name" and self.t[self.i + 1][1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
            self.i += 1
        else:
            self.fail("expected a type")
        self.level = level
        self.deep -= 1

    # statements
    def body(self):
        level, self.level = self.level, 0
        self.block()
        self.level = level

    def block(self):
        self.need("{")
        self.deep += 1
        if self.deep > MOST_NESTED:
            self.fail("too deep")
        self.statements()
        self.need("}")
        self.deep -= 1

    def statements(self):
        while self.v not in ("}", "case", "default"):
            if self.k == "end":
                self.fail()
            self.statement()
            if self.v not in ("}", "case", "default"):
                self.need(";")

    def statement(self):
        v = self.v
        if v in ("var", "const", "type"):
            return self.simple_declaration()
        if v == "{":
            return self.block()
        if v == ";":
            return None
        if v == "return":
            self.i += 1
            if self.v not in (";", "}"):
                self.expressions()
            return None
        if v in ("break", "continue", "goto"):
            self.i += 1
            if self.k == "name":
                self.i += 1
            elif v == "goto":
                self.fail()
            return None
        if v == "fallthrough":
            self.i += 1
            return None
        if v in ("go", "defer"):
            self.i += 1
            if self.expression() != "call":
                self.fail("expected a call")
            return None
        if v == "if":
            return self.if_()
        if v == "for":
            return self.for_()
        if v == "switch":
            return self.switch()
        if v == "select":
            self.i += 1
            return self.cases(lambda: self.simple())
        if self.k == "name" and self.t[self.i + 1][1] == ":" and self.t[self.i + 1][0] == "op":
            self.i += 2
            if self.v != "}":
                self.statement()
            return None
        return self.simple()

    def simple(self, ranges: bool = False):
        if ranges and self.eat("range"):
            self.expression()
            return "range"
        start = self.i
        kind = self.expressions()
        v = self.v
        if v in ASSIGN:
            if v == ":=" and not all(k == "name" or s == "," for k, s, _ in self.t[start : self.i]):
                self.fail("non-name on the left of :=")
            if v not in ("=", ":=") and kind == "list":
                self.fail()
            if kind == "value":
                self.fail("cannot assign to this expression")
            self.i += 1
            if ranges and self.eat("range"):
                self.expression()
                return "range"
            self.expressions()
            return "assign"
        if kind == "list":
            self.fail("expected an assignment")
        if v in ("++", "--"):
            self.i += 1
            return "assign"
        if self.eat("<-"):
            self.expression()
            return "send"
        return kind

    def header(self, f):
        level, self.level = self.level, -1
        out = f()
        self.level = level
        return out

    def if_(self):
        self.need("if")

        def head():
            kind = None
            if self.v == "{":
                self.fail("missing condition")
            if self.v != ";":
                kind = self.simple()
            if self.eat(";"):
                if self.v == "{":
                    self.fail("missing condition")
                kind = self.simple()
            if kind in ("assign", "send"):
                self.fail("used as value")

        self.header(head)
        self.block_in()
        if self.eat("else"):
            if self.v == "if":
                self.if_()
            else:
                self.block_in()

    def block_in(self):
        level, self.level = self.level, 0
        self.block()
        self.level = level

    def for_(self):
        self.need("for")

        def head():
            if self.v == "{":
                return
            kind = None
            if self.v != ";":
                kind = self.simple(True)
            if kind == "range" or self.v == "{":
                if kind in ("assign", "send"):
                    self.fail("used as value")
                return
            self.need(";")
            if self.v != ";":
                self.simple()
            self.need(";")
            if self.v != "{":
                self.simple()

        self.header(head)
        self.block_in()

    def switch(self):
        self.need("switch")

        def head():
            if self.v == "{":
                return
            if self.v != ";":
                self.simple()
            if self.eat(";") and self.v != "{":
                self.simple()

        self.header(head)
        level, self.level = self.level, 0
        self.cases(self.case_list)
        self.level = level

    def case_list(self):
        while True:
            self.type_or_expression()
            if not self.eat(","):
                return

    def type_or_expression(self):
        if self.v in ("[", "map", "chan", "struct", "interface", "func", "*"):
            at = self.i
            try:
                self.type()
                if self.v in (",", ":"):
                    return
            except Bad:
                pass
            self.i = at
        self.expression()

    def cases(self, head):
        self.need("{")
        while self.v != "}":
            if self.eat("case"):
                head()
            else:
                self.need("default")
            self.need(":")
            self.statements()
        self.i += 1

    # expressions
    def expressions(self):
        kind, many = self.expression(), False
        while self.eat(","):
            k = self.expression()
            kind = "value" if "value" in (k, kind) else kind
            many = True
        return "list" if many and kind != "value" else kind

    def expression(self, least: int = 1):
        self.deep += 1
        if self.deep > MOST_NESTED:
            self.fail("too deep")
        kind = self.unary()
        while (p := BINARY.get(self.v, 0)) >= least and self.k == "op":
            self.i += 1
            self.expression(p + 1)
            kind = "value"
        self.deep -= 1
        return kind

    def unary(self):
        if self.k == "op" and self.v in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            v = self.v
            self.i += 1
            if v == "<-" and self.v == "chan":
                self.i -= 1
                self.type()
                return "value"
            self.unary()
            return {"*": "target", "<-": "receive"}.get(v, "value")
        return self.primary()

    def primary(self):
        kind, literal = self.operand()
        while True:
            v = self.v if self.k == "op" else ""
            if v == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    kind, literal = "value", False
                else:
                    self.name()
                    kind = "target"
            elif v == "[":
                self.i += 1
                level, self.level = self.level, 1
                if self.v == "]":
                    self.fail("expected an operand")
                if self.v != ":":
                    self.type_or_index()
                    while self.eat(","):
                        if self.v == "]":
                            break
                        self.type()
                if self.eat(":"):
                    if self.v not in ("]", ":"):
                        self.expression()
                    if self.eat(":"):
                        self.expression()
                    literal = False
                self.level = level
                self.need("]")
                kind = "target"
            elif v == "(":
                self.i += 1
                level, self.level = self.level, 1
                while self.v != ")":
                    self.type_or_expression_arg()
                    self.eat("...")
                    if not self.eat(","):
                        break
                self.level = level
                self.need(")")
                kind, literal = "call", False
            elif v == "{" and literal and (self.level >= 0 or literal == "type"):
                self.composite()
                kind, literal = "value", False
            else:
                return kind

    def type_or_index(self):
        self.type_or_expression_arg()

    def type_or_expression_arg(self):
        if self.v in ("[", "map", "chan", "struct", "interface") or self.v == "func":
            at = self.i
            try:
                self.type()
                if self.v in (",", ")", "]"):
                    return
            except Bad:
                pass
            self.i = at
        self.expression()

    def operand(self):
        k, s, _ = self.t[self.i]
        if k in ("num", "str"):
            self.i += 1
            return "value", False
        if k == "name":
            self.i += 1
            return "target", "name"
        if s == "(":
            self.i += 1
            level, self.level = self.level, 1
            kind = None
            if self.v in ("[", "map", "chan", "struct", "interface", "func"):
                self.type_or_expression()
                kind = "value"
            else:
                kind = self.expression()
            self.level = level
            self.need(")")
            return ("target" if kind == "target" else "value"), False
        if s == "func":
            self.i += 1
            self.signature()
            if self.v == "{":
                self.body()
            return "value", False
        if s in ("[", "map", "chan", "struct", "interface"):
            self.type()
            return "value", "type"
        self.fail()

    def composite(self):
        self.need("{")
        self.deep += 1
        if self.deep > MOST_NESTED:
            self.fail("too deep")
        level, self.level = self.level, 1
        while self.v != "}":
            self.element()
            if self.eat(":"):
                self.element()
            if not self.eat(","):
                break
        self.level = level
        self.need("}")
        self.deep -= 1

    def element(self):
        if self.v == "{":
            self.composite()
        else:
            self.expression()


def problems(text: str) -> list[Problem]:
    p = _Parser(text)
    try:
        p.file()
    except RecursionError:
        p.found.append((0, "too deep"))
    found = sorted(set(p.found))
    return at_lines(text, found)
