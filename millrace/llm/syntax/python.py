"""Python 3.13: recursive-descent statements, precedence-climbing expressions, recovery at the next line of no deeper indent."""

from __future__ import annotations

import re

from millrace.llm.syntax.base import Bad, Problem, at_lines

#: Reserved words and operators of the language (fixed values).
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
BINARY = {"|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
COMPARE = frozenset("< > == != <= >= in is not".split())
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())

_TOKEN = re.compile(
    r"""(?P<ws>[ \t\f]+|\\\r?\n)|(?P<comment>\#[^\r\n]*)|(?P<nl>\r?\n|\r)
    |(?P<str>(?i:[rbu]|br|rb|f|fr|rf)?(?:\"\"\"|'''|\"|'))
    |(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)
    |(?P<name>[^\W\d]\w*)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|<=|>=|==|!=|[+\-*/%@&|^]=|[+\-*/%@&|^~<>()\[\]{},:.;=])""",
    re.X,
)


#: The language's own limits: open brackets, and levels of indentation with the outermost.
MOST_BRACKETS, MOST_INDENTS = 200, 100


class _Lexer:
    def __init__(self, text: str):
        self.text, self.tokens, self.problems = text, [], []
        self.run()

    def bad(self, pos: int, msg: str):
        self.problems.append((pos, msg))

    def run(self):
        text, pos, n = self.text, 0, len(self.text)
        indents, depth, start = [0], [], True
        out = self.tokens
        if text.startswith("﻿"):
            pos = 1
        while pos < n:
            if start and not depth:
                m = re.compile(r"[ \t\f]*").match(text, pos)
                col = 0
                for ch in m[0]:
                    col = (col // 8 + 1) * 8 if ch == "\t" else 0 if ch == "\f" else col + 1
                pos = m.end()
                if pos >= n:
                    break
                if text[pos] in "#\r\n" or text.startswith("\\\n", pos):
                    start = False if text.startswith("\\\n", pos) else start
                    if text[pos] == "#":
                        e = re.compile(r"[^\r\n]*").match(text, pos).end()
                        pos = e
                    if pos < n and text[pos] in "\r\n":
                        pos += 2 if text.startswith("\r\n", pos) else 1
                        continue
                    if pos >= n:
                        break
                if col > indents[-1]:
                    indents.append(col)
                    if len(indents) > MOST_INDENTS:
                        self.bad(pos, "too many levels of indentation")
                    out.append(("INDENT", "", pos))
                while col < indents[-1]:
                    indents.pop()
                    out.append(("DEDENT", "", pos))
                    if col > indents[-1]:
                        self.bad(pos, "unindent does not match any outer level")
                        indents.append(col)
                        break
                start = False
            m = _TOKEN.match(text, pos)
            if not m:
                self.bad(pos, f"invalid character {text[pos]!r}")
                pos += 1
                continue
            kind, s = m.lastgroup, m[0]
            if kind == "nl":
                if not depth:
                    out.append(("NEWLINE", "", pos))
                    start = True
            elif kind == "str":
                end = self.string(pos, s)
                out.append(("STR", "f" if "f" in s.lower().rstrip("\"'") else "b" if "b" in s.lower().rstrip("\"'") else "s", pos))
                pos = end
                continue
            elif kind == "num":
                nxt = re.compile(r"[^\W\d]\w*").match(text, m.end())
                if nxt and nxt[0] not in ("and", "or", "in", "is", "if", "else", "for", "not") or re.fullmatch(r"0\d+", s) and s.strip("0"):
                    self.bad(pos, "invalid number")
                    if nxt:
                        pos = nxt.end()
                        out.append(("NUM", s, m.start()))
                        continue
                out.append(("NUM", s, pos))
            elif kind == "name":
                out.append(("KW" if s in KEYWORDS else "NAME", s, pos))
            elif kind == "op":
                if s in "([{":
                    depth.append((s, pos))
                    if len(depth) > MOST_BRACKETS:
                        self.bad(pos, "too many nested brackets")
                elif s in ")]}":
                    if not depth or "([{".index(depth[-1][0]) != ")]}".index(s):
                        self.bad(pos, f"unmatched {s!r}")
                        if depth:
                            depth.pop()
                    else:
                        depth.pop()
                out.append(("OP", s, pos))
            elif kind == "ws" and s[0] == "\\" and m.end() >= n:
                self.bad(pos, "unexpected end of file after a backslash")
            pos = m.end()
        if depth:
            self.bad(depth[-1][1], f"{depth[-1][0]!r} was never closed")
        if out and out[-1][0] != "NEWLINE":
            out.append(("NEWLINE", "", n))
        out += [("DEDENT", "", n)] * (len(indents) - 1)
        out.append(("END", "", n))

    def string(self, pos: int, opener: str) -> int:
        text = self.text
        quote = opener.lstrip("rbufRBUF")
        prefix = opener[: len(opener) - len(quote)].lower()
        i, n = pos + len(opener), len(text)
        fmt, raw = "f" in prefix, "r" in prefix
        while i < n:
            c = text[i]
            if c == "\\" and not (raw and fmt and False):
                i += 3 if text.startswith("\\\r\n", i) else 2
                continue
            if text.startswith(quote, i):
                return i + len(quote)
            if len(quote) == 1 and c in "\r\n":
                self.bad(pos, "unterminated string")
                return i
            if "b" in prefix and ord(c) > 127:
                self.bad(i, "bytes can only contain ASCII")
            if fmt and c == "{":
                if text.startswith("{{", i):
                    i += 2
                    continue
                i = self.field(i, quote)
                continue
            if fmt and c == "}":
                if text.startswith("}}", i):
                    i += 2
                    continue
                self.bad(i, "single '}' in f-string")
            i += 1
        self.bad(pos, "unterminated string")
        return n

    def field(self, pos: int, quote: str) -> int:
        """A replacement field of an f-string, from its brace to behind the closing one."""
        text, n, i, depth = self.text, len(self.text), pos + 1, []
        begin, code_end = i, None
        while i < n:
            c = text[i]
            m = re.compile(r"(?i)(?:[rbuf]|br|rb|fr|rf)?(?:\"\"\"|'''|\"|')").match(text, i)
            if m and (not text[i - 1].isalnum()):
                if text.startswith(quote, i) and len(quote) == 3 or len(quote) == 1 and not depth and text.startswith(quote, i) and code_end is not None:
                    break
                i = self.string(i, m[0])
                continue
            if len(quote) == 1 and c in "\r\n" and code_end is not None:
                break
            if c in "([{":
                depth.append(c)
            elif c in ")]}":
                if not depth:
                    if c != "}":
                        break
                    code_end = i if code_end is None else code_end
                    self.code(begin, code_end)
                    return i + 1
                depth.pop()
            elif not depth and c == "!" and text[i + 1 : i + 2] != "=" or not depth and c == ":":
                code_end = i
                if c == "!":
                    m = re.compile(r"!\s*[^\W\d]\w*\s*").match(text, i)
                    if not m or m[0].strip("! ") not in ("r", "s", "a"):
                        self.bad(i, "invalid conversion in f-string")
                    i = m.end() if m else i + 1
                    if text[i : i + 1] != ":":
                        continue
                i += 1
                while i < n and text[i] != "}":  # the format, which may hold fields of its own
                    if text.startswith(quote, i) or len(quote) == 1 and text[i] in "\r\n":
                        break
                    i = self.field(i, quote) if text[i] == "{" else i + 1
                continue
            i += 1
        self.bad(pos, "f-string: expecting '}'")
        return i

    def code(self, a: int, z: int):
        src = self.text[a:z]
        body = re.sub(r"(?<![=!<>])=\s*$", "", src)
        if not body.strip():
            self.bad(a, "f-string: empty expression")
            return
        sub = _Lexer("(" + body.replace("\n", " ") + ")")
        p = _Parser(sub)
        if sub.problems or not p.whole_expression():
            self.bad(a, "f-string: invalid expression")


class _Parser:
    def __init__(self, lexer: _Lexer):
        self.t, self.i, self.deep = lexer.tokens, 0, 0
        self.found: list[tuple[int, str]] = []

    # tokens
    @property
    def v(self) -> str:
        k, s, _ = self.t[self.i]
        return s if k in ("OP", "KW") else ""

    @property
    def kind(self) -> str:
        return self.t[self.i][0]

    def fail(self, msg: str = "invalid syntax"):
        raise Bad(self.t[self.i][2], msg)

    def eat(self, s: str) -> bool:
        if self.v == s:
            self.i += 1
            return True
        return False

    def need(self, s: str):
        if not self.eat(s):
            self.fail(f"expected {s!r}")

    def name(self):
        if self.kind != "NAME":
            self.fail("expected a name")
        self.i += 1

    def soft(self, word: str) -> bool:
        return self.kind == "NAME" and self.t[self.i][1] == word

    def whole_expression(self) -> bool:
        try:
            self.star_expressions()
            return self.kind in ("NEWLINE", "END")
        except Bad:
            return False

    # statements
    def file(self):
        while self.kind != "END":
            self.guarded()

    def guarded(self):
        start = self.i
        try:
            if self.kind == "INDENT":
                self.i += 1
                raise Bad(self.t[start][2], "unexpected indent")
            if self.kind == "DEDENT":
                self.i += 1
                return
            self.statement()
        except Bad as e:
            self.found.append((e.pos, e.message))
            while self.kind not in ("NEWLINE", "END"):
                self.i += 1
            if self.kind == "NEWLINE":
                self.i += 1
            if self.i == start:
                self.i += 1
            if self.kind == "INDENT":  # the body of the bad line is read as a block of its own
                self.i += 1
                self.body()

    def body(self):
        while self.kind not in ("DEDENT", "END"):
            self.guarded()
        if self.kind == "DEDENT":
            self.i += 1

    def block(self):
        self.need(":")
        if self.kind == "NEWLINE":
            self.i += 1
            if self.kind != "INDENT":
                self.fail("expected an indented block")
            self.i += 1
            self.deep += 1
            if self.deep > 99:
                self.fail("too many levels of indentation")
            self.body()
            self.deep -= 1
        else:
            self.simple_line()

    def statement(self):
        v = self.v
        f = {"if": self.if_, "while": self.while_, "for": self.for_, "try": self.try_, "with": self.with_, "def": self.def_, "class": self.class_}.get(v)
        if f:
            self.i += 1
            return f()
        if v == "@":
            while self.eat("@"):
                self.named()
                if self.kind != "NEWLINE":
                    self.fail()
                self.i += 1
            if self.eat("async"):
                self.need("def")
                return self.def_()
            if self.eat("def"):
                return self.def_()
            self.need("class")
            return self.class_()
        if v == "async":
            self.i += 1
            for w, g in (("def", self.def_), ("with", self.with_), ("for", self.for_)):
                if self.eat(w):
                    return g()
            self.fail()
        if self.soft("match") and self.match_():
            return None
        return self.simple_line()

    def simple_line(self):
        while True:
            self.simple()
            if not self.eat(";"):
                break
            if self.kind == "NEWLINE":
                break
        if self.kind != "NEWLINE":
            self.fail()
        self.i += 1

    def simple(self):
        v = self.v
        if v in ("pass", "break", "continue"):
            self.i += 1
        elif v == "return":
            self.i += 1
            if self.kind != "NEWLINE" and self.v != ";":
                self.star_expressions()
        elif v == "raise":
            self.i += 1
            if self.kind != "NEWLINE" and self.v != ";":
                self.expression()
                if self.eat("from"):
                    self.expression()
        elif v in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.eat(","):
                self.name()
        elif v == "del":
            self.i += 1
            self.targets()
        elif v == "assert":
            self.i += 1
            self.expression()
            if self.eat(","):
                self.expression()
        elif v == "import":
            self.i += 1
            self.dotted()
            while self.eat(","):
                self.dotted()
        elif v == "from":
            self.i += 1
            dots = 0
            while self.v in (".", "..."):
                self.i += 1
                dots += 1
            if not dots or self.kind == "NAME":
                self.dotted(alias=False)
            self.need("import")
            if self.eat("*"):
                return
            paren = self.eat("(")
            self.alias()
            while self.eat(","):
                if self.v == ")" and paren:
                    break
                self.alias()
            if paren:
                self.need(")")
        elif self.soft("type") and self.t[self.i + 1][0] == "NAME" and self.t[self.i + 2][1] in ("=", "["):
            self.i += 2
            self.type_params()
            self.need("=")
            self.expression()
        else:
            self.expression_statement()

    def alias(self):
        self.name()
        if self.eat("as"):
            self.name()

    def dotted(self, alias: bool = True):
        self.name()
        while self.eat("."):
            self.name()
        if alias and self.eat("as"):
            self.name()

    def expression_statement(self):
        kind = self.star_expressions()
        if self.v == ":" :
            if kind != "target" and kind != "paren":
                self.fail("only a single target can be annotated")
            self.i += 1
            self.expression()
            if self.eat("="):
                self.value()
            return
        if self.v in AUGMENTED:
            if kind not in ("target", "paren"):
                self.fail("illegal target of an augmented assignment")
            self.i += 1
            self.value()
            return
        while self.v == "=":
            if kind not in ("target", "paren", "targets"):
                self.fail("cannot assign to this expression")
            self.i += 1
            kind = self.value()

    def value(self):
        if self.v == "yield":
            return self.yield_()
        return self.star_expressions()

    def yield_(self):
        self.need("yield")
        if self.eat("from"):
            self.expression()
        elif self.kind not in ("NEWLINE", "END") and self.v not in (")", "]", "}", "=", ";"):
            self.star_expressions()
        return "yield"

    def if_(self):
        self.named()
        self.block()
        while self.eat("elif"):
            self.named()
            self.block()
        if self.eat("else"):
            self.block()

    def while_(self):
        self.named()
        self.block()
        if self.eat("else"):
            self.block()

    def for_(self):
        self.targets()
        self.need("in")
        self.star_expressions()
        self.block()
        if self.eat("else"):
            self.block()

    def try_(self):
        self.block()
        any_ = False
        while self.eat("except"):
            any_ = True
            self.eat("*")
            if self.v != ":":
                self.expression()
                if self.eat("as"):
                    self.name()
                elif self.v == ",":
                    self.fail("multiple exception types must be parenthesized")
            self.block()
        if any_ and self.eat("else"):
            self.block()
        if self.eat("finally"):
            self.block()
        elif not any_:
            self.fail("expected 'except' or 'finally' block")

    def with_(self):
        at = self.i
        if self.eat("("):
            try:  # items in parentheses
                while True:
                    self.expression()
                    if self.eat("as"):
                        self.target()
                    if not self.eat(",") or self.v == ")":
                        break
                self.need(")")
                if self.v == ":":
                    return self.block()
            except Bad:
                pass
            self.i = at
        while True:
            self.expression()
            if self.eat("as"):
                self.target()
            if not self.eat(","):
                break
        self.block()

    def type_params(self):
        if self.eat("["):
            while self.v != "]":
                if not self.eat("**"):
                    self.eat("*")
                self.name()
                if self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.star_or_expression()
                if not self.eat(","):
                    break
            self.need("]")

    def def_(self):
        self.name()
        self.type_params()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.eat("->"):
            self.expression()
        self.block()

    def parameters(self, end: str, typed: bool):
        default = star = slash = keyword = False
        while self.v != end:
            if self.eat("/"):
                if slash or star or keyword:
                    self.fail()
                slash = True
            elif self.eat("**"):
                self.name()
                if typed and self.eat(":"):
                    self.expression()
                keyword = True
            elif self.eat("*"):
                if star or keyword:
                    self.fail()
                star = True
                if self.v == ",":
                    if self.t[self.i + 1][1] in (end, "**"):
                        self.fail("named arguments must follow bare *")
                else:
                    self.name()
                    if typed and self.eat(":"):
                        self.star_or_expression()
            else:
                if keyword:
                    self.fail()
                self.name()
                if typed and self.eat(":"):
                    self.expression()
                if self.eat("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default follows parameter with a default")
            if not self.eat(","):
                break

    def class_(self):
        self.name()
        self.type_params()
        if self.eat("("):
            self.arguments()
        self.block()

    # match statement; `match` and `case` are names elsewhere
    def match_(self) -> bool:
        at = self.i
        self.i += 1
        try:
            if self.kind in ("NEWLINE", "END") or self.v in ("=", ".", ",", ")", ":") or self.v in AUGMENTED:
                raise Bad(0, "")
            self.star_expressions()
            if self.v != ":" or self.t[self.i + 1][0] != "NEWLINE" or self.t[self.i + 2][0] != "INDENT" or self.t[self.i + 3][1] != "case":
                raise Bad(0, "")
        except Bad:
            self.i = at
            return False
        self.i += 3
        while self.soft("case"):
            self.i += 1
            self.patterns()
            if self.eat("if"):
                self.named()
            self.block()
        if self.kind != "DEDENT":
            self.fail("expected 'case'")
        self.i += 1
        return True

    def patterns(self):
        while True:
            if self.eat("*"):
                self.name()
            else:
                self.pattern()
            if not self.eat(",") or self.v in (":", "if"):
                break

    def pattern(self):
        self.pattern_part()
        while self.eat("|"):
            self.pattern_part()
        if self.eat("as"):
            self.name()

    def pattern_part(self):
        if self.kind in ("NUM", "STR") or self.v == "-":
            self.eat("-")
            if self.kind == "STR":
                while self.kind == "STR":
                    self.i += 1
                return
            if self.kind != "NUM":
                self.fail()
            self.i += 1
            if self.v in ("+", "-"):
                self.i += 1
                self.i += 1
        elif self.v in ("None", "True", "False"):
            self.i += 1
        elif self.v in ("(", "["):
            end = ")" if self.v == "(" else "]"
            self.i += 1
            while self.v != end:
                if self.eat("*"):
                    self.name()
                else:
                    self.pattern()
                if not self.eat(","):
                    break
            self.need(end)
        elif self.eat("{"):
            while self.v != "}":
                if self.eat("**"):
                    self.name()
                else:
                    self.pattern_part()
                    self.need(":")
                    self.pattern()
                if not self.eat(","):
                    break
            self.need("}")
        else:
            self.name()
            while self.eat("."):
                self.name()
            if self.eat("("):
                while self.v != ")":
                    if self.kind == "NAME" and self.t[self.i + 1][1] == "=":
                        self.i += 2
                    self.pattern()
                    if not self.eat(","):
                        break
                self.need(")")

    # expressions; each gives `target`, `targets`, `paren` or what else it is
    def targets(self):
        n = self.target()
        while self.eat(","):
            if self.v in ("in", "=", ":", ")") or self.kind == "NEWLINE":
                break
            self.target()
        return n

    def target(self):
        self.eat("*")
        if self.binary(5) not in ("target", "paren", "targets"):
            self.fail("cannot assign to this expression")

    def star_or_expression(self):
        if self.eat("*"):
            self.binary(5)
            return "target"
        return self.named()

    def star_expressions(self):
        if self.v == "yield":
            return self.yield_()
        kind, many = self.star_or_expression(), False
        while self.v == ",":
            self.i += 1
            many = True
            if self.kind in ("NEWLINE", "END") or self.v in (")", "]", "}", "=", ":", ";"):
                break
            k = self.star_or_expression()
            if k not in ("target", "paren", "targets"):
                kind = k
        return ("targets" if kind in ("target", "paren", "targets") else "tuple") if many else kind

    def named(self):
        if self.kind == "NAME" and self.t[self.i + 1][1] == ":=" and self.t[self.i + 1][0] == "OP":
            self.i += 2
            self.expression()
            return "named"
        return self.expression()

    def expression(self):
        if self.v == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.need(":")
            self.expression()
            return "lambda"
        kind = self.or_()
        if self.eat("if"):
            self.or_()
            self.need("else")
            self.expression()
            return "if"
        return kind

    def or_(self):
        kind = self.not_()
        while self.v in ("or", "and"):
            self.i += 1
            self.not_()
            kind = "op"
        return kind

    def not_(self):
        if self.eat("not"):
            self.not_()
            return "op"
        kind = self.binary(5)
        while self.v in COMPARE:
            if self.eat("not"):
                self.need("in")
            elif self.eat("is"):
                self.eat("not")
            else:
                self.i += 1
            self.binary(5)
            kind = "op"
        return kind

    def binary(self, least: int):
        kind = self.unary()
        while (p := BINARY.get(self.v, 0)) >= least and self.kind == "OP":
            self.i += 1
            self.binary(p + 1)
            kind = "op"
        return kind

    def unary(self):
        if self.v in ("+", "-", "~"):
            self.i += 1
            self.deep += 1
            if self.deep > 400:
                self.fail("too deep")
            self.unary()
            self.deep -= 1
            return "op"
        awaited = self.eat("await")
        kind = self.primary()
        if self.eat("**"):
            self.unary()
            return "op"
        return "op" if awaited else kind

    def primary(self):
        kind = self.atom()
        while True:
            if self.eat("."):
                self.name()
                kind = "target"
            elif self.eat("("):
                self.arguments()
                kind = "call"
            elif self.eat("["):
                self.slices()
                kind = "target"
            else:
                return kind

    def slices(self):
        if self.v == "]":
            self.fail()
        while self.v != "]":
            if self.v == "*":
                self.star_or_expression()
            else:
                if self.v != ":":
                    self.named()
                if self.eat(":"):
                    if self.v not in ("]", ",", ":"):
                        self.expression()
                    if self.eat(":") and self.v not in ("]", ","):
                        self.expression()
            if not self.eat(","):
                break
        self.need("]")

    def arguments(self):
        keyword = False
        while self.v != ")":
            if self.v in ("*", "**"):
                keyword = keyword or self.v == "**"
                self.i += 1
                self.expression()
            elif self.kind == "NAME" and self.t[self.i + 1][:2] == ("OP", "="):
                self.i += 2
                self.expression()
                keyword = True
            else:
                self.named()
                if self.v in ("for", "async"):
                    self.comprehension()
                elif keyword and self.v != "=":
                    self.fail("positional argument follows keyword argument")
            if not self.eat(","):
                break
        self.need(")")

    def comprehension(self):
        while True:
            self.eat("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.or_()
            while self.eat("if"):
                if self.kind == "NAME" and self.t[self.i + 1][1] == ":=":
                    self.named()
                else:
                    self.or_()
            if self.v not in ("for", "async"):
                return

    def atom(self):
        k, s, _ = self.t[self.i]
        if k == "NAME":
            self.i += 1
            return "target"
        if k == "NUM" or k == "KW" and s in ("None", "True", "False") or s == "..." and k == "OP":
            self.i += 1
            return "literal"
        if k == "STR":
            byte = s == "b"
            while self.kind == "STR":
                if (self.t[self.i][1] == "b") != byte:
                    self.fail("cannot mix bytes and nonbytes literals")
                self.i += 1
            return "literal"
        if k == "OP" and s in "([{":
            self.deep += 1
            if self.deep > 400:
                self.fail("too deep")
            self.i += 1
            kind = {"(": self.group, "[": self.list_, "{": self.dict_}[s]()
            self.deep -= 1
            return kind
        self.fail()

    def group(self):
        if self.eat(")"):
            return "targets"
        if self.v == "yield":
            self.yield_()
            self.need(")")
            return "yield"
        star = self.v == "*"
        kind = self.star_or_expression()
        if self.v in ("for", "async"):
            self.comprehension()
            kind = "generator"
        elif self.v == ",":
            ok = kind in ("target", "paren", "targets")
            while self.eat(","):
                if self.v == ")":
                    break
                ok = self.star_or_expression() in ("target", "paren", "targets") and ok
            kind = "targets" if ok else "tuple"
        elif star:
            self.fail("cannot use starred expression here")
        self.need(")")
        return "paren" if kind == "target" else kind

    def list_(self):
        ok, first = True, True
        while self.v != "]":
            k = self.star_or_expression()
            ok = ok and k in ("target", "paren", "targets")
            if first and self.v in ("for", "async"):
                self.comprehension()
                ok = False
                break
            first = False
            if not self.eat(","):
                break
        self.need("]")
        return "targets" if ok else "list"

    def dict_(self):
        mode, first = None, True
        while self.v != "}":
            if self.eat("**"):
                self.binary(5)
                kind = "dict"
            elif self.v == "*":
                self.star_or_expression()
                kind = "set"
            else:
                self.named()
                kind = "set"
                if self.eat(":"):
                    self.expression()
                    kind = "dict"
            if mode and kind != mode:
                self.fail()
            mode = kind
            if first and self.v in ("for", "async"):
                self.comprehension()
                break
            first = False
            if not self.eat(","):
                break
        self.need("}")
        return "dict"


def problems(text: str) -> list[Problem]:
    lexer = _Lexer(text)
    parser = _Parser(lexer)
    try:
        parser.file()
    except RecursionError:
        parser.found.append((0, "too deep"))
    if "\0" in text:
        parser.found.append((text.index("\0"), "null bytes"))
    found = sorted({*lexer.problems, *parser.found})
    return at_lines(text, found)
