"""A TypeScript reader: source text to a tree of nodes.

Covers the language that the rules look at: modules, declarations, statements,
expressions, JSX and types.  Whatever it cannot read raises ``SyntaxFailure`` with a
place; callers turn that into a row of ``parse_failures``.  Offsets count
characters here; the extractor converts them to bytes.
"""

from __future__ import annotations

import re

_ID = r"[^\W\d]|\$"
TOKEN = re.compile(
    r"""(?P<ws>[\s\ufeff]+|//[^\n]*|/\*.*?\*/)
  |(?P<num>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)
  |(?P<id>\#?(?:[^\W\d]|\$)(?:\w|\$)*)
  |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<punct>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.X | re.S,
)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
JSX_NAME = re.compile(r"(?:[^\W\d]|\$)[\w$.:-]*")
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "in": 8, "instanceof": 8, "as": 8, "satisfies": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
KEYWORD_TYPES = {"any", "unknown", "never", "void", "null", "undefined", "string", "number", "boolean", "bigint", "symbol", "object", "this"}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor", "get", "set"}
LOOPS = ("for", "for_in", "for_of", "while", "do")
FUNCTIONS = ("function", "function_expr", "arrow", "method", "object_method", "getter", "setter", "constructor")


class SyntaxFailure(Exception):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


class Node:
    __slots__ = ("kind", "start", "end", "name", "attrs", "children")

    def __init__(self, kind, start, end=-1, name=None, children=None, **attrs):
        self.kind, self.start, self.end, self.name, self.attrs = kind, start, end, name, attrs
        self.children = [c for c in children or () if c is not None]


class Parser:
    def __init__(self, text: str, jsx: bool):
        self.text, self.jsx = text, jsx
        self.comments: dict[int, int] = {}
        self.pos = self.last_end = self.objects = 0
        self.advance()

    # -- tokens
    def scan(self, at: int):
        newline = False
        while True:
            if at >= len(self.text):
                return "eof", "", at, at, newline
            if at == 0 and self.text.startswith("#!"):
                at = self.text.find("\n") if "\n" in self.text else len(self.text)
                continue
            if self.text[at] == "`":
                return "tmpl", "`", at, at + 1, newline
            m = TOKEN.match(self.text, at)
            if not m:
                raise SyntaxFailure(f"unexpected character {self.text[at]!r}", at)
            if m.lastgroup != "ws":
                return m.lastgroup, m[0], m.start(), m.end(), newline
            if m[0][0] == "/":
                self.comments[m.start()] = m.end()
            newline |= "\n" in m[0]
            at = m.end()

    def advance(self):
        self.kind, self.value, self.start, self.end, self.newline = self.scan(self.pos)
        self.pos = self.end

    def next(self):
        self.last_end = self.end
        value = self.value
        self.advance()
        return value

    def mark(self):
        return self.pos, self.last_end, self.kind, self.value, self.start, self.end, self.newline

    def reset(self, m):
        self.pos, self.last_end, self.kind, self.value, self.start, self.end, self.newline = m

    def at(self, *values):
        return self.kind in ("punct", "id") and self.value in values

    def eat(self, value):
        if self.at(value):
            self.next()
            return True
        if value == ">" and self.kind == "punct" and self.value[0] == ">" and len(self.value) > 1:  # split >> in types
            self.last_end = self.start + 1
            self.pos = self.start + 1
            self.advance()
            return True
        return False

    def need(self, value):
        if not self.eat(value):
            self.fail(f"expected {value!r}")

    def fail(self, message):
        raise SyntaxFailure(f"{message}, found {self.value or 'the end'!r}", self.start)

    def done(self, node):
        node.end = self.last_end
        return node

    def attempt(self, fn):
        m = self.mark()
        try:
            return fn()
        except SyntaxFailure:
            self.reset(m)
            return None

    def peek(self):
        return self.scan(self.pos)

    def semicolon(self):
        if not self.eat(";") and not self.at("}") and self.kind != "eof" and not self.newline:
            self.fail("expected ';'")

    # -- statements
    def program(self):
        root = Node("program", 0, len(self.text))
        while self.kind != "eof":
            root.children.append(self.statement())
        return root

    def block(self):
        n = Node("block", self.start)
        self.need("{")
        while not self.at("}"):
            if self.kind == "eof":
                self.fail("expected '}'")
            n.children.append(self.statement())
        self.next()
        return self.done(n)

    def statement(self):
        v, start = self.value, self.start
        if self.kind == "punct":
            if v == "{":
                return self.block()
            if v == ";":
                self.next()
                return self.done(Node("empty", start))
            if v == "@":
                self.decorators()
                return self.statement()
        elif self.kind == "id":
            method = getattr(self, f"s_{v}", None)
            if method and not (self.peek()[1] in ("=", ".", ":", ",", ")", "?.") and v in SOFT):
                found = method(start)
                if found is not None:
                    return found
            nxt = self.peek()
            if nxt[1] == ":" and nxt[0] == "punct":
                name = self.next()
                self.next()
                return self.done(Node("label", start, name=name, children=[self.statement()]))
        e = self.expression()
        self.semicolon()
        return self.done(Node("expression_statement", start, children=[e]))

    def decorators(self):
        while self.eat("@"):
            self.postfix(self.primary(), True)

    def paren(self):
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def s_if(self, start):
        self.next()
        c = [self.paren(), self.statement()]
        if self.eat("else"):
            c.append(self.statement())
        return self.done(Node("if", start, children=c))

    def s_while(self, start):
        self.next()
        return self.done(Node("while", start, children=[self.paren(), self.statement()]))

    def s_do(self, start):
        self.next()
        body = self.statement()
        self.need("while")
        c = self.paren()
        self.eat(";")
        return self.done(Node("do", start, children=[body, c]))

    def s_for(self, start):
        self.next()
        waits = self.eat("await")
        self.need("(")
        init = None
        if self.at("var", "let", "const"):
            init = self.variables(self.start, in_for=True)
        elif not self.at(";"):
            init = self.expression(no_in=True)
        if self.at("of", "in"):
            kind = "for_" + self.next()
            c = [init, self.expression()]
            self.need(")")
            return self.done(Node("for_await" if waits else kind, start, children=[*c, self.statement()]))
        self.need(";")
        test = None if self.at(";") else self.expression()
        self.need(";")
        step = None if self.at(")") else self.expression()
        self.need(")")
        return self.done(Node("for", start, children=[init, test, step, self.statement()]))

    def s_switch(self, start):
        self.next()
        n = Node("switch", start, children=[self.paren()])
        self.need("{")
        while not self.eat("}"):
            case = Node("case", self.start)
            if not self.eat("default"):
                self.need("case")
                case.children.append(self.expression())
            self.need(":")
            while not self.at("case", "default", "}"):
                case.children.append(self.statement())
            n.children.append(self.done(case))
        return self.done(n)

    def s_try(self, start):
        self.next()
        n = Node("try", start, children=[self.block()])
        if self.at("catch"):
            c = Node("catch", self.start)
            self.next()
            if self.eat("("):
                c.children.append(self.binding("catch_param"))
                self.need(")")
            c.children.append(self.block())
            n.children.append(self.done(c))
        if self.eat("finally"):
            n.children.append(self.done(Node("finally", self.last_end - 7, children=[self.block()])))
        return self.done(n)

    def s_return(self, start):
        self.next()
        e = None if self.newline or self.at(";", "}") or self.kind == "eof" else self.expression()
        self.semicolon()
        return self.done(Node("return", start, children=[e], valued=e is not None))

    def s_throw(self, start):
        self.next()
        e = self.expression()
        self.semicolon()
        return self.done(Node("throw", start, children=[e]))

    def s_break(self, start):
        kind = self.next()
        if self.kind == "id" and not self.newline:
            self.next()
        self.semicolon()
        return self.done(Node(kind, start))

    s_continue = s_break

    def s_debugger(self, start):
        self.next()
        self.semicolon()
        return self.done(Node("debugger", start))

    def s_var(self, start):
        n = self.variables(start)
        self.semicolon()
        return self.done(n)

    def s_let(self, start):
        nxt = self.peek()
        return self.s_var(start) if nxt[0] == "id" or nxt[1] in "{[" and nxt[1] else None

    def s_const(self, start):
        if self.peek()[1] == "enum":
            self.next()
            return self.s_enum(start)
        return self.s_var(start)

    def variables(self, start, in_for=False):
        kind = self.next()
        n = Node("variables", start, decl=kind)
        while True:
            d = Node("declarator", self.start, decl=kind)
            target = self.binding("binding")
            d.name = target.name
            d.children.append(target)
            d.attrs["type"] = target.attrs.get("type", "")
            if self.eat("="):
                init = self.assignment(no_in=in_for)
                d.children.append(init)
                d.attrs |= {"init": init.kind, "init_value": init.name or ""}
            n.children.append(self.done(d))
            if not self.eat(","):
                return self.done(n)

    def binding(self, role):
        start = self.start
        if self.at("{", "["):
            close = {"{": "}", "[": "]"}[self.next()]
            n = Node("pattern", start)
            self.objects += close == "}"
            while not self.eat(close):
                if self.eat(","):
                    continue
                if self.eat("..."):
                    n.children.append(self.binding(role))
                elif close == "]":
                    n.children.append(self.default(self.binding(role)))
                else:
                    at = self.start
                    if self.at("["):
                        self.next()
                        key = self.assignment()
                        self.need("]")
                        n.children.append(key)
                        self.need(":")
                        n.children.append(self.default(self.binding(role)))
                    else:
                        name = self.next()
                        if self.eat(":"):
                            n.children.append(self.default(self.binding(role)))
                        else:
                            n.children.append(self.default(Node(role, at, self.last_end, name=name, key=name, in_object=True)))
            self.objects -= close == "}"
        else:
            if self.kind != "id":
                self.fail("expected a name")
            n = Node(role, start, self.end, name=self.value)
            if self.objects:
                n.attrs["in_object"] = True
            self.next()
        if role == "binding":
            self.eat("!")
        if role == "param":
            self.eat("?")
        if self.eat(":"):
            t = self.type_()
            n.attrs["type"] = self.text[t.start : t.end]
            n.attrs["type_kind"] = t.kind
            n.attrs["type_name"] = t.name or ""
            n.children.append(t)
        return self.done(n) if n.kind == "pattern" or n.children else n

    def default(self, target):
        if self.eat("="):
            target.children.append(self.assignment())
        return target

    def s_function(self, start):
        return self.function(start, "function")

    def s_async(self, start):
        if self.peek()[1] != "function" or self.peek()[4]:
            return None
        self.next()
        return self.function(start, "function")

    def function(self, start, kind):
        self.need("function")
        self.eat("*")
        n = Node(kind, start)
        if self.kind == "id":
            n.name, n.attrs["name_start"] = self.value, self.start
            self.next()
        self.signature(n)
        if self.at("{"):
            n.children.append(self.block())
        else:
            self.semicolon()
            n.attrs["overload"] = True
        return self.done(n)

    def signature(self, n, arrow=False):
        if self.at("<"):
            n.children.append(self.type_params())
        self.need("(")
        count = 0
        while not self.eat(")"):
            self.decorators()
            while self.kind == "id" and self.value in MODIFIERS and self.peek()[0] == "id":
                self.next()
            rest = self.eat("...")
            p = self.default(self.binding("param"))
            p.attrs["rest"] = rest
            count += not rest and p.name != "this"
            n.children.append(p)
            if not self.eat(","):
                self.need(")")
                break
        n.attrs["n_params"] = count
        if self.at(":"):
            self.next()
            n.attrs["return_type"] = True
            n.children.append(self.return_type())

    def return_type(self):
        start = self.start
        if self.at("asserts") and self.peek()[0] == "id":
            self.next()
        if self.kind == "id" and self.peek()[1] == "is":
            self.next()
            self.next()
            return self.done(Node("t_predicate", start, children=[self.type_()]))
        return self.type_()

    def s_abstract(self, start):
        if self.peek()[1] != "class":
            return None
        self.next()
        return self.s_class(start)

    def s_class(self, start):
        return self.class_(start, "class")

    def class_(self, start, kind):
        self.need("class")
        n = Node(kind, start)
        if self.kind == "id" and not self.at("extends", "implements"):
            n.name = self.next()
        if self.at("<"):
            n.children.append(self.type_params())
        if self.eat("extends"):
            n.children.append(self.postfix(self.primary(), True))
            if self.at("<"):
                n.children += self.type_args()
        if self.eat("implements"):
            n.children.append(self.type_())
            while self.eat(","):
                n.children.append(self.type_())
        self.need("{")
        while not self.eat("}"):
            if not self.eat(";"):
                n.children.append(self.member())
        return self.done(n)

    def member(self):
        start = self.start
        self.decorators()
        kind, readonly = "property", False
        if self.at("static") and self.peek()[1] == "{":
            self.next()
            return self.done(Node("static_block", start, children=[self.block()]))
        while self.kind == "id" and self.value in MODIFIERS and self.peek()[1] not in ("(", "=", ";", ":", "?", "!", "}", "<", ","):
            m = self.next()
            readonly |= m == "readonly"
            kind = {"get": "getter", "set": "setter"}.get(m, kind)
        star = self.eat("*")
        if self.at("[") and self.peek()[0] == "id" and self.scan(self.peek()[3])[1] == ":":
            return self.index_signature(start)
        n = Node(kind, start)
        self.property_name(n)
        self.eat("?") or self.eat("!")
        if self.at("(", "<") or star:
            n.kind = kind if kind != "property" else "constructor" if n.name == "constructor" else "method"
            self.signature(n)
            if self.at("{"):
                n.children.append(self.block())
            else:
                self.semicolon()
            return self.done(n)
        n.attrs["readonly"] = readonly
        if self.eat(":"):
            n.children.append(self.type_())
        if self.eat("="):
            n.children.append(self.assignment())
        self.semicolon()
        return self.done(n)

    def property_name(self, n):
        n.attrs["name_start"] = self.start
        if self.eat("["):
            n.children.append(self.assignment())
            self.need("]")
            n.attrs["computed"] = True
        elif self.kind in ("id", "str", "num"):
            n.name = self.next()
        else:
            self.fail("expected a property name")

    def index_signature(self, start):
        self.need("[")
        self.next()
        self.need(":")
        c = [self.type_()]
        self.need("]")
        if self.eat(":"):
            c.append(self.type_())
        self.eat(";") or self.eat(",")
        return self.done(Node("t_index", start, children=c))

    def s_interface(self, start):
        if self.peek()[0] != "id":
            return None
        self.next()
        n = Node("interface", start, name_start=self.start, name=self.next())
        if self.at("<"):
            n.children.append(self.type_params())
        if self.eat("extends"):
            n.attrs["extends"] = True
            n.children.append(self.type_())
            while self.eat(","):
                n.children.append(self.type_())
        body = self.object_type()
        n.attrs["empty"] = not body.children
        n.children.append(body)
        return self.done(n)

    def s_type(self, start):
        if self.peek()[0] != "id":
            return None
        self.next()
        n = Node("type_alias", start, name_start=self.start, name=self.next())
        if self.at("<"):
            n.children.append(self.type_params())
        self.need("=")
        n.children.append(self.type_())
        self.semicolon()
        return self.done(n)

    def s_enum(self, start):
        self.need("enum")
        n = Node("enum", start, name=self.next())
        self.need("{")
        while not self.eat("}"):
            m = Node("enum_member", self.start)
            self.property_name(m)
            if self.eat("="):
                m.children.append(self.assignment())
            n.children.append(self.done(m))
            if not self.eat(","):
                self.need("}")
                break
        return self.done(n)

    def s_namespace(self, start):
        if self.peek()[0] not in ("id", "str"):
            return None
        word = self.next()
        name = self.next()
        while self.eat("."):
            name += "." + self.next()
        n = Node("namespace", start, name=name, word=word)
        if self.at("{"):
            n.children.append(self.block())
        else:
            self.semicolon()
        return self.done(n)

    s_module = s_namespace

    def s_declare(self, start):
        if self.peek()[0] != "id":
            return None
        self.next()
        if self.at("global"):
            self.next()
            return self.done(Node("namespace", start, name="global", word="global", children=[self.block()]))
        n = self.statement()
        n.start = start
        n.attrs["declare"] = True
        return n

    def module_names(self):
        """``{ a, type b as c }`` as (imported, local, type only) triples."""
        names = []
        self.need("{")
        while not self.eat("}"):
            at = self.start
            only = self.at("type") and self.peek()[0] in ("id", "str") and not (self.peek()[1] == "as" and self.scan(self.peek()[3])[1] != "as")
            if only:
                self.next()
            a = b = self.next()
            if self.eat("as"):
                b = self.next()
            names.append((a.strip("'\""), b.strip("'\""), only, at, self.last_end))
            if not self.eat(","):
                self.need("}")
                break
        return names

    def source(self):
        if self.kind != "str":
            self.fail("expected a module name")
        s = self.next()[1:-1]
        if self.at("with", "assert") and self.peek()[1] == "{":
            self.next()
            self.object_()
        return s

    def s_import(self, start):
        if self.peek()[1] in ("(", "."):
            return None
        self.next()
        n = Node("import", start, type_only=False, names="", side_effect=False)
        if self.kind == "str":
            n.attrs["side_effect"] = True
            n.name = self.source()
            self.semicolon()
            return self.done(n)
        if self.at("type") and (self.peek()[1] in "{*" or self.peek()[0] == "id" and self.peek()[1] != "from"):
            n.attrs["type_only"] = True
            self.next()
        names, local = [], []
        if self.kind == "id":
            local.append((self.value, self.start, self.end))
            names.append("default")
            self.next()
            if self.eat("="):
                n.children.append(self.expression())
                self.semicolon()
                n.kind = "import_equals"
                return self.done(n)
            self.eat(",")
        if self.eat("*"):
            self.need("as")
            local.append((self.value, self.start, self.end))
            self.next()
            names.append("*")
        elif self.at("{"):
            for a, b, _, s, e in self.module_names():
                names.append(a)
                local.append((b, e - len(b), e))
        self.need("from")
        n.name = self.source()
        n.attrs["names"] = ",".join(names)
        n.children += [Node("import_name", s, e, name=x) for x, s, e in local]
        self.semicolon()
        return self.done(n)

    def s_export(self, start):
        self.next()
        if self.eat("default"):
            n = Node("export_default", start)
            at = self.start
            if self.at("function") or self.at("async") and self.peek()[1] == "function":
                self.eat("async")
                d = self.function(at, "function")
            elif self.at("class", "abstract", "@"):
                self.decorators()
                self.eat("abstract")
                d = self.class_(at, "class")
            elif self.at("interface") and self.peek()[0] == "id":
                d = self.s_interface(at)
            else:
                d = self.assignment()
                self.semicolon()
            n.children, n.name, n.attrs["what"] = [d], d.name, d.kind
            return self.done(n)
        if self.eat("="):
            n = Node("export_equals", start, children=[self.expression()])
            self.semicolon()
            return self.done(n)
        only = self.at("type") and self.peek()[1] in ("{", "*") and self.peek()[1] != ""
        if only:
            self.next()
        if self.eat("*"):
            alias = self.next() if self.eat("as") else None
            self.need("from")
            n = Node("export_all", start, name=self.source(), alias=alias or "", type_only=only)
            self.semicolon()
            return self.done(n)
        if self.at("{"):
            names = self.module_names()
            n = Node("export_names", start, names=",".join(a for a, *_ in names), exported=",".join(b for _, b, *_ in names), weight=len(names), type_only=only, source="")
            if self.eat("from"):
                n.attrs["source"] = n.name = self.source()
                n.kind = "export_from"
            self.semicolon()
            return self.done(n)
        d = self.statement()
        n = Node("export", start, children=[d], what=d.kind, name=d.name)
        n.attrs["weight"] = len(d.children) if d.kind == "variables" else 1
        if d.kind == "variables":
            n.attrs["decl"], n.name = d.attrs["decl"], d.children[0].name
        return self.done(n)

    # -- expressions
    def expression(self, no_in=False):
        e = self.assignment(no_in)
        if self.at(","):
            e = Node("sequence", e.start, children=[e])
            while self.eat(","):
                e.children.append(self.assignment(no_in))
            self.done(e)
        return e

    def assignment(self, no_in=False):
        start = self.start
        if self.at("yield"):
            self.next()
            star = self.eat("*")
            e = None if not star and (self.newline or self.at(")", "]", "}", ",", ";")) else self.assignment(no_in)
            return self.done(Node("yield", start, children=[e]))
        if self.at("(", "<") or self.kind == "id":
            a = self.arrow(start)
            if a:
                return a
        left = self.conditional(no_in)
        if self.kind == "punct" and self.value in ASSIGN:
            op = self.next()
            return self.done(Node("assign", start, children=[left, self.assignment(no_in)], op=op))
        return left

    def arrow(self, start):
        if self.kind == "id" and not self.at("async"):
            if self.peek()[1] != "=>":
                return None
            n = Node("arrow", start, n_params=1, children=[Node("param", self.start, self.end, name=self.value, rest=False)])
            self.next()
            return self.arrow_body(n)

        def head():
            n = Node("arrow", start)
            if self.at("async"):
                self.next()
                if self.newline:
                    self.fail("no arrow")
                if self.kind == "id":
                    n.attrs["n_params"] = 1
                    n.children.append(Node("param", self.start, self.end, name=self.next(), rest=False))
                    if not self.at("=>"):
                        self.fail("no arrow")
                    return n
            self.signature(n)
            if not self.at("=>"):
                self.fail("no arrow")
            return n

        if self.at("(") and not self.might_be_arrow():
            return None
        n = self.attempt(head)
        return self.arrow_body(n) if n else None

    def might_be_arrow(self):
        """Whether ``=>`` or ``:`` follows the bracket that closes this one."""
        at, depth_ = self.start, 0
        while True:
            try:
                kind, value, _, end, _ = self.scan(at)
            except SyntaxFailure:
                return True
            if kind == "eof":
                return False
            if kind == "tmpl":
                return True
            if kind == "punct" and value in ("(", "[", "{"):
                depth_ += 1
            elif kind == "punct" and value in (")", "]", "}"):
                depth_ -= 1
                if not depth_:
                    return self.scan(end)[1] in ("=>", ":")
            at = end

    def arrow_body(self, n):
        self.need("=>")
        if self.at("{"):
            n.children.append(self.block())
        else:
            n.attrs["expression_body"] = True
            n.children.append(self.assignment())
        return self.done(n)

    def conditional(self, no_in):
        start = self.start
        e = self.binary(0, no_in)
        if self.at("?"):
            self.next()
            a = self.assignment()
            self.need(":")
            return self.done(Node("conditional", start, children=[e, a, self.assignment(no_in)]))
        return e

    def operator(self):
        if self.value == ">" and self.kind == "punct":  # longer shifts are scanned as one unless split
            return ">"
        return self.value

    def binary(self, least, no_in):
        start = self.start
        left = self.unary()
        while self.kind in ("punct", "id"):
            op = self.value
            power = BINARY.get(op)
            if power is None or power <= least or op == "in" and no_in or op in ("as", "satisfies") and self.newline:
                break
            if op == ">" and self.text.startswith(">=", self.start) is False and self.text.startswith(">>", self.start):
                op = ">>>" if self.text.startswith(">>>", self.start) else ">>"
                self.pos = self.start + len(op)
                self.end = self.pos
                self.value = op
                power = 9
                if power <= least:
                    break
            self.next()
            if op in ("as", "satisfies"):
                if op == "as" and self.at("const"):
                    t = Node("t_const", self.start, self.end, name="const")
                    self.next()
                else:
                    t = self.type_()
                left = self.done(Node(op, start, children=[left, t], expr=left.kind, type=t.kind, type_name=t.name or ""))
            else:
                left = self.done(Node("binary", start, children=[left, self.binary(power - (op == "**"), no_in)], op=op))
        return left

    def unary(self):
        start = self.start
        if self.at("!", "~", "+", "-", "typeof", "void", "delete"):
            op = self.next()
            return self.done(Node("unary", start, children=[self.unary()], op=op))
        if self.at("++", "--"):
            op = self.next()
            return self.done(Node("update", start, children=[self.unary()], op=op))
        if self.at("await") and self.peek()[1] not in (")", ",", ";", "=", ".", "=>"):
            self.next()
            return self.done(Node("await", start, children=[self.unary()]))
        if self.at("<"):
            if self.jsx:
                return self.postfix(self.jsx_element(), True)
            self.next()
            t = self.type_()
            self.need(">")
            return self.done(Node("angle_assertion", start, children=[t, self.unary()]))
        e = self.postfix(self.primary(), True)
        if self.at("++", "--") and not self.newline:
            e = Node("update", start, children=[e], op=self.next())
            self.done(e)
        return e

    def postfix(self, e, calls):
        while True:
            start = e.start
            if self.at("."):
                self.next()
                name = self.next()
                e = self.done(Node("member", start, name=name, children=[e], prop_start=self.last_end - len(name)))
            elif self.at("?."):
                self.next()
                if self.at("("):
                    e = self.done(Node("call", start, children=[e, *self.arguments()], optional=True))
                elif self.eat("["):
                    c = self.expression()
                    self.need("]")
                    e = self.done(Node("index", start, children=[e, c], optional=True))
                else:
                    name = self.next()
                    e = self.done(Node("member", start, name=name, children=[e], optional=True, prop_start=self.last_end - len(name)))
            elif self.at("["):
                self.next()
                c = self.expression()
                self.need("]")
                e = self.done(Node("index", start, children=[e, c]))
            elif self.at("!") and not self.newline and self.peek()[1] not in ("=",):
                self.next()
                e = self.done(Node("non_null", start, children=[e]))
            elif self.at("(") and calls:
                e = self.done(Node("call", start, children=[e, *self.arguments()]))
            elif self.kind == "tmpl":
                e = self.done(Node("tagged", start, children=[e, self.template()]))
            elif self.at("<", "<<") and calls:
                args = self.attempt(self.call_types)
                if args is None:
                    return e
                if self.at("("):
                    e = self.done(Node("call", start, children=[e, *args, *self.arguments()], n_types=len(args)))
                else:
                    e = self.done(Node("instantiation", start, children=[e, *args]))
            else:
                return e

    def call_types(self):
        args = self.type_args()
        if self.kind in ("id", "num", "str") and not self.newline or not self.at("(") and self.kind == "punct" and self.value in ("<", "-", "+", "[", "{"):
            self.fail("no type arguments")
        return args

    def arguments(self):
        self.need("(")
        out = []
        while not self.eat(")"):
            out.append(self.spread())
            if not self.eat(","):
                self.need(")")
                break
        return out

    def spread(self):
        start = self.start
        if self.eat("..."):
            return self.done(Node("spread", start, children=[self.assignment()]))
        return self.assignment()

    def primary(self):
        kind, v, start = self.kind, self.value, self.start
        if kind == "num":
            self.next()
            return Node("number", start, self.last_end, name=v)
        if kind == "str":
            self.next()
            return Node("string", start, self.last_end, name=v[1:-1])
        if kind == "tmpl":
            return self.template()
        if kind == "id":
            if v == "function" or v == "async" and self.peek()[1] == "function" and not self.peek()[4]:
                self.eat("async")
                return self.function(start, "function_expr")
            if v == "class":
                return self.class_(start, "class_expr")
            if v == "new":
                return self.new(start)
            if v in ("true", "false"):
                self.next()
                return Node("boolean", start, self.last_end, name=v)
            if v == "null":
                self.next()
                return Node("null", start, self.last_end, name=v)
            if v == "import":
                self.next()
                if self.at("("):
                    args = self.arguments()
                    src = args[0].name if args and args[0].kind == "string" else ""
                    return self.done(Node("dynamic_import", start, name=src, children=args))
                self.need(".")
                return self.done(Node("meta", start, name=self.next()))
            self.next()
            return Node("id", start, self.last_end, name=v)
        if v == "(":
            self.next()
            e = self.expression()
            self.need(")")
            return self.done(Node("paren", start, children=[e]))
        if v == "[":
            self.next()
            n = Node("array", start)
            while not self.eat("]"):
                if self.eat(","):
                    continue
                n.children.append(self.spread())
                if not self.at("]"):
                    self.need(",")
            return self.done(n)
        if v == "{":
            return self.object_()
        if v in ("/", "/="):
            m = REGEX.match(self.text, start)
            if m:
                self.end = self.pos = m.end()
                self.next()
                return Node("regex", start, m.end())
        if v == "<" and self.jsx:
            return self.jsx_element()
        if v == "@":
            self.decorators()
            return self.primary()
        self.fail("expected an expression")

    def new(self, start):
        self.next()
        if self.eat("."):
            self.next()
            return self.done(Node("meta", start, name="new.target"))
        callee = self.new(self.start) if self.at("new") else self.postfix(self.primary(), False)
        types = (self.attempt(self.type_args) or []) if self.at("<") else []
        args = self.arguments() if self.at("(") else []
        return self.done(Node("new", start, name=callee.name if callee.kind == "id" else None, children=[callee, *types, *args]))

    def template(self):
        n, at = Node("template", self.start), self.start + 1
        while True:
            if at >= len(self.text):
                raise SyntaxFailure("unterminated template", n.start)
            c = self.text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                self.pos = at + 1
                self.last_end = at + 1
                self.advance()
                return self.done(n)
            elif self.text.startswith("${", at):
                self.pos = at + 2
                self.advance()
                n.children.append(self.expression())
                if not self.at("}"):
                    self.fail("expected '}'")
                at = self.end
            else:
                at += 1

    def object_(self):
        n = Node("object", self.start)
        self.need("{")
        while not self.eat("}"):
            start = self.start
            if self.eat("..."):
                n.children.append(self.done(Node("spread", start, children=[self.assignment()])))
            else:
                kind = "property"
                while self.at("async", "get", "set") and self.peek()[1] not in ("(", ":", ",", "}", "=", "<"):
                    kind = {"get": "getter", "set": "setter"}.get(self.next(), kind)
                star = self.eat("*")
                p = Node(kind, start)
                short = self.kind == "id"
                self.property_name(p)
                if self.at("(", "<") or star:
                    p.kind = kind if kind != "property" else "object_method"
                    self.signature(p)
                    p.children.append(self.block())
                elif self.eat(":"):
                    p.children.append(self.assignment())
                elif short and self.eat("="):
                    p.children.append(self.assignment())
                elif short:
                    p.attrs["short"] = True
                else:
                    self.fail("expected ':'")
                n.children.append(self.done(p))
            if not self.eat(","):
                self.need("}")
                break
        return self.done(n)

    # -- JSX
    def jsx_element(self):
        n = Node("jsx", self.start)
        self.need("<")
        if self.at(">"):
            at = self.end
        else:
            m = JSX_NAME.match(self.text, self.start)
            if not m:
                self.fail("expected a JSX name")
            n.name = m[0]
            self.pos = m.end()
            self.advance()
            if self.at("<"):
                n.children += self.type_args()
            while not self.at(">", "/"):
                start = self.start
                if self.eat("{"):
                    self.need("...")
                    n.children.append(self.done(Node("spread", start, children=[self.assignment()])))
                    self.need("}")
                    continue
                m = JSX_NAME.match(self.text, self.start)
                if not m:
                    self.fail("expected an attribute")
                a = Node("jsx_attr", start, name=m[0])
                self.pos = m.end()
                self.last_end = m.end()
                self.advance()
                if self.at("="):
                    m = re.compile(r"\s*(\"[^\"]*\"|'[^']*')", re.S).match(self.text, self.end)
                    if m:
                        a.children.append(Node("string", m.start(1), m.end(1), name=m[1][1:-1]))
                        self.pos = self.last_end = m.end()
                        self.advance()
                    elif self.next() and self.at("{"):
                        a.children.append(self.jsx_hole())
                    else:
                        a.children.append(self.jsx_element())
                n.children.append(self.done(a))
            if self.at("/"):
                self.next()
                if not self.at(">"):
                    self.fail("expected '>'")
                self.next()
                return self.done(n)
            at = self.end
        while True:  # children
            m = re.compile(r"[^<{]*").match(self.text, at)
            at = m.end()
            if at >= len(self.text):
                raise SyntaxFailure("unclosed JSX element", n.start)
            self.pos = at
            self.advance()
            if self.at("{"):
                n.children.append(self.jsx_hole(closing=True))
                at = self.last_end
            elif self.text.startswith("</", at):
                close = self.text.find(">", at)
                if close < 0 or self.text[at + 2 : close].strip() != (n.name or ""):
                    self.fail("closing tag does not match")
                self.pos = self.last_end = close + 1
                self.advance()
                return self.done(n)
            else:
                n.children.append(self.jsx_element())
                at = self.last_end

    def jsx_hole(self, closing=False):
        start = self.start
        self.need("{")
        e = None if self.at("}") else self.spread()
        if not self.at("}"):
            self.fail("expected '}'")
        if closing:
            self.last_end = self.end
            return Node("jsx_hole", start, self.end, children=[e])
        self.next()
        return self.done(Node("jsx_hole", start, children=[e]))

    # -- types
    def type_params(self):
        n = Node("t_params", self.start)
        self.need("<")
        while not self.eat(">"):
            while self.at("const", "in", "out") and self.peek()[0] == "id":
                self.next()
            p = Node("t_param", self.start, name=self.next())
            if self.eat("extends"):
                p.children.append(self.type_())
            if self.eat("="):
                p.children.append(self.type_())
            n.children.append(self.done(p))
            if not self.eat(","):
                self.need(">")
                break
        return self.done(n)

    def type_args(self):
        self.need("<")
        out = []
        while not self.eat(">"):
            out.append(self.type_())
            if not self.eat(","):
                self.need(">")
                break
        for t in out:
            t.attrs["argument"] = True
        return out

    def type_(self):
        start = self.start
        if self.at("new", "abstract") and self.peek()[1] in ("(", "<", "new"):
            self.eat("abstract")
            self.next()
            return self.function_type(start)
        if self.at("<") or self.at("(") and self.type_function_ahead():
            return self.function_type(start)
        t = self.union()
        if self.at("extends") and not self.newline and not self.no_conditional:
            self.next()
            self.no_conditional = True
            c = self.type_()
            self.no_conditional = False
            self.need("?")
            a = self.type_()
            self.need(":")
            t = self.done(Node("t_conditional", start, children=[t, c, a, self.type_()]))
        return t

    no_conditional = False

    def type_function_ahead(self):
        nxt = self.peek()
        if nxt[1] in (")", "..."):
            return self.might_be_arrow()
        after = self.scan(nxt[3])
        return (nxt[0] == "id" and after[1] in (":", ",", "?", "=", ")") or nxt[1] in ("{", "[")) and self.might_be_arrow()

    def function_type(self, start):
        n = Node("t_function", start)
        if self.at("<"):
            n.children.append(self.type_params())
        inner = Node("t_signature", self.start)
        self.signature(inner)
        self.need("=>")
        n.children += [self.done(inner), self.return_type()]
        return self.done(n)

    def union(self):
        start = self.start
        self.eat("|") or self.eat("&")
        parts = [self.type_operator()]
        op = None
        while self.at("|", "&"):
            op = self.next()
            parts.append(self.type_operator())
        return parts[0] if op is None else self.done(Node("t_union", start, children=parts))

    def type_operator(self):
        start = self.start
        if self.at("keyof", "unique", "readonly") and (self.peek()[0] in ("id", "str") or self.peek()[1] in ("(", "[", "{")):
            op = self.next()
            return self.done(Node("t_operator", start, name=op, children=[self.type_operator()]))
        if self.at("infer") and self.peek()[0] == "id":
            self.next()
            n = Node("t_infer", start, name=self.next())
            return self.done(n)
        t = self.type_primary()
        while self.at("[") and not self.newline:
            self.next()
            if self.eat("]"):
                t = self.done(Node("t_array", start, children=[t]))
            else:
                i = self.type_()
                self.need("]")
                t = self.done(Node("t_indexed", start, children=[t, i]))
        return t

    def type_primary(self):
        kind, v, start = self.kind, self.value, self.start
        if kind == "id":
            if v in KEYWORD_TYPES and self.peek()[1] != ".":
                self.next()
                if v == "this" and self.at("is"):
                    self.next()
                    return self.done(Node("t_predicate", start, children=[self.type_()]))
                return Node("t_keyword", start, self.last_end, name=v)
            if v in ("true", "false"):
                self.next()
                return Node("t_literal", start, self.last_end, name=v)
            if v == "typeof":
                self.next()
                n = Node("t_typeof", start, children=[self.type_primary()])
                return self.done(n)
            if v == "asserts" and self.peek()[0] == "id":
                return self.return_type()
            if v == "import":
                self.next()
                self.need("(")
                n = Node("t_import", start, children=[self.type_()])
                self.need(")")
                while self.eat("."):
                    n.name = self.next()
                if self.at("<"):
                    n.children += self.type_args()
                return self.done(n)
            n = Node("t_ref", start, name=self.next())
            while self.at(".") and self.next():
                n.name += "." + self.next()
            if self.at("<") and not self.newline:
                n.children += self.type_args()
            return self.done(n)
        if kind in ("str", "num"):
            self.next()
            return Node("t_literal", start, self.last_end, name=v)
        if kind == "tmpl":
            t = self.template()
            return Node("t_literal", start, t.end, children=[])
        if v == "-":
            self.next()
            self.next()
            return self.done(Node("t_literal", start))
        if v == "(":
            self.next()
            kept, self.no_conditional = self.no_conditional, False
            t = self.type_()
            self.no_conditional = kept
            self.need(")")
            return self.done(Node("t_paren", start, children=[t]))
        if v == "[":
            self.next()
            n = Node("t_tuple", start)
            while not self.eat("]"):
                self.eat("...")
                if self.kind == "id" and self.peek()[1] in (":", "?") and self.scan(self.peek()[3])[1] not in (",", "]"):
                    self.next()
                    self.eat("?")
                    self.need(":")
                n.children.append(self.type_())
                self.eat("?")
                if not self.eat(","):
                    self.need("]")
                    break
            return self.done(n)
        if v == "{":
            return self.object_type()
        self.fail("expected a type")

    def object_type(self):
        n = Node("t_object", self.start)
        self.need("{")
        while not self.eat("}"):
            if self.eat(";") or self.eat(","):
                continue
            start = self.start
            m = Node("t_member", start)
            if self.at("+", "-"):
                self.next()
            while self.at("readonly", "get", "set") and self.peek()[1] not in ("(", ":", "?", ";", ",", "}", "<"):
                self.next()
            if self.at("[") and self.peek()[0] == "id" and self.scan(self.peek()[3])[1] in (":", "in"):
                self.next()
                self.next()
                self.next()
                m.children.append(self.type_())
                if self.eat("as"):
                    m.children.append(self.type_())
                self.need("]")
                if self.at("+", "-"):
                    self.next()
                self.eat("?")
                if self.eat(":"):
                    m.children.append(self.type_())
            else:
                if self.at("new") and self.peek()[1] in ("(", "<"):
                    self.next()
                if not self.at("(", "<"):
                    self.property_name(m)
                    self.eat("?")
                if self.at("(", "<"):
                    sig = Node("t_signature", self.start)
                    self.signature(sig)
                    m.children.append(self.done(sig))
                elif self.eat(":"):
                    m.children.append(self.type_())
            n.children.append(self.done(m))
            if not self.at("}") and not self.eat(";") and not self.eat(",") and not self.newline:
                self.fail("expected ';'")
        return self.done(n)


#: Statement words that are names elsewhere.
SOFT = {"type", "interface", "namespace", "module", "declare", "abstract", "async", "let", "enum"}


def parse(text: str, path: str = "file.ts") -> tuple[Node, dict[int, int]]:
    """The program and its comments (start to end)."""
    p = Parser(text, path.lower().endswith(("x", ".js")))
    return p.program(), p.comments
