"""Go: recursive-descent statements, precedence-climbing expressions."""

from __future__ import annotations

from tesserine.llm.syntax_base import Checker, TooDeep

# Binding strength of the binary operators, and the tokens after which a line end is a semicolon.
_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_PREFIX = frozenset(["+", "-", "!", "^", "*", "&", "<-", "~"])
_ENDS_LINE = frozenset(["ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


class GoChecker(Checker):
    """Declarations until EOF."""

    SYNC = frozenset("func type var const if for switch return package import".split())

    def __init__(self, tokens) -> None:
        super().__init__(tokens)
        t, s, e, nl = [], [], [], []
        last = ""
        for x, a, b, n in zip(tokens.types, tokens.start, tokens.end, tokens.nl):
            if n and last in _ENDS_LINE:
                t.append(";"), s.append(a), e.append(a), nl.append(False)
            t.append(x), s.append(a), e.append(b), nl.append(n)
            last = x
        tokens.types, tokens.start, tokens.end, tokens.nl = self.t, tokens.start, tokens.end, self.nl = t, s, e, nl
        self.t, self.nl = t, nl
        self.control = False

    def program(self):
        if self.t[0] == "EOF":
            return sorted(set(self.errors))
        try:
            self.need("package")
            self.need("ID")
            self.semi()
        except Exception as e:
            self.errors.append((self.k.start[self.i], getattr(e, "message", "expected package")))
            self.recover(0)
        return super().program()

    def semi(self) -> None:
        if self.t[self.i] in (")", "}"):
            return
        if self.t[self.i] == "EOF":
            return
        self.need(";")

    def statement(self) -> None:
        """A top-level declaration."""
        x = self.t[self.i]
        if x == "import":
            self.i += 1
            self.group(self.import_spec)
        elif x == "func":
            self.i += 1
            if self.t[self.i] == "(":
                self.parameters()
            self.need("ID")
            if self.t[self.i] == "[":
                self.type_parameters()
            self.signature()
            if self.t[self.i] == "{":
                self.block()
        elif x in ("const", "var", "type"):
            self.declaration()
        elif x == ";":
            self.i += 1
            return
        else:
            self.fail("expected a declaration")
        self.semi()

    def import_spec(self) -> None:
        if self.t[self.i] in ("ID", "."):
            self.i += 1
        self.need("STR")

    def group(self, spec) -> None:
        if self.opt("("):
            while self.t[self.i] != ")":
                spec()
                self.semi()
            self.i += 1
        else:
            spec()

    def declaration(self) -> None:
        x = self.t[self.i]
        self.i += 1
        self.group({"const": self.const_spec, "var": self.var_spec, "type": self.type_spec}[x])

    def const_spec(self) -> None:
        self.names()
        if self.t[self.i] not in ("=", ";", ")"):
            self.type()
        if self.opt("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if self.t[self.i] != "=":
            self.type()
        if self.opt("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("ID")
        if self.t[self.i] == "[" and self.t[self.i + 1] == "ID" and self.t[self.i + 2] != "]":
            self.type_parameters()
        self.opt("=")
        self.type()

    def names(self) -> None:
        self.need("ID")
        while self.opt(","):
            self.need("ID")

    def type_parameters(self) -> None:
        self.need("[")
        while self.t[self.i] != "]":
            self.names()
            self.constraint()
            if self.t[self.i] != "]":
                self.need(",")
        self.i += 1

    def constraint(self) -> None:
        while True:
            self.opt("~")
            self.type()
            if not self.opt("|"):
                return

    def type(self) -> None:
        t = self.t
        x = t[self.i]
        if x == "ID":
            self.i += 1
            if t[self.i] == "." and t[self.i + 1] == "ID":
                self.i += 2
            if t[self.i] == "[" and t[self.i + 1] != "]" and self.attempt(self.type_arguments):
                pass
        elif x == "*":
            self.i += 1
            self.type()
        elif x == "[":
            self.i += 1
            if t[self.i] != "]":
                if not self.opt("..."):
                    self.expression()
            self.need("]")
            self.type()
        elif x == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif x == "chan":
            self.i += 1
            self.opt("<-")
            self.type()
        elif x == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif x == "func":
            self.i += 1
            self.signature()
        elif x == "struct":
            self.i += 1
            self.need("{")
            while t[self.i] != "}":
                if self.opt("*"):
                    self.type()
                elif t[self.i + 1] in (".", ";", "STR", "}"):
                    self.type()
                else:
                    self.names()
                    self.type()
                if t[self.i] == "STR":
                    self.i += 1
                self.semi()
            self.i += 1
        elif x == "interface":
            self.i += 1
            self.need("{")
            while t[self.i] != "}":
                if t[self.i] == "ID" and t[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.semi()
            self.i += 1
        elif x == "(":
            self.i += 1
            self.type()
            self.need(")")
        else:
            self.fail("expected a type")

    def type_arguments(self) -> None:
        self.need("[")
        while True:
            self.type()
            if not self.opt(",") or self.t[self.i] == "]":
                break
        self.need("]")

    def signature(self) -> None:
        self.parameters()
        x = self.t[self.i]
        if x == "(":
            self.parameters()
        elif x in ("ID", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        t = self.t
        while t[self.i] != ")":
            if self.opt("..."):
                self.type()
            else:
                self.type()
                if t[self.i] not in (",", ")"):
                    self.opt("...")
                    self.type()
            if t[self.i] != ")":
                self.need(",")
        self.i += 1

    def block(self) -> None:
        self.need("{")
        self.deep += 1
        if self.deep > self.DEEP:
            raise TooDeep
        control, self.control = self.control, False
        self.statements()
        self.control = control
        self.deep -= 1
        self.need("}")

    def statements(self) -> None:
        t = self.t
        while t[self.i] not in ("}", "case", "default"):
            if t[self.i] == "EOF":
                self.fail("unclosed block")
            if t[self.i] == ";":
                self.i += 1
                continue
            self.inner()
            if t[self.i] not in ("}", "case", "default"):
                self.need(";")

    def inner(self) -> None:
        t = self.t
        x = t[self.i]
        if x == "ID" and t[self.i + 1] == ":" :
            self.i += 2
            if t[self.i] not in ("}", ";", "case", "default"):
                self.inner()
        elif x in ("const", "var", "type"):
            self.declaration()
        elif x == "{":
            self.block()
        elif x == "if":
            self.if_()
        elif x == "for":
            self.for_()
        elif x == "switch":
            self.i += 1
            self.header()
            self.clauses(self.expressions)
        elif x == "select":
            self.i += 1
            self.clauses(self.simple)
        elif x == "return":
            self.i += 1
            if t[self.i] not in (";", "}", "case", "default"):
                self.expressions()
        elif x in ("go", "defer"):
            self.i += 1
            self.expression()
        elif x in ("break", "continue", "goto"):
            self.i += 1
            self.opt("ID")
        elif x == "fallthrough":
            self.i += 1
        else:
            self.simple()

    def clauses(self, head) -> None:
        self.need("{")
        while self.t[self.i] != "}":
            if self.opt("case"):
                control, self.control = self.control, False
                if head == self.expressions:
                    while True:
                        if not self.attempt(self.case_expression):
                            self.type()
                        if not self.opt(","):
                            break
                else:
                    head()
                self.control = control
            else:
                self.need("default")
            self.need(":")
            control, self.control = self.control, False
            self.statements()
            self.control = control
        self.i += 1

    def case_expression(self) -> None:
        self.expression()
        if self.t[self.i] not in (",", ":"):
            self.fail()

    def simple(self) -> None:
        t = self.t
        n = self.expressions()
        x = t[self.i]
        if x in _ASSIGN:
            self.i += 1
            if t[self.i] == "range":
                self.i += 1
                self.expression()
            else:
                self.expressions()
        elif x in ("++", "--"):
            if n != 1:
                self.fail()
            self.i += 1
        elif x == "<-":
            self.i += 1
            self.expression()
        elif n != 1:
            self.fail()

    def header(self) -> None:
        """What stands between the keyword and the block of if and switch."""
        control, self.control = self.control, True
        t = self.t
        if t[self.i] != "{":
            if t[self.i] != ";":
                self.simple()
            if self.opt(";") and t[self.i] != "{":
                self.simple()
        self.control = control

    def if_(self) -> None:
        self.i += 1
        if self.t[self.i] == "{":
            self.fail("expected a condition")
        self.header()
        self.block()
        while self.opt("else"):
            if self.t[self.i] != "if":
                self.block()
                break
            self.i += 1
            if self.t[self.i] == "{":
                self.fail("expected a condition")
            self.header()
            self.block()

    def for_(self) -> None:
        self.i += 1
        t = self.t
        control, self.control = self.control, True
        if t[self.i] == "range":
            self.i += 1
            self.expression()
        elif t[self.i] != "{":
            if t[self.i] != ";":
                self.simple()
            if self.opt(";"):
                if t[self.i] != ";":
                    self.expression()
                self.need(";")
                if t[self.i] != "{":
                    self.simple()
        self.control = control
        self.block()

    def expressions(self) -> int:
        n = 1
        self.expression()
        while self.opt(","):
            self.expression()
            n += 1
        return n

    def expression(self, least: int = 1) -> None:
        t = self.t
        if t[self.i] in _PREFIX:
            self.i += 1
            self.nested(self.unary)
        else:
            self.operand()
        while True:
            p = _BINARY.get(t[self.i])
            if p is None or p < least:
                return
            self.i += 1
            self.expression(p + 1)

    def unary(self) -> None:
        if self.t[self.i] in _PREFIX:
            self.i += 1
            self.nested(self.unary)
        else:
            self.operand()

    def operand(self) -> None:
        t = self.t
        x = t[self.i]
        literal = False
        if x == "ID":
            self.i += 1
            literal = not self.control
        elif x in ("NUM", "STR"):
            self.i += 1
        elif x == "(":
            self.i += 1
            control, self.control = self.control, False
            if not self.attempt(self.parenthesised):
                self.type()
                self.need(")")
            self.control = control
        elif x == "func":
            self.i += 1
            self.signature()
            if t[self.i] == "{":
                self.nested(self.block)
        elif x in ("[", "map", "chan", "struct", "interface"):
            self.type()
            literal = True
            if t[self.i] not in ("{", "("):
                if t[self.i] not in (",", ")"):
                    self.fail()
        else:
            self.fail("expected an expression")
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                if self.opt("("):
                    if not self.opt("type"):
                        self.type()
                    self.need(")")
                else:
                    self.need("ID")
            elif x == "(":
                self.nested(self.arguments)
                literal = False
            elif x == "[":
                self.nested(self.index)
            elif x == "{" and literal:
                self.nested(self.composite)
            else:
                return

    def parenthesised(self) -> None:
        self.nested(self.expression)
        self.need(")")

    def arguments(self) -> None:
        self.i += 1
        t = self.t
        control, self.control = self.control, False
        while t[self.i] != ")":
            if t[self.i] in ("[", "map", "chan", "struct", "interface", "func", "*"):
                if not self.attempt(self.argument):
                    self.type()
            else:
                self.expression()
            self.opt("...")
            if t[self.i] != ")":
                self.need(",")
        self.control = control
        self.i += 1

    def argument(self) -> None:
        self.expression()
        if self.t[self.i] not in (",", ")", "..."):
            self.fail()

    def index(self) -> None:
        self.i += 1
        t = self.t
        control, self.control = self.control, False
        if t[self.i] == "]":
            self.fail("expected an expression")
        while t[self.i] != "]":
            if t[self.i] == ":":
                self.i += 1
            elif t[self.i] == ",":
                self.i += 1
            elif not self.attempt(self.expression):
                self.type()
        self.control = control
        self.i += 1

    def composite(self) -> None:
        self.i += 1
        t = self.t
        control, self.control = self.control, False
        while t[self.i] != "}":
            if t[self.i] in ("NUM", "STR") and t[self.i + 1] == ",":
                self.i += 2
                continue
            self.element()
            if self.opt(":"):
                self.element()
            if t[self.i] != "}":
                self.need(",")
        self.control = control
        self.i += 1

    def element(self) -> None:
        if self.t[self.i] == "{":
            self.nested(self.composite)
        else:
            self.expression()
