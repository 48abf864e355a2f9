"""Python: recursive-descent statements, precedence-climbing expressions."""

from __future__ import annotations

from tesserine.llm.syntax_base import Checker, TooDeep, Unexpected

# Binding strength of the binary operators.
_BINARY = {"or": 1, "and": 2, "in": 4, "is": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "==": 4, "!=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10, "**": 12}
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_ENDS = frozenset(["NL", ")", "]", "}", ":", "=", ";", "EOF"]) | _AUGMENTED
#: Kinds of expression: a name, attribute or item; a list or tuple of such; anything else.
NAME, ITEM, GROUP, OTHER = 0, 1, 2, 3


class PythonChecker(Checker):
    """Statements until EOF, with NL, INDENT and DEDENT tokens."""

    def recover(self, begun: int) -> None:
        t, i = self.t, max(self.i, begun)
        while t[i] not in ("NL", "EOF"):
            i += 1
        i += t[i] == "NL"
        if i == begun:
            i += t[i] != "EOF"
        self.i = i

    def statement(self) -> None:
        t = self.t
        x = t[self.i]
        f = self.COMPOUND.get(x)
        if f:
            f(self)
        elif x in ("INDENT", "DEDENT"):
            if x == "INDENT":
                self.errors.append((self.k.start[self.i], "unexpected indent"))
            self.i += 1
        elif x == "ID" and t[self.i + 1] not in ("=", ".", "(", "NL", ",") and self.text() in ("match", "type") and self.soft():
            pass
        elif x == "ID" and self.text() == "match" and t[self.i + 1] == "(" and self.attempt(self.match_):
            pass
        else:
            self.simple_line()

    def soft(self) -> bool:
        if self.text() == "type" and self.t[self.i + 1] == "ID":
            self.i += 2
            if self.t[self.i] == "[":
                self.type_params()
            self.need("=")
            self.expr()
            self.line_end()
            return True
        return self.attempt(self.match_)

    def match_(self) -> None:
        self.i += 1
        self.star_list()
        self.need(":")
        self.need("NL")
        self.need("INDENT")
        if not self.word("case"):
            self.fail()
        while self.word("case"):
            self.i += 1
            self.pattern()
            if self.opt("if"):
                self.named()
            self.suite()
        self.need("DEDENT")

    def pattern(self) -> None:
        t = self.t
        while t[self.i] not in (":", "if", "NL", "EOF"):
            if t[self.i] == "as":
                self.i += 1
                self.need("ID")
            elif t[self.i] in ("|", ",", "*"):
                self.i += 1
            elif t[self.i] in ("(", "[", "{"):
                self.skip_group()
            else:
                self.expr(5)

    def skip_group(self) -> None:
        depth = 0
        while True:
            x = self.t[self.i]
            if x == "EOF":
                self.fail()
            depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
            self.i += 1
            if not depth:
                return

    def line_end(self) -> None:
        if self.t[self.i] == ";":
            self.i += 1
            if self.t[self.i] == "NL":
                self.i += 1
            else:
                self.simple_line()
        else:
            self.need("NL")

    def simple_line(self) -> None:
        t = self.t
        while True:
            self.simple()
            if t[self.i] == "NL":
                self.i += 1
                return
            if t[self.i] != ";":
                self.fail("expected end of line")
            self.i += 1
            if t[self.i] == "NL":
                self.i += 1
                return

    def simple(self) -> None:
        t = self.t
        x = t[self.i]
        if x in ("pass", "break", "continue"):
            self.i += 1
        elif x == "return":
            self.i += 1
            if t[self.i] not in ("NL", ";"):
                self.star_list()
        elif x == "raise":
            self.i += 1
            if t[self.i] not in ("NL", ";"):
                self.expr()
                if self.opt("from"):
                    self.expr()
        elif x == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.opt("as"):
                    self.need("ID")
                if not self.opt(","):
                    break
        elif x == "from":
            self.i += 1
            dots = 0
            while t[self.i] in (".", "..."):
                self.i += 1
                dots = 1
            if t[self.i] == "ID" or not dots:
                self.dotted()
            self.need("import")
            if self.opt("*"):
                return
            grouped = self.opt("(")
            while True:
                self.need("ID")
                if self.opt("as"):
                    self.need("ID")
                if not self.opt(","):
                    break
                if t[self.i] == ")" and grouped:
                    break
            if grouped:
                self.need(")")
        elif x in ("global", "nonlocal"):
            self.i += 1
            self.need("ID")
            while self.opt(","):
                self.need("ID")
        elif x == "del":
            self.i += 1
            if self.star_list() == OTHER:
                self.fail("cannot delete")
        elif x == "assert":
            self.i += 1
            self.expr()
            if self.opt(","):
                self.expr()
        else:
            self.assignment()

    def dotted(self) -> None:
        self.need("ID")
        while self.opt("."):
            self.need("ID")

    def assignment(self) -> None:
        kind = self.star_list(True)
        t = self.t
        x = t[self.i]
        if x == "=":
            while t[self.i] == "=":
                if kind == OTHER:
                    self.fail("cannot assign")
                self.i += 1
                kind = self.star_list(True)
        elif x in _AUGMENTED:
            if kind not in (NAME, ITEM):
                self.fail("cannot assign")
            self.i += 1
            self.star_list(True)
        elif x == ":":
            if kind not in (NAME, ITEM):
                self.fail("cannot annotate")
            self.i += 1
            self.expr()
            if self.opt("="):
                self.star_list(True)

    def star_list(self, may_yield: bool = False) -> int:
        """Expressions, starred or not, separated by commas."""
        t = self.t
        if t[self.i] == "yield":
            self.yield_()
            return OTHER
        kind = self.star()
        if t[self.i] != ",":
            return kind
        worst = OTHER if kind == OTHER else GROUP
        while t[self.i] == ",":
            self.i += 1
            if t[self.i] in _ENDS:
                break
            if self.star() == OTHER:
                worst = OTHER
        return worst

    def star(self) -> int:
        if self.t[self.i] == "*":
            self.i += 1
            return self.expr(5)
        return self.named()

    def yield_(self) -> None:
        self.i += 1
        if self.opt("from"):
            self.expr()
        elif self.t[self.i] not in _ENDS:
            self.star_list()

    def named(self) -> int:
        if self.t[self.i] == "ID" and self.t[self.i + 1] == ":=":
            self.i += 2
            self.expr()
            return OTHER
        return self.expr()

    def expr(self, least: int = 0) -> int:
        """Operand and binary operators that bind at least so strongly; 0 also takes lambda and if-else."""
        t = self.t
        x = t[self.i]
        if x == "lambda":
            self.i += 1
            self.parameters(":")
            self.need(":")
            self.expr()
            return OTHER
        if x == "not":
            self.i += 1
            self.expr(3)
            kind = OTHER
        elif x in ("-", "+", "~"):
            self.i += 1
            self.expr(11)
            kind = OTHER
        elif x == "ID" and t[self.i + 1] in _ENDS:
            self.i += 1
            return NAME
        elif x == "await":
            self.i += 1
            self.primary()
            kind = OTHER
        else:
            kind = self.primary()
        while True:
            x = t[self.i]
            p = _BINARY.get(x)
            if p is None:
                if x == "not" and t[self.i + 1] == "in" and least <= 4:
                    self.i += 1
                    p = 4
                else:
                    break
            if p < least:
                break
            self.i += 1
            if x == "is" and t[self.i] == "not":
                self.i += 1
            if p == 12:
                self.expr(11)
            elif p == 1:
                self.expr(2)
            elif p == 2:
                self.expr(3)
            else:
                if t[self.i] == "not" and p > 3:
                    self.fail()
                self.expr(p + 1)
            kind = OTHER
        if least == 0 and t[self.i] == "if":
            self.i += 1
            self.expr(1)
            self.need("else")
            self.expr()
            return OTHER
        return kind

    def primary(self) -> int:
        t = self.t
        x = t[self.i]
        if x == "ID":
            kind = NAME
            self.i += 1
        elif x == "STR":
            while t[self.i] == "STR":
                self.i += 1
            kind = OTHER
        elif x in ("NUM", "None", "True", "False", "..."):
            self.i += 1
            kind = OTHER
        elif x == "(":
            kind = self.nested(self.group)
        elif x == "[":
            kind = self.nested(self.list_)
        elif x == "{":
            self.nested(self.braces)
            kind = OTHER
        else:
            self.fail("expected an expression")
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                self.need("ID")
                kind = ITEM
            elif x == "(":
                self.nested(self.arguments)
                kind = OTHER
            elif x == "[":
                self.nested(self.subscript)
                kind = ITEM
            else:
                return kind

    def group(self) -> int:
        self.i += 1
        t = self.t
        if self.opt(")"):
            return GROUP
        if t[self.i] == "yield":
            self.yield_()
            self.need(")")
            return OTHER
        starred = t[self.i] == "*"
        kind = self.star()
        if t[self.i] in ("for", "async"):
            self.comprehension()
            self.need(")")
            return OTHER
        comma = False
        while self.opt(","):
            comma = True
            if t[self.i] == ")":
                break
            if self.star() == OTHER:
                kind = OTHER
        self.need(")")
        if starred and not comma:
            self.fail("cannot use starred expression here")
        return GROUP if comma and kind != OTHER else kind

    def list_(self) -> int:
        self.i += 1
        t = self.t
        kind = GROUP
        if self.opt("]"):
            return kind
        if self.star() == OTHER:
            kind = OTHER
        if t[self.i] in ("for", "async"):
            self.comprehension()
            self.need("]")
            return OTHER
        while self.opt(","):
            if t[self.i] == "]":
                break
            if t[self.i] in ("NUM", "STR") and t[self.i + 1] in (",", "]"):
                self.i += 1
                kind = OTHER
            elif self.star() == OTHER:
                kind = OTHER
        self.need("]")
        return kind

    def braces(self) -> None:
        self.i += 1
        t = self.t
        first = True
        is_map = None
        while t[self.i] != "}":
            if t[self.i] == "**":
                self.i += 1
                self.expr(5)
                is_map = True
            else:
                self.star()
                if t[self.i] == ":" and is_map is not False:
                    self.i += 1
                    self.expr()
                    is_map = True
                elif is_map:
                    self.fail()
                else:
                    is_map = False
                if first and t[self.i] in ("for", "async"):
                    self.comprehension()
                    break
            first = False
            if not self.opt(","):
                break
        self.need("}")

    def comprehension(self) -> None:
        while self.t[self.i] in ("for", "async"):
            self.opt("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.expr(1)
            while self.opt("if"):
                if self.t[self.i] == "ID" and self.t[self.i + 1] == ":=":
                    self.i += 2
                self.expr(1)

    def targets(self) -> None:
        while True:
            self.opt("*")
            if self.expr(5) == OTHER:
                self.fail("cannot assign")
            if not self.opt(",") or self.t[self.i] in ("in", "="):
                return

    def arguments(self) -> None:
        self.i += 1
        t = self.t
        named = False
        while t[self.i] != ")":
            x = t[self.i]
            if x in ("*", "**"):
                self.i += 1
                self.expr()
                named = named or x == "**"
            elif x == "ID" and t[self.i + 1] == "=":
                self.i += 2
                self.expr()
                named = True
            else:
                self.named()
                if t[self.i] in ("for", "async"):
                    self.comprehension()
                elif named:
                    self.fail("positional argument follows keyword argument")
            if not self.opt(","):
                break
        self.need(")")

    def subscript(self) -> None:
        self.i += 1
        t = self.t
        if t[self.i] == "]":
            self.fail("expected an expression")
        while t[self.i] != "]":
            if t[self.i] != ":":
                self.star()
            if self.opt(":"):
                if t[self.i] not in (":", ",", "]"):
                    self.expr()
                if self.opt(":") and t[self.i] not in (",", "]"):
                    self.expr()
            if not self.opt(","):
                break
        self.need("]")

    def parameters(self, end: str) -> None:
        t = self.t
        defaults = False
        star = False
        while t[self.i] != end:
            x = t[self.i]
            if x == "/":
                self.i += 1
            elif x == "*" and t[self.i + 1] == ",":
                self.i += 1
                star = True
            else:
                if x in ("*", "**"):
                    self.i += 1
                    star = True
                self.need("ID")
                if end == ")" and self.opt(":"):
                    self.star()
                if self.opt("="):
                    self.expr()
                    defaults = True
                elif defaults and not star:
                    self.fail("parameter without a default follows one with a default")
            if not self.opt(","):
                break

    def type_params(self) -> None:
        self.need("[")
        while self.t[self.i] != "]":
            if self.t[self.i] in ("*", "**"):
                self.i += 1
            self.need("ID")
            if self.opt(":"):
                self.expr()
            if self.opt("="):
                self.expr()
            if not self.opt(","):
                break
        self.need("]")

    def suite(self) -> None:
        self.need(":")
        t = self.t
        if t[self.i] != "NL":
            self.simple_line()
            return
        self.i += 1
        if t[self.i] != "INDENT":
            self.fail("expected an indented block")
        self.i += 1
        self.deep += 1
        if self.deep > self.DEEP:
            raise TooDeep
        deep = self.deep
        while t[self.i] not in ("DEDENT", "EOF"):
            begun = self.i
            try:
                self.statement()
            except Unexpected as e:
                self.deep = deep
                self.errors.append((self.k.start[e.at], e.message))
                self.recover(begun)
        self.deep -= 1
        if t[self.i] == "DEDENT":
            self.i += 1

    def if_(self) -> None:
        self.i += 1
        self.named()
        self.suite()
        while self.opt("elif"):
            self.named()
            self.suite()
        if self.opt("else"):
            self.suite()

    def while_(self) -> None:
        self.i += 1
        self.named()
        self.suite()
        if self.opt("else"):
            self.suite()

    def for_(self) -> None:
        self.need("for")
        self.targets()
        self.need("in")
        self.star_list()
        self.suite()
        if self.opt("else"):
            self.suite()

    def try_(self) -> None:
        self.i += 1
        self.suite()
        caught = False
        while self.opt("except"):
            caught = True
            self.opt("*")
            if self.t[self.i] != ":":
                self.expr()
                while self.opt(","):
                    self.expr()
                if self.opt("as"):
                    self.need("ID")
            self.suite()
        if caught and self.opt("else"):
            self.suite()
        if self.opt("finally"):
            self.suite()
        elif not caught:
            self.fail("expected except or finally")

    def with_(self) -> None:
        self.need("with")

        def items() -> None:
            while True:
                self.named()
                if self.opt("as") and self.expr(5) == OTHER:
                    self.fail("cannot assign")
                if not self.opt(",") or self.t[self.i] == ")":
                    break

        def grouped() -> None:
            self.need("(")
            items()
            self.need(")")
            if self.t[self.i] != ":":
                self.fail()

        if not (self.t[self.i] == "(" and self.attempt(grouped)):
            items()
        self.suite()

    def def_(self) -> None:
        self.need("def")
        self.need("ID")
        if self.t[self.i] == "[":
            self.type_params()
        self.need("(")
        self.parameters(")")
        self.need(")")
        if self.opt("->"):
            self.star_list()
        self.suite()

    def class_(self) -> None:
        self.need("class")
        self.need("ID")
        if self.t[self.i] == "[":
            self.type_params()
        if self.t[self.i] == "(":
            self.arguments()
        self.suite()

    def decorated(self) -> None:
        while self.opt("@"):
            self.named()
            self.need("NL")
        if self.t[self.i] == "async":
            self.async_()
        elif self.t[self.i] == "def":
            self.def_()
        else:
            self.class_()

    def async_(self) -> None:
        self.i += 1
        x = self.t[self.i]
        if x == "def":
            self.def_()
        elif x == "for":
            self.for_()
        else:
            self.with_()

    COMPOUND = {"if": if_, "while": while_, "for": for_, "try": try_, "with": with_, "def": def_, "class": class_, "@": decorated, "async": async_}
