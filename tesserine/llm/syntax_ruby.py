"""Ruby: recursive-descent statements, precedence-climbing expressions; calls without brackets are commands."""

from __future__ import annotations

from tesserine.llm.syntax_base import Checker, TooDeep

# Binding strength of the binary operators.
_BINARY = {"..": 2, "...": 2, "||": 3, "&&": 4, "<=>": 6, "==": 6, "===": 6, "!=": 6, "=~": 6, "!~": 6, "<": 7, "<=": 7, ">": 7, ">=": 7, "|": 8, "^": 8, "&": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "**": 14}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= &= |= ^= &&= ||=".split())
_MODIFIERS = frozenset(["if", "unless", "while", "until", "rescue"])
_OPERAND = frozenset(["ID", "NUM", "STR", "SYM", "REGEX", "nil", "true", "false", "self", "not", "defined?", "->", "!", "~", "::", "proc", "lambda", "case", "if", "unless", "while", "begin", "def", "yield", "super", "__FILE__", "__LINE__", "__method__", "class", "module"])
_LITERAL = frozenset(["NUM", "STR", "SYM", "REGEX", "nil", "true", "false", "self", "__FILE__", "__LINE__", "__method__", "redo", "retry"])
_END = frozenset(["end", "else", "elsif", "when", "in", "rescue", "ensure", "}", ")", "]", "EOF"])
_OPERATOR_METHODS = frozenset("+ - * / % ** == != === =~ !~ <=> < <= > >= << >> ! ~ & | ^".split())
TARGET, CALL, OTHER = 0, 1, 2


class RubyChecker(Checker):
    """Statements until EOF. A line break ends a statement unless an operator or a comma stands before it or a dot behind it."""

    SYNC = frozenset("def class module if unless while until case begin return end".split())
    no_do = False

    def ended(self) -> bool:
        x = self.t[self.i]
        return x == ";" or x in _END or self.nl[self.i] and x not in (".", "&.")

    def statement(self) -> None:
        if self.opt(";"):
            return
        if self.t[self.i] in _END:
            self.fail("unexpected " + self.t[self.i])
        self.expression_statement()
        if not self.ended():
            self.fail("expected end of statement")
        self.opt(";")

    def body(self, *ends: str) -> None:
        """Statements up to one of ``ends``."""
        t = self.t
        self.deep += 1
        if self.deep > self.DEEP:
            raise TooDeep
        no_do, self.no_do = self.no_do, False
        while t[self.i] not in ends:
            if t[self.i] == "EOF":
                self.fail("missing end")
            self.statement()
        self.no_do = no_do
        self.deep -= 1

    def expression_statement(self) -> None:
        t = self.t
        self.not_expression()
        while True:
            x = t[self.i]
            if x in ("and", "or"):
                self.i += 1
                self.not_expression()
            elif x in _MODIFIERS and not self.nl[self.i]:
                self.i += 1
                self.not_expression()
            else:
                return

    def not_expression(self) -> None:
        if self.opt("not"):
            self.not_expression()
            return
        t = self.t
        if t[self.i] == "*":
            self.i += 1
        kind = self.assignment()
        if t[self.i] == "," and kind != OTHER:
            while self.opt(","):
                self.opt("*")
                if t[self.i] == "(":
                    self.primary()
                elif self.ternary() == OTHER:
                    self.fail("cannot assign")
            self.need("=")
            self.right_side()
        elif t[self.i] in ("=>", "in") and not self.nl[self.i] and not self.no_do:
            self.i += 1
            self.pattern_list()

    def right_side(self) -> None:
        self.opt("*")
        self.assignment()
        while self.t[self.i] == "," and not self.in_arguments:
            self.i += 1
            self.opt("*")
            self.assignment()
        if self.t[self.i] == "rescue" and not self.nl[self.i]:
            self.i += 1
            self.assignment()

    in_arguments = 0

    def assignment(self) -> int:
        kind = self.nested(self.ternary)
        t = self.t
        if t[self.i] in _ASSIGN and not (self.nl[self.i]):
            if kind == OTHER:
                self.fail("cannot assign")
            self.i += 1
            self.right_side()
            return OTHER
        return kind

    def ternary(self) -> int:
        kind = self.binary(0)
        if self.t[self.i] == "?" and not self.nl[self.i]:
            self.i += 1
            self.nested(self.ternary)
            if self.t[self.i] == "SYM" and self.k.src[self.k.start[self.i]] == ":":
                self.i += 1
            else:
                self.need(":")
                self.nested(self.ternary)
            return OTHER
        return kind

    def binary(self, least: int) -> int:
        t = self.t
        kind = self.unary()
        while True:
            x = t[self.i]
            p = _BINARY.get(x)
            if p is None or p < least or self.nl[self.i]:
                return kind
            if x == "|" and self.in_bars:
                return kind
            self.i += 1
            if p == 2 and (self.ended() or t[self.i] == "then"):
                return OTHER
            self.binary(p if p == 14 else p + 1)
            kind = OTHER

    in_bars = 0

    def unary(self) -> int:
        t = self.t
        x = t[self.i]
        if x in ("!", "-", "+", "~", "&", "*", "**", "..", "..."):
            if x in ("&", "*", "**") and not self.in_arguments:
                self.fail("expected an expression")
            self.i += 1
            if x in ("&", "*", "**") and t[self.i] in (")", ","):
                return OTHER
            self.nested(self.unary)
            return OTHER
        if x == "defined?":
            self.i += 1
            self.nested(self.unary)
            return OTHER
        return self.postfix(self.primary())

    def postfix(self, kind: int) -> int:
        t = self.t
        while True:
            x = t[self.i]
            if x in (".", "&.") or x == "::" and not self.spaced():
                self.i += 1
                if t[self.i] == "(":
                    self.arguments(")")
                    kind = OTHER
                    continue
                y = t[self.i]
                if y == "EOF" or y in _END and y in ("}", ")", "]") or not (y == "ID" or y.isalpha() or y in _OPERATOR_METHODS or y == "defined?"):
                    self.fail("expected a name")
                self.i += 1
                kind = self.call_rest(TARGET)
            elif x == "[" and not self.nl[self.i] and not self.spaced():
                self.arguments("]")
                kind = TARGET
            elif x == "{" and kind == CALL and not self.nl[self.i]:
                self.brace_block()
                kind = OTHER
            elif x == "do" and not self.no_do and kind in (CALL, TARGET) and not self.nl[self.i]:
                self.do_block()
                kind = OTHER
            else:
                return kind

    def spaced(self) -> bool:
        return self.k.start[self.i] > self.k.end[self.i - 1]

    def call_rest(self, kind: int) -> int:
        """Arguments and block behind a method's name."""
        t = self.t
        x = t[self.i]
        if x == "(" and not self.spaced():
            self.arguments(")")
            kind = CALL
        elif self.command_likely():
            self.command_arguments()
            kind = OTHER
            if t[self.i] == "do" and not self.no_do:
                self.do_block()
            return kind
        if t[self.i] == "{" and not self.nl[self.i]:
            self.brace_block()
            kind = CALL
        elif t[self.i] == "do" and not self.no_do and not self.nl[self.i]:
            self.do_block()
            kind = CALL
        return kind

    def command_likely(self) -> bool:
        t, i = self.t, self.i
        x = t[i]
        if self.nl[i] or not self.spaced():
            return False
        if x in ("if", "unless", "while", "until", "rescue"):
            return False
        if x in _OPERAND:
            return True
        tight = self.k.start[i + 1] == self.k.end[i] if i + 1 < len(t) else False
        if x in ("[", "*", "&", "-", "**", "::", ":") and tight:
            return x != ":"
        return False

    def command_arguments(self) -> None:
        t = self.t
        bars, self.in_bars = self.in_bars, 0
        self.in_arguments += 1
        while True:
            self.argument()
            if t[self.i] != ",":
                break
            self.i += 1
        self.in_arguments -= 1
        self.in_bars = bars

    def argument(self) -> None:
        t = self.t
        x = t[self.i]
        if (x == "ID" or x.isalpha() and x not in ("EOF", "BAD")) and t[self.i + 1] == ":" and self.k.start[self.i + 1] == self.k.end[self.i] or x == "STR" and t[self.i + 1] == ":" and self.k.start[self.i + 1] == self.k.end[self.i] and self.k.src[self.k.end[self.i] - 1] in "\"'":
            self.i += 2
            if t[self.i] in (",", ")", "]", "}") or self.nl[self.i] and t[self.i] not in ("ID", "STR", "NUM", "SYM", "[", "{", "->", "nil", "true", "false"):
                return
            self.no_comma_assignment()
            return
        if x == "not":
            self.i += 1
        self.no_comma_assignment()
        if self.opt("=>"):
            self.no_comma_assignment()

    def no_comma_assignment(self) -> None:
        self.in_arguments += 1
        self.assignment()
        self.in_arguments -= 1

    def arguments(self, close: str) -> None:
        self.i += 1
        t = self.t
        no_do, self.no_do = self.no_do, False
        bars, self.in_bars = self.in_bars, 0
        self.in_arguments += 1
        while t[self.i] != close:
            if t[self.i] in ("NUM", "STR", "SYM") and t[self.i + 1] == ",":
                self.i += 2
                continue
            if t[self.i] == "..." and t[self.i + 1] == close:
                self.i += 1
                break
            self.argument()
            if t[self.i] != close:
                self.need(",")
        self.in_arguments -= 1
        self.no_do, self.in_bars = no_do, bars
        self.i += 1

    def bars(self) -> None:
        t = self.t
        if self.opt("||"):
            return
        if self.opt("|"):
            self.in_bars += 1
            self.parameters("|")
            self.in_bars -= 1
            self.i += 1

    def brace_block(self) -> None:
        self.need("{")
        self.outside(self.brace_body)

    def outside(self, f) -> None:
        """Run ``f`` as a fresh body: commas and bars around it don't count inside."""
        arguments, bars = self.in_arguments, self.in_bars
        self.in_arguments = self.in_bars = 0
        f()
        self.in_arguments, self.in_bars = arguments, bars

    def brace_body(self) -> None:
        self.bars()
        self.body("}")
        self.i += 1

    def do_block(self) -> None:
        self.need("do")
        self.outside(self.do_body)

    def do_body(self) -> None:
        self.bars()
        self.rescue_body()

    def rescue_body(self) -> None:
        """A body with optional rescue, else and ensure parts, and its end."""
        t = self.t
        self.body("rescue", "else", "ensure", "end")
        while self.opt("rescue"):
            while not self.ended() and t[self.i] not in ("then", "=>"):
                self.opt("*")
                self.in_arguments += 1
                self.ternary()
                self.in_arguments -= 1
                if not self.opt(","):
                    break
            if self.opt("=>"):
                self.postfix(self.primary())
            self.opt("then")
            self.body("rescue", "else", "ensure", "end")
        if self.opt("else"):
            self.body("ensure", "end")
        if self.opt("ensure"):
            self.body("end")
        self.need("end")

    def parameters(self, close: str) -> None:
        t = self.t
        while t[self.i] != close:
            x = t[self.i]
            if x in ("*", "**", "&"):
                self.i += 1
                self.opt("ID") or self.opt("nil")
            elif x == "...":
                self.i += 1
            elif x == "(":
                self.i += 1
                self.parameters(")")
                self.i += 1
            else:
                self.need("ID")
                if self.opt(":"):
                    if t[self.i] not in (",", close) and not self.nl[self.i]:
                        self.in_arguments += 1
                        self.ternary()
                        self.in_arguments -= 1
                elif self.opt("="):
                    self.in_arguments += 1
                    self.ternary()
                    self.in_arguments -= 1
            if t[self.i] == ";" and close == "|":
                self.i += 1
                continue
            if close == "" and self.ended():
                return
            if t[self.i] != close:
                self.need(",")

    def primary(self) -> int:
        t = self.t
        x = t[self.i]
        if x == "ID":
            self.i += 1
            return self.call_rest(TARGET)
        if x in _LITERAL:
            self.i += 1
            while x == "STR" and t[self.i] == "STR" and not self.nl[self.i]:
                self.i += 1
            return OTHER
        if x == "(":
            self.i += 1
            self.outside(lambda: self.body(")"))
            self.i += 1
            return OTHER
        if x == "[":
            self.nested(lambda: self.arguments("]"))
            return OTHER
        if x == "{":
            self.nested(self.hash_)
            return OTHER
        f = self.KEYWORDS.get(x)
        if f:
            self.outside(lambda: self.nested(lambda: f(self)))
            return CALL if x in ("super", "yield") else OTHER
        if x == "::":
            self.i += 1
            self.need("ID")
            return self.call_rest(TARGET)
        self.fail("expected an expression")
        return OTHER

    def hash_(self) -> None:
        self.i += 1
        t = self.t
        no_do, self.no_do = self.no_do, False
        self.in_arguments += 1
        while t[self.i] != "}":
            if t[self.i] == "**":
                self.i += 1
                self.ternary()
            else:
                begun = self.i
                self.argument()
                if not any(x in ("=>", ":") for x in t[begun : self.i]) :
                    self.fail("expected =>")
            if t[self.i] != "}":
                self.need(",")
        self.in_arguments -= 1
        self.no_do = no_do
        self.i += 1

    def condition(self) -> None:
        no_do, self.no_do = self.no_do, True
        self.expression_statement()
        self.no_do = no_do

    def then(self) -> None:
        if not (self.opt("then") or self.t[self.i] == ";" or self.nl[self.i]):
            self.fail("expected then")
        self.opt(";")
        self.opt("then")

    def if_(self) -> None:
        self.i += 1
        self.condition()
        self.then()
        self.body("elsif", "else", "end")
        while self.opt("elsif"):
            self.condition()
            self.then()
            self.body("elsif", "else", "end")
        if self.opt("else"):
            self.body("end")
        self.need("end")

    def while_(self) -> None:
        self.i += 1
        self.condition()
        self.opt("do")
        self.body("end")
        self.i += 1

    def for_(self) -> None:
        self.i += 1
        self.need("ID")
        while self.opt(","):
            self.need("ID")
        self.need("in")
        self.condition()
        self.opt("do")
        self.body("end")
        self.i += 1

    def case(self) -> None:
        self.i += 1
        t = self.t
        if not self.nl[self.i] and t[self.i] != ";":
            self.expression_statement()
        self.opt(";")
        if t[self.i] not in ("when", "in"):
            self.fail("expected when")
        while t[self.i] in ("when", "in"):
            patterns = t[self.i] == "in"
            self.i += 1
            if patterns:
                self.pattern_list()
                if t[self.i] in ("if", "unless") and not self.nl[self.i]:
                    self.i += 1
                    self.expression_statement()
            else:
                self.in_arguments += 1
                while True:
                    self.opt("*")
                    self.ternary()
                    if not self.opt(","):
                        break
                self.in_arguments -= 1
            self.then()
            self.body("when", "in", "else", "end")
        if self.opt("else"):
            self.body("end")
        self.need("end")

    def pattern_list(self) -> None:
        """A pattern: brackets paired, up to the end of the line, then, if or unless."""
        t, depth, begun = self.t, 0, self.i
        while True:
            x = t[self.i]
            if x == "EOF" or not depth and self.i > begun and (x in ("then", "if", "unless", ";", "and", "or") or self.nl[self.i] or x in (")", "]", "}")):
                return
            depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
            self.i += 1

    def def_(self) -> None:
        self.i += 1
        t = self.t
        x = t[self.i]
        if x in _OPERATOR_METHODS or x == "[":
            self.i += 1
            if x == "[":
                self.need("]")
            self.opt("=") if t[self.i] == "=" and not self.spaced() else None
            if t[self.i] in ("@",):
                self.i += 1
        elif x == "ID" or x.isalpha() and x != "EOF":
            self.i += 1
            if t[self.i] == "." :
                self.i += 1
                if t[self.i] == "[":
                    self.i += 1
                    self.need("]")
                else:
                    self.i += 1
            if t[self.i] == "=" and not self.spaced() and t[self.i + 1] == "(":
                self.i += 1
        else:
            self.fail("expected a name")
        if self.opt("("):
            self.parameters(")")
            self.i += 1
        elif not self.nl[self.i] and t[self.i] not in (";", "="):
            while True:
                if t[self.i] in ("*", "**", "&"):
                    self.i += 1
                self.need("ID")
                if self.opt("=") or self.opt(":"):
                    if not self.ended() and t[self.i] != ",":
                        self.in_arguments += 1
                        self.ternary()
                        self.in_arguments -= 1
                if not self.opt(","):
                    break
            if not self.ended():
                self.fail("expected end of line")
        if self.opt("="):
            self.expression_statement()
            return
        self.rescue_body()

    def class_(self) -> None:
        self.i += 1
        if self.opt("<<"):
            self.ternary()
        else:
            self.opt("::")
            self.need("ID")
            while self.opt("::"):
                self.need("ID")
            if self.opt("<"):
                self.ternary()
        if not self.ended():
            self.fail("expected end of line")
        self.rescue_body()

    def module(self) -> None:
        self.i += 1
        self.need("ID")
        while self.opt("::"):
            self.need("ID")
        self.rescue_body()

    def begin(self) -> None:
        self.i += 1
        self.rescue_body()

    def jump(self) -> None:
        self.i += 1
        if not self.ended() and self.t[self.i] not in _MODIFIERS and self.t[self.i] not in ("and", "or"):
            self.opt("*")
            self.assignment()
            while self.opt(","):
                self.opt("*")
                self.assignment()

    def lambda_(self) -> None:
        self.i += 1
        if self.opt("("):
            self.parameters(")")
            self.i += 1
        elif self.t[self.i] == "ID":
            while self.opt("ID") and self.opt(","):
                pass
        if self.t[self.i] == "{":
            self.brace_block()
        else:
            self.do_block()

    def yield_(self) -> None:
        self.i += 1
        if self.t[self.i] == "(" and not self.spaced():
            self.arguments(")")
        elif self.command_likely():
            self.command_arguments()

    def alias(self) -> None:
        self.i += 1
        for _ in range(2):
            if self.nl[self.i]:
                self.fail()
            self.i += 1

    def hooks(self) -> None:
        self.i += 1
        self.brace_block()

    KEYWORDS = {"if": if_, "unless": if_, "while": while_, "until": while_, "for": for_, "case": case, "def": def_, "class": class_, "module": module, "begin": begin, "return": jump, "break": jump, "next": jump, "->": lambda_, "yield": yield_, "super": yield_, "alias": alias, "undef": jump, "BEGIN": hooks, "END": hooks}
