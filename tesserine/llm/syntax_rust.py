"""Rust: recursive-descent items and statements, precedence-climbing expressions; macro calls are token trees."""

from __future__ import annotations

from tesserine.llm.syntax_base import Checker, TooDeep

# Binding strength of the binary operators.
_BINARY = {"||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_ASSIGN = frozenset("= += -= *= /= %= ^= &= |= <<= >>=".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
_PATH = frozenset(["ID", "self", "Self", "super", "crate"])
_BLOCKLIKE = frozenset(["{", "if", "match", "loop", "while", "for", "unsafe"])


class RustChecker(Checker):
    """Items until EOF."""

    SYNC = frozenset("fn pub let use mod struct enum impl trait const static for while if match return".split())
    no_struct = False

    def program(self):
        self.attributes_at_start()
        return super().program()

    def attributes_at_start(self) -> None:
        while self.t[self.i] == "#" and self.t[self.i + 1] == "!" and self.attempt(self.inner_attribute):
            pass

    def inner_attribute(self) -> None:
        self.i += 2
        self.tree("[")

    def tree(self, opener: str = "") -> None:
        """A token tree, its brackets paired."""
        t = self.t
        x = t[self.i]
        if x not in _OPEN or opener and x != opener:
            self.fail("expected a bracket")
        stack = [_OPEN[x]]
        self.i += 1
        while stack:
            x = t[self.i]
            if x in _OPEN:
                stack.append(_OPEN[x])
            elif x in _CLOSE:
                if stack.pop() != x:
                    self.fail("mismatched bracket")
            elif x == "EOF":
                self.fail("unclosed bracket")
            self.i += 1

    def attributes(self) -> None:
        while self.t[self.i] == "#":
            self.i += 1
            self.opt("!")
            self.tree("[")

    def visibility(self) -> None:
        if self.opt("pub") and self.t[self.i] == "(" and self.t[self.i + 1] in ("crate", "self", "super", "in"):
            self.tree("(")

    def statement(self) -> None:
        self.attributes()
        if self.t[self.i] == "EOF":
            self.fail("expected an item")
        if not self.item():
            self.fail("expected an item")

    def item(self) -> bool:
        t = self.t
        begun = self.i
        self.visibility()
        x = t[self.i]
        if x == "const" and t[self.i + 1] in ("ID", "_", "mut"):
            self.i += 1
            self.constant()
        elif x == "static":
            if t[self.i + 1] in ("|", "||", "move"):
                return False
            self.i += 1
            self.opt("mut")
            self.constant()
        elif x in ("fn", "async", "unsafe", "extern", "const") and self.function_likely():
            while t[self.i] in ("const", "async", "unsafe", "extern"):
                self.i += 1
                if t[self.i] == "STR":
                    self.i += 1
            self.function()
        elif x == "struct":
            self.i += 1
            self.need("ID")
            self.generics()
            if t[self.i] == "(":
                self.tuple_fields()
                self.where()
                self.need(";")
            else:
                self.where()
                if not self.opt(";"):
                    self.fields()
        elif x == "enum":
            self.i += 1
            self.need("ID")
            self.generics()
            self.where()
            self.need("{")
            while t[self.i] != "}":
                self.attributes()
                self.visibility()
                self.need("ID")
                if t[self.i] == "(":
                    self.tuple_fields()
                elif t[self.i] == "{":
                    self.fields()
                if self.opt("="):
                    self.expression()
                if t[self.i] != "}":
                    self.need(",")
            self.i += 1
        elif self.word("union") and t[self.i + 1] == "ID":
            self.i += 2
            self.generics()
            self.where()
            self.fields()
        elif x == "impl" or x == "unsafe" and t[self.i + 1] == "impl":
            self.opt("unsafe")
            self.i += 1
            if t[self.i] == "<":
                self.generics()
            self.opt("const")
            self.opt("!")
            self.type()
            if self.opt("for"):
                self.type()
            self.where()
            self.members()
        elif x == "trait" or x == "unsafe" and t[self.i + 1] == "trait":
            self.opt("unsafe")
            self.i += 1
            self.need("ID")
            self.generics()
            if self.opt(":"):
                self.bounds()
            self.where()
            self.members()
        elif x == "mod":
            self.i += 1
            self.need("ID")
            if not self.opt(";"):
                self.need("{")
                while t[self.i] != "}":
                    if t[self.i] == "EOF":
                        self.fail("unclosed module")
                    self.attributes()
                    if t[self.i] == "}":
                        break
                    if not self.item():
                        self.fail("expected an item")
                self.i += 1
        elif x == "use":
            self.i += 1
            self.use_tree()
            self.need(";")
        elif x == "extern":
            self.i += 1
            if self.opt("crate"):
                self.i += 1
                if self.opt("as"):
                    self.i += 1
                self.need(";")
            else:
                self.opt("STR")
                self.members()
        elif x == "type":
            self.i += 1
            self.need("ID")
            self.generics()
            if self.opt(":"):
                self.bounds()
            self.where()
            if self.opt("="):
                self.type()
            self.where()
            self.need(";")
        elif self.word("macro_rules") and t[self.i + 1] == "!":
            self.i += 2
            self.need("ID")
            brace = t[self.i] == "{"
            self.tree()
            if not brace:
                self.need(";")
        elif x in _PATH and self.i == begun and self.macro_item():
            pass
        else:
            self.i = begun
            return False
        return True

    def macro_item(self) -> bool:
        t, i = self.t, self.i
        while t[i] in _PATH or t[i] == "::":
            i += 1
        if t[i] != "!" or t[i + 1] not in _OPEN or self.in_body:
            return False
        self.i = i + 1
        brace = t[self.i] == "{"
        self.tree()
        if not brace:
            self.need(";")
        return True

    in_body = 0

    def function_likely(self) -> bool:
        t, i = self.t, self.i
        while t[i] in ("const", "async", "unsafe", "extern", "STR"):
            i += 1
        return t[i] == "fn"

    def constant(self) -> None:
        self.i += 1
        if self.opt(":"):
            self.type()
        if self.opt("="):
            self.expression()
        self.need(";")

    def function(self) -> None:
        self.need("fn")
        self.need("ID")
        self.generics()
        self.need("(")
        t = self.t
        while t[self.i] != ")":
            self.attributes()
            if self.opt("..."):
                continue
            if not self.attempt(self.receiver):
                if t[self.i] == "ID" and t[self.i + 1] == ":":
                    self.i += 2
                else:
                    self.pattern()
                    self.need(":")
                self.type()
            if t[self.i] != ")":
                self.need(",")
        self.i += 1
        if self.opt("->"):
            self.type()
        self.where()
        if not self.opt(";"):
            self.body()

    def receiver(self) -> None:
        t = self.t
        if self.opt("&") and t[self.i] == "LIFE":
            self.i += 1
        self.opt("mut")
        self.need("self")
        if self.opt(":"):
            self.type()

    def members(self) -> None:
        self.need("{")
        in_body, self.in_body = self.in_body, 0
        while self.t[self.i] != "}":
            if self.t[self.i] == "EOF":
                self.fail("unclosed body")
            self.attributes()
            if self.t[self.i] == "}":
                break
            if self.word("default") and self.t[self.i + 1] in ("fn", "type", "const", "async", "unsafe"):
                self.i += 1
            if not self.item():
                self.fail("expected an item")
        self.in_body = in_body
        self.i += 1

    def tuple_fields(self) -> None:
        self.need("(")
        while self.t[self.i] != ")":
            self.attributes()
            self.visibility()
            self.type()
            if self.t[self.i] != ")":
                self.need(",")
        self.i += 1

    def fields(self) -> None:
        self.need("{")
        while self.t[self.i] != "}":
            self.attributes()
            self.visibility()
            self.need("ID")
            self.need(":")
            self.type()
            if self.t[self.i] != "}":
                self.need(",")
        self.i += 1

    def use_tree(self) -> None:
        t = self.t
        self.opt("::")
        while True:
            if self.opt("*"):
                return
            if self.opt("{"):
                while t[self.i] != "}":
                    self.use_tree()
                    if t[self.i] != "}":
                        self.need(",")
                self.i += 1
                return
            if t[self.i] not in _PATH:
                self.fail("expected a name")
            self.i += 1
            if not self.opt("::"):
                break
        if self.opt("as"):
            self.i += 1

    def generics(self) -> None:
        t = self.t
        if t[self.i] != "<":
            return
        self.i += 1
        while t[self.i][:1] != ">":
            self.attributes()
            if self.opt("const"):
                self.need("ID")
                self.need(":")
                self.type()
                if self.opt("="):
                    self.unary()
            elif self.opt("LIFE"):
                if self.opt(":"):
                    self.bounds()
            else:
                self.need("ID")
                if self.opt(":"):
                    self.bounds()
                if self.opt("="):
                    self.type()
            if t[self.i][:1] != ">":
                self.need(",")
        self.close_angle()

    def where(self) -> None:
        t = self.t
        if not self.opt("where"):
            return
        while t[self.i] not in ("{", ";", "=", "EOF"):
            if self.opt("for"):
                self.generics()
            if not self.opt("LIFE"):
                self.type()
            self.need(":")
            self.bounds()
            if not self.opt(","):
                break

    def bounds(self) -> None:
        t = self.t
        while t[self.i] not in ("{", ";", "=", ",", ">", ")", "where", "EOF", ">>", "]"):
            if self.opt("LIFE"):
                pass
            else:
                grouped = self.opt("(")
                self.opt("?")
                self.opt("~")
                if self.opt("for"):
                    self.generics()
                self.type_path()
                if grouped:
                    self.need(")")
            if not self.opt("+"):
                break

    def type(self) -> None:
        t = self.t
        x = t[self.i]
        if x == "ID" and t[self.i + 1] in (",", ")", "{", ";", "="):
            self.i += 1
            return
        if x in ("&", "&&"):
            self.i += 1
            self.opt("LIFE")
            self.opt("mut")
            self.nested(self.type)
        elif x == "*":
            self.i += 1
            if t[self.i] not in ("const", "mut"):
                self.fail()
            self.i += 1
            self.type()
        elif x == "(":
            self.i += 1
            while t[self.i] != ")":
                self.nested(self.type)
                if t[self.i] != ")":
                    self.need(",")
            self.i += 1
        elif x == "[":
            self.i += 1
            self.nested(self.type)
            if self.opt(";"):
                self.expression()
            self.need("]")
        elif x in ("impl", "dyn"):
            self.i += 1
            self.bounds()
        elif x in ("fn", "unsafe", "extern", "for"):
            if self.opt("for"):
                self.generics()
            self.opt("unsafe")
            if self.opt("extern"):
                self.opt("STR")
            if t[self.i] != "fn":
                self.type_path()
                return
            self.i += 1
            self.need("(")
            while t[self.i] != ")":
                if t[self.i] == "ID" and t[self.i + 1] == ":":
                    self.i += 2
                self.type()
                if t[self.i] != ")":
                    self.need(",")
            self.i += 1
            if self.opt("->"):
                self.type()
        elif x == "!":
            self.i += 1
        elif x == "_" or x == "ID" and self.text() == "_":
            self.i += 1
        else:
            self.nested(self.type_path)
            if t[self.i] == "!" and t[self.i + 1] in _OPEN:
                self.i += 1
                self.tree()

    def type_path(self) -> None:
        t = self.t
        if t[self.i] in ("<", "<<"):
            self.qualified()
        else:
            self.opt("::")
            if t[self.i] not in _PATH:
                self.fail("expected a type")
            self.i += 1
        while True:
            if t[self.i] == "::" and t[self.i + 1] in _PATH:
                self.i += 2
            elif t[self.i] == "::" and t[self.i + 1] == "<":
                self.i += 1
            elif t[self.i] == "<" or t[self.i] == "<<":
                self.type_arguments()
            elif t[self.i] == "(" and self.k.src[self.k.start[self.i - 1] : self.k.end[self.i - 1]][:2] == "Fn":
                self.i += 1
                while t[self.i] != ")":
                    self.type()
                    if t[self.i] != ")":
                        self.need(",")
                self.i += 1
                if self.opt("->"):
                    self.type()
            else:
                return

    def qualified(self) -> None:
        self.need("<")
        self.type()
        if self.opt("as"):
            self.type_path()
        self.close_angle()

    def type_arguments(self) -> None:
        t = self.t
        self.need("<")
        while t[self.i][:1] != ">":
            if self.opt("LIFE"):
                pass
            elif t[self.i] in ("NUM", "STR", "{", "true", "false", "-"):
                self.block() if t[self.i] == "{" else self.unary()
            else:
                self.type()
                if self.opt("="):
                    self.type()
                elif self.opt(":"):
                    self.bounds()
            if t[self.i][:1] != ">":
                self.need(",")
        self.close_angle()

    def body(self) -> None:
        in_body, self.in_body = self.in_body, 1
        no_struct, self.no_struct = self.no_struct, False
        self.block()
        self.in_body, self.no_struct = in_body, no_struct

    def block(self) -> None:
        self.need("{")
        self.deep += 1
        if self.deep > self.DEEP:
            raise TooDeep
        t = self.t
        no_struct, self.no_struct = self.no_struct, False
        in_body, self.in_body = self.in_body, 1
        while t[self.i] != "}":
            if t[self.i] == "EOF":
                self.fail("unclosed block")
            self.inner()
        self.no_struct, self.in_body = no_struct, in_body
        self.i += 1
        self.deep -= 1

    def inner(self) -> None:
        t = self.t
        self.attributes()
        x = t[self.i]
        if x == ";":
            self.i += 1
        elif x == "let":
            self.i += 1
            self.pattern()
            if self.opt(":"):
                self.type()
            if self.opt("="):
                self.expression()
                if self.opt("else"):
                    self.block()
            self.need(";")
        elif x == "ID" and t[self.i + 1] != "!" and not self.word("macro_rules") and not self.word("union"):
            self.expression_statement(False)
        elif x in ("fn", "pub", "use", "struct", "enum", "impl", "trait", "mod", "const", "static", "type", "extern", "async", "unsafe", "ID") and self.item():
            pass
        elif x == "}":
            return
        else:
            self.expression_statement(x in _BLOCKLIKE or x == "LIFE")

    def expression_statement(self, blocklike: bool) -> None:
        t = self.t
        if blocklike:
            self.nested(self.block_expression)
            if t[self.i] in (".", "?"):
                self.postfix(False)
                self.binary_rest(0)
                self.assignment_rest()
                self.statement_end()
            elif t[self.i] == "as":
                self.binary_rest(0)
                self.statement_end()
            else:
                self.opt(";")
            return
        macro = t[self.i] == "ID" and t[self.i + 1] == "!" and t[self.i + 2] == "{"
        self.expression()
        if macro and self.t[self.i - 1] == "}":
            self.opt(";")
        else:
            self.statement_end()

    def statement_end(self) -> None:
        if not self.opt(";") and self.t[self.i] != "}":
            self.fail("expected ;")

    def block_expression(self) -> None:
        t = self.t
        if t[self.i] == "LIFE":
            self.i += 1
            self.need(":")
        x = t[self.i]
        if x == "{":
            self.block()
        elif x == "unsafe":
            self.i += 1
            self.block()
        elif x == "if":
            self.i += 1
            self.condition()
            self.block()
            while self.opt("else"):
                if t[self.i] != "if":
                    self.block()
                    break
                self.i += 1
                self.condition()
                self.block()
        elif x == "match":
            self.i += 1
            self.condition()
            self.need("{")
            no_struct, self.no_struct = self.no_struct, False
            in_body, self.in_body = self.in_body, 1
            while t[self.i] != "}":
                self.attributes()
                self.pattern()
                if self.opt("if"):
                    self.expression()
                self.need("=>")
                block = t[self.i] == "{"
                self.expression()
                if not self.opt(",") and t[self.i] != "}" and not (block and t[self.i - 1] == "}"):
                    self.fail("expected ,")
            self.no_struct, self.in_body = no_struct, in_body
            self.i += 1
        elif x == "loop":
            self.i += 1
            self.block()
        elif x == "while":
            self.i += 1
            self.condition()
            self.block()
        elif x == "for":
            self.i += 1
            self.pattern()
            self.need("in")
            self.condition()
            self.block()
        else:
            self.fail("expected a block")

    def condition(self) -> None:
        no_struct, self.no_struct = self.no_struct, True
        self.expression()
        self.no_struct = no_struct

    def pattern(self) -> None:
        self.opt("|")
        self.pattern_one()
        while self.opt("|"):
            self.pattern_one()

    def pattern_one(self) -> None:
        t = self.t
        x = t[self.i]
        if x in ("&", "&&"):
            self.i += 1
            self.opt("mut")
            self.nested(self.pattern_one)
        elif x in ("(", "["):
            self.i += 1
            while t[self.i] != _OPEN[x]:
                self.nested(self.pattern)
                if t[self.i] != _OPEN[x]:
                    self.need(",")
            self.i += 1
        elif x in ("..", "...", "..="):
            self.i += 1
            if t[self.i] in ("NUM", "STR", "-", "ID"):
                self.pattern_literal()
        elif x in ("NUM", "STR", "-", "true", "false"):
            self.pattern_literal()
            self.pattern_range()
        elif x in ("ref", "mut"):
            self.i += 1
            self.opt("mut")
            self.need("ID")
            if self.opt("@"):
                self.pattern_one()
        elif x == "_":
            self.i += 1
        elif x in _PATH or x == "::" or x == "<":
            self.path()
            if t[self.i] == "!" and t[self.i + 1] in _OPEN:
                self.i += 1
                self.tree()
            elif self.opt("@"):
                self.pattern_one()
            elif self.opt("("):
                while t[self.i] != ")":
                    self.nested(self.pattern)
                    if t[self.i] != ")":
                        self.need(",")
                self.i += 1
            elif t[self.i] == "{" :
                self.i += 1
                while t[self.i] != "}":
                    self.attributes()
                    if self.opt(".."):
                        break
                    self.opt("ref")
                    self.opt("mut")
                    if t[self.i] not in ("ID", "NUM"):
                        self.fail()
                    self.i += 1
                    if self.opt(":"):
                        self.nested(self.pattern)
                    if t[self.i] != "}":
                        self.need(",")
                self.need("}")
            else:
                self.pattern_range()
        else:
            self.fail("expected a pattern")

    def pattern_range(self) -> None:
        if self.t[self.i] in ("..=", "..", "..."):
            self.i += 1
            if self.t[self.i] in ("NUM", "STR", "-", "ID"):
                self.pattern_literal()

    def pattern_literal(self) -> None:
        self.opt("-")
        if self.t[self.i] == "ID":
            self.path()
        elif self.t[self.i] in ("NUM", "STR", "true", "false"):
            self.i += 1
        else:
            self.fail()

    def path(self) -> None:
        t = self.t
        if t[self.i] == "<":
            self.qualified()
            self.need("::")
        else:
            self.opt("::")
        if t[self.i] not in _PATH:
            self.fail("expected a path")
        self.i += 1
        while t[self.i] == "::":
            self.i += 1
            if t[self.i] in ("<", "<<"):
                self.type_arguments()
            elif t[self.i] in _PATH:
                self.i += 1
            else:
                self.fail("expected a path")

    def expression(self) -> None:
        t = self.t
        if t[self.i] in ("ID", "NUM", "STR") and t[self.i + 1] in (")", ",", ";", "]"):
            self.i += 1
            return
        self.attributes()
        self.nested(self.range)
        self.assignment_rest()

    def assignment_rest(self) -> None:
        if self.t[self.i] in _ASSIGN:
            self.i += 1
            self.expression()

    def ends(self) -> bool:
        x = self.t[self.i]
        return x in (")", "]", "}", ",", ";", "=>", "EOF") or x == "{" and self.no_struct

    def range(self) -> None:
        t = self.t
        if t[self.i] in ("..", "..="):
            self.i += 1
            if not self.ends():
                self.binary(2)
            return
        self.binary(2)
        if t[self.i] in ("..", "..="):
            self.i += 1
            if not self.ends():
                self.binary(2)

    def binary(self, least: int) -> None:
        if self.t[self.i] == "let":
            self.i += 1
            self.pattern()
            self.need("=")
            no_struct, self.no_struct = self.no_struct, True
            self.binary(4)
            self.no_struct = no_struct
        else:
            self.unary()
        self.binary_rest(least)

    def binary_rest(self, least: int) -> None:
        t = self.t
        while True:
            x = t[self.i]
            if x == "as":
                self.i += 1
                self.type()
                continue
            p = _BINARY.get(x)
            if p is None or p < least:
                return
            self.i += 1
            if p == 4:
                self.binary(5)
            else:
                self.binary(p + 1)

    def unary(self) -> None:
        t = self.t
        x = t[self.i]
        if x in ("-", "!", "*"):
            self.i += 1
            self.nested(self.unary)
        elif x in ("&", "&&"):
            self.i += 1
            if self.word("raw") and t[self.i + 1] in ("const", "mut"):
                self.i += 2
            self.opt("mut")
            self.nested(self.unary)
        else:
            self.primary()
            self.postfix(True)

    def postfix(self, calls: bool) -> None:
        t = self.t
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                y = t[self.i]
                if y not in ("ID", "NUM", "await"):
                    self.fail("expected a name")
                self.i += 1
                if t[self.i] == "::":
                    self.i += 1
                    self.type_arguments()
                calls = True
            elif x == "(" and calls:
                self.nested(self.arguments)
            elif x == "[" and calls:
                self.i += 1
                no_struct, self.no_struct = self.no_struct, False
                self.expression()
                self.no_struct = no_struct
                self.need("]")
            elif x == "?":
                self.i += 1
            else:
                return

    def arguments(self, close: str = ")") -> None:
        self.i += 1
        t = self.t
        no_struct, self.no_struct = self.no_struct, False
        while t[self.i] != close:
            if t[self.i] in ("NUM", "STR") and t[self.i + 1] == ",":
                self.i += 2
                continue
            self.expression()
            if t[self.i] != close:
                if close == "]" and self.opt(";"):
                    continue
                self.need(",")
        self.no_struct = no_struct
        self.i += 1

    def primary(self) -> None:
        t = self.t
        x = t[self.i]
        if x in ("NUM", "STR", "true", "false", "_"):
            self.i += 1
        elif x in _PATH or x in ("::", "<"):
            self.path()
            if t[self.i] == "!" and t[self.i + 1] in _OPEN:
                self.i += 1
                self.tree()
            elif t[self.i] == "{" and not self.no_struct and (t[self.i - 1] in _PATH or t[self.i - 1] == ">"):
                self.nested(self.struct_literal)
        elif x == "(":
            self.nested(self.arguments)
        elif x == "[":
            self.nested(lambda: self.arguments("]"))
        elif x in _BLOCKLIKE or x == "LIFE":
            self.nested(self.block_expression)
        elif x in ("|", "||", "move", "static") or x == "async":
            self.opt("static")
            self.opt("async")
            self.opt("move")
            if t[self.i] == "{":
                self.block()
            elif self.opt("||"):
                self.closure_body()
            else:
                self.need("|")
                while t[self.i] != "|":
                    self.attributes()
                    self.pattern_one()
                    if self.opt(":"):
                        self.type()
                    if t[self.i] != "|":
                        self.need(",")
                self.i += 1
                self.closure_body()
        elif x in ("return", "break"):
            self.i += 1
            if x == "break":
                self.opt("LIFE")
            if not self.ends():
                self.expression()
        elif x == "continue":
            self.i += 1
            self.opt("LIFE")
        elif x == "const" and t[self.i + 1] == "{":
            self.i += 1
            self.block()
        else:
            self.fail("expected an expression")

    def closure_body(self) -> None:
        if self.opt("->"):
            self.type()
            self.block()
        else:
            self.expression()

    def struct_literal(self) -> None:
        self.need("{")
        t = self.t
        while t[self.i] != "}":
            self.attributes()
            if self.opt(".."):
                if t[self.i] != "}":
                    self.expression()
                break
            if t[self.i] not in ("ID", "NUM"):
                self.fail("expected a field")
            self.i += 1
            if self.opt(":"):
                self.expression()
            if t[self.i] != "}":
                self.need(",")
        self.need("}")
