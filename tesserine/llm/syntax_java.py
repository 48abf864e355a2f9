"""Java: recursive-descent statements, precedence-climbing expressions."""

from __future__ import annotations

from tesserine.llm.syntax_base import Checker, TooDeep

# Binding strength of the binary operators, primitive types and modifiers.
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
_PRIMITIVE = frozenset("boolean byte char short int long float double".split())
_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default".split())
_LITERAL = frozenset(["NUM", "STR", "true", "false", "null", "this", "super"])


class JavaChecker(Checker):
    """Declarations until EOF."""

    SYNC = frozenset("public private protected class interface enum import package static final abstract".split())

    def statement(self) -> None:
        t = self.t
        x = t[self.i]
        if x == ";":
            self.i += 1
        elif x == "package" or x == "@" and self.attempt(self.annotated_package):
            if x == "package":
                self.i += 1
                self.qualified()
                self.need(";")
        elif x == "import":
            self.i += 1
            self.opt("static")
            self.need("ID")
            while self.opt("."):
                if self.opt("*"):
                    break
                self.need("ID")
            self.need(";")
        else:
            self.modifiers()
            if not self.type_declaration():
                self.fail("expected a declaration")

    def annotated_package(self) -> None:
        self.modifiers()
        self.need("package")
        self.qualified()
        self.need(";")

    def qualified(self) -> None:
        self.need("ID")
        while self.opt("."):
            self.need("ID")

    def modifiers(self) -> None:
        t = self.t
        while True:
            x = t[self.i]
            if x in _MODIFIERS and not (x == "default" and t[self.i + 1] in (":", "->")) and not (x in ("synchronized",) and t[self.i + 1] == "("):
                self.i += 1
            elif x == "@" and t[self.i + 1] != "interface":
                self.i += 1
                self.qualified()
                if t[self.i] == "(":
                    self.annotation_arguments()
            elif x == "ID" and t[self.i + 1] in ("class", "interface", "ID", "public", "abstract", "-") and self.text() in ("sealed", "non"):
                self.i += 1
                if self.opt("-"):
                    self.need("ID")
            else:
                return

    def annotation_arguments(self) -> None:
        self.i += 1
        t = self.t
        while t[self.i] != ")":
            if t[self.i] == "ID" and t[self.i + 1] == "=":
                self.i += 2
            self.annotation_value()
            if t[self.i] != ")":
                self.need(",")
        self.i += 1

    def annotation_value(self) -> None:
        if self.t[self.i] == "{":
            self.i += 1
            while self.t[self.i] != "}":
                self.annotation_value()
                if self.t[self.i] != "}":
                    self.need(",")
            self.i += 1
        elif self.t[self.i] == "@":
            self.modifiers()
        else:
            self.expression()

    def type_declaration(self) -> bool:
        t = self.t
        x = t[self.i]
        if x == "class":
            self.i += 1
            self.need("ID")
            self.type_parameters()
            if self.opt("extends"):
                self.type()
            self.super_types()
            self.class_body()
        elif x == "interface" or x == "@":
            if x == "@":
                self.i += 1
            self.i += 1
            self.need("ID")
            self.type_parameters()
            if self.opt("extends"):
                self.type()
                while self.opt(","):
                    self.type()
            self.super_types()
            self.class_body()
        elif x == "enum":
            self.i += 1
            self.need("ID")
            self.super_types()
            self.need("{")
            while t[self.i] in ("ID", "@"):
                self.modifiers()
                self.need("ID")
                if t[self.i] == "(":
                    self.arguments()
                if t[self.i] == "{":
                    self.class_body()
                if not self.opt(","):
                    break
            if self.opt(";"):
                while t[self.i] != "}":
                    self.member()
            self.need("}")
        elif self.word("record") and t[self.i + 1] == "ID" and t[self.i + 2] in ("(", "<"):
            self.i += 2
            self.type_parameters()
            self.parameters()
            self.super_types()
            self.class_body()
        else:
            return False
        return True

    def super_types(self) -> None:
        while self.t[self.i] == "implements" or self.word("permits"):
            self.i += 1
            self.type()
            while self.opt(","):
                self.type()

    def type_parameters(self) -> None:
        if not self.opt("<"):
            return
        while True:
            self.modifiers()
            self.need("ID")
            if self.opt("extends"):
                self.type()
                while self.opt("&"):
                    self.type()
            if not self.opt(","):
                break
        self.need(">")

    def class_body(self) -> None:
        self.need("{")
        while self.t[self.i] != "}":
            if self.t[self.i] == "EOF":
                self.fail("unclosed class")
            self.nested(self.member)
        self.i += 1

    def member(self) -> None:
        t = self.t
        if self.opt(";"):
            return
        if t[self.i] == "{" or t[self.i] == "static" and t[self.i + 1] == "{":
            self.opt("static")
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        if t[self.i] == "ID" and t[self.i + 1] in ("(", "{"):
            self.i += 1
            if t[self.i] == "(":
                self.parameters()
            self.throws()
            self.block()
            return
        if not self.opt("void"):
            self.type()
        self.need("ID")
        if t[self.i] == "(":
            self.parameters()
            self.dims()
            self.throws()
            if self.opt("default"):
                self.annotation_value()
            if t[self.i] == "{":
                self.block()
            else:
                self.need(";")
        else:
            self.declarators()
            self.need(";")

    def throws(self) -> None:
        if self.opt("throws"):
            self.type()
            while self.opt(","):
                self.type()

    def parameters(self) -> None:
        self.need("(")
        t = self.t
        while t[self.i] != ")":
            self.modifiers()
            self.type()
            self.opt("...")
            if not self.opt("this"):
                self.need("ID")
                self.dims()
            if t[self.i] != ")":
                self.need(",")
        self.i += 1

    def dims(self) -> None:
        while self.t[self.i] == "[" and self.t[self.i + 1] == "]":
            self.i += 2

    def declarators(self) -> None:
        """What follows the first name of a variable declaration."""
        while True:
            self.dims()
            if self.opt("="):
                self.initializer()
            if not self.opt(","):
                return
            self.need("ID")

    def initializer(self) -> None:
        if self.t[self.i] == "{":
            self.array()
        else:
            self.expression()

    def array(self) -> None:
        self.i += 1
        t = self.t
        while t[self.i] != "}":
            if t[self.i] in ("NUM", "STR") and t[self.i + 1] == ",":
                self.i += 2
                continue
            self.initializer()
            if t[self.i] != "}":
                self.need(",")
        self.i += 1

    def type(self) -> None:
        t = self.t
        while t[self.i] == "@":
            self.modifiers()
        if t[self.i] in _PRIMITIVE:
            self.i += 1
        elif t[self.i] == "?":
            self.i += 1
            if t[self.i] in ("extends", "super"):
                self.i += 1
                self.type()
            return
        else:
            self.need("ID")
            self.type_arguments()
            while t[self.i] == "." and t[self.i + 1] == "ID":
                self.i += 2
                self.type_arguments()
        self.dims()

    def type_arguments(self) -> None:
        if self.t[self.i] != "<":
            return
        self.i += 1
        if not self.opt(">"):
            self.type()
            while self.opt("&"):
                self.type()
            while self.opt(","):
                self.type()
            self.need(">")

    def block(self) -> None:
        self.need("{")
        self.deep += 1
        if self.deep > self.DEEP:
            raise TooDeep
        t = self.t
        while t[self.i] != "}":
            if t[self.i] == "EOF":
                self.fail("unclosed block")
            self.inner()
        self.i += 1
        self.deep -= 1

    def declaration_head(self) -> None:
        self.type()
        self.need("ID")
        if self.t[self.i] not in ("=", ";", ",", ":", "["):
            self.fail()

    def inner(self) -> None:
        t = self.t
        x = t[self.i]
        f = self.STATEMENTS.get(x)
        if f:
            f(self)
            return
        if x == "ID":
            y = t[self.i + 1]
            if y == ":":
                self.i += 2
                self.inner()
                return
            if y == "(":
                self.expression()
                self.need(";")
                return
            w = self.text()
            if w == "yield" and y not in ("=", ".", "[", "++", "--"):
                self.i += 1
                self.expression()
                self.need(";")
                return
            if w in ("record", "sealed") and y in ("ID", "class", "interface") and self.attempt(self.local_class):
                return
        if x in ("final", "abstract", "class", "interface", "enum", "@", "strictfp", "static"):
            self.modifiers()
            if self.type_declaration():
                return
            self.type()
            self.need("ID")
            self.declarators()
            self.need(";")
            return
        if (x == "ID" or x in _PRIMITIVE) and self.attempt(self.declaration_head):
            self.declarators()
            self.need(";")
            return
        self.expression()
        self.need(";")

    def local_class(self) -> None:
        self.modifiers()
        if not self.type_declaration():
            self.fail()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def if_(self) -> None:
        self.i += 1
        self.condition()
        self.nested(self.inner)
        while self.opt("else"):
            if self.t[self.i] != "if":
                self.nested(self.inner)
                break
            self.i += 1
            self.condition()
            self.nested(self.inner)

    def while_(self) -> None:
        self.i += 1
        self.condition()
        self.nested(self.inner)

    def do_(self) -> None:
        self.i += 1
        self.nested(self.inner)
        self.need("while")
        self.condition()
        self.need(";")

    def for_(self) -> None:
        self.i += 1
        self.need("(")
        t = self.t
        if t[self.i] != ";":
            self.modifiers()
            if self.attempt(self.declaration_head):
                if self.opt(":"):
                    self.expression()
                    self.need(")")
                    self.nested(self.inner)
                    return
                self.declarators()
            else:
                self.expressions()
        self.need(";")
        if t[self.i] != ";":
            self.expression()
        self.need(";")
        if t[self.i] != ")":
            self.expressions()
        self.need(")")
        self.nested(self.inner)

    def expressions(self) -> None:
        self.expression()
        while self.opt(","):
            self.expression()

    def return_(self) -> None:
        self.i += 1
        if self.t[self.i] != ";":
            self.expression()
        self.need(";")

    def throw(self) -> None:
        self.i += 1
        self.expression()
        self.need(";")

    def jump(self) -> None:
        self.i += 1
        self.opt("ID")
        self.need(";")

    def try_(self) -> None:
        self.i += 1
        t = self.t
        ok = False
        if self.opt("("):
            ok = True
            while t[self.i] != ")":
                self.modifiers()
                if self.attempt(self.declaration_head):
                    self.declarators()
                else:
                    self.expression()
                if t[self.i] != ")":
                    self.need(";")
            self.i += 1
        self.block()
        while self.opt("catch"):
            ok = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.opt("|"):
                self.type()
            self.need("ID")
            self.need(")")
            self.block()
        if self.opt("finally"):
            ok = True
            self.block()
        if not ok:
            self.fail("expected catch or finally")

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        t = self.t
        while t[self.i] != "}":
            if self.opt("case"):
                while True:
                    if not self.opt("default") and not self.attempt(self.case_pattern):
                        self.conditional()
                    if not self.opt(","):
                        break
                if self.word("when"):
                    self.i += 1
                    self.expression()
            else:
                self.need("default")
            if self.opt("->"):
                if t[self.i] in ("{", "throw"):
                    self.inner()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while t[self.i] not in ("case", "default", "}"):
                    if t[self.i] == "EOF":
                        self.fail()
                    self.inner()
        self.i += 1

    def case_pattern(self) -> None:
        self.pattern()
        if self.t[self.i] not in ("->", ":", ",") and not self.word("when"):
            self.fail()

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.opt("("):
            while self.t[self.i] != ")":
                self.pattern()
                if self.t[self.i] != ")":
                    self.need(",")
            self.i += 1
            self.opt("ID")
        else:
            self.need("ID")

    def synchronized(self) -> None:
        self.i += 1
        self.condition()
        self.block()

    def assert_(self) -> None:
        self.i += 1
        self.expression()
        if self.opt(":"):
            self.expression()
        self.need(";")

    def empty(self) -> None:
        self.i += 1

    STATEMENTS = {"{": block, ";": empty, "if": if_, "while": while_, "do": do_, "for": for_, "return": return_, "throw": throw, "break": jump, "continue": jump, "try": try_, "switch": switch, "synchronized": synchronized, "assert": assert_}

    def expression(self) -> None:
        t = self.t
        if t[self.i] in ("ID", "NUM", "STR") and t[self.i + 1] in (")", ",", ";"):
            self.i += 1
            return
        target = self.nested(self.conditional)
        if t[self.i] in _ASSIGN or t[self.i] == ">" and t[self.i + 1] in (">=", ">>="):
            if not target:
                self.fail("invalid assignment target")
            self.i += 1
            self.initializer() if t[self.i] == "{" else self.nested(self.expression)

    def conditional(self) -> bool:
        target = self.binary(1)
        if self.t[self.i] == "?":
            self.i += 1
            self.expression()
            self.need(":")
            if self.lambda_likely():
                self.expression()
            else:
                self.nested(self.conditional)
            return False
        return target

    def binary(self, least: int) -> bool:
        t = self.t
        target = self.unary()
        while True:
            x = t[self.i]
            p = _BINARY.get(x)
            if p is None:
                return target
            if x == ">" and t[self.i + 1] == ">" and self.k.start[self.i + 1] == self.k.end[self.i]:
                p = 8
                if p < least:
                    return target
                self.i += 2
                self.opt(">")
            elif p < least:
                return target
            else:
                self.i += 1
            if x == "instanceof":
                if not self.attempt(self.pattern):
                    self.modifiers()
                    self.type()
            else:
                self.binary(p + 1)
            target = False

    def lambda_likely(self) -> bool:
        t, i = self.t, self.i
        if t[i] == "ID":
            return t[i + 1] == "->"
        if t[i] != "(":
            return False
        depth = 0
        while t[i] != "EOF":
            depth += (t[i] == "(") - (t[i] == ")")
            i += 1
            if not depth:
                return t[i] == "->"
        return False

    def lambda_(self) -> None:
        t = self.t
        if not self.opt("ID"):
            self.i += 1
            while t[self.i] != ")":
                if t[self.i] == "ID" and t[self.i + 1] in (",", ")"):
                    self.i += 1
                else:
                    self.modifiers()
                    self.type()
                    self.opt("...")
                    self.need("ID")
                if t[self.i] != ")":
                    self.need(",")
            self.i += 1
        self.need("->")
        if t[self.i] == "{":
            self.block()
        else:
            self.expression()

    def cast(self) -> None:
        self.need("(")
        primitive = self.t[self.i] in _PRIMITIVE
        self.type()
        while self.opt("&"):
            self.type()
        self.need(")")
        x = self.t[self.i]
        if not (x in ("ID", "(", "!", "~", "new", "switch") or x in _LITERAL or x in _PRIMITIVE or primitive and x in ("+", "-", "++", "--")):
            self.fail()
        self.unary()

    def unary(self) -> bool:
        t = self.t
        x = t[self.i]
        if x in ("+", "-", "!", "~", "++", "--"):
            self.i += 1
            self.nested(self.unary)
            return False
        if x == "(":
            if self.lambda_likely():
                self.nested(self.lambda_)
                return False
            if self.attempt(self.cast):
                return False
        elif x == "ID" and t[self.i + 1] == "->":
            self.nested(self.lambda_)
            return False
        target = self.primary()
        while t[self.i] in ("++", "--"):
            self.i += 1
            target = False
        return target

    def primary(self) -> bool:
        t = self.t
        x = t[self.i]
        target = False
        if x == "ID":
            self.i += 1
            target = True
            if t[self.i] == "<" and self.attempt(self.generic_reference):
                target = False
            elif t[self.i] == "[" and t[self.i + 1] == "]":
                self.dims()
                if t[self.i] not in ("::", "."):
                    self.fail()
        elif x in _LITERAL:
            self.i += 1
        elif x == "(":
            self.i += 1
            self.nested(self.expression)
            self.need(")")
        elif x == "new":
            self.nested(self.new)
        elif x == "switch":
            self.nested(self.switch)
        elif x in _PRIMITIVE or x == "void":
            self.i += 1
            self.dims()
            if t[self.i] not in (".", "::"):
                self.fail()
        else:
            self.fail("expected an expression")
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                self.type_arguments()
                if t[self.i] == "new":
                    self.new()
                elif t[self.i] in ("ID", "class", "this", "super"):
                    self.i += 1
                else:
                    self.fail("expected a name")
                target = True
            elif x == "(":
                self.nested(self.arguments)
                target = False
            elif x == "[":
                self.i += 1
                self.nested(self.expression)
                self.need("]")
                target = True
            elif x == "::":
                self.i += 1
                self.type_arguments()
                if t[self.i] not in ("ID", "new"):
                    self.fail()
                self.i += 1
                target = False
            else:
                return target

    def generic_reference(self) -> None:
        self.type_arguments()
        self.dims()
        if self.t[self.i] != "::":
            self.fail()

    def new(self) -> None:
        self.i += 1
        t = self.t
        self.type_arguments()
        self.modifiers()
        if t[self.i] in _PRIMITIVE:
            self.i += 1
        else:
            self.need("ID")
            self.type_arguments()
            while self.opt("."):
                self.need("ID")
                self.type_arguments()
        if t[self.i] == "[":
            sized = False
            while t[self.i] == "[":
                self.i += 1
                if t[self.i] != "]":
                    self.expression()
                    sized = True
                self.need("]")
            if t[self.i] == "{":
                self.array()
            elif not sized:
                self.fail()
        else:
            self.arguments()
            if t[self.i] == "{":
                self.class_body()

    def arguments(self) -> None:
        self.need("(")
        t = self.t
        while t[self.i] != ")":
            self.expression()
            if t[self.i] != ")":
                self.need(",")
                if t[self.i] == ")":
                    self.fail()
        self.i += 1
