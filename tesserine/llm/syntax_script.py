"""JavaScript and TypeScript, read as modules: recursive-descent statements, precedence-climbing expressions."""

from __future__ import annotations

from tesserine.llm.syntax_base import Checker, TooDeep

# Binding strength of the binary operators.
_BINARY = {"??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_PREFIX = frozenset(["!", "~", "+", "-", "typeof", "void", "delete", "await"])
_LITERAL = frozenset(["NUM", "STR", "REGEX", "JSX", "true", "false", "null"])
_MODIFIERS = frozenset("public private protected readonly static abstract override declare accessor async get set".split())
TARGET, PATTERN, OTHER = 0, 1, 2


class ScriptChecker(Checker):
    """Statements until EOF."""

    SYNC = frozenset("const var function class if for while do return throw try switch import export interface".split())

    def __init__(self, tokens, typed: bool = False) -> None:
        super().__init__(tokens)
        self.typed = typed
        self.no_in = False
        for sub in tokens.subs:
            inner = type(self)(sub, typed)
            inner.t = [*sub.types, "EOF"]
            inner.nl = [*sub.nl, True]
            sub.start.append(sub.end[-1])
            sub.end.append(sub.end[-1])
            if not inner.attempt(inner.embedded):
                self.errors.append((sub.start[0], "invalid embedded expression"))
            self.errors += sub.errors

    def embedded(self) -> None:
        self.opt("...")
        self.expression()
        self.need("}")

    def semicolon(self) -> None:
        x = self.t[self.i]
        if x == ";":
            self.i += 1
        elif x != "}" and x != "EOF" and not self.nl[self.i]:
            self.fail("expected ;")

    def name(self) -> None:
        """An identifier; words reserved in only some places count."""
        if self.t[self.i] not in ("ID", "yield", "await"):
            self.fail("expected a name")
        self.i += 1

    def statement(self) -> None:
        t = self.t
        x = t[self.i]
        f = self.STATEMENTS.get(x)
        if f:
            f(self)
        elif x == "ID":
            y = t[self.i + 1]
            if y == ":":
                self.i += 2
                self.statement()
                return
            if y in ("ID", "[", "{", "STR", "function", "class", "enum", "yield", "await"):
                w = self.text()
                if w == "let" and y != "STR":
                    self.variables()
                    self.semicolon()
                    return
                if w == "async" and y == "function" and not self.nl[self.i + 1]:
                    self.i += 1
                    self.function()
                    return
                if self.typed and w in ("interface", "type", "namespace", "module", "declare", "abstract", "global") and not self.nl[self.i + 1]:
                    if self.attempt(lambda: self.typed_statement(w)):
                        return
                    self.typed_statement(w)
                    return
            self.expression()
            self.semicolon()
        else:
            self.expression()
            self.semicolon()

    def block(self) -> None:
        self.need("{")
        self.deep += 1
        if self.deep > self.DEEP:
            raise TooDeep
        t = self.t
        while t[self.i] != "}":
            if t[self.i] == "EOF":
                self.fail("unclosed block")
            self.statement()
        self.i += 1
        self.deep -= 1

    def variables(self) -> None:
        self.i += 1
        t = self.t
        if self.typed and t[self.i] == "enum":
            self.enum()
            return
        while True:
            if t[self.i] == "ID" or t[self.i] in ("yield", "await"):
                self.i += 1
                pattern = False
            else:
                self.binding()
                pattern = True
            if self.typed:
                self.opt("!")
                if self.opt(":"):
                    self.type()
            if self.opt("="):
                self.assign()
            elif pattern and not (t[self.i] == "in" or self.word("of")):
                self.fail("pattern without initializer")
            if not self.opt(","):
                return

    def binding(self) -> None:
        t = self.t
        if self.opt("["):
            while t[self.i] != "]":
                if t[self.i] == ",":
                    self.i += 1
                    continue
                self.opt("...")
                self.binding()
                if self.opt("="):
                    self.assign()
                if t[self.i] != "]":
                    self.need(",")
            self.i += 1
        elif self.opt("{"):
            while t[self.i] != "}":
                if self.opt("..."):
                    self.binding()
                elif t[self.i] == "[":
                    self.i += 1
                    self.assign()
                    self.need("]")
                    self.need(":")
                    self.binding()
                elif t[self.i + 1] == ":":
                    self.property_name()
                    self.i += 1
                    self.binding()
                else:
                    self.name()
                if self.opt("="):
                    self.assign()
                if t[self.i] != "}":
                    self.need(",")
            self.i += 1
        else:
            self.name()

    def function(self) -> None:
        self.need("function")
        self.opt("*")
        if self.t[self.i] != "(" and self.t[self.i] != "<":
            self.name()
        self.signature()
        if self.typed and self.t[self.i] != "{":
            self.semicolon()
        else:
            self.block()

    def signature(self) -> None:
        if self.typed and self.t[self.i] == "<":
            self.type_parameters()
        self.need("(")
        self.parameters()
        if self.typed and self.opt(":"):
            self.return_type()

    def return_type(self) -> None:
        if self.word("asserts") and self.t[self.i + 1] in ("ID", "this"):
            self.i += 1
        if self.t[self.i] in ("ID", "this") and self.word("is", 1):
            self.i += 2
        self.type()

    def parameters(self) -> None:
        """Parameters and the closing bracket."""
        t = self.t
        while t[self.i] != ")":
            while self.opt("@"):
                self.decorator()
            rest = self.opt("...")
            if self.typed:
                while t[self.i] == "ID" and self.text() in _MODIFIERS and t[self.i + 1] in ("ID", "{", "["):
                    self.i += 1
                if t[self.i] == "this":
                    self.i += 1
                else:
                    self.binding()
                self.opt("?")
                if self.opt(":"):
                    self.type()
            elif t[self.i] == "ID":
                self.i += 1
            else:
                self.binding()
            if self.opt("="):
                self.assign()
            if t[self.i] != ")":
                if rest:
                    self.fail()
                self.need(",")
        self.i += 1

    def decorator(self) -> None:
        if self.opt("("):
            self.expression()
            self.need(")")
        else:
            self.name()
        while self.t[self.i] in (".", "("):
            if self.opt("."):
                self.i += 1
            else:
                self.arguments()

    def class_(self) -> None:
        while self.opt("@"):
            self.decorator()
        if self.t[self.i] == "export":
            self.i += 1
            self.opt("default")
        if self.word("abstract"):
            self.i += 1
        self.need("class")
        t = self.t
        if t[self.i] == "ID" and not self.word("implements"):
            self.i += 1
        if self.typed and t[self.i] == "<":
            self.type_parameters()
        if self.opt("extends"):
            self.unary()
            if self.typed and t[self.i] == "<":
                self.type_arguments()
        if self.typed and self.word("implements"):
            self.i += 1
            self.type()
            while self.opt(","):
                self.type()
        self.need("{")
        while t[self.i] != "}":
            if t[self.i] == "EOF":
                self.fail("unclosed class")
            if not self.opt(";"):
                self.nested(self.member)
        self.i += 1

    def member(self) -> None:
        t = self.t
        while self.opt("@"):
            self.decorator()
        if self.word("static") and t[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        while t[self.i] == "ID" and self.text() in _MODIFIERS and t[self.i + 1] not in ("(", "=", ";", "}", ":", "?", "!", "<", ",") and (self.typed or self.text() in ("static", "async", "get", "set", "accessor")):
            if self.nl[self.i + 1] and self.text() not in ("static", "public", "private", "protected", "abstract", "readonly"):
                break
            self.i += 1
        self.opt("*")
        if self.typed and t[self.i] == "[" and t[self.i + 1] == "ID" and t[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.need("]")
            self.need(":")
            self.type()
            self.semicolon()
            return
        self.property_name()
        if self.typed:
            self.opt("?")
            self.opt("!")
        if t[self.i] in ("(", "<"):
            self.signature()
            if self.typed and t[self.i] != "{":
                self.semicolon()
            else:
                self.block()
            return
        if self.typed and self.opt(":"):
            self.type()
        if self.opt("="):
            self.assign()
        self.semicolon()

    def property_name(self) -> None:
        x = self.t[self.i]
        if x == "[":
            self.i += 1
            self.assign()
            self.need("]")
        elif x == "#":
            self.i += 1
            self.name()
        elif x in ("STR", "NUM", "ID") or x.isalpha() and x not in ("EOF", "BAD", "TPL", "REGEX", "JSX"):
            self.i += 1
        else:
            self.fail("expected a property name")

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while self.t[self.i] != "}":
            self.property_name()
            if self.opt("="):
                self.assign()
            if self.t[self.i] != "}":
                self.need(",")
        self.i += 1

    def typed_statement(self, w: str) -> None:
        self.i += 1
        t = self.t
        if w == "interface":
            self.name()
            if t[self.i] == "<":
                self.type_parameters()
            if self.opt("extends"):
                self.type()
                while self.opt(","):
                    self.type()
            self.object_type()
        elif w == "type":
            self.name()
            if t[self.i] == "<":
                self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
        elif w == "abstract":
            self.class_()
        elif w == "declare":
            if self.word("global") or self.word("module"):
                self.i += 1
                if t[self.i] in ("STR", "ID"):
                    self.i += 1
                self.block() if t[self.i] == "{" else self.semicolon()
            else:
                self.statement()
        else:
            while t[self.i] in ("ID", "."):
                self.i += 1
            if t[self.i] == "STR":
                self.i += 1
            self.block()

    def if_(self) -> None:
        self.i += 1
        self.condition()
        self.nested(self.statement)
        while self.opt("else"):
            if self.t[self.i] != "if":
                self.nested(self.statement)
                break
            self.i += 1
            self.condition()
            self.nested(self.statement)

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def for_(self) -> None:
        self.i += 1
        t = self.t
        self.opt("await")
        self.need("(")
        if t[self.i] != ";":
            self.no_in = True
            if t[self.i] in ("const", "var") or self.word("let") and t[self.i + 1] in ("ID", "[", "{"):
                self.variables()
            else:
                self.expression()
            self.no_in = False
            if t[self.i] == "in" or self.word("of"):
                self.i += 1
                self.expression()
                self.need(")")
                self.nested(self.statement)
                return
        self.need(";")
        if t[self.i] != ";":
            self.expression()
        self.need(";")
        if t[self.i] != ")":
            self.expression()
        self.need(")")
        self.nested(self.statement)

    def while_(self) -> None:
        self.i += 1
        self.condition()
        self.nested(self.statement)

    def do_(self) -> None:
        self.i += 1
        self.nested(self.statement)
        self.need("while")
        self.condition()
        self.opt(";")

    def return_(self) -> None:
        self.i += 1
        if self.t[self.i] not in (";", "}", "EOF") and not self.nl[self.i]:
            self.expression()
        self.semicolon()

    def jump(self) -> None:
        self.i += 1
        if self.t[self.i] == "ID" and not self.nl[self.i]:
            self.i += 1
        self.semicolon()

    def throw(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            self.fail()
        self.expression()
        self.semicolon()

    def try_(self) -> None:
        self.i += 1
        self.block()
        ok = False
        if self.opt("catch"):
            ok = True
            if self.opt("("):
                self.binding()
                if self.typed and self.opt(":"):
                    self.type()
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
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while t[self.i] not in ("case", "default", "}"):
                if t[self.i] == "EOF":
                    self.fail()
                self.nested(self.statement)
        self.i += 1

    def specifiers(self) -> None:
        self.need("{")
        while self.t[self.i] != "}":
            if self.word("type") and self.t[self.i + 1] == "ID" and self.typed:
                self.i += 1
            self.property_name()
            if self.word("as"):
                self.i += 1
                self.property_name()
            if self.t[self.i] != "}":
                self.need(",")
        self.i += 1

    def source(self) -> None:
        self.need("STR")
        if self.t[self.i] == "with" or self.word("assert") and not self.nl[self.i]:
            self.i += 1
            self.object_()
        self.semicolon()

    def import_(self) -> None:
        t = self.t
        if t[self.i + 1] in ("(", "."):
            self.expression()
            self.semicolon()
            return
        self.i += 1
        if t[self.i] == "STR":
            self.source()
            return
        if self.typed and self.word("type") and (t[self.i + 1] in ("{", "*") or t[self.i + 1] == "ID" and not self.word("from", 1)):
            self.i += 1
        if t[self.i] == "ID":
            self.i += 1
            if self.typed and self.opt("="):
                self.expression()
                self.semicolon()
                return
            if self.opt(","):
                self.import_rest()
        else:
            self.import_rest()
        if not self.word("from"):
            self.fail("expected from")
        self.i += 1
        self.source()

    def import_rest(self) -> None:
        if self.opt("*"):
            if not self.word("as"):
                self.fail()
            self.i += 1
            self.name()
        else:
            self.specifiers()

    def export(self) -> None:
        self.i += 1
        t = self.t
        x = t[self.i]
        if x == "default":
            self.i += 1
            if t[self.i] == "function":
                self.function()
            elif t[self.i] in ("class", "@") or self.word("abstract") and t[self.i + 1] == "class":
                self.class_()
            elif self.word("async") and t[self.i + 1] == "function":
                self.i += 1
                self.function()
            elif self.typed and self.word("interface") and t[self.i + 1] == "ID":
                self.typed_statement("interface")
            else:
                self.assign()
                self.semicolon()
        elif x == "*":
            self.i += 1
            if self.word("as"):
                self.i += 1
                self.property_name()
            if not self.word("from"):
                self.fail()
            self.i += 1
            self.source()
        elif x == "{" or self.typed and self.word("type") and t[self.i + 1] == "{":
            if x != "{":
                self.i += 1
            self.specifiers()
            if self.word("from"):
                self.i += 1
                self.source()
            else:
                self.semicolon()
        elif self.typed and x in ("=", "import"):
            self.i += 1
            self.expression()
            self.semicolon()
        elif x in ("var", "const", "function", "class", "@", "enum") or x == "ID" and self.text() in ("let", "async", "interface", "type", "namespace", "module", "declare", "abstract"):
            self.statement()
        else:
            self.fail()

    def variable_statement(self) -> None:
        self.variables()
        self.semicolon()

    def debugger(self) -> None:
        self.i += 1
        self.semicolon()

    def enum_statement(self) -> None:
        if not self.typed:
            self.fail()
        self.enum()

    def empty(self) -> None:
        self.i += 1

    STATEMENTS = {"{": block, "var": variable_statement, "const": variable_statement, "function": function, "class": class_, "@": class_, "if": if_, "for": for_, "while": while_, "do": do_, "return": return_, "break": jump, "continue": jump, "throw": throw, "try": try_, "switch": switch, "import": import_, "export": export, ";": empty, "debugger": debugger, "enum": enum_statement}

    # Expressions

    def expression(self) -> int:
        kind = self.assign()
        while self.t[self.i] == ",":
            self.i += 1
            self.assign()
            kind = OTHER
        return kind

    def arrow_body(self) -> None:
        if self.t[self.i] == "{":
            self.block()
        else:
            self.assign()

    def assign(self) -> int:
        t = self.t
        x = t[self.i]
        if x == "ID":
            y = t[self.i + 1]
            if y == "=>":
                self.i += 2
                self.arrow_body()
                return OTHER
            if y in (",", ")", ";", "]"):
                self.i += 1
                return TARGET
            if self.text() == "async" and not self.nl[self.i + 1]:
                if y == "ID" and t[self.i + 2] == "=>":
                    self.i += 3
                    self.arrow_body()
                    return OTHER
                if y in ("(", "<"):
                    at = self.i
                    self.i += 1
                    if self.attempt(self.arrow_head):
                        self.arrow_body()
                        return OTHER
                    self.i = at
        elif x == "NUM" and t[self.i + 1] in (",", "]", ")", ";"):
            self.i += 1
            return OTHER
        elif x == "(" or x == "<" and self.typed:
            if self.arrow_likely() and self.attempt(self.arrow_head):
                self.arrow_body()
                return OTHER
        elif x == "yield":
            self.i += 1
            if not self.nl[self.i] and t[self.i] not in (")", "]", "}", ",", ";", ":", "EOF"):
                self.opt("*")
                self.assign()
            return OTHER
        kind = self.nested(self.conditional)
        if t[self.i] in _ASSIGN:
            if kind == OTHER or kind == PATTERN and t[self.i] != "=":
                self.fail("invalid assignment target")
            self.i += 1
            self.nested(self.assign)
            return OTHER
        return kind

    def arrow_likely(self) -> bool:
        """Whether "=>" or, with types, ":" follows the bracket that closes the one here."""
        t, i, depth = self.t, self.i, 0
        if t[i] == "<":
            return True
        while True:
            x = t[i]
            if x in ("(", "[", "{"):
                depth += 1
            elif x in (")", "]", "}"):
                depth -= 1
                if not depth:
                    break
            elif x == "EOF":
                return False
            i += 1
        return t[i + 1] == "=>" or self.typed and t[i + 1] == ":"

    def arrow_head(self) -> None:
        self.signature()
        if self.nl[self.i]:
            self.fail()
        self.need("=>")

    def conditional(self) -> int:
        kind = self.binary(0)
        if self.t[self.i] == "?":
            self.i += 1
            no_in, self.no_in = self.no_in, False
            self.assign()
            self.no_in = no_in
            self.need(":")
            self.assign()
            return OTHER
        return kind

    def binary(self, least: int) -> int:
        t = self.t
        kind = self.unary()
        while True:
            x = t[self.i]
            p = _BINARY.get(x)
            if p is None:
                if x == "ID" and self.typed and self.text() in ("as", "satisfies") and not self.nl[self.i]:
                    self.i += 1
                    if not self.opt("const"):
                        self.type()
                    kind = TARGET if kind == TARGET else OTHER
                    continue
                return kind
            if p < least or p == 0 or x == "in" and self.no_in:
                return kind
            self.i += 1
            self.binary(p if p == 11 else p + 1)
            kind = OTHER

    def unary(self) -> int:
        t = self.t
        x = t[self.i]
        if x in _PREFIX:
            self.i += 1
            self.nested(self.unary)
            return OTHER
        if x in ("++", "--"):
            self.i += 1
            if self.unary() != TARGET:
                self.fail("invalid operand")
            return OTHER
        if x == "<" and self.typed:
            self.type_arguments()
            self.nested(self.unary)
            return OTHER
        kind = self.member_chain(self.primary())
        if t[self.i] in ("++", "--") and not self.nl[self.i]:
            if kind != TARGET:
                self.fail("invalid operand")
            self.i += 1
            return OTHER
        return kind

    def member_chain(self, kind: int, calls: bool = True) -> int:
        t = self.t
        while True:
            x = t[self.i]
            if x == ".":
                self.i += 1
                self.opt("#")
                y = t[self.i]
                if y != "ID" and not (y.isalpha() and y.islower()):
                    self.fail("expected a name")
                self.i += 1
                kind = TARGET
            elif x == "(":
                if not calls:
                    return kind
                self.nested(self.arguments)
                kind = OTHER
            elif x == "[":
                self.i += 1
                no_in, self.no_in = self.no_in, False
                self.nested(self.expression)
                self.no_in = no_in
                self.need("]")
                kind = TARGET
            elif x == "?.":
                self.i += 1
                if t[self.i] == "(":
                    self.arguments()
                elif self.opt("["):
                    self.expression()
                    self.need("]")
                else:
                    self.opt("#")
                    self.property_name()
                kind = OTHER
            elif x == "TPL":
                self.i += 1
                kind = OTHER
            elif x == "!" and self.typed and not self.nl[self.i]:
                self.i += 1
            elif x == "<" and self.typed and self.attempt(self.call_types):
                pass
            else:
                return kind

    def call_types(self) -> None:
        self.type_arguments()
        if self.t[self.i] not in ("(", "TPL", ")", "]", ",", ";", ".", "?."):
            self.fail()

    def primary(self) -> int:
        t = self.t
        x = t[self.i]
        if x == "ID":
            if t[self.i + 1] == "function" and self.text() == "async":
                self.i += 1
                self.function()
                return OTHER
            self.i += 1
            return TARGET
        if x in _LITERAL or x == "TPL":
            self.i += 1
            return OTHER
        if x == "(":
            self.i += 1
            no_in, self.no_in = self.no_in, False
            kind = self.nested(self.expression)
            self.no_in = no_in
            self.need(")")
            return TARGET if kind == TARGET else OTHER
        if x == "[":
            self.nested(self.array)
            return PATTERN
        if x == "{":
            self.nested(self.object_)
            return PATTERN
        if x == "function":
            self.nested(self.function)
            return OTHER
        if x in ("class", "@"):
            self.nested(self.class_)
            return OTHER
        if x in ("this", "super"):
            self.i += 1
            return OTHER
        if x == "new":
            self.i += 1
            if self.opt("."):
                self.name()
                return OTHER
            self.member_chain(self.nested(self.primary), False)
            if self.typed and t[self.i] == "<":
                self.type_arguments()
            if t[self.i] == "(":
                self.arguments()
            return OTHER
        if x == "import":
            self.i += 1
            if self.opt("."):
                self.name()
            else:
                self.arguments()
            return OTHER
        if x in ("yield", "await"):
            self.i += 1
            return TARGET
        if x == "#":
            self.i += 1
            self.name()
            return OTHER
        self.fail("expected an expression")
        return OTHER

    def arguments(self) -> None:
        self.need("(")
        t = self.t
        no_in, self.no_in = self.no_in, False
        while t[self.i] != ")":
            self.opt("...")
            self.assign()
            if t[self.i] != ")":
                self.need(",")
        self.no_in = no_in
        self.i += 1

    def array(self) -> None:
        self.i += 1
        t = self.t
        no_in, self.no_in = self.no_in, False
        while t[self.i] != "]":
            if t[self.i] == ",":
                self.i += 1
                continue
            if t[self.i] in ("NUM", "STR") and t[self.i + 1] == ",":
                self.i += 2
                continue
            self.opt("...")
            self.assign()
            if t[self.i] != "]":
                self.need(",")
        self.no_in = no_in
        self.i += 1

    def object_(self) -> None:
        self.need("{")
        t = self.t
        no_in, self.no_in = self.no_in, False
        while t[self.i] != "}":
            if self.opt("..."):
                self.assign()
            else:
                while t[self.i] == "ID" and self.text() in ("get", "set", "async") and t[self.i + 1] not in (",", ":", "(", "}", "="):
                    self.i += 1
                self.opt("*")
                short = t[self.i] in ("ID", "yield", "await")
                self.property_name()
                if t[self.i] in ("(", "<"):
                    self.signature()
                    self.block()
                elif self.opt(":"):
                    self.assign()
                elif not short:
                    self.fail("expected :")
                elif self.opt("="):
                    self.assign()
            if t[self.i] != "}":
                self.need(",")
        self.no_in = no_in
        self.i += 1

    # Types

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            while self.t[self.i] in ("const", "in") or self.word("out") and self.t[self.i + 1] == "ID":
                self.i += 1
            self.name()
            if self.opt("extends"):
                self.type()
            if self.opt("="):
                self.type()
            if not self.opt(",") or self.t[self.i][:1] == ">":
                break
        self.close_angle()

    def type_arguments(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.opt(","):
                break
        self.close_angle()

    def type(self) -> None:
        t = self.t
        if t[self.i] == "ID" and t[self.i + 1] in (")", ",", "=", ";", "{"):
            self.i += 1
            return
        self.nested(self.union)
        if t[self.i] == "extends" and not self.nl[self.i]:
            self.i += 1
            self.nested(self.union)
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def union(self) -> None:
        t = self.t
        if t[self.i] in ("|", "&"):
            self.i += 1
        self.type_unary()
        while t[self.i] in ("|", "&"):
            self.i += 1
            self.type_unary()

    def type_unary(self) -> None:
        t = self.t
        while t[self.i] == "ID" and self.text() in ("keyof", "unique", "readonly", "infer") and t[self.i + 1] in ("ID", "[", "{", "(", "typeof", "STR", "this"):
            self.i += 1
        x = t[self.i]
        if x == "new" or x == "<" or self.word("abstract") and t[self.i + 1] == "new":
            if self.word("abstract"):
                self.i += 1
            self.opt("new")
            if t[self.i] == "<":
                self.type_parameters()
            self.function_type()
            return
        if x == "(":
            if self.attempt(self.function_type):
                return
            self.i += 1
            self.type()
            self.need(")")
        elif x == "ID" or x in ("void", "null", "this", "true", "false", "import", "typeof"):
            self.i += 1
            if x == "typeof":
                self.i += 1
            if x == "import":
                self.need("(")
                self.need("STR")
                self.need(")")
            while self.opt("."):
                self.property_name()
            if t[self.i] == "<" and not self.nl[self.i]:
                self.type_arguments()
            if self.word("is") and not self.nl[self.i]:
                self.i += 1
                self.type()
        elif x in ("STR", "NUM", "TPL"):
            self.i += 1
        elif x == "-":
            self.i += 1
            self.need("NUM")
        elif x == "{":
            self.object_type()
        elif x == "[":
            self.i += 1
            while t[self.i] != "]":
                self.opt("...")
                if t[self.i] == "ID" and (t[self.i + 1] == ":" or t[self.i + 1] == "?" and t[self.i + 2] == ":"):
                    self.i += 1
                    self.opt("?")
                    self.i += 1
                self.type()
                self.opt("?")
                if t[self.i] != "]":
                    self.need(",")
            self.i += 1
        else:
            self.fail("expected a type")
        while t[self.i] == "[" and not self.nl[self.i]:
            self.i += 1
            if t[self.i] != "]":
                self.type()
            self.need("]")

    def function_type(self) -> None:
        self.need("(")
        self.parameters()
        self.need("=>")
        self.return_type()

    def object_type(self) -> None:
        self.need("{")
        t = self.t
        while t[self.i] != "}":
            while t[self.i] in ("+", "-") or t[self.i] == "ID" and self.text() in ("readonly", "get", "set", "static") and t[self.i + 1] not in (":", "?", "(", ";", ",", "}", "<"):
                self.i += 1
            if t[self.i] == "[" and t[self.i + 1] == "ID" and t[self.i + 2] in (":", "in"):
                self.i += 3
                self.type()
                if self.word("as"):
                    self.i += 1
                    self.type()
                self.need("]")
                if t[self.i] in ("+", "-"):
                    self.i += 1
                self.opt("?")
                if self.opt(":"):
                    self.type()
            else:
                self.opt("new")
                if t[self.i] not in ("(", "<"):
                    self.property_name()
                    self.opt("?")
                if t[self.i] in ("(", "<"):
                    self.signature()
                elif self.opt(":"):
                    self.type()
            if t[self.i] in (";", ","):
                self.i += 1
            elif t[self.i] != "}" and not self.nl[self.i]:
                self.fail("expected ;")
        self.i += 1
