"""Problem 4: functions paired with their documentation.

A packrat grammar per language reads a file into definitions with the comments directly above them (and above their
decorators) and the docstring within them, keeping offsets; a rule of the same grammar reads each definition's body, so its
code ends where the grammar says. The semantic action emits the pair with name, parameters, documentation and code. Pairs
meet the functions and methods of the parsed modules by file and line: the module's docstring is the documentation, and
where it is empty, the comment of the pair. A pair stays when its documentation says something, see :func:`informative`.

Cases: null docstrings count as empty; null content has no pairs; a function whose file or definition is missing is judged by
its docstring and has no code; overloads are told apart by their lines; a repeated row gives one pair; files in other
languages than the seven are read by no grammar. Empty tables give empty results.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.peg import Grammar
from tesserine.llm.syntax import language_of
from tesserine.session import map_rows

_C_COMMENTS = r"""
doc <- (block / line)+
block <- ~[ \t]*/\*(?:[^*]|\*(?!/))*\*/[ \t]*\r?\n~
line <- ~[ \t]*//[^\n]*\n~
group <- ~\(~ (group / string / inside / ~[^()\"'`/]+|/~)* ~\)~
inside <- ~//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/~
string <- ~\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|'~
skip <- ~[ \t]*/\*(?:[^*]|\*(?!/))*\*/[^\n]*\n?~ / ~[^\n`]*`[^`]*`[^\n]*\n?~ / ~[^\n]*\n~ / ~[^\n]+~
braces <- ~\{~ item* ~\}~
"""
GRAMMARS = {
    "python": r"""
pair <- doc:doc? decorator* definition
doc <- ~[ \t]*\#[^\n]*\n~+
decorator <- ~[ \t]*@[\w.]+~ group? ~[^\n]*\n~
definition <- ~[ \t]*~ def:~(?:async[ \t]+)?def\b~ ~[ \t]+~ name:~\w+~ ~[ \t]*~ params:group docstring?
group <- ~[(\[{]~ (group / string / ~\#[^\n]*~ / ~[^()\[\]{}\"'\#]+~)* ~[)\]}]~
string <- ~\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'~
logical <- (group / string / ~\#[^\n]*|\\\r?\n|[^()\[\]{}\"'\#\\\n]+|[\\\"')\]}]~)* ~\n~
docstring <- ~[ \t]*(?:->[^\n]*?)?:[ \t]*(?:\#[^\n]*)?\n(?:[ \t]*(?:\#[^\n]*)?\n)*[ \t]+[rRuU]?~ inner:~\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'~
skip <- ~[^\n\"'\#]*[rRbBuUfF]*(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')[^\n]*\n?~ / ~[^\n]*\n~ / ~[^\n]+~
""",
    "javascript": r"""
pair <- doc:doc? decorator* definition
decorator <- ~[ \t]*@[\w.]+~ group? ~[ \t]*\r?\n|[ \t]+~
definition <- function / arrow / method
function <- ~[ \t]*~ def:~(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function\b~ ~[ \t]*\*?[ \t]*~ name:~[\w$]+~ ~[ \t]*(?:<[^()]*>)?~ params:group
arrow <- ~[ \t]*~ def:~(?:export[ \t]+)?(?:const|let|var)[ \t]+~ name:~[\w$]+~ ~[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]*)?(?:<[^()]*>)?~ params:group ~[ \t]*(?::[^=\n]+)?=>~
method <- ~[ \t]+~ def:~(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)[ \t]+)*~ ~\*?[ \t]*~ !reserved name:~\#?[A-Za-z_$][\w$]*~ ~[ \t]*\??(?:<[^()]*>)?~ params:group ~[ \t]*(?::[^\n]*?)?\{|[ \t]*:[^\n{]*;~
reserved <- ~(?:if|for|while|switch|catch|return|function|throw|new|typeof|await|super|with|do|else)\b~
literal <- ~\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'~ / template / ~(?:(?<=[(=:,;!&|?\[+{}\n])|(?<=[(=:,;!&|?+] )|(?<=return ))/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*|[\"']~
template <- ~`~ (~[^`\\$]+|\\[\s\S]|\$(?!\{)~ / ~\$~ braces)* ~`~
item <- braces / literal / inside / ~[^{}\"'`/]+|/~
head <- group / literal / inside / ~[^{};()\"'`/\n]+|/|\r?\n(?=[ \t\r\n]*[{:])~
squares <- ~\[~ (squares / group / literal / inside / braces / ~[^\[\](){}\"'`/]+|/~)* ~\]~
round <- ~\(~ (round / squares / literal / inside / braces / ~[^\[\](){}\"'`/]+|/~)* ~\)~
value <- (round / squares / braces / literal / inside / ~[^\[\](){}\"'`/;,\n]+|/|\r?\n(?=[ \t]*[.?:|&+*)=])|,(?=[ \t]*\n)~)+
body <- ~[ \t]*(?::[^=\n]+)?=>[ \t\r\n]*~ (braces / value) ~;?~ / head* (~;~ / braces (~[ \t]*(?=\{)~ braces)?)
"""
    + _C_COMMENTS,
    "go": r"""
pair <- doc:doc? definition
definition <- def:~func\b~ ~[ \t]+~ group? ~[ \t]*~ name:~\w+~ ~(?:\[[^\n(]*\])?~ params:group
literal <- ~\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)+'|[\"'`]~
item <- braces / literal / inside / ~[^{}\"'`/]+|/~
head <- group / literal / inside / ~[^{};()\"'`/\n]+|/~
body <- head* braces (~[ \t]*(?=\{)~ braces)?
"""
    + _C_COMMENTS,
    "java": r"""
pair <- doc:doc? decorator* definition
decorator <- ~[ \t]*@(?!interface)[\w.]+~ group? ~[ \t]*\r?\n|[ \t]+~
definition <- ~[ \t]+~ !reserved def:~(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*~ ~(?:<[^()\n]*>[ \t]+)?~ !reserved (typed / bare)
typed <- ~[\w.]+(?:<[^()\n;=]*>)?(?:\[\])*[ \t]+~ !reserved name:~\w+~ ~[ \t]*~ params:group ~\s*(?:throws[^{;]*)?[{;]~
bare <- name:~\w+~ ~[ \t]*~ params:group ~\s*(?:throws[^{;]*)?\{~
reserved <- ~(?:if|for|while|switch|catch|return|throw|new|else|try|do|synchronized[ \t]*\(|assert|super|this)\b~
literal <- ~\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'|[\"']~
item <- braces / literal / inside / ~[^{}\"'/]+|/~
head <- group / literal / inside / ~[^{};()\"'/]+|/~
body <- head* (~;~ / braces)
"""
    + _C_COMMENTS,
    "ruby": r"""
pair <- doc:doc? definition
doc <- ~[ \t]*\#[^\n]*\n~+
definition <- ~[ \t]*(?:(?:private|protected|public|module_function)[ \t]+)?~ def:~def\b~ ~[ \t]+(?:\w+\.)?~ name:~\w+[?!=]?|[-+*/%<=>!\~\[\]^&|]+~ params:group?
group <- ~\(~ (group / string / ~[^()\"'\#]+|\#~)* ~\)~
string <- ~\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'~
skip <- ~=begin\b[\s\S]*?\n=end[^\n]*\n?~ / ~[^\n]*\n~ / ~[^\n]+~
body <- ~[ \t]*=(?![=\~])[^\n]*~ / rest ~\bend\b~
rest <- (nested / text / !~\bend\b~ ~\w+[?!]?|[^\w]~)*
nested <- ~(?:^|(?<=[\n;=(|{,]))[ \t]*(?:while|until|for)\b[^\n;\#]*?(?:\bdo\b(?=[ \t]*[\n;\#])|(?=[\n;\#]))~ rest ~\bend\b~ / ~(?:^|(?<=[\n;=(|{,]))[ \t]*(?:if|unless|case|begin|class|module|def)\b(?![?!:=.])~ rest ~\bend\b~ / ~\bdo\b(?![?!:=])~ rest ~\bend\b~
text <- ~\n=begin\b[\s\S]*?\n=end[^\n]*~ / ~\#(?!\{)[^\n]*~ / ~<<[\~-]?([\"'`]?)([A-Z_]\w*)\1[^\n]*\n[\s\S]*?\n[ \t]*\2(?=\s)~ / ~\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'|`[^`\n]*`~ / ~:\w+|\w+:(?!:)|@+\w+|\$\w+|\.\w+|(?:(?<=[(=,\~!|&])|(?<=[(=,\~!|&] ))/(?:[^/\\\n]|\\.)+/[a-z]*~
""",
    "rust": r"""
pair <- doc:doc? decorator* definition
decorator <- ~[ \t]*\#\[[^\n]*\][ \t]*\r?\n~
definition <- ~[ \t]*~ def:~(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*fn\b~ ~[ \t]+~ name:~\w+~ ~(?:<[^()]*?(?:\([^()]*\)[^()]*?)*?>(?=\())?~ params:group
literal <- ~\bb?r(\#*)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n]*?)'|[\"'br]~
nest <- ~/\*~ (nest / ~[^*/]+|\*(?!/)|/(?!\*)~)* ~\*/~
item <- braces / nest / ~//[^\n]*~ / literal / ~[^{}\"'/br]+|/~
head <- group / nest / ~//[^\n]*~ / literal / ~[^{};()\"'/br]+|/~
body <- head* (~;~ / braces)
"""
    + _C_COMMENTS,
}
GRAMMARS["typescript"] = GRAMMARS["javascript"]


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    """The compiled grammar of a language."""
    return Grammar(GRAMMARS[language])


def pairs_of(text: str, language: str, bodies: bool = False) -> list[dict]:
    """Definitions in a text: line, name, params, doc (above), inner (docstring), offsets; ``end`` is the body's with ``bodies``."""
    out, line, last = [], 1, 0
    if not text.endswith("\n"):
        text += "\n"
    memo: dict = {}
    rules = grammar(language)
    for _, end, captures in rules.each("pair", "skip", text, memo):
        got = {c[0]: (c[1], c[2]) for c in captures}
        at = got["def"][0]
        line += text.count("\n", last, at)
        last = at
        doc, params, inner = got.get("doc"), got.get("params"), got.get("inner")
        begin = text.rfind("\n", 0, at) + 1
        if bodies:
            end = body_end(text, begin, params[1] if params else got["name"][1], language, rules, memo)
        out.append({"line": line, "name": text[slice(*got["name"])], "params": text[slice(*params)] if params else "", "doc": text[slice(*doc)] if doc else "", "inner": text[slice(*inner)] if inner else "", "begin": begin, "end": end, "doc_begin": doc[0] if doc else begin})
    return out


def body_end(text: str, begin: int, at: int, language: str, rules: Grammar, memo: dict) -> int:
    """Where the definition that begins at ``begin`` and whose parameters end at ``at`` ends; the end of its line, where the grammar finds no body."""
    if language == "python":
        depth = re.compile(r"[ \t]*").match(text, begin).end() - begin
        r = rules.rules["logical"](text, at, memo)
        end = kept = r[0] if r else len(text)
        indent = re.compile(r"([ \t]*)([^\s\#])?")
        while end < len(text):
            m = indent.match(text, end)
            if m.group(2) and len(m.group(1)) <= depth:
                break
            r = rules.rules["logical"](text, end, memo)
            end = r[0] if r else len(text)
            if m.group(2):
                kept = end
        return kept - 1 if text[kept - 1] == "\n" else kept
    r = rules.rules["body"](text, at, memo)
    if r is not None:
        return r[0]
    end = text.find("\n", at)
    return end if end >= 0 else len(text)


_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*+!?|\*+/|\*+(?!\w)|//+[/!]?|#+(?!\[)!?|--)[ \t]?|\*+/[ \t]*\r?$")
# What documentation that says nothing consists of.
_DIRECTIVE = re.compile(r"(?i)^(?:eslint|tslint|jshint|jslint|prettier|biome|istanbul|c8|v8|webpack|noqa|nolint|nosec|pylint|flake8|mypy|pyright|ruff|isort|yapf|black|fmt|autopep8|pragma|type:\s*ignore|@ts-|rubocop|steep|sorbet|typed:|frozen_string_literal|clippy|rustfmt|cargo|go:|lint:|\+build|checkstyle|nosonar|noinspection|suppresswarnings|@formatter|swiftlint|coverage|codecov|vim:|-\*-|coding[:=]|region\b|endregion\b|stylelint|deno-|@jsx|@flow|cspell|spell-?check|shellcheck|cppcheck|pmd|spotless|sonar|nocov|simplecov|:nocov:|:nodoc:|@internal\b|@private\b|@api\b|@generated\b|@override\b|@deprecated\s*$|@hidden\b|@ignore\b|#\[)")
_TODO = re.compile(r"(?i)^\W*(?:to-?do|fixme|xxx|hack|tbd|wip|optimi[sz]e|review)\b")
_PLACEHOLDER = re.compile(r"(?i)^\W*(?:n\s*/\s*a|none|null|tbd|tba|undocumented|not documented|missing(?: docs?| documentation)?|no (?:description|docs?|documentation|comment|docstring)(?: (?:yet|available|provided|here))?|(?:add |write |insert |your )?(?:a |the )?(?:description|docs?|docstring|documentation|comment|summary)(?: (?:here|go(?:es)? here|follows?|to follow|missing|needed|pending))?|placeholder|lorem ipsum.*|fill (?:me|this) in|write me|document (?:me|this)|to be (?:done|written|documented|added|described|filled in)|auto-?generated(?: method)? stub|method stub|stub|blah.*|foo|bar|test|asdf|xxx+|self-?explanatory|obvious|helper|helper (?:function|method)|function|method|constructor|getter|setter|internal|private|public|deprecated)\W*$")
_POINTER = re.compile(r"(?i)^\W*(?:\{?@inherit-?doc\}?|inherit(?:s|ed)?(?: doc\w*)?(?: from [\w.#:()]+)?|(?:please )?(?:see|cf\.?|refer to|look at|check|compare|as in|same as|like|identical to|ditto|@see|documented (?:in|at|elsewhere)|described (?:in|at|elsewhere)|docs? (?:in|at)|overrides?|implements?)(?:\s+(?:also|above|below|elsewhere|there|here|the|a|an|its|base|parent|super|interface|class|method|function|module|file|docs?|documentation|docstring|comment|description|definition|declaration|spec(?:ification)?|wiki|readme|page|guide|handbook|manual|section|chapter|for|in|of|on|at|to|and|details?|more|information|overview|superclass|[\w./#:`'\"<>()\[\]-]*[._/#:`(\[<A-Z0-9][\w./#:`'\"<>()\[\]-]*|\w+)){0,9}|as above|see above|above|below)\W*$")
_TAG = re.compile(r"(?i)^\W*(?:[@\\](\w+)|:(\w+)(?:\s+[^:\n]*)?:)\s*(.*)$")
_SECTION = re.compile(r"(?i)^\W*(?:args?|arguments?|params?|parameters?|returns?|yields?|raises?|throws?|examples?|notes?|attributes|kwargs|keyword args|see also|usage)\s*:?\W*$")
_FIELD = re.compile(r"^\W*[`*]*([A-Za-z_]\w*)[`*]*\s*(?:\([^)]*\))?\s*(?::|\s-{1,2}\s)\s*(.*)$")
_GENERIC = frozenset("a an the this that these those it its is are was be been of for to in on at by with from and or as into onto up function functions method methods routine procedure subroutine helper func fn def class object implementation implement implements implementing does do done perform performs performing call calls called calling invoke invokes handle handles handling execute executes run given simply just here there which will can used use uses using return returns value values result results name named operation action utility given current new all any some our".split())
_WORDS = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")


def stem(word: str) -> str:
    """A word without the endings that verbs and plurals take."""
    for end in ("ings", "ing", "ies", "ied", "es", "ed", "er", "ers", "ation", "ations", "ion", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)]
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def _new_words(text: str, known: set[str]) -> int:
    """Words of a text that are neither generic nor in the function's name; each Chinese character counts a third."""
    han = len(_HAN.findall(text))
    words = [p.lower() for w in _WORDS.findall(text) for p in (_PIECES.findall(w) or [w])]
    return han // 3 + sum(1 for w in words if len(w) > 1 and w not in _GENERIC and stem(w) not in known and not _HAN.match(w))


def plain(doc: str) -> str:
    """A comment or docstring without comment marks, tags and entities."""
    text = _MARKS.sub("", doc)
    if "<" in text or "&" in text:
        text = re.sub(r"<!--[\s\S]*?-->", " ", text)
        text = html.unescape(re.sub(r"</?[a-zA-Z][^<>\n]*>", " ", text))
    return text


def informative(doc: str | None, name: str) -> bool:
    """Whether documentation says something about the function ``name``.

    Blanks, placeholders, to-do marks, separator lines, tool directives, pointers elsewhere, and tags or parameter names
    without a description are left out line by line; what remains must hold two words that neither the function's name
    nor a list of generic words has.
    """
    if not doc or not doc.strip():
        return False
    known = {stem(p.lower()) for w in re.split(r"[^\w]+|_", name) for p in _PIECES.findall(w)}
    kept = []
    for line in plain(doc).split("\n"):
        line = line.strip()
        if not _WORDS.search(line) or _DIRECTIVE.match(line) or _TODO.match(line) or _PLACEHOLDER.match(line) or _SECTION.match(line):
            continue
        m = _TAG.match(line)
        if m:
            tag, rest = (m.group(1) or m.group(2)).lower(), m.group(3)
            if tag in ("see", "inheritdoc", "link", "override", "todo", "author", "since", "version", "date", "type", "rtype"):
                continue
            if m.group(1) and tag in ("param", "arg", "argument", "property", "prop", "throws", "raises", "exception", "tparam", "template"):
                rest = re.sub(r"^\s*(?:\{[^}]*\}\s*)?\[?[\w.$*&<>]+\]?\s*-?", "", rest)
            line = re.sub(r"^\s*\{[^}]*\}", "", rest)
            if not line.strip():
                continue
        if _POINTER.match(line):
            continue
        m = _FIELD.match(line)
        if m and not m.group(2):
            continue
        kept.append(line)
    return bool(kept) and _new_words("\n".join(kept), known) >= 2


_SIGNS = {"rust": re.compile(r"\bfn \w"), "go": re.compile(r"(?m)^func "), "python": re.compile(r"(?m)^\s*(?:async )?def \w+\(.*:\s*$"), "javascript": re.compile(r"\bfunction\b|^import \{", re.M), "java": re.compile(r"\b(?:public|private) "), "ruby": re.compile(r"(?m)^\s*end\s*$")}


def best_pairs(text: str, language: str | None, bodies: bool = False) -> list[dict]:
    """Pairs by the grammar of the file's language; where its signs are missing and others stand, of the language whose grammar finds most."""
    found = pairs_of(text, language, bodies) if language in GRAMMARS else []
    own = _SIGNS.get("javascript" if language == "typescript" else language or "")
    if not found or own and not own.search(text):
        for other, sign in _SIGNS.items():
            if other != language and sign.search(text):
                pairs = pairs_of(text, other, bodies)
                if len(pairs) > len(found):
                    found = pairs
    return found


def definitions(source_files: DataFrame, bodies: bool = False) -> DataFrame:
    """All definitions found by the grammars: file_id, line, name, says (whether the comment above does), with ``bodies`` also doc, params and code."""

    def run(rows):
        for r in rows:
            if r["content"]:
                for p in best_pairs(r["content"], language_of(r["path"], r["language"]), bodies):
                    says = bool(p["doc"]) and informative(p["doc"], p["name"])
                    yield (r["file_id"], p["line"], p["name"], says, p["doc"], p["params"], r["content"][p["begin"] : p["end"]]) if bodies else (r["file_id"], p["line"], p["name"], says)

    schema = "file_id bigint, line int, name string, says boolean" + (", doc string, params string, code string" if bodies else "")
    # Repeated versions of a file give the same pairs.
    return map_rows(source_files, run, schema, ["file_id", "path", "language", "content"]).dropDuplicates(["file_id", "line"])


def functions_of(modules: DataFrame) -> DataFrame:
    """Functions and methods of modules: file_id, symbol, name, line, params, docstring."""
    pick = lambda f, owner: F.struct(
        F.concat(owner, F.coalesce(f["name"], F.lit(""))).alias("symbol"), F.coalesce(f["name"], F.lit("")).alias("name"), f["line"].alias("line"), F.transform(f["parameters"], lambda p: p["name"]).alias("params"), F.coalesce(f["docstring"], F.lit("")).alias("docstring")
    )
    empty = F.array().cast("array<struct<symbol:string,name:string,line:int,params:array<string>,docstring:string>>")
    plain_ = F.coalesce(F.transform("functions", lambda f: pick(f, F.lit(""))), empty)
    methods = F.coalesce(F.flatten(F.transform("classes", lambda c: F.transform(c["methods"], lambda f: pick(f, F.concat(F.coalesce(c["name"], F.lit("")), F.lit(".")))))), empty)
    return modules.select("file_id", F.explode(F.concat(plain_, methods)).alias("f")).select("file_id", "f.*")


def judged_functions(modules: DataFrame, texts: bool = False) -> DataFrame:
    """Functions and methods with what their docstring is worth: file_id, symbol, name, line, own (null: blank; else whether it says something)."""

    def run(rows):
        for r in rows:
            doc = r["docstring"]
            own = informative(doc, r["name"]) if doc.strip() else None
            yield (r["file_id"], r["symbol"], r["name"], r["line"], own, r["params"], doc) if texts else (r["file_id"], r["symbol"], r["name"], r["line"], own)

    schema = "file_id bigint, symbol string, name string, line int, own boolean" + (", params array<string>, docstring string" if texts else "")
    return map_rows(functions_of(modules), run, schema)


def documented_functions(source_files: DataFrame, modules: DataFrame) -> DataFrame:
    """Rows (file_id, symbol) of functions whose documentation says something. Only keys and verdicts are shuffled."""
    functions = judged_functions(modules).where("own is null or own").distinct()
    pairs = definitions(source_files).select("file_id", "line", "says")
    return functions.join(pairs, ["file_id", "line"], "left").where(F.coalesce("own", "says", F.lit(False))).select("file_id", "symbol").distinct()


def code_description_pairs(source_files: DataFrame, modules: DataFrame) -> DataFrame:
    """The pairs: file_id, symbol, line, name, params, doc, code (from the definition's line to the end of its body; null without file)."""
    functions = judged_functions(modules, texts=True).where("own is null or own").distinct()
    pairs = definitions(source_files, bodies=True).select("file_id", "line", "says", F.col("doc").alias("above"), "code")
    found = functions.join(pairs, ["file_id", "line"], "left").where(F.coalesce("own", "says", F.lit(False)))
    return found.select("file_id", "symbol", "line", "name", F.array_join("params", ", ").alias("params"), F.when(F.col("own"), F.col("docstring")).otherwise(F.col("above")).alias("doc"), "code").distinct()
