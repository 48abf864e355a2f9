"""Tokenizers for the supported programming languages.

One compiled alternation per language does the bulk of the work; the few constructs a regular expression cannot
describe (nested comments, template literals, heredocs, raw strings with counted hashes, JSX) are scanned by hand.
A token is described by parallel lists, which is the cheapest representation in a Python worker:

``types``   the operator or keyword itself, or one of ID NUM STR TPL REGEX JSX LIFE SYM NL INDENT DEDENT EOF
``start``/``end``  character offsets, ``nl``  whether a line break precedes the token on its own line
"""

from __future__ import annotations

import re
from functools import lru_cache

# Reserved words of each language (from the public language references).
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield enum",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    "ruby": "BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield __FILE__ __LINE__ __method__",
    "rust": "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn",
    "csharp": "abstract as base bool break byte case catch char class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while",
    "cpp": "",
    "scala": "abstract case catch class def do else enum extends extension false final finally for given if implicit import lazy match new null object override package private protected return sealed super then this throw trait true try type using val var while with yield",
    "kotlin": "",
    "swift": "",
    "php": "",
    "elixir": "do end fn and or not in when true false nil",
}
KEYWORDS["typescript"] = KEYWORDS["javascript"]

_OPS = {
    "python": "**= //= >>= <<= ... -> := ** // >> << <= >= == != += -= *= /= %= &= |= ^= @= + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; = !",
    "javascript": ">>>= === !== **= <<= >>= >>> ... &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** + - * / % & | ^ ! ~ < > = ? : ; , . ( ) [ ] { } @ #",
    "go": "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~",
    "java": ">>>= <<= >>= ... -> :: ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << + - * / & | ^ % < > = ! ~ ? : ; , . ( ) [ ] { } @",
    "ruby": "**= <=> === ... <<= >>= &&= ||= &. ** == != >= <= && || =~ !~ :: .. += -= *= /= %= |= &= ^= << >> -> => + - * / % & | ^ ! ~ < > = ? : ; , . ( ) [ ] { }",
    "rust": "<<= >>= ..= ... :: -> => == != <= >= && || += -= *= /= %= ^= &= |= << >> .. + - * / % ^ ! & | = < > @ . , ; : # $ ? ~ ( ) [ ] { }",
}
_OPS["typescript"] = _OPS["javascript"]
_GENERIC_OPS = "<<= >>= ... <=> === !== ?-> -> => :: == != <= >= && || ?? ?. ?: !! ++ -- += -= *= /= %= &= |= ^= << .. |> <> <- + - * / % & | ^ ! ~ < > = ? : ; , . ( ) [ ] { } @ # $ \\"

_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
_NUMBERS = {
    "python": _NUM + r"[jJ]?",
    "javascript": _NUM + "n?",
    "typescript": _NUM + "n?",
    "go": _NUM + "i?",
    "java": r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?|" + _NUM[3:] + "[lLfFdD]?",
    "ruby": r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)r?i?",
    "rust": r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?",
}
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_STRINGS = {
    "python": r"(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|(?!\"\"\"|''')(?:\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'))",
    "javascript": r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"' + r"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'",
    "go": r'"(?:[^"\\\n]|\\[^\n])*"|`[^`]*`|' + r"'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)'",
    "java": r'"""[ \t]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|(?!""")"(?:[^"\\\n]|\\[^\n])*"' + r"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[^\n][0-7]*)'",
    "rust": r'b?"(?:[^"\\]|\\[\s\S])*"|c"(?:[^"\\]|\\[\s\S])*"|b?' + r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|[^\n]))'",
    "csharp": r'[$]?@[$]?"(?:[^"]|"")*"|[$]?' + _DQ + "|" + _SQ,
    "scala": r'[a-z]*"""[\s\S]*?"""(?!")|[a-z]*' + _DQ + r"|'(?:[^'\\\n]|\\.)'",
    "kotlin": r'"""[\s\S]*?"""|' + _DQ + r"|'(?:[^'\\\n]|\\[^\n]+?)'",
    "swift": r'#*"""[\s\S]*?"""#*|' + _DQ,
    "elixir": r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|~[a-zA-Z](?:\"\"\"[\s\S]*?\"\"\"|\"[^\"]*\"|\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|/[^/]*/)|" + _DQ + "|" + _SQ,
    "php": r'"(?:[^"\\]|\\[\s\S])*"|' + r"'(?:[^'\\]|\\[\s\S])*'",
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_HASH_COMMENT = {"python", "ruby", "elixir"}
_NESTED_COMMENT = {"rust", "swift", "kotlin", "scala"}
#: Types after which an operand has ended, so that "/" divides and "<" compares.
_ENDED = {"ID", "NUM", "STR", "TPL", "REGEX", "SYM", ")", "]", "}", "this", "super", "null", "true", "false", "self", "nil", "end"}


class Tokens:
    """Parallel token lists of one text, with its comments, lexical errors and embedded expressions."""

    __slots__ = ("src", "types", "start", "end", "nl", "comments", "errors", "subs")

    def __init__(self, src: str) -> None:
        self.src, self.types, self.start, self.end, self.nl = src, [], [], [], []
        self.comments, self.errors, self.subs = [], [], []

    def text(self, i: int) -> str:
        return self.src[self.start[i] : self.end[i]]


def _ops(words: str) -> str:
    return "|".join(re.escape(w) for w in sorted(words.split(), key=len, reverse=True))


@lru_cache(maxsize=None)
def _pattern(lang: str):
    comment = r"#[^\n]*" if lang in _HASH_COMMENT else r"(?:#(?!\[)[^\n]*|//[^\n]*)" if lang == "php" else r"//[^\n]*"
    block = r"(?!)" if lang in _HASH_COMMENT else r"/\*" if lang in _NESTED_COMMENT else r"/\*(?:[^*]|\*(?!/))*\*/"
    name = r"[^\W\d]\w*" if lang not in ("javascript", "typescript", "java", "php", "kotlin", "scala") else r"(?:[^\W\d]|\$)[\w$]*"
    if lang == "ruby":
        name = r"(?:@@?|\$)?[^\W\d]\w*(?:[?!](?![=~]))?|\$[0-9~!@&`'+*$?:\"<>,./;]"
    if lang == "elixir":
        name = r"[^\W\d]\w*[?!]?"
    if lang == "rust":
        name = r"r#[^\W\d]\w*|[^\W\d]\w*"
    if lang == "kotlin":
        name = r"`[^`\n]+`|" + name
    strings = _STRINGS.get(lang, _DQ + "|" + _SQ) if lang != "ruby" else r"(?!)"
    return re.compile(
        rf"[ \t\f\v\r﻿]*(?:(\n)|((?:{strings}))|({name})|({_NUMBERS.get(lang, _NUM + '[a-zA-Z]*')})|({comment}|{block})|({_ops(_OPS.get(lang, _GENERIC_OPS))})|(\Z)|([\s\S]))"
    )


@lru_cache(maxsize=None)
def keywords(lang: str) -> frozenset:
    return frozenset(KEYWORDS.get(lang, "").split())


def _nested_end(src: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(src, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_RAW = re.compile(r'(?:b|c)?r(#*)"')
_LIFETIME = re.compile(r"'[^\W\d]\w*(?!')")
_HEREDOC = re.compile(r"<<([~-]?)(?:([\"'`])(\w+)\2|([A-Z_]\w*))")
_PERCENT = re.compile(r"%([qQwWiIrxs]?)([(\[{<|!/^-])")
_SYMBOL = re.compile(r":(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^\W\d]\w*[?!=]?(?![=~>])|[^\W\d]\w*[?!]?|\[\]=?|[-+*/%<>=!~^&|]+@?)")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _interpolated_end(src: str, at: int, quote: str, interpolates: bool, opener: str = "") -> int:
    """End of a Ruby string that began before ``at``; -1 when it does not end."""
    depth, n = 0, len(src)
    while at < n:
        c = src[at]
        if c == "\\":
            at += 2
            continue
        if interpolates and c == "#" and src.startswith("{", at + 1):
            at = _code_end(src, at + 2, "ruby")
            if at < 0:
                return -1
            continue
        if opener and c == opener:
            depth += 1
        elif c == quote:
            if not depth:
                return at + 1
            depth -= 1
        at += 1
    return -1


def _code_end(src: str, at: int, lang: str, subs: list | None = None) -> int:
    """End of the code in braces that began before ``at``, behind its closing brace; -1 when it does not end."""
    inner = tokenize(src, lang, at, True)
    if not inner.types or inner.types[-1] != "}":
        return -1
    if subs is not None:
        subs.append(inner)
    return inner.end[-1]


def _template_end(src: str, at: int, lang: str, subs: list) -> int:
    n = len(src)
    while at < n:
        c = src[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif c == "$" and src.startswith("{", at + 1):
            at = _code_end(src, at + 2, lang, subs)
            if at < 0:
                return -1
        else:
            at += 1
    return -1


_JSX_NAME = re.compile(r"[^\W\d][\w.:$-]*")
_JSX_ATTR = re.compile(r"\s*(?:\{|([^\W\d][\w:-]*)(\s*=\s*(?:\"[^\"]*\"|'[^']*'|(\{)|(?=<)))?)")


def _jsx_end(src: str, at: int, lang: str, subs: list) -> int:
    """End of the JSX element whose "<" stands at ``at``; -1 when it is not well formed."""
    m = _JSX_NAME.match(src, at + 1)
    name, at = (m.group(), m.end()) if m else ("", at + 1)
    while True:
        ws = re.compile(r"\s*").match(src, at).end()
        if src.startswith("/>", ws):
            return ws + 2
        if src.startswith(">", ws):
            at = ws + 1
            break
        a = _JSX_ATTR.match(src, at)
        if not a or a.end() == at:
            return -1
        at = a.end()
        if a.group(3) or a.group(1) is None:
            at = _code_end(src, at, lang, subs)
            if at < 0:
                return -1
    n = len(src)
    while at < n:
        c = src[at]
        if c == "{":
            at = re.compile(r"\s*(?:/\*[\s\S]*?\*/\s*)*").match(src, at + 1).end()
            at = at + 1 if src.startswith("}", at) else _code_end(src, at, lang, subs)
            if at < 0:
                return -1
        elif c == "<":
            if src.startswith("/", at + 1):
                close = re.compile(r"</\s*([\w.:$-]*)\s*>").match(src, at)
                return close.end() if close and close.group(1) == name else -1
            at = _jsx_end(src, at, lang, subs)
            if at < 0:
                return -1
        elif c in ">}":
            return -1
        else:
            at += 1
    return -1


def tokenize(src: str, lang: str, at: int = 0, in_braces: bool = False, jsx: bool = True) -> Tokens:
    """Tokens of ``src``; with ``in_braces`` only up to the brace that closes the one before ``at``."""
    if lang == "python":
        return _tokenize_python(src)
    out = Tokens(src)
    types, start, end, nls = out.types, out.start, out.end, out.nl
    match, words = _pattern(lang).match, keywords(lang)
    js, ruby, go, rust = lang in ("javascript", "typescript"), lang == "ruby", lang == "go", lang == "rust"
    newline, depth, n, heredocs = True, 0, len(src), []
    if js and at == 0 and src.startswith("#!"):
        at = src.find("\n") if "\n" in src else n
    while True:
        m = match(src, at)
        k = m.lastindex
        s, e = m.span(k)
        at = e
        if k == 1:
            newline = True
            if ruby:
                if heredocs:
                    for dash, tag in heredocs:
                        h = re.compile(r"^%s%s[ \t]*\r?$" % ("[ \t]*" if dash else "", re.escape(tag)), re.M).search(src, at)
                        if not h:
                            out.errors.append((at, "unterminated heredoc"))
                            at = n
                            break
                        at = min(n, h.end() + 1)
                    heredocs = []
                if src.startswith("=begin", e) and at == e:
                    c = re.compile(r"^=end[^\n]*", re.M).search(src, e)
                    out.comments.append((e, c.end() if c else n))
                    if not c:
                        out.errors.append((e, "unterminated comment"))
                    at = c.end() if c else n
                if src.startswith("__END__", at) and src[at : at + 8].strip() == "__END__":
                    at = n
            continue
        if k == 3:
            t = src[s:e]
            if rust and t in ("r", "br", "cr") and (raw := _RAW.match(src, s)):
                close = src.find('"' + raw.group(1), raw.end())
                if close < 0:
                    out.errors.append((s, "unterminated string"))
                at = e = close + 1 + len(raw.group(1)) if close >= 0 else n
                t = "STR"
            elif t not in words:
                t = "ID"
            elif types and types[-1] in (".", "?.", "&.") and t != "class":
                t = "ID"
            if ruby and t != "ID" and src.startswith(":", e) and not src.startswith("::", e):
                t = "ID"
        elif k == 2:
            t = "STR"
        elif k == 4:
            t = "NUM"
            if src[e : e + 1].isalnum() or src[e : e + 1] == "_":
                out.errors.append((s, "invalid number"))
        elif k == 6:
            t = src[s:e]
            if js and t == "/" or js and t == "/=":
                if not types or types[-1] not in _ENDED:
                    r = _JS_REGEX.match(src, s)
                    if r:
                        t, at = "REGEX", r.end()
                        e = at
            elif js and t == "<" and jsx and (not types or types[-1] not in _ENDED) and (src[e : e + 1].isalpha() or src[e : e + 1] == ">"):
                j = _jsx_end(src, s, lang, out.subs)
                if j > 0:
                    t, at = "JSX", j
                    e = at
            elif ruby:
                spaced = s > 0 and src[s - 1] in " \t" or newline
                operand = not types or newline or types[-1] not in _ENDED or (spaced and types[-1] == "ID" and src[e : e + 1] not in " \t\n=")
                if t == "<<" and (h := _HEREDOC.match(src, s)) and (operand or h.group(1) and spaced):
                    heredocs.append((h.group(1), h.group(3) or h.group(4)))
                    t, e = "STR", h.end()
                elif t == ":" and (h := _SYMBOL.match(src, s)) and (operand or spaced) and src[e : e + 1] not in " ":
                    t, e = "SYM", h.end()
                elif t in ("/", "/=") and operand:
                    e = _interpolated_end(src, s + 1, "/", True)
                    if e < 0:
                        out.errors.append((s, "unterminated regular expression"))
                        e = n
                    e = re.compile("[a-z]*").match(src, e).end()
                    t = "REGEX"
                elif t == "%" and operand and (h := _PERCENT.match(src, s)):
                    e = _interpolated_end(src, h.end(), _PAIRS.get(h.group(2), h.group(2)), h.group(1) not in ("q", "w", "i", "s"), h.group(2) if h.group(2) in _PAIRS else "")
                    if e < 0:
                        out.errors.append((s, "unterminated literal"))
                        e = n
                    t = "STR"
                elif t == "?" and operand and re.compile(r"\?(?:\\.|[^\s\\])(?!\w)").match(src, s):
                    t, e = "STR", s + (3 if src[s + 1] == "\\" else 2)
                at = e
            if in_braces:
                if t == "{":
                    depth += 1
                elif t == "}":
                    if not depth:
                        types.append(t), start.append(s), end.append(e), nls.append(newline)
                        return out
                    depth -= 1
        elif k == 5:
            if src.startswith("/*", s) and lang in _NESTED_COMMENT:
                e = _nested_end(src, s)
                if e < 0:
                    out.errors.append((s, "unterminated comment"))
                    e = n
                at = e
            if not in_braces:
                out.comments.append((s, e))
            if go and src.startswith("/*", s) and "\n" in src[s:e]:
                newline = True
            if js and "\n" in src[s:e]:
                newline = True
            continue
        elif k == 7:
            break
        else:
            c = src[s]
            if js and c == "`":
                e = _template_end(src, s + 1, lang, out.subs)
                t = "TPL"
                if e < 0:
                    out.errors.append((s, "unterminated template"))
                    e = n
            elif rust and c == "'" and (h := _LIFETIME.match(src, s)):
                t, e = "LIFE", h.end()
            elif ruby and c in "\"'`":
                e = _interpolated_end(src, s + 1, c, c != "'")
                t = "STR"
                if e < 0:
                    out.errors.append((s, "unterminated string"))
                    e = n
            elif c in "    ​　":
                continue
            elif c == "\\" and ruby and re.compile(r"\\\r?\n").match(src, s):
                at = re.compile(r"\\\r?\n").match(src, s).end()
                continue
            elif src.startswith("/*", s) and lang not in _HASH_COMMENT:
                out.errors.append((s, "unterminated comment"))
                at = n
                continue
            else:
                out.errors.append((s, "unterminated string" if c in "\"'`" else "unexpected character"))
                t = "BAD"
                if c in "\"'`":
                    e = src.find("\n", s)
                    e = n if e < 0 else e
            at = e
        types.append(t)
        start.append(s)
        end.append(e)
        nls.append(newline)
        newline = False
    types.append("EOF"), start.append(n), end.append(n), nls.append(True)
    return out


_PY_INDENT = re.compile(r"[ \t\f]*")
_PY_OPEN, _PY_CLOSE = frozenset("([{"), frozenset(")]}")


def _tokenize_python(src: str) -> Tokens:
    """Python tokens with NL, INDENT and DEDENT; brackets join lines."""
    out = Tokens(src)
    types, start, end, nls = out.types, out.start, out.end, out.nl
    match, words = _pattern("python").match, keywords("python")
    at, depth, indents, n = 0, 0, [0], len(src)

    def put(t: str, s: int, e: int) -> None:
        types.append(t), start.append(s), end.append(e), nls.append(False)

    def indent(p: int) -> int:
        """Handle the indentation of the line at ``p``; the place of its first token, or of the line's end when it is blank."""
        q = _PY_INDENT.match(src, p).end()
        if q >= n or src[q] in "\r\n#":
            return q
        w = len(src[p:q].replace("\f", "").expandtabs(8)) if q > p else 0
        if w > indents[-1]:
            indents.append(w)
            put("INDENT", p, q)
        elif w < indents[-1]:
            while w < indents[-1]:
                indents.pop()
                put("DEDENT", q, q)
            if w != indents[-1]:
                out.errors.append((q, "inconsistent dedent"))
                indents.append(w)
        return q

    at = indent(1 if src.startswith("﻿") else 0)
    while True:
        m = match(src, at)
        k = m.lastindex
        s, at = m.span(k)
        if k == 3:
            t = src[s:at]
            put(t if t in words else "ID", s, at)
        elif k == 1:
            if not depth:
                if types and types[-1] not in ("NL", "INDENT", "DEDENT"):
                    put("NL", s, at)
                at = indent(at)
        elif k == 6:
            t = src[s:at]
            if t in _PY_OPEN:
                depth += 1
            elif t in _PY_CLOSE and depth:
                depth -= 1
            put(t, s, at)
        elif k == 2:
            put("STR", s, at)
        elif k == 4:
            put("NUM", s, at)
            if src[at : at + 1].isalnum() or src[at : at + 1] == "_":
                rest = re.compile(r"\w+").match(src, at).group()
                if not rest.startswith(("if", "or", "and", "else", "in", "is", "for", "not")):
                    out.errors.append((s, "invalid number"))
            elif src[s] == "0" and at - s > 1 and src[s:at].isdigit() and src[s:at].strip("0_"):
                out.errors.append((s, "invalid number"))
        elif k == 5:
            out.comments.append((s, at))
        elif k == 7:
            break
        else:
            c = src[s]
            if c == "\\" and (h := re.compile(r"\\\r?\n").match(src, s)):
                at = h.end()
                continue
            q = re.compile(r"['\"]").match(src, s)
            out.errors.append((s, "unterminated string" if q else "unexpected character"))
            put("BAD", s, at)
            if q:
                at = n if src.startswith(c * 3, s) else src.find("\n", s) if "\n" in src[s:] else n
    if types and types[-1] not in ("NL", "DEDENT"):
        put("NL", n, n)
    for _ in indents[1:]:
        put("DEDENT", n, n)
    put("EOF", n, n)
    return out
