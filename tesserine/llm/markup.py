"""Problem 3: markup residue in docstrings.

A tolerant reader turns a text into a tree of candidate nodes: everything that could be a construct of HTML, Markdown, wiki
or LaTeX markup, look-alikes included. Each kind is looked for by itself, so candidates may overlap. Opening and closing
tags that match become one element with the nodes between them below it, and so do environments; neighbouring items and
rows stand below a list or a table. Gradient-boosted trees score every node from its features (kind, tag and attribute
tokens, density of text and of nodes in its subtree, depth, siblings, neighbouring characters). The decoder then picks the
likeliest set of nodes in which no choice contradicts another: nothing inside a verbatim construct (code, formula, comment)
is markup, items and rows stand with their list or table or not at all, and of crossing constructs one stays.

Accepted nodes give the clean text. Headings keep their level ("## "), items their dash or number, code its backticks or
fence, formulas stand as they were, cells are parted by bars; emphasis, links, tags and other marks go.

The trees are trained on texts that the rules below write (``EXAMPLES`` texts), as no labelled docstrings exist; the corpus
itself is never used to fit them, and none of its wording is in the rules.

Cases: null and empty docstrings have no nodes; repeated modules give one row per symbol; a symbol that occurs several times
in a file counts when one of its docstrings does. Texts of any length and depth are read whole. An empty table gives an
empty result.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.session import map_rows

EXAMPLES = 5000
BATCH = 512
#: Kinds of candidate nodes.
KINDS = "tag element comment entity list bullet number heading setext table row under2 under1 strike code link image auto quote fence foot rule bold3 ital2 star2 star1 wiki ext template wtable whead indent command env item math2 math1 mathp".split()
_ID = {k: i for i, k in enumerate(KINDS)}
_VERBATIM = frozenset(["code", "fence", "math2", "math1", "mathp", "comment"])
#: Kinds that stand only with the node above them, and that node's kind.
_MEMBERS = {"bullet": "list", "number": "list", "row": "table"}
# Element names of HTML, and commands of LaTeX by what they mean.
HTML_TAGS = frozenset("a abbr address article aside b bdi blockquote body br button caption center cite code col dd del details dfn div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label li link main mark meta nav nobr ol option p pre q ref s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split())
ATTRIBUTES = frozenset("align alt bgcolor border class cellpadding cellspacing colspan color face height href id lang name rel rowspan size src style target title type valign width".split())
HEADINGS = {"title": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
STYLES = frozenset("emph text textbf textit textrm textsc textsf textsl underline footnote mbox caption author".split())
LATEX = STYLES | set(HEADINGS) | frozenset("alpha begin beta cdot cite delta end epsilon frac gamma href infty int item label lambda ldots leq geq log mathbf mathrm mu neq omega pi prod ref rho sigma sqrt sum texttt theta times url verb".split())
_TYPED = frozenset(["code", "tt", "kbd", "samp", "var"])
_BREAKS = frozenset(["br", "p", "tr", "div", "ul", "ol", "table", "dl", "dd", "dt"])

# Each kind by a pattern of its own; a mark that is never closed is left at the next one of its kind, so no text is read twice.
_INLINE = {
    "comment": ("<!--", r"<!--(?:(?!<!--|-->)[\s\S])*+-->"),
    "math2": ("$$", r"\$\$[^$]++\$\$"),
    "mathp": ("\\", r"\\\((?:[^\\]|\\\\|\\(?![()\[\]]))*+\\\)|\\\[(?:[^\\]|\\\\|\\(?![()\[\]]))*+\\\]"),
    "env": ("\\", r"\\(?:begin|end)\{[a-zA-Z*]+\}"),
    "command": ("\\", r"\\(?!begin\{|end\{|item\b)[a-zA-Z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*"),
    "code": ("`", r"``[^`\n]++``|(?<!`)`[^`\n]++`(?!`)"),
    "auto": ("<", r"<(?:https?|ftp|mailto):[^\s<>]++>"),
    "tag": ("<", r"</?[a-zA-Z][\w.-]*(?:\s+[^<>\n]*+)?/?>"),
    "entity": ("&", r"&(?:[a-zA-Z]{2,10}\d{0,2}|\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6});"),
    "image": ("![", r"!\[[^\[\]\n]*+\]\([^()\n]*+\)"),
    "foot": ("[^", r"\[\^[\w-]+\]"),
    "wiki": ("[[", r"\[\[[^\[\]\n]++\]\]"),
    "ext": ("[", r"\[(?:https?|ftp)://[^\s\]]++(?:[ \t][^\]\n]*+)?\]"),
    "link": ("](", r"(?<!!)\[[^\[\]\n]++\]\([^()\n]*+\)"),
    "link ": ("][", r"\[[^\[\]\n]++\]\[[^\[\]\n]*+\]"),
    "template": ("{{", r"\{\{[^{}\n]++\}\}"),
    "bold3": ("'''", r"'''[^'\n]++'''"),
    "ital2": ("''", r"(?<!')''(?!')[^'\n]++''(?!')"),
    "strike": ("~~", r"~~[^~\n]++~~"),
    "star2": ("**", r"\*\*(?:[^*\n]|(?<!\*)\*(?!\*))++\*\*"),
    "star1": ("*", r"(?<!\*)\*(?!\*)[^*\n]++\*(?!\*)"),
    "under2": ("__", r"__(?:[^_\n]|(?<!_)_(?!_))++__"),
    "under1": ("_", r"(?<!_)_(?!_)[^_\n]++_(?!_)"),
    "math1": ("$", r"(?<!\$)\$(?!\$)[^$\n]++\$(?!\$)"),
}
_PATTERNS = [(k.strip(), hint, re.compile(p)) for k, (hint, p) in _INLINE.items()]
_LINE = re.compile(
    r"(?P<heading>[ \t]*\#{1,6}[ \t]+\S.*)"
    r"|(?P<whead>[ \t]*(?P<eq>={2,6})[ \t]*[^=\s][^=]*?(?P=eq)[ \t]*)"
    r"|(?P<row>[ \t]*\|.*\|[ \t]*)"
    r"|(?P<rule>[ \t]*(?:-{3,}|\*{3,}|_{3,}|(?:\* ){2,}\*)[ \t]*)"
    r"|(?P<foot>[ \t]*\[\^[\w-]+\]:.*)"
    r"|(?P<quote>[ \t]*>+[ \t]?.*)"
    r"|(?P<bullet>[ \t]*(?:[-+]|\*+|\#+)[ \t]+\S.*)"
    r"|(?P<number>[ \t]*\d{1,3}[.)][ \t]+\S.*)"
    r"|(?P<indent>[ \t]*:{1,4}[ \t]+\S.*)"
    r"|(?P<item>[ \t]*\\item\b.*)"
)
_FENCE = re.compile(r"[ \t]*(?:```+|~~~+)[^`\n]*$")
_FENCE_END = re.compile(r"[ \t]*(?:```+|~~~+)[ \t]*$")
_UNDERLINE = re.compile(r"[ \t]*(?:={3,}|-{3,})[ \t]*$")
_SUSPECT = re.compile(r"[<&#*`\[~|${\\]|__|_\w|''|(?m:^[ \t]*(?:[-+>:]|={3,}|-{3,}|\d{1,3}[.)]\s|==))")
_NOT_TAGS = re.compile(r"[ \t]*(?:@\w+|:\w+[^:\n]*:)")
_PROMPT = re.compile(r"[ \t]*(?:>>>|\.\.\. |\$ )")
_NAME = re.compile(r"[a-zA-Z][\w.*-]*")
_ATTRIBUTE = re.compile(r"\s([\w:-]+)\s*=")


class Node:
    """A candidate construct: its kind and place, the number of the node above it (-1: none), and its inner part."""

    __slots__ = ("kind", "begin", "end", "parent", "inner")

    def __init__(self, kind: str, begin: int, end: int, inner: tuple[int, int] | None = None) -> None:
        self.kind, self.begin, self.end, self.parent, self.inner = kind, begin, end, -1, inner


def _blocks(text: str, out: list[Node]) -> None:
    """Candidates that take whole lines, with lists and tables above their items and rows."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    ends = [i for i, (_, x) in enumerate(lines) if ("```" in x or "~~~" in x) and _FENCE_END.match(x)]
    tables = [i for i, (_, x) in enumerate(lines) if x.strip() == "|}"]
    group: list[Node] = []

    def close() -> None:
        if group:
            out.append(Node(_MEMBERS[group[0].kind], group[0].begin, group[-1].end))
            group.clear()

    inside = -1
    for i, (at, line) in enumerate(lines):
        end = at + len(line)
        if i > inside:
            for marks, last in ((_FENCE.match(line) and ("```" in line or "~~~" in line), ends), (line.lstrip().startswith("{|"), tables)):
                if marks:
                    k = bisect_right(last, i)
                    if k < len(last):
                        close()
                        inside = last[k]
                        out.append(Node("fence" if last is ends else "wtable", at, lines[inside][0] + len(lines[inside][1])))
                        break
        if not line.strip():
            close()
            continue
        if i + 1 < len(lines) and _UNDERLINE.match(lines[i + 1][1]) and not _UNDERLINE.match(line):
            out.append(Node("setext", at, lines[i + 1][0] + len(lines[i + 1][1])))
        m = _LINE.fullmatch(line)
        if m is None:
            if group and not line[0].isspace():
                close()
            continue
        node = Node(m.lastgroup if m.lastgroup != "eq" else "whead", at, end)
        kind = "whead" if m.group("whead") else node.kind
        node.kind = kind
        out.append(node)
        if kind == "heading" and re.match(r"[ \t]*#+[ \t]", line):
            # "# x" on neighbouring lines is a numbered list of a wiki.
            before = lines[i - 1][1].lstrip()[:1] if i else ""
            after = lines[i + 1][1].lstrip()[:1] if i + 1 < len(lines) else ""
            if "#" in (before, after):
                node = Node("bullet", at, end)
                out.append(node)
                kind = "bullet"
        if kind in _MEMBERS:
            if group and _MEMBERS[group[0].kind] != _MEMBERS[kind]:
                close()
            group.append(node)
        else:
            close()
    close()


def nodes_of(text: str) -> list[Node]:
    """Candidate nodes in order of their place, with parents by nesting; matching tags and environments are one node."""
    found: list[Node] = []
    _blocks(text, found)
    marks: list[tuple[int, int, str, str, bool]] = []
    for kind, hint, pattern in _PATTERNS:
        if hint in text:
            for m in pattern.finditer(text):
                if kind in ("tag", "env"):
                    raw = m.group()
                    name = _NAME.search(raw, raw.find("{") + 1 if kind == "env" else 0)
                    marks.append((m.start(), m.end(), kind, name.group().lower() if name else "", raw.startswith(("</", "\\end"))))
                else:
                    found.append(Node(kind, m.start(), m.end()))
    marks.sort()
    opened: dict[tuple[str, str], list[int]] = {}
    partner: dict[int, int] = {}
    floor = -1
    for i, (_, _, kind, name, closing) in enumerate(marks):
        stack = opened.setdefault((kind, name), [])
        if not closing:
            stack.append(i)
        else:
            while stack and stack[-1] < floor and kind == "env":
                stack.pop()
            if stack:
                partner[stack.pop()] = i
    closed = set(partner.values())
    for i, (b, e, kind, _, _) in enumerate(marks):
        if i in partner:
            j = partner[i]
            found.append(Node("element" if kind == "tag" else "env", b, marks[j][1], (e, marks[j][0])))
        elif i not in closed:
            found.append(Node(kind, b, e))
    found.sort(key=lambda n: (n.begin, -n.end, _ID[n.kind]))
    stack: list[int] = []
    for i, n in enumerate(found):
        while stack and found[stack[-1]].end <= n.begin:
            stack.pop()
        for j in reversed(stack):
            if found[j].end >= n.end:
                n.parent = j
                break
        stack.append(i)
    return found


NUMERIC = "length words share place line_start line_end before_word after_word before_space after_space inner_space known upper attributes known_attributes spaced_attribute brace digits operators same_kind siblings order children depth total doc_tag prompt upper_words camel dotted same_line level bars closing unknown_case dunder path_like subtree_nodes subtree_text member parent_verbatim parent_element crossing inner_blank".split()
_WORDY = frozenset("star1 star2 under1 under2 code strike bold3 ital2 math1 math2".split())


def features_of(text: str, nodes: list[Node]) -> list[list[float]]:
    """Feature rows of the nodes of a text."""
    n = max(1, len(text))
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    kinds: dict[str, int] = {}
    per_line: dict[int, int] = {}
    children = [0] * len(nodes)
    depth = [0] * len(nodes)
    order = [0] * len(nodes)
    covered = [0] * len(nodes)
    below = [0] * len(nodes)
    line_of = [0] * len(nodes)
    crossing = [0] * len(nodes)
    roots = 0
    last = -1
    for i, x in enumerate(nodes):
        kinds[x.kind] = kinds.get(x.kind, 0) + 1
        line_of[i] = bisect_right(starts, x.begin) - 1
        per_line[line_of[i]] = per_line.get(line_of[i], 0) + 1
        if x.parent >= 0:
            order[i] = children[x.parent]
            children[x.parent] += 1
            depth[i] = depth[x.parent] + 1
        else:
            order[i] = roots
            roots += 1
        if last >= 0 and x.begin < nodes[last].end < x.end:
            crossing[i] = 1
            crossing[last] = 1
        if last < 0 or x.end > nodes[last].end:
            last = i
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.parent >= 0:
            below[x.parent] += below[i] + 1
            covered[x.parent] += x.end - x.begin
    rows = []
    for i, x in enumerate(nodes):
        size = x.end - x.begin
        raw = text[x.begin : x.end]
        line_at = starts[line_of[i]]
        k = bisect_left(starts, x.end)
        line_end = starts[k] - 1 if k < len(starts) else len(text)
        before = text[x.begin - 1] if x.begin else "\n"
        after = text[x.end] if x.end < len(text) else "\n"
        inner = raw.strip("*_~`$<>[]{}()'|=#!/\\ \t\n-")
        name = _NAME.search(raw)
        word = name.group() if name else ""
        core = raw[1:-1] if len(raw) > 2 else ""
        if x.kind in _WORDY:
            mark = len(raw) - len(raw.lstrip("*_`~'$"))
            core = raw[mark : len(raw) - mark] if len(raw) > 2 * mark else ""
        head = raw if x.inner is None else text[x.begin : x.inner[0]]
        html_ = x.kind in ("tag", "element")
        known = word.lower() in HTML_TAGS if html_ else word in LATEX if x.kind in ("command", "env", "item") else html.unescape(raw) != raw if x.kind == "entity" else False
        attributes = _ATTRIBUTE.findall(head) if html_ else []
        stripped = raw.strip()
        level = len(stripped) - len(stripped.lstrip("#>*:-+="))
        parent = nodes[x.parent].kind if x.parent >= 0 else ""
        up = core.replace("_", "")
        row = [
            min(size, 400), min(len(inner.split()), 40), size / n, x.begin / n, float(not text[line_at : x.begin].strip()), float(not text[x.end : line_end].strip()),
            float(before.isalnum() or before in "_)]"), float(after.isalnum() or after == "_"), float(before.isspace()), float(after.isspace()),
            float(bool(core) and (core[0].isspace() or core[-1].isspace())), float(known), float(word.isupper()),
            len(attributes), sum(a.lower() in ATTRIBUTES for a in attributes), float(" " in head.strip("<>/ ")), float("{" in raw),
            sum(c.isdigit() for c in raw) / size, sum(c in "+*/=<>^|&%-" for c in raw) / size, min(kinds[x.kind], 20), min(children[x.parent] if x.parent >= 0 else roots, 30), min(order[i], 30), min(children[i], 20), depth[i], min(len(nodes), 60),
            float(_NOT_TAGS.match(text, line_at) is not None), float(_PROMPT.match(text, line_at) is not None), float(bool(up) and up.isupper() and up.isalpha()), float(bool(re.search(r"[a-z][A-Z]", word))), float("." in word),
            min(per_line[line_of[i]], 20), level, min(raw.count("|"), 20), float(html_ and raw.startswith("</")), float(html_ and not known and word[:1].isupper()),
            float(raw.startswith("__") and bool(re.fullmatch(r"__\w+__", raw))), float(bool(re.search(r"[a-zA-Z]:$", text[max(0, x.begin - 2) : x.begin])) or before in "\\/~"),
            min(below[i], 30) / size, 1 - min(covered[i], size) / size, float(parent == _MEMBERS.get(x.kind, "-")), float(parent in _VERBATIM), float(parent == "element"), float(crossing[i]), float(not inner),
        ]
        one = [0.0] * len(KINDS)
        one[_ID[x.kind]] = 1.0
        rows.append(row + one)
    return rows


# Training texts, written by rule. In a pattern "@" stands for a word, "%" for a number, "?" for a word of the list named
# with it; the kinds before a pattern's list are those that are markup in it. None of it is wording of any corpus.
_NOUNS = "apple bridge candle drawer engine feather garden hammer island jacket kettle ladder mirror needle orchard pencil quarry ribbon saddle timber umbrella valley wagon yarn zipper anchor basket copper desert".split()
_TYPES = "Apple Drawer Engine Kettle Ladder Optional Vector Box Option Pair Iterable Sequence Holder".split()
_INLINE_TAGS = "b i em strong code tt u small sub sup kbd span cite q var samp s del ins a".split()
_BLOCK_TAGS = "p div li ul ol h1 h2 h3 h4 blockquote pre td th center dd dt dl table".split()
_LONE_TAGS = "br hr p li BR HR P LI br/ hr/ wbr".split()
_ENTITIES = "amp nbsp lt gt quot mdash ndash rarr larr copy hellip times eacute uuml middot".split()
_GREEK = "alpha beta gamma delta lambda sigma theta omega mu pi".split()
_ENVIRONMENTS = "itemize enumerate equation verbatim align quote center description".split()
_MATH = ["n", "x_%", "n^%", "O(n)", "O(n \\log n)", "n \\leq %", "\\?greek", "2^k", "x + y", "a = b", "n > %", "\\sqrt{n}", "\\frac{@}{%}", "T(n) = n^%", "k_i", "\\sum_i x_i", "p \\cdot q", "\\?greek_%", "n / %", "x"]
_MARKUP: list[tuple[str, list[str]]] = [
    ("element", ["<?inline>@</?inline>", "@ <?inline>@ @</?inline> @", "<?inline>@ @</?inline>: @ @.", "<?block>@ @ @.</?block>", "<?block class=\"@\">@ @</?block>", "<?inline id='@'>@</?inline> @ @.", "<?block>\n@ @ @.\n</?block>", '@ <a href="@/@.html">@ @</a>', '<a href="@://@.test/@">@ @</a>', "<A HREF=\"@.html\">@</A>", "<?block><?inline>@</?inline> @ @</?block>", "<table> <tr><td>@</td> <td>%</td></tr> </table>", "<ul>\n<li>@ @</li>\n<li>@ @ @</li>\n</ul>", "<ol><li>@</li><li>@ @</li></ol>", "x<sup>%</sup> @", "<ref>@ @</ref>", "<?block align=center>@</?block>"]),
    ("tag", ["<?lone>", "@ @ @.<?lone>@ @.", "<?lone>@ @ @.", "@ @ @.\n<?lone>\n@ @ @.", "<?block>@ @ @.", "<p class=@>@ @ @.", '<img src="@.png" alt="@">', "<?lone>@ @.\n<?lone>@ @ @.", "<P ALIGN=right>@ @."]),
    ("comment", ["<!-- @ -->", "<!-- @ @ @ -->", "<!--@-->", "<!--\n@ @\n@\n-->"]),
    ("entity", ["@ &?entity; @ @", "&?entity;", "@ &?entity; @&?entity;@", "@&#%; @ @.", "&#x%;@", "% &?entity; %"]),
    ("heading", ["# @ @", "## @ @", "### @", "#### @ @ @", "## @ @ ##", "# @\n\n@ @ @.", "## `@` @"]),
    ("setext", ["@ @\n=======", "@ @ @\n-------", "@\n====", "@ @\n----------\n\n@ @ @."]),
    ("list bullet", ["- @ @ @.\n- @ @.", "+ @ @ @.\n+ @ @.", "* @ @ @.\n* @ @.", "* @\n* @\n* @", "- @\n- @ @\n- @ @ @", "@ @:\n\n  * @ @\n  * @", "- @ @.", "* @ @ @.\n** @ @.", "- @\n  - @ @\n  - @", "* @: @ @\n* @: @", "# @ @ @.\n# @ @.", "- @ -- @ @ @\n- @ -- @ @"]),
    ("list number", ["1. @ @ @.\n2. @ @.", "1) @ @.\n2) @ @.", "1. @\n2. @\n3. @ @", "1. @ @ @."]),
    ("list bullet star1 star2", ["- **@**: @ @.\n- *@*: @ @."]),
    ("star2", ["**@** @ @.", "@ **@ @** @.", "**@:** @ @.", "@ @ **@**", "**@ `@` @**"]),
    ("star1", ["*@* @ @.", "@ *@ @* @.", "@ @ *@*.", "(*@*)"]),
    ("under2", ["@ __@ @__ @.", "__@ @ @__"]),
    ("under1", ["_@ @_ @ @.", "@ _@_ @ @.", "@ @ _@ @ @_."]),
    ("strike", ["~~@ @ @.~~", "@ ~~@~~ @"]),
    ("code", ["@ `@=@` @ @.", "@ `@(@)` @.", "`@`", "`@_@` @ @", "@ ``@`` @.", "`@.@`: @ @.", "@ @ `%`", "`--@`", "@ `*@` @ `<@>` @", "`$@ * @`"]),
    ("link", ["@ [@ @](https://@.test/@#@) @.", "[@](@.md)", "@ [@][%].", "[@ @][]", "@ [`@`](#@) @", "[@](@ \"@ @\")"]),
    ("image", ["![@ @](img/@.png)", "@ ![@](https://@.test/@.svg)", "![](@.png)"]),
    ("auto", ["@ <https://@.test/@>", "<mailto:@@@.test>", "<http://@.test>"]),
    ("quote", ["> @ @ @.\n> @ @.", "> @ @ @.", ">> @ @\n> @", "@ @:\n\n> @ @ @"]),
    ("fence", ["```\n@ --@\n```", "```@\n@ --@ --@=%\n```", "~~~@\n@ --@ --@=%\n~~~", "```\n@(@)\n\n@ = %\n```", "```\n- @\n# @\n```"]),
    ("table row", ["| @ | @ |\n|--|--|\n| @ | % |", "|@|@|@|\n|:--|--:|---|\n|@|%|%|", "| @ | @ |\n| --- | --- |\n| @ @ | @ |\n| @ | % |"]),
    ("foot", ["@ @.[^%]\n\n[^%]: @ @ @.", "@ @[^@]", "[^@]: @ @."]),
    ("rule", ["***", "---", "----\n@ @ @.", "* * *", "@ @.\n\n---\n\n@ @ @."]),
    ("bold3", ["'''@''' @ @ @.", "@ '''@ @''' @"]),
    ("ital2", ["''@'' @. @ @ @.", "@ ''@ @'' @."]),
    ("wiki", ["[[@ @]]", "@ [[@]].", "@ [[@|@ @]] @", "[[@:@]] @ @"]),
    ("ext", ["@ [https://@.test/@ @ @]", "[http://@.test @]", "@ [https://@.test/@]"]),
    ("template", ["{{@|@ @}}", "{{@|@=@}}", "{{@}} @ @"]),
    ("wtable", ['{| class="@"\n|-\n| @ || @\n|}', "{|\n! @ !! @\n|-\n| @ || %\n|}"]),
    ("whead", ["== @ ==", "=== @ @ ===", "== @ @ ==\n@ @ @.", "==@=="]),
    ("indent", [":: @ @ @.", ": @ @ @.", "; @\n: @ @"]),
    ("command", ["\\section{@}", "\\subsection{@ @}", "\\textbf{@} @.", "\\emph{@} @ @.", "\\texttt{@}", "@ \\cite{@}.", "@ \\ref{@:@} @", "\\textit{@ @}", "\\footnote{@ @.}", "\\url{@}", "@ \\?greek @", "\\frac{@}{%}", "\\href{@}{@ @}", "@ \\underline{@}", "\\label{@}", "\\chapter*{@}"]),
    ("env item", ["\\begin{?env}\n\\item @ @.\n\\item @ @.\n\\end{?env}", "\\begin{?env}\n@ = @\n\\end{?env}"]),
    ("math2", ["$$ ?math $$", "$$?math$$", "$$\n?math\n$$"]),
    ("math1", ["@ $?math$ @ @.", "@ @ $?math$ @ $?math$ @.", "$?math$", "@ ($?math$)"]),
    ("mathp", ["@ \\(?math\\); @ @.", "\\[ ?math \\]", "\\(?math\\)", "\\[\n?math\n\\]"]),
]


def _operators(r: random.Random) -> str:
    v = lambda: r.choice([r.choice("abcxyznkij"), r.choice(_NOUNS), str(r.randint(0, 99)), f"{r.choice('abcxy')}[{r.randint(0, 9)}]", f"|{r.choice('abxy')}|"])
    ops = "+ - * / < > <= >= == != && || & | ^ << >> ** // % -> => := .. ::".split()
    glue = r.choice([" ", " ", " ", ""])
    out = v()
    for _ in range(r.randint(1, 5)):
        out += glue + r.choice(ops) + glue + v()
    return out


def _generic(r: random.Random, depth: int = 0) -> str:
    t = r.choice(_TYPES + _NOUNS + ["int", "str", "T", "K", "V"])
    if depth > 2 or r.random() < (0.2 if not depth else 0.5):
        return t
    inner = ", ".join(_generic(r, depth + 1) for _ in range(r.randint(1, 2)))
    return f"{t}<{inner}>" if r.random() < 0.7 else f"{t}[{inner}]"


def _regex(r: random.Random) -> str:
    atom = lambda: r.choice(["\\d", "\\w", "\\s", "\\S", ".", "[a-z]", "[A-Z0-9_]", "(\\w+)", "(?:@|@)", "\\.", "\\b", "[^/]", "(@)", "\\n", "\\t", "\\$", "\\(", "\\[", "[*_]"]) + r.choice(["", "", "+", "*", "?", "{%}", "+?"])
    return r.choice(["", "^"]) + "".join(atom() for _ in range(r.randint(1, 5))) + r.choice(["", "$"])


_PLAIN = [
    "<@>", "<@-@>", "<@_@>", "<@> <@>", "[<@>]", "<@>:<@>", "@ <@> @ <@> @ @.", "@ <@>=<@>", "<@ @>", "<your-@>", "<@...>", "<@|@>", "<@.@>", "<@/@>", "<@>/<@>.@", "</@>", "<?type>", "@ @ <- @", "<=>", "< @", "@ >", "a<b",
    "C:\\@\\@", "c:\\@\\@.@ @", "\\\\@\\@", "/@/@/@", "~/.@/@", "~/@/*", "@/*.@", "@/**/@", "../@/_@_", "./@_@/@_%", "%userprofile%\\@",
    "$@", "$?up", "${?up}", "$?up @ $?up", "${@:-@}", "@ $?up/@ @ $?up/@.", "$% @ $%", "$%.% @ %%", "%$ @ %$", "$1 @ $2", "$(@ @)", "US$%", "@=$?up", "export ?up=$@", "$$", "$", "$@.$@",
    "https://@.test/@#@", "@ (see https://@.test/@_@_@)", "http://@.test/~@/*", "https://@.test/@?a=%&b=%", "ftp://@.test/@_@", "www.@.test/@_@_", "https://@.test/@*@*",
    ">>> @(%)", ">>> @(%)\n%", ">>> x = @\n>>> x", ">>> @\n... @", "$ @ --@", "$ @ $?up", "... @", "# @ --@"[2:], "In [%]: @", "% @ %", ">>> @[%](@)",
    "@param @ the @ @ @", "@param @\n@return", "@return @ @", "@throws ?type @ @", "@see ?type#@", "@param <T> the @ @", ":param @: the @ @", ":param @:\n:return:", ":returns: @", ":raises ?type: @ @", ":type @: ?type", ":@: @ @",
    "Args:\n    @: @ @ @\n    @_@: @ @", "Parameters:\n  @ - the @\n  @ - the @", "Returns:\n    @ @ @.", "Args:\n    *@: @ @\n    **@: @ @", "Parameters\n  @ : ?type\n    @ @ @", "Keyword arguments:\n  @ (?type): @ @ @\n  @_@ (?type, optional): @", "  @ -- @ @\n  @ -- @",
    "{@inheritDoc}", "{@link @}", "{@code @}", "{@}", "{@: %}", "{@, @}", "${@}", "%s @ %d", "{%} @", "#{@}", "{@}/{@}",
    "*@", "**@", "*@, **@", "*@ @ **@ @", "@ *@ @ @", "@*", "(*@, **@)", "&@", "&mut @", "&'a @", "@ && @", "AT&T; @", "R&D", "&@;@"[:2], "'a, 'b", "''", "@'s @ isn't @'s", "it's", "\"@\"", "'@'", "'@' @ '@'", "''.@(@)",
    "_@", "@_", "@_@", "@_@_@", "_@_@_", "__@__", "__@__ @ __@__", "@.__@__", "_@ @ @_", "@__@", "__?up__", "self._@ @ self._@", "__@", "_",
    "#%", "#@", "#include <@.h>", "#![@(@)]", "#[@]", "C# @ F#", "# "[:1], "@ #% @ #%", "#!/@/@", "#ff%", "@#@",
    "@[%]", "@[%][%]", "@[@](@)", "f(x)[%](y)", "@ [%, %) @", "@ [@] [@]", "[@]", "[@] @", "[x] @", "[%]", "[%, %]", "[[%, %], [%, %]]", "@[@][@]", "[@, @] (@)", "[^@]"[:1], "[a-z]", "(@) [@]",
    "~%", "~@", "~", "~ @", "!@", "@ | @", "|@|", "|@| @ |@|", "@|@|@", "||", "@ || @ || @", "|-@", "|",
    "\\n", "\\n @ \\t", "\\@", "@\\", "\\0", "\\u%", "\\x%", "\\\\", "'\\n'", "\"\\t\"", "\\d+", "\\%",
    "-", "--", "-@", "--@", "-% @", "--@=@ -v", "-x @ -y", "@ - @", "@ -- @", "- %", "-1", "+@", "+%", "+ %"[:1], "% + %", "@ -> @", "...", "=", "==", "=>", ":", "::", "@::@::@", "@: @", "%:%", "% * %", "%. @"[3:], "%.%", "v%.%.%", "(%) @ (%) @", "`", "@ ` @", "``", "*", "**", "* %"[:1], "%*", "@ * @ * @", "% * @ = %", "a*b*c", "2*@*3", "^@", "@^%", "%%", "n/a", "N/A", "TODO: @", "FIXME(@): @", "@@", "@ @", "i++", "@; @", "@? @", "<%", ">%", ">= % @ <= %", "@ < @ @ > @", "x > y", "> %"[2:],
]


def _sentence(r: random.Random) -> str:
    w = [r.choice(_NOUNS) for _ in range(r.randint(3, 20))]
    for i in range(1, len(w), 2):
        w[i] = r.choice(["the", "a", "of", "and", "when", "is", "to", "every", "its", "has"])
    return " ".join(w).capitalize() + r.choice([".", ".", ".", ":", "; " + r.choice(_NOUNS) + ".", "", "!"])


def _filled(r: random.Random, pattern: str) -> str:
    if r.random() < 0.6:
        pattern = re.sub(r"@(?: @)+[.]", lambda m: "\1" + _sentence(r), pattern)
    picks: dict[str, str] = {}
    lists = {"inline": _INLINE_TAGS, "block": _BLOCK_TAGS, "lone": _LONE_TAGS, "entity": _ENTITIES, "greek": _GREEK, "env": _ENVIRONMENTS, "type": _TYPES, "up": [n.upper() for n in _NOUNS] + ["HOME", "PATH", "TMPDIR"], "math": _MATH}

    def pick(m) -> str:
        k = m.group(1)
        if k in ("inline", "block", "env"):
            return picks.setdefault(k, r.choice(lists[k]))
        return r.choice(lists[k])

    for _ in range(2):
        pattern = re.sub(r"\?(inline|block|lone|entity|greek|env|type|up|math)", pick, pattern)
    kept = re.sub(r"@(?=param\b|return\b|throws\b|see\b|@)|(?<=\{)@(?=inherit|link |code )", "\0", pattern)
    out = re.sub("@", lambda m: r.choice(_NOUNS).capitalize() if r.random() < 0.25 else r.choice(_NOUNS), kept).replace("\0", "@").replace("\1", "")
    return re.sub("%(?![a-z])", lambda m: str(r.choice([r.randint(0, 9), r.randint(10, 999)])), out)


def training_texts(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, list[tuple[int, int, frozenset]]]]:
    """Texts with the places of their markup and the kinds that are markup there."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, marked = "", []
        for _ in range(r.randint(1, 3)):
            roll = r.random()
            kinds = None
            if roll < 0.3:
                piece = _sentence(r)
            elif roll < 0.63:
                names, patterns = r.choice(_MARKUP)
                kinds = frozenset(names.split())
                piece = _filled(r, r.choice(patterns))
            elif roll < 0.72:
                piece = r.choice([_operators, _generic, lambda q: _filled(q, _regex(q))])(r)
                if r.random() < 0.6:
                    piece = " ".join([r.choice(_NOUNS) for _ in range(r.randint(1, 5))] + [piece] + [r.choice(_NOUNS) for _ in range(r.randint(0, 4))]) + "."
            else:
                piece = _filled(r, r.choice(_PLAIN))
                if r.random() < 0.3:
                    piece = " ".join(r.choice(_NOUNS) for _ in range(r.randint(1, 5))) + " " + piece + r.choice(["", ".", " " + _sentence(r), " and " + _filled(r, r.choice(_PLAIN))])
            alone = piece.startswith(tuple("#=-+*>|`~:;0123456789{\\<[.'_$")) and (kinds is None or not kinds & _INLINE.keys() or "\n" in piece) or "\n" in piece or kinds is None and piece.startswith(("@", "In [")) or kinds and not kinds & (_INLINE.keys() | {"element"})
            joint = r.choice(["\n", "\n\n"]) if alone or r.random() < 0.4 else " "
            if text:
                text += joint if not (kinds and "setext" in kinds) else "\n\n"
            if not alone and r.random() < 0.4:
                text += " ".join([r.choice(_NOUNS).capitalize()] + [r.choice(_NOUNS + ["the", "of", "a", "to"]) for _ in range(r.randint(0, 7))]) + " "
            if kinds:
                marked.append((len(text), len(text) + len(piece), kinds))
            text += piece
            if alone and r.random() < 0.5:
                text += r.choice(["\n", "\n\n"]) + _sentence(r)
            elif not alone and r.random() < 0.3:
                text += r.choice([" ", ". ", ", "]) + _sentence(r)
        out.append((text, marked))
    return out


def labels_of(nodes: list[Node], marked: list[tuple[int, int, frozenset]]) -> list[float | None]:
    """1 for the nodes that are markup, 0 for those that are not, None for those inside a construct of another kind."""
    out: list[float | None] = []
    for n in nodes:
        label: float | None = 0.0
        for b, e, kinds in marked:
            if n.begin >= b - 1 and n.end <= e + 1:
                label = 1.0 if n.kind in kinds else None
            elif n.begin <= b and n.end >= e and n.kind in kinds:
                label = 1.0
        out.append(label)
    return out


@lru_cache(maxsize=1)
def model():
    """Trees fitted to the training texts."""
    import numpy as np

    from tesserine.llm.boosting import Boosted

    rows, labels = [], []
    for text, marked in training_texts():
        nodes = nodes_of(text)
        if nodes:
            for row, label in zip(features_of(text, nodes), labels_of(nodes, marked)):
                if label is not None:
                    rows.append(row)
                    labels.append(label)
    return Boosted(trees=60, depth=4).fit(np.array(rows), np.array(labels))


def decode(nodes: list[Node], scores: list[float]) -> list[bool]:
    """The likeliest consistent set of markup nodes.

    For every node two values are kept, bottom up: the best total below it when it is taken, and when it is not. A taken
    verbatim node forbids everything below it; items and rows are taken with their list or table and never without it; of
    crossing nodes the better stays. No step recurses, so depth has no limit.
    """
    n = len(nodes)
    member = [x.parent >= 0 and _MEMBERS.get(x.kind) == nodes[x.parent].kind for x in nodes]
    score = list(scores)
    counts = [0] * n
    for i, x in enumerate(nodes):
        if member[i]:
            counts[x.parent] += 1
            score[x.parent] += scores[i]
    for i in range(n):
        if counts[i]:
            score[i] /= counts[i] + 1
    free = [0.0] * n
    bound = [0.0] * n
    take, skip = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        kind = nodes[i].kind
        take[i] = score[i] + (0.0 if kind in _VERBATIM else free[i] + bound[i])
        skip[i] = free[i] + bound[i]
        p = nodes[i].parent
        if p >= 0:
            if member[i]:
                bound[p] += free[i] + bound[i]
            else:
                free[p] += max(take[i], skip[i])
    chosen, open_ = [False] * n, [True] * n
    for i, x in enumerate(nodes):
        p = x.parent
        open_[i] = p < 0 or open_[p] and not (chosen[p] and nodes[p].kind in _VERBATIM)
        chosen[i] = open_[i] and (chosen[p] if member[i] else take[i] > skip[i])
    # Crossing nodes: those that begin inside a chosen one and end behind it, in order of their place.
    stack: list[int] = []
    for i, x in enumerate(nodes):
        if not chosen[i]:
            continue
        while stack and (not chosen[stack[-1]] or nodes[stack[-1]].end <= x.begin):
            stack.pop()
        for j in reversed(stack):
            if chosen[j] and x.begin < nodes[j].end < x.end and not (x.parent == j or member[i] or member[j]):
                worse = i if score[i] <= score[j] else j
                chosen[worse] = False
                if worse == i:
                    break
        if chosen[i]:
            stack.append(i)
    environment = any(chosen[i] for i, x in enumerate(nodes) if x.kind == "env")
    for i, x in enumerate(nodes):
        if x.kind == "item" and chosen[i] and not environment and score[i] < 1:
            chosen[i] = False
        if member[i] and chosen[i] and not chosen[x.parent]:
            chosen[i] = False
    return chosen


def markup_of(texts: list[str]) -> list[tuple[list[Node], list[bool]]]:
    """Nodes and decisions of every text."""
    import numpy as np

    trees = [nodes_of(t) if t and _SUSPECT.search(t) else [] for t in texts]
    rows = [r for t, ns in zip(texts, trees) if ns for r in features_of(t, ns)]
    z = model().score(np.array(rows)).tolist() if rows else []
    out, at = [], 0
    for ns in trees:
        out.append((ns, decode(ns, z[at : at + len(ns)]) if ns else []))
        at += len(ns)
    return out


def _script(text: str, sign: str) -> tuple[str, str]:
    """What stands before and behind a superscript or subscript."""
    return (sign, "") if re.fullmatch(r"\w+", text) else (sign + "(", ")")


def clean(text: str, nodes: list[Node], chosen: list[bool]) -> str:
    """The text without its markup; headings with their level, items, code and formulas stay.

    Every accepted node contributes replacements for its own marks only, so nesting needs no recursion.
    """
    edits: list[tuple[int, int, str]] = []
    verbatim_until = -1
    numbers: dict[tuple[int, int], int] = {}

    def around(n: Node, lead: str, tail: str, before: str = "", after: str = "") -> None:
        a = re.compile(lead).match(text, n.begin, n.end)
        begin = a.end() if a else n.begin
        b = re.search(rf"(?:{tail})\Z", text[begin : n.end])
        end = begin + b.start() if b else n.end
        edits.append((n.begin, begin, before))
        edits.append((end, n.end, after))

    def ordered(i: int) -> bool:
        p = nodes[i].parent
        while p >= 0:
            x = nodes[p]
            if x.kind == "element" and (t := _NAME.search(text, x.begin)) and t.group().lower() in ("ol", "ul"):
                return t.group().lower() == "ol"
            if x.kind == "env":
                return "enumerate" in text[x.begin : x.inner[0] if x.inner else x.end]
            p = x.parent
        return False

    def dash(i: int, order: bool, level: int = 0) -> str:
        if not order:
            return "- "
        key = (nodes[i].parent, level)
        numbers[key] = numbers.get(key, 0) + 1
        return f"{numbers[key]}. "

    for i, (n, c) in enumerate(zip(nodes, chosen)):
        if not c or n.begin < verbatim_until:
            continue
        kind, raw = n.kind, text[n.begin : n.end]
        if kind in ("heading", "whead"):
            mark = "=" if kind == "whead" else "#"
            if n.parent >= 0 and chosen[n.parent] and nodes[n.parent].kind == "bullet":
                continue
            level = len(raw.strip()) - len(raw.strip().lstrip(mark))
            around(n, rf"\s*{mark}+\s*", rf"\s*{mark}*\s*", "#" * level + " ")
        elif kind == "setext":
            at = raw.index("\n")
            edits.append((n.begin, n.begin, "# " if raw[at:].strip()[0] == "=" else "## "))
            edits.append((n.begin + at, n.end, ""))
        elif kind == "bullet":
            m = re.match(r"([ \t]*)([-+*#]+)[ \t]+", raw)
            level = len(m.group(2)) - 1
            edits.append((n.begin, n.begin + m.end(), m.group(1) + "  " * level + dash(i, m.group(2)[0] == "#", level)))
        elif kind == "number":
            m = re.match(r"([ \t]*\d+)[.)][ \t]+", raw)
            edits.append((n.begin, n.begin + m.end(), m.group(1) + ". "))
        elif kind == "item":
            m = re.match(r"[ \t]*\\item\b(?:\[([^\]\n]*)\])?[ \t]*", raw)
            edits.append((n.begin, n.begin + m.end(), dash(i, ordered(i)) + (m.group(1) + ": " if m.group(1) else "")))
        elif kind == "quote":
            around(n, r"[ \t]*>+[ \t]?", "")
        elif kind == "indent":
            around(n, r"[ \t]*:+[ \t]*", "")
        elif kind in ("fence", "code", "math1", "math2", "mathp"):
            verbatim_until = n.end
        elif kind in ("strike", "bold3", "ital2", "star1", "star2", "under1", "under2"):
            k = 3 if kind == "bold3" else 1 if kind in ("star1", "under1") else 2
            edits += [(n.begin, n.begin + k, ""), (n.end - k, n.end, "")]
        elif kind in ("link", "image"):
            around(n, r"!?\[", r"\](?:\([^()\n]*\)|\[[^\[\]\n]*\])")
        elif kind in ("wiki", "template"):
            k = raw.rfind("|") + 1 or 2
            edits += [(n.begin, n.begin + k, ""), (n.end - 2, n.end, "")]
        elif kind == "ext":
            k = len(raw) - len(raw.partition(" ")[2]) if " " in raw else 1
            edits += [(n.begin, n.begin + k, ""), (n.end - 1, n.end, "")]
        elif kind == "auto":
            edits += [(n.begin, n.begin + 1, ""), (n.end - 1, n.end, "")]
        elif kind == "row":
            if re.fullmatch(r"[\s|:-]+", raw):
                edits.append((n.begin, min(n.end + 1, len(text)), ""))
            else:
                around(n, r"\s*\|\s*", r"\s*\|\s*")
        elif kind == "wtable":
            at = n.begin
            for line in raw.split("\n"):
                m = re.match(r"\s*(?:\{\||\|\}|\|-)[^\n]*", line)
                if m:
                    edits.append((at, min(at + len(line) + 1, n.end), ""))
                else:
                    m = re.match(r"\s*[|!]\+?\s*", line)
                    if m:
                        edits.append((at, at + m.end(), ""))
                    for s in re.finditer(r"\s*(?:\|\||!!)\s*", line):
                        edits.append((at + s.start(), at + s.end(), " | "))
                at += len(line) + 1
        elif kind == "foot":
            if n.parent >= 0 and chosen[n.parent] and nodes[n.parent].kind == "foot":
                continue
            m = re.match(r"\s*\[\^([\w-]+)\](:?)\s*", raw)
            edits.append((n.begin, n.begin + m.end(), f"[{m.group(1)}]" + (" " if m.group(2) else "")))
        elif kind == "entity":
            edits.append((n.begin, n.end, html.unescape(raw)))
        elif kind in ("rule", "comment"):
            edits.append((n.begin, n.end, ""))
            verbatim_until = n.end
        elif kind == "command":
            m = re.match(r"\\([a-zA-Z]+)\*?(?:\[[^\]\n]*\])?", raw)
            name, groups = m.group(1), [(g.start(), g.end()) for g in re.finditer(r"\{[^{}\n]*\}", raw)]
            if not groups or name not in STYLES and name not in HEADINGS and name not in ("texttt", "verb", "cite", "ref", "eqref", "label", "href", "url"):
                continue  # a formula's command, or one unknown here: it stays as it is
            b, e = groups[-1]
            before, after = ("#" * HEADINGS[name] + " ", "\n") if name in HEADINGS else ("`", "`") if name in ("texttt", "verb") else ("[", "]") if name in ("cite", "ref", "eqref", "label") else ("", "")
            edits += [(n.begin, n.begin + b + 1, before), (n.begin + e - 1, n.end, after)]
        elif kind == "env":
            name = re.search(r"\{(\w+)", raw)
            name = name.group(1) if name else ""
            if name in ("verbatim", "lstlisting") and n.inner:
                edits += [(n.begin, n.inner[0], "```"), (n.inner[1], n.end, "```")]
                verbatim_until = n.inner[1]
            elif name in ("equation", "align", "math", "displaymath", "gather", "array", "matrix"):
                verbatim_until = n.end
            elif n.inner:
                edits += [(n.begin, n.inner[0], ""), (n.inner[1], n.end, "")]
            else:
                edits.append((n.begin, n.end, ""))
        elif kind in ("tag", "element"):
            name = _NAME.search(raw)
            name = name.group().lower() if name else ""
            before = after = ""
            if re.fullmatch("h[1-6]", name):
                before, after = "\n" + "#" * int(name[1]) + " ", "\n"
            elif name == "li":
                before = ("" if n.begin and text[n.begin - 1] == "\n" else "\n") + dash(i, ordered(i))
            elif name in _TYPED:
                before = after = "`"
            elif name == "pre":
                before, after = "\n```\n", "\n```\n"
            elif name in ("sup", "sub") and n.inner:
                before, after = _script(text[slice(*n.inner)], "^" if name == "sup" else "_")
            elif name in ("td", "th"):
                after = " | "
            elif name in _BREAKS:
                before, after = "\n", "\n" if name != "br" else ""
            if n.inner:
                edits += [(n.begin, n.inner[0], before), (n.inner[1], n.end, after)]
            else:
                lone = raw.startswith("</")
                edits.append((n.begin, n.end, after if lone else before if name not in _TYPED and name not in ("sup", "sub") else ""))
    edits.sort(key=lambda e: (e[0], e[1]))
    out, at = [], 0
    for b, e, new in edits:
        if b < at:
            if e > at:
                at = e
            continue
        out += [text[at:b], new]
        at = e
    out.append(text[at:])
    joined = "".join(out)
    pieces = re.split(r"(^[ \t]*(?:```|~~~)[^\n]*\n[\s\S]*?^[ \t]*(?:```|~~~)[ \t]*$)", joined, flags=re.M)
    return "".join(p if k % 2 else re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", p)) for k, p in enumerate(pieces)).strip()


def docstrings(modules: DataFrame) -> DataFrame:
    """The parts of modules that hold docstrings, and nothing else."""
    pick = lambda f: F.struct(f["name"].alias("name"), f["docstring"].alias("docstring"))
    return modules.select(
        "file_id",
        "docstring",
        F.transform("functions", pick).alias("functions"),
        F.transform("classes", lambda c: F.struct(c["name"].alias("name"), c["docstring"].alias("docstring"), F.transform(c["methods"], pick).alias("methods"))).alias("classes"),
    )


def symbols_of(r: dict):
    """(symbol, docstring) of everything in a module row that has a docstring."""
    if r["docstring"]:
        yield "", r["docstring"]
    for f in r["functions"] or []:
        if f and f["docstring"]:
            yield f["name"] or "", f["docstring"]
    for c in r["classes"] or []:
        if not c:
            continue
        if c["docstring"]:
            yield c["name"] or "", c["docstring"]
        for f in c["methods"] or []:
            if f and f["docstring"]:
                yield f"{c['name'] or ''}.{f['name'] or ''}", f["docstring"]


def _batches(rows):
    held = []
    for r in rows:
        for symbol, text in symbols_of(r):
            held.append((r["file_id"], symbol, text))
        if len(held) >= BATCH:
            yield held
            held = []
    if held:
        yield held


def docstrings_with_markup(modules: DataFrame) -> DataFrame:
    """Rows (file_id, symbol) of docstrings with at least one construct of markup."""
    shared = modules.sparkSession.sparkContext.broadcast(model())

    def run(rows):
        _keep(shared.value)
        for held in _batches(rows):
            for (file, symbol, _), (_, chosen) in zip(held, markup_of([h[2] for h in held])):
                if any(chosen):
                    yield file, symbol

    return map_rows(docstrings(modules), run, "file_id bigint, symbol string").distinct()


def clean_docstrings(modules: DataFrame) -> DataFrame:
    """Rows (file_id, symbol, constructs, text): every docstring as clean text with the number of constructs removed."""
    shared = modules.sparkSession.sparkContext.broadcast(model())

    def run(rows):
        _keep(shared.value)
        for held in _batches(rows):
            for (file, symbol, text), (nodes, chosen) in zip(held, markup_of([h[2] for h in held])):
                yield file, symbol, sum(chosen), clean(text, nodes, chosen)

    return map_rows(docstrings(modules), run, "file_id bigint, symbol string, constructs int, text string").distinct()


def _keep(trees) -> None:
    """Use the broadcast trees in this worker instead of training them again."""
    global model
    if getattr(model, "kept", None) is None:

        def kept():
            return trees

        kept.kept = True
        model = kept
