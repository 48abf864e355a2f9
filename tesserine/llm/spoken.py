"""Problem 2: natural language inside code.

Comments and strings are found by a lexer whose state (code, a comment, a string, with nesting depth, closing tag or number
of hashes where the language has such) is all that must be known to go on at any place. A file longer than ``CHUNK`` is cut
into chunks that are lexed on different executors: each chunk gives the function from the state before it to the state
behind it, these functions are composed by a parallel prefix, and then each chunk is read from its true first state.
Spans that go on behind a cut are put together again, so the result does not depend on the chunk size.

Neighbouring comment lines and concatenated strings are joined, comment marks and escapes removed, and the text is cut
into sentences; short neighbours are judged together. A multinomial logistic regression on hashed byte n-grams labels each.
It is fitted to a bounded sample of labelled pages (``SAMPLE`` pages and ``SENTENCES`` sentences per language, both drawn
by hash), twice, the second time without the sentences whose label the first fit rejects.

Cases: null or empty content has no passages; languages unknown to the lexer are read like C; a string that its line does
not close ends there; repeated versions give one row; passages under six words (twelve characters of Chinese) count for no
language. An empty table of pages leaves no model, and then no passages are labelled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.syntax import language_of
from tesserine.session import map_rows, stored

LANGUAGES = ["en", "de", "es", "fr", "it", "pl", "pt", "ru", "zh"]
SAMPLE = 300
SENTENCES = 1200
#: Characters beyond which a file is lexed in chunks.
CHUNK = 1 << 20
#: Sentences are labelled in batches of so many files.
BATCH = 256
FEWEST_WORDS, FEWEST_HAN = 6, 12
SURE = 0.5
#: How many times as often a sentence in code is English than each other language; the classes of the sample are equal.
ENGLISH = 10
_ORDERS, _BITS = (3, 5), 16

# The lexer. For each language: an alternation that finds the next comment or string, and for each way to be inside one a
# pattern that finds its end. Group names say which state an opening leads to.
_BLOCK = r"(?P<block>/\*)"
_LINE = r"(?P<line>//)"
_PLAIN = r"(?P<dq>\")|(?P<sq>')"
_OPEN = {
    "python": r"(?P<line>\#)|(?P<tdq>\"\"\")|(?P<tsq>''')|" + _PLAIN,
    "javascript": rf"{_LINE}|{_BLOCK}|{_PLAIN}|(?P<tick>`)",
    "go": rf"{_LINE}|{_BLOCK}|{_PLAIN}|(?P<tick>`)",
    "java": rf"{_LINE}|{_BLOCK}|(?P<tdq>\"\"\")|{_PLAIN}",
    "ruby": r"(?P<begin>^=begin\b)|(?P<line>\#(?!\{))|(?P<wait><<[~-]?(?:[\"'`]\w+[\"'`]|[A-Z_]\w*))|(?P<mdq>\")|(?P<msq>')",
    "rust": rf"{_LINE}|(?P<nest>/\*)|(?P<raw>\bb?r\#*\")|(?P<mdq>\")|(?P<char>'(?:[^'\\\n]|\\[^\n]*?)')",
}
_OPEN["typescript"] = _OPEN["javascript"]
_OPEN["c"] = rf"{_LINE}|{_BLOCK}|{_PLAIN}"
_OPENERS = {k: re.compile(v, re.M) for k, v in _OPEN.items()}
_CLOSE = {
    "line": re.compile(r"[^\n]*"),
    "dq": re.compile(r"(?:[^\"\\\n]|\\[\s\S])*"),
    "sq": re.compile(r"(?:[^'\\\n]|\\[\s\S])*"),
    "block": re.compile(r"\*/"),
    "tdq": re.compile(r"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\""),
    "tsq": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
    "tick": re.compile(r"(?:[^`\\]|\\[\s\S])*`"),
    "mdq": re.compile(r"(?:[^\"\\]|\\[\s\S])*\""),
    "msq": re.compile(r"(?:[^'\\]|\\[\s\S])*'"),
    "begin": re.compile(r"^=end[^\n]*", re.M),
}
_SEARCHED = frozenset(["block", "begin"])
_COMMENTS = frozenset(["line", "block", "nest", "begin"])
CODE = ("code", "")
#: States without a parameter in which a chunk of a language may begin.
STATES = {
    "python": ["code", "line", "dq", "sq", "tdq", "tsq"],
    "javascript": ["code", "line", "dq", "sq", "block", "tick"],
    "typescript": ["code", "line", "dq", "sq", "block", "tick"],
    "go": ["code", "line", "dq", "sq", "block", "tick"],
    "java": ["code", "line", "dq", "sq", "block", "tdq"],
    "ruby": ["code", "line", "begin", "mdq", "msq"],
    "rust": ["code", "line", "mdq"],
    "c": ["code", "line", "dq", "sq", "block"],
}
_NEST = re.compile(r"/\*|\*/")
State = tuple[str, str]


def _end(text: str, at: int, state: State) -> tuple[int, State]:
    """Where the comment or string of ``state`` ends at or behind ``at``; the state then (itself, where it does not end)."""
    kind, arg = state
    n = len(text)
    if kind == "nest":
        depth = int(arg)
        for m in _NEST.finditer(text, at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end(), CODE
        return n, ("nest", str(depth))
    if kind == "raw":
        end = text.find('"' + arg, at)
        return (end + 1 + len(arg), CODE) if end >= 0 else (n, state)
    if kind == "wait":
        end = text.find("\n", at)
        return (end + 1, ("here", arg)) if end >= 0 else (n, state)
    if kind == "here":
        m = re.compile(rf"^[ \t]*{re.escape(arg)}[ \t]*\r?$", re.M).search(text, at)
        return (m.end(), CODE) if m else (n, state)
    pattern = _CLOSE[kind]
    if kind in ("line", "dq", "sq"):
        end = pattern.match(text, at).end()
        if end >= n:
            return n, state
        return (end, CODE) if text[end] == "\n" else (end + 1, CODE)
    m = pattern.search(text, at) if kind in _SEARCHED else pattern.match(text, at)
    return (m.end(), CODE) if m else (n, state)


def _opened(m: re.Match) -> State:
    """The state behind an opening."""
    kind = m.lastgroup
    if kind == "nest":
        return kind, "1"
    if kind == "raw":
        return kind, m.group()[m.group().index("r") + 1 : -1]
    if kind == "wait":
        return kind, m.group().lstrip("<~-").strip("\"'`")
    return kind, ""


def scan(text: str, language: str, state: State = CODE, spans: list | None = None, at: int = 0) -> State:
    """The state behind ``text`` when ``state`` holds at ``at``; ``spans`` collects (begin, end, is comment)."""
    find = _OPENERS[language].search
    n = len(text)
    begin = at
    while at < n:
        if state == CODE:
            m = find(text, at)
            if not m:
                break
            begin, at = m.span()
            if m.lastgroup == "char":
                continue
            state = _opened(m)
            if at >= n:
                if spans is not None and state[0] != "wait":
                    spans.append((begin, n, state[0] in _COMMENTS))
                break
        kind = state[0]
        if kind in ("wait", "here"):
            begin = at
        at, state = _end(text, at, state)
        if spans is not None and kind != "wait":
            spans.append((begin, at, kind in _COMMENTS))
        elif spans is not None and at >= n and state[0] == "here":
            spans.append((n, n, False))  # begins with the next chunk
        begin = at
    return state


class Transition:
    """A chunk's function from the state before it to the state behind it.

    ``to`` lists states that the chunk changes in a way of its own. The others follow rules: a nested comment that the chunk
    does not leave grows by ``delta`` levels, an awaited heredoc begins if the chunk has a line end, and raw strings and
    heredocs whose ends do not occur go on.
    """

    __slots__ = ("to", "low", "delta", "line")

    def __init__(self, to: dict[State, State], low: int, delta: int, line: bool) -> None:
        self.to, self.low, self.delta, self.line = to, low, delta, line

    def __call__(self, state: State) -> State:
        found = self.to.get(state)
        if found is not None:
            return found
        if state[0] == "nest":
            return "nest", str(int(state[1]) + self.delta)
        if state[0] == "wait" and self.line:
            return "here", state[1]
        return state

    def then(self, g: Transition) -> Transition:
        """First this function, then ``g``."""
        low = min(self.low, self.delta + g.low)
        keys = set(self.to) | {k for k in g.to if k[0] in ("raw", "here", "wait")} | {("wait", k[1]) for k in g.to if k[0] == "here"} | {("nest", str(d)) for d in range(1, -low + 1)}
        return Transition({k: g(self(k)) for k in keys}, low, self.delta + g.delta, self.line or g.line)


def transition(text: str, language: str, at: int = 0) -> Transition:
    """The function of the chunk ``text[at:]``; what stands before it is only looked back at."""
    find = _OPENERS[language].search
    n = len(text)
    behind: dict[int, State] = {}

    def onward(place: int, state: State) -> State:
        """The state behind the text; readings from different places meet at the next opening, and are followed from there once."""
        path = []
        while True:
            if state != CODE:
                place, state = (n, state) if place >= n else _end(text, place, state)
                if place >= n:
                    break
                continue
            m = find(text, place)
            while m and m.lastgroup == "char":
                m = find(text, m.end())
            if not m:
                break
            if m.start() in behind:
                state = behind[m.start()]
                break
            path.append(m.start())
            place, state = m.end(), _opened(m)
        for p in path:
            behind[p] = state
        return state

    to = {(s, ""): onward(at, (s, "")) for s in STATES[language]}
    low = delta = 0
    if language == "rust":
        for m in _NEST.finditer(text, at):
            delta += 1 if m.group() == "/*" else -1
            if delta < low:
                low = delta
                to["nest", str(-low)] = onward(m.end(), CODE)
        longest = max((len(x) for x in re.compile(r"\"(\#*)").findall(text, at)), default=-1)
        for h in range(longest + 1):
            to["raw", "#" * h] = onward(at, ("raw", "#" * h))
    line = text.find("\n", at)
    if language == "ruby":
        for kind, begin in (("here", at), ("wait", line + 1 if line >= 0 else n)):
            for m in re.compile(r"^[ \t]*(\w+)[ \t]*\r?$", re.M).finditer(text, begin):
                if (kind, m.group(1)) not in to:
                    to[kind, m.group(1)] = onward(m.end(), CODE)
    return Transition(to, low, delta, line >= 0)


def prefix_states(functions: list[Transition]) -> list[State]:
    """First state of every chunk, by a parallel prefix over the chunks' functions in log2(n) rounds."""
    running, step = list(functions), 1
    while step < len(running):
        running = [running[i - step].then(running[i]) if i >= step else running[i] for i in range(len(running))]
        step *= 2
    return [CODE] + [f(CODE) for f in running[:-1]]


_CUT = re.compile(r"(?<![\\\r])\n|(?<=[^\\]\r)\n|(?<=\w) (?=\w)")


def cut(text: str, size: int) -> list[str]:
    """Pieces of about ``size`` characters, cut at line ends or between words, where no mark of the languages can stand."""
    pieces, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m or m.end() >= len(text):
            break
        pieces.append(text[at : m.end()])
        at = m.end()
    return [*pieces, text[at:]]


_MARK = re.compile(r"(?m)^[ \t]*(?:/\*+!?|\*+/|\*+(?!/)|//+[/!]?|#+!?|--|=begin|=end)[ \t]?")
_TAIL = re.compile(r"\*+/\s*$")
_JOIN = re.compile(r"\s*(?:\+|\\|\.|<<)?\s*\\?\s*")
_ESCAPES = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|\r?\n|([\s\S]))")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "0": "", "b": "", "f": "", "v": ""}


def unescape(text: str) -> str:
    """Escapes of a string literal replaced by what they stand for."""

    def one(m) -> str:
        code = m.group(1) or m.group(2) or m.group(3) or m.group(4)
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 else " "
        c = m.group(5)
        return "" if c is None else _SIMPLE.get(c, c)

    out = _ESCAPES.sub(one, text)
    if any("\ud800" <= c <= "\udfff" for c in out):
        out = out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return out


def _quotes_off(text: str) -> str:
    m = re.match(r"(?:b?r#*\"|\"\"\"|'''|[\"'`])", text)
    return text[m.end() : len(text) - (m.end() - (m.group().index("r") + 1) if "r" in m.group() else m.end())] if m and len(text) >= 2 * len(m.group()) else text.strip("\"'`")


#: A span as it travels: its text, whether it is a comment, and the code before it (None where that is too long to join over).
Span = tuple[str, bool, str | None]
_FAR = 400


def spans_of(text: str, spans: list[tuple[int, int, bool]], at: int = 0) -> tuple[list[Span], str | None]:
    """Spans with their texts and the code before each, and the code behind the last."""
    out = []
    for b, e, comment in spans:
        out.append((text[b:e], comment, text[at:b] if b - at < _FAR else None))
        at = e
    return out, text[at:] if len(text) - at < _FAR else None


def joined_chunks(chunks: list[tuple[list[Span], str | None, bool]]) -> list[Span]:
    """The spans of a file from those of its chunks; a chunk says whether its first span goes on from the one before."""
    out: list[Span] = []
    tail: str | None = ""
    for spans, rest, goes_on in chunks:
        for i, (text, comment, gap) in enumerate(spans):
            if not i:
                if goes_on and out:
                    out[-1] = (out[-1][0] + text, comment, out[-1][2])
                    continue
                gap = None if gap is None or tail is None or len(gap) + len(tail) >= _FAR else tail + gap
            out.append((text, comment, gap))
        tail = rest if spans else None if rest is None or tail is None or len(rest) + len(tail) >= _FAR else tail + rest
    return out


def passages(spans: list[Span]) -> list[str]:
    """Texts of comments and strings, neighbouring ones joined, marks and escapes removed."""
    out: list[str] = []
    held: list[str] = []
    kind = False
    for raw, comment, gap in spans:
        if held:
            near = comment == kind and gap is not None and ((not gap.strip() and gap.count("\n") <= 1) if comment else _JOIN.fullmatch(gap) is not None)
            if not near:
                out.append(("\n" if kind else "").join(held))
                held = []
        kind = comment
        if comment:
            held.append(_TAIL.sub("", _MARK.sub("", raw)))
        else:
            inner = _quotes_off(raw)
            held.append(unescape(inner) if "\\" in inner else inner)
    if held:
        out.append(("\n" if kind else "").join(held))
    return out


_STOP = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])|\n\s*\n|\n(?=\s*(?:[-*+>|@:#]|\d+\.|```|~~~|\\))")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HAN = re.compile(r"[㐀-鿿]")
_NOISY = re.compile(r"[`/{<_@=$\\(]|----")
_NOISE = re.compile(r"-{4,}[^-\n]{1,80}-{4,}|`[^`\n]*`|https?://\S+|\{[^{}\n]*\}|<[^<>\n]{1,80}>|[\w.-]*[/_@=$\\][\w./_@=$\\:-]*|\w+\(\w*\)")


def sentences(text: str) -> list[str]:
    """Sentences of enough words to be judged, short neighbours together; names, paths and addresses are no words."""
    out = []
    if len(text) < FEWEST_HAN:
        return out
    short, short_words, short_han = [], 0, 0
    for s in _STOP.split(text):
        if not s:
            continue
        han = 0 if s.isascii() else len(_HAN.findall(s))
        if han and 2 * han >= len(s.split()):
            if han >= FEWEST_HAN:
                out.append(s.lower())
            else:
                short_han += han
                short.append(s.lower())
        else:
            if _NOISY.search(s):
                s = _NOISE.sub(" ", s)
            words = _LETTERS.findall(s)
            if 2 * sum(len(w) > 2 for w in words) < max(1, len(words)):
                continue  # numbers in letters, initials, marks
            if len(words) >= FEWEST_WORDS:
                out.append(" ".join(words).lower())
            else:
                short_words += len(words)
                short.append(" ".join(words).lower())
        if short and (short_words >= FEWEST_WORDS or short_han >= FEWEST_HAN):
            out.append(" ".join(short))
            short, short_words, short_han = [], 0, 0
    return out


class Model:
    """Weights of the language classifier."""

    def __init__(self, weights) -> None:
        self.weights = weights

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and probability of each sentence."""
        import numpy as np

        from tesserine.llm.hashed import ngrams, scores

        if self.weights is None or not texts:
            return [("", 0.0)] * len(texts)
        out = []
        for at in range(0, len(texts), 4096):
            part = [t.encode("utf-8", "replace") for t in texts[at : at + 4096]]
            z = scores(self.weights, *ngrams(part, _ORDERS, _BITS))
            z[:, LANGUAGES.index("en")] += np.log(ENGLISH)
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            out += [(LANGUAGES[b], float(q)) for b, q in zip(best.tolist(), p.max(1).tolist())]
        return out


_FOLD = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}


def plain_letters(text: str) -> str:
    """The text as a writer without the language's special letters would put it."""
    import unicodedata

    text = "".join(_FOLD.get(c, c) for c in text).replace("ł", "l")
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _part(text: str) -> str:
    """A few words out of a sentence, from a place that its hash names; nothing, where it is hardly longer."""
    import zlib

    words = text.split() if len(text.split()) > 1 else list(text)
    least = FEWEST_WORDS if len(text.split()) > 1 else FEWEST_HAN
    if len(words) < least + 2:
        return ""
    h = zlib.crc32(text.encode("utf-8", "replace"))
    at, n = h % (len(words) - least), least + (h >> 16) % 3
    return (" " if least == FEWEST_WORDS else "").join(words[at : at + n])


def train(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the classifier to about ``sample`` pages per labelled language, twice, leaving out what the first fit rejects."""
    import numpy as np

    from tesserine.llm.hashed import ngrams, scores, train_logistic

    label = F.lower(F.trim("lang"))
    pages = documents.select("doc_id", label.alias("lang"), "text").where(label.isin(LANGUAGES) & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in pages.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(None)
    share = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(min(1.0, sample / n)))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    rows = pages.where(place < share[F.col("lang")]).limit(3 * sample * len(LANGUAGES)).collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id))
    texts, labels = [], []
    for r in rows:
        for s in dict.fromkeys(sentences(r.text)):
            texts.append(s)
            labels.append(LANGUAGES.index(r.lang))
    if not texts:
        return Model(None)
    import zlib

    per: dict[int, int] = {}
    kept = []
    for i in sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].encode("utf-8", "replace")), i)):
        per[labels[i]] = per.get(labels[i], 0) + 1
        if per[labels[i]] <= SENTENCES:
            kept.append(i)
    texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
    # Comments are shorter than sentences of pages, so each sentence also gives a part of the fewest words that count.
    parts = [_part(t) for t in texts]
    texts, labels = texts + [p for p in parts if p], labels + [g for g, p in zip(labels, parts) if p]
    plain = [plain_letters(t) for t in texts]
    everything = [t.encode() for t in texts + plain]
    y = np.array(labels + labels)
    w = train_logistic(everything, y, len(LANGUAGES), _ORDERS, _BITS, epochs=2)
    good = scores(w, *ngrams(everything, _ORDERS, _BITS)).argmax(1) == y
    half = len(texts)
    good = good[:half] & good[half:]
    chosen = [i for i in range(half) if good[i]]
    w = train_logistic([everything[i] for i in chosen] + [everything[i + half] for i in chosen], np.array([labels[i] for i in chosen] * 2), len(LANGUAGES), _ORDERS, _BITS, epochs=4)
    return Model(w)


def _labelled(texts: list[list[str]], model: Model) -> list[dict[str, int]]:
    """Characters per language of each list of sentences; equal sentences are judged once."""
    order = list(dict.fromkeys(s for t in texts for s in t))
    known = dict(zip(order, model.label(order)))
    out = []
    for t in texts:
        sums: dict[str, int] = {}
        for s in t:
            g, p = known[s]
            if g and p >= SURE:
                sums[g] = sums.get(g, 0) + len(s)
        out.append(sums)
    return out


def _lexed(language: str, text: str, state: State = CODE, at: int = 0) -> tuple[list[Span], str | None]:
    spans: list = []
    scan(text, language, state, spans, at)
    return spans_of(text, spans, at)


def _pieces(rows):
    for r in rows:
        language = language_of(r["path"], r["language"]) or "c"
        text, before = r["content"], ""
        for k, piece in enumerate(cut(text, r["size"])):
            yield r["file_id"], language, len(text), k, before, piece
            before = piece[-1]


def _functions(rows):
    import pickle

    for r in rows:
        f = transition(r["before"] + r["piece"], r["lexer"], len(r["before"]))
        yield r["file_id"], r["k"], pickle.dumps((f.to, f.low, f.delta, f.line))


def _first_states(key, batch):
    import pickle

    import pandas as pd

    batch = batch.sort_values("k")
    states = prefix_states([Transition(*pickle.loads(f)) for f in batch["f"]])
    return pd.DataFrame({"file_id": batch["file_id"].to_numpy(), "k": batch["k"].to_numpy(), "kind": [s[0] for s in states], "arg": [s[1] for s in states]})


def _chunk_spans(rows):
    for r in rows:
        at, state = len(r["before"]), (r["kind"], r["arg"])
        spans, rest = _lexed(r["lexer"], r["before"] + r["piece"], state, at)
        yield r["file_id"], r["n_chars"], r["k"], [{"text": t, "comment": c, "gap": g} for t, c, g in spans], rest, state != CODE and state[0] != "wait"


def long_passages(source_files: DataFrame, chunk: int) -> DataFrame:
    """Passages of the files over ``chunk`` characters in parts of about that size: file_id, n_chars, passages."""
    columns = ["file_id", "path", "language", "content", "size"]
    long = source_files.where(F.length("content") > chunk).dropDuplicates(["file_id"]).withColumn("size", F.lit(chunk))
    pieces = stored(map_rows(long, _pieces, "file_id bigint, lexer string, n_chars bigint, k int, before string, piece string", columns), "p2-pieces")
    spread = pieces.repartition("file_id", "k")
    functions = map_rows(spread, _functions, "file_id bigint, k int, f binary", ["file_id", "lexer", "k", "before", "piece"])
    # A chunk's function is a few dozen states, so those of one file are a small part of it.
    states = functions.groupBy("file_id").applyInPandas(_first_states, "file_id bigint, k int, kind string, arg string")
    schema = "file_id bigint, n_chars bigint, k int, spans array<struct<text:string,comment:boolean,gap:string>>, rest string, goes_on boolean"
    spans = map_rows(pieces.join(states, ["file_id", "k"]), _chunk_spans, schema)
    # The spans of a file are less than its content, which came as one row.
    whole = spans.groupBy("file_id").agg(F.max("n_chars").alias("n_chars"), F.sort_array(F.collect_list(F.struct("k", "spans", "rest", "goes_on"))).alias("chunks"))

    def parts(rows):
        for r in rows:
            chunks = [([(s["text"], s["comment"], s["gap"]) for s in c["spans"]], c["rest"], c["goes_on"]) for c in r["chunks"]]
            part, size, k = [], 0, 0
            for p in passages(joined_chunks(chunks)):
                part.append(p)
                size += len(p)
                if size >= chunk:
                    yield r["file_id"], r["n_chars"], k, part
                    part, size, k = [], 0, k + 1
            if part:
                yield r["file_id"], r["n_chars"], k, part

    return map_rows(whole, parts, "file_id bigint, n_chars bigint, k int, passages array<string>").repartition("file_id", "k")


def language_shares(source_files: DataFrame, documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (file_id, lang, chars, share): labelled characters of each language and their share of the file's content."""
    spark = source_files.sparkSession
    shared = spark.sparkContext.broadcast(train(documents))
    schema = "file_id bigint, n_chars bigint, lang string, chars bigint"

    def flush(held):
        for (file, n), sums in zip([h[:2] for h in held], _labelled([h[2] for h in held], shared.value)):
            for g, chars in sums.items():
                yield file, n, g, chars

    def short(rows):
        held = []
        for r in rows:
            text = r["content"]
            if not text or len(text) > chunk:
                continue
            spans, _ = _lexed(language_of(r["path"], r["language"]) or "c", text)
            held.append((r["file_id"], len(text), [s for p in passages(spans) for s in sentences(p)]))
            if len(held) >= BATCH:
                yield from flush(held)
                held = []
        yield from flush(held)

    def parts(rows):
        held = []
        for r in rows:
            held.append((r["file_id"], r["n_chars"], [s for p in r["passages"] for s in sentences(p)]))
            if len(held) >= 8:
                yield from flush(held)
                held = []
        yield from flush(held)

    direct = map_rows(source_files.where(F.length("content") <= chunk), short, schema, ["file_id", "path", "language", "content"])
    total = direct.dropDuplicates(["file_id", "lang"]).unionByName(map_rows(long_passages(source_files, chunk), parts, schema))
    return total.groupBy("file_id", "lang").agg(F.max("n_chars").alias("n_chars"), F.sum("chars").alias("chars")).select("file_id", "lang", "chars", (F.col("chars") / F.col("n_chars")).alias("share"))


def foreign_languages(source_files: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (file_id, lang) for the languages other than English."""
    return language_shares(source_files, documents).where("lang <> 'en'").select("file_id", "lang")
