"""Problem 7: credentials embedded in source code, by a corpus-wide index of literals and a second scan with an automaton.

1. Every literal of every file, every constant of the parsed modules and every value of a known secret structure (private
   keys, signed tokens, issuer tokens, logins in addresses, encoded logins, settings strings, values named in comments) is
   indexed by its hash and repository. Those that stand where a secret stands (by structure, name or comment) are candidates.
2. Over the whole index, values that more than ``OWNERS`` repositories use are placeholders and drop out.
3. What is rare is confirmed by its structure: placeholders, templates, names and words that nobody else uses fall here.
4. Every file is scanned again for the confirmed texts, so that a secret is also found where nothing around it gives it away.
   Whole runs of letters and digits of a secret are its anchor. A bitmap of all anchors, ``BITS`` large whatever the corpus
   holds, is broadcast; one pass over the files sends on those that hold an anchor, they meet their secrets in a join on
   anchors, and an automaton of those secrets reads them.

The redacted content replaces the secret parts only, keeping quotes, length and line breaks, so that code still parses;
secrets that overlap are masked as one.

Cases: null content or constants give nothing; a null repository counts as one owner; repeated versions give one row; a
secret that spans lines counts on its first; several secrets on a line count once; empty tables give empty results. Values
of any length and lines of any length are read whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.session import map_rows, stored

OWNERS = 3
#: Size of the bitmap of anchors, in bits: 8 MB. More secrets fill it further and send on more files, and lose none.
BITS = 1 << 26
BATCH = 256

_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\\n|\\r|[\s\"'+*#/,]|Proc-Type[^\n]*|DEK-Info[^\n]*|Version[^\n]*)*([A-Za-z0-9+/=]{24,})")
_PEM_BODY = re.compile(r"(?:\\[nrt]|[A-Za-z0-9+/=]|[\s\"'`\\*#,.]+(?=[A-Za-z0-9+/=]{24}))*+")
_PEM_LAYOUT = re.compile(r"[\"'`]\s*(?:\+|\.|<<|,)?\s*\\?\s*[\"'`]|\\[nrt]|\n[ \t]*(?://+[ \t]|[#*]+)?")
_JWT = re.compile(r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{10,}")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]*://([^\s:/@\"'`<>]*):([^\s@/\"'`]{3,})@[\w.\[-]")
_BASIC = re.compile(r"\bBasic ([A-Za-z0-9+/]{8,}={0,2})")
_SETTING = re.compile(r"(?i)\b((?:[a-z0-9_]*_)?(?:password|passwd|passphrase|pwd|secret|token|api_?key|access_?key))\s*=\s*([^\s;&,\"'`]{5,})")
_LONG = re.compile(r"(?<=[-_:.])[A-Za-z0-9]{16,}(?![\w/+=-])(?!\.\w)")
_ISSUER = re.compile(r"(?:^|[^\w/+.-])([A-Za-z]{2,6}\d{0,2}(?:[-_](?:live|test|prod|pat|key))?[-_:.])$")
_PIECES = re.compile(r"(?<![\w/+.-])([A-Za-z]{2,6}\d{0,2}(?:[-_](?:live|test|prod|pat|key))?[-_:.][A-Za-z0-9]{4,})([\"'`])\s*(?:\+|\.|<<|\\\r?\n)?\s*\2([A-Za-z0-9]{6,})\2")
_LITERAL = re.compile(r"\"((?:[^\"\\\n]++|\\.)*+)\"|'((?:[^'\\\n]++|\\.)*+)'|`((?:[^`\\\n]++|\\.)*+)`")
_ESCAPED = re.compile(r"\\([\"'`\\/$])")
_MENTION = re.compile(r"\b(?:p(?:w|ass(?:wd|word|phrase)?)|logins?|secret|token|(?:api[ _-]?)?key|credentials?)\b([^\n]*)")
#: Marks of footnotes and references in comments.
_NOTE = re.compile(r"\[\^?[\w-]*\]")
_IN_COMMENT = re.compile(r"(?:^|\s)(?:#|//|--|\*|/\*)")
_LEADS = re.compile(r"[:=/]|\b(?:is|was|are)\b")
#: Words of a name that make its value a secret, and words that make it none. Fixed values.
_SECRET_WORDS = frozenset("password passwd pwd pw pass passphrase phrase secret token auth login cred creds credential credentials apikey key passcode pin signing access".split())
_HARMLESS_WORDS = frozenset("pattern regex field fields kind type name names length min max id ids uid uuid icon image checksum sha md5 hash etag commit revision integrity fingerprint verifier public pub endpoint".split())
_DIGEST_PREFIX = frozenset(["sha", "sha1", "sha256", "sha384", "sha512", "md5", "crc32", "rev", "urn"])
_FIRST = re.compile(r"\s*(?:(?:export|pub(?:lic)?|private|protected|static|final|const|let|var|mut|String|val)\s+|self\.|this\.|@)*([A-Za-z_]\w*)\s*(?::|=|\()")
_BEFORE = re.compile(r"(?:[=:(,]|\?\?|\|\||=>|\bor)\s*$")
_NAME = re.compile(r"[A-Za-z_]\w*")
_COMMENT_START = re.compile(r"\s*(?:#|//|\*|/\*|--)")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_MARKED = re.compile(r"[A-Za-z0-9][!%$#&*?+^~@][A-Za-z0-9]")
_SYNTAX = re.compile(r"[()\[\]{}<>\\|\s]|://|^[./^]")
_HEX = re.compile(r"(?:[0-9a-f]{16,}|[0-9A-F]{16,})")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Templates as a whole: in brackets, a variable of one case, a format, a variable between percent signs.
_TEMPLATE = re.compile(r"<.*>|\{.*\}|\[.*\]|\$\(.*\)|\$[A-Z_][A-Z0-9_]*|\$[a-z_]+|%[-+ #0]*\d*(?:\.\d+)?[a-z]|%\w+%", re.S)
_PLACEHOLDER = re.compile(r"(?i)\$\{|\{\{|%\(|\{\w*\}|^(.)\1{3,}$|\*{3,}|x{6,}|\.{3}|change_?me|replace_?me|your[_-]|[_-]here$|example|placeholder|dummy|redacted|todo|fixme|^none$|^null$|vault[:.]|^env[:.]|secretsmanager")


def name_words(name: str) -> list[str]:
    """Lower-case words of an identifier."""
    return [w.lower() for w in _SPLIT.findall(name) if not w.isdigit()]


def looks_random(value: str, least: int = 6) -> bool:
    """Whether a value without white space is no word, name, path or version."""
    if len(value) < least:
        return False
    if value[0] in "./\\^" or "://" in value or value.startswith("data:") or re.search(r"\[[^\]]*\][+*?]|\\[dw]", value):
        return False
    letters = [c for c in value if c.isalpha()]
    digits = sum(c.isdigit() for c in value)
    if not letters:
        return False
    if re.fullmatch(r"[\w-]+\.[a-z]{2,5}", value) and not digits or re.fullmatch(r"v?\d+(?:\.\d+)+\S*", value):
        return False
    odd = False
    for w in re.split(r"[^A-Za-z]+", value):
        if w and not (w.islower() or w.isupper() or w.istitle()) and not re.fullmatch(r"(?:[a-z]{3,}|[A-Z][a-z]{2,})(?:[A-Z][a-z]{2,}|[A-Z]{2,3})+", w):
            odd = True
    symbols = sum(not c.isalnum() and c not in "-_./: " for c in value)
    if digits and len(value) >= 8 and (odd or symbols or re.search(r"[A-Za-z]\d{3,}$", value) or len(set(value)) >= 8 and digits >= 2):
        return True
    if digits and len(value) >= 10 and len(set(value)) >= 9 and not value[-1].isdigit() and not value.islower() and not value.isupper() and value.isalnum():
        return True
    return odd and len(value) >= 8 or bool(symbols) and (odd or digits) and len(value) >= 6


def _issued(prefix: str, rest: str) -> bool:
    if prefix.rstrip("-_:.").lower() in _DIGEST_PREFIX:
        return False
    mixed = any(c.islower() for c in rest) and any(c.isupper() for c in rest)
    return mixed and (any(c.isdigit() for c in rest) and len(set(rest)) >= 9 or len(rest) >= 20 and len(set(rest)) >= 12)


def structured(kind: str, value: str) -> bool:
    """Whether a rare candidate has the structure of a secret and is no placeholder, template or name."""
    if kind == "private key":
        return True
    if kind == "encoded login":
        value = _login(value) or ""
    if _PLACEHOLDER.search(value) or _TEMPLATE.fullmatch(value):
        return False
    if kind in ("address", "setting", "encoded login"):
        return len(value) >= 4 and not re.fullmatch(r"(?i)(?:password|passwd|pass|pwd|secret|token|\w*_password|\w*_token)", value)
    return not _UUID.fullmatch(value)


def _login(encoded: str) -> str | None:
    """The password in an encoded login."""
    try:
        inner = base64.b64decode(encoded, validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError):
        return None
    user, colon, word = inner.partition(":")
    return word if colon and user and word and inner.isprintable() else None


def _named(words: list[str], value: str) -> bool:
    """Whether a value under a name of these words is a secret."""
    if not any(w in _SECRET_WORDS for w in words) or any(w in _HARMLESS_WORDS for w in words):
        return False
    if " " in value:
        parts = value.split(" ")
        return any(w in ("passphrase", "phrase") for w in words) and 3 <= len(parts) <= 12 and all(p.isalpha() and p.islower() for p in parts)
    if _HEX.fullmatch(value):
        return any(w in ("secret", "key", "token", "password", "hmac", "signing", "auth") for w in words) and len(set(value)) >= 6
    # Words joined by a mark that names and paths do not have are a password too.
    return looks_random(value) or len(value) >= 8 and _MARKED.search(value) is not None and not _SYNTAX.search(value)


def key_value(text: str, begin: int) -> str:
    """What a private key counts as: the hash of its body from ``begin`` up to the END line, without layout.

    The first characters alone do not tell keys apart; some formats begin with the same header.
    """
    end = text.find("-----", begin)
    if end < 0:  # no END line: as far as the letters of a body go
        end = _PEM_BODY.match(text, begin).end()
    body = "".join(c for c in _PEM_LAYOUT.sub("", text[begin:end]) if c.isalnum() or c in "+/=")
    return hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()


def candidates(text: str, literals: set[str] | None = None) -> list[tuple[int, str, str, str]]:
    """(offset, needle, value, kind) of all candidates in a text; the needle is the text as it stands there. ``literals`` collects all literals."""
    out = []
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            out.append((m.start(), m.group(1)[:64], key_value(text, m.start(1)), "private key"))
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            out.append((m.start(), m.group(), m.group(), "signed token"))
    if "://" in text:
        for m in _URL.finditer(text):
            if not _PLACEHOLDER.search(m.group(1)) and not _TEMPLATE.fullmatch(m.group(1)):
                out.append((m.start(), m.group()[:-2], m.group(2), "address"))
    if "Basic " in text:
        for m in _BASIC.finditer(text):
            if _login(m.group(1)) is not None:
                out.append((m.start(), m.group(1), m.group(1), "encoded login"))
    for m in _LONG.finditer(text):
        p = _ISSUER.search(text, max(0, m.start() - 14), m.start())
        if p and _issued(p.group(1), m.group()):
            out.append((p.start(1), p.group(1) + m.group(), p.group(1) + m.group(), "issued token"))
    lower = text.lower()
    if len(lower) != len(text):  # some letters grow; places must stay
        lower = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    for m in _PIECES.finditer(text):
        head = m.group(1)
        cut = max(head.rfind(c) for c in "-_:.") + 1
        if _issued(head[:cut], head[cut:] + m.group(3)):
            out.append((m.start(), m.group(), head + m.group(3), "issued token"))
    if "=" in text and any(k in lower for k in ("password", "passwd", "pwd", "secret", "token", "key", "passphrase")):
        line, done, odd = -1, 0, {}
        for m in _SETTING.finditer(text):
            value = m.group(2)
            if value[-1] in "()" or value.isalpha() and (value.islower() or value.istitle()) or re.search(r"[()\[\]]|\w\.\w+\(", value):
                continue
            at = text.rfind("\n", done, m.start()) + 1 or (line if line >= 0 else 0)
            if at != line:  # quotes are counted once along a line
                line, done, odd = at, at, dict.fromkeys("\"'`", 0)
            for q in odd:
                odd[q] += text.count(q, done, m.start())
            done = m.start()
            if any(n % 2 for n in odd.values()) or _COMMENT_START.match(text, at, m.start()):
                out.append((m.start(), m.group(), value, "setting"))
    line, end, names, first = -1, 0, [], None
    for m in _LITERAL.finditer(text):
        needle = m.group(m.lastindex)
        at = text.rfind("\n", end if line >= 0 else 0, m.start()) + 1 or max(line, 0)
        if at != line:
            line, end, names = at, at, []
            first = _FIRST.match(text, at)
        gap = text[end : m.start()]
        # The last two names before the literal on its line, read along the line once.
        names = (names + _NAME.findall(gap))[-2:]
        begin, end = m.start(), m.end()
        before = gap.rstrip()
        called = before.endswith("(")
        if len(needle) >= 5:
            value = _ESCAPED.sub(r"\1", needle) if "\\" in needle else needle
            if literals is not None:
                literals.add(value)
            if _worth(value) and (_BEFORE.search(gap) if before else False):
                own = name_words(first.group(1)) if first and first.end() <= begin else name_words(names[-1]) if names else []
                if not any(w in _HARMLESS_WORDS for w in own):
                    words = own if any(w in _SECRET_WORDS for w in own) else [w for n in names for w in name_words(n)]
                    if _named([w for w in words if w not in _HARMLESS_WORDS], value):
                        out.append((begin + 1, needle, value, "named value"))
        if called and m.group()[0] != "`":
            names = (names + _NAME.findall(needle))[-2:]
    for m in _MENTION.finditer(lower):
        begin, end = m.span(1)
        c = _LEADS.search(lower, begin, end)
        if not c or not _IN_COMMENT.search(text, max(0, text.rfind("\n", 0, begin)), begin):
            continue
        for w in re.finditer(r"[^\s\"'`,;()<>]{6,}", text[c.start() : end]):
            value = _NOTE.sub("", w.group()).strip(".:=/")
            if value in w.group() and looks_random(value, 8) and not _HEX.fullmatch(value) and not re.match(r"^[\w.-]+/[\w./-]+$", value) and "&" not in value[:1]:
                out.append((c.start() + w.start() + w.group().find(value), value, value, "comment"))
    return out


def _worth(value: str) -> bool:
    """Whether a literal can be a secret under a secret's name: a passphrase, or no plain word or path."""
    if " " in value:
        return value.islower() and 3 <= value.count(" ") + 1 <= 12 and value.replace(" ", "").isalpha()
    return not (value.islower() and (value.isalpha() or value.replace("-", "").replace("_", "").replace("/", "").replace(".", "").isalpha()))


def _hash(value: str) -> int:
    import xxhash

    n = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


_RUN = re.compile(r"[^\W_]+")


def anchor_of(needle: str, kind: str, value: str) -> tuple[str, str]:
    """(anchor, main run): whole runs of letters and digits that stand wherever the secret stands.

    A secret of one run has that run; of several, the longest and the longer of its neighbours. A secret is only found where
    no letter or digit adjoins it, so its runs are whole runs of the text. Keys are told by their body.
    """
    if kind == "private key":
        return "k:" + value, ""
    runs = _RUN.findall(needle)
    if not runs:
        return "", ""
    i = max(range(len(runs)), key=lambda k: len(runs[k]))
    if len(runs) == 1:
        return "s:" + runs[0], ""
    j = i - 1 if i + 1 == len(runs) or i and len(runs[i - 1]) >= len(runs[i + 1]) else i + 1
    return f"p:{runs[min(i, j)]} {runs[max(i, j)]}", runs[i]


def _indexed(text: str, repo: str):
    """Rows of the index for a text: hash and repository of every literal, and the candidates."""
    literals: set[str] = set()
    found = {(n, v, k) for _, n, v, k in candidates(text, literals)}
    for value in literals.union(v for _, v, _ in found):
        yield _hash(value), repo, None, None, None
    for needle, value, kind in found:
        yield _hash(value), repo, needle, value, kind


def _file_rows(rows):
    for r in rows:
        if r["content"] and r["file_id"] is not None:
            yield from _indexed(r["content"], r["repo"] or "")


def _constant_rows(rows):
    for r in rows:
        constants = list(r["constants"] or [])
        for c in r["classes"] or []:
            constants += (c or {}).get("class_vars") or []
        for c in constants:
            if c and c["value"]:
                yield from _indexed(f"{c['name'] or '_'} = {c['value']}", r["repo"] or "")


def index_literals(source_files: DataFrame, modules: DataFrame) -> DataFrame:
    """The index: h (hash of the value), repo, and needle, value, kind for candidates; one row per literal and file."""
    schema = "h bigint, repo string, needle string, value string, kind string"
    found = map_rows(source_files, _file_rows, schema, ["file_id", "repo", "content"])
    constants = modules.select("repo", "constants", F.transform("classes", lambda c: F.struct(c.class_vars.alias("class_vars"))).alias("classes"))
    return stored(found.unionByName(map_rows(constants, _constant_rows, schema)), "p7-index")


def confirmed(source_files: DataFrame, modules: DataFrame) -> DataFrame:
    """Confirmed secrets: needle, kind, value, owners, anchor, main."""
    index = index_literals(source_files, modules)
    named = index.where("needle is not null").select("h", "needle", "value", "kind").distinct()
    uses = index.select("h", "repo").join(named.select("h").distinct(), "h", "left_semi").distinct()
    rare = named.join(uses.groupBy("h").agg(F.count("*").alias("owners")).where(F.col("owners") <= OWNERS), "h")

    def run(rows):
        for r in rows:
            if structured(r["kind"], r["value"]):
                anchor, main = anchor_of(r["needle"], r["kind"], r["value"])
                yield r["needle"], r["kind"], r["value"], r["owners"], anchor, main

    kept = map_rows(rare, run, "needle string, kind string, value string, owners bigint, anchor string, main string")
    # Keys of one format may share a needle, other secrets do not.
    key = F.when(F.col("kind") == "private key", F.col("value"))
    first = F.min(F.struct("kind", "value", "anchor", "main")).alias("v")
    merged = kept.groupBy("needle", key.alias("key")).agg(first, F.max("owners").alias("owners"))
    return merged.select("needle", "v.kind", "v.value", "owners", "v.anchor", "v.main")


def _place(x: str) -> int:
    return _hash(x) & (BITS - 1)


def anchor_bitmap(secrets: DataFrame) -> bytes:
    """A bit for each anchor and main run. It is put together as words of 64 bits in Spark; at most BITS / 64 of them exist."""
    import numpy as np

    def run(rows):
        for r in rows:
            for x in (r["anchor"], "m:" + r["main"] if r["main"] else ""):
                if x:
                    p = _place(x)
                    yield p >> 6, p & 63

    bits = map_rows(secrets.select("anchor", "main"), run, "word int, bit int")
    words = bits.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()
    full = np.zeros(BITS >> 6, dtype=np.int64)
    full[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return full.view(np.uint64).astype("<u8").tobytes()


def files_near(source_files: DataFrame, secrets: DataFrame) -> DataFrame:
    """Files that hold an anchor of some secret (or share its bit): file_id, content, anchors. One pass over all files."""
    shared = source_files.sparkSession.sparkContext.broadcast(anchor_bitmap(secrets))

    def run(rows):
        bitmap = shared.value

        def marked(x: str) -> bool:
            p = _place(x)
            return bitmap[p >> 3] >> (p & 7) & 1 == 1

        known: dict[str, int] = {}
        for r in rows:
            text = r["content"]
            if not text:
                continue
            runs = _RUN.findall(text)
            found = set()
            hit = False
            for x in set(runs):
                k = known.get(x)
                if k is None:
                    if len(known) > 200_000:
                        known.clear()
                    k = known[x] = (1 if marked("s:" + x) else 0) | (2 if marked("m:" + x) else 0)
                if k & 1:
                    found.add("s:" + x)
                hit |= k > 1
            if hit:
                for a, b in set(zip(runs, runs[1:])):
                    if known.get(a, 0) > 1 or known.get(b, 0) > 1:
                        x = f"p:{a} {b}"
                        if marked(x):
                            found.add(x)
            if "PRIVATE KEY" in text:
                for m in _PEM.finditer(text):
                    x = "k:" + key_value(text, m.start(1))
                    if marked(x):
                        found.add(x)
            if found:
                yield r["file_id"], text, sorted(found)

    return map_rows(source_files, run, "file_id bigint, content string, anchors array<string>", ["file_id", "content"])


def automaton(secrets: list[dict]):
    """An automaton over the texts of secrets: needle -> (length, other secrets, keys)."""
    import ahocorasick

    made = ahocorasick.Automaton()
    at: dict[str, tuple[list, set]] = {}
    for x in secrets:
        other, keys = at.setdefault(x["needle"], ([], set()))
        keys.add(x["value"]) if x["kind"] == "private key" else other.append((x["kind"], x["value"]))
    for needle, (other, keys) in at.items():
        made.add_word(needle, (len(needle), other, keys))
    made.make_automaton()
    return made


def spans_in(text: str, made) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, value) of the secrets of an automaton in a text, whole words only."""
    out = []
    for last, (n, other, keys) in made.iter(text):
        begin, end = last - n + 1, last + 1
        if other and not ((text[begin].isalnum() and begin and (text[begin - 1].isalnum())) or (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())):
            out += [(begin, end, kind, value) for kind, value in other]
        if keys:
            head = text.rfind("-----BEGIN", 0, begin)
            if head < 0 or "PRIVATE KEY" not in text[head:begin] or "-----END" in text[head:begin]:
                continue
            value = key_value(text, begin)
            if value in keys:
                tail = text.find("-----END", end)
                out.append((head, tail if tail > 0 else end, "private key", value))
    return out


def _rescanned(source_files: DataFrame, modules: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(file_id, text, spans)`` for every file that holds confirmed secrets."""
    secrets = stored(confirmed(source_files, modules), "p7-secrets")
    near = stored(files_near(source_files, secrets), "p7-near").dropDuplicates(["file_id"])
    pairs = near.select("file_id", F.explode("anchors").alias("anchor")).join(secrets.select("anchor", "needle", "kind", "value"), "anchor")
    # As many as the file itself holds.
    wanted = pairs.groupBy("file_id").agg(F.collect_list(F.struct("needle", "kind", "value")).alias("secrets"))
    joined = near.select("file_id", "content").join(wanted, "file_id")

    def run(rows):
        held = []

        def flush():
            if held:
                made = automaton([x for r in held for x in r["secrets"]])
                for r in held:
                    spans = spans_in(r["content"], made)
                    if spans:
                        yield from emit(r["file_id"], r["content"], spans)

        for r in rows:
            held.append(r)
            if len(held) >= BATCH:
                yield from flush()
                held.clear()
        yield from flush()

    return map_rows(joined, run, schema)


def _lines(file: int, text: str, spans):
    for line in {text.count("\n", 0, begin) + 1 for begin, _, _, _ in spans}:
        yield file, line


def find_secrets(source_files: DataFrame, modules: DataFrame) -> DataFrame:
    """Rows (file_id, line) on which a secret begins."""
    return _rescanned(source_files, modules, _lines, "file_id bigint, line int").distinct()


def mask(secret: str) -> str:
    """A replacement of the same length that keeps line breaks, escapes, quotes and separators."""
    out = []
    i = 0
    while i < len(secret):
        c = secret[i]
        if c == "\\" and i + 1 < len(secret):
            out.append(secret[i : i + 2])
            i += 2
            continue
        out.append("X" if c.isalnum() else c)
        i += 1
    return "".join(out)


def redact(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """The text with the secret part of every span masked; parts that overlap are masked as one."""
    parts = []
    for begin, end, kind, value in spans:
        if kind in ("address", "setting"):
            cut = text.rfind(value, begin, end)
            if cut >= 0:
                begin, end = cut, cut + len(value)
        elif kind == "private key":
            head = re.compile(r"-----BEGIN [A-Z0-9 ]+-----").match(text, begin, end)
            begin = head.end() if head else begin
        parts.append((begin, end))
    merged: list[list[int]] = []
    for begin, end in sorted(parts):
        if merged and begin < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    out, last = [], 0
    for begin, end in merged:
        out += [text[last:begin], mask(text[begin:end])]
        last = end
    return "".join([*out, text[last:]])


def _redacted(file: int, text: str, spans):
    yield file, len({(b, e) for b, e, _, _ in spans}), redact(text, spans)


def redacted_files(source_files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files that hold secrets, with redacted content: file_id, secrets, content."""
    return _rescanned(source_files, modules, _redacted, "file_id bigint, secrets int, content string")
