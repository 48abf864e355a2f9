"""Import resolution, dependency edges and reference counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import exprs
from tesserine.session import map_rows, stored

#: Stems of a repository that make one automaton, and texts that run through it in one task.
STEMS, TEXTS = 50_000, 20_000


def path_aliases(modules: DataFrame) -> DataFrame:
    """Names under which a module can be imported, per repository: alias, path.

    A module's own path always means that module. Every suffix of the path without extension, with slashes or dots, means
    the first module (by module_ord) that has it.
    """
    parts = F.split(exprs.path_key("path"), "/")
    suffixes = modules.select("repo", "path", "module_ord", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("k", "alias"))
    forms = suffixes.select("repo", "path", "module_ord", F.posexplode(F.array("alias", F.translate("alias", "/", "."))).alias("form", "alias"), "k")
    named = forms.select("repo", "alias", F.struct(F.lit(1).alias("rank"), "module_ord", (F.col("k") * 2 + F.col("form")).alias("n"), "path").alias("v"))
    own = modules.select("repo", F.col("path").alias("alias"), F.struct(F.lit(0).alias("rank"), "module_ord", F.lit(0).alias("n"), "path").alias("v"))
    return named.unionByName(own).groupBy("repo", "alias").agg(F.min("v").alias("v")).select("repo", "alias", F.col("v.path").alias("target"), F.col("v.module_ord").alias("target_ord"))


def aliases_of(path: str) -> list[str]:
    """The suffixes of a path without extension, with slashes and with dots."""
    folder, slash, name = path.rpartition("/")
    stem = name[: name.rindex(".")] if name.rfind(".") > 0 else name
    parts = (folder + slash + stem).split("/")
    found = ["/".join(parts[i:]) for i in range(len(parts))]
    return found + [x.replace("/", ".") for x in found if "/" in x]


def relative_name(path, name, resolve_slashes: bool = False):
    """The path that a name with leading dots means, seen from a file; with ``resolve_slashes`` "./x" and "../x" as well."""
    dots = F.length(F.regexp_extract(name, "^(\\.*)", 1))
    rest = F.translate(F.regexp_replace(name, "^\\.+", ""), ".", "/")
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    up = F.when(rest == "", dots).otherwise(dots - 1)
    kept = F.slice(folders, 1, F.greatest(F.size(folders) - up, F.lit(0)))
    dotted = F.array_join(F.concat(kept, F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(rest))), "/")
    if not resolve_slashes:
        return dotted
    steps = F.size(F.expr("regexp_extract_all(concat('/', import), '/\\\\.\\\\.(?=/)', 0)"))
    tail = F.regexp_replace(name, "^(?:\\.{1,2}/)+", "")
    by_slash = F.array_join(F.concat(F.slice(folders, 1, F.greatest(F.size(folders) - steps, F.lit(0))), F.array(F.regexp_replace(tail, "\\.\\w+$", ""))), "/")
    return F.when(name.rlike("^\\.{1,2}/"), by_slash).otherwise(dotted)


def dependency_edges(modules: DataFrame, resolve_relative_ts: bool = False) -> DataFrame:
    """Distinct edges (repo, src, dst) from a module to the modules it imports; names that resolve to nothing drop out.

    One equi join on (repo, alias) serves both the name as written and, where that fails, its relative form.
    """
    used = modules.select("repo", F.col("path").alias("src"), F.posexplode("imports").alias("n", "import"))
    tries = used.select(
        "repo", "src", "n", F.posexplode(F.array(F.col("import"), F.when(F.col("import").startswith("."), relative_name(F.col("src"), F.col("import"), resolve_relative_ts)))).alias("turn", "alias")
    ).where("alias is not null")
    found = tries.join(path_aliases(modules), ["repo", "alias"])
    first = found.groupBy("repo", "src", "n").agg(F.min(F.struct("turn", "target")).alias("v"))
    return first.select("repo", "src", F.col("v.target").alias("dst")).where("src <> dst").distinct()


def dependency_lines(modules: DataFrame, **options) -> DataFrame:
    """Per module the sorted list of what it imports, "(none — leaf node)" where that is nothing."""
    edges = dependency_edges(modules, **options).groupBy("repo", F.col("src").alias("path")).agg(F.array_sort(F.collect_list("dst")).alias("targets"))
    shown = F.coalesce(F.array_join(F.transform("targets", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", "), F.lit("(none — leaf node)"))
    return modules.select("repo", "path", "module_ord").join(edges, ["repo", "path"], "left").select("repo", "path", "module_ord", F.concat(F.lit("`"), "path", F.lit("` imports: "), shown).alias("line"))


def reference_texts(modules: DataFrame, *also: str) -> DataFrame:
    """What reference counts need of modules: repo, path, module_ord, stem, text (and columns named in ``also``)."""
    return modules.select("repo", "path", "module_ord", F.lower(exprs.path_stem("path")).alias("stem"), exprs.reference_text().alias("text"), *also)


def mentions(texts: DataFrame, stems: int = STEMS, group: int = TEXTS) -> DataFrame:
    """Pairs (repo, path, stem) of ``reference_texts``: the text holds the stem of some module of its repository as a substring.

    Texts meet the stems of their own repository only. A repository of more than ``stems`` stems or ``group`` texts is dealt
    into blocks of stems times groups of texts, so a task's group is bounded however large the repository. Stems come first
    in a group and make an automaton, through which its texts then run once: the work is linear in texts and matches, unlike
    a join on "contains".
    """
    known = texts.where("repo is not null")
    named = known.select("repo", "stem").distinct()
    held = known.select("repo", "path", "text")
    size = known.groupBy("repo").agg(F.count("*").alias("texts"), F.countDistinct("stem").alias("stems"))
    shape = size.select("repo", F.ceil(F.col("stems") / stems).cast("int").alias("blocks"), F.ceil(F.col("texts") / group).cast("int").alias("groups"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    none = F.lit(None).cast("string")
    words = named.join(shape, "repo").select("repo", F.pmod(F.xxhash64("stem"), F.col("blocks")).cast("int").alias("b"), upto("groups").alias("g"), F.lit(0).alias("kind"), F.col("stem").alias("name"), none.alias("text"))
    rows = held.join(shape, "repo").select("repo", upto("blocks").alias("b"), F.pmod(F.xxhash64("path"), F.col("groups")).cast("int").alias("g"), F.lit(1).alias("kind"), F.col("path").alias("name"), "text")
    together = words.unionByName(rows).repartition("repo", "b", "g").sortWithinPartitions("repo", "b", "g", "kind")

    def run(batch):
        key, stems_here, find = None, [], None
        for r in batch:
            if (r["repo"], r["b"], r["g"]) != key:
                key, stems_here, find = (r["repo"], r["b"], r["g"]), [], None
            if r["kind"] == 0:
                stems_here.append(r["name"])
                continue
            if find is None:
                find = _automaton(stems_here)
            for stem in find(r["text"] or ""):
                yield r["repo"], r["name"], stem

    return map_rows(together, run, "repo string, path string, stem string")


def _automaton(words: list[str]):
    """A function from a text to the set of words in it."""
    try:
        import ahocorasick
    except ImportError:
        import re

        return lambda text: {w for w in words if re.search(re.escape(w), text)}
    made = ahocorasick.Automaton()
    empty = [w for w in words if not w]
    for w in words:
        if w:
            made.add_word(w, w)
    if not len(made):
        return lambda text: set(empty)
    made.make_automaton()
    return lambda text: {w for _, w in made.iter(text)} | set(empty)


def counts_of(texts: DataFrame, **sizes: int) -> DataFrame:
    """Per module of ``reference_texts`` the number of other modules of its repository whose text mentions its stem."""
    seen = mentions(texts, **sizes)
    total = seen.groupBy("repo", "stem").agg(F.count("*").alias("n"))
    own = seen.select("repo", "path", "stem", F.lit(1).alias("own"))
    named = texts.select("repo", "path", "module_ord", "stem")
    return named.join(total, ["repo", "stem"], "left").join(own, ["repo", "path", "stem"], "left").select("repo", "path", "module_ord", (F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).cast("bigint").alias("n"))


def reference_counts(modules: DataFrame, **sizes: int) -> DataFrame:
    """Per module the number of other modules of its repository whose text mentions its stem; zero where none does."""
    return counts_of(stored(reference_texts(modules), "texts"), **sizes)
