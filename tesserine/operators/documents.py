"""Documents made of modules: lines of the summary, full, mini and diff documents, budgets, and the checks of a document.

A document is a relation of lines per repository, ordered by (section, module, line). Only documents within a token budget
are put together into one string per repository, so no unbounded group meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.config import Config
from tesserine.functions import exprs
from tesserine.operators import graph, views
from tesserine.session import map_rows, stored

# What a file's name says about it.
DESCRIPTIONS = {"models": "Data models.", "utils": "Utility functions.", "helpers": "Utility functions.", "types": "Type definitions.", "schemas": "Schema definitions.", "routes": "HTTP route handlers.", "constants": "Module constants.", "config": "Configuration settings."}


def _empty() -> Column:
    return F.array().cast("array<string>")


def _first(items: Column, test: Callable[[Column], Column]) -> Column:
    """The first item that passes, or null."""
    return F.get(F.filter(items, test), F.lit(0))


def plain_fallback() -> Column:
    """What a module defines, by the names of its classes or functions."""
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ", ")
    return F.when(F.size("classes") > 0, F.concat(F.lit("Defines "), names("classes"), F.lit("."))).when(F.size("functions") > 0, F.concat(F.lit("Provides "), names("functions"), F.lit("."))).otherwise("")


def fallback(smart: bool = True) -> Column:
    """Description of a module without docstring: page route, routes, file name, first docstring, __all__, or its names."""
    if not smart:
        return plain_fallback()
    page = _first(F.col("routes"), lambda r: (r["handler"] == "default") & (r["method"] == "GET"))
    stem = F.lower(exprs.path_stem("path"))
    by_name = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])[stem]
    documented = lambda c: _first(F.col(c), lambda x: x["docstring"] != "")["docstring"]
    listed = _first(F.col("constants"), lambda c: c["name"] == "__all__")["value"]
    items = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(listed, "^[\\[\\]() ]+|[\\[\\]() ]+$", ""), "['\"]", ""), ","), exprs.strip), lambda x: x != "")
    return (
        F.when(F.col("path").rlike("page\\.(?:tsx|jsx|ts|js)$") & page.isNotNull(), F.concat(F.lit("Page component at "), page["path"], F.lit(".")))
        .when(F.size("routes") > 0, "Defines HTTP routes.")
        .when(by_name.isNotNull(), by_name)
        .otherwise(F.coalesce(documented("classes"), documented("functions"), F.when(F.size(items) > 0, F.concat(F.lit("Provides "), F.array_join(items, ", "), F.lit("."))), plain_fallback()))
    )


def summary_line(config: Config | None = None) -> Column:
    """The line of a module in the summary."""
    config = config or Config(root=".")
    own = exprs.first_sentence("docstring")
    text = F.when(own != "", own).otherwise(exprs.first_sentence(fallback(config.smart_summaries)))
    return F.regexp_replace(F.concat(F.lit("- ["), exprs.path_key("path"), F.lit(f"]({config.output_full}#"), exprs.slug("path"), F.lit("): "), text), "(?U)\\s+$", "")


def summary_head(config: Config | None = None) -> Column:
    """What stands before the lines of the summary; the repository's name heads it where the settings have none."""
    config = config or Config(root=".")
    name = F.lit(config.name) if config.name else F.coalesce("repo", F.lit("project"))
    return F.concat(F.lit("# "), name, F.lit("\n\n" + (f"> {config.description}\n\n" if config.description else "") + "## Modules\n\n"))


def summary_lines(modules: DataFrame, config: Config | None = None) -> DataFrame:
    """One line per module: repo, module_ord, path, line."""
    return modules.select("repo", "module_ord", "path", summary_line(config).alias("line"))


def summary_cut(modules: DataFrame, max_tokens: int = 8000, config: Config | None = None, counts: DataFrame | None = None) -> DataFrame:
    """The lines that stay in each repository's summary within the budget, in order of references.

    Where a repository's lines fit, all stay in module order. Else the modules least referred to go first, until the rest
    fits: the longest suffix by (references, module_ord) whose characters do. A line has at least ten characters, so only
    the last ``4 * max_tokens / 10`` modules can be part of it; that limit is applied before the shuffle, and the running
    sum then works on a bounded group even where one repository holds most modules.
    """
    config = config or Config(root=".", max_tokens_summary=max_tokens)
    room = 4 * max_tokens + 3
    # Lines of the modules as they are, and texts of the pruned ones, in one pass over the nested columns.
    lined = modules.withColumn("line", summary_line(config))
    slim = stored(graph.reference_texts(views.without_private(views.without_constants(views.truncated(lined))), "line"), "summary")
    lines = slim.select("repo", "module_ord", "path", "line")
    size = F.length("line") + 1
    head = F.length(summary_head(config))
    total = lines.groupBy("repo").agg(F.sum(size).alias("chars")).select("repo", (F.col("chars") + head <= room).alias("fits"), (F.lit(room) - head).alias("room"))
    refs = counts if counts is not None else graph.counts_of(slim)
    ranked = lines.join(refs.select("repo", "path", F.col("n").alias("refs")), ["repo", "path"]).join(total, "repo")
    kept = ranked.where("fits").select("repo", "module_ord", "path", "line", F.lit(0).cast("bigint").alias("refs"))
    last = Window.partitionBy("repo").orderBy(F.col("refs").desc(), F.col("module_ord").desc(), F.col("path").desc())
    bounded = ranked.where("not fits").withColumn("k", F.row_number().over(last)).where(F.col("k") <= room // 10)
    running = bounded.withColumn("chars", F.sum(size).over(last.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return kept.unionByName(running.where("chars <= room").select("repo", "module_ord", "path", "line", "refs"))


def summary_documents(modules: DataFrame, max_tokens: int = 8000, config: Config | None = None) -> DataFrame:
    """The summary of each repository as text. Its size is bounded by the budget."""
    cut = summary_cut(modules, max_tokens, config)
    lines = cut.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("refs", "module_ord", "path", "line"))).alias("x"))
    repos = modules.select("repo").distinct()
    body = F.coalesce(F.array_join(F.transform("x", lambda r: F.concat(r["line"], F.lit("\n"))), ""), F.lit(""))
    return repos.join(lines, "repo", "left").select("repo", F.concat(summary_head(config), body).alias("text"))


def detail_lines(config: Config | None = None) -> Column:
    """The lines of a module in the full document."""
    config = config or Config(root=".")
    doc = lambda d: F.when(d != "", F.array(F.lit(""), d)).otherwise(_empty())
    blank = F.array(F.lit(""))
    parts = [F.array(F.concat(F.lit("## "), "path"), F.concat(F.lit('<a id="'), exprs.slug("path"), F.lit('"></a>')))]
    if config.emit_frontmatter:
        names = exprs.exports()
        used = F.array_sort(F.array_distinct("imports"))
        served = F.array_sort(F.array_distinct(F.transform("routes", lambda r: F.concat(r["method"], F.lit(" "), r["path"]))))
        some = lambda label, items: F.when(F.size(items) > 0, F.array(F.concat(F.lit(f"{label}: "), exprs.json_list(items)))).otherwise(_empty())
        parts += [F.array(F.lit("```yaml"), F.concat(F.lit("language: "), "language")), some("exports", names), some("imports", used), some("routes", served), F.array(F.lit("```"))]
    parts.append(blank)
    parts.append(F.when(F.col("docstring") != "", F.array(F.col("docstring"), F.lit(""))).otherwise(_empty()))
    decorators = lambda f: F.when(F.size(f["decorators"]) > 0, F.array(F.concat(F.lit("_Decorators: "), F.array_join(F.transform(f["decorators"], lambda d: F.concat(F.lit("@"), F.regexp_replace(d, "^@", ""))), ", "), F.lit("_")))).otherwise(_empty())
    fn = lambda f: F.concat(F.array(F.concat(F.lit("#### `"), exprs.signature(f), F.lit("`"))), decorators(f), doc(f["docstring"]), blank)
    section = lambda items, title, one: F.when(F.size(items) > 0, F.concat(F.array(F.lit(f"### {title}"), F.lit("")), F.flatten(F.transform(items, one)))).otherwise(_empty())
    parts.append(section("functions", "Functions", fn))
    method = lambda f: F.concat(F.array(F.concat(F.lit("###### `"), exprs.signature(f), F.lit("`"))), doc(f["docstring"]), blank)
    bases = lambda c: F.when(F.size(c["bases"]) > 0, F.concat(F.lit("("), F.array_join(c["bases"], ", "), F.lit(")"))).otherwise("")
    methods = lambda c: F.when(F.size(c["methods"]) > 0, F.concat(F.array(F.lit(""), F.lit("##### Methods"), F.lit("")), F.flatten(F.transform(c["methods"], method)))).otherwise(_empty())
    parts.append(section("classes", "Classes", lambda c: F.concat(F.array(F.concat(F.lit("#### `"), c["name"], bases(c), F.lit("`"))), doc(c["docstring"]), methods(c), blank)))
    listed = lambda items, title, one: F.when(F.size(items) > 0, F.concat(F.array(F.lit(f"### {title}"), F.lit("")), F.transform(items, one), blank)).otherwise(_empty())
    parts.append(listed("constants", "Constants", exprs.constant_line))
    parts.append(listed("routes", "Routes", exprs.route_line))
    return F.concat(*parts)


def module_details(modules: DataFrame, config: Config | None = None) -> DataFrame:
    """The section of each module in the full document as text."""
    return modules.select("repo", "module_ord", "path", F.array_join(detail_lines(config), "\n").alias("text"))


def mini_lines(modules: DataFrame) -> DataFrame:
    """Lines of the document of bare names and signatures: repo, module_ord, path, line_ord, line."""
    sigs = lambda items: F.when(F.size(items) > 0, F.concat(F.transform(items, exprs.signature), F.array(F.lit("")))).otherwise(_empty())
    lines = F.concat(F.array(F.col("path"), F.lit("")), sigs(F.col("functions")), F.flatten(F.transform("classes", lambda c: F.concat(F.array(c["name"], F.lit("")), sigs(c["methods"])))))
    return modules.select("repo", "module_ord", "path", F.posexplode(lines).alias("line_ord", "line"))


def full_lines(modules: DataFrame, config: Config | None = None) -> DataFrame:
    """Lines of the full document of each repository: repo, section_ord, module_ord, line_ord, line; sections are head, environment, dependencies, modules."""
    config = config or Config(root=".")
    repos = modules.select("repo").distinct()
    name = F.lit(config.name) if config.name else F.coalesce("repo", F.lit("project"))
    head = F.array(*[F.concat(F.lit("# "), name), F.lit(""), *([F.lit(f"> {config.description}"), F.lit("")] if config.description else [])])
    zero = F.lit(0).cast("bigint")
    first = repos.select("repo", F.lit(0).alias("section_ord"), zero.alias("module_ord"), F.posexplode(head).alias("line_ord", "line"))
    pairs = views.env_refs(modules).distinct().groupBy("repo", "var").agg(F.array_sort(F.collect_list("path")).alias("files"))
    # One row of the table per variable; its place among the variables of the repository is their order by name.
    row = F.concat(F.lit("| `"), "var", F.lit("` | "), F.array_join(F.transform("files", lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", "), F.lit(" |"))
    env = pairs.select("repo", F.lit(1).alias("section_ord"), F.dense_rank().over(Window.partitionBy("repo").orderBy("var")).cast("bigint").alias("module_ord"), F.lit(0).alias("line_ord"), row.alias("line"))
    env_head = pairs.select("repo").distinct().select("repo", F.lit(1).alias("section_ord"), zero.alias("module_ord"), F.posexplode(F.array(*[F.lit(x) for x in ("## Environment Variables", "", "| Variable | Files |", "|---|---|")])).alias("line_ord", "line"))
    far = F.lit(2**62).cast("bigint")
    env_end = pairs.select("repo").distinct().select("repo", F.lit(1).alias("section_ord"), far.alias("module_ord"), F.lit(0).alias("line_ord"), F.lit("").alias("line"))
    dep_head = repos.select("repo", F.lit(2).alias("section_ord"), F.lit(-1).cast("bigint").alias("module_ord"), F.posexplode(F.array(F.lit("## Dependency Graph"), F.lit(""))).alias("line_ord", "line"))
    deps = graph.dependency_lines(modules).select("repo", F.lit(2).alias("section_ord"), "module_ord", F.lit(0).alias("line_ord"), "line")
    dep_end = repos.select("repo", F.lit(2).alias("section_ord"), far.alias("module_ord"), F.lit(0).alias("line_ord"), F.lit("").alias("line"))
    details = modules.select("repo", F.lit(3).alias("section_ord"), "module_ord", F.posexplode(detail_lines(config)).alias("line_ord", "line"))
    out = first
    for part in (env_head, env, env_end, dep_head, deps, dep_end, details):
        out = out.unionByName(part)
    return out


def diff_lines(modules: DataFrame, changed: DataFrame, config: Config | None = None) -> DataFrame:
    """Lines of the partial view of changed modules; ``changed`` has (repo, path) or path."""
    config = config or Config(root=".")
    keys = [c for c in ("repo", "path") if c in changed.columns]
    some = modules.join(changed.select(*keys).distinct(), keys, "left_semi")
    repos = some.select("repo").distinct()
    name = F.lit(config.name) if config.name else F.coalesce("repo", F.lit("project"))
    note = "> Partial view — cross-module sections omitted. See llms-full.txt for complete context."
    head = F.array(F.concat(F.lit("# "), name), F.lit(""), *([F.lit(f"> {config.description}"), F.lit("")] if config.description else []), F.lit(note), F.lit(""))
    first = repos.select("repo", F.lit(0).alias("section_ord"), F.lit(0).cast("bigint").alias("module_ord"), F.posexplode(head).alias("line_ord", "line"))
    return first.unionByName(some.select("repo", F.lit(1).alias("section_ord"), "module_ord", F.posexplode(detail_lines(config)).alias("line_ord", "line")))


def joined_document(lines: DataFrame) -> DataFrame:
    """Ordered lines as one text per repository; for documents whose size is bounded (a budget, one repository)."""
    keys = [c for c in ("section_ord", "module_ord", "line_ord") if c in lines.columns]
    return lines.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, "line"))), lambda x: x["line"]), "\n").alias("text"))


def prune_stage(modules: DataFrame, max_tokens: int, cost: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per repository the first stage whose document fits: 0 as it is, 1 docstrings cut, 2 without constants, 3 without private symbols, 4 modules must go.

    ``cost`` gives (repo, chars) for a set of modules; its sums are additive, so every stage is one aggregate.
    """
    stages = [modules, views.truncated(modules)]
    stages.append(views.without_constants(stages[1]))
    stages.append(views.without_private(stages[2]))
    out = None
    for k, m in enumerate(stages):
        part = cost(m).where(F.col("chars") <= 4 * max_tokens + 3).select("repo", F.lit(k).alias("stage"))
        out = part if out is None else out.unionByName(part)
    fit = out.groupBy("repo").agg(F.min("stage").alias("stage"))
    return modules.select("repo").distinct().join(fit, "repo", "left").select("repo", F.coalesce("stage", F.lit(4)).alias("stage"))


def prune_counters(modules: DataFrame) -> DataFrame:
    """What the stages would change per repository: docstrings longer than their first sentence, constants, private symbols."""
    cut = lambda d: F.when((d != "") & (d != exprs.first_sentence(d)), 1).otherwise(0)
    total = lambda items, one: F.aggregate(items, F.lit(0), lambda a, x: a + one(x))
    of_class = lambda c: cut(c["docstring"]) + total(c["methods"], lambda f: cut(f["docstring"]))
    private = lambda f: F.when(f["is_private"], 1).otherwise(0)
    return modules.groupBy("repo").agg(
        F.sum(cut(F.col("docstring")) + total("functions", lambda f: cut(f["docstring"])) + total("classes", of_class)).alias("docstrings"),
        F.sum(F.size("constants") + total("classes", lambda c: F.size(c["class_vars"]))).alias("constants"),
        F.sum(total("functions", private) + total("classes", lambda c: total(c["methods"], private))).alias("private"),
    )


def detail_cost(modules: DataFrame) -> DataFrame:
    """Characters of the module sections per repository."""
    return module_details(modules).groupBy("repo").agg(F.sum(F.length("text") + 1).alias("chars"))


def summary_cost(modules: DataFrame) -> DataFrame:
    """Characters of the summary per repository."""
    return summary_lines(modules).groupBy("repo").agg(F.sum(F.length("line") + 1).alias("chars")).select("repo", (F.col("chars") + F.length(summary_head())).alias("chars"))


def pruned(modules: DataFrame, max_tokens: int, cost: Callable[[DataFrame], DataFrame] = detail_cost, size: Callable[[], Column] | None = None) -> DataFrame:
    """Modules pruned to the budget per repository, stage by stage; ``size`` is the additive size of one module for the last stage.

    The last stage keeps the longest suffix by (references, module_ord) that fits. It is exact where the document's size is
    the sum of its modules' sizes.
    """
    one = (size or (lambda: F.length(F.array_join(detail_lines(), "\n")) + 1))()
    stage = prune_stage(modules, max_tokens, cost)
    staged = modules.join(stage, "repo")
    cut1 = views.truncated(staged)
    cut2 = views.without_constants(cut1)
    cut3 = views.without_private(cut2)
    kept = staged.where("stage = 0").unionByName(cut1.where("stage = 1")).unionByName(cut2.where("stage = 2")).unionByName(cut3.where("stage = 3")).withColumn("refs", F.lit(0).cast("bigint"))
    room = 4 * max_tokens + 3
    over = cut3.where("stage = 4")
    refs = graph.reference_counts(over)
    keys = over.select("repo", "path", "module_ord", one.alias("size")).join(refs.select("repo", "path", F.col("n").alias("refs")), ["repo", "path"])
    last = Window.partitionBy("repo").orderBy(F.col("refs").desc(), F.col("module_ord").desc(), F.col("path").desc())
    bounded = keys.withColumn("k", F.row_number().over(last)).where(F.col("k") <= room // 10)
    fitting = bounded.withColumn("chars", F.sum("size").over(last.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("chars") <= room).select("repo", "path", "refs")
    return kept.unionByName(over.join(fitting, ["repo", "path"]).select(*kept.columns))


def longest_fitting(rows: list[dict], room: int, head: int) -> int:
    """How many modules at the end of ``rows`` make the longest full document within ``room`` characters.

    ``rows`` are in the order in which modules go, each with path, size (of its section), vars, aliases and imports (a list
    of names to try for each). Modules are added from the end, and what the document gains is kept up to date: a module in
    front takes over the aliases it shares with later ones, so lines of those that import them are written again.
    """
    none = len("(none — leaf node)")
    own: dict[str, str] = {}
    first: dict[str, str] = {}
    wanted: dict[str, set[int]] = {}
    line: dict[int, int] = {}
    seen_vars: set[str] = set()

    def written(i: int) -> int:
        found = set()
        for tries in rows[i]["imports"]:
            for x in tries:
                target = own.get(x) or first.get(x)
                if target:
                    found.add(target)
                    break
        found.discard(rows[i]["path"])
        return len(rows[i]["path"]) + 12 + (sum(len(t) + 4 for t in found) - 2 if found else none) + 1

    total = head + len("## Dependency Graph") + 1 + 1 + 1 - 1
    best = 0
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        total += r["size"]
        for v in r["vars"]:
            if not seen_vars:
                total += len("## Environment Variables") + 1 + 1 + len("| Variable | Files |") + 1 + len("|---|---|") + 1 + 1
            total += len(r["path"]) + 4 if v in seen_vars else len(v) + len(r["path"]) + 12
            seen_vars.add(v)
        touched = {i}
        if r["path"] not in own:
            own[r["path"]] = r["path"]
            touched |= wanted.get(r["path"], set())
        for x in r["aliases"]:
            first[x] = r["path"]
            touched |= wanted.get(x, set())
        for tries in r["imports"]:
            for x in tries:
                wanted.setdefault(x, set()).add(i)
        for j in touched:
            total -= line.get(j, 0)
            line[j] = written(j)
            total += line[j]
        if total <= room:
            best = len(rows) - i
    return best


def fitted_full(modules: DataFrame, max_tokens: int, config: Config | None = None) -> DataFrame:
    """Modules of each repository that stay in a full document within the budget, stage by stage, exact to the character.

    Every stage measures the whole document. In the last one modules go one at a time, the least referred to first, until the
    rest fits; dropping one changes environment table and dependency lines, which is followed module by module. Every module
    takes ten characters at least, so only the last ``room / 10`` can stay, a bounded group however large the repository.
    Adds stage and refs; modules of the last stage get the place among those that stay as their module_ord.
    """
    config = config or Config(root=".")
    room = 4 * max_tokens + 3
    size = F.length(F.array_join(detail_lines(config), "\n")) + 1
    # Sections change with the stage, the rest of the document does not: both are summed once.
    sized = modules.withColumn("__s0", size)
    for k, prune in enumerate((views.truncated, views.without_constants, views.without_private), 1):
        sized = prune(sized).withColumn(f"__s{k}", size)
    sections = sized.groupBy("repo").agg(*[F.sum(f"__s{k}").alias(f"s{k}") for k in range(4)])
    rest = full_lines(modules, config).where("section_ord < 3").groupBy("repo").agg((F.sum(F.length("line") + 1) - 1).alias("chars"))
    first = F.coalesce(*[F.when(F.col("chars") + F.col(f"s{k}") <= room, k) for k in range(4)], F.lit(4))
    stage = stored(rest.join(sections, "repo").select("repo", first.alias("stage")), "stage")
    staged = modules.join(stage, "repo")
    cut1 = views.truncated(staged)
    cut2 = views.without_constants(cut1)
    cut3 = views.without_private(cut2)
    whole = staged.where("stage = 0").unionByName(cut1.where("stage = 1")).unionByName(cut2.where("stage = 2")).unionByName(cut3.where("stage = 3")).withColumn("refs", F.lit(0).cast("bigint"))
    over = cut3.where("stage = 4")
    refs = graph.reference_counts(over)
    tries = F.transform("imports", lambda i: F.filter(F.array(i, F.when(i.startswith("."), graph.relative_name(F.col("path"), i))), lambda x: x.isNotNull()))
    slim = over.select("repo", "path", "module_ord", size.alias("size"), F.map_keys("env_vars").alias("vars"), tries.alias("imports"))
    ranked = slim.join(refs.select("repo", "path", F.col("n").alias("refs")), ["repo", "path"])
    last = Window.partitionBy("repo").orderBy(F.col("refs").desc(), F.col("module_ord").desc(), F.col("path").desc())
    bounded = ranked.withColumn("k", F.row_number().over(last)).where(F.col("k") <= room // 10 + 1)
    named = config.name

    def run(batch):
        for repo, group in groupby(batch, key=lambda r: r["repo"]):
            rows = [{**r, "vars": r["vars"] or [], "imports": r["imports"] or [], "aliases": graph.aliases_of(r["path"])} for r in group]
            head = len(named or repo or "project") + 2 + 1 + 1 + (len(config.description) + 2 + 1 + 1 if config.description else 0)
            n = longest_fitting(rows, room, head)
            for place, r in enumerate(rows[len(rows) - n :]):
                yield repo, r["path"], place, r["refs"]

    together = bounded.repartition("repo").sortWithinPartitions("repo", F.col("k").desc())
    fitting = map_rows(together, run, "repo string, path string, place bigint, refs bigint")
    left = over.join(fitting, ["repo", "path"]).withColumn("module_ord", F.col("place").cast(modules.schema["module_ord"].dataType)).drop("place")
    return whole.unionByName(left.select(*whole.columns))


def document_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-blank lines of documents with their numbers: doc, line_no, line, ord (1-based place among the non-blank lines)."""
    lines = documents.select(F.col(doc).cast("string").alias("doc"), F.filter(F.transform(F.split(exprs.text_or_empty(text), exprs.LINE_END), lambda s, i: F.struct((i + 1).alias("line_no"), s.alias("line"))), lambda x: exprs.strip(x["line"]) != "").alias("x"))
    return lines.select("doc", F.posexplode("x").alias("k", "r")).select("doc", F.col("r.line_no").alias("line_no"), F.col("r.line").alias("line"), (F.col("k") + 1).alias("ord"))


def links(documents: DataFrame) -> DataFrame:
    """Links on list lines: doc, line_no, label, url."""
    lines = document_lines(documents).where(exprs.strip("line").startswith("- "))
    pair = F.arrays_zip(F.expr("regexp_extract_all(line, '\\\\[(.*?)\\\\]\\\\((.*?)\\\\)', 1)").alias("label"), F.expr("regexp_extract_all(line, '\\\\[(.*?)\\\\]\\\\((.*?)\\\\)', 2)").alias("url"))
    return lines.select("doc", "line_no", F.explode(pair).alias("p")).select("doc", "line_no", F.col("p.label").alias("label"), F.col("p.url").alias("url"))


def anchors(documents: DataFrame) -> DataFrame:
    """Anchors: doc, line_no, n (place on the line), anchor."""
    found = F.expr("regexp_extract_all(line, '(?i)<(?:a|span)[^>]*(?:id|name)=[\"\\'](.*?)[\"\\']', 1)")
    return document_lines(documents).select("doc", "line_no", F.posexplode(found).alias("n", "anchor"))


def violations(documents: DataFrame) -> DataFrame:
    """What is wrong with documents: doc, line_no (0: the document), rule, message."""
    lines = document_lines(documents)
    at = lambda d: F.concat(F.lit("L"), F.col("line_no").cast("string"), F.lit(": "), d)
    shape = lines.groupBy("doc").agg(
        F.min(F.struct("ord", "line_no", "line")).alias("first"),
        F.min(F.when(exprs.strip("line").startswith("> "), F.struct("ord", "line_no"))).alias("quote"),
        F.max(F.col("line").startswith("## ")).alias("section"),
    )
    empty = documents.select(F.col("doc_id").cast("string").alias("doc")).join(shape.select("doc"), "doc", "left_anti").select("doc", F.lit(0).alias("line_no"), F.lit("empty").alias("rule"), F.lit("document is empty").alias("message"))
    heading = shape.where(~F.col("first.line").startswith("# ")).select("doc", F.col("first.line_no").alias("line_no")).select("doc", "line_no", F.lit("heading").alias("rule"), at(F.lit("missing top-level H1 heading (e.g. '# Project')")).alias("message"))
    quote = shape.where("quote.ord <> 2").select("doc", F.col("quote.line_no").alias("line_no")).select("doc", "line_no", F.lit("quote").alias("rule"), at(F.lit("blockquote must immediately follow H1 heading")).alias("message"))
    section = shape.where("not section").select("doc", F.lit(0).alias("line_no"), F.lit("section").alias("rule"), F.lit("no '##' section found").alias("message"))
    bad = links(documents)
    label = bad.where(exprs.strip("label") == "").select("doc", "line_no", F.lit("label").alias("rule"), at(F.lit("empty link label")).alias("message"))
    url = bad.where(exprs.strip("url") == "").select("doc", "line_no", F.lit("url").alias("rule"), at(F.lit("empty link URL")).alias("message"))
    again = duplicate_anchors(documents).select("doc", "line_no", F.lit("anchor").alias("rule"), at(F.concat(F.lit("duplicate anchor '"), "anchor", F.lit("' (previously seen on L"), F.col("first_line").cast("string"), F.lit(")"))).alias("message"))
    out = empty
    for part in (heading, quote, section, label, url, again):
        out = out.unionByName(part)
    return out


def duplicate_anchors(documents: DataFrame) -> DataFrame:
    """Every occurrence of an anchor after its first in a document: doc, line_no, n, anchor, first_line."""
    found = anchors(documents)
    first = found.groupBy("doc", "anchor").agg(F.min(F.struct("line_no", "n")).alias("f"), F.count("*").alias("c")).where("c > 1")
    again = found.join(first, ["doc", "anchor"]).where(F.struct("line_no", "n") > F.col("f"))
    return again.select("doc", "line_no", "n", "anchor", F.col("f.line_no").alias("first_line"))
