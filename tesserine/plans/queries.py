"""Registry of the core queries. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.config import DEFAULT_EXTENSIONS, DEFAULT_LANGUAGES
from tesserine.functions import exprs
from tesserine.operators import documents as docs
from tesserine.operators import graph, incremental, scan, views
from tesserine.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    """Register a query under its name."""
    QUERIES[f.__name__] = f
    return f


def _modules(spark: SparkSession, folder: str) -> DataFrame:
    return views.current_modules(table(spark, folder, "modules"), table(spark, folder, "source_files").select("file_id", "modified_at"))


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Current versions of files that the cache does not cover as of the successful runs."""
    # Only whether a module is there matters, so one leaf of it is read instead of the whole tree.
    cache = spark.read.schema("repo string, path string, content_hash string, run_id bigint, cached_at timestamp, module struct<language:string>").parquet(f"{folder}/module_cache.parquet")
    return incremental.pending_versions(table(spark, folder, "source_files"), cache, table(spark, folder, "scan_runs")).select("file_id")


@query
def scalar_slug(spark, folder):
    """Anchors of paths."""
    return table(spark, folder, "source_files").select("file_id", exprs.slug("path").alias("slug"))


@query
def scalar_path_key(spark, folder):
    """Paths without suffix, stems and suffixes."""
    return table(spark, folder, "source_files").select("file_id", exprs.path_key("path").alias("path_key"), exprs.path_stem("path").alias("stem"), exprs.path_suffix("path").alias("suffix"))


@query
def scalar_first_sentence(spark, folder):
    """First sentences of documents."""
    return table(spark, folder, "documents").select("doc_id", exprs.first_sentence("text").alias("sentence"))


@query
def scalar_tokens(spark, folder):
    """Token estimates of documents."""
    return table(spark, folder, "documents").select("doc_id", exprs.estimate_tokens("text").alias("tokens"))


@query
def scalar_sha256(spark, folder):
    """Content hashes, and whether the stored one agrees."""
    s = table(spark, folder, "source_files")
    return s.select("file_id", exprs.sha256("content").alias("hash"), F.coalesce(F.lower("content_hash") == exprs.sha256("content"), F.lit(False)).alias("agrees"))


@query
def scalar_clean_comment(spark, folder):
    """Docstrings of modules without comment marks."""
    return table(spark, folder, "modules").select("file_id", exprs.clean_comment("docstring").alias("doc")).distinct()


@query
def language_lookup(spark, folder):
    """Files per language of their extension."""
    return table(spark, folder, "source_files").groupBy(exprs.detect_language("path").alias("language")).agg(F.count("*").alias("n"))


@query
def scan_filter_chain(spark, folder):
    """Files that pass the scan's predicates, in their order."""
    return scan.accepted(table(spark, folder, "source_files"), DEFAULT_EXTENSIONS, DEFAULT_LANGUAGES, exclude=("**/test_*.py", "**/tests/**", "**/build/**"), include=("src/", "lib/**", "**/*.go")).select("file_id", "path")


@query
def stats_summary(spark, folder):
    """Counts over all modules."""
    return views.stats(_modules(spark, folder))


@query
def stats_by_repo(spark, folder):
    """Counts per repository."""
    return views.stats(_modules(spark, folder), "repo")


@query
def mini_signatures(spark, folder):
    """Signatures of all functions and methods."""
    return views.functions(_modules(spark, folder)).select("repo", "path", "owner", "owner_ord", "fn_ord", "signature")


@query
def flat_params(spark, folder):
    """Parameters of all functions and methods."""
    return views.params(_modules(spark, folder)).groupBy("repo", "path").agg(F.count("*").alias("params"), F.sum(F.when(F.col("is_optional"), 1).otherwise(0)).alias("optional"), F.sum(F.when(F.col("default") != "", 1).otherwise(0)).alias("with_default"))


@query
def flat_classes(spark, folder):
    """Classes with bases."""
    return views.classes(_modules(spark, folder)).select("repo", "path", "class_ord", "name", F.array_join("bases", ", ").alias("bases"), "methods")


@query
def flat_constants(spark, folder):
    """Constants and class variables as lines."""
    return views.constants(_modules(spark, folder)).select("repo", "path", "owner", "const_ord", "name", "type_hint")


@query
def flat_routes(spark, folder):
    """Routes as list items."""
    m = _modules(spark, folder)
    return m.select("repo", "path", F.posexplode(F.transform("routes", exprs.route_line)).alias("route_ord", "line"))


@query
def env_table(spark, folder):
    """Environment variables with the files that read them."""
    return views.env_table(_modules(spark, folder))


@query
def exports_union(spark, folder):
    """Sorted exports of modules."""
    return _modules(spark, folder).select("repo", "path", exprs.json_list(exprs.exports()).alias("exports"))


@query
def summary_lines(spark, folder):
    """Summary line of every module."""
    return docs.summary_lines(_modules(spark, folder)).select("repo", "path", "line")


@query
def summary_budget_cut(spark, folder):
    """Lines that stay in each repository's summary within 500 tokens."""
    return docs.summary_cut(_modules(spark, folder), 500).select("repo", "path", "line", "refs")


@query
def summary_documents(spark, folder):
    """Summaries of all repositories within 8,000 tokens."""
    return docs.summary_documents(_modules(spark, folder))


@query
def prune_truncate(spark, folder):
    """Docstrings cut to their first sentence, per function."""
    return views.functions(views.truncated(_modules(spark, folder))).select("repo", "path", "owner", "owner_ord", "fn_ord", "docstring")


@query
def prune_drop_private(spark, folder):
    """Functions and methods left when private ones go."""
    m = views.without_private(_modules(spark, folder))
    return m.select("repo", "path", F.size("functions").alias("functions"), F.aggregate("classes", F.lit(0), lambda a, c: a + F.size(c["methods"])).alias("methods"))


@query
def prune_drop_constants(spark, folder):
    """Tokens of modules with and without constants."""
    m = _modules(spark, folder)
    cut = views.without_constants(m).select("repo", "path", exprs.module_tokens().alias("without_constants"))
    return m.select("repo", "path", exprs.module_tokens().alias("tokens")).join(cut, ["repo", "path"])


@query
def prune_stages(spark, folder):
    """Stage at which each repository's summary fits 1,500 tokens."""
    return docs.prune_stage(_modules(spark, folder), 1500, docs.summary_cost)


@query
def full_document(spark, folder):
    """Lines of the full documents."""
    return docs.full_lines(_modules(spark, folder))


@query
def full_document_pruned(spark, folder):
    """Modules of each repository that stay in a full document of 1,000 tokens, in their order."""
    return docs.fitted_full(_modules(spark, folder), 1000).select("repo", "path", "stage", "refs")


@query
def mini_document(spark, folder):
    """Lines of the documents of names and signatures."""
    return docs.mini_lines(_modules(spark, folder)).select("repo", "path", "line_ord", "line")


@query
def module_details(spark, folder):
    """Sections of the full documents."""
    return docs.module_details(_modules(spark, folder)).select("repo", "path", "text")


@query
def diff_semi(spark, folder):
    """Modules whose file changed after the cache's last successful run began."""
    last = table(spark, folder, "scan_runs").where("status = 'success'").agg(F.max("started_at").alias("since"))
    since = last.first().since  # one value
    changed = table(spark, folder, "source_files").where(F.col("modified_at") > F.lit(since))
    m = _modules(spark, folder)
    return m.join(changed.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("repo", "path", "name")


@query
def dependency_edges(spark, folder):
    """Edges between modules."""
    return graph.dependency_edges(_modules(spark, folder))


@query
def dependency_tpch(spark, folder):
    """Edges between modules made of nations and regions, imported by dotted and by relative name."""
    r = table(spark, folder, "region").select(F.lit("tpch").alias("repo"), F.concat(F.lit("geo/"), "r_name", F.lit(".py")).alias("path"), F.col("r_regionkey").cast("bigint").alias("module_ord"), F.array(F.lit("os")).alias("imports"))
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("geo."), "r_name")).otherwise(F.concat(F.lit(".."), "r_name"))
    n = n.select(F.lit("tpch").alias("repo"), F.concat(F.lit("geo/nations/"), "n_name", F.lit(".py")).alias("path"), (F.col("n_nationkey") + 100).cast("bigint").alias("module_ord"), F.array(F.lit("sys"), name, name).alias("imports"))
    return graph.dependency_edges(r.unionByName(n))


@query
def duplicate_anchor_tpch(spark, folder):
    """Repeated anchors in documents of 200 customers each, with a line per customer that anchors its nation."""
    c = table(spark, folder, "customer")
    line = F.concat(F.lit('<a id="n'), F.col("c_nationkey").cast("string"), F.lit('"></a> '), "c_name")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"]), "\n")
    d = c.groupBy(F.floor(F.col("c_custkey") / 200).alias("doc_id")).agg(text.alias("text"))
    return docs.duplicate_anchors(d).select("doc", "line_no", "anchor", "first_line")


@query
def dependency_lines(spark, folder):
    """What each module imports, as a line."""
    return graph.dependency_lines(_modules(spark, folder)).select("repo", "path", "line")


@query
def reference_counts(spark, folder):
    """Number of modules that mention each module."""
    return graph.reference_counts(_modules(spark, folder)).select("repo", "path", "n")


@query
def link_extract(spark, folder):
    """Links on list lines of documents."""
    return docs.links(table(spark, folder, "documents"))


@query
def duplicate_anchor(spark, folder):
    """Anchors that a document repeats."""
    return docs.duplicate_anchors(table(spark, folder, "documents")).select("doc", "line_no", "anchor", "first_line")


@query
def validate_rules(spark, folder):
    """Violations of the rules of a summary document."""
    return docs.violations(table(spark, folder, "documents"))


@query
def cache_hits(spark, folder):
    """Versions whose parsed module the cache holds: same path, hash and parse options."""
    return scan.cache_join(table(spark, folder, "source_files"), table(spark, folder, "module_cache")).where("hit").select("file_id")


@query
def cache_misses(spark, folder):
    """Versions that must be parsed."""
    return scan.cache_join(table(spark, folder, "source_files"), table(spark, folder, "module_cache")).where("not hit").select("file_id")


@query
def cache_merge(spark, folder):
    """Rows per repository of the cache after a run: entries of seen files, old ones collected."""
    return scan.cache_merged(table(spark, folder, "source_files"), table(spark, folder, "module_cache")).groupBy("repo").agg(F.count("*").alias("entries"), F.sum(F.when(F.col("hit"), 1).otherwise(0)).alias("kept"))


@query
def sticky_state(spark, folder):
    """Last purchase-like event seen by each user before each event."""
    e = table(spark, folder, "events")
    return views.carried_forward(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "last_purchase")


@query
def head_collapse(spark, folder):
    """Functions of a class or module with one name, collapsed."""
    return views.heads_collapsed(views.functions(_modules(spark, folder)).select("repo", "path", "owner", "owner_ord", "fn_ord", "name", "signature")).select("repo", "path", "owner", "owner_ord", "name", "heads")


@query
def receiver_attach(spark, folder):
    """Orders joined to customers, both kept when unmatched."""
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("orders"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return views.members_attached(orders, customers, "key").select("key", "orders", "c_name", "synthetic")


@query
def first_match(spark, folder):
    """First module of each repository under every alias."""
    return graph.path_aliases(_modules(spark, folder)).select("repo", "alias", "target")


@query
def roundtrip_python(spark, folder):
    """Python source written from nations, parsed again."""
    from tesserine.parse.udtf import parse_modules

    n = table(spark, folder, "nation")
    src = F.concat(F.lit('"""'), "n_name", F.lit('"""\n\nKEY: int = '), F.col("n_nationkey").cast("string"), F.lit("\n\ndef visit_"), F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "_")), F.lit("(region: int = "), F.col("n_regionkey").cast("string"), F.lit(') -> str:\n    """Visit."""\n    return ""\n'))
    files = n.select(F.lit("tpch").alias("repo"), F.concat("n_name", F.lit(".py")).alias("path"), F.lit("python").alias("language"), src.alias("content"))
    m = parse_modules(files)
    return m.select("path", "docstring", F.col("functions")[0]["name"].alias("fn"), F.col("functions")[0]["parameters"][0]["default"].alias("region"), F.col("constants")[0]["value"].alias("key"))


@query
def roundtrip_go(spark, folder):
    """Go source written from regions, parsed again."""
    from tesserine.parse.udtf import parse_modules

    r = table(spark, folder, "region")
    name = F.initcap(F.lower(F.regexp_replace("r_name", "[^A-Za-z]", "")))
    src = F.concat(F.lit("// Package regions.\npackage regions\n\n// Visit"), name, F.lit(" goes there.\nfunc Visit"), name, F.lit("(key int) string {\n\treturn \"\"\n}\n"))
    files = r.select(F.lit("tpch").alias("repo"), F.concat("r_name", F.lit(".go")).alias("path"), F.lit("go").alias("language"), src.alias("content"))
    return parse_modules(files).select("path", "docstring", F.col("functions")[0]["name"].alias("fn"), F.col("functions")[0]["docstring"].alias("doc"), F.col("functions")[0]["return_type"].alias("returns"))


@query
def roundtrip_typescript(spark, folder):
    """TypeScript source written from parts, parsed again."""
    from tesserine.parse.udtf import parse_modules

    p = table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    src = F.concat(F.lit("/** Part "), key, F.lit(" */\nexport async function part"), key, F.lit("(size?: number): Promise<number> { return "), key, F.lit("; }\nexport const SIZE: number = "), key, F.lit(";\n"))
    files = p.select(F.lit("tpch").alias("repo"), F.concat(F.lit("part"), key, F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), src.alias("content"))
    m = parse_modules(files)
    return m.select("path", F.col("functions")[0]["name"].alias("fn"), F.col("functions")[0]["docstring"].alias("doc"), F.col("functions")[0]["return_type"].alias("returns"), F.col("functions")[0]["is_async"].alias("is_async"))


# Source text per language, written from a nation's name and key and parsed again: (suffix, text, method, parameters).
ROUND_TRIPS = {
    "java": (".java", '/** {n} doc. */\npublic class {n} {{\n    public static final int KEY = {k};\n    /** Visits. */\n    public String visit(int region) {{ return null; }}\n}}\n', "visit", "region"),
    "csharp": (".cs", 'namespace A {{\n    /// <summary>{n} doc.</summary>\n    public class {n} {{\n        public const int Key = {k};\n        /// <summary>Visits.</summary>\n        public string Visit(int region) {{ return null; }}\n    }}\n}}\n', "Visit", "region"),
    "rust": (".rs", "/// {n} doc.\npub struct {n} {{ pub key: i32 }}\nimpl {n} {{\n    /// Visits.\n    pub fn visit(&self, region: i32) -> String {{ x }}\n}}\npub const KEY: i32 = {k};\n", "visit", "&self, region"),
    "cpp": (".cpp", "/// {n} doc.\nclass {n} : public Base {{\npublic:\n    int key = {k};\n    /// Visits.\n    int visit(int region) {{ return 1; }}\n}};\n", "visit", "region"),
    "scala": (".scala", '/** {n} doc. */\nclass {n} extends Base {{\n  val key: Int = {k}\n  /** Visits. */\n  def visit(region: Int): String = ""\n}}\n', "visit", "region"),
    "kotlin": (".kt", '/** {n} doc. */\nclass {n}(val key: Int = {k}) : Base() {{\n    /** Visits. */\n    fun visit(region: Int): String {{ return "" }}\n}}\n', "visit", "region"),
    "swift": (".swift", '/// {n} doc.\nclass {n}: Base {{\n    /// Visits.\n    func visit(region: Int) -> String {{ return "" }}\n}}\nlet KEY: Int = {k}\n', "visit", "region"),
    "php": (".php", "<?php\n\n/** {n} doc. */\nclass {n} extends Base {{\n    const KEY = {k};\n    /** Visits. */\n    public function visit(int $region): string {{ return ''; }}\n}}\n", "visit", "$region"),
    "ruby": (".rb", "# {n} doc.\nclass {n} < Base\n  KEY = {k}\n  # Visits.\n  def visit(region)\n    1\n  end\nend\n", "visit", "region"),
    "elixir": (".ex", 'defmodule {n} do\n  @moduledoc "{n} doc."\n  @key {k}\n  @doc "Visits."\n  def visit(region) do\n    1\n  end\nend\n', "visit", "region"),
}


def _round_trip(language: str):
    suffix, text, _, _ = ROUND_TRIPS[language]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        from tesserine.parse.udtf import parse_modules

        name = F.initcap(F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")))
        src = F.lit(text.replace("{{", "{").replace("}}", "}").replace("{n}", "\x00").replace("{k}", "\x01"))
        src = F.replace(F.replace(src, F.lit("\x00"), name), F.lit("\x01"), F.col("n_nationkey").cast("string"))
        files = table(spark, folder, "nation").select(F.lit("tpch").alias("repo"), F.concat(name, F.lit(suffix)).alias("path"), F.lit(language).alias("language"), src.alias("content"))
        c = F.col("classes")[0]
        m = c["methods"][0]
        values = F.concat(F.transform(c["class_vars"], lambda v: v["value"]), F.transform("constants", lambda v: v["value"]))
        return parse_modules(files).select("path", c["name"].alias("cls"), c["docstring"].alias("doc"), m["name"].alias("method"), m["docstring"].alias("method_doc"), F.array_join(F.transform(m["parameters"], lambda p: p["name"]), ", ").alias("params"), F.coalesce(F.element_at(F.filter(values, lambda v: v != ""), -1), F.lit("")).alias("key"))

    run.__doc__ = f"{language} source written from nations, parsed again."
    return run


for _language in ROUND_TRIPS:
    QUERIES[f"roundtrip_{_language}"] = _round_trip(_language)


@query
def prune_counters(spark, folder):
    """Docstrings that would be cut, constants and private symbols that would go, per repository."""
    return docs.prune_counters(_modules(spark, folder))


@query
def parsed_symbols(spark, folder):
    """Symbols that the parsers find in every file version."""
    from tesserine.parse.udtf import parse_modules

    m = parse_modules(table(spark, folder, "source_files"), include_private=True, keep=["file_id"])
    return m.select("file_id", F.size("functions").alias("functions"), F.size("classes").alias("classes"), F.size("constants").alias("constants"), F.size("imports").alias("imports")).dropDuplicates(["file_id"])


@query
def watch_rebuild(spark, folder):
    """Latest event per user from a stream of the events file, read in micro-batches until it ends."""
    from tesserine.streaming.watch import latest_by_key

    return latest_by_key(spark, f"{folder}/events.parquet", table(spark, folder, "events").schema, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All core queries by name."""
    from tesserine.plans import members, tree

    return QUERIES | tree.QUERIES | {"parsed_members": members.parsed_members, "parsed_script": members.parsed_script}


def oracle_sql() -> dict[str, str]:
    """SQL for the core queries."""
    from tesserine.plans import members, oracle, oracle_documents, oracle_tree

    return oracle.SQL | oracle_documents.SQL | oracle_tree.SQL | {"parsed_members": members.members_sql(), "parsed_script": members.script_sql()}

