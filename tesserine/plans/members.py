"""Visibility, companions, partial classes, receivers, extensions and nested types in twelve languages, on source made of nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.session import table

#: Language: (suffix, source, what must come out: functions, classes, methods, fields); "{n}" stands for a nation's name.
SOURCES = {
    "scala": (".scala", '/** {n} doc. */\nclass {n}(x: Int) {\n  def visit(r: Int): String = ""\n  private def hide(): Int = 1\n}\nobject {n} {\n  val KEY: Int = 7\n  def make(): {n} = null\n}\n', "", "{n}", "{n}.visit {n}.make", "KEY"),
    "csharp": (".cs", "public partial class {n} {\n    public string Visit(int r) { return null; }\n    private int hide() { return 1; }\n}\npublic partial class {n} {\n    public int Second() { return 1; }\n    internal int Inner() { return 2; }\n}\n", "", "{n}", "{n}.Visit {n}.Second", ""),
    "rust": (".rs", "pub struct {n} { pub key: i32 }\nimpl {n} {\n    pub fn visit(&self) -> i32 { 1 }\n    fn hide(&self) {}\n}\nfn alone() {}\npub fn open() {}\n", "open", "{n}", "{n}.visit", "key"),
    "kotlin": (".kt", 'class {n} {\n    fun visit(r: Int): String { return "" }\n    private fun hide() {}\n    companion object {\n        const val KEY: Int = 7\n        fun make(): {n} { return {n}() }\n    }\n}\nprivate fun alone() {}\n', "", "{n}", "{n}.visit {n}.make", "KEY"),
    "swift": (".swift", 'public class {n} {\n    public func visit(r: Int) -> String { return "" }\n    private func hide() {}\n}\nextension {n} {\n    func more() -> Int { return 7 }\n}\n', "", "{n}", "{n}.visit {n}.more", ""),
    "go": (".go", 'package p\n\nfunc (n *{n}) Visit(key int) string {\n\treturn ""\n}\n\n// {n} doc.\ntype {n} struct {\n\tkey int\n}\n\nfunc (n {n}) hide() {}\n\nfunc (o Other) Lone() {}\n', "", "{n} Other", "{n}.Visit Other.Lone", ""),
    "java": (".java", "public class {n} {\n    public String visit(int r) { return null; }\n    private int hide() { return 1; }\n    public static class Inner {\n        public int deep() { return 7; }\n    }\n}\n", "", "{n}.Inner {n}", "{n}.Inner.deep {n}.visit", ""),
    "ruby": (".rb", "class {n}\n  def visit(r)\n    1\n  end\n\n  private\n\n  def hide\n    2\n  end\n\n  public\n\n  def open\n    3\n  end\nend\n", "", "{n}", "{n}.visit {n}.open", ""),
    "php": (".php", "<?php\nclass {n} {\n    public function visit(int $r): string { return ''; }\n    private function hide() {}\n    protected function kin() {}\n}\n", "", "{n}", "{n}.visit", ""),
    "cpp": (".cpp", "class {n} {\n    int before() { return 0; }\npublic:\n    int visit(int r) { return 1; }\nprivate:\n    int hide() { return 2; }\n};\n", "", "{n}", "{n}.visit", ""),
    "elixir": (".ex", "defmodule {n} do\n  def visit(r), do: 1\n  def visit(r, s), do: 2\n  defp hide(), do: 3\nend\n", "", "{n}", "{n}.visit (+1 heads)", ""),
    "typescript": (".ts", 'export class {n} {\n  visit(r: number): string { return ""; }\n  private hide() {}\n  #deep() {}\n}\nclass Local {}\nexport default function open() {}\n', "open", "{n}", "{n}.visit", ""),
}


def parsed_members(spark: SparkSession, folder: str) -> DataFrame:
    """Public functions, classes, methods and fields of every nation's class in every language."""
    from tesserine.parse.udtf import parse_modules

    name = F.initcap(F.lower(F.regexp_replace("n_name", "[^A-Za-z0-9]", "")))
    texts = F.explode(F.array(*[F.struct(F.lit(g).alias("language"), F.lit(x[0]).alias("suffix"), F.lit(x[1]).alias("text")) for g, x in SOURCES.items()])).alias("t")
    rows = table(spark, folder, "nation").select(name.alias("n"), texts)
    source = rows.select(F.lit("tpch").alias("repo"), F.concat("n", "t.suffix").alias("path"), "t.language", F.replace("t.text", F.lit("{n}"), "n").alias("content"))
    names = lambda items: F.array_join(F.transform(items, lambda x: x["name"]), " ")
    methods = F.flatten(F.transform("classes", lambda c: F.transform(c["methods"], lambda m: F.concat(c["name"], F.lit("."), m["name"]))))
    fields = F.flatten(F.transform("classes", lambda c: F.transform(c["class_vars"], lambda v: v["name"])))
    return parse_modules(source).select("path", names("functions").alias("functions"), names("classes").alias("classes"), F.array_join(methods, " ").alias("methods"), F.array_join(fields, " ").alias("fields"))


def members_sql() -> str:
    """What must come out, for a second engine."""
    name = "(upper(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')[1:1]) || lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')[2:]))"
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in (v[0], *v[2:])) + ")" for v in SOURCES.values())
    filled = ", ".join(f"replace({c}, '{{n}}', n) as {c}" for c in ("functions", "classes", "methods", "fields"))
    return f"with ns as (select {name} as n from nation), ls(suffix, functions, classes, methods, fields) as (values {rows}) select n || suffix as path, {filled} from ns cross join ls"


#: Path, source, functions, constants with types, routes, imports and environment variables; "{r}" stands for a region.
SCRIPTS = [
    ("src/app/{r}/page.tsx", 'import { Zone } from "../zone";\nexport default function Page() {\n  return null;\n}\n', "Page", "", "GET /{r} default", "../zone", ""),
    ("src/app/api/{r}/route.ts", 'import { z } from "zod";\n/** Lists. */\nexport async function GET(req: Request) {\n  return process.env.HOME_{r};\n}\nexport function POST() { return process.env["TOKEN"]; }\n', "GET POST", "", "GET /api/{r} GET;POST /api/{r} POST", "zod", "HOME_{r} TOKEN"),
    ("src/server/{r}.ts", 'import express from "express";\nimport * as zone from "./zone";\nconst app = express();\napp.get("/{r}/all", listAll);\napp.post("/{r}", (req, res) => {});\nexport const Shape = z.object({\n  name: z.string(),\n  size: z.number(),\n});\nconst hidden = 1;\n', "", "Shape: { name: string, size: number }", "GET /{r}/all listAll;POST /{r} ", "./zone express", ""),
    ("pkg/{r}.go", 'package p\n\nimport "os"\n\n// Home of the zone.\nfunc Home() string {\n\treturn os.Getenv("HOME_{r}")\n}\n\nfunc hidden() {}\n', "Home", "", "", "os", "HOME_{r}"),
]


def parsed_script(spark: SparkSession, folder: str) -> DataFrame:
    """Functions, constants, routes, imports and environment variables of pages, servers and Go files made of regions."""
    from tesserine.parse.udtf import parse_modules

    name = F.lower(F.regexp_replace("r_name", "[^A-Za-z0-9]", "_"))
    texts = F.explode(F.array(*[F.struct(F.lit(x[0]).alias("path"), F.lit(x[1]).alias("text")) for x in SCRIPTS])).alias("t")
    rows = table(spark, folder, "region").select(name.alias("r"), texts)
    put = lambda c: F.replace(c, F.lit("{r}"), F.col("r"))
    language = F.when(F.col("t.path").endswith(".go"), "go").otherwise("typescript")
    source = rows.select(F.lit("tpch").alias("repo"), put("t.path").alias("path"), language.alias("language"), put("t.text").alias("content"))
    constants = F.transform("constants", lambda k: F.concat(k["name"], F.when(k["type_hint"] != "", F.concat(F.lit(": "), k["type_hint"])).otherwise("")))
    served = F.transform("routes", lambda x: F.concat_ws(" ", x["method"], x["path"], x["handler"]))
    joined = lambda items: F.array_join(F.array_sort(items), " ")
    return parse_modules(source).select("path", joined(F.transform("functions", lambda f: f["name"])).alias("functions"), F.array_join(constants, "; ").alias("constants"), F.array_join(F.array_sort(served), ";").alias("routes"), joined(F.array_distinct("imports")).alias("imports"), joined(F.map_keys("env_vars")).alias("env"))


def script_sql() -> str:
    """What must come out, for a second engine."""
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in (v[0], *v[2:])) + ")" for v in SCRIPTS)
    filled = ", ".join(f"replace({c}, '{{r}}', r) as {c}" for c in ("path", "functions", "constants", "routes", "imports", "env"))
    return f"with rs as (select lower(regexp_replace(r_name, '[^A-Za-z0-9]', '_', 'g')) as r from region), ls(path, functions, constants, routes, imports, env) as (values {rows}) select {filled} from rs cross join ls"
