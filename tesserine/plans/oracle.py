"""SQL of the core queries for a second engine (DuckDB): an independent statement of what each returns, on the same tables."""

from __future__ import annotations


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


CM = """dated as (select file_id, max(modified_at) as modified_at from source_files group by file_id),
cm as (select * exclude (k, modified_at) from (select m.*, d.modified_at, row_number() over (partition by m.repo, m.path order by d.modified_at desc nulls last, m.file_id desc) as k from modules m left join dated d on d.file_id = m.file_id) where k = 1)"""
_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_KEY = r"regexp_replace({0}, '([^/])\.[^./]+$', '\1')"
_STEM = r"regexp_replace(split_part({0}, '/', -1), '(.)\.[^.]+$', '\1')"
_SUFFIX = r"lower(regexp_extract({0}, '[^/](\.[^./]+)$', 1))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _first(x: str) -> str:
    line = rf"regexp_extract({_STRIP.format(f'coalesce({x}, chr(0)[1:0])')}, '^[^\n\r\x0b\x0c]*')"
    return f"(case when contains({line}, '.') then split_part({line}, '.', 1) || '.' else {line} end)"


# Fixed values, stated here once more so that a mistake in the engine's own tables shows.
_LANGUAGES = ".py python .js javascript .jsx javascript .ts typescript .tsx typescript .go go .rs rust .rb ruby .java java .cs csharp .c cpp .h cpp .cpp cpp .hpp cpp .cc cpp .scala scala .sc scala .php php .swift swift .ex elixir .exs elixir .kt kotlin .kts kotlin".split()
_DESCRIBED = {"models": "Data models.", "utils": "Utility functions.", "helpers": "Utility functions.", "types": "Type definitions.", "schemas": "Schema definitions.", "routes": "HTTP route handlers.", "constants": "Module constants.", "config": "Configuration settings."}


def _language(x: str) -> str:
    return f"(case {_SUFFIX.format(x)} " + " ".join(f"when {_quote(k)} then {_quote(v)}" for k, v in zip(_LANGUAGES[::2], _LANGUAGES[1::2])) + " end)"


def _params(f: str) -> str:
    return f"""array_to_string(list_transform({f}.parameters, lambda p: p.name || (case when p.is_optional then '?' else '' end) || (case when p.type_hint <> '' then ': ' || p.type_hint else '' end) || (case when p."default" <> '' then ' = ' || p."default" else '' end)), ', ')"""


def _signature(f: str) -> str:
    return f"(case when {f}.is_async then 'async ' else '' end) || {f}.name || '(' || {_params(f)} || ')' || (case when {f}.return_type <> '' then ' -> ' || {f}.return_type else '' end)"


FNS = f"""{CM},
own as (select repo, path, '' as owner, cast(-1 as integer) as owner_ord, cast(i - 1 as integer) as fn_ord, functions[i] as f from cm, unnest(generate_series(1, len(functions))) as t(i)),
cls as (select repo, path, cast(j - 1 as integer) as owner_ord, classes[j] as c from cm, unnest(generate_series(1, len(classes))) as t(j)),
meth as (select repo, path, c.name as owner, owner_ord, cast(i - 1 as integer) as fn_ord, c.methods[i] as f from cls, unnest(generate_series(1, len(c.methods))) as t(i)),
fns as (select * from own union all select * from meth)"""

_PLAIN = "(case when len(classes) > 0 then 'Defines ' || array_to_string(list_transform(classes, lambda c: c.name), ', ') || '.' when len(functions) > 0 then 'Provides ' || array_to_string(list_transform(functions, lambda f: f.name), ', ') || '.' else '' end)"
_PAGE = "list_filter(routes, lambda r: r.handler = 'default' and r.method = 'GET')"
_ALL = "list_filter(constants, lambda c: c.name = '__all__')"
_ITEMS = rf"list_filter(list_transform(string_split(replace(replace(trim({_ALL}[1].value, '[]() '), '''', ''), '\"', ''), ','), lambda s: {_STRIP.format('s')}), lambda s: s <> '')"
_BY_NAME = f"(case lower({_STEM.format('path')}) " + " ".join(f"when {_quote(k)} then {_quote(v)}" for k, v in _DESCRIBED.items()) + " end)"
_FALLBACK = f"""(case when regexp_matches(path, 'page\\.(?:tsx|jsx|ts|js)$') and len({_PAGE}) > 0 then 'Page component at ' || {_PAGE}[1].path || '.' when len(routes) > 0 then 'Defines HTTP routes.' when {_BY_NAME} is not null then {_BY_NAME}
 else coalesce(list_filter(classes, lambda c: c.docstring <> '')[1].docstring, list_filter(functions, lambda f: f.docstring <> '')[1].docstring, case when len({_ITEMS}) > 0 then 'Provides ' || array_to_string({_ITEMS}, ', ') || '.' end, {_PLAIN}) end)"""
LINES = f"""{CM},
described as (select repo, module_ord, path, {_first("docstring")} as own, {_FALLBACK} as other from cm),
lines as (select repo, module_ord, path, rtrim('- [' || {_KEY.format("path")} || '](llms-full.txt#' || {_SLUG.format("path")} || '): ' || (case when own <> '' then own else {_first("other")} end)) as line from described)"""


def _parts(constants: str = "constants") -> str:
    fn = "lambda f: list_concat([f.name, f.docstring, f.return_type], flatten(list_transform(f.parameters, lambda p: [p.name, p.type_hint, p.\"default\"])))"
    parts = f"list_concat([name, docstring], flatten(list_transform(functions, {fn})))"
    parts = f"list_concat({parts}, flatten(list_transform(classes, lambda c: list_concat(list_concat([c.name, c.docstring], c.bases), flatten(list_transform(c.methods, {fn}))))))"
    return f"list_concat({parts}, flatten(list_transform({constants}, lambda k: [k.name, k.type_hint, k.value])))"


def _tokens(constants: str = "constants") -> str:
    return f"greatest(1, length(array_to_string({_parts(constants)}, chr(10))) // 4)"


_STATS = f"count(*) as files, sum(len(functions)) as functions, sum(len(classes)) as classes, sum(coalesce(list_sum(list_transform(classes, lambda c: len(c.methods))), 0)) as methods, array_to_string(list_sort(array_agg(distinct language)), ', ') as languages, sum({_tokens()}) as tokens"
_REF = "lower(array_to_string(list_concat(list_concat(list_concat([{d}], flatten(list_transform(functions, lambda f: [f.name, {fd}]))), flatten(list_transform(classes, lambda c: list_concat([c.name, {cd}], flatten(list_transform(c.methods, lambda f: [f.name, {fd}])))))), list_transform({k}, lambda c: c.name)), ' '))"
_REF_FULL = _REF.format(d="docstring", fd="f.docstring", cd="c.docstring", k="constants")


def _counts(text: str, source: str = "cm") -> str:
    return f"""texts as (select repo, path, {text} as txt from {source}),
stems as (select repo, path, module_ord, lower({_STEM.format("path")}) as stem from cm),
counts as (select s.repo, s.path, any_value(s.module_ord) as module_ord, count(t.path) as n from stems s left join texts t on t.repo = s.repo and t.path <> s.path and contains(t.txt, s.stem) group by s.repo, s.path)"""


_CUT_FN = f"list_transform(list_filter(functions, lambda f: not f.is_private), lambda f: struct_pack(name := f.name, docstring := {_first('f.docstring')}))"
_CUT_CLS = f"list_transform(classes, lambda c: struct_pack(name := c.name, docstring := {_first('c.docstring')}, methods := list_transform(list_filter(c.methods, lambda f: not f.is_private), lambda f: struct_pack(name := f.name, docstring := {_first('f.docstring')}))))"
_ALIASES = f"""named as (select repo, module_ord, path, i, array_to_string(list_slice(parts, i, len(parts)), '/') as alias from (select repo, module_ord, path, string_split({_KEY.format("path")}, '/') as parts from cm), unnest(generate_series(1, len(parts))) as t(i)),
cand as (select repo, alias, path, module_ord, 1 as rank, i * 2 as n from named union all select repo, replace(alias, '/', '.'), path, module_ord, 1, i * 2 + 1 from named union all select repo, path, path, module_ord, 0, 0 from cm),
aliases as (select repo, alias, path as target from (select *, row_number() over (partition by repo, alias order by rank, module_ord, n, path) as k from cand) where k = 1)"""
_REST = r"replace(regexp_replace(imp, '^\.+', ''), '.', '/')"
_DOTS = r"length(regexp_extract(imp, '^\.*'))"
_EDGES = f"""{CM}, {_ALIASES},
used as (select repo, path as src, i as n, imports[i] as imp from cm, unnest(generate_series(1, len(imports))) as t(i)),
rel as (select *, case when imp like '.%' then array_to_string(list_concat(list_slice(string_split(src, '/'), 1, greatest(len(string_split(src, '/')) - 1 - (case when {_REST} = '' then {_DOTS} else {_DOTS} - 1 end), 0)), case when {_REST} = '' then [] else [{_REST}] end), '/') end as relative from used),
edges as (select distinct r.repo, r.src, coalesce(a.target, b.target) as dst from rel r left join aliases a on a.repo = r.repo and a.alias = r.imp left join aliases b on b.repo = r.repo and b.alias = r.relative where coalesce(a.target, b.target) is not null and coalesce(a.target, b.target) <> r.src)"""
_DOC_LINES = r"""raw as (select cast(doc_id as varchar) as doc, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e]') as xs from documents),
dl as (select doc, cast(i as integer) as line_no, xs[i] as line from raw, unnest(generate_series(1, len(xs))) as t(i) where regexp_replace(xs[i], '^\s+|\s+$', '', 'g') <> '')"""
_ANCHOR = """(?i)<(?:a|span)[^>]*(?:id|name)=["''](.*?)["'']"""
_HASH = "regexp_replace(lower(trim(content_hash)), '^sha-?256[:=]', '')"
_CACHED = f"cached as (select distinct repo, path, {_HASH} as hash from module_cache where module is not null and coalesce(parse_opts, 'private=0') = 'private=0')"
SQL: dict[str, str] = {
    "p5_found": """
with cur as (
  select repo, path, file_id, content, row_number() over (partition by repo, path order by modified_at desc, file_id desc) as k from source_files
), st as (
  select c.repo, c.path, regexp_replace(lower(trim(c.content_hash)), '^sha-?256[:=]', '') as h,
         row_number() over (partition by c.repo, c.path order by c.run_id desc, c.cached_at desc, c.content_hash desc) as k
  from module_cache c join scan_runs r on r.run_id = c.run_id and r.status = 'success' where c.module is not null
)
select cur.file_id from cur left join st on st.repo is not distinct from cur.repo and st.path is not distinct from cur.path and st.k = 1
where cur.k = 1 and (st.h is null or cur.content is null or st.h <> sha256(cur.content))""",
    "scalar_slug": f"select file_id, {_SLUG.format('path')} as slug from source_files",
    "scalar_path_key": f"select file_id, {_KEY.format('path')} as path_key, {_STEM.format('path')} as stem, {_SUFFIX.format('path')} as suffix from source_files",
    "scalar_first_sentence": f"select doc_id, {_first('text')} as sentence from documents",
    "scalar_tokens": "select doc_id, greatest(1, length(text) // 4) as tokens from documents",
    "scalar_sha256": "select file_id, sha256(content) as hash, coalesce(lower(content_hash) = sha256(content), false) as agrees from source_files",
    "language_lookup": f"select {_language('path')} as language, count(*) as n from source_files group by 1",
    "scan_filter_chain": rf"""select file_id, path from source_files
 where not list_has_any(string_split(path, '/'), ['.git', '__pycache__', 'node_modules', '.venv', 'venv', 'dist', 'build', '.mypy_cache', '.pytest_cache', '.ruff_cache', '.tox', '.idea', '.vscode'])
 and {_SUFFIX.format('path')} in ('.py', '.js', '.jsx', '.ts', '.tsx', '.go', '.rs', '.rb', '.java', '.cs', '.c', '.h', '.cpp', '.hpp', '.cc')
 and not (regexp_matches(path, '(^|/)test_[^/]*\.py(/|$)') or regexp_matches(path, '(^|/)(tests|build)/'))
 and (regexp_matches(path, '(^|/)src/') or starts_with(path, 'lib/') or regexp_matches(path, '\.go(/|$)'))""",
    "stats_summary": f"with {CM} select {_STATS} from cm",
    "stats_by_repo": f"with {CM} select repo, {_STATS} from cm group by repo",
    "mini_signatures": f"with {FNS} select repo, path, owner, owner_ord, fn_ord, {_signature('f')} as signature from fns",
    "flat_params": f"with {FNS}, ps as (select repo, path, unnest(f.parameters) as p from fns) select repo, path, count(*) as params, count(*) filter (p.is_optional) as optional, count(*) filter (p.\"default\" <> '') as with_default from ps group by repo, path",
    "flat_classes": f"with {FNS} select repo, path, owner_ord as class_ord, c.name as name, array_to_string(c.bases, ', ') as bases, cast(len(c.methods) as integer) as methods from cls",
    "flat_constants": f"with {FNS}, ks as (select repo, path, '' as owner, cast(i - 1 as integer) as const_ord, constants[i] as k from cm, unnest(generate_series(1, len(constants))) as t(i) union all select repo, path, c.name, cast(i - 1 as integer), c.class_vars[i] from cls, unnest(generate_series(1, len(c.class_vars))) as t(i)) select repo, path, owner, const_ord, k.name as name, k.type_hint as type_hint from ks",
    "flat_routes": f"with {CM}, rs as (select repo, path, cast(i - 1 as integer) as route_ord, routes[i] as r from cm, unnest(generate_series(1, len(routes))) as t(i)) select repo, path, route_ord, '- `' || r.method || ' ' || r.path || '`' || (case when r.handler not in ('', 'default') then ' → `' || r.handler || '`' else '' end) || (case when r.docstring <> '' then ' — ' || r.docstring else '' end) as line from rs",
    "env_table": f"with {CM}, e as (select distinct repo, path, unnest(map_keys(env_vars)) as var from cm) select repo, var, string_agg(path, ', ' order by path) as files, count(*) as n from e group by repo, var",
    "exports_union": f"""with {CM}, x as (select repo, path, list_sort(list_distinct(list_concat(list_concat(list_transform(functions, lambda f: f.name), list_transform(classes, lambda c: c.name)), list_transform(constants, lambda k: k.name)))) as names from cm)
 select repo, path, '[' || array_to_string(list_transform(names, lambda n: '"' || n || '"'), ', ') || ']' as exports from x""",
    "summary_lines": f"with {LINES} select repo, path, line from lines",
    "summary_budget_cut": f"""with {LINES}, {_counts(_REF.format(d=_first("docstring"), fd="f.docstring", cd="c.docstring", k="[struct_pack(name := '')]").replace("list_transform([struct_pack(name := '')], lambda c: c.name)", "[]"), f"(select repo, path, docstring, {_CUT_FN} as functions, {_CUT_CLS} as classes from cm)")},
head as (select repo, length('# ' || repo || chr(10) || chr(10) || '## Modules' || chr(10) || chr(10)) as h from cm group by repo),
tot as (select l.repo, sum(length(line) + 1) + any_value(h) <= 2003 as fits, 2003 - any_value(h) as room from lines l join head using (repo) group by l.repo),
ranked as (select l.*, c.n as refs, t.fits, t.room, sum(length(line) + 1) over (partition by l.repo order by c.n desc, l.module_ord desc, l.path desc rows between unbounded preceding and current row) as chars from lines l join counts c on c.repo = l.repo and c.path = l.path join tot t on t.repo = l.repo)
select repo, path, line, case when fits then 0 else refs end as refs from ranked where fits or chars <= room""",
    "prune_truncate": f"with {FNS} select repo, path, owner, owner_ord, fn_ord, {_first('f.docstring')} as docstring from fns",
    "prune_drop_private": f"with {CM} select repo, path, cast(len(list_filter(functions, lambda f: not f.is_private)) as integer) as functions, cast(coalesce(list_sum(list_transform(classes, lambda c: len(list_filter(c.methods, lambda f: not f.is_private)))), 0) as integer) as methods from cm",
    "prune_drop_constants": f"with {CM} select repo, path, {_tokens()} as tokens, {_tokens('list_slice(constants, 1, 0)')} as without_constants from cm",
    "diff_semi": f"with {CM}, changed as (select distinct repo, path from source_files where modified_at > (select max(started_at) from scan_runs where status = 'success')) select repo, path, name from cm where exists (select 1 from changed c where c.repo = cm.repo and c.path = cm.path)",
    "dependency_edges": f"with {_EDGES} select repo, src, dst from edges",
    "dependency_tpch": "select 'tpch' as repo, 'geo/nations/' || n_name || '.py' as src, 'geo/' || r_name || '.py' as dst from nation join region on n_regionkey = r_regionkey",
    "duplicate_anchor_tpch": "with l as (select cast(c_custkey // 200 as varchar) as doc, 'n' || c_nationkey as anchor, cast(row_number() over (partition by c_custkey // 200 order by c_custkey) as integer) as line_no from customer), f as (select *, min(line_no) over (partition by doc, anchor) as first_line from l) select doc, line_no, anchor, first_line from f where line_no > first_line",
    "dependency_lines": f"with {_EDGES}, grouped as (select repo, src as path, string_agg('`' || dst || '`', ', ' order by dst) as targets from edges group by repo, src) select cm.repo, cm.path, '`' || cm.path || '` imports: ' || coalesce(targets, '(none — leaf node)') as line from cm left join grouped g on g.repo = cm.repo and g.path = cm.path",
    "first_match": f"with {CM}, {_ALIASES} select repo, alias, target from aliases",
    "reference_counts": f"with {CM}, {_counts(_REF_FULL)} select repo, path, n from counts",
    "link_extract": rf"with {_DOC_LINES}, ls as (select doc, line_no, regexp_extract_all(line, '\[(.*?)\]\((.*?)\)', 1) as a, regexp_extract_all(line, '\[(.*?)\]\((.*?)\)', 2) as b from dl where starts_with(regexp_replace(line, '^\s+|\s+$', '', 'g'), '- ')) select doc, line_no, a[i] as label, b[i] as url from ls, unnest(generate_series(1, len(a))) as t(i)",
    "duplicate_anchor": f"with {_DOC_LINES}, an as (select doc, line_no, i as n, xs[i] as anchor from (select doc, line_no, regexp_extract_all(line, '{_ANCHOR}', 1) as xs from dl), unnest(generate_series(1, len(xs))) as t(i)), nu as (select *, row_number() over (partition by doc, anchor order by line_no, n) as k, first_value(line_no) over (partition by doc, anchor order by line_no, n) as first_line from an) select doc, line_no, anchor, first_line from nu where k > 1",
    "cache_hits": f"with {_CACHED}, v as (select distinct file_id, repo, path, sha256(content) as hash from source_files) select file_id from v where exists (select 1 from cached c where c.repo = v.repo and c.path = v.path and c.hash = v.hash)",
    "cache_misses": f"with {_CACHED}, v as (select distinct file_id, repo, path, sha256(content) as hash from source_files) select file_id from v where not exists (select 1 from cached c where c.repo = v.repo and c.path = v.path and c.hash = v.hash)",
    "cache_merge": f"with {_CACHED}, cur as (select repo, path, sha256(content) as hash from (select *, row_number() over (partition by repo, path order by modified_at desc, file_id desc) as k from source_files) where k = 1) select cur.repo, count(*) as entries, count(c.hash) as kept from cur left join cached c on c.repo = cur.repo and c.path = cur.path and c.hash = cur.hash group by cur.repo",
    "sticky_state": "select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase from events",
    "head_collapse": f"with {FNS} select repo, path, owner, owner_ord, f.name || (case when count(*) > 1 then ' (+' || (count(*) - 1) || ' heads)' else '' end) as name, cast(count(*) as integer) as heads from fns group by repo, path, owner, owner_ord, f.name",
    "receiver_attach": "select coalesce(o.key, c.c_custkey) as key, o.orders as orders, c.c_name as c_name, c.c_custkey is null as synthetic from (select o_custkey as key, count(*) as orders from orders group by 1) o full join customer c on c.c_custkey = o.key",
    "mini_document": f"""with {CM}, x as (select repo, path, list_concat(list_concat([path, ''], case when len(functions) > 0 then list_concat(list_transform(functions, lambda f: {_signature('f')}), ['']) else [] end), flatten(list_transform(classes, lambda c: list_concat([c.name, ''], case when len(c.methods) > 0 then list_concat(list_transform(c.methods, lambda f: {_signature('f')}), ['']) else [] end)))) as ls from cm)
 select repo, path, cast(i - 1 as integer) as line_ord, ls[i] as line from x, unnest(generate_series(1, len(ls))) as t(i)""",
    "roundtrip_python": "select n_name || '.py' as path, n_name as docstring, 'visit_' || lower(regexp_replace(n_name, '[^A-Za-z]', '_', 'g')) as fn, cast(n_regionkey as varchar) as region, cast(n_nationkey as varchar) as key from nation",
    "roundtrip_go": "with r as (select *, upper(regexp_replace(r_name, '[^A-Za-z]', '', 'g')[1:1]) || lower(regexp_replace(r_name, '[^A-Za-z]', '', 'g')[2:]) as nm from region) select r_name || '.go' as path, 'Package regions.' as docstring, 'Visit' || nm as fn, 'Visit' || nm || ' goes there.' as doc, 'string' as returns from r",
    "roundtrip_typescript": "select 'part' || p_partkey || '.ts' as path, 'part' || p_partkey as fn, 'Part ' || p_partkey as doc, 'Promise<number>' as returns, true as is_async from part",
    "watch_rebuild": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1",
}

_CUT = "(case when {0} <> '' and {0} <> {1} then 1 else 0 end)"
_cut = lambda d: _CUT.format(d, _first(d))
SQL["prune_counters"] = f"""with {CM} select repo,
 sum({_cut("docstring")} + coalesce(list_sum(list_transform(functions, lambda f: {_cut("f.docstring")})), 0) + coalesce(list_sum(list_transform(classes, lambda c: {_cut("c.docstring")} + coalesce(list_sum(list_transform(c.methods, lambda f: {_cut("f.docstring")})), 0))), 0)) as docstrings,
 sum(len(constants) + coalesce(list_sum(list_transform(classes, lambda c: len(c.class_vars))), 0)) as constants,
 sum(len(list_filter(functions, lambda f: f.is_private)) + coalesce(list_sum(list_transform(classes, lambda c: len(list_filter(c.methods, lambda f: f.is_private)))), 0)) as private
 from cm group by repo"""


def _round_trips() -> dict[str, str]:
    from tesserine.plans.queries import ROUND_TRIPS

    name = "regexp_replace(n_name, '[^A-Za-z]', '', 'g')"
    name = f"(upper({name}[1:1]) || lower({name}[2:]))"
    return {f"roundtrip_{k}": f"select {name} || '{suffix}' as path, {name} as cls, {name} || ' doc.' as doc, '{method}' as method, 'Visits.' as method_doc, '{params}' as params, cast(n_nationkey as varchar) as key from nation" for k, (suffix, _, method, params) in ROUND_TRIPS.items()}


SQL |= _round_trips()
