"""SQL of the queries over a source tree made of nations and regions."""

from __future__ import annotations

from tesserine.plans.tree import NATION, REGION


def _text(template: str, *marks: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for m in marks:
        out = f"replace({out}, '{{{m}}}', cast({m} as varchar))"
    return out


_IDENT = "lower(regexp_replace({0}, '[^A-Za-z0-9]', '_', 'g'))"
_TREE = f"""rs as (select {_IDENT.format('r_name')} as r, r_regionkey from region),
ns as (select {_IDENT.format('n_name')} as n, n_nationkey as k, r, 'geo/' || r || '/' || {_IDENT.format('n_name')} || '.py' as path from nation join rs on n_regionkey = r_regionkey),
zs as (select r, 'geo/zone_' || r || '.py' as path from rs)"""
_SUMMARY = f"""with {_TREE}, fs as (select path, 'Visits ' || n || '.' as said from ns union all select path, 'Zone of ' || r || '.' from zs),
ls as (select '- [' || replace(path, '.py', '') || '](llms-full.txt#' || trim(regexp_replace(path, '[^a-z0-9]+', '-', 'g'), '-') || '): ' || said as line, row_number() over (order by string_split(path, '/')) as i from fs),
xs as (select line, i + 4 as i from ls union all select * from (values ('# tree', 1), ('', 2), ('## Modules', 3), ('', 4)) union all select '', count(*) + 5 from ls)
select cast(i as integer) as line_no, line from xs"""

SQL: dict[str, str] = {
    "tree_scan": f"""with {_TREE}, fs as (select path, {_text(NATION, 'n', 'k', 'r')} as t from ns union all select path, {_text(REGION, 'r')} from zs)
select path, 'python' as language, '.py' as ext, length(t) as n_chars, sha256(t) as content_hash from fs""",
    "tree_modules": f"""with {_TREE} select path, 'Visits ' || n || '. It lies in zone_' || r || '.' as docstring, 'visit_' || n as functions, 'Guide_' || n as classes, 'Guide_' || n || '.lead' as methods, 'KEY _HIDDEN' as constants, 'HOME_' || r || ' TOKEN' as env, '. geo.zone_' || r || ' os' as imports from ns
union all select path, 'Zone of ' || r || '.', 'add_' || r || ' all_' || r, '', '', 'ZONE router', '', 'fastapi' from zs""",
    "tree_private": f"""with {_TREE} select path, '' as owner, 'visit_' || n as name, false as is_async, false as is_private from ns union all select path, '', '_secret', false, true from ns
union all select path, 'Guide_' || n, 'lead', true, false from ns union all select path, 'Guide_' || n, '_rest', false, true from ns
union all select path, '', 'all_' || r, false, false from zs union all select path, '', 'add_' || r, true, false from zs""",
    "tree_routes": f"with {_TREE} select path, 'GET' as method, '/' || r || '/all' as route_path, 'all_' || r as handler, 'Lists the zone.' as docstring from zs union all select path, 'POST', '/' || r, 'add_' || r, '' from zs",
    "tree_dependencies": f"with {_TREE} select path, '`' || path || '` imports: `geo/zone_' || r || '.py`' as line from ns union all select path, '`' || path || '` imports: (none — leaf node)' from zs",
    "tree_references": f"""with {_TREE}, ts as (select path, n as stem, 'visits ' || n || '. it lies in zone_' || r || '. visit_' || n || ' spends days there. twice. guide_' || n || ' leads through ' || n || '. lead leads a group. key _hidden' as t from ns
 union all select path, 'zone_' || r, 'zone of ' || r || '. all_' || r || ' lists the zone. add_' || r || '  router zone' from zs)
select a.path, (select count(*) from ts b where b.path <> a.path and contains(b.t, a.stem)) as n from ts a""",
    "tree_environment": f"with {_TREE}, e as (select 'HOME_' || r as var, path from ns union all select 'TOKEN', path from ns) select var, count(*) as n, string_agg(path, ', ' order by path) as files from e group by var",
    "tree_summary": _SUMMARY,
    "tree_watch": _SUMMARY,
    "tree_incremental": f"with {_TREE}, c as (select cast((select count(*) from ns) as integer) as n, cast((select count(*) from zs) as integer) as z) select 1 as run, n + z as parsed, n + z as listed from c union all select 2, 0, n + z from c union all select 3, z, n + z - 1 from c",
    "tree_settings": "select 'tree' as name, '1.0' as version, 'of zones' as description, '**/drafts/**' as exclude, 8000 as summary, 64000 as full, true as frontmatter, 8 as languages",
    "tree_changes": f"""with {_TREE}, fs as (select path from ns union all select path from zs)
select 0 as turn, path, 'write' as op from fs union all select 1, 'geo/zone_asia.py', 'write' union all select 1, 'geo/zone_new.py', 'write' union all select 1, path, 'delete' from ns where k = (select min(k) from ns)""",
    "tree_diff": f"with {_TREE} select path from zs",
    "cache_json": "select distinct repo, path, run_id, module.name as name, module.docstring as docstring, cast(len(module.functions) as integer) as functions, cast(len(module.classes) as integer) as classes, cast(len(module.constants) as integer) as constants, cast(len(map_keys(module.env_vars)) as integer) as env from module_cache where module is not null",
    "cache_versions": "select path, count(*) as entries from module_cache group by path",
}
