"""SQL of the document queries: details, full documents, validation, budgets, stages."""

from __future__ import annotations

from tesserine.plans.oracle import _ANCHOR, _CUT_CLS, _CUT_FN, _DOC_LINES, _EDGES, _FALLBACK, _KEY, _REF, _SLUG, _STRIP, CM, LINES, _counts, _first, _signature

SQL: dict[str, str] = {}
_SPLIT = r"'\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e]'"
_RAW = r"regexp_replace(regexp_replace({0}, '^/\*\*?', ''), '\*/$', '')".format(_STRIP.format("coalesce(docstring, '')"))
_BARE = _STRIP.format(rf"regexp_replace({_STRIP.format('s')}, '^(?:///|//!|//|#|\*+)', '')")
_JOINED = f"array_to_string(list_transform(regexp_split_to_array({_RAW}, {_SPLIT}), lambda s: {_BARE}), chr(10))"
SQL["scalar_clean_comment"] = f"select distinct file_id, {_STRIP.format(_JOINED)} as doc from modules"


def _some(items: str, title: str, one: str) -> str:
    """Lines of a section that stands only where there are items."""
    return f"case when len({items}) > 0 then list_concat(['### {title}', ''], {one}) else [] end"


def _all(*parts: str) -> str:
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def _doc(x: str) -> str:
    return f"case when {x} <> '' then ['', {x}] else [] end"


_DECORATED = "case when len(f.decorators) > 0 then ['_Decorators: ' || array_to_string(list_transform(f.decorators, lambda d: '@' || regexp_replace(d, '^@', '')), ', ') || '_'] else [] end"
_FN_LINES = _all(f"['#### `' || {_signature('f')} || '`']", _DECORATED, _doc("f.docstring"), "['']")
_METHOD_LINES = _all(f"['###### `' || {_signature('f')} || '`']", _doc("f.docstring"), "['']")
_CLASS_LINES = _all(
    "['#### `' || c.name || (case when len(c.bases) > 0 then '(' || array_to_string(c.bases, ', ') || ')' else '' end) || '`']",
    _doc("c.docstring"),
    f"case when len(c.methods) > 0 then list_concat(['', '##### Methods', ''], flatten(list_transform(c.methods, lambda f: {_METHOD_LINES}))) else [] end",
    "['']",
)
_SHORT = _STRIP.format(f"regexp_replace(k.value, {_SPLIT}, ' ', 'g')")
_CONSTANT = f"'- `' || k.name || '`' || (case when k.type_hint <> '' then ': `' || k.type_hint || '`' when starts_with(k.value, 'z.') or contains(k.value, '.partial(') then ': `' || (case when length({_SHORT}) > 120 then {_SHORT}[1:117] || '...' else {_SHORT} end) || '`' else '' end)"
_ROUTE = "'- `' || r.method || ' ' || r.path || '`' || (case when r.handler not in ('', 'default') then ' → `' || r.handler || '`' else '' end) || (case when r.docstring <> '' then ' — ' || r.docstring else '' end)"


def _details(docstring: str = "docstring") -> str:
    """Lines of a module's section."""
    return _all(
        f"['## ' || path, '<a id=\"' || {_SLUG.format('path')} || '\"></a>', '']",
        f"case when {docstring} <> '' then [{docstring}, ''] else [] end",
        _some("functions", "Functions", f"flatten(list_transform(functions, lambda f: {_FN_LINES}))"),
        _some("classes", "Classes", f"flatten(list_transform(classes, lambda c: {_CLASS_LINES}))"),
        _some("constants", "Constants", f"list_concat(list_transform(constants, lambda k: {_CONSTANT}), [''])"),
        _some("routes", "Routes", f"list_concat(list_transform(routes, lambda r: {_ROUTE}), [''])"),
    )


SQL["module_details"] = f"with {CM} select repo, path, array_to_string({_details()}, chr(10)) as text from cm"
_FAR = "4611686018427387904"
SQL["full_document"] = f"""with {_EDGES},
det as (select repo, module_ord, {_details()} as xs from cm),
ev as (select distinct repo, path, unnest(map_keys(env_vars)) as var from cm),
er as (select repo, var, '| `' || var || '` | ' || string_agg('`' || path || '`', ', ' order by path) || ' |' as line, dense_rank() over (partition by repo order by var) as n from ev group by repo, var),
tg as (select repo, src as path, string_agg('`' || dst || '`', ', ' order by dst) as targets from edges group by repo, src),
rp as (select distinct repo from cm), re as (select distinct repo from ev),
hd as (select repo, ['# ' || repo, ''] as xs from rp), eh as (select repo, ['## Environment Variables', '', '| Variable | Files |', '|---|---|'] as xs from re), dh as (select repo, ['## Dependency Graph', ''] as xs from rp)
select repo, 0 as section_ord, cast(0 as bigint) as module_ord, cast(i - 1 as integer) as line_ord, xs[i] as line from hd, unnest(generate_series(1, len(xs))) as t(i)
union all select repo, 1, 0, cast(i - 1 as integer), xs[i] from eh, unnest(generate_series(1, len(xs))) as t(i)
union all select repo, 1, n, 0, line from er
union all select repo, 1, {_FAR}, 0, '' from re
union all select repo, 2, -1, cast(i - 1 as integer), xs[i] from dh, unnest(generate_series(1, len(xs))) as t(i)
union all select cm.repo, 2, cm.module_ord, 0, '`' || cm.path || '` imports: ' || coalesce(targets, '(none — leaf node)') from cm left join tg on tg.repo = cm.repo and tg.path = cm.path
union all select repo, 2, {_FAR}, 0, '' from rp
union all select repo, 3, module_ord, cast(i - 1 as integer), xs[i] from det, unnest(generate_series(1, len(xs))) as t(i)"""

_LINKS = rf"lk as (select doc, line_no, a[i] as label, b[i] as url from (select doc, line_no, regexp_extract_all(line, '\[(.*?)\]\((.*?)\)', 1) as a, regexp_extract_all(line, '\[(.*?)\]\((.*?)\)', 2) as b from dl where starts_with({_STRIP.format('line')}, '- ')), unnest(generate_series(1, len(a))) as t(i))"
_AGAIN = f"an as (select doc, line_no, i as n, xs[i] as anchor from (select doc, line_no, regexp_extract_all(line, '{_ANCHOR}', 1) as xs from dl), unnest(generate_series(1, len(xs))) as t(i)), nu as (select *, row_number() over (partition by doc, anchor order by line_no, n) as k, first_value(line_no) over (partition by doc, anchor order by line_no, n) as first_line from an)"
SQL["validate_rules"] = f"""with {_DOC_LINES}, nb as (select *, row_number() over (partition by doc order by line_no) as ord from dl), {_LINKS}, {_AGAIN}
select cast(doc_id as varchar) as doc, 0 as line_no, 'empty' as rule, 'document is empty' as message from documents where cast(doc_id as varchar) not in (select doc from dl)
union all select doc, line_no, 'heading', 'L' || line_no || ': missing top-level H1 heading (e.g. ''# Project'')' from nb where ord = 1 and not starts_with(line, '# ')
union all select doc, line_no, 'quote', 'L' || line_no || ': blockquote must immediately follow H1 heading' from (select doc, line_no, ord, row_number() over (partition by doc order by ord) as q from nb where starts_with({_STRIP.format('line')}, '> ')) where q = 1 and ord <> 2
union all select doc, 0, 'section', 'no ''##'' section found' from dl group by doc having not bool_or(starts_with(line, '## '))
union all select doc, line_no, 'label', 'L' || line_no || ': empty link label' from lk where {_STRIP.format('label')} = ''
union all select doc, line_no, 'url', 'L' || line_no || ': empty link URL' from lk where {_STRIP.format('url')} = ''
union all select doc, line_no, 'anchor', 'L' || line_no || ': duplicate anchor ''' || anchor || ''' (previously seen on L' || first_line || ')' from nu where k > 1"""


def _budget_cut(tokens: int) -> str:
    """Lines that stay in the summaries within a budget."""
    room = 4 * tokens + 3
    text = _REF.format(d=_first("docstring"), fd="f.docstring", cd="c.docstring", k="[struct_pack(name := '')]").replace("list_transform([struct_pack(name := '')], lambda c: c.name)", "[]")
    return f"""{LINES}, {_counts(text, f"(select repo, path, docstring, {_CUT_FN} as functions, {_CUT_CLS} as classes from cm)")},
head as (select repo, length('# ' || repo || chr(10) || chr(10) || '## Modules' || chr(10) || chr(10)) as h from cm group by repo),
tot as (select l.repo, sum(length(line) + 1) + any_value(h) <= {room} as fits, {room} - any_value(h) as room from lines l join head using (repo) group by l.repo),
ranked as (select l.*, c.n as refs, t.fits, t.room, sum(length(line) + 1) over (partition by l.repo order by c.n desc, l.module_ord desc, l.path desc rows between unbounded preceding and current row) as chars from lines l join counts c on c.repo = l.repo and c.path = l.path join tot t on t.repo = l.repo),
kept as (select repo, module_ord, path, line, case when fits then 0 else refs end as refs from ranked where fits or chars <= room)"""


SQL["summary_documents"] = f"""with {_budget_cut(8000)}, body as (select repo, string_agg(line || chr(10), '' order by refs, module_ord, path) as text from kept group by repo)
select r.repo, '# ' || r.repo || chr(10) || chr(10) || '## Modules' || chr(10) || chr(10) || coalesce(body.text, '') as text from (select distinct repo from cm) r left join body on body.repo = r.repo"""


def _stage_lines(name: str, constants: str, test: str, cut: bool) -> str:
    """Characters of the summaries of modules at a stage."""
    d = (lambda x: _first(x)) if cut else (lambda x: x)
    fns = f"list_transform(list_filter(functions, lambda f: {test}), lambda f: struct_pack(name := f.name, docstring := {d('f.docstring')}))"
    cls = f"list_transform(classes, lambda c: struct_pack(name := c.name, docstring := {d('c.docstring')}))"
    return f"""{name}_m as (select repo, path, {d('docstring')} as docstring, {fns} as functions, {cls} as classes, {constants} as constants, routes from cm),
{name}_d as (select repo, path, {_first('docstring')} as own, {_FALLBACK} as other from {name}_m),
{name} as (select repo, sum(length(rtrim('- [' || {_KEY.format('path')} || '](llms-full.txt#' || {_SLUG.format('path')} || '): ' || (case when own <> '' then own else {_first('other')} end))) + 1) + length('# ' || repo) + 2 + 12 as chars from {name}_d group by repo)"""


SQL["prune_stages"] = f"""with {CM}, {_stage_lines('s0', 'constants', 'true', False)}, {_stage_lines('s1', 'constants', 'true', True)}, {_stage_lines('s2', 'list_slice(constants, 1, 0)', 'true', True)}, {_stage_lines('s3', 'list_slice(constants, 1, 0)', 'not f.is_private', True)}
select s0.repo, cast(case when s0.chars <= 6003 then 0 when s1.chars <= 6003 then 1 when s2.chars <= 6003 then 2 when s3.chars <= 6003 then 3 else 4 end as integer) as stage
from s0 join s1 using (repo) join s2 using (repo) join s3 using (repo)"""


def _stage_sections(name: str, constants: str, test: str, cut: bool) -> str:
    """Sections of the modules at a stage."""
    d = (lambda x: _first(x)) if cut else (lambda x: x)
    fn = f"lambda f: struct_pack(name := f.name, parameters := f.parameters, return_type := f.return_type, docstring := {d('f.docstring')}, is_async := f.is_async, decorators := f.decorators)"
    fns = lambda items: f"list_transform(list_filter({items}, lambda f: {test}), {fn})"
    cls = f"list_transform(classes, lambda c: struct_pack(name := c.name, docstring := {d('c.docstring')}, bases := c.bases, methods := {fns('c.methods')}))"
    return f"""{name}_m as (select repo, path, module_ord, {d('docstring')} as docstring, {fns('functions')} as functions, {cls} as classes, {constants} as constants, routes from cm),
{name} as (select repo, path, length(array_to_string({_details()}, chr(10))) + 1 as size from {name}_m)"""


def _cut_text() -> str:
    return _REF.format(d=_first("docstring"), fd="f.docstring", cd="c.docstring", k="[struct_pack(name := '')]").replace("list_transform([struct_pack(name := '')], lambda c: c.name)", "[]")


# The whole document is measured for every number k of modules that went, aliases resolved anew among those that stay.
SQL["full_document_pruned"] = f"""with {_EDGES}, {_counts(_cut_text(), f"(select repo, path, docstring, {_CUT_FN} as functions, {_CUT_CLS} as classes from cm)")},
{_stage_sections('p0', 'constants', 'true', False)}, {_stage_sections('p1', 'constants', 'true', True)}, {_stage_sections('p2', 'list_slice(constants, 1, 0)', 'true', True)}, {_stage_sections('p3', 'list_slice(constants, 1, 0)', 'not f.is_private', True)},
ev as (select distinct repo, path, unnest(map_keys(env_vars)) as var from cm),
er as (select repo, length(var) + 8 + sum(length(path) + 4) as chars from ev group by repo, var),
envs as (select repo, sum(chars) + 25 + 1 + 21 + 10 + 1 as chars from er group by repo),
ds as (select repo, src, sum(length(dst) + 4) - 2 as n from edges group by repo, src),
deps as (select cm.repo, sum(length(cm.path) + 12 + coalesce(n, 18) + 1) + 20 + 1 + 1 as chars from cm left join ds on ds.repo = cm.repo and ds.src = cm.path group by cm.repo),
base as (select d.repo, length(d.repo) + 3 + 1 + d.chars + coalesce(e.chars, 0) - 1 as chars from deps d left join envs e using (repo)),
t0 as (select repo, sum(size) as n from p0 group by repo), t1 as (select repo, sum(size) as n from p1 group by repo), t2 as (select repo, sum(size) as n from p2 group by repo), t3 as (select repo, sum(size) as n from p3 group by repo),
stages as (select b.repo, case when b.chars + t0.n <= 4003 then 0 when b.chars + t1.n <= 4003 then 1 when b.chars + t2.n <= 4003 then 2 when b.chars + t3.n <= 4003 then 3 else 4 end as stage from base b join t0 using (repo) join t1 using (repo) join t2 using (repo) join t3 using (repo)),
pos as (select c.repo, c.path, c.n as refs, p3.size, row_number() over (partition by c.repo order by c.n, c.module_ord, c.path) - 1 as p from counts c join stages s on s.repo = c.repo and s.stage = 4 join p3 on p3.repo = c.repo and p3.path = c.path),
ks as (select repo, p as k from pos),
kept as (select ks.repo, ks.k, pos.path, pos.p, pos.size from ks join pos on pos.repo = ks.repo and pos.p >= ks.k),
kal as (select repo, k, alias, path as target from (select q.repo, q.k, c.alias, c.path, row_number() over (partition by q.repo, q.k, c.alias order by c.rank, q.p, c.n, c.path) as o from kept q join cand c on c.repo = q.repo and c.path = q.path) where o = 1),
ked as (select distinct q.repo, q.k, q.path as src, coalesce(a.target, b.target) as dst from kept q join rel r on r.repo = q.repo and r.src = q.path left join kal a on a.repo = q.repo and a.k = q.k and a.alias = r.imp left join kal b on b.repo = q.repo and b.k = q.k and b.alias = r.relative where coalesce(a.target, b.target) is not null and coalesce(a.target, b.target) <> q.path),
kds as (select repo, k, src, sum(length(dst) + 4) - 2 as n from ked group by repo, k, src),
kdep as (select q.repo, q.k, sum(length(q.path) + 12 + coalesce(n, 18) + 1 + q.size) + 20 + 1 + 1 as chars from kept q left join kds on kds.repo = q.repo and kds.k = q.k and kds.src = q.path group by q.repo, q.k),
kev as (select q.repo, q.k, e.var, length(e.var) + 8 + sum(length(q.path) + 4) as chars from kept q join ev e on e.repo = q.repo and e.path = q.path group by q.repo, q.k, e.var),
kenv as (select repo, k, sum(chars) + 25 + 1 + 21 + 10 + 1 as chars from kev group by repo, k),
fits as (select d.repo, min(d.k) as k from kdep d left join kenv e on e.repo = d.repo and e.k = d.k where length(d.repo) + 3 + 1 + d.chars + coalesce(e.chars, 0) - 1 <= 4003 group by d.repo)
select cm.repo, cm.path, cast(stage as integer) as stage, cast(0 as bigint) as refs from cm join stages using (repo) where stage < 4
union all select pos.repo, pos.path, 4, pos.refs from pos join fits f on f.repo = pos.repo and pos.p >= f.k"""
