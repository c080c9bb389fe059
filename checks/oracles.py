"""The same answers in plain SQL for DuckDB, by construction and without a parser."""

from __future__ import annotations

import re

from checks import fixtures as fx
from checks.fixtures import sql_text
from sourcemine import fixed_values as fixed


def _format(pattern: str, **columns: str) -> str:
    """SQL for a fixed format with columns in its fields."""
    parts = []
    for literal, name in re.findall(r"([^{}]+)|\{(\w+)\}", pattern):
        parts.append(columns[name] if name else sql_text(literal))
    return f"concat({', '.join(parts)})"


def _union(rows: list[str]) -> str:
    return "\nunion all\n".join(rows)


def _ctes() -> str:
    units, methods = [], []
    size = len(fx.VARIANTS)
    for number, variant in enumerate(fx.VARIANTS):
        where = f"from part where p_partkey % {size} = {number}"
        for unit in variant.units:
            units.append(
                f"select {fx.PATH} as path, '{unit.kind}' as kind, {sql_text(unit.name)} as name, "
                f"{unit.line} as line, {sql_text(unit.code)} as code {where}"
            )
            for pos, (method, line, code) in enumerate(unit.methods):
                methods.append(
                    f"select {fx.PATH} as path, {sql_text(unit.name)} as class_name, "
                    f"{unit.line} as class_line, {sql_text(unit.code)} as class_code, "
                    f"{pos} as pos, '{method}' as method, {line} as line, "
                    f"{sql_text(code)} as code {where}"
                )
    return f"""
raw_units as ({_union(units)}),
raw_methods as ({_union(methods)}),
last_units as (
  select * from raw_units
  qualify row_number() over (partition by path, kind, name order by line desc) = 1
),
fn_candidates as (
  select name, path, line, code, code as target from last_units where kind = 'function'
  qualify row_number() over (partition by name order by path desc, line desc) = 1
),
live_methods as (
  select m.*, concat(m.class_name, '.', m.method) as name,
    {_format(fixed.METHOD_TARGET_FORMAT, class_code='m.class_code', method='m.method', code='m.code')} as target
  from raw_methods m join last_units u
    on u.kind = 'class' and u.path = m.path and u.name = m.class_name and u.line = m.class_line
),
method_candidates as (
  select * from live_methods
  qualify row_number() over (partition by name order by path desc, line desc) = 1
),
candidates as (
  select name, 'function' as kind, path, line, code, target from fn_candidates
  union all
  select name, 'method' as kind, path, line, code, target from method_candidates
),
catalogue as (
  select {fx.CATALOGUE['prompt_id']} as prompt_id, cast({fx.CATALOGUE['temperature']} as double) as temperature,
    {fx.CATALOGUE['description']} as description, {fx.CATALOGUE['template']} as template
  from benchmark
),
docs_pair as (
  select {_banner('text', 0)} as docs from benchmark where item_id = 0
),
docs_two as (
  select concat(docs, chr(10), chr(10), (select {_banner('text', 1)} from benchmark where item_id = 1)) as docs
  from docs_pair
),
prompts as (
  select name, kind, replace(replace(template, '{{{{CODE}}}}', target), '{{{{DOCS}}}}', docs) as prompt
  from candidates, (select template from catalogue where prompt_id = 'item_1'), docs_two
)"""


def _banner(body: str, key: int) -> str:
    title, intro = sql_text(fixed.DOC_TITLES[key]), sql_text(fixed.DOC_INTRO)
    return _format(fixed.BANNER_FORMAT, title=title, intro=intro, body=body)


def _listing() -> str:
    return _union(
        [f"select {sql_text(path)} as path from part where {condition}" for condition, path in fx.LISTING]
    )


_ROOTS = """roots as (
  select distinct left(path, length(path) - 11) as dir from listing c
  where ends_with(path, '/pyvenv.cfg') and exists (
    select 1 from listing b where b.path in (
      concat(left(c.path, length(c.path) - 11), '/bin/python'),
      concat(left(c.path, length(c.path) - 11), '/Scripts/python.exe')))
)"""

_COUNTS = """measured as (
  select p_partkey, p_size as n, p_partkey % 4 as v,
    case p_partkey % 4 when 0 then 5 * p_size when 2 then 2 * p_size else 0 end as n_operators,
    case p_partkey % 4 when 0 then 10 * p_size when 2 then 4 * p_size else 0 end as n_operands,
    case p_partkey % 4 when 0 then 5 when 2 then 2 else 0 end as u_operators,
    case p_partkey % 4 when 0 then 3 + 3 * p_size when 2 then 3 + p_size else 0 end as u_operands,
    case p_partkey % 4 when 0 then 1 + 2 * p_size when 2 then 2 else 1 end as complexity,
    case p_partkey % 4 when 0 then 2 + 2 * p_size when 1 then 2 when 2 then 5 + p_size else 3 end as sloc,
    case p_partkey % 4 when 0 then 100.0 / (2 + 2 * p_size) when 2 then 200.0 / (5 + p_size) else 0.0 end as comment_pct,
    concat('/m/', cast(p_partkey as string), '.py') as path,
    concat(case p_partkey % 4 when 0 then 'g_' when 1 then 'h_' when 2 then 'D_' else 'E_' end,
      cast(p_partkey as string)) as name
  from part
),
scored as (
  select *, {score} as mi from (
    select *, case when u_operators + u_operands > 0
      then (n_operators + n_operands) * log2(u_operators + u_operands) else 0.0 end as volume
    from measured)
)"""


def _score(volume: str, complexity: str, lines: str, pct: str) -> str:
    raw = (
        f"171.0::double - 5.2::double * ln(nullif({volume}, 0)) - 0.23::double * {complexity} "
        f"- 16.2::double * ln(nullif({lines}, 0)) + 50.0::double * sin(sqrt(2.46::double * radians({pct})))"
    )
    return (
        f"case when {volume} <= 0 or {lines} <= 0 then 100.0::double "
        f"else least(100.0::double, greatest(0.0::double, ({raw}) * 100.0::double / 171.0::double)) end"
    )


def oracle_sql() -> dict[str, str]:
    base = "with " + _ctes() + "\n"
    listing = f"with listing as ({_listing()}), {_ROOTS}\n"
    scored = "with " + _COUNTS.replace(
        "{score}", _score("volume", "complexity", "sloc", "comment_pct")
    ) + "\n"
    variants = len(fx.VARIANTS)
    counts_per_file = fx.pick(
        "p_partkey",
        [str(len({u.name for u in v.units if u.kind == "function"})) for v in fx.VARIANTS],
    )
    classes_per_file = fx.pick(
        "p_partkey",
        [str(len({u.name for u in v.units if u.kind == "class"})) for v in fx.VARIANTS],
    )
    bare = fx.BARE_URL
    url_path = f"regexp_replace({bare}, '^[a-zA-Z]+://[^/]*', '')"
    plain_stem = (
        f"regexp_replace(regexp_extract({url_path}, '([^/]*)/*$', 1), '(.)[.][^.]+$', '\\1')"
    )
    git = "concat('git@host:team/repo-', cast(page_id as string), '.git')"
    answers = f"(select *, {fx.ANSWER} as response, {fx.ANSWER_BLOCK} as block, {fx.ANSWER_NAME} as name from conversations)"
    answer_run = _format(
        fixed.RUN_LABEL_FORMAT, source="role", model="'m.x.1'", time="'01-02-24_03-04-05pm'"
    )
    order_run = _format(
        fixed.RUN_LABEL_FORMAT,
        source="o_orderpriority",
        model="concat('gem.', o_orderstatus, '.1')",
        time="lower(strftime(o_orderdate + to_seconds(o_orderkey * 37), '%m-%d-%y_%I-%M-%S%p'))",
    )
    entry = _format(
        fixed.FAILURE_ENTRY_FORMAT, ts="'2024-01-02 15:04:05'", context="'Generation'", message="error_msg"
    )
    digest = "sha256(prompt)"
    offline = (
        f"case when left({digest}, 1) = '2' then '' "
        f"when left({digest}, 1) = '3' then concat('I cannot help with ', {digest}, '.') "
        f"when left({digest}, 1) in ('0', '1') then null "
        f"else concat('Here it is:', chr(10), {fx.FENCE}, 'python', chr(10), chr(10), '# ', {digest}, chr(10), {fx.FENCE}, chr(10), 'Done.') end"
    )
    return {
        "src_scan": f"""
select path, regexp_extract(path, '[^/]*$') as name, regexp_replace(path, '/[^/]*$', '') as dir
from (select {fx.SCAN_PATH} as path from part) where ends_with(path, '.py')""",
        "src_decode": f"""
select path, case when p_partkey % 11 = 0 then 0 else 1 end as valid,
  case when p_partkey % 11 = 0 then '' else replace({fx.CONTENT}, concat(chr(13), chr(10)), chr(10)) end as content
from (select *, {fx.PATH} as path from part)""",
        "venv_roots": listing + "select dir from roots",
        "venv_prune": listing
        + """select path from listing l where ends_with(path, '.py')
  and not exists (select 1 from roots r where starts_with(l.path, concat(r.dir, '/')))""",
        "tree_candidates": listing
        + f"""select {fx.TREE_NAME} as name, path, 1 as line,
  concat('def ', {fx.TREE_NAME}, '():', chr(10), '    return 1') as code
from listing l where ends_with(path, '.py') and not ({fx.TREE_BROKEN})
  and not exists (select 1 from roots r where starts_with(l.path, concat(r.dir, '/')))""",
        "fn_units": base + "select path, name, line, code from raw_units where kind = 'function'",
        "method_units": base
        + "select path, class_name, class_line, concat(class_name, '.', method) as name, line, code from raw_methods",
        "sql_units": base
        + """select path, 'function' as kind, cast(null as varchar) as class_name, name, line, code
from raw_units where kind = 'function'
union all
select path, 'method', class_name, concat(class_name, '.', method), line, code from raw_methods""",
        "class_methods": base
        + "select path, class_name, class_line, pos, method, line from raw_methods",
        "parse_errors": f"select {fx.PATH} as path, 'SyntaxError' as error_type from part where p_partkey % {variants} = 5",
        "units_per_file": f"""
select {fx.PATH} as path, {counts_per_file} as n_functions, {classes_per_file} as n_classes
from part where p_partkey % {variants} <> 5""",
        "discovery_summary": base
        + f"""select (select count(*) from part) as files_scanned,
  (select count(*) from part where p_partkey % {variants} = 5) as files_failed,
  (select count(*) from fn_candidates) as functions_found,
  (select count(*) from method_candidates) as methods_found,
  (select count(*) from candidates) as candidates""",
        "fn_last_in_file": base + "select path, kind, name, line, code from last_units",
        "candidate_dedup": base + "select name, path, line, code from fn_candidates",
        "smell_candidates": scored
        + """, hard as (
  select concat('s_', cast(p_partkey % 97 as string)) as name, 'function' as kind, path, 1 as line
  from scored where v in (0, 1) and mi < 65.0
  union all
  select concat('S_', cast(p_partkey % 61 as string), '.', m), 'method', path, case m when 'run' then 5 else 8 + n end
  from scored, (values ('run'), ('stop')) t(m) where v = 2 and mi < 65.0
)
select name, kind, path, line from hard
qualify row_number() over (partition by name order by path desc) = 1""",
        "candidate_union": base + "select name, kind, path, line, code from candidates",
        "method_focus": base + "select path, name, line, target from live_methods",
        "mi_score": f"""
select l_orderkey, l_linenumber, round({_score('v', 'l_linenumber', 'n', 'l_discount * 100')}, 6) as mi
from (select *, l_extendedprice * (l_linenumber - 1) as v, cast(floor(l_quantity) as int) - 1 as n from lineitem)""",
        "mi_counts": scored
        + """select path, name, n_operators, n_operands, u_operators, u_operands, complexity, sloc,
  round(comment_pct, 6) as comment_pct from measured""",
        "mi_filter": scored + "select path, name, round(mi, 6) as mi from scored where v in (0, 1) and mi < 65.0",
        "mi_filter_class": scored
        + """select path, concat(name, '.', m) as name, round(mi, 6) as mi
from scored, (values ('run'), ('stop')) t(m) where v = 2 and mi < 65.0""",
        "template_lookup": base
        + """select o_orderkey, r.prompt_id, temperature, template, case when c.prompt_id is null then 0 else 1 end as found
from (select o_orderkey, concat('item_', cast(o_orderkey % 50 as string)) as prompt_id from orders) r
left join catalogue c on c.prompt_id = r.prompt_id""",
        "docs_block": f"""
select block, concat(
  coalesce(max(case when slot = 0 and not missing then {_banner(fx.CLEAN_MARKDOWN.format(text='text'), 0)} end), ''),
  chr(10), chr(10),
  coalesce(max(case when slot = 1 and not missing then {_banner(fx.CLEAN_MARKDOWN.format(text='text'), 1)} end), '')) as docs
from (select *, cast(doc_id - doc_id % 2 as string) as block, doc_id % 2 as slot, doc_id % 7 = 3 as missing
  from (select doc_id, source, regexp_replace(text, concat(chr(10), '{{3,}}'), concat(chr(10), chr(10)), 'g') as text from documents))
group by block""",
        "prompt_render": base + "select name, kind, prompt from prompts",
        "fn_candidates": base + "select name, prompt from prompts where kind = 'function'",
        "method_candidates": base + "select name, prompt from prompts where kind = 'method'",
        "md_clean": f"""
select doc_id, {fx.CLEAN_MARKDOWN.format(text="regexp_replace(text, concat(chr(10), '{3,}'), concat(chr(10), chr(10)), 'g')")} as cleaned
from documents""",
        "url_clean": f"""
select page_id, case page_id % 7 when 2 then concat({bare}, '/a.b/./c.tar.gz/') when 4 then concat('://', {git})
  when 6 then concat({bare}, '/x[1].') else {bare} end as clean_url from pages""",
        "url_stem": f"""
select page_id, case page_id % 7 when 2 then 'c.tar' when 4 then concat('repo-', cast(page_id as string))
  when 6 then 'x[1].' else {plain_stem} end as stem from pages""",
        "kv_map": """
select page_id, left(o, strpos(o, '=') - 1) as key, arg_max(substr(o, strpos(o, '=') + 1), i) as value
from (select page_id, unnest(opts) as o, generate_subscripts(opts, 1) as i from (
  select page_id, list_concat(string_split(regexp_replace(url, '^[^?]*[?]?', ''), '&'),
    ['bad', concat('k=', cast(page_id as string)), '=e', 'x=y=z', 'k=', 'page=last']) as opts from pages))
where strpos(o, '=') > 0 group by 1, 2""",
        "run_id": f"select o_orderkey, {order_run} as run_id from orders",
        "code_blocks": f"select conv_id, turn, block from {answers}",
        "first_choice": """
select conv_id, turn, case (conv_id + turn) % 4 when 2 then text when 3 then role end as response from conversations""",
        "completions": base
        + f"""select name, {offline} as response,
  case when left({digest}, 1) = '0' then 'ConnectionError: no route to the model' end as error from prompts""",
        "harness_rows": f"""
select {answer_run} as run_id, name, {_format(fixed.HARNESS_FILE_FORMAT, name='name')} as file_name, block as code
from {answers} where block <> ''""",
        "failure_rows": f"""
select run_id, 'Generation' as context, name, error_msg,
  {entry} as entry
from (select {answer_run} as run_id, name, case when coalesce(response, '') = ''
    then {_format(fixed.MESSAGE_EMPTY, name='name')}
    else {_format(fixed.MESSAGE_NO_BLOCK, name='name')} end as error_msg
  from {answers} where block = '')""",
        "harness_run_outcomes": base
        + f"""select name, case when left({digest}, 1) in ('0', '1', '2') then 'empty'
  when left({digest}, 1) = '3' then 'no block' else 'saved' end as outcome,
  case when left({digest}, 1) in ('0', '1', '2', '3') then '' else concat('# ', {digest}, chr(10)) end as code from prompts""",
        "harness_rerun_outcomes": base
        + f"""select {_format(fixed.RUN_LABEL_FORMAT, source="'repo'", model="'second.one'", time="'01-02-24_03-04-05pm'")} as run_id,
  name, concat('# second/one ', {digest}, chr(10)) as code from prompts""",
        "runs_table": base
        + f"""select {_format(fixed.RUN_LABEL_FORMAT, source="'repo'", model="'a.b'", time="'01-02-24_03-04-05pm'")} as run_id,
  name, concat('# a/b ', {digest}, chr(10)) as code, 0 as failed from prompts
union all
select {_format(fixed.RUN_LABEL_FORMAT, source="'repo'", model="'a.b'", time="'01-03-24_03-04-05pm'")} as run_id,
  name, case when left({digest}, 1) in ('0', '1', '2', '3') then '' else concat('# ', {digest}, chr(10)) end as code,
  case when left({digest}, 1) in ('0', '1', '2', '3') then 1 else 0 end as failed from prompts""",
        "run_totals": base
        + f"""select (select count(*) from part) as files_scanned,
  (select count(*) from part where p_partkey % {variants} = 5) as files_failed,
  (select count(*) from fn_candidates) as functions_found,
  (select count(*) from method_candidates) as methods_found,
  (select count(*) from candidates) as candidates,
  (select count(*) from prompts where left({digest}, 1) not in ('0', '1', '2', '3')) as harnesses,
  (select count(*) from prompts where left({digest}, 1) in ('0', '1', '2', '3')) as failures""",
    }
