"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

from ..functions.text import BACK_PANEL_WORDS, BLANKS, EDGE, PANEL_MARKERS
from ..operators.rules import CATALOG, CLAIMS, HEADERS, KEYWORDS, MADE_BY, MRP, NET_LABELLED, ORIGIN, FSSAI, Rule
from .samples import CALLS_SQL, IMAGE_NAME, LABEL_LINES_SQL, ORDER_CODES_SQL, TRUTH_SQL

WS = r"[\x20\x09-\x0D]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace({strip(f'lower({x})')}, '{WS}+', ' ', 'g'), {q(EDGE)})"


def only_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def digits(x: str) -> str:
    s = strip(x)
    wide = f"try_cast({s} as decimal(38,10))"
    number = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
    return f"case when regexp_matches({s}, {number}) and {wide} = trunc({wide}) then cast(cast({wide} as decimal(38,0)) as string) else {only_digits(s)} end"


def any_of(x: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower({x}), {q(w)})" for w in words) + ")"


def title(x: str) -> str:
    return rf"array_to_string(list_transform(string_split({x}, ''), lambda c, i: case when i = 1 or not regexp_matches(string_split({x}, '')[i - 1], '\p{{L}}') then upper(c) else lower(c) end), '')"


def entity(x: str) -> str:
    return strip(f"trim(regexp_replace({x}, '([,;|]|{WS}{{3,}}|[0-9]{{5,}})(?s:.*)$', ''), ' .,:;-–')")


def checksum(x: str) -> str:
    full = f"(case when regexp_matches({x}, '^[0-9]{{12}}$') then '0' || {x} when regexp_matches({x}, '^[0-9]{{13}}$') then {x} end)"
    total = " + ".join(f"cast(substr({full}, {k + 1}, 1) as int) * {1 if k % 2 == 0 else 3}" for k in range(13))
    return f"coalesce(({total}) % 10 = 0, false)"


def recovered(x: str) -> str:
    tries = " ".join(f"when {checksum(f'({d!r} || {x})')} then '{d}' || {x}" for d in map(str, range(10)))
    return f"(case when regexp_matches({x}, '^[0-9]{{12}}$') then (case {tries} end) end)"


def line_runs(x: str) -> str:
    ds = rf"list_filter(list_transform(list_filter(regexp_split_to_array({x}, '\r\n|[\n\r]'), lambda s: not regexp_matches(s, '\p{{L}}')), lambda s: {only_digits('s')}), lambda d: d <> '')"
    return ds


LINE_RUNS = rf"""
ds as (select o_orderkey, i, d from (select o_orderkey, unnest({line_runs('text')}) as d, generate_subscripts({line_runs('text')}, 1) as i from codes)),
seq as (select *, lead(d, 1) over w as d1, lead(d, 2) over w as d2 from ds window w as (partition by o_orderkey order by i)),
runs as (select o_orderkey, d as r from seq where length(d) between 11 and 14
  union select o_orderkey, d || d1 from seq where length(d) < 11 and length(d1) < 11 and length(d || d1) between 11 and 14
  union select o_orderkey, d || d1 || d2 from seq where length(d) < 11 and length(d1) < 11 and length(d || d1) <= 14 and length(d2) < 11 and length(d || d1 || d2) between 11 and 14),
lists as (select codes.o_orderkey, list(r order by abs(length(r) - 13), r) filter (r is not null) as runs from codes left join runs using (o_orderkey) group by 1)
"""
CANDIDATES = "list_sort(list_transform(list_distinct(regexp_extract_all({x}, '[0-9]{{11,14}}')), lambda r: {{'n': -length(r), 'r': r}}))"


def share(code: str, text: str) -> str:
    shown = only_digits(text)
    parts = f"flatten(list_transform(range(1, length({code}) + 1), lambda i: list_transform(range(1, length({code}) - i + 2), lambda k: substr({code}, i, k))))"
    return f"(case when length({code}) > 0 and {shown} <> '' then coalesce(list_max(list_transform(list_filter({parts}, lambda p: contains({shown}, p)), lambda p: length(p))), 0) / length({code})::double else 0.0 end)"


def found(field: str, value: str, text: str) -> str:
    s, v, t = strip(value), norm(value), norm(text)
    tokens = f"list_filter(string_split({v}, ' '), lambda x: x <> '')"
    return (
        f"case when {value} is null or {s} in ('', '-', '--') then null "
        f"when {field} in ('Mrp', 'Fssai No', 'Upc / Ean') then ({digits(value)}) <> '' and contains({only_digits(text)}, {digits(value)}) "
        f"when {field} = 'Net Quantity' then {only_digits(value)} <> '' and contains({only_digits(text)}, {only_digits(value)}) "
        f"when {v} = '' then null else contains({t}, {v}) or 4 * len(list_filter({tokens}, lambda x: contains({t}, x))) >= 3 * len({tokens}) end"
    )


CHECKS = """checks as (select doc_id, text,
  case doc_id % 4 when 0 then 'Mrp' when 1 then 'Brand' when 2 then 'Net Quantity' else 'Manufacturer' end as field,
  case doc_id % 4 when 0 then cast(doc_id % 100 as string) || '.0' when 1 then substr(text, 5, 12) when 2 then cast(doc_id % 10 as string) || '.5 g' else null end as value from documents)"""
SURE = "coalesce(nullif(confidence, 0), 0.8::double)"


def rule_value(rule: Rule) -> tuple[str, str]:
    """(condition, value) of a rule for a line's text."""
    t = r"regexp_replace(text, '\s+', ' ', 'g')" if rule.squeeze else "text"
    hit = f"regexp_matches({t}, {q(rule.pattern)})"
    if rule.needs:
        hit += f" and {any_of('text', rule.needs)}"
    group = f"regexp_extract({t}, {q(rule.pattern)}, 1)"
    forms = {
        "constant": q(rule.constant),
        "group": group,
        "amount": f"{group} || ' ' || lower(regexp_extract({t}, {q(rule.pattern)}, 2))",
        "entity": entity(group),
        "country": title(entity(group)),
        "title": title(strip(group)),
        "strip": strip(group),
    }
    if rule.form in ("entity", "country"):
        hit += f" and length({forms[rule.form]}) >= 3" + (f" and length({forms[rule.form]}) <= 30" if rule.form == "country" else "")
    return hit, strip(forms[rule.form])


def field_rows() -> str:
    parts = []
    for r in CATALOG:
        hit, value = rule_value(r)
        parts.append(f"select product_key, line_no, {q(r.field)} as field, {r.step} as step, {'-height' if r.tallest else '0.0::double'} as ord, {value} as value, {r.weight}::double * {SURE} as confidence, {q(r.source)} as source from lines where {hit}")
    for name, words in KEYWORDS:
        case = "case " + " ".join(f"when contains(lower(text), {q(w)}) then {q(w.title())}" for w in words) + " end"
        parts.append(f"select product_key, line_no, {q(name)}, 1, 0.0::double, {case}, 0.4::double * {SURE}, {q('keyword:' + name.lower())} from lines where {any_of('text', words)}")
    return "hits as (" + " union all ".join(parts) + "), fields as (select product_key, field, value, round(confidence, 9) as confidence, source from hits where value <> '' qualify row_number() over (partition by product_key, field order by step, ord, line_no) = 1)"


NEW_SECTION = f"({strip('text')} = '' or " + " or ".join(f"regexp_matches({strip('text')}, {q(p)})" for p in (MRP, FSSAI, MADE_BY, ORIGIN, NET_LABELLED)) + rf" or (len(regexp_split_to_array({strip('text')}, '\s+')) <= 6 and upper({strip('text')}) = {strip('text')} and regexp_matches({strip('text')}, '\p{{L}}')))"


def block_rows() -> str:
    parts = []
    for name, p in HEADERS.items():
        s = strip("h.text")
        parts.append(
            f"select h.product_key, {q(name)} as field, h.line_no, {strip(f'regexp_extract({s}, {q(p)}, 1)')} as own, "
            "(select list(x.text order by x.line_no) from flagged x where x.product_key = h.product_key and x.line_no between h.line_no + 1 and h.line_no + 8 and x.line_no < coalesce("
            "(select min(y.line_no) from flagged y where y.product_key = h.product_key and y.line_no > h.line_no and y.stop), 1000000)) as rest "
            f"from flagged h where regexp_matches({s}, {q(p)})"
        )
    return " union all ".join(parts)


PAIRS = """pairs as (select p_partkey as product_key, p_partkey % 3 <> 0 as filled, greatest(0.0::double, 1.0::double - (p_partkey % 7) / greatest(p_size + p_partkey % 7, 1)::double) as nearness, case when (p_partkey % 2 = 0) = (p_partkey % 5 < 3) then 1.0::double else 0.0 end as veg from part where p_partkey % 4 <> 0),
  scores as (select product_key, (case when filled then nearness else 0.0 end + 1 + veg) / 3 as r, (case when filled then nearness else 0.0 end + 1 + veg) / (case when filled then 3 else 2 end) as p from pairs)"""

ORACLE_SQL = {
    "ceiling_report": f"""select source as product_key, count(*) as listed, count(distinct sha256(text)) as distinct_views, count(*) - count(distinct sha256(text)) as duplicates,
        avg(case when {any_of('text', PANEL_MARKERS)} then 1.0::double else 0.0 end) as panel_share from documents group by 1""",
    "views_total": """select cast(sum(listed) as bigint) as listed, cast(sum(d) as bigint) as distinct_views, cast(sum(listed - d) as bigint) as duplicates, count(*) as products from
        (select source, count(*) as listed, count(distinct sha256(text)) as d from documents group by 1)""",
    "norm_text": f"""select doc_id, {norm('text')} as normalised, {norm('text')} in ({', '.join(map(q, BLANKS))}) as blank, nullif({strip('text')}, '') as stripped from documents""",
    "digit_signatures": f"""with v as (select o_orderkey, case o_orderkey % 4 when 0 then cast(o_orderkey as string) || '.0' when 1 then ' ' || cast(o_orderkey as string) || '.50 ' when 2 then 'Rs ' || cast(o_orderkey as string) || '-12' else '1' || o_orderpriority end as v from orders)
        select o_orderkey, {digits('v')} as signature, regexp_extract(v, '[0-9]+') as first_number, try_cast(nullif(regexp_extract(v, '-?[0-9]+\\.?[0-9]*'), '') as double) as number, cast(trunc(try_cast({strip('v')} as double)) as bigint) as whole from v""",
    "script_counts": """with t as (select doc_id, text || case when doc_id % 3 = 0 then ' 漢字 हिन्दी ₹' else '' end as t from documents)
        select doc_id, length(regexp_replace(t, '[^一-鿿]', '', 'g')) as cjk, (select count(*) from unnest(string_split(t, '')) as u(c) where unicode(c) between 2304 and 2431) as devanagari, regexp_matches(t, '[^\\x00-\\x7F]') as non_latin from t""",
    "token_overlap": f"""with d as (select doc_id, list_distinct(list_filter(string_split({norm('text')}, ' '), lambda w: w <> '')) as a from documents), b as (select item_id, list_distinct(list_filter(string_split({norm('text')}, ' '), lambda w: w <> '')) as b from benchmark),
        p as (select doc_id, item_id, 2.0::double * count(*) / (any_value(n) + any_value(m)) as f1 from (select doc_id, len(a) as n, unnest(a) as w from d) join (select item_id, len(b) as m, unnest(b) as w from b) using (w) group by 1, 2)
        select * from p qualify row_number() over (partition by doc_id order by f1 desc, item_id) = 1""",
    "benchmark_recall": f"""with d as (select doc_id, {norm('text')} as t from documents), b as (select item_id, list_filter(string_split({norm('text')}, ' '), lambda w: w <> '') as w from benchmark)
        select doc_id, item_id from d, b where len(w) > 0 and 4 * len(list_filter(w, lambda x: contains(t, x))) >= 3 * len(w)""",
    "checksum_codes": f"""with {ORDER_CODES_SQL} select o_orderkey, code, {checksum('code')} as valid, {checksum('run')} as run_valid, regexp_matches(substr(code, 2), '^(2|02|04)') as restricted,
        case when not regexp_matches({recovered('run')}, '^(2|02|04)') then {recovered('run')} end as recovered from codes""",
    "digit_runs": f"""select doc_id, array_to_string(list_transform({CANDIDATES.format(x='text')}, lambda s: s.r), ',') as runs from documents where regexp_matches(text, '[0-9]{{11}}')""",
    "barcode_lines": f"""with {ORDER_CODES_SQL}, {LINE_RUNS} select o_orderkey, coalesce(array_to_string(runs, ','), '') as runs from lists""",
    "text_match": f"""with {ORDER_CODES_SQL} select o_orderkey, {share('code', 'text')} as share from codes""",
    "find_barcode": f"""with {ORDER_CODES_SQL}, {LINE_RUNS},
        t as (select codes.*, coalesce(runs, []) as runs, list_transform({CANDIDATES.format(x='text')}, lambda s: s.r) as others, case when o_orderkey % 7 = 0 then code end as bars from codes join lists using (o_orderkey)),
        c as (select *, case when {checksum('bars')} and (not regexp_matches(bars, '^[012]') or {share('bars', 'text')} >= 0.5) then bars end as b, list_filter(runs, lambda r: length(r) = 13 and {checksum('r')})[1] as l, list_filter(others, lambda r: length(r) = 13 and {checksum('r')})[1] as o,
          list_filter(list_transform(runs, lambda r: case when not regexp_matches({recovered('r')}, '^(2|02|04)') then {recovered('r')} end), lambda x: x is not null)[1] as rec from t)
        select o_orderkey, coalesce(b, l, o) as code, case when b is not null then 'bars' when coalesce(l, o) is not null then 'ocr_digits' else '' end as source, case when coalesce(b, l, o) is null then coalesce(rec, runs[1]) end as unverified from c""",
    "strongest_barcode": f"""with {ORDER_CODES_SQL}, r as (select o_orderkey % 200 as product_key, o_orderkey as view, case when o_orderkey % 9 = 0 then 'bars' else 'ocr_digits' end as source, case when o_orderkey % 4 <> 1 then code end as code from codes)
        select * from r where code is not null qualify row_number() over (partition by product_key order by source <> 'bars', view) = 1""",
    "barcode_funnel": f"""with {ORDER_CODES_SQL}, r as (select case when o_orderkey % 3 <> 0 then code end as code, case when o_orderkey % 6 = 1 then 'bars' else 'ocr_digits' end as source, o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 as valid,
          case when o_orderkey % 2 = 0 then code else run end as truth, case o_orderkey % 4 when 1 then 'primary' when 2 then 'secondary' end as lookup_source, case when o_orderkey % 2 = 0 then run end as unverified,
          cast(o_orderkey % 8 as double) / 8 as closeness, case when o_orderkey % 5 = 0 then cast(o_orderkey % 16 as double) / 16 end as brand_match from codes)
        select count(*) as products, count(*) filter (source = 'bars') as bars, count(*) filter (valid) as valid, count(*) filter (valid and code = truth) as exact, count(*) filter (lookup_source = 'primary') as found_primary, count(*) filter (lookup_source = 'secondary') as found_secondary,
          count(*) filter (code is null and unverified is not null) as unverified, avg(closeness) filter (code is null and unverified is not null) as closeness, count(*) filter (code is null and unverified is not null and closeness >= 0.85) as near_misses, avg(brand_match) as brand_match, count(*) filter (brand_match < 0.5) as brand_low from r""",
    "product_groups": f"""with n as (select {IMAGE_NAME} as path from part), p as (select path, regexp_extract(path, '(?i)^Image_([0-9]+)_(.+)\\.jpg$', 2) as product_key, try_cast(regexp_extract(path, '(?i)^Image_([0-9]+)_(.+)\\.jpg$', 1) as int) as view from n)
        select product_key, string_agg(path, ',' order by view, path) as images from p where product_key <> '' group by 1""",
    "images_of_rows": f"""with {TRUTH_SQL}, n as (select {IMAGE_NAME} as path from part), p as (select path, regexp_extract(path, '(?i)^Image_([0-9]+)_(.+)\\.jpg$', 2) as product_key, try_cast(regexp_extract(path, '(?i)^Image_([0-9]+)_(.+)\\.jpg$', 1) as int) as view from n),
        listed as (select row_id, 0 as position, nullif(trim("Front Filename"), '') as name from truth union all select row_id, 1, nullif(trim("Back Filename"), '') from truth),
        seeds as (select row_id, arg_min(k, position) as product_key from (select row_id, position, regexp_extract(name, '(?i)^Image_([0-9]+)_(.+)\\.jpg$', 2) as k from listed where name is not null) where k <> '' group by 1),
        f as (select row_id, path as image, cast(view as bigint) as view from seeds join p using (product_key) union all
          select row_id, name, coalesce(try_cast(regexp_extract(name, '(?i)^Image_([0-9]+)_(.+)\\.jpg$', 1) as bigint), 0) from listed where name is not null and row_id not in (select row_id from seeds))
        select * from f where image in (select path from n)""",
    "truth_first_wins": f"""with {TRUTH_SQL}, listed as (select row_id, 0::bigint as position, nullif(trim("Front Filename"), '') as name from truth union all select row_id, 1, nullif(trim("Back Filename"), '') from truth)
        select name, row_id, position from listed where name is not null qualify row_number() over (partition by name order by row_id, position) = 1""",
    "lookup_coalesce": """with a as (select p_partkey as code, p_name as name, p_brand as brand from part where p_partkey % 6 = 0), b as (select s_suppkey as code, s_name as name, cast(s_nationkey as string) as brand from supplier)
        select p_partkey as code, coalesce(a.name, b.name) as name, coalesce(a.brand, b.brand) as brand, case when a.code is not null then 'primary' when b.code is not null then 'secondary' end as lookup_source from part left join a on a.code = p_partkey left join b on b.code = p_partkey""",
    "cache_miss": f"""with {CALLS_SQL} select cast(event_id as string) as key from calls where not (engine = 'click' and user_id % 4 <> 0)""",
    "cache_stats": f"""with {CALLS_SQL} select engine, count(*) as n, round(sum(cast(cents as double)), 4) as cost_usd from calls group by 1""",
    "cache_latest": f"""with {CALLS_SQL} select key, engine, cents, event_id as seq from calls qualify row_number() over (partition by key, engine order by event_id desc) = 1""",
    "latency_summary": f"""with {CALLS_SQL} select engine as tier, count(*) as n, min(cents) as least, avg(cents) as mean, max(cents) as most, list_sort(list(cents))[cast(floor(count(*) / 2) as bigint) + 1] as median from calls group by 1""",
    "tier_share": f"""with {CALLS_SQL} select engine, count(*) as n, count(*)::double / (select count(*) from calls) as share from calls group by 1""",
    "outcome_confusion": f"""with {CALLS_SQL} select key as field, count(*) filter (event_id % 3 = 0) as correct, count(*) filter (event_id % 3 = 1) as wrong, count(*) filter (event_id % 3 = 2) as empty from calls group by 1""",
    "engine_comparison": f"""with {CALLS_SQL} select engine, count(distinct key) as products, cast(sum(event_id % 4) as bigint) as found, sum(event_id % 4)::double / sum(event_id % 4 + event_id % 2) as of_reachable, cast(sum(cents) as bigint) as chars, cast(sum(event_id % 3) as bigint) as cjk, cast(sum(event_id % 5) as bigint) as devanagari,
        sum(cents)::double / count(distinct key) as seconds_a_product, count(*) filter (event_id % 50 = 0) as errors from calls group by 1""",
    "recovery_by_setup": f"""with {CALLS_SQL} select setup, count(*) as products, cast(sum(hit) as bigint) as recovered from (select engine as setup, key, max(case when cents % 17 = 0 then 1 else 0 end) as hit from calls group by 1, 2) group by 1""",
    "escalation_reasons": """with l as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) as t, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: x <> ''), 1) - 1 as i from documents),
        c as (select doc_id, t, case when (doc_id + i) % 4 <> 3 then cast((doc_id * 3 + i) % 10 as double) / 8 end as confidence from l),
        a as (select d.doc_id, coalesce(sum(length(t)), 0)::bigint as chars, avg(confidence) as conf, count(*) filter (regexp_matches(t, '[0-9]')) as digit_lines, count(t) as n from documents d left join c using (doc_id) group by 1)
        select doc_id, chars, round(conf, 9) as confidence, digit_lines, case when n = 0 then 'no text' when chars < 40 then 'few characters' when conf < 0.65 then 'low confidence' when digit_lines = 0 then 'no digits' end as reason from a""",
    "escalation_report": """with l as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) as t, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: x <> ''), 1) - 1 as i from documents),
        c as (select doc_id, t, case when (doc_id + i) % 4 <> 3 then cast((doc_id * 3 + i) % 10 as double) / 8 end as confidence from l),
        a as (select d.doc_id, any_value(d.text) as text, coalesce(sum(length(t)), 0) as chars, avg(confidence) as conf, count(t) as n from documents d left join c using (doc_id) group by 1),
        r as (select text, n = 0 or chars < 40 or coalesce(conf < 0.65, false) as weak from a)
        select count(*) as n, count(*) filter (weak) as weak, avg(case when weak then 1.0::double else 0.0 end) as rate, avg(case when weak then 1.0::double else 0.0 end) * 20746 * 0.0015::double as projected_usd, count(*) filter (regexp_matches(text, '[^\\x00-\\x7F]')) as non_latin from r""",
    "field_checks": f"""with {CHECKS} select doc_id, field, {found('field', 'value', 'text')} as found, ({digits('value')}) <> '' and list_contains(regexp_extract_all(text, '[0-9]+'), {digits('value')}) as found_strict from checks""",
    "field_recall": f"""with {CHECKS}, f as (select field, {found('field', 'value', 'text')} as pre, {found('field', 'value', "translate(text, '15', 'lS')")} as raw from checks)
        select coalesce(field, 'OVERALL') as field, count(*) as n, count(*) filter (pre) as pre, count(*) filter (raw) as raw, count(*) filter (pre) / count(*)::double as pre_share, count(*) filter (raw) / count(*)::double as raw_share from f where pre is not null group by rollup (field)""",
    "recall_vs_ceiling": f"""with {CHECKS}, f as (select field, doc_id % 3 = 0 as panel, {found('field', 'value', 'text')} as got from checks),
        g as (select field, count(*) as in_truth, count(*) filter (case when field in ('Mrp', 'Fssai No', 'Upc / Ean', 'Manufacturer') then panel else true end) as reachable, count(*) filter (got) as got from f where got is not null group by 1)
        select *, got / in_truth::double as recall, case when reachable > 0 then got / reachable::double end as recall_of_reachable from g""",
    "extract_fields": f"with {LABEL_LINES_SQL}, {field_rows()} select * from fields",
    "extract_blocks": f"""with {LABEL_LINES_SQL}, flagged as (select product_key, line_no, {strip('text')} as text, {NEW_SECTION} as stop from lines), b as ({block_rows()}),
        p as (select product_key, field, line_no, list_concat(case when own <> '' then [own] else [] end, coalesce(rest, [])) as parts from b),
        f as (select product_key, field, nullif(trim(regexp_replace(array_to_string(parts, ' '), '\\s+', ' ', 'g'), ' .,:;-'), '') as value from p where len(parts) > 0 qualify row_number() over (partition by product_key, field order by line_no) = 1)
        select product_key, field, value, 0.5::double as confidence, 'heuristic:block:' || lower(field) as source from f where value is not null""",
    "extract_bullets": f"""with {LABEL_LINES_SQL}, c as (select product_key, {strip('text')} as text, min(line_no) as line_no from lines where len(regexp_split_to_array({strip('text')}, '\\s+')) between 2 and 10 and {any_of(strip('text'), CLAIMS)} group by 1, 2)
        select product_key, array_to_string(list(text order by line_no)[1:6], '|') as bullets from c group by 1""",
    "extract_front": f"""with {LABEL_LINES_SQL}, front as (select product_key, text, {SURE} as c, row_number() over (partition by product_key order by -height, line_no) as k from lines where length({strip('text')}) >= 3 and regexp_matches(text, '\\p{{L}}') and not {any_of('text', BACK_PANEL_WORDS)}),
        t as (select product_key, min(text) filter (k = 1) as one, string_agg(text, ' ' order by k) filter (k <= 2) as two, min(c) filter (k = 1) as c from front group by 1),
        r as (select product_key, 'Brand' as field, {strip('one')} as value, 0.4::double * c as confidence, 'layout:largest-text' as source, 1 as o from t union all select product_key, 'Product Name', {strip('two')}, 0.35::double * c, 'layout:top-lines', 1 from t
          union all select p_partkey, 'Brand', p_brand, 0.9::double, 'barcode:lookup', 0 from part where p_partkey % 5 = 0 union all select p_partkey, 'Product Name', p_name, 0.85::double, 'barcode:lookup', 0 from part where p_partkey % 5 = 0)
        select product_key, field, value, round(confidence, 9) as confidence, source from r qualify row_number() over (partition by product_key, field order by confidence desc, o) = 1""",
    "extract_description": f"""with {LABEL_LINES_SQL}, {field_rows()}, s as (select product_key, line_no, {strip('text')} as value, length(text) as n, 0.4::double * {SURE} as confidence from lines where len(regexp_split_to_array({strip('text')}, '\\s+')) >= 8 and upper(text) <> text and not {any_of('text', BACK_PANEL_WORDS)})
        select product_key, 'Product_Description' as field, value, round(confidence, 9) as confidence, 'heuristic:longest-front-sentence' as source from s where (product_key, value) not in (select (product_key, value) from fields) qualify row_number() over (partition by product_key order by -n, line_no) = 1""",
    "record_projection": f"""with v as (select p_partkey as product_key, nullif({strip("case p_partkey % 4 when 0 then cast(p_size as string) || '.7 ml' when 1 then 'many g' when 2 then cast(p_size as string) else '  ' end")}, '') as net0,
          case p_partkey % 4 when 0 then cast(p_size as string) || '.7 ml' when 1 then 'many g' when 2 then cast(p_size as string) else '  ' end as raw, case when p_partkey % 3 = 0 then p_name end as flavour, cast(p_size as string) || case when p_partkey % 2 = 0 then '%' else '' end as pack from part)
        select product_key, cast(trunc(try_cast(regexp_extract(net0, '^[^ ]+') as double)) as bigint) as net_quantity, nullif(regexp_extract(net0, ' +(.*)$', 1), '') as uom, cast(trunc(try_cast(pack as double)) as bigint) as pack_quantity, case when flavour is not null then 'Yes' end as scented, raw as capacity, 'Grocery' as category from v""",
    "keep_best": f"""with {CALLS_SQL}, r as (select key as product_key, engine as field, case when cents % 7 = 0 then ' ' else cast(cents as string) end as value, cast(cents % 10 as double) / 10 as confidence, event_id from calls)
        select product_key, field, value, confidence, 'call' as source from r where trim(value) <> '' qualify row_number() over (partition by product_key, field order by confidence desc, event_id) = 1""",
    "field_provenance": f"""with {CALLS_SQL}, r as (select event_id as product_key, event_id % 3 as f, cast(cents as string) || '   (' || printf('%.2f', cast(cents % 4 as double) / 4) || ', ' || engine || ')' as p, cast(cents % 4 as double) / 4 as c from calls)
        select product_key, case when f = 0 then p else '—' end as brand, case when f = 1 then p else '—' end as mrp, case when c >= 0.9 then 'good' when c >= 0.7 then 'medium' else 'weak' end as bucket from r""",
    "extraction_report": f"""with {CALLS_SQL}, r as (select engine as field, cast(cents % 5 as double) / 4 as f1, event_id % 3 = 0 as t, event_id % 2 = 0 as g from calls)
        select field, count(*) as n, avg(f1) as f1, avg(case when g then 0.0::double else 1.0 end) as coverage, avg(f1) filter (not (t and g)) as f1_filled, count(*) filter (t and g) as both_empty from r group by 1""",
    "label_spans": f"""with {CALLS_SQL}, w as (select user_id % 20 as product_key, event_id % 3 as view, event_id % 2 as crop, event_id as word_no, cast(cents as string) as word, case engine when 'click' then 'BRAND' when 'view' then 'MRP' when 'error' then 'O' else 'FSSAI' end as label, cast(cents % 8 as double) / 8 as confidence from calls),
        g as (select *, word_no as o, row_number() over (partition by product_key, view, crop order by word_no) - row_number() over (partition by product_key, view, crop, label order by word_no) as island from w),
        s as (select product_key, view, crop, label, island, min(o) as first, string_agg(word, ' ' order by o) as value, avg(confidence) as confidence from g where label <> 'O' group by 1, 2, 3, 4, 5)
        select product_key, case label when 'BRAND' then 'Brand' when 'MRP' then 'Mrp' else 'Fssai No' end as field, value, 0.5::double * confidence as confidence, 'token-model' as source from s qualify row_number() over (partition by product_key, label order by confidence desc, view, crop, first) = 1""",
    "weak_labels": f"""with {LABEL_LINES_SQL}, w as (select product_key, line_no * 100 + pos - 1 as word_no, word from (select product_key, line_no, unnest(regexp_split_to_array(text, ' +')) as word, generate_subscripts(regexp_split_to_array(text, ' +'), 1) as pos from lines) where word <> ''),
        k as (select product_key, word_no, word, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') as t, {digits('word')} as d from w),
        m as (select k.*, case when len(t) >= 2 and list_contains(list_transform(regexp_split_to_array(p_brand, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), t) then 'BRAND'
          when len(t) >= 2 and list_contains(list_transform(regexp_split_to_array(p_name, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), t) then 'PRODUCT_NAME'
          when d <> '' and d = cast(p_size as string) || '50' then 'MRP' when d <> '' and d = cast(10012345678901 + p_partkey as string) then 'FSSAI' else 'O' end as label from k join part on p_partkey = product_key)
        select product_key, word_no, word, label, case label when 'BRAND' then 1 when 'PRODUCT_NAME' then 7 when 'MRP' then 2 when 'FSSAI' then 4 else 0 end::bigint as label_id from m""",
    "word_boxes": f"""with {LABEL_LINES_SQL}, w as (select product_key, line_no, product_key % 50 as x0, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from lines),
        e as (select *, 301::double / len(words) as span, unnest(words) as word, generate_subscripts(words, 1) - 1 as i from w)
        select product_key, line_no, i as word_no, word, least(1000, cast(trunc(1000 * cast(trunc(x0 + i * span) as int) / 320::double) as bigint)) as x0, 25::bigint as y0, least(1000, cast(trunc(1000 * cast(trunc(x0 + (i + 1) * span) as int) / 320::double) as bigint)) as x1, 105::bigint as y1, 32 / 400::double as height, 10 / 400::double as top from e""",
    "resolution_plan": """with r as (select o_orderkey, cast(200 + o_orderkey * 37 % 3000 as int) as h, cast(300 + o_orderkey * 91 % 2500 as int) as w from orders),
        s as (select *, case when least(h, w) < 900 then 900::double / least(h, w) when greatest(h, w) > 2200 then 2200::double / greatest(h, w) else 1.0::double end as z, h // 2 as th, w // 2 as tw, cast(floor((h // 2) * 0.15::double) as bigint) as oh, cast(floor((w // 2) * 0.15::double) as bigint) as ow from r)
        select o_orderkey, round(case when abs(z - 1) < 0.01 then 1.0 else z end, 9) as scale, least(w, tw + ow)::bigint as first_x1, least(h, th + oh)::bigint as first_y1, greatest(0, tw - ow)::bigint as last_x0, greatest(0, th - oh)::bigint as last_y0 from s""",
    "union_texts": f"""with c as (select conv_id as product_key, turn, case when turn % 3 = 1 then ' ' else text end as text from conversations) select product_key, string_agg(text, chr(10) order by turn, text) as text from c where {strip('text')} <> '' group by 1""",
    "text_blocks": """with b as (select conv_id, role, string_agg(text, chr(10) order by turn, text) as text from conversations group by 1, 2) select conv_id as product_key, string_agg('=== ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) order by role) as value from b group by 1""",
    "row_range": "select s_suppkey, s_name, contains(s_name, '3') as shown from supplier where s_suppkey between 20 and 39",
    "licence_probe": f"""with {ORDER_CODES_SQL} select o_orderkey, run as value from codes where o_orderkey % 3 <> 0 order by o_orderkey limit 20""",
    "fence_strip": "select event_id, props as bare from events",
    "engine_union": f"""with {CALLS_SQL}, r as (select key, engine, event_id, cents from calls qualify row_number() over (partition by key, engine order by event_id desc) = 1)
        select key, string_agg(engine, '+' order by engine) as engine, string_agg(cast(cents as string), '|' order by engine) as lines, 0.0::double as cost_usd, bool_and(event_id % 3 <> 0) as cached from r group by 1""",
    "tier_escalation": """with a as (select doc_id, length(text) as n from documents where text is not null),
        f as (select *, case when n = 0 then 'no text' when n < 40 then 'few characters' when n % 3 <> 0 then 'low confidence' end as r1 from a),
        c as (select *, r1 is not null and n % 5 <> 0 as more from f),
        g as (select *, case when not more then r1 when n + 5 < 40 then 'few characters' when n % 2 = 0 then 'low confidence' end as r2 from c),
        h as (select *, r2 is not null and n >= 40 as paid from g)
        select doc_id, case when paid then 'hosted' when more then 'careful' else 'fast' end as engine, case when paid or not more then 1 else 2 end::bigint as lines, case when paid then 0.0015::double else 0.0 end as cost_usd, case when not paid then r2 end as reason,
          'fast ' || case when r1 is null then 'accepted' else 'weak: ' || r1 || ', careful ' || case when more then 'kept' else 'no better' end || case when r2 is null then '' when paid then ', hosted kept' else ', hosted no better' end end as trail from h""",
    "layout_pool": """with p as (select p_partkey as product_key, p_partkey % 3 as view, 1 + p_partkey // 2 % 40 as n, 100 + p_partkey // 2 % 50 as height from part),
        l as (select *, unnest([n, 1]) as chars, unnest([0, 1]) as k from p)
        select product_key, view * 1099511627776 + k as line_no, chars::bigint as n, round(case when k = 0 then n / height::double else 0.0 end, 9) as height, round(case when k = 0 then 10 / height::double else 0.0 end, 9) as top, repeat('x', n::int) as text from l""",
    "token_labels": f"""with {LABEL_LINES_SQL}, w as (select product_key, line_no % 3 as view, line_no // 3 as crop, list_filter(regexp_split_to_array(text, ' +'), lambda w: w <> '') as words from lines),
        e as (select product_key, view, crop, unnest(words) as word, generate_subscripts(words, 1) - 1 as word_no from w)
        select product_key, view::bigint as view, crop::bigint as crop, word_no, word, case when word_no > 4 then 'O' when regexp_matches(word, '[0-9]') then 'MRP' when word_no < 4 then 'BRAND' else 'O' end as label, case when word_no > 4 then 0.0 else length(word) / 64::double end as confidence from e""",
    "hard_subset_comparison": f"""with {CALLS_SQL}, r as (select * from calls where user_id in (select user_id from calls where engine = 'click' and cents < 4))
        select engine, count(distinct user_id) as products, cast(sum(event_id % 4) as bigint) as found, sum(event_id % 4)::double / nullif(sum(event_id % 4 + event_id % 2), 0) as of_reachable, cast(sum(cents) as bigint) as chars, cast(sum(event_id % 3) as bigint) as cjk, cast(sum(event_id % 5) as bigint) as devanagari,
        sum(cents)::double / count(distinct user_id) as seconds_a_product, count(*) filter (event_id % 50 = 0) as errors from r group by 1""",
    "paired_scores": f"""with {PAIRS} select product_key, round(p, 4) as precision, round(r, 4) as recall, round(case when round(p, 4) + round(r, 4) > 0 then 2 * p * r / (p + r) else 0.0 end, 4) as f1 from scores""",
    "stage2_report": f"""with {PAIRS}, f as (select product_key, unnest(['size', 'pack', 'veg']) as field, unnest([case when filled then nearness else 0.0 end, 1.0, veg]) as f1, unnest([case when filled then 1.0 else 0.0 end, 1.0, 1.0]) as c from pairs)
        select field, count(*) as n, round(avg(round(f1, 4)), 4)::double as f1, round(avg(c), 4)::double as coverage from f group by 1
        union all select 'OVERALL', count(*), round(avg(round(2 * p * r / (p + r), 4)), 4)::double, null from scores""",
}

# Queries that are made of others.
ORACLE_SQL |= {
    "product_fields": f"""with {LABEL_LINES_SQL}, parts as (select product_key, field, value, confidence, source from ({ORACLE_SQL['extract_fields']}) union all select product_key, field, value, confidence, source from ({ORACLE_SQL['extract_blocks']})
          union all select product_key, field, value, confidence, source from ({ORACLE_SQL['extract_front']}) union all select p_partkey, 'Upc / Ean', cast(8900000000000 + p_partkey as string), 1.0::double, 'barcode:decoded' from part where p_partkey % 2 = 0),
        s as (select product_key, line_no, {strip('text')} as value, length(text) as n, 0.4::double * {SURE} as confidence from lines where len(regexp_split_to_array({strip('text')}, '\\s+')) >= 8 and upper(text) <> text and not {any_of('text', BACK_PANEL_WORDS)})
        select * from parts union all (select product_key, 'Product_Description', value, round(confidence, 9), 'heuristic:longest-front-sentence' from s
          where not exists (select 1 from parts p where p.product_key = s.product_key and p.value = s.value) qualify row_number() over (partition by product_key order by -n, line_no) = 1)""",
    "dual_reads": """select doc_id, 1::bigint as layout_lines, case when length(text) % 5 = 0 then 1 else 2 end::bigint as text_lines,
        case when length(text) % 5 <> 0 then case when length(text) % 2 = 0 then 0.6::double else 0.8::double end when length(text) % 3 = 0 then 0.9::double else 0.5::double end as confidence from documents where text is not null""",
    "cached_reads": """with a as (select doc_id, doc_id % 3 = 0 and doc_id % 9 <> 0 as cached, length(text) as n from documents where text is not null)
        select doc_id, cached, case when cached then 0.0::double else 0.25::double end as cost_usd, case when cached then 4 else n end::bigint as n from a""",
    "paid_budget": "select distinct cast(doc_id as string) as key from documents order by key limit 200",
    "first_reasons": f"select doc_id as key, reason from ({ORACLE_SQL['escalation_reasons']}) where reason is not null order by doc_id limit 8",
    "crop_arms": """with c as (select p_partkey as product_key, unnest(['pre', 'raw']) as arm, unnest([upper(p_name), case when p_partkey % 2 = 0 then upper(p_name) else p_name end]) as text from part)
        select product_key, arm, 'fast' as engine, 0::bigint as line_no, text, case when length(text) % 3 = 0 then 0.9::double else 0.5::double end as confidence from c""",
    "validated_barcodes": f"""with {ORDER_CODES_SQL}, f as (select o_orderkey, f.code, f.source, f.unverified, codes.text from ({ORACLE_SQL['find_barcode']}) f join codes using (o_orderkey)),
        a as (select code, 'a' || cast(min(o_orderkey) as string) as name from codes where o_orderkey % 3 = 0 group by 1), b as (select code, 'b' || cast(min(o_orderkey) as string) as name from codes where o_orderkey % 2 = 0 group by 1),
        v as (select *, {checksum('code')} as valid_checksum from f)
        select o_orderkey as product_key, v.code, source, unverified, valid_checksum, case when v.code is not null then {share('v.code', 'text')} >= 0.4 end as text_match_ok,
          case when valid_checksum then coalesce(a.name, b.name) end as name, case when not valid_checksum then null when a.name is not null then 'primary' when b.name is not null then 'secondary' end as lookup_source
        from v left join a on a.code = v.code left join b on b.code = v.code""",
    "catalog_scan": """select '00' || cast(s_suppkey as string) as id, 'say "' || s_name || '",' || chr(10) || 'twice' as text, case when s_suppkey % 3 = 0 then null else cast(s_nationkey as string) || '.0' end as nation from supplier""",
}
