"""DuckDB SQL for the registered queries, written from the rules and not from Spark plans."""

from __future__ import annotations

from hearthline.functions.text import BLANKS
from hearthline.schema import CLEANED_FIELDS, FIELDS, LISTING_COLUMNS, RAW_COLUMNS

from .listings_view import raw_sql
from .other_views import LOAD_EVENTS, POLLS, RUNS, TEMPORAL_TEXT, view_sql

_BL = BLANKS
_FLOAT = (
    r"[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?"
    r"|(?i:inf|infinity|nan))"
)


# Scalar rules


def strip(c: str) -> str:
    return f"trim({c}, '{_BL}')"


def text(c: str, width: int | None = None) -> str:
    t = f"trim(regexp_replace(coalesce({c}, ''), '[{_BL}]+', ' ', 'g'), ' ')"
    if width is None:
        return t
    return f"case when length({t}) > {width} then substr({t}, 1, {width - 3}) || '...' else {t} end"


def parsed(c: str) -> str:
    t = strip(c)
    return f"case when regexp_full_match({t}, '{_FLOAT}') then try_cast(replace({t}, '_', '') as double) end"


def real(c: str) -> str:
    return f"coalesce({parsed(c)}, cast(0 as double))"


def whole(c: str) -> str:
    x = real(c)
    return (
        f"case when isnan({x}) or abs({x}) >= 9223372036854775807 then cast(0 as bigint) "
        f"else cast(trunc({x}) as bigint) end"
    )


def percent(c: str) -> str:
    return real(f"replace({c}, '%', '')")


def cents(x: str) -> str:
    """Rounding on the exact binary value, ties to even: what printf does."""
    return f"cast(printf('%.2f', {x}) as double)"


def money(c: str) -> str:
    p = f"regexp_replace({c}, '[^0-9.]', '', 'g')"
    number = f"cast({p} as double)"
    return (
        f"case when regexp_full_match({p}, '[0-9]+\\.?[0-9]*|\\.[0-9]+') then {cents(number)} "
        f"else cast(0 as double) end"
    )


def flag(c: str) -> str:
    return f"cast(coalesce(lower({c}) in ('t', 'true', '1', 'yes'), false) as integer)"


def items(c: str) -> str:
    body = f"trim({c}, '{{}}')"
    return f"cast(case when {body} <> '' then len(string_split({body}, ',')) else 0 end as integer)"


def date_text(c: str) -> str:
    forms = [
        (r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "%Y/%m/%d"),
        (r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "%Y-%m-%d"),
        (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%m/%d/%Y"),
    ]
    tries = [
        f"case when regexp_full_match({c}, '{p}') then strftime(try_strptime({c}, '{f}'), '%Y-%m-%d') end"
        for p, f in forms
    ]
    return f"coalesce({', '.join(tries)}, {c}, '')"


RULES = {
    "strip": strip,
    "date": date_text,
    "percent": percent,
    "real": real,
    "money": money,
    "whole": whole,
    "items": items,
    "flag": flag,
}


def bands(x: str, first: str, bounds: list[tuple[int, str]], above: str) -> str:
    whens = " ".join(f"when {x} < {b} then '{label}'" for b, label in bounds)
    return f"case {first} {whens} else '{above}' end"


def room_type(c: str, apt: bool) -> str:
    entire = f"contains(lower({c}), 'entire')" + (f" or contains(lower({c}), 'apt')" if apt else "")
    return (
        f"case when {entire} then 'Entire' when contains(lower({c}), 'private') then 'Private' "
        f"when contains(lower({c}), 'shared') then 'Shared' else 'Other' end"
    )


# Stage 1


def judged_sql(variant: str, source: str = "raw") -> str:
    lacks = " or ".join(f"{f.name} is null" for f in CLEANED_FIELDS if f.clean == "strip")
    bad = "(px <= 0 or px > 10000)"
    blank = f"{strip('id')} = ''"
    if variant == "scale":
        case = (
            f"when {bad} then 'removed' when id is null then 'error' "
            f"when {blank} then 'removed' when {lacks} then 'error'"
        )
    else:
        case = (
            f"when id is null or ({blank} and name is null) then 'error' "
            f"when {bad} or {blank} then 'removed' when {lacks} then 'error'"
        )
    priced = f"select *, {money('price')} as px from {source}"
    return f"select *, case {case} else 'clean' end as outcome from ({priced}) p"


def cleaned_sql(variant: str = "scale", source: str = "raw") -> str:
    columns = []
    for f in CLEANED_FIELDS:
        if f.name == "price":
            expression = "px"
        elif f.clean == "text":
            expression = text(f.name, f.width)
        elif f.clean in RULES:
            expression = RULES[f.clean](f.name)
        else:
            expression = f.name
        columns.append(f"{expression} as {f.name}")
    inner = (
        f"select {', '.join(columns)} from ({judged_sql(variant, source)}) j where outcome = 'clean'"
    )
    rate = "host_response_rate"
    derived = {
        "price_category": bands(
            "price",
            "when price <= 0 then 'unknown'",
            [(75, "budget"), (150, "moderate"), (300, "expensive")],
            "luxury",
        ),
        "review_category": bands(
            "number_of_reviews",
            "when number_of_reviews = 0 then 'no_reviews'",
            [(5, "few"), (20, "moderate"), (50, "many")],
            "very_popular",
        ),
        "host_category": f"case when host_is_superhost = 1 then 'superhost' when isnan({rate}) then "
        f"'low_response' when {rate} >= 90 then 'responsive' when {rate} >= 50 then 'moderate' "
        "else 'low_response' end",
        "availability_category": bands(
            "availability_365",
            "when availability_365 = 0 then 'not_available'",
            [
                (30, "rarely_available"),
                (180, "occasionally_available"),
                (300, "mostly_available"),
            ],
            "highly_available",
        ),
        "room_type_simplified": room_type("room_type", variant != "scale"),
        "is_professional_host": "cast(host_listings_count > 3 as integer)",
        "has_cleaning_fee": "cast(cleaning_fee > 0 as integer)",
        "price_per_guest": cents("price / greatest(accommodates, 1)"),
    }
    return f"select *, {', '.join(f'{e} as {n}' for n, e in derived.items())} from ({inner}) c"


def text_sql(source: str) -> str:
    """All columns as staging text."""
    columns = ", ".join(f"coalesce(cast({n} as varchar), '') as {n}" for n in LISTING_COLUMNS)
    return f"select {columns} from {source}"


# Stage 2


def typed(name: str, target: str) -> str:
    t = f"trim({name}, ' ')"
    if target == "bigint":
        return f"case when regexp_full_match({t}, '[0-9]+') then try_cast({t} as bigint) end"
    if target == "decimal(10,2)":
        t = f"replace(replace({t}, '$', ''), ',', '')"
    if target == "decimal(12,8)":
        return f"case when regexp_full_match({t}, '[-+]?[0-9]*\\.?[0-9]+') then try_cast({t} as {target}) end"
    if target.startswith("decimal"):
        return f"case when regexp_full_match({t}, '[0-9]+(\\.[0-9]+)?') then try_cast({t} as {target}) end"
    if target == "date":
        return typed_date(t)
    return t


def typed_date(t: str) -> str:
    yy = f"cast(regexp_extract({t}, '([0-9]{{2}})$', 1) as integer)"
    md = "'^([0-9]{1,2})/([0-9]{1,2})/'"
    month, day = f"regexp_extract({t}, {md}, 1)", f"regexp_extract({t}, {md}, 2)"
    century = f"case when {yy} >= 70 then '19' else '20' end"
    return (
        f"case when {t} = '' or upper({t}) in ('N/A', 'NA', 'NULL') then null "
        f"when regexp_full_match({t}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}') then "
        f"try_cast({century} || right({t}, 2) || '-' || lpad({month}, 2, '0') || '-' || lpad({day}, 2, '0') as date) "
        f"when regexp_full_match({t}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') then "
        f"try_cast(right({t}, 4) || '-' || lpad({month}, 2, '0') || '-' || lpad({day}, 2, '0') as date) "
        f"when regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast({t} as date) end"
    )


def typed_sql(source: str) -> str:
    return f"select {', '.join(f'{typed(f.name, f.target)} as {f.name}' for f in FIELDS)} from {source}"


def staged_raw(source: str = "raw") -> str:
    """Raw text in the staging columns; columns it lacks are NULL."""
    columns = [n if n in RAW_COLUMNS else f"cast(null as varchar) as {n}" for n in LISTING_COLUMNS]
    return f"select {', '.join(columns)} from {source}"


BAD_ROW = (
    "not regexp_full_match(trim(host_id, ' '), '[0-9]+') or not "
    "regexp_full_match(replace(replace(trim(price, ' '), '$', ''), ',', ''), '[0-9]+(\\.[0-9]+)?')"
)

# Stage 3


def average(column: str, digits: int = 2) -> str:
    """AVG of a decimal column at six places, rounded half up, from whole numbers."""
    units = f"cast(sum({column} * {10**digits}) as hugeint)"
    n = f"count({column})"
    scale = 10 ** (6 - digits)
    rounded = f"({units} * {2 * scale} + {n}) // (2 * {n})"
    return f"case when {n} > 0 then cast({rounded} as double) / 1000000 end"


GROUP_COLUMNS = (
    f"count(*) as num_listings, {average('price')} as avg_price, "
    f"{average('review_scores_rating')} as avg_rating"
)
RANGE_COLUMNS = "cast(min(price) as double) as min_price, cast(max(price) as double) as max_price"


def with_tables(body: str, variant: str = "scale") -> str:
    """``body`` over raw, cleaned, staging and typed."""
    return (
        f"with raw as ({raw_sql()}), cleaned as ({cleaned_sql(variant)}), "
        f"staging as ({text_sql('cleaned')}), typed as ({typed_sql('staging')}) {body}"
    )


def with_raw(body: str) -> str:
    return f"with raw as ({raw_sql()}) {body}"


SUMMARY = (
    f"select count(*) as total_listings, {average('price')} as avg_price, {RANGE_COLUMNS}, "
    f"{average('review_scores_rating')} as avg_rating from typed"
)
TOP = (
    f"select neighbourhood, {GROUP_COLUMNS} from typed group by neighbourhood "
    "order by num_listings desc, neighbourhood limit 15"
)
PRICES = "select price_category, count(*) as num_listings from typed group by price_category"
ROOMS = f"select room_type_simplified, {GROUP_COLUMNS} from typed group by room_type_simplified"

_NULL = "cast(null as double)"
REPORT = (
    "select 'summary' as section, cast(null as varchar) as label, total_listings as num_listings, "
    f"avg_price, avg_rating, min_price, max_price from ({SUMMARY}) s union all "
    f"select 'top_neighbourhoods', neighbourhood, num_listings, avg_price, avg_rating, {_NULL}, {_NULL} "
    f"from ({TOP}) t union all select 'price_categories', price_category, num_listings, {_NULL}, {_NULL}, "
    f"{_NULL}, {_NULL} from ({PRICES}) p union all select 'room_type_breakdown', room_type_simplified, "
    f"num_listings, avg_price, avg_rating, {_NULL}, {_NULL} from ({ROOMS}) r"
)


def _json(fields: dict[str, str]) -> str:
    parts = [f"'\"{name}\":' || {value}" for name, value in fields.items()]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _quoted(c: str) -> str:
    return f"'\"' || {c} || '\"'"


def _number(c: str) -> str:
    return f"cast({c} as varchar)"


_GROUP_JSON = {n: _number(n) for n in ("num_listings", "avg_price", "avg_rating")}
_SUMMARY_NAMES = ("total_listings", "avg_price", "min_price", "max_price", "avg_rating")
REPORT_JSON = (
    f"select 'summary' as section, {_json({n: _number(n) for n in _SUMMARY_NAMES})} as entry "
    f"from ({SUMMARY}) s union all select 'top_neighbourhoods', "
    f"{_json({'neighbourhood': _quoted('neighbourhood'), **_GROUP_JSON})} from ({TOP}) t "
    "union all select 'price_categories', "
    f"{_json({'price_category': _quoted('price_category'), 'num_listings': _number('num_listings')})} "
    f"from ({PRICES}) p union all select 'room_type_breakdown', "
    f"{_json({'room_type_simplified': _quoted('room_type_simplified'), **_GROUP_JSON})} from ({ROOMS}) r"
)


def _accounting() -> str:
    parts = []
    for variant in ("base", "scale", "arch"):
        judged = judged_sql("scale" if variant == "scale" else "base")
        parts.append(
            f"select '{variant}' as variant, count(*) as raw_count, "
            "count(*) filter (outcome = 'clean') as clean_count, "
            "count(*) filter (outcome <> 'clean') as removed_count, "
            f"count(*) filter (outcome = 'error') as error_count from ({judged}) j"
        )
    return with_raw(" union all ".join(parts))


def _absent() -> str:
    """Three real columns; every other raw column holds its default."""
    parts = []
    for variant in ("base", "scale"):
        columns = []
        for f in CLEANED_FIELDS:
            default = f.default
            if f.name == "accommodates" and variant == "scale":
                default = "1"
            kept = f.name in ("id", "name", "price")
            columns.append(f.name if kept else f"'{default}' as {f.name}")
        source = f"(select {', '.join(columns)} from raw) d"
        names = [n if n != "room_type_simplified" else f"'Other' as {n}" for n in LISTING_COLUMNS]
        parts.append(
            f"select '{variant}' as variant, {', '.join(names)} from ({cleaned_sql(variant, source)}) c"
        )
    return with_raw(" union all ".join(parts))


def _functions(columns: dict[str, str]) -> str:
    return with_raw(f"select id, {', '.join(f'{e} as {n}' for n, e in columns.items())} from raw")


# Temporal decoding

_CLOCK = r"([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})(?:.([0-9]{1,6}))?"


def _part(c: str, pattern: str, i: int) -> str:
    return f"regexp_extract({c}, '{pattern}', {i})"


def _plain_date(c: str) -> str:
    p = "^([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2})$"
    parts = [_part(c, p, i) for i in (1, 2, 3)]
    return (
        f"case when regexp_matches({c}, '{p}') and cast({parts[0]} as int) > 0 then try_cast("
        f"lpad({parts[0]}, 4, '0') || '-' || lpad({parts[1]}, 2, '0') || '-' || lpad({parts[2]}, 2, '0') as date) end"
    )


def _datetimes() -> str:
    c = "stamp_text"
    p = r"^([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2})[T ]" + _CLOCK
    g = [_part(c, p, i) for i in range(1, 8)]
    iso = (
        f"lpad({g[0]}, 4, '0') || '-' || lpad({g[1]}, 2, '0') || '-' || lpad({g[2]}, 2, '0') || ' ' || "
        f"lpad({g[3]}, 2, '0') || ':' || lpad({g[4]}, 2, '0') || ':' || lpad({g[5]}, 2, '0') || '.' || "
        f"rpad({g[6]}, 6, '0')"
    )
    value = (
        f"case when regexp_matches({c}, '{p}') and cast({g[0]} as int) > 0 and cast({g[3]} as int) < 24 "
        f"then try_cast({iso} as timestamp) end"
    )
    inner = f"select event_id, {c}, {value} as value, {_plain_date(c)} as plain from ({view_sql('events', TEMPORAL_TEXT)}) v"
    return (
        "select event_id, value, case when value is null then plain end as day, "
        f"case when value is null and plain is null then {c} end as raw from ({inner}) d"
    )


def _intervals() -> str:
    c = "span_text"
    p = r"^(-)?([0-9]{1,3}):([0-9]{1,2}):([0-9]{1,2})(?:.([0-9]{1,6}))?"
    g = [_part(c, p, i) for i in range(1, 6)]
    total = (
        f"cast({g[1]} as int) * 3600 + cast({g[2]} as int) * 60 + cast({g[3]} as int) + "
        f"cast(rpad({g[4]}, 6, '0') as int) / 1000000"
    )
    hit = f"regexp_matches({c}, '{p}')"
    return (
        f"select event_id, case when {hit} then cast(({total}) * case when {g[0]} = '-' then -1 else 1 end as double) "
        f"end as seconds, case when not {hit} then {c} end as raw from ({view_sql('events', TEMPORAL_TEXT)}) v"
    )


def _times() -> str:
    c = "clock_text"
    p = "^" + _CLOCK
    g = [_part(c, p, i) for i in range(1, 5)]
    hit = (
        f"(regexp_matches({c}, '{p}') and cast({g[0]} as int) < 24 and cast({g[1]} as int) < 60 "
        f"and cast({g[2]} as int) < 60)"
    )
    shown = (
        f"lpad({g[0]}, 2, '0') || ':' || lpad({g[1]}, 2, '0') || ':' || lpad({g[2]}, 2, '0') || "
        f"case when {g[3]} <> '' then '.' || rpad({g[3]}, 6, '0') else '' end"
    )
    return (
        f"select event_id, case when {hit} then {shown} end as value, "
        f"case when not {hit} then {c} end as raw from ({view_sql('events', TEMPORAL_TEXT)}) v"
    )


# Events


def _manifest(default_bucket: str | None, rejected: bool = False) -> str:
    j = "case when json_valid(event) then cast(event as json) end"
    body = "case when json_type(j, '$.detail') = 'OBJECT' then json_extract(j, '$.detail') else j end"

    def field(path: str) -> str:
        return f"json_extract_string(b, '$.{path}')"

    def inside(outer: str, name: str) -> str:
        return f"case when json_type(b, '$.{outer}') = 'OBJECT' then {field(f'{outer}.{name}')} end"

    bucket = f"coalesce({field('s3Bucket')}, {inside('bucket', 'name')}"
    bucket += f", '{default_bucket}')" if default_bucket else ")"
    key = f"coalesce({field('s3Key')}, {inside('object', 'key')})"
    good = "not regexp_matches(k, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|.?$)')"
    embedded = f"coalesce(lower({field('target')}) = 'sqlite', false) or coalesce(lower({field('action')}) = 'sqlite', false)"
    read = (
        f"select event_id, event, b, {bucket} as bucket, {key} as k from (select event_id, event, {body} as b "
        f"from (select event_id, event, {j} as j from ({view_sql('events', LOAD_EVENTS)}) e) p) q"
    )
    if rejected:
        return f"select event_id, event from ({read}) r where bucket is null or k is null"
    return (
        f"select event_id, bucket, case when {good} then url_decode(replace(k, '+', ' ')) else k end as object_key, "
        f"case when {embedded} then 'text_table' else 'typed_table' end as destination, "
        f"coalesce(lower({field('pruneTargetTable')}) = 'true', true) as prune_target, "
        f"coalesce(lower({field('pruneTable')}) = 'true', false) as prune_text_table "
        f"from ({read}) r where bucket is not null and k is not null"
    )


def _deltas() -> str:
    names = ["cpuUser", "cpuKernel", "cpuIdle", "pageFaults", "majorPageFaults"]
    columns = ", ".join(
        f"arg_max(value, ts) filter (metric = '{n}') - arg_min(value, ts) filter (metric = '{n}') as {n}Delta"
        for n in names
    )
    return f"select run_id, {columns} from ({view_sql('events', POLLS)}) p group by run_id"


def _advice() -> str:
    available = '"functionMemory" / 1792'
    used = '("cpuUserDelta" + "cpuKernelDelta") / nullif("userRuntime", 0)'
    return (
        f"select run_id, functionMemory, cpuUserDelta, cpuKernelDelta, userRuntime, "
        f"cast(printf('%.3f', {available}) as double) as availableCPUs, "
        f"case when {used} is not null then cast(printf('%.3f', {used}) as double) end as utilizedCPUs, "
        f"cast(least(greatest(round_even(0.000556 * case when {available} - {used} < 0.1 then "
        f"{available} * 1.1 else {used} end + 0.012346, 0), 128), 10240) as bigint) as recommendedMemory "
        f"from ({view_sql('customer', RUNS)}) r"
    )


# Scale-up

_ID = strip("id")
_DIGITS = f"regexp_full_match({_ID}, '[0-9]+')"
_TOP = f"select max(cast({_ID} as hugeint)) as top from raw where {_DIGITS}"


def _copies(copies: str) -> str:
    """Rows of ``raw`` times the rows of ``copies`` (copy number ``copy``)."""
    new = f"cast(cast({_ID} as hugeint) + (select top from top) * copy as varchar)"
    moved = f"replace(listing_url, '/rooms/' || {_ID}, '/rooms/' || {new})"
    return (
        f"select case when {_DIGITS} then {new} else id end as id, "
        f"case when {_DIGITS} then {moved} else listing_url end as listing_url, "
        f"raw.* exclude (id, listing_url), c.* from raw, ({copies}) c"
    )


def _long_ids() -> str:
    """Addition in two halves of 30 digits."""
    raw = (
        "select cast(c_custkey as varchar) || case when c_custkey % 3 = 0 then '' "
        "else repeat('9', cast(c_custkey % 45 as int)) end as id from customer"
    )
    unit = "cast('1' || repeat('0', 30) as hugeint)"
    halves = "cast(substr(lpad(id, 60, '0'), 1, 30) as hugeint) as hi, cast(substr(lpad(id, 60, '0'), 31) as hugeint) as lo"
    return (
        f"with raw as ({raw}), halves as (select id, {halves} from raw), "
        "top as (select hi as top_hi, lo as top_lo from halves order by hi desc, lo desc limit 1), "
        "sums as (select copy, hi + top_hi * copy as hi, lo + top_lo * copy as lo "
        "from halves, top, (select unnest(range(3)) as copy)), "
        f"moved as (select copy, coalesce(nullif(ltrim(cast(hi + lo // {unit} as varchar) "
        f"|| lpad(cast(lo % {unit} as varchar), 30, '0'), '0'), ''), '0') as id from sums) "
        "select id, 'u/rooms/' || id || '?x' as listing_url, cast(copy as integer) as copy from moved"
    )


def _literal(c: str) -> str:
    escaped = f"replace(replace(cast({c} as varchar), chr(92), chr(92) || chr(92)), chr(39), chr(39) || chr(39))"
    return f"coalesce(chr(39) || {escaped} || chr(39), 'NULL')"


def _statements(source: str, stream: str, order: str, values: list[str], before: str, after: str, limit: int) -> str:
    """Greedy cuts: from each row the last that still fits, then a walk from cut to cut."""
    row = " || ', ' || ".join(values)
    room = limit - len(before) - len(after) + 1
    text = f"'{before}' || string_agg(line, ',' order by n) || '{after}'"
    return (
        f"with recursive lines as (select {stream} as stream, {order} as k, '(' || {row} || ')' as line from {source}), "
        "placed as (select *, row_number() over (partition by stream order by k, line) as n, strlen(line) + 1 as size from lines), "
        "ends as (select *, cast(sum(size) over (partition by stream order by n) as bigint) as upto from placed), "
        f"reach as (select stream, n, size, upto - size + {room} as target from ends), "
        "fits as (select r.stream, r.n, greatest(r.n, coalesce(e.n, 0)) as last from reach r "
        "asof left join ends e on r.stream = e.stream and r.target >= e.upto), "
        "cuts as (select stream, cast(0 as bigint) as statement, n as first, last from fits where n = 1 union all "
        "select c.stream, c.statement + 1, f.n, f.last from cuts c join fits f on f.stream = c.stream and f.n = c.last + 1), "
        f"texts as (select cast(c.stream as integer) as stream, statement, count(*) as n_rows, {text} as text "
        "from cuts c join placed p on p.stream = c.stream and p.n between c.first and c.last group by c.stream, statement) "
        "select stream, statement, n_rows, cast(strlen(text) as bigint) as n_bytes, md5(text) as text from texts"
    )


_PAIRS = " union all ".join(f"select {m} as multiplier, {k} as copy" for m in (1, 2, 4, 6) for k in range(m))
_SEQ_KEY = "case when event_type = 'error' then 0 else user_id end"

ORACLE: dict[str, str] = {
    "price_categories": with_tables(PRICES),
    "summary": with_tables(SUMMARY),
    "summary_without_unrated": with_tables(
        f"select count(*) as total_listings, {average('price')} as avg_price, {RANGE_COLUMNS}, "
        f"{average('nullif(review_scores_rating, 0)')} as avg_rating from typed"
    ),
    "top_neighbourhoods": with_tables(TOP),
    "room_type_breakdown": with_tables(ROOMS),
    "state_counts_any_case": with_tables(
        "select lower(state) as state, count(*) as num_listings from typed group by 1"
    ),
    "full_report": with_tables(REPORT),
    "full_report_json": with_tables(REPORT_JSON),
    "data_quality": with_tables(
        f"select {cents('avg(price)')} as avg_price, {cents('avg(review_scores_rating)')} as avg_review_score, "
        "count(*) filter (host_is_superhost = 1) as superhosts_count, "
        "count(*) filter (instant_bookable = 1) as instant_bookable_count from cleaned",
        "base",
    ),
    "row_accounting": _accounting(),
    "cleaned_listings": with_tables("select * from cleaned"),
    "cleaned_listings_base": with_tables("select * from cleaned", "base"),
    "absent_columns": _absent(),
    "typed_listings": with_tables("select * from typed"),
    "typed_staging": with_tables("select * from typed"),
    "typed_raw_listings": with_raw(typed_sql(f"({staged_raw()}) s")),
    "bad_rows": with_raw(
        f"select id, host_id, price from raw where {BAD_ROW} order by id, host_id nulls first, price nulls first limit 50"
    ),
    "all_bad_rows": with_raw(f"select id, host_id, price from raw where {BAD_ROW}"),
    "clean_document_text": f"select doc_id, {text('text')} as text, {text('text', 1000)} as description, "
    f"{text('text', 200)} as name from documents",
    "clean_conversation_text": f"select conv_id, turn, {text('text', 100)} as host_name from conversations",
    "clean_numbers": _functions(
        {
            "price": money("price"),
            "security_deposit": money("security_deposit"),
            "latitude": real("latitude"),
            "review_scores_rating": real("review_scores_rating"),
            "beds": whole("beds"),
            "maximum_nights": whole("maximum_nights"),
            "host_response_rate": percent("host_response_rate"),
            "host_acceptance_rate": percent("host_acceptance_rate"),
        }
    ),
    "number_text": "select o_orderkey, cast(o_totalprice as varchar) as total, "
    "cast(o_totalprice * 1000 as varchar) as thousands, "
    "cast(floor(o_totalprice) / 1024 as varchar) as fraction from orders",
    "flags": _functions(
        {
            "host_is_superhost": flag("host_is_superhost"),
            "host_identity_verified": flag("host_identity_verified"),
            "has_availability": flag("has_availability"),
            "is_professional_host": f"cast({whole('host_listings_count')} > 3 as integer)",
            "has_cleaning_fee": f"cast({money('cleaning_fee')} > 0 as integer)",
        }
    ),
    "clean_dates": _functions({c: date_text(c) for c in ("host_since", "first_review", "last_review")}),
    "amenity_counts": with_raw(
        f"select {items('amenities')} as amenities, count(*) as num_listings from raw group by 1"
    ),
    "categories": with_tables(
        "select price_category, review_category, host_category, availability_category, room_type_simplified, "
        "count(*) as num_listings from cleaned group by all"
    ),
    "price_per_guest": f"select l_orderkey, l_linenumber, "
    f"{cents('l_extendedprice / greatest(l_partkey % 17, 1)')} as price_per_guest from lineitem",
    "typed_dates": _functions(
        {
            "host_since": typed_date("trim(host_since, ' ')"),
            "is_null_token": "upper(trim(host_since, ' ')) in ('N/A', 'NA', 'NULL')",
            "bedrooms": typed("bedrooms", "bigint"),
            "bedrooms_lenient": "case when regexp_full_match(bedrooms, '[0-9]+(\\.0+)?') "
            "then cast(string_split(bedrooms, '.')[1] as bigint) end",
        }
    ),
    "listings_in_sql": _functions(
        {
            "price": money("price"),
            "latitude": real("latitude"),
            "beds": whole("beds"),
            "host_response_rate": percent("host_response_rate"),
            "host_is_superhost": flag("host_is_superhost"),
            "is_professional_host": f"cast({whole('host_listings_count')} > 3 as integer)",
            "has_cleaning_fee": f"cast({money('cleaning_fee')} > 0 as integer)",
            "first_review": date_text("first_review"),
            "amenities": items("amenities"),
            "host_since": typed_date("trim(host_since, ' ')"),
            "bedrooms": typed("bedrooms", "bigint"),
        }
    ),
    "decode_datetimes": _datetimes(),
    "decode_intervals": _intervals(),
    "decode_times": _times(),
    "decode_dates": f"select event_id, {_plain_date('day_text')} as value, "
    f"case when {_plain_date('day_text')} is null then day_text end as raw "
    f"from ({view_sql('events', TEMPORAL_TEXT)}) v",
    "ticks": "select event_id, cast(ts as date) as day, strftime(ts, '%H:%M:%S') as clock, "
    "date_trunc('second', ts) as stamp from events",
    "largest_id": with_raw(f"select cast(max(cast({_ID} as hugeint)) as bigint) as largest_id from raw where {_DIGITS}"),
    "replicate": with_raw(
        f", top as ({_TOP}) {_copies('select unnest(range(4)) as copy')}".replace(", c.*", ", cast(copy as integer) as copy")
    ),
    "scale_summary": with_raw(
        f", top as ({_TOP}) select multiplier, count(*) as records, cast(sum("
        + " + ".join(f"coalesce(strlen({n}), 0)" for n in RAW_COLUMNS)
        + ") as bigint) as text_bytes "
        f"from ({_copies(_PAIRS)}) r group by multiplier"
    ),
    "scale_files": " union all ".join(
        f"select {m} as multiplier, count(*) * {m} as records from orders" for m in (1, 2, 4, 6)
    ),
    "sequence": f"select row_number() over (order by {_SEQ_KEY}, event_id) as sequential_id, "
    "case when event_type = 'error' then 'n/a' else cast(user_id as varchar) end as id, event_id from events",
    "scale_file_contents": with_raw(
        f", top as ({_TOP}) select "
        + ", ".join(f"coalesce({n}, '') as {n}" for n in RAW_COLUMNS)
        + f" from ({_copies('select unnest(range(2)) as copy')}) r"
    ),
    "order_by_id": with_raw(
        "select * exclude (k), row_number() over (order by case when regexp_full_match(id, '[0-9]+') "
        "then cast(id as hugeint) else 0 end, k) as place from raw"
    ).replace("(select ", "(select k, ", 1),
    "upsert_awkward_versions": "with changes as (select case when o_orderkey % 50 <> 0 then o_custkey * 2 end as c_custkey, "
    "o_orderpriority || o_orderkey as c_mktsegment, case when o_orderkey % 3 <> 0 then o_orderkey % 4 end as version "
    "from orders), latest as (select c_custkey, c_mktsegment from changes where c_custkey is not null qualify row_number() "
    "over (partition by c_custkey order by version desc nulls last, c_mktsegment desc) = 1) "
    "select * from latest union all select c_custkey, c_mktsegment from changes where c_custkey is null union all "
    "select c_custkey, c_mktsegment from customer where c_custkey not in (select c_custkey from latest)",
    "oversized_prices": "select variant, count(*) as raw_count, count(*) filter (o_orderkey % 4 = 0) as clean_count, "
    "count(*) filter (o_orderkey % 4 <> 0) as removed_count, cast(0 as bigint) as error_count "
    "from orders, (values ('base'), ('scale'), ('arch')) v(variant) group by variant",
    "awkward_csv": "select cast(o_orderkey as varchar) as id, "
    "['5\" wide', 'line' || chr(10) || 'break ', 'closedafter', ''][o_orderkey % 4 + 1] as a, "
    "['a, \"b\"', 'x\"y', 'q\"', ''][o_orderkey % 4 + 1] as b, "
    "['z', 'z', null, o_orderpriority][o_orderkey % 4 + 1] as c from orders",
    "insert_new_only": "select o_orderkey as id, o_totalprice as price from orders "
    "where o_orderkey not in (select c_custkey from customer)",
    "upsert": "with latest as (select o_custkey * 2 as c_custkey, o_totalprice as c_acctbal, "
    "o_orderpriority as c_mktsegment from orders qualify row_number() over (partition by o_custkey "
    "order by o_orderdate desc, o_orderkey desc) = 1) select * from latest union all "
    "select c_custkey, c_acctbal, c_mktsegment from customer where c_custkey not in (select c_custkey from latest)",
    "stored_upsert": "with latest as (select o_custkey * 2 as c_custkey, o_totalprice as c_acctbal, "
    "o_orderpriority as c_mktsegment from orders qualify row_number() over (partition by o_custkey "
    "order by o_orderdate desc, o_orderkey desc) = 1), "
    "second as (select s_suppkey * 3 as c_custkey, s_acctbal as c_acctbal, s_name as c_mktsegment from supplier) "
    "select * from second union all "
    "select * from latest where c_custkey not in (select c_custkey from second) union all "
    "select c_custkey, c_acctbal, c_mktsegment from customer where c_custkey not in (select c_custkey from latest) "
    "and c_custkey not in (select c_custkey from second)",
    "replicate_long_ids": _long_ids(),
    "insert_statements": _statements(
        "lineitem",
        "l_orderkey % 4",
        "(l_orderkey, l_linenumber)",
        ["l_orderkey", "l_linenumber", "l_partkey", _literal("l_returnflag"), _literal("cast(l_shipdate as date)")],
        "INSERT INTO items (l_orderkey, l_linenumber, l_partkey, l_returnflag, l_shipdate) VALUES ",
        "",
        1_024_000,
    ),
    "replace_statements": _statements(
        "documents",
        "coalesce(doc_id % 3, 0)",
        "doc_id",
        ["coalesce(cast(doc_id as varchar), 'NULL')", _literal("lang"), _literal("source"), _literal("text")],
        "REPLACE INTO documents (doc_id, lang, source, text) VALUES ",
        " AS new ON DUPLICATE KEY UPDATE text = new.text",
        4000,
    ),
    "load_manifest": _manifest(None),
    "load_manifest_default_bucket": _manifest("inbox"),
    "rejected_events": _manifest(None, rejected=True),
    "counter_deltas": _deltas(),
    "size_advice": _advice(),
    "csv_round_trip": with_raw(
        "select "
        + ", ".join(f"coalesce({n}, '') as {n}" for n in RAW_COLUMNS)
        + " from raw"
    ),
    "text_table": "select cast(c_custkey as varchar) as customer_id, c_name as name, "
    "c_mktsegment as segment__market_ from customer",
    "transform_job": "",
    "transform_job_counts": with_raw(
        "select count(*) as raw_count, count(*) filter (outcome = 'clean') as clean_count, "
        "count(*) filter (outcome <> 'clean') as removed_count, count(*) filter (outcome = 'error') as error_count, "
        f"count(*) filter (outcome = 'clean') as records_processed from ({judged_sql('base')}) j"
    ),
    "numbered_transform_job": with_tables(
        "select cast(row_number() over (order by case when regexp_full_match(id, '[0-9]+') then cast(id as bigint) "
        "else 0 end, cast(ltrim(id, 'a') as bigint)) as varchar) as sequential_id, * from staging",
        "base",
    ),
    "load_job": with_tables("select * from typed"),
    "parquet_transform_job": with_tables("select * from typed"),
    "arriving_loads": with_tables("select * from typed"),
}

_STEPS = {
    "transform": "start_read end_read start_transform end_transform start_save end_save total",
    "bulk_load": "load count insert badrows total",
    "report": "aggregate summary top_neighbourhoods price_categories room_type_breakdown total",
}
ORACLE["decode_dates_in_sql"] = ORACLE["decode_dates"]
ORACLE["run_metrics"] = " union all ".join(
    f"select '{operation}' as operation, '{step}' as step, count(*) > 0 as measured from orders"
    for operation, steps in _STEPS.items()
    for step in [*steps.split(), "sum of steps", *(["marks in order"] if operation == "transform" else [])]
)


def _filled(columns: list[str]) -> str:
    """The raw view after a trip through CSV: a missing field in mid-row reads as empty."""
    return "select " + ", ".join(f"coalesce({n}, '') as {n}" for n in columns) + " from raw"


ORACLE["transform_job"] = (
    f"with raw0 as ({raw_sql()}), raw as ({_filled(RAW_COLUMNS).replace('from raw', 'from raw0')}), "
    f"cleaned as ({cleaned_sql('scale')}) {text_sql('cleaned')}"
)
ORACLE["three_stage_report"] = (
    f"with raw0 as ({raw_sql()}), raw as ({_filled(RAW_COLUMNS).replace('from raw', 'from raw0')}), "
    f"cleaned as ({cleaned_sql('base')}), staging as ({text_sql('cleaned')}), typed as ({typed_sql('staging')}) {ROOMS}"
)
ORACLE["arriving_transforms"] = (
    f"with raw0 as ({raw_sql()}), raw as ({_filled(RAW_COLUMNS).replace('from raw', 'from raw0')}), "
    f"cleaned as ({cleaned_sql('base')}) select price_category, room_type_simplified, count(*) as num_listings, "
    "cast(sum(cast(price as decimal(20,2))) as double) as price from cleaned group by all"
)
ORACLE["load_job_counts"] = with_raw(
    ", n as (select count(*) as rows, least(50, count(*) filter "
    f"({BAD_ROW})) as bad from (select coalesce(host_id, '') as host_id, coalesce(price, '') as price from raw) r) "
    "select u.load_id, rows as staging_count, rows * u.new as inserted, bad as bad_rows_shown, rows * 2 as target_rows "
    "from n, (values ('replace', 1), ('append', 1), ('new_only', 0)) u(load_id, new)"
)
ORACLE["report_order"] = with_tables(
    " union all ".join(
        f"select '{name}' as report, {label} as label, num_listings, "
        f"row_number() over (order by num_listings desc, {label}) as place from ({rows}) r"
        for name, label, rows in (
            ("price_categories", "price_category", PRICES),
            ("top_neighbourhoods", "neighbourhood", TOP),
            ("room_type_breakdown", "room_type_simplified", ROOMS),
        )
    )
)
_CLEAN = "select '{0}' as variant, count(*) filter (outcome = 'clean') as n from ({1}) j"
ORACLE["transform_outputs"] = with_raw(
    ", counts as ("
    + " union all ".join(_CLEAN.format(v, judged_sql(v)) for v in ("base", "scale", "arch"))
    + ") select variant, 'some' as kind, case variant when 'base' then 'clean_listings_20240304_050607.csv' "
    "when 'scale' then 'clean_l_2x_20240304_050607.csv' else 'clean_listings_any_20240304_050607.csv' end as name, n "
    "from counts union all select variant, 'none', null, 0 from counts"
)
ORACLE["arriving_accounts"] = (
    f"with raw0 as ({raw_sql()}), raw as ({_filled(RAW_COLUMNS).replace('from raw', 'from raw0')}) "
    "select count(*) as raw_count, count(*) filter (outcome = 'clean') as clean_count, "
    "count(*) filter (outcome <> 'clean') as removed_count, count(*) filter (outcome = 'error') as error_count, "
    f"true as kept_aside from ({judged_sql('scale')}) j"
)
ORACLE["event_loads"] = (
    "select (select count(*) from nation) as rows_loaded, (select count(*) from orders) as target_rows, "
    "(select count(*) from nation) as text_rows, cast(1 as bigint) as rejected"
)
ORACLE["arriving_files"] = (
    f"with raw0 as ({raw_sql()}), raw as ({_filled(RAW_COLUMNS).replace('from raw', 'from raw0')}), "
    f"cleaned as ({cleaned_sql('scale')}) select cast(length(neighbourhood) % 3 as varchar) as part, "
    "count(*) as clean_rows from cleaned group by all"
)
ORACLE["replayed_loads"] = with_tables(
    "select cast(1 as bigint) as copies, count(distinct id) as listings from typed"
)
