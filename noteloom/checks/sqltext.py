"""SQL expressions of the text functions, used to build the DuckDB twins."""

from __future__ import annotations

from noteloom.checks.tables import NOTES
from noteloom.functions.text import CJK_CLASS, STOP_WORDS, TOKEN_RUNS, WHITESPACE, WS_CLASS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

WITH_NOTES = f"with notes as ({NOTES})"


def trim(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def ltrim(x: str) -> str:
    return f"ltrim({x}, '{WHITESPACE}')"


def rtrim(x: str) -> str:
    return f"rtrim({x}, '{WHITESPACE}')"


def utf16(x: str) -> str:
    return rf"(length({x}) + len(regexp_extract_all({x}, '[\x{{10000}}-\x{{10FFFF}}]')))"


def est_tokens(x: str) -> str:
    cjk = f"len(regexp_extract_all({x}, '[{CJK_CLASS}]'))"
    return f"cast(ceil(cast({cjk} as double) / cast(1.5 as double) + cast({utf16(x)} - {cjk} as double) / 4) as bigint)"


def tokens(x: str) -> str:
    return (
        f"list_filter(flatten(list_transform(regexp_extract_all({x}, '{TOKEN_RUNS}'), lambda r: "
        f"case when regexp_matches(r, '^[{CJK_CLASS}]') then "
        "case when length(r) >= 2 then list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) "
        "else cast([] as varchar[]) end else [lower(r)] end)), "
        f"lambda t: (length(t) > 1 or strlen(t) = 4) and t not in ({_STOPS}))"
    )


def fixed_digits(x: str, digits: int) -> str:
    """Correct rounding of the binary value, exact ties upwards."""
    half = 2 ** (digits + 1)
    nudge = 10.0 ** -(digits + 1)
    return (
        f"printf('%.{digits}f', case when ({x}) * {half} = floor(({x}) * {half}) and abs(({x}) * {half}) % 2 = 1 "
        f"then cast({x} as double) + cast({nudge} as double) else cast({x} as double) end)"
    )


def bytes_label(x: str) -> str:
    return (
        f"case when {x} < 1024 then {x} || 'B' when {x} < 1048576 then {fixed_digits(f'cast({x} as double) / 1024', 1)} || 'KB' "
        f"else {fixed_digits(f'cast({x} as double) / 1048576', 1)} || 'MB' end"
    )


def title(x: str) -> str:
    t = trim(x)
    return f"case when length({t}) > 30 then substr({t}, 1, 30) || '...' else {t} end"


HEADING = rf"^#{{1,6}}[{WS_CLASS}]"


def fm_ctes(source: str = "notes") -> str:
    """CTEs ``fm`` (path, name, body, base, found, block) and ``fm_lines`` over a notes relation."""
    return f"""
fm0 as (select *, {ltrim('content')} as t from {source}),
fm1 as (select *, case when starts_with(t, '---') then strpos(substr(t, 4), chr(10) || '---') else 0 end as e0 from fm0),
fm2 as (select *, case when e0 > 0 then e0 + 3 else 0 end as e from fm1),
fm3 as (select *, substr(t, e + 4) as rest from fm2),
fm4 as (select *, case when e = 0 then content when starts_with(rest, chr(10)) then substr(rest, 2) else rest end as body,
  {trim("substr(t, 5, greatest(e - 5, 0))")} as block from fm3),
fm as (select * exclude (t, e0, rest), case when e = 0 then 0 else
   len(string_split(case when strpos(content, body) > 0 then substr(content, 1, strpos(content, body) - 1) else '' end, chr(10))) - 1 end as base from fm4)
"""


def line_ctes(source: str = "fm") -> str:
    """CTE ``ln``: body lines with index, fence parity (toggled by the line itself), heading and blank flags."""
    return f"""
ln0 as (select path, base, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) - 1 as i
  from {source} where {trim('body')} <> ''),
ln1 as (select *, sum(case when starts_with({ltrim('line')}, '```') then 1 else 0 end) over (partition by path order by i) % 2 as code from ln0),
ln as (select *, code = 0 and regexp_matches(line, '{HEADING}') as is_heading,
   code = 0 and {trim('line')} = '' as gap, {trim("ltrim(line, '#')")} as heading_text from ln1)
"""
