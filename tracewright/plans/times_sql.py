"""SQL of the timestamp rules, to put behind a ``texts`` table (text, host, any other columns) and in front of a query on ``instants``."""

from __future__ import annotations

from tracewright.operators.timestamps import ABBREVIATIONS

_ABBR = ", ".join(f"('{k}', {v})" for k, v in ABBREVIATIONS.items())


def host_sql(column: str) -> str:
    return f"nullif(lower(trim(split_part(trim({column}), '.', 1))), '')"


TIMES_SQL = rf"""
zones AS (SELECT {host_sql('computer')} AS host, min(time_zone) AS zone, min(locale) AS locale FROM host_zones GROUP BY 1),
abbr(a, m) AS (VALUES {_ABBR}),
mon(n, i) AS (VALUES ('JAN', 1), ('FEB', 2), ('MAR', 3), ('APR', 4), ('MAY', 5), ('JUN', 6), ('JUL', 7), ('AUG', 8), ('SEP', 9), ('OCT', 10), ('NOV', 11), ('DEC', 12)),
shaped AS (SELECT *, trim(text) AS x, CASE
  WHEN regexp_matches(trim(text), '^(\d{{10}}|\d{{13}}|\d{{18}})$') THEN 'epoch'
  WHEN regexp_matches(trim(text), '^\d{{4}}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d([.,]\d+)? ?([Zz]|[A-Z]{{3,4}}|[+-]\d\d:?\d\d)?$') THEN 'iso'
  WHEN regexp_matches(trim(text), '^\d{{8}}T\d{{6}}Z?$') THEN 'compact'
  WHEN regexp_matches(trim(text), '^\d{{14}}\.\d{{6}}[+-]\d{{3}}$') THEN 'cim'
  WHEN regexp_matches(trim(text), '^[A-Z][a-z]{{2}}, \d\d [A-Z][a-z]{{2}} \d{{4}} \d\d:\d\d:\d\d [+-]\d{{4}}$') THEN 'rfc'
  WHEN regexp_matches(trim(text), '^\d{{4}}/\d\d/\d\d \d\d:\d\d:\d\d(\.\d+)?$') THEN 'slash'
  WHEN regexp_matches(trim(text), '^\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}} \d{{1,2}}[:.]\d\d[:.]\d\d([.,]\d+)?( [AP]M)?$') THEN 'day'
  WHEN regexp_matches(trim(text), '^\d\d-[A-Z][a-z]{{2}}-\d{{4}} \d\d:\d\d:\d\d(\.\d+)?$') THEN 'month' END AS shape FROM texts),
cut AS (SELECT *, CASE shape
    WHEN 'iso' THEN regexp_extract(x, '^(\d{{4}})-(\d\d)-(\d\d).(\d\d):(\d\d):(\d\d)(?:[.,](\d+))? ?(.*)$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'z'])
    WHEN 'compact' THEN regexp_extract(x, '^(\d{{4}})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)()(.*)$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'z'])
    WHEN 'cim' THEN regexp_extract(x, '^(\d{{4}})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)\.(\d+)(.*)$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'z'])
    WHEN 'slash' THEN regexp_extract(x, '^(\d{{4}})/(\d\d)/(\d\d) (\d\d):(\d\d):(\d\d)\.?(\d*)()$', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'z'])
    WHEN 'rfc' THEN regexp_extract(x, '^.{{5}}(\d\d) (.{{3}}) (\d{{4}}) (\d\d):(\d\d):(\d\d)() (.*)$', ['d', 'mo', 'y', 'h', 'mi', 's', 'f', 'z'])
    WHEN 'month' THEN regexp_extract(x, '^(\d\d)-(.{{3}})-(\d{{4}}) (\d\d):(\d\d):(\d\d)\.?(\d*)()$', ['d', 'mo', 'y', 'h', 'mi', 's', 'f', 'z'])
    WHEN 'day' THEN CASE WHEN lower(trim(locale)) = 'en-us' THEN regexp_extract(x, '^(\d+)[./](\d+)[./](\d{{4}}) (\d+)[:.](\d\d)[:.](\d\d)[.,]?(\d*) ?(.*)$', ['mo', 'd', 'y', 'h', 'mi', 's', 'f', 'z'])
         ELSE regexp_extract(x, '^(\d+)[./](\d+)[./](\d{{4}}) (\d+)[:.](\d\d)[:.](\d\d)[.,]?(\d*) ?(.*)$', ['d', 'mo', 'y', 'h', 'mi', 's', 'f', 'z']) END END AS p
  FROM shaped LEFT JOIN zones USING (host)),
parts AS (SELECT * EXCLUDE (p), CASE WHEN p.mo SIMILAR TO '\d+' THEN p.mo ELSE (SELECT CAST(i AS VARCHAR) FROM mon WHERE n = upper(p.mo)) END AS mo, p.y AS y, p.d AS d, p.h AS h0, p.mi AS mi, p.s AS s, p.f AS f, upper(p.z) AS z FROM cut),
walls AS (SELECT *, TRY_CAST(y || '-' || lpad(mo, 2, '0') || '-' || lpad(d, 2, '0') || ' ' || lpad(CASE WHEN z = 'PM' AND h0 <> '12' THEN CAST(CAST(h0 AS INTEGER) + 12 AS VARCHAR) WHEN z = 'AM' AND h0 = '12' THEN '0' ELSE h0 END, 2, '0') || ':' || mi || ':' || s AS TIMESTAMP) AS wall,
    coalesce(TRY_CAST(rpad(substr(f, 1, 6), 6, '0') AS BIGINT), 0) AS us FROM parts),
offs AS (SELECT *, CASE
    WHEN shape = 'cim' THEN CAST(z AS INTEGER) WHEN z SIMILAR TO '[+-]\d\d:?\d\d' THEN (CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * (CAST(substr(z, 2, 2) AS INTEGER) * 60 + CAST(right(z, 2) AS INTEGER))
    WHEN shape IN ('iso', 'compact') AND z = '' THEN 0 WHEN shape IN ('iso', 'compact') THEN (SELECT m FROM abbr WHERE a = z) END AS minutes,
    epoch_us(timezone(zone, wall)) AS at_zone FROM walls),
instants AS (SELECT *, CASE
    WHEN shape = 'epoch' THEN CASE length(x) WHEN 10 THEN CAST(x AS BIGINT) * 1000000 WHEN 13 THEN CAST(x AS BIGINT) * 1000 ELSE CAST(x AS BIGINT) // 10 - 11644473600000000 END
    WHEN shape IN ('slash', 'day', 'month') THEN us + CASE WHEN timezone(zone, make_timestamptz(at_zone - 3600000000)) = wall THEN at_zone - 3600000000 ELSE at_zone END
    ELSE epoch_us(wall) - CAST(minutes AS BIGINT) * 60000000 + us END AS utc_us FROM offs)
"""
