"""DuckDB oracles of the string metrics and of what rests on them.

The longest common subsequence is a textbook row-by-row dynamic programme in a
recursive CTE over the distinct pairs: the new row is the running maximum of
``greatest(up, diagonal + match)``.
"""

from __future__ import annotations

from .. import constants as K
from ..sources.fixtures import with_views
from .catalog_evidence import D
from .oracles_decision import chain
from .registry import ORACLE, hav_sql

_CANON = " ".join(f"WHEN {{x}} IN ({', '.join(repr(v) for v in dict.fromkeys(vs + [c.lower()]))}) THEN '{c}'"
                  for c, vs in K.COUNTRY_ALIASES.items())


def canon(x: str) -> str:
    low = f"lower(trim({x}))"
    return f"(CASE {_CANON.replace('{x}', low)} ELSE upper(trim({x})) END)"


def lcs(pairs: str) -> str:
    """CTEs ending in ``lcs(a, b, n)`` for the distinct pairs of ``pairs`` (a SELECT of a, b)."""
    return f"""pairs AS (SELECT DISTINCT a, b FROM ({pairs}) p),
dp(a, b, i, r) AS (SELECT a, b, 0, list_transform(range(length(a) + 1), lambda x: CAST(0 AS BIGINT)) FROM pairs
 UNION ALL SELECT a, b, i + 1, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(a) + 1), lambda j:
  list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k + 1],
   r[k] + CASE WHEN substr(a, k, 1) = substr(b, i + 1, 1) THEN 1 ELSE 0 END)))))
 FROM dp WHERE i < length(b)),
lcs AS (SELECT a, b, r[length(a) + 1] AS n FROM dp WHERE i = length(b))"""


def _query(ctes: str, body: str) -> str:
    return f"SELECT * FROM (WITH RECURSIVE {ctes}\n{body}) q"


def _ratio(n: str, a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN {D(100)} ELSE {D(200)} * {n} / (length({a}) + length({b})) END"


_NAMES = """SELECT c.pos, lower(c.name) AS a, lower(coalesce(e.name, '')) AS b FROM centres c LEFT JOIN existing e ON e.pos = c.pos"""

ORACLE["indel_ratio"] = with_views(_query(
    lcs(_NAMES), f"SELECT n.pos, round({_ratio('l.n', 'n.a', 'n.b')}, 6) AS ratio FROM ({_NAMES}) n JOIN lcs l ON l.a = n.a AND l.b = n.b"),
    "centres", "existing")


def token_set(pairs: str) -> str:
    """CTEs ending in ``tsr(a, b, ratio)``: token-set ratio 0..100 of the distinct pairs."""
    words = lambda x: f"list_distinct(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"
    return f"""tok AS (SELECT a, b, {words('a')} AS ta, {words('b')} AS tb FROM (SELECT DISTINCT a, b FROM ({pairs}) p0) p1),
cut AS (SELECT a AS qa, b AS qb, ta, tb, list_intersect(ta, tb) AS s,
 array_to_string(list_sort(list_filter(ta, lambda w: NOT list_contains(tb, w))), ' ') AS ja,
 array_to_string(list_sort(list_filter(tb, lambda w: NOT list_contains(ta, w))), ' ') AS jb FROM tok),
{lcs('SELECT ja AS a, jb AS b FROM cut')},
size AS (SELECT cut.*, length(array_to_string(s, ' ')) AS sl, length(ja) AS la, length(jb) AS lb, l.n FROM cut
 JOIN lcs l ON l.a = ja AND l.b = jb),
glued AS (SELECT *, CASE WHEN sl > 0 THEN 1 ELSE 0 END AS g FROM size),
tsr AS (SELECT qa AS a, qb AS b, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN {D(0)}
 WHEN len(s) > 0 AND (ja = '' OR jb = '') THEN {D(100)}
 WHEN sl = 0 THEN 100 * (1 - CAST(la + lb - 2 * n AS DOUBLE) / (la + lb))
 ELSE greatest(100 * (1 - CAST(la + lb - 2 * n AS DOUBLE) / (2 * (sl + g) + la + lb)),
  100 * (1 - CAST(g + la AS DOUBLE) / (2 * sl + g + la)), 100 * (1 - CAST(g + lb AS DOUBLE) / (2 * sl + g + lb))) END AS ratio
 FROM glued)"""


for _key, _col, _empty in (("token_set_ratio", "ratio", ""), ("score_fuzzy_field", "score", "")):
    ORACLE[_key] = with_views(_query(
        token_set(_NAMES), f"SELECT n.pos, round(t.ratio, 6) AS {_col} FROM ({_NAMES}) n JOIN tsr t ON t.a = n.a AND t.b = n.b"),
        "centres", "existing")

_COUNTRIES = "SELECT c.pos, c.country AS x, k.ctry AS y FROM centres c JOIN cities k ON k.city = c.city"
_FOLD = lambda x: f"regexp_replace(trim(lower({x})), '\\s+', ' ', 'g')"
ORACLE["country_similarity"] = with_views(_query(
    token_set(f"SELECT {_FOLD('x')} AS a, {_FOLD('y')} AS b FROM ({_COUNTRIES}) c"),
    f"""SELECT c.pos, round(CASE WHEN x = '' OR y = '' THEN {D(0)} WHEN {canon('x')} = {canon('y')} OR t.a = t.b THEN {D(1)}
  ELSE t.ratio / 100 END, 6) AS country_similarity FROM ({_COUNTRIES}) c JOIN tsr t ON t.a = {_FOLD('x')} AND t.b = {_FOLD('y')}"""),
    "centres", "cities")
ORACLE["score_country"] = with_views(_query(
    lcs(f"SELECT lower(trim(x)) AS a, lower(trim(y)) AS b FROM ({_COUNTRIES}) c"),
    f"""SELECT pos, round(CASE WHEN x = '' OR y = '' THEN {D(0)} WHEN {canon('x')} = {canon('y')} THEN {D(1)}
  WHEN r < 50 THEN {D(0)} ELSE r / 100 END, 6) AS score FROM (SELECT c.*, {_ratio('l.n', 'l.a', 'l.b')} AS r
  FROM ({_COUNTRIES}) c JOIN lcs l ON l.a = lower(trim(x)) AND l.b = lower(trim(y))) z"""), "centres", "cities")

_NEXT = """SELECT c.pos, lower(c.city) AS rc, lower(c.state) AS rs, lower(c.country) AS rn, lower(coalesce(n.city, '')) AS vc,
 lower(coalesce(n.state, '')) AS vs, lower(coalesce(n.country, '')) AS vn FROM centres c LEFT JOIN centres n ON n.pos - 1 = c.pos"""
_IN = lambda a, b: f"(contains({a}, {b}) OR contains({b}, {a}))"
ORACLE["reverse_match"] = with_views(_query(
    lcs(f"SELECT rc AS a, vc AS b FROM ({_NEXT}) n"),
    f"""SELECT pos, (rc <> '' AND vc <> '' AND ({_IN('vc', 'rc')} OR {_ratio('l.n', 'l.a', 'l.b')} > 70))
  OR (rn <> '' AND vn <> '' AND {_IN('vn', 'rn')}) AS reverse_match
  FROM ({_NEXT}) n JOIN lcs l ON l.a = rc AND l.b = vc"""), "centres")
ORACLE["admin_hierarchy_valid"] = with_views(_query(
    lcs(f"SELECT rs AS a, vs AS b FROM ({_NEXT}) n"),
    f"""SELECT pos, NOT ((rn <> '' AND vn <> '' AND NOT {_IN('vn', 'rn')})
  OR (rs <> '' AND vs <> '' AND NOT {_IN('vs', 'rs')} AND {_ratio('l.n', 'l.a', 'l.b')} < 60)) AS admin_hierarchy_valid
  FROM ({_NEXT}) n JOIN lcs l ON l.a = rs AND l.b = vs"""), "centres")

_SC = K.SCORER_WEIGHTS
_SCORED = f"""SELECT pos, CAST(cand_pos AS INTEGER) AS cand_pos, CAST(printf('%.4f', {D(_SC['name'])} + {D(_SC['city'])}
 + {D(_SC['country'])} + CAST(confidence AS DOUBLE) * {D(_SC['confidence'])} + {D(_SC['distance_penalty'])}) AS DOUBLE) AS score
 FROM candidates"""
_RANKED = f"""SELECT *, CAST(row_number() OVER (PARTITION BY pos ORDER BY score DESC, cand_pos) AS INTEGER) AS rank FROM ({_SCORED}) s"""
ORACLE["score_candidates"] = with_views(_SCORED, "candidates")
ORACLE["rank_candidates"] = with_views(_RANKED, "candidates")
ORACLE["best_candidate"] = with_views(
    f"SELECT pos, cand_pos, score FROM ({_RANKED}) r WHERE rank = 1 AND score >= {D(K.CONFIDENCE_THRESHOLD)}", "candidates")

# The previous row of a centre's id, the last one by position
_HISTORY = f"""{chain().strip()},
prev AS (SELECT * FROM (SELECT id, latitude, longitude, lower(name) AS pname, address, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS rn
  FROM existing WHERE id <> '') x WHERE rn = 1),
hist0 AS (SELECT d.pos, d.cand_pos, lower(c.name) AS a, coalesce(p.pname, '') AS b, p.id IS NOT NULL AS has, p.address AS paddr,
  CASE WHEN p.latitude IS NOT NULL AND p.longitude IS NOT NULL THEN {hav_sql('d.latitude', 'd.longitude', 'p.latitude', 'p.longitude')} END AS dist
  FROM decided d JOIN centres c ON c.pos = d.pos LEFT JOIN prev p ON p.id = c.id),
{lcs('SELECT a, b FROM hist0')},
hist AS (SELECT h.pos, CAST(h.cand_pos AS INTEGER) AS cand_pos, has AS has_previous_data, coalesce(dist <= 1.0, false) AS matches_previous,
  dist AS distance_from_previous, has AND coalesce(paddr, '') <> '' AS address_changed,
  has AND h.b <> '' AND {_ratio('l.n', 'h.a', 'h.b')} < 70 AS name_changed, coalesce(dist > {D(K.LARGE_MOVEMENT_KM)}, false) AS large_movement
  FROM hist0 h JOIN lcs l ON l.a = h.a AND l.b = h.b)"""
_HV = ("centres", "candidates", "cities", "existing")
ORACLE["historical_evidence"] = with_views(_query(
    _HISTORY, "SELECT * REPLACE (round(distance_from_previous, 6) AS distance_from_previous) FROM hist"), *_HV)
ORACLE["fusion_historical"] = with_views(_query(_HISTORY, f"""
SELECT pos, cand_pos, round(CASE WHEN NOT has_previous_data THEN {D(0.5)} ELSE greatest({D(0)}, least({D(1)},
 CASE WHEN matches_previous THEN {D(0.5)} ELSE {D(0)} END
 + CASE WHEN distance_from_previous IS NULL THEN {D(0)} WHEN distance_from_previous <= 1 THEN {D(0.3)}
   WHEN distance_from_previous <= 5 THEN {D(0.2)} WHEN distance_from_previous <= 20 THEN {D(0.1)}
   WHEN distance_from_previous > {D(K.LARGE_MOVEMENT_KM)} THEN {D(-0.2)} ELSE {D(0)} END
 - CASE WHEN name_changed THEN {D(0.1)} ELSE {D(0)} END - CASE WHEN address_changed THEN {D(0.05)} ELSE {D(0)} END
 - CASE WHEN large_movement THEN {D(0.3)} ELSE {D(0)} END)) END, 6) AS historical_score FROM hist"""), *_HV)
