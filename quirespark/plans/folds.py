"""SQL twins of the page-local folds, for DuckDB: common table expressions that walk the state of every page at once."""

from __future__ import annotations

_BOX = "'x1': {a}.x1, 'y1': {a}.y1, 'x2': {a}.x2, 'y2': {a}.y2"
_UNION = "'x1': least(cur.x1, todo[1].x1), 'y1': least(cur.y1, todo[1].y1), 'x2': greatest(cur.x2, todo[1].x2), 'y2': greatest(cur.y2, todo[1].y2)"


def _near(a: str, b: str, distance: float) -> str:
    return f"sqrt(pow(greatest({a}.x1 - {b}.x2, {b}.x1 - {a}.x2, 0), 2) + pow(greatest({a}.y1 - {b}.y2, {b}.y1 - {a}.y2, 0), 2)) < {distance}"


def merged_texts(texts: str, tables: str, distance: float = 5.0) -> str:
    """mt (page, ord, e): texts (page, idx, box, content) of which no two that are away from tables are near. Prefix mt_.

    A step compares the growing text `cur` with the first of `todo`; what doesn't join waits in `rest`. Sweeps end with one that changed nothing.
    """
    free = " AND ".join(f"len(list_filter(guards, lambda g: {_near(a, 'g', distance)})) = 0" for a in ("cur", "todo[1]"))
    return f"""mt_x AS (SELECT a.page, list({{{_BOX.format(a='a')}, 'c': a.content, 'n': CAST(1 AS BIGINT)}} ORDER BY a.idx) AS e FROM {texts} a GROUP BY a.page),
 mt_g AS (SELECT a.page, list({{{_BOX.format(a='a')}}}) AS guards FROM {tables} a GROUP BY a.page),
 mt_w AS (
  SELECT mt_x.page, coalesce(guards, []) AS guards, e[1] AS cur, e[2:] AS todo, e[:0] AS rest, e[:0] AS done, false AS changed, false AS over FROM mt_x LEFT JOIN mt_g ON mt_x.page = mt_g.page
  UNION ALL
  SELECT page, guards,
   CASE WHEN joins THEN {{{_UNION}, 'c': cur.c || ' ' || todo[1].c, 'n': cur.n + todo[1].n}} WHEN len(todo) > 0 THEN cur WHEN len(rest) > 0 THEN rest[1] ELSE list_append(done, cur)[1] END,
   CASE WHEN len(todo) > 0 THEN todo[2:] WHEN len(rest) > 0 THEN rest[2:] ELSE list_append(done, cur)[2:] END,
   CASE WHEN joins THEN rest WHEN len(todo) > 0 THEN list_append(rest, todo[1]) ELSE rest[:0] END,
   CASE WHEN len(todo) > 0 THEN done WHEN len(rest) > 0 OR NOT changed THEN list_append(done, cur) ELSE done[:0] END,
   CASE WHEN len(todo) > 0 OR len(rest) > 0 THEN changed OR joins ELSE false END,
   len(todo) = 0 AND len(rest) = 0 AND NOT changed
  FROM (SELECT *, CASE WHEN len(todo) > 0 THEN {_near('cur', 'todo[1]', distance)} AND {free} ELSE false END AS joins FROM mt_w WHERE NOT over)),
 mt AS (SELECT page, CAST(unnest(range(len(done))) AS BIGINT) AS ord, unnest(done) AS e FROM mt_w WHERE over)"""


def vector_graphics(elements: str, side: float = 30.0, rounds: int = 10) -> str:
    """vg (page, ord, e): elements (page, idx, type, box) with dense groups of lines and images merged. Prefix vg_."""
    half = side / 2
    wide = f"least(cx + {half}, e[j].x2) - greatest(cx - {half}, e[j].x1)".replace("cx", "m[i].x")
    high = f"least(cy + {half}, e[j].y2) - greatest(cy - {half}, e[j].y1)".replace("cy", "m[i].y")
    area = f"least({side * side}, (e[j].x2 - e[j].x1) * (e[j].y2 - e[j].y1))"
    inside = f"(abs(m[j].x - m[i].x) <= {half} AND abs(m[j].y - m[i].y) <= {half})"
    dense = f"({wide} > 0 AND {high} > 0 AND {area} > 0 AND ({wide}) * ({high}) / {area} > 0.1)"

    def united(groups: str, same: str) -> str:
        """A fold over sets, each wrapped in a list: a set goes into the first of the groups so far that it is the same as."""
        home = f"list_position(list_transform(acc, lambda g: {same}), true)"
        into = f"list_transform(range(1, len(acc) + 1), lambda k: CASE WHEN k = {home} THEN list_distinct(list_concat(acc[k], w[1])) ELSE acc[k] END)"
        return f"CASE WHEN len({groups}) = 0 THEN [] ELSE list_reduce(list_transform({groups}, lambda g: [g]), lambda acc, w: CASE WHEN coalesce({home}, 0) = 0 THEN list_append(acc, w[1]) ELSE {into} END) END"

    kinds = "list_transform({g}, lambda i: e[i].t)"
    least = lambda f, c: f"list_{f}(list_transform(g, lambda i: e[i].{c}))"
    types = f"array_to_string(list_sort(list_transform(list_distinct({kinds.format(g='g')}), lambda t: t || ':' || len(list_filter(g, lambda i: e[i].t = t)))), ',')"
    made = f"{{'t': 'vector_graphic', 'x1': {least('min', 'x1')}, 'y1': {least('min', 'y1')}, 'x2': {least('max', 'x2')}, 'y2': {least('max', 'y2')}, 'types': {types}, 'n': CAST(len(g) AS BIGINT)}}"
    return f"""vg_w AS (
  SELECT a.page, 0 AS round, list({{'t': a.type, {_BOX.format(a='a')}, 'types': CAST(NULL AS VARCHAR), 'n': CAST(NULL AS BIGINT)}} ORDER BY a.idx) AS e, false AS over FROM {elements} a GROUP BY a.page
  UNION ALL
  SELECT page, round + 1, CASE WHEN len(valid) = 0 THEN e ELSE list_concat(list_transform(valid, lambda g: {made}),
    list_transform(list_filter(range(1, len(e) + 1), lambda i: NOT list_contains(flatten(valid), i)), lambda i: e[i])) END, len(valid) = 0
  FROM (SELECT *, list_filter(groups, lambda g: len(g) > 1 AND list_contains({kinds.format(g='g')}, 'original_line') AND list_contains({kinds.format(g='g')}, 'image')) AS valid
   FROM (SELECT *, {united('listed', 'list_has_any(g, w[1])')} AS groups
    FROM (SELECT *, {united('met', '2 * len(list_intersect(w[1], g)) > len(w[1])')} AS listed
     FROM (SELECT *, list_filter(list_transform(range(1, len(e) + 1), lambda i: list_filter(range(1, len(e) + 1), lambda j: j = i OR {inside} OR {dense})), lambda g: len(g) > 1) AS met
      FROM (SELECT *, list_transform(e, lambda r: {{'x': (r.x1 + r.x2) / 2, 'y': (r.y1 + r.y2) / 2}}) AS m FROM vg_w WHERE NOT over AND round < {rounds})))))),
 vg_l AS (SELECT page, arg_max(e, round) AS e FROM vg_w GROUP BY page),
 vg AS (SELECT page, CAST(unnest(range(len(e))) AS BIGINT) AS ord, unnest(e) AS e FROM vg_l)"""
