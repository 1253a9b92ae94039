"""Pieces of SQL for the oracle statements."""

from __future__ import annotations

from collections.abc import Sequence

from .fixtures import ROOM, SQL
from .rooms import Door

Poly = Sequence[tuple[float, float]]


def query(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SQL.strip(), *[c.strip() for c in ctes if c.strip()]]) + "\n" + body


def recursive(body: str, *ctes: str) -> str:
    return query(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def edges(poly: Poly) -> list[tuple[float, float, float, float]]:
    return [(*poly[k], *poly[(k + 1) % len(poly)]) for k in range(len(poly))]


def inside(x: str, y: str, poly: Poly) -> str:
    """Ray cast over the edges of a literal polygon."""
    parts = [f"CAST((({by:.1f} > {y}) <> ({ay:.1f} > {y})) AND {x} < ({ax:.1f} - {bx:.1f}) * ({y} - {by:.1f}) / {(ay - by) or 1e-12:.12f} + {bx:.1f} AS INT)" for ax, ay, bx, by in edges(poly)]
    return "((" + " + ".join(parts) + ") % 2 = 1)"


def distance(x: str, y: str, poly: Poly) -> str:
    """Distance to a literal outline."""
    parts = []
    for ax, ay, bx, by in edges(poly):
        dx, dy = bx - ax, by - ay
        t = f"greatest(0.0, least(1.0, (({x} - {ax:.1f}) * {dx:.1f} + ({y} - {ay:.1f}) * {dy:.1f}) / {dx * dx + dy * dy:.1f}))"
        parts.append(f"sqrt(power({x} - ({ax:.1f} + {t} * {dx:.1f}), 2) + power({y} - ({ay:.1f} + {t} * {dy:.1f}), 2))")
    return "least(" + ", ".join(parts) + ")"


def any_inside(x: str, y: str, polys: Sequence[Poly]) -> str:
    return "(" + " OR ".join(inside(x, y, p) for p in polys) + ")"


def door_index(x: str, y: str, doors: Sequence[Door]) -> str:
    nearest = " ".join(
        f"WHEN {' AND '.join(f'{_square(x, y, d)} <= {_square(x, y, e)}' for e in doors)} THEN {k}" for k, d in enumerate(doors)
    )
    return "CASE " + " ".join(f"WHEN {inside(x, y, d.polygon)} THEN {k}" for k, d in enumerate(doors)) + f" {nearest} END"


def _square(x: str, y: str, d: Door) -> str:
    return f"(({x} - {d.centre[0]:.6f}) * ({x} - {d.centre[0]:.6f}) + ({y} - {d.centre[1]:.6f}) * ({y} - {d.centre[1]:.6f}))"


# The doors of the fixed room, worked out by hand: each lies at a wall, whose inner side is to the right of +x and above +y.
DOORS = [
    Door(ROOM.doors[0], (41.0, 155.0), (0.0, 1.0), (0.0, -1.0), (1.0, 0.0), "STRAIGHT"),
    Door(ROOM.doors[1], (230.0, 20.0), (-1.0, 0.0), (1.0, 0.0), (0.0, 1.0), "STRAIGHT"),
]
TEAM = f"chosen AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first_frame, track_id) AS entry_number FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n_samples DESC, first_frame, track_id) AS place FROM spans) WHERE place <= {ROOM.team})"
GAPS = """
pairs_ AS (SELECT run_id, lag(entry_number) OVER w AS pair_number, entry_number AS to_entry, lag(track_id) OVER w AS from_track, track_id AS to_track, lag(first_frame) OVER w AS from_frame, first_frame AS to_frame FROM chosen WINDOW w AS (PARTITION BY run_id ORDER BY entry_number)),
gaps AS (SELECT *, (to_frame - from_frame) / 30.0 AS gap_sec, CASE WHEN pair_number = 2 THEN 2.0 ELSE 1.0 END AS allowed_sec FROM pairs_ WHERE pair_number IS NOT NULL),
gap_scores AS (SELECT *, exp(-power(greatest(0.0, gap_sec - allowed_sec), 2) / 0.5) AS score, gap_sec > allowed_sec AS violation FROM gaps)
"""
TOTAL = """
span_ AS (SELECT run_id, count(*) AS n_entries, min(first_frame) AS start_frame, max(first_frame) AS end_frame FROM chosen GROUP BY run_id),
total_ AS (SELECT *, (end_frame - start_frame) / 30.0 AS duration_sec, (n_entries - 1) * 1.0 + CASE WHEN n_entries >= 3 THEN 1.0 ELSE 0.0 END AS limit_sec FROM span_),
total AS (SELECT *, CASE WHEN n_entries < 2 THEN 0.0 WHEN duration_sec <= limit_sec THEN 1.0 WHEN duration_sec - limit_sec >= limit_sec OR limit_sec <= 0 THEN 0.0
  ELSE round(exp(-(duration_sec - limit_sec) / (limit_sec - (duration_sec - limit_sec))), 2) END AS score, n_entries >= 2 AND duration_sec > limit_sec AS violation FROM total_)
"""
_AXIS = {v: "CASE door_index " + " ".join(f"WHEN {k} THEN {getattr(d, v[0])[v[1]]:.6f}" for k, d in enumerate(DOORS)) + " END" for v in [("p_a", 0), ("p_a", 1), ("p_b", 0), ("p_b", 1)]}
VECTORS = f"""
entry_at AS (SELECT run_id, track_id, coalesce(min(CASE WHEN {any_inside("map_x", "map_y", ROOM.doors)} THEN frame END), min(frame)) AS entry_frame FROM positions GROUP BY ALL),
fit_ AS (SELECT run_id, track_id, entry_number, min(entry_frame) AS start_frame, min_by(map_x, frame) AS start_x, min_by(map_y, frame) AS start_y, count(*) AS n_fit,
  regr_slope(map_x, (frame - entry_frame) / 30.0) * 2 AS dx, regr_slope(map_y, (frame - entry_frame) / 30.0) * 2 AS dy
  FROM positions JOIN entry_at USING (run_id, track_id) JOIN chosen USING (run_id, track_id) WHERE frame >= entry_frame AND frame < entry_frame + 60 GROUP BY run_id, track_id, entry_number),
door_ AS (SELECT *, {door_index("start_x", "start_y", DOORS)} AS door_index FROM fit_),
vectors AS (SELECT *, CASE WHEN dx IS NULL OR sqrt(dx * dx + dy * dy) <= 1e-9 THEN 0 WHEN dx * {_AXIS["p_a", 0]} + dy * {_AXIS["p_a", 1]} >= dx * {_AXIS["p_b", 0]} + dy * {_AXIS["p_b", 1]} THEN 1 ELSE -1 END AS sign FROM door_)
"""


def transitions(by_door: bool) -> str:
    part = "run_id, door_index" if by_door else "run_id"
    return f"""turns_ AS (SELECT run_id, lag(entry_number) OVER w AS from_entry, entry_number AS to_entry, lag(sign) OVER w AS from_sign, sign AS to_sign, lag(start_frame) OVER w AS start_frame, start_frame AS end_frame, row_number() OVER w - 1 AS transition_number
  FROM vectors WHERE sign <> 0 WINDOW w AS (PARTITION BY {part} ORDER BY entry_number)),
turns AS (SELECT *, from_sign <> to_sign AS alternates FROM turns_ WHERE from_entry IS NOT NULL)"""
