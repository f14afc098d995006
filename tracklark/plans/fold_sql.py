"""SQL of the queries whose rows depend on what was kept before: recursion over the places of a key's rows."""

from __future__ import annotations

from tracklark.plans.queries import DAY, E_, HOUR

ROWS = f"{E_}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)"

SQL = {
    "spike_filter": f"""WITH RECURSIVE {ROWS}, r AS (SELECT user_id, event_id, t, cents, i, cents AS last, true AS keep FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.event_id, o.t, o.cents, o.i, CASE WHEN abs(o.cents - r.last) <= 2500 THEN o.cents ELSE r.last END, abs(o.cents - r.last) <= 2500 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, event_id, t, cents FROM r WHERE keep""",
    "thin_points": f"""WITH RECURSIVE {ROWS}, r AS (SELECT user_id, event_id, t, i, t AS last, true AS keep FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.event_id, o.t, o.i, CASE WHEN o.t - r.last >= {DAY} THEN o.t ELSE r.last END, o.t - r.last >= {DAY} OR o.i = o.n FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, event_id, t FROM r WHERE keep""",
    "dedupe_box": f"""WITH RECURSIVE {E_}, b AS (SELECT user_id, event_id, t / {HOUR} AS s, cents / 100 AS v, event_id % 7 AS p FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, v, event_id) AS i FROM b),
r AS (SELECT user_id, i, 0 AS g, event_id, s, v, p FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, CASE WHEN near THEN r.g ELSE r.g + 1 END, CASE WHEN near AND o.p <= r.p THEN r.event_id ELSE o.event_id END,
 CASE WHEN near AND o.p <= r.p THEN r.s ELSE o.s END, CASE WHEN near AND o.p <= r.p THEN r.v ELSE o.v END, CASE WHEN near AND o.p <= r.p THEN r.p ELSE o.p END
 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1, LATERAL (SELECT abs(o.s - r.s) <= 3 AND abs(o.v - r.v) <= 3 AS near))
SELECT user_id, event_id, s, v, p FROM r QUALIFY row_number() OVER (PARTITION BY user_id, g ORDER BY i DESC) = 1""",
    "hysteresis_states": f"""WITH RECURSIVE {ROWS}, x AS (SELECT *, CASE WHEN cents < 500 THEN 'stationary' WHEN cents < 1500 THEN 'creeping' ELSE 'moving' END AS instant FROM o),
c AS (SELECT *, CASE WHEN instant IS DISTINCT FROM lag(instant) OVER (PARTITION BY user_id ORDER BY i) THEN i END AS start FROM x), k AS (SELECT *, i - max(start) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) + 1 AS streak FROM c),
r AS (SELECT user_id, event_id, t, instant, i, instant AS state FROM k WHERE i = 1 UNION ALL SELECT k.user_id, k.event_id, k.t, k.instant, k.i, CASE WHEN k.instant <> r.state AND streak >= CASE k.instant WHEN 'stationary' THEN 3 ELSE 2 END THEN k.instant ELSE r.state END
 FROM r JOIN k ON k.user_id = r.user_id AND k.i = r.i + 1) SELECT user_id, event_id, t, instant, state FROM r""",
    "stationary_lock": f"""WITH RECURSIVE {ROWS}, x AS (SELECT user_id, event_id, i, t / 1e6 / 3600 AS h, cents / 1000 AS speed FROM o),
r AS (SELECT user_id, i, CASE WHEN speed <= 1 THEN 'stopping' ELSE 'moving' END AS state, CASE WHEN speed <= 1 THEN i END AS since, CASE WHEN speed <= 1 THEN h END AS since_h, NULL::BIGINT AS lock_from, NULL::BIGINT AS free_from FROM x WHERE i = 1
UNION ALL SELECT user_id, i, CASE WHEN s1 = 'stopping' AND h - h1 >= 6 THEN 'stopped' WHEN s1 = 'starting' AND h - h1 >= 6 THEN 'moving' ELSE s1 END, CASE WHEN s1 IN ('stopping', 'starting') AND h - h1 < 6 THEN i1 END, CASE WHEN s1 IN ('stopping', 'starting') AND h - h1 < 6 THEN h1 END,
 CASE WHEN s1 = 'stopping' AND h - h1 >= 6 THEN i1 END, CASE WHEN s1 = 'starting' AND h - h1 >= 6 THEN i1 END FROM
 (SELECT x.user_id, x.i, x.h, s1, CASE WHEN r.state = s1 THEN r.since ELSE x.i END AS i1, CASE WHEN r.state = s1 THEN r.since_h ELSE x.h END AS h1 FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1,
  LATERAL (SELECT CASE WHEN r.state IN ('moving', 'stopping') THEN CASE WHEN x.speed <= 1 THEN 'stopping' ELSE 'moving' END ELSE CASE WHEN x.speed >= 2 THEN 'starting' ELSE 'stopped' END END AS s1))),
m AS (SELECT user_id, lock_from AS i, 1 AS lock FROM r WHERE lock_from IS NOT NULL UNION ALL SELECT user_id, free_from, 0 FROM r WHERE free_from IS NOT NULL)
SELECT x.user_id, x.event_id, x.h, x.speed, coalesce(m.lock, 0) = 1 AS locked FROM x ASOF LEFT JOIN m ON x.user_id = m.user_id AND x.i >= m.i""",
    "pose_sections": f"""WITH RECURSIVE {ROWS}, x AS (SELECT user_id, event_id, i, t / {HOUR} AS h, (cents % 1000)::DOUBLE AS east, (floor(cents / 1000) * 10)::DOUBLE AS north, cents FROM o),
p AS (SELECT *, h - lag(h) OVER w AS dt, sqrt((east - lag(east) OVER w) ** 2 + (north - lag(north) OVER w) ** 2) / greatest(h - lag(h) OVER w, 1e-6) AS speed FROM x WINDOW w AS (PARTITION BY user_id ORDER BY i)),
r AS (SELECT user_id, event_id, h, east, north, cents, i, 0 AS section, NULL::VARCHAR AS reason, []::DOUBLE[] AS past FROM p WHERE i = 1
UNION ALL SELECT p.user_id, p.event_id, p.h, p.east, p.north, p.cents, p.i, r.section + CASE WHEN why IS NULL THEN 0 ELSE 1 END, why, CASE WHEN why IS NULL THEN list_append(r.past, p.speed)[-5:] ELSE []::DOUBLE[] END
 FROM r JOIN p ON p.user_id = r.user_id AND p.i = r.i + 1, LATERAL (SELECT CASE WHEN p.dt > 24 THEN 'timeGap' WHEN p.speed > 2000 THEN 'speed' WHEN len(r.past) > 0 AND p.speed > 4 * greatest(list_median(r.past), 1) THEN 'jump' END AS why))
SELECT user_id, event_id, h, east, north, cents, section::BIGINT AS section, reason FROM r""",
    "motion_headings": f"""WITH {ROWS}, x AS (SELECT user_id, event_id, i, t / {HOUR} AS h, (cents % 1000)::DOUBLE AS east, (floor(cents / 1000) * 10)::DOUBLE AS north, (cents % 360)::DOUBLE AS reported FROM o),
m AS (SELECT *, sqrt((east - lag(east) OVER w) ** 2 + (north - lag(north) OVER w) ** 2) AS step, h - lag(h) OVER w AS dt, coalesce(lead(east) OVER w, east) - coalesce(lag(east) OVER w, east) AS de, coalesce(lead(north) OVER w, north) - coalesce(lag(north) OVER w, north) AS dn FROM x WINDOW w AS (PARTITION BY user_id ORDER BY h, event_id)),
c AS (SELECT *, CASE WHEN dt > 0 AND step / dt >= 20 THEN reported WHEN sqrt(de * de + dn * dn) >= 1e-6 THEN (degrees(atan2(de, dn)) + 360) % 360 END AS own, CASE WHEN dt > 0 AND step / dt >= 20 THEN 'reported' WHEN sqrt(de * de + dn * dn) >= 1e-6 THEN 'motion' END AS how FROM m),
l AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY h, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM c)
SELECT event_id, round(coalesce(own, past), 6) AS heading, CASE WHEN own IS NOT NULL THEN how WHEN past IS NOT NULL THEN 'fallback' END AS heading_source FROM l""",
}
