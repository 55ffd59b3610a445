"""The same queries as plain SQL over `events`, for checking results on another engine.

The statements follow the definitions row by row (a running maximum over the whole arrival order),
not the distributed way the library computes them.
"""

from tallyward.policy import CORRECTION_JOB
from tallyward.sources.trips import delay_limits

STREET, HARBOR = delay_limits("street"), delay_limits("harbor")


def _drawn(kind: str) -> str:
    return f"draw < CASE WHEN user_id % 6 >= 4 THEN {HARBOR[kind]} ELSE {STREET[kind]} END"


TRIPS = f"""
trips AS (
  SELECT event_id AS trip_seq, CAST(event_id AS VARCHAR) AS trip_id,
    CASE user_id % 6 WHEN 0 THEN 'downtown' WHEN 1 THEN 'airport' WHEN 2 THEN 'university'
      WHEN 3 THEN 'waterfront' WHEN 4 THEN 'harbor_north' ELSE 'harbor_tunnel' END AS zone,
    ts AS event_time,
    CASE
      WHEN {_drawn("normal")}
        THEN ts + to_milliseconds(1000 + event_id * 31 % 4001)
      WHEN {_drawn("tunnel")} THEN ts + to_milliseconds(120000 + event_id * 6151 % 360001)
      WHEN {_drawn("very_late")} THEN ts + to_milliseconds(1200000 + event_id * 9973 % 2400001)
      ELSE date_trunc('day', ts) + to_milliseconds(108000000 + event_id * 7907 % 10800001)
    END AS processing_time,
    value AS fare,
    CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN CAST(1.0 + 0.25 * (event_id % 5) AS DOUBLE) END
      AS surge_multiplier
  FROM (SELECT *, (event_id * 7919 + 104729) % 1000 AS draw FROM events)
)"""

STREAM = (
    TRIPS
    + """,
arrived AS (
  SELECT *,
    time_bucket(INTERVAL 15 MINUTE, event_time, TIMESTAMP '1970-01-01') AS window_start,
    time_bucket(INTERVAL 15 MINUTE, processing_time, TIMESTAMP '1970-01-01') AS arrival_window,
    row_number() OVER (ORDER BY processing_time, trip_seq) AS position,
    max(event_time) OVER (ORDER BY processing_time, trip_seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_before
  FROM trips
),
flagged AS (
  SELECT *, max_before - INTERVAL 2 MINUTE AS watermark, (position - 1) // 500 + 1 AS batch_id,
    coalesce(window_start + INTERVAL 25 MINUTE <= max_before - INTERVAL 2 MINUTE, false) AS is_late
  FROM arrived
),
clocks AS (SELECT max(event_time) AS max_event, max(processing_time) AS max_processing FROM trips),
event_windows AS (
  SELECT zone, window_start, count(*) AS trip_count FROM flagged WHERE NOT is_late GROUP BY ALL
),
arrival_windows AS (
  SELECT zone, arrival_window AS window_start, count(*) AS trip_count FROM flagged GROUP BY ALL
),
event_closed AS (
  SELECT w.* FROM event_windows w, clocks WHERE window_start + INTERVAL 27 MINUTE <= max_event
),
arrival_closed AS (
  SELECT w.* FROM arrival_windows w, clocks WHERE window_start + INTERVAL 15 MINUTE <= max_processing
),
event_open AS (SELECT * FROM event_windows EXCEPT ALL SELECT * FROM event_closed),
arrival_open AS (SELECT * FROM arrival_windows EXCEPT ALL SELECT * FROM arrival_closed),
late AS (SELECT * FROM flagged WHERE is_late),
aligned AS (
  SELECT zone, window_start, coalesce(e.trip_count, 0) AS event, coalesce(p.trip_count, 0) AS processing,
    coalesce(p.trip_count, 0) - coalesce(e.trip_count, 0) AS diff
  FROM event_closed e FULL OUTER JOIN arrival_closed p USING (zone, window_start)
),
late_windows AS (SELECT zone, window_start, count(*) AS late FROM late GROUP BY ALL),
completeness AS (
  SELECT zone, window_start, coalesce(e.trip_count, 0) AS on_time, coalesce(l.late, 0) AS late,
    coalesce(e.trip_count, 0)::DOUBLE / (coalesce(e.trip_count, 0) + coalesce(l.late, 0)) AS completeness,
    coalesce(e.trip_count, 0)::DOUBLE / (coalesce(e.trip_count, 0) + coalesce(l.late, 0)) < 0.97 AS flagged
  FROM event_closed e FULL OUTER JOIN late_windows l USING (zone, window_start)
)"""
)

BATCHES = (
    STREAM
    + """,
batch_ends AS (
  SELECT batch_id, max(greatest(event_time, coalesce(max_before, event_time))) AS max_event,
    max(processing_time) AS max_processing
  FROM flagged GROUP BY batch_id
),
event_starts AS (
  SELECT window_start, min(batch_id) AS batch_id
  FROM (SELECT DISTINCT window_start FROM event_closed) w
  JOIN batch_ends b ON w.window_start + INTERVAL 27 MINUTE <= b.max_event GROUP BY window_start
),
arrival_starts AS (
  SELECT window_start, min(batch_id) AS batch_id
  FROM (SELECT DISTINCT window_start FROM arrival_closed) w
  JOIN batch_ends b ON w.window_start + INTERVAL 15 MINUTE <= b.max_processing GROUP BY window_start
),
emitted AS (
  SELECT 'event' AS clock, zone, window_start, trip_count, batch_id
  FROM event_closed JOIN event_starts USING (window_start)
  UNION ALL
  SELECT 'processing', zone, window_start, trip_count, batch_id
  FROM arrival_closed JOIN arrival_starts USING (window_start)
)"""
)

LOG = (
    STREAM
    + """,
good AS (
  SELECT zone, window_start, trip_count,
    CAST(CASE WHEN window_start < TIMESTAMP '2024-01-02' THEN 1
      WHEN window_start < TIMESTAMP '2024-01-03' THEN 2 ELSE 3 END AS BIGINT) AS batch_id
  FROM event_closed
),
rebuilt AS (
  SELECT zone, window_start, late AS trip_count, CAST(NULL AS BIGINT) AS batch_id FROM late_windows
  WHERE window_start >= TIMESTAMP '2024-01-02' AND window_start < TIMESTAMP '2024-01-03'
),
bad AS (SELECT * FROM good WHERE batch_id <> 2 UNION ALL SELECT * FROM rebuilt),
rows_of AS (
  SELECT (SELECT count(*) FROM good WHERE batch_id = 1) AS n1, (SELECT count(*) FROM good WHERE batch_id = 2) AS n2,
    (SELECT count(*) FROM good WHERE batch_id = 3) AS n3, (SELECT count(*) FROM rebuilt) AS nb
),
history AS (
  SELECT 0::BIGINT AS version, 'WRITE' AS operation, 'Append' AS mode, n1 AS rows_added, 0::BIGINT AS rows_removed,
    NULL::VARCHAR AS job FROM rows_of
  UNION ALL SELECT 1, 'WRITE', 'Append', n2, 0, NULL FROM rows_of
  UNION ALL SELECT 2, 'WRITE', 'Append', n3, 0, NULL FROM rows_of
  UNION ALL SELECT 3, 'WRITE', 'Overwrite', nb, n2, '"""
    + CORRECTION_JOB
    + """' FROM rows_of
  UNION ALL SELECT 4, 'RESTORE', '', n2, nb, NULL FROM rows_of
)"""
)

DELAYS = (
    TRIPS
    + """,
classed AS (
  SELECT *, CASE
      WHEN delay_us BETWEEN 1000000 AND 5000000 THEN 'normal'
      WHEN delay_us BETWEEN 120000000 AND 480000000 THEN 'tunnel'
      WHEN delay_us BETWEEN 1200000000 AND 3600000000 THEN 'very_late'
      WHEN processing_time BETWEEN date_trunc('day', event_time) + INTERVAL 30 HOUR
        AND date_trunc('day', event_time) + INTERVAL 33 HOUR THEN 'next_morning'
      ELSE 'other' END AS delay_class
  FROM (SELECT *, epoch_us(processing_time) - epoch_us(event_time) AS delay_us FROM trips)
)"""
)

_COUNTS = "SELECT zone, window_start, trip_count FROM"
_OPEN = f"""SELECT 'event' AS clock, zone, window_start, trip_count FROM event_open
UNION ALL SELECT 'processing', zone, window_start, trip_count FROM arrival_open"""
_LATE_EVENTS = """SELECT trip_seq, trip_id, zone, event_time, processing_time, fare, surge_multiplier, window_start,
  window_start + INTERVAL 15 MINUTE AS window_end, watermark,
  ((epoch_us(watermark) - epoch_us(event_time) + 500) // 1000) / 1000.0::DOUBLE AS lateness_seconds
FROM late"""
_COVERAGE = """SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS event_day, count(*) AS trips, count(surge_multiplier) AS with_value,
  count(*) - count(surge_multiplier) AS without_value FROM trips GROUP BY 1"""


def _with(tables: str, select: str) -> str:
    return f"WITH {tables.strip()}\n{select.strip()}"


ORACLE = {
    "trip_window_assign": _with(
        STREAM,
        """SELECT trip_seq, zone, window_start, window_start + INTERVAL 15 MINUTE AS window_end,
  window_start + INTERVAL 25 MINUTE AS closes_at, arrival_window AS arrival_window_start FROM arrived""",
    ),
    "watermark_at_arrival": _with(STREAM, "SELECT trip_seq, position, batch_id, watermark FROM flagged"),
    "late_events": _with(STREAM, _LATE_EVENTS),
    "zone_counts_event_time": _with(STREAM, f"{_COUNTS} event_closed"),
    "zone_counts_processing_time": _with(STREAM, f"{_COUNTS} arrival_closed"),
    "open_windows": _with(STREAM, _OPEN),
    "conservation": _with(
        STREAM,
        """SELECT n AS events, c AS on_time, l AS late, o AS still_open, c + l + o = n AS balanced FROM (
  SELECT (SELECT count(*) FROM trips) AS n,
    (SELECT coalesce(sum(trip_count), 0)::BIGINT FROM event_closed) AS c,
    (SELECT count(*) FROM late) AS l,
    (SELECT coalesce(sum(trip_count), 0)::BIGINT FROM event_open) AS o)""",
    ),
    "window_span": _with(
        STREAM,
        """SELECT clock, count(*) AS windows, min(window_start) AS first_start,
  max(window_start) + INTERVAL 15 MINUTE AS last_end
FROM (SELECT 'event' AS clock, window_start FROM event_closed
  UNION ALL SELECT 'processing', window_start FROM arrival_closed) GROUP BY clock""",
    ),
    "through_day_windows": _with(
        STREAM,
        """SELECT zone, window_start, count(*) AS trip_count FROM flagged
WHERE processing_time < TIMESTAMP '2024-01-03' AND NOT is_late AND window_start + INTERVAL 27 MINUTE <=
  (SELECT max(event_time) FROM trips WHERE processing_time < TIMESTAMP '2024-01-03')
GROUP BY zone, window_start""",
    ),
    "emission_batch": _with(BATCHES, "SELECT clock, zone, window_start, trip_count, batch_id FROM emitted"),
    "batch_summary": _with(
        BATCHES,
        """SELECT b.*, e.max_event AS max_event_time, e.max_event - INTERVAL 2 MINUTE AS watermark,
  coalesce(event_windows, 0) AS event_windows, event_first_start, event_last_end,
  coalesce(processing_windows, 0) AS processing_windows, processing_first_start, processing_last_end
FROM (SELECT batch_id, min(position) AS first_row, max(position) AS last_row,
    min(processing_time) AS first_arrival, max(processing_time) AS last_arrival,
    count(*) FILTER (is_late) AS late FROM flagged GROUP BY batch_id) b
JOIN batch_ends e USING (batch_id)
LEFT JOIN (SELECT batch_id,
    count(*) FILTER (clock = 'event') AS event_windows,
    min(window_start) FILTER (clock = 'event') AS event_first_start,
    max(window_start) FILTER (clock = 'event') + INTERVAL 15 MINUTE AS event_last_end,
    count(*) FILTER (clock = 'processing') AS processing_windows,
    min(window_start) FILTER (clock = 'processing') AS processing_first_start,
    max(window_start) FILTER (clock = 'processing') + INTERVAL 15 MINUTE AS processing_last_end
  FROM emitted GROUP BY batch_id) c USING (batch_id)""",
    ),
    "batch_zone_totals": _with(
        BATCHES,
        """SELECT batch_id, CASE WHEN grouping(zone) = 1 THEN 'TOTAL' ELSE zone END AS zone,
  coalesce(sum(trip_count) FILTER (clock = 'event'), 0)::BIGINT AS event_trips,
  coalesce(sum(trip_count) FILTER (clock = 'processing'), 0)::BIGINT AS processing_trips
FROM emitted GROUP BY GROUPING SETS ((batch_id, zone), (batch_id))""",
    ),
    "late_by_batch": _with(
        STREAM,
        """SELECT batch_id, zone, late, row_number() OVER (PARTITION BY batch_id ORDER BY late DESC, zone) AS place
FROM (SELECT batch_id, zone, count(*) AS late FROM late GROUP BY batch_id, zone)""",
    ),
    "late_examples_per_batch": _with(
        STREAM,
        """SELECT batch_id, place, zone, trip_seq, event_time, processing_time,
  delay // 60 AS delay_hours, delay % 60 AS delay_minutes, lateness_seconds, greatest(n - 5, 0) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY position) AS place,
    count(*) OVER (PARTITION BY batch_id) AS n,
    CAST(round_even((epoch_us(processing_time) - epoch_us(event_time)) / 60000000.0::DOUBLE, 0) AS BIGINT) AS delay,
    ((epoch_us(watermark) - epoch_us(event_time) + 500) // 1000) / 1000.0::DOUBLE AS lateness_seconds
  FROM late) WHERE place <= 5""",
    ),
    "event_vs_processing": _with(STREAM, "SELECT zone, window_start, event, processing, diff FROM aligned"),
    "event_vs_processing_busiest": _with(
        STREAM,
        """SELECT window_start, a.event AS first_event, a.processing AS first_processing, a.diff AS first_diff,
  b.event AS second_event, b.processing AS second_processing, b.diff AS second_diff
FROM (SELECT * FROM aligned WHERE zone = 'harbor_tunnel') a
JOIN (SELECT * FROM aligned WHERE zone = 'downtown') b USING (window_start)
ORDER BY a.event + b.event DESC, window_start LIMIT 8""",
    ),
    "disagreement_share": _with(
        STREAM,
        """SELECT zone, count(*) AS windows,
  (count(*) FILTER (diff <> 0))::DOUBLE / count(*) AS disagree_share FROM aligned GROUP BY zone""",
    ),
    "hourly_rollup": _with(
        STREAM,
        """SELECT CAST(date_part('hour', window_start) AS INTEGER) AS hour, sum(trip_count)::BIGINT AS trips
FROM event_closed GROUP BY 1""",
    ),
    "late_by_zone": _with(
        STREAM, "SELECT zone, count(*) AS events, count(*) FILTER (is_late) AS late FROM flagged GROUP BY zone"
    ),
    "side_output_rate": _with(
        STREAM,
        """SELECT CASE WHEN grouping(zone) = 1 THEN 'ALL ZONES' ELSE zone END AS zone, count(*) AS events,
  count(*) FILTER (is_late) AS late, (count(*) FILTER (is_late))::DOUBLE / count(*) AS rate
FROM flagged GROUP BY ROLLUP (zone)""",
    ),
    "completeness_by_window": _with(
        STREAM, "SELECT zone, window_start, on_time, late, completeness, flagged FROM completeness"
    ),
    "completeness_by_zone": _with(
        STREAM,
        """SELECT zone, count(*) AS windows, sum(on_time)::BIGINT AS on_time, sum(late)::BIGINT AS late,
  count(*) FILTER (flagged) AS flagged, sum(on_time)::DOUBLE / (sum(on_time) + sum(late))::DOUBLE AS overall,
  (count(*) FILTER (flagged))::DOUBLE / count(*) AS flagged_share
FROM completeness GROUP BY zone""",
    ),
    "worst_windows": _with(
        STREAM,
        """SELECT zone, window_start, on_time, late, completeness, flagged FROM completeness WHERE flagged
ORDER BY completeness, late DESC, zone, window_start LIMIT 8""",
    ),
    "delay_profile": _with(
        DELAYS,
        """SELECT delay_class, count(*) AS events, count(*)::DOUBLE / (SELECT count(*) FROM classed) AS share
FROM classed GROUP BY delay_class""",
    ),
    "zone_tunnel_share": _with(
        DELAYS,
        """SELECT zone, count(*) AS events,
  (count(*) FILTER (delay_class = 'tunnel'))::DOUBLE / count(*) AS share FROM classed GROUP BY zone""",
    ),
    "delay_class_examples": _with(
        DELAYS,
        """SELECT delay_class, trip_seq, trip_id, zone, event_time, processing_time, fare, surge_multiplier
FROM classed WHERE delay_class <> 'tunnel' OR zone IN ('harbor_north', 'harbor_tunnel')
QUALIFY row_number() OVER (PARTITION BY delay_class ORDER BY processing_time, trip_seq) = 1""",
    ),
    "day_filter": _with(
        TRIPS,
        """SELECT part, count(*) AS trips, min(event_time) AS first, max(event_time) AS last,
  strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS first_text
FROM (SELECT *, CASE WHEN event_time >= TIMESTAMP '2024-01-02' AND event_time < TIMESTAMP '2024-01-03'
    THEN 'inside' ELSE 'outside' END AS part FROM trips WHERE zone = 'harbor_tunnel') GROUP BY part""",
    ),
    "surge_coverage": _with(
        TRIPS,
        """SELECT zone, count(surge_multiplier) / count(*) AS known_share, max(surge_multiplier) AS highest,
  min(CASE WHEN surge_multiplier > 1 THEN event_time END) AS first_above_one FROM trips GROUP BY zone""",
    ),
    "version_by_sql": _with(
        LOG,
        """SELECT zone, count(*) AS windows, sum(trip_count)::BIGINT AS trips, max(window_start) AS newest
FROM good WHERE batch_id <= 2 GROUP BY zone""",
    ),
    "restored_equals_good_rows": "SELECT false AS bad_equals_good, true AS restored_equals_good, false AS empty",
    "stream_conservation": _with(
        STREAM,
        """SELECT count(*) AS rows, count(*) FILTER (WHERE is_late) AS late,
  count(*) FILTER (WHERE NOT is_late AND window_start + INTERVAL 27 MINUTE <= newest) AS on_time,
  count(*) FILTER (WHERE NOT is_late AND window_start + INTERVAL 27 MINUTE > newest) AS still_open, true AS balanced
FROM (SELECT *, max(event_time) OVER () AS newest FROM flagged WHERE processing_time < TIMESTAMP '2024-01-03')""",
    ),
    "surge_coverage_by_day": _with(TRIPS, _COVERAGE),
    "surge_samples": _with(
        TRIPS,
        """SELECT sample, trip_seq, zone, event_time, fare, surge_multiplier FROM (
  SELECT *, row_number() OVER (PARTITION BY sample ORDER BY event_time, trip_seq) AS place
  FROM (SELECT *, CASE WHEN event_time < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS sample FROM trips))
WHERE place <= 4""",
    ),
    "schema_diff": _with(
        TRIPS,
        """SELECT position, "column", type, is_new, rows, non_null FROM (
  SELECT 0 AS position, 'trip_seq' AS "column", 'bigint' AS type, false AS is_new, count(*) AS rows,
    count(trip_seq) AS non_null FROM trips
  UNION ALL SELECT 1, 'trip_id', 'string', false, count(*), count(trip_id) FROM trips
  UNION ALL SELECT 2, 'zone', 'string', false, count(*), count(zone) FROM trips
  UNION ALL SELECT 3, 'event_time', 'timestamp', false, count(*), count(event_time) FROM trips
  UNION ALL SELECT 4, 'processing_time', 'timestamp', false, count(*), count(processing_time) FROM trips
  UNION ALL SELECT 5, 'fare', 'double', false, count(*), count(fare) FROM trips
  UNION ALL SELECT 6, 'batch_id', 'int', false, count(*), count(*) FROM trips
  UNION ALL SELECT 7, 'surge_multiplier', 'double', true, count(*),
    count(CASE WHEN processing_time >= TIMESTAMP '2024-01-16' THEN surge_multiplier END) FROM trips)""",
    ),
    "file_inventory": _with(
        TRIPS,
        """SELECT CASE WHEN processing_time < TIMESTAMP '2024-01-16' THEN 'kept' ELSE 'added' END AS status,
  count(*) AS rows FROM trips GROUP BY 1""",
    ),
    "json_round_trip": _with(
        TRIPS,
        """SELECT zone, count(*) AS trips, count(surge_multiplier) AS with_surge, min(event_time) AS first_event,
  max(processing_time) AS last_arrival, max(fare) AS max_fare FROM trips GROUP BY zone""",
    ),
    "append_once": _with(LOG, "SELECT * FROM good"),
    "replace_where": _with(LOG, "SELECT * FROM bad"),
    "asof_read": _with(LOG, "SELECT * FROM good"),
    "restored_table": _with(LOG, "SELECT * FROM good"),
    "version_diff_hourly": _with(
        LOG,
        """, hours AS (
  SELECT hour,
    coalesce((SELECT sum(trip_count) FROM good WHERE zone = 'harbor_tunnel' AND batch_id = 2
      AND date_part('hour', window_start) = hour), 0)::BIGINT AS before,
    coalesce((SELECT sum(trip_count) FROM rebuilt WHERE zone = 'harbor_tunnel'
      AND date_part('hour', window_start) = hour), 0)::BIGINT AS latest
  FROM range(24) r(hour)
)
SELECT CASE WHEN grouping(hour) = 1 THEN 'TOTAL' ELSE lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' END AS hour,
  sum(before)::BIGINT AS before, sum(latest)::BIGINT AS latest, (sum(before) - sum(latest))::BIGINT AS missing
FROM hours GROUP BY ROLLUP (hour)""",
    ),
    "version_difference": _with(
        LOG,
        """SELECT zone, window_start, trip_count, batch_id, -1::BIGINT AS delta FROM good WHERE batch_id = 2
UNION ALL SELECT zone, window_start, trip_count, batch_id, 1 FROM rebuilt""",
    ),
    "restore_equals_good": _with(
        LOG,
        """, other AS (SELECT sum(trip_count)::BIGINT AS n FROM good WHERE batch_id <> 2),
good_day AS (SELECT sum(trip_count)::BIGINT AS n FROM good WHERE batch_id = 2),
bad_day AS (SELECT sum(trip_count)::BIGINT AS n FROM rebuilt)
SELECT 'good' AS "table", (SELECT n FROM good_day) AS day_trips, (SELECT n FROM other) AS other_trips, true AS equals_good
UNION ALL SELECT 'bad', (SELECT n FROM bad_day), (SELECT n FROM other), false
UNION ALL SELECT 'restored', (SELECT n FROM good_day), (SELECT n FROM other), true""",
    ),
    "commit_history": _with(LOG, "SELECT * FROM history"),
    "commit_summary": _with(
        LOG,
        """SELECT operation, mode, count(*) AS commits, sum(rows_added)::BIGINT AS rows_added,
  sum(rows_removed)::BIGINT AS rows_removed FROM history WHERE version > 1 GROUP BY operation, mode""",
    ),
    "commit_report": _with(
        LOG,
        f"""SELECT version, operation, rows_added,
  CASE WHEN version = 3 THEN '{CORRECTION_JOB}: counts of 2024-01-02 taken from the side output alone'
    WHEN version = 4 THEN 'restored to 2' ELSE '' END AS details FROM history WHERE version >= 2""",
    ),
    "correction_commits": _with(
        LOG,
        """SELECT version - 1 AS good_version, version AS bad_version,
  'counts of 2024-01-02 taken from the side output alone' AS description FROM history WHERE job IS NOT NULL""",
    ),
    "commit_ends": _with(
        LOG,
        """SELECT version, operation, rows_added, rows_removed,
  CASE WHEN version <= 2 THEN 'first' ELSE 'last' END AS "end", 1::BIGINT AS skipped FROM history WHERE version <> 3""",
    ),
    "log_files": _with(
        LOG,
        """SELECT 'kept' AS status, (SELECT count(*) FROM good) AS rows
UNION ALL SELECT 'added', n2 + nb FROM rows_of""",
    ),
    "stream_zone_counts": _with(STREAM, f"{_COUNTS} event_closed"),
    "stream_processing_counts": _with(STREAM, f"{_COUNTS} arrival_closed"),
    "stream_late_events": _with(STREAM, _LATE_EVENTS),
    "stream_open_windows": _with(STREAM, _OPEN),
    "idempotent_replay": _with(
        STREAM,
        """SELECT (SELECT count(*) FROM trips) AS rows, (SELECT count(*) FROM trips) AS trips,
  (SELECT coalesce(sum(trip_count), 0)::BIGINT FROM event_closed) AS on_time,
  (SELECT count(*) FROM late) AS late,
  (SELECT coalesce(sum(trip_count), 0)::BIGINT FROM event_open) AS still_open""",
    ),
}

# What the stream does in micro-batches, and from its stored tallies, has the definition of the batch queries.
ORACLE |= {
    name: ORACLE[same]
    for name, same in {
        "stream_emission_batch": "emission_batch",
        "stream_late_examples": "late_examples_per_batch",
        "stream_batch_summary": "batch_summary",
        "stored_side_output_rate": "side_output_rate",
        "stored_completeness_by_zone": "completeness_by_zone",
        "stored_worst_windows": "worst_windows",
    }.items()
}
ORACLE |= {
    "stream_batch_report": f"""SELECT batch_id, zone, coalesce(event_trips, 0) AS event_trips,
  coalesce(processing_trips, 0) AS processing_trips, coalesce(late, 0) AS late, coalesce(place, 0) AS place
FROM ({ORACLE["batch_zone_totals"]}) FULL JOIN ({ORACLE["late_by_batch"]}) USING (batch_id, zone)""",
    "stop_inside_a_file": _with(
        STREAM
        + """,
parts AS (SELECT * EXCLUDE (batch_id), CASE WHEN processing_time < TIMESTAMP '2024-01-03' THEN 1 ELSE 2 END AS part FROM flagged),
stopped AS (SELECT max(event_time) AS max_event, max(processing_time) AS max_processing FROM parts WHERE part = 1),
event_batches AS (
  SELECT w.*, CASE WHEN window_start + INTERVAL 27 MINUTE <= max_event THEN 1 ELSE 2 END AS batch_id FROM event_closed w, stopped
),
arrival_batches AS (
  SELECT w.*, CASE WHEN window_start + INTERVAL 15 MINUTE <= max_processing THEN 1 ELSE 2 END AS batch_id FROM arrival_closed w, stopped
)""",
        """SELECT batch_id, first_row, last_row, late,
  (SELECT count(*) FROM event_batches e WHERE e.batch_id = b.batch_id) AS event_windows,
  (SELECT coalesce(sum(trip_count), 0)::BIGINT FROM event_batches e WHERE e.batch_id = b.batch_id) AS event_trips,
  (SELECT count(*) FROM arrival_batches e WHERE e.batch_id = b.batch_id) AS processing_windows,
  (SELECT coalesce(sum(trip_count), 0)::BIGINT FROM arrival_batches e WHERE e.batch_id = b.batch_id) AS processing_trips
FROM (SELECT part AS batch_id, min(position) AS first_row, max(position) AS last_row, count(*) FILTER (is_late) AS late
      FROM parts GROUP BY part) b""",
    ),
}

ORACLE |= {
    "native_arrival_counts": ORACLE["zone_counts_processing_time"],
    "late_trip_finished_batch": _with(
        BATCHES,
        """SELECT trip_seq, processing_time, coalesce(b.batch_id, 0) AS finished_batch,
  coalesce(window_start + INTERVAL 27 MINUTE <= b.max_event, false) AS window_emitted
FROM late l ASOF LEFT JOIN batch_ends b ON l.processing_time > b.max_processing""",
    ),
    "hourly_both_clocks": _with(
        STREAM
        + """,
hours AS (
  SELECT hour,
    coalesce((SELECT sum(trip_count) FROM event_closed WHERE zone = 'harbor_tunnel'
      AND window_start >= TIMESTAMP '2024-01-02' AND window_start < TIMESTAMP '2024-01-03'
      AND date_part('hour', window_start) = hour), 0)::BIGINT AS event,
    coalesce((SELECT sum(trip_count) FROM arrival_closed WHERE zone = 'harbor_tunnel'
      AND window_start >= TIMESTAMP '2024-01-02' AND window_start < TIMESTAMP '2024-01-03'
      AND date_part('hour', window_start) = hour), 0)::BIGINT AS processing
  FROM range(24) r(hour)
)""",
        """SELECT CASE WHEN grouping(hour) = 1 THEN 'TOTAL' ELSE lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' END AS hour,
  sum(event)::BIGINT AS event, sum(processing)::BIGINT AS processing, (sum(event) - sum(processing))::BIGINT AS diff
FROM hours GROUP BY ROLLUP (hour)""",
    ),
    "first_and_last_batches": _with(
        BATCHES,
        """SELECT batch_id, trips, last_arrival, CASE WHEN batch_id <= 3 THEN 'first' ELSE 'last' END AS "end",
  greatest(batches - 5, 0) AS skipped
FROM (SELECT batch_id, count(*) AS trips, max(processing_time) AS last_arrival, count(*) OVER () AS batches FROM flagged GROUP BY batch_id)
WHERE batch_id <= 3 OR batch_id > batches - 2""",
    ),
    "table_differences": _with(
        STREAM + """,
changed AS (SELECT * FROM event_closed ORDER BY window_start, zone LIMIT 1)""",
        """SELECT zone, window_start, trip_count, 1::BIGINT AS surplus FROM changed
UNION ALL SELECT zone, window_start, trip_count + 1, -1 FROM changed""",
    ),
    "tables_equal": _with(STREAM, "SELECT true AS copy_equal, false AS changed_equal, count(*) AS rows FROM event_closed"),
    "windows_by_sql_function": _with(
        STREAM,
        """SELECT w.window_start, w.trip_count, count(a.trip_seq) AS arrived,
  max((epoch_us(a.processing_time) - epoch_us(a.event_time)) / 1e6::DOUBLE) AS longest_delay
FROM event_closed w LEFT JOIN trips a ON a.zone = 'harbor_tunnel'
 AND a.processing_time >= w.window_start AND a.processing_time < w.window_start + INTERVAL 15 MINUTE
WHERE w.zone = 'harbor_tunnel' AND w.window_start >= TIMESTAMP '2024-01-02' AND w.window_start < TIMESTAMP '2024-01-03'
GROUP BY ALL""",
    ),
}

ORACLE |= {
    "promoted_field": _with(
        TRIPS,
        """SELECT zone, count(*) AS trips, count(surge_multiplier) AS with_seats,
  sum(CASE WHEN surge_multiplier IS NOT NULL THEN trip_seq % 4 + 1 END)::BIGINT AS seats,
  count(*) FILTER (surge_multiplier IS NOT NULL AND trip_seq % 3 = 0) AS pools,
  min(event_time) FILTER (surge_multiplier IS NOT NULL) AS first_with_seats
FROM trips GROUP BY zone""",
    ),
    "schema_history": _with(
        TRIPS
        + """,
bounds AS (SELECT min(epoch_us(processing_time)) AS lo, max(epoch_us(processing_time)) AS hi FROM trips),
slices AS (
  SELECT *, CASE WHEN epoch_us(processing_time) < lo + (hi - lo) // 3 THEN 1
                 WHEN epoch_us(processing_time) < lo + (hi - lo) * 2 // 3 THEN 2 ELSE 3 END AS batch_id
  FROM trips, bounds WHERE surge_multiplier IS NOT NULL
)""",
        """SELECT min(batch_id)::BIGINT AS batch_id, 'ride' AS path, 'added' AS change,
  'struct<pool:boolean,seats:bigint>' AS new_type FROM slices
UNION ALL SELECT min(batch_id) FILTER (event_time >= TIMESTAMP '2024-01-25'), 'ride.wait', 'added', 'decimal(2,1)' FROM slices""",
    ),
}
