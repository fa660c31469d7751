"""Expected rows of the streaming jobs."""

from oracle.licence_sql import SQL as LICENCE_SQL

SQL = {
    "s6_audit_append": "SELECT event_id AS id, user_id AS customer_id, event_type FROM events",
    "g14_running_counters": """SELECT count(*) FILTER (event_type IN ('click', 'purchase')) AS matched,
        count(*) FILTER (event_type NOT IN ('click', 'purchase')) AS rejected FROM (SELECT * FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)""",
    "a1_stream_deliveries": "SELECT 'm-' || CAST(event_id AS STRING) AS match_event_id FROM events",
    "s3_page_stream": LICENCE_SQL["s2_page_scan"],
}
