"""Queries over log lines rendered from the events table; their SQL answers from the event columns and never parses."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lodeglass.operators import compact
from lodeglass.operators.blocks import number_lines
from lodeglass.operators.carry import carry_stage, find_marks
from lodeglass.operators.detect import detect_format
from lodeglass.operators.entries import event_time, parse_as, parse_logs
from lodeglass.operators.logs import newest_order, recent, tail
from lodeglass.operators.years import with_years
from lodeglass.plans import inputs as I
from lodeglass.plans.registry import QUERIES, Tables, query
from lodeglass.sources import landed
from lodeglass.sources.lines import split_text
from lodeglass.sources.staging import new_folder, stage

_CLOCK = "strftime(ts, '%H:%M:%S')"
_SAID = "'user ' || user_id || ' did ' || event_type"
_LEVEL = """CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG'
                 WHEN 'signup' THEN 'INFO' ELSE 'NOTICE' END"""
_K = "regexp_extract(props, '([0-9]+)', 1)"
_WHERE = "event_type || '.go:' || user_id"


def _lines(t: Tables, line: Column):
    return I.lines(t.events, line)


def _spread_lines(t: Tables, line: Column):
    """The same lines dealt over all cores. A few MB of columns are one part, or one row group, but JSON lines for minutes."""
    return I.lines(t.events.repartition("event_id"), line)


def _field(name: str) -> Column:
    return F.col("fields")[name]


# ---- lines


@query(
    """SELECT user_id AS source_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no FROM events"""
)
def lines_position(t: Tables):
    lines = _lines(t, I.text_line()).withColumn("event_id", F.col("line_no"))
    return number_lines(lines).select("source_id", "event_id", "line_no")


@query(
    """SELECT * FROM (SELECT doc_id AS source_id, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS value,
                             generate_subscripts(string_split(rtrim(text, chr(10)), chr(10)), 1) AS line_no FROM documents)
       WHERE value <> ''"""
)
def text_lines(t: Tables):
    return split_text(t.documents, "doc_id", "text").where(F.col("value") != "")


@query("SELECT user_id AS source_id, event_id AS line_no FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def log_tail(t: Tables):
    return tail(_lines(t, I.source_line()), 5).select("source_id", "line_no")


_DATED = "CASE WHEN event_type IN ('error', 'click') THEN ts END"


@query(
    f"""SELECT source_id, line_no FROM (
          SELECT user_id AS source_id, event_id AS line_no, first_value({_DATED} IGNORE NULLS) OVER every AS first,
                 last_value({_DATED} IGNORE NULLS) OVER past AS last FROM events
          WINDOW past AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
                 every AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        WHERE first IS NULL OR coalesce(last, first) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 36 HOUR"""
)
def log_since(t: Tables):
    """Dated JSON lines among klog and text lines, which have no date."""
    lines = _lines(t, I.mixed_line())
    as_of = F.lit(_AS_OF).cast("timestamp")
    return recent(lines, event_time(F.col("value")), "36h", as_of, block_rows=1000).select("source_id", "line_no")


@query(
    f"""SELECT user_id AS source_id, event_id AS line_no, {_LEVEL} AS level,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events"""
)
def log_newest_first(t: Tables):
    """Every line's place in the order, so that the order is data."""
    _, *order = newest_order()
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    return parse_as(_spread_lines(t, I.zap_line()), "json").select("source_id", "line_no", "level", place.alias("place"))


_AS_OF = "2024-01-30T12:00:00Z"


def _landed(t: Tables, line: Column, part_rows: int) -> str:
    path = new_folder(t.spark)
    landed.land(_lines(t, line), path, part_rows)
    return path


@query(QUERIES["log_since"].sql)
def log_since_landed(t: Tables):
    """The same from landed lines, of which only parts are read that can hold young ones."""
    as_of = F.lit(_AS_OF).cast("timestamp")
    return landed.recent(t.spark, _landed(t, I.mixed_line(), 1000), "36h", as_of).select("source_id", "line_no")


@query("SELECT user_id AS source_id, event_id AS line_no FROM events WHERE user_id % 6 = 4 AND event_type = 'signup'")
def log_search(t: Tables):
    """Words in landed lines, of which only parts are read that have them all."""
    return landed.search(t.spark, _landed(t, I.source_line(), 1000), ["libvirt", "SOURCE"]).select("source_id", "line_no")


# ---- detection


@query(
    """WITH head AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 10),
            votes AS (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END) AS j,
                             sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS k FROM head GROUP BY user_id)
       SELECT user_id AS source_id, greatest(j, k) / n AS confidence,
              CASE WHEN greatest(j, k) / n < 0.4 THEN 'plain' WHEN j >= k THEN 'json' ELSE 'klog' END AS format FROM votes"""
)
def log_detect(t: Tables):
    return detect_format(_lines(t, I.mixed_line()))


_FORMAT = """CASE user_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'klog' WHEN 2 THEN 'logfmt' WHEN 3 THEN 'clf'
                  WHEN 4 THEN 'virtv2v' ELSE 'plain' END"""


@query(f"SELECT DISTINCT user_id AS source_id, {_FORMAT} AS format FROM events")
def log_detect_sources(t: Tables):
    return detect_format(_lines(t, I.source_line())).select("source_id", "format")


@query(
    """SELECT doc_id AS source_id, 'plain' AS format, CAST(0 AS DOUBLE) AS confidence FROM documents"""
)
def log_detect_documents(t: Tables):
    """Prose is no log."""
    return detect_format(split_text(t.documents, "doc_id", "text"))


# ---- parsers

_ROW = "user_id AS source_id, event_id AS line_no"


@query(
    f"""SELECT {_ROW}, {_CLOCK} AS timestamp, {_LEVEL} AS level, {_SAID} AS message, {_WHERE} AS source,
               event_type || '|u' || user_id AS logger, event_id AS event, 'k=' || {_K} AS props, CAST(2 AS INTEGER) AS fields, TRUE AS parsed
        FROM events"""
)
def log_json(t: Tables):
    event = _field("event").cast("double").cast("long").alias("event")
    return parse_as(_spread_lines(t, I.zap_line()), "json").select(
        "source_id", "line_no", "timestamp", "level", "message", "source", "logger", event,
        _field("props").alias("props"), F.size("fields").alias("fields"), "parsed",
    )


@query(
    f"""SELECT {_ROW}, {_CLOCK} AS timestamp, {_LEVEL} AS level, {_SAID} AS message, {_WHERE} AS source,
               event_type AS logger, CAST(user_id AS VARCHAR) AS user FROM events"""
)
def log_json_logrus(t: Tables):
    return parse_as(_spread_lines(t, I.logrus_line()), "json").select(
        "source_id", "line_no", "timestamp", "level", "message", "source", "logger", _field("user").alias("user")
    )


@query(
    f"""SELECT event_id AS line_no, 'a=' || user_id || ',q,<nil>,true b=type=' || event_type || ' user=' || user_id AS z,
               'k=' || {_K} || ',' || event_type AS list, '<nil>' AS "none", value FROM events"""
)
def log_flatten(t: Tables):
    return parse_as(_spread_lines(t, I.nested_line()), "json").select(
        "line_no", _field("z").alias("z"), _field("list").alias("list"), _field("none").alias("none"),
        _field("value").cast("double").alias("value"),
    )


@query(
    """SELECT event_id AS line_no, 'b=x=y=' || event_type || ' k=' || user_id || '.5' AS z, 'a=' || event_type || ',' || user_id AS list,
              'map[m:' || event_type || ']' AS message FROM events"""
)
def log_flatten_repeated(t: Tables):
    """Of a key that a nested object repeats the last value counts."""
    entries = parse_as(_spread_lines(t, I.repeated_line()), "json")
    return entries.select("line_no", _field("z").alias("z"), _field("list").alias("list"), "message")


_LETTER = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END"


@query(
    f"""SELECT {_ROW}, {_CLOCK} AS timestamp, {_LETTER} AS level, {_SAID} AS message, {_WHERE} AS source, '' AS logger,
               TRUE AS bare, TRUE AS parsed FROM events"""
)
def log_klog(t: Tables):
    return parse_as(_lines(t, I.klog_line()), "klog").select(
        "source_id", "line_no", "timestamp", "level", "message", "source", "logger", F.col("fields").isNull().alias("bare"), "parsed"
    )


@query(
    f"""SELECT {_ROW}, {_SAID} AS message, 'pairs.go:7' AS source, event_type AS logger, 'u' || user_id AS user FROM events"""
)
def log_klog_structured(t: Tables):
    return parse_as(_lines(t, I.klog_pairs_line()), "klog").select(
        "source_id", "line_no", "message", "source", "logger", _field("user").alias("user")
    )


@query(
    f"""SELECT {_ROW}, {_CLOCK} AS timestamp, {_LEVEL} AS level, {_SAID} AS message, event_type AS logger,
               'u' || user_id AS user, CAST(event_id AS VARCHAR) AS event FROM events"""
)
def log_logfmt(t: Tables):
    return parse_as(_lines(t, I.logfmt_line()), "logfmt").select(
        "source_id", "line_no", "timestamp", "level", "message", "logger", _field("user").alias("user"), _field("event").alias("event")
    )


@query(
    f"""SELECT {_ROW}, {_CLOCK} AS timestamp, {_LETTER} AS level, 'GET /' || event_type || '/' || event_id || ' HTTP/1.1' AS message,
               '10.0.0.' || user_id AS client, CASE WHEN event_type <> 'view' THEN 'u' || user_id END AS user,
               CASE event_type WHEN 'error' THEN '500' WHEN 'purchase' THEN '404' ELSE '200' END AS status,
               CAST(event_id AS VARCHAR) AS size FROM events"""
)
def log_access(t: Tables):
    fields = [_field(n).alias(n) for n in ("client", "user", "status", "size")]
    return parse_as(_lines(t, I.access_line()), "clf").select("source_id", "line_no", "timestamp", "level", "message", *fields)


_V_LOGGER = "CASE event_type WHEN 'click' THEN 'v2v-monitor' WHEN 'view' THEN 'libguestfs' WHEN 'error' THEN 'nbdkit' ELSE 'v2v' END"
_V_LEVEL = "CASE WHEN event_type IN ('view', 'error') THEN 'DEBUG' ELSE 'INFO' END"
_V_TIME = f"CASE event_type WHEN 'signup' THEN '0.0s' WHEN 'purchase' THEN '147.3s' WHEN 'error' THEN {_CLOCK} ELSE '' END"
_V_TEXT = f"""CASE event_type WHEN 'signup' THEN 'Setting up the source: -i libvirt' WHEN 'purchase' THEN 'Copying disk 1/3'
                   WHEN 'click' THEN 'Progress update, completed ' || {_K} || ' %' WHEN 'view' THEN 'op_' || event_id
                   ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z warning' END"""


@query(
    f"""SELECT {_ROW}, {_V_LOGGER} AS logger, {_V_LEVEL} AS level, {_V_TIME} AS timestamp, {_V_TEXT} AS message,
               CASE WHEN event_type = 'purchase' THEN '3' END AS disk_total,
               CASE WHEN event_type = 'click' THEN {_K} END AS progress_pct, TRUE AS parsed FROM events"""
)
def log_conversion(t: Tables):
    return parse_as(_lines(t, I.conversion_line()), "virtv2v").select(
        "source_id", "line_no", "logger", "level", "timestamp", "message", _field("disk_total").alias("disk_total"),
        _field("progress_pct").alias("progress_pct"), "parsed",
    )


# ---- carry-forward

_MARK = "CASE event_type WHEN 'signup' THEN 'source-setup' WHEN 'purchase' THEN 'disk-copy' END"
_STAGE = f"coalesce(last_value({_MARK} IGNORE NULLS) OVER past, 'init')"
_PAST = "WINDOW past AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
_RUNS = f"""SELECT *, {_STAGE} AS stage, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER past AS run
            FROM events {_PAST}"""
_PROGRESS = f"""last_value(CASE WHEN event_type = 'click' THEN {_K} END IGNORE NULLS)
                OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""


def _carried(t: Tables):
    lines = _lines(t, I.conversion_line())
    return carry_stage(lines, marks=find_marks(lines))


@query(f"SELECT {_ROW}, {_STAGE} AS stage FROM events {_PAST}")
def log_stage(t: Tables):
    return _carried(t).select("source_id", "line_no", "stage")


@query(f"SELECT {_ROW}, {_STAGE} AS stage FROM events {_PAST}")
def log_stage_blocks(t: Tables):
    """The same in blocks, as for logs with very many marks, so small that every source spans several."""
    lines = _lines(t, I.conversion_line())
    marks = find_marks(lines, block_rows=500, most=0)
    return carry_stage(lines, 500, marks).select("source_id", "line_no", "stage")


@query(f"SELECT {_ROW}, stage, {_PROGRESS} AS progress_pct FROM ({_RUNS})")
def log_progress(t: Tables):
    return _carried(t).select("source_id", "line_no", "stage", "progress_pct")


# ---- whole pipeline

_ENTRY_LEVEL = f"""CASE user_id % 6 WHEN 0 THEN {_LEVEL} WHEN 1 THEN {_LETTER} WHEN 2 THEN {_LEVEL} WHEN 3 THEN {_LETTER}
                        WHEN 4 THEN {_V_LEVEL} ELSE '' END"""
_ENTRY_TIME = f"CASE user_id % 6 WHEN 4 THEN {_V_TIME} WHEN 5 THEN '' ELSE {_CLOCK} END"
_ENTRY_TEXT = f"""CASE user_id % 6 WHEN 3 THEN 'GET /' || event_type || '/' || event_id || ' HTTP/1.1' WHEN 4 THEN {_V_TEXT}
                       WHEN 5 THEN '' ELSE {_SAID} END"""
_ENTRIES = f"""SELECT user_id, event_id, ts, event_type, {_FORMAT} AS format, {_ENTRY_LEVEL} AS level, {_ENTRY_TIME} AS timestamp,
                      {_ENTRY_TEXT} AS message, {_FORMAT} <> 'plain' AS parsed,
                      CASE WHEN {_FORMAT} = 'virtv2v' THEN {_STAGE} END AS stage FROM events {_PAST}"""


def _entries(t: Tables):
    lines = _lines(t, I.source_line())
    return parse_logs(lines, stage(detect_format(lines)))


@query(f"SELECT {_ROW}, format, level, timestamp, message, parsed, stage FROM ({_ENTRIES})")
def log_entries_mixed(t: Tables):
    return _entries(t).select(
        "source_id", "line_no", "format", "level", "timestamp", "message", "parsed", _field("stage").alias("stage")
    )


_EVENT_TS = """CASE user_id % 6 WHEN 1 THEN NULL WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN NULL WHEN 5 THEN NULL
                    ELSE ts END"""


@query(
    f"""SELECT {_ROW}, format, timestamp, message FROM ({_ENTRIES}) WHERE level = 'ERROR'
        ORDER BY {_EVENT_TS} DESC NULLS LAST, user_id, event_id LIMIT 20"""
)
def log_errors_top(t: Tables):
    """Flagship: the latest errors of all sources that date their lines, whatever they log in."""
    errors = _entries(t).where(F.col("level") == "ERROR")
    newest = errors.orderBy(F.col("event_ts").desc_nulls_last(), "source_id", "line_no").limit(20)
    return newest.select("source_id", "line_no", "format", "timestamp", "message")


# As far as the lines say it: numbers of seconds have it whole, of milliseconds not. Of conversion lines only nbdkit's
# carry a date, of text lines every other one.
_OWN_TIME = """CASE user_id % 6 WHEN 0 THEN CASE event_type WHEN 'view' THEN date_trunc('millisecond', ts) ELSE ts END
                    WHEN 1 THEN ts - INTERVAL 15 DAY WHEN 2 THEN ts WHEN 3 THEN date_trunc('second', ts)
                    WHEN 4 THEN CASE event_type WHEN 'error' THEN date_trunc('millisecond', ts) END
                    ELSE CASE WHEN event_id % 2 = 0 THEN ts END END"""


@query(f"SELECT {_ROW}, {_FORMAT} AS format, {_OWN_TIME} AS event_ts FROM events")
def log_event_ts(t: Tables):
    """Stamps of many forms beside other dates, and klog lines that go over a new year."""
    written = F.lit("2024-01-16T00:00:00Z").cast("timestamp").alias("modified")
    lines = _lines(t, I.dated_line()).select("*", written)
    formats = stage(with_years(detect_format(lines), lines))
    entries = parse_logs(lines, formats)
    return entries.select("source_id", "line_no", "format", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"))


_BY_FORMAT = f"(SELECT *, {_FORMAT} AS format FROM events)"


@query(f"SELECT {_ROW} FROM {_BY_FORMAT} WHERE event_type = 'error' AND format <> 'virtv2v'")
def log_fulltext(t: Tables):
    hits = _lines(t, I.source_line()).where(F.col("value").rlike("(?i)did ERROR|/error/"))
    return hits.select("source_id", "line_no")


@query(f"SELECT {_ROW}, CAST(event_id AS VARCHAR) AS event FROM {_BY_FORMAT} WHERE format = 'logfmt'")
def log_field_exists(t: Tables):
    entries = _entries(t)
    return entries.where((F.col("format") == "logfmt") & _field("event").isNotNull()).select(
        "source_id", "line_no", _field("event").alias("event")
    )


_PADDED = f"'[' || rpad({_LEVEL}, CAST(greatest(length({_LEVEL}), 5) AS INTEGER), ' ') || '] '"
_ACCESS = f"""'[' || rpad({_LETTER}, 5, ' ') || '] ' || {_CLOCK} || ' GET /' || event_type || '/' || event_id || ' HTTP/1.1 client=10.0.0.'
              || user_id || ' size=' || event_id || ' status=' || CASE event_type WHEN 'error' THEN '500' WHEN 'purchase' THEN '404' ELSE '200' END
              || CASE WHEN event_type <> 'view' THEN ' user=u' || user_id ELSE '' END"""
_CONVERSION = f"""'[' || rpad({_V_LEVEL}, 5, ' ') || '] ' || {_V_TIME} || CASE WHEN {_V_TIME} = '' THEN '' ELSE ' ' END || {_V_LOGGER} || ': '
                  || {_V_TEXT} || CASE WHEN event_type = 'purchase' THEN ' disk_num=1 disk_total=3' ELSE '' END
                  || coalesce(' progress_pct=' || {_PROGRESS}, '') || ' stage=' || stage"""
# JSON numbers from a million on print with an exponent.
_JSON_NUMBER = r"""CASE WHEN event_id < 1000000 THEN CAST(event_id AS VARCHAR)
                       ELSE regexp_replace(regexp_replace(printf('%.17e', event_id), '0+e', 'e'), '\.e', 'e') END"""


@query(
    f"""SELECT {_ROW}, CASE user_id % 6
          WHEN 0 THEN {_PADDED} || {_CLOCK} || ' ' || event_type || ': ' || {_SAID} || ' event=' || {_JSON_NUMBER} || ' props=k=' || {_K}
          WHEN 1 THEN '[' || rpad({_LETTER}, 5, ' ') || '] ' || {_CLOCK} || ' ' || {_WHERE} || ': ' || {_SAID}
          WHEN 2 THEN {_PADDED} || {_CLOCK} || ' ' || event_type || ': ' || {_SAID} || ' event=' || event_id || ' user=u' || user_id
          WHEN 3 THEN {_ACCESS} WHEN 4 THEN {_CONVERSION} ELSE {_SAID} END AS line FROM ({_RUNS})"""
)
def log_compact(t: Tables):
    return _entries(t).select("source_id", "line_no", compact.compact_line().alias("line"))


_KEPT = "event_type = 'error'"


@query(
    f"""SELECT user_id AS source_id, {_FORMAT} AS format, count(*) FILTER ({_KEPT}) AS lines,
               CASE WHEN {_FORMAT} = 'plain' THEN NULL WHEN count(*) FILTER ({_KEPT}) = 0 THEN '(no matching log entries)'
                    ELSE '# format: ' || {_FORMAT} || ', lines: ' || count(*) FILTER ({_KEPT}) END AS header
        FROM events GROUP BY user_id UNION ALL SELECT -r_regionkey - 1, 'plain', 0, NULL FROM region"""
)
def log_header(t: Tables):
    """After a filter, and with sources of blank lines only."""
    blank = t.region.select((-F.col("r_regionkey") - 1).alias("source_id"), F.lit(1).cast("long").alias("line_no"), F.lit(" ").alias("value"))
    lines = _lines(t, I.source_line()).unionByName(blank)
    kept = t.events.where("event_type = 'error'").select(F.col("user_id").alias("source_id"))
    return compact.log_header(kept, detect_format(lines))
