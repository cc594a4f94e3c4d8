"""Detection, carrying, picking and rendering over many sources, against plain Python models."""

import random

import pytest
from pyspark.sql import functions as F

from lodeglass.functions.formats import conversion
from lodeglass.operators import blocks, carry, compact, logs, years
from lodeglass.operators.detect import detect_format
from lodeglass.operators.entries import event_time, parse_logs
from lodeglass.sources.lines import split_text

JSON, KLOG, TEXT = '{"a":1}', "I0303 x", "free text"
# Two runs in one log: the second starts the progress anew.
RUN = """Building command: virt-v2v [-i disk]
[   3.5] Opening the source
virt-v2v monitoring: Progress update, completed 7 %
[  12.0] Creating an overlay to protect the source
nbdkit: file[4]: debug: plan: 2 extents
[  21.9] Copying disk 2/5
virt-v2v monitoring: Progress update, completed 61 %
supermin: kernel: picked 6.1
[   1.1] Setting up the source: -i ova
guestfsd: <= list_filesystems
[1600.25] Creating output metadata"""
STAGES_OF_RUN = ["init"] + ["source-open"] * 2 + ["overlay"] * 2 + ["disk-copy"] * 3 + ["source-setup"] * 2 + ["metadata"]
PROGRESS_OF_RUN = [None] * 2 + ["7"] * 4 + ["61"] * 2 + [None] * 3


def lines_of(spark, sources):
    rows = [(s, i, v) for s, values in sources.items() for i, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "source_id string, line_no long, value string").repartition(5)


@pytest.mark.parametrize("block_rows", [3, 1 << 20])
def test_detect(spark, block_rows):
    sources = {
        "four": [JSON] * 4 + [TEXT] * 6 + [KLOG] * 20,
        "three": [JSON] * 3 + [TEXT] * 7,
        "tie": [KLOG] * 5 + [JSON] * 5,
        "tie clf": ["a=1 b=2 c=3", '1.1.1.1 - - [x] "G" 200 1'],
        "blanks": ["", " "] * 6 + [JSON] + [TEXT],
        "late": [""] * 20 + [JSON],
        "later": [JSON] + [""] * 18 + [TEXT] + [KLOG] * 5,
        "nineteen": [""] * 10 + [KLOG] * 9 + [TEXT] * 3,
        "empty": ["", "  "],
        "conversion": RUN.split("\n"),
        "text": [TEXT],
        "past ten": [TEXT] * 10 + [JSON] * 90,
    }
    got = {r.source_id: (r.format, round(r.confidence, 3)) for r in detect_format(lines_of(spark, sources), block_rows).collect()}
    assert got == {
        "four": ("json", 0.4),
        "three": ("plain", 0.3),
        "tie": ("json", 0.5),
        "tie clf": ("logfmt", 0.5),
        "blanks": ("json", 0.5),
        "late": ("json", 1.0),
        "later": ("json", 0.5),
        "nineteen": ("klog", 0.9),
        "empty": ("plain", 0.0),
        "conversion": ("virtv2v", 1.0),
        "text": ("plain", 0.0),
        "past ten": ("plain", 0.0),
    }


def model_carry(rows):
    stage, progress, out = "init", "", []
    for parsed, logger, message, pct in rows:
        if parsed and logger == "v2v":
            started = next((s for k, s in conversion.STAGES if k in message), None)
            if started:
                stage = started
                if started == "source-setup":
                    progress = ""
        if pct:
            progress = pct
        out.append((stage, progress or None))
    return out


@pytest.mark.parametrize("block_rows", [2, 7, 1 << 20])
def test_carry_matches_model(spark, block_rows):
    rng = random.Random(block_rows)
    messages = [k for k, _ in conversion.STAGES] + ["other", "Copying disk 1/2"]
    sources, rows = {}, []
    for source in ("a", "b", "c"):
        sources[source] = [
            (rng.random() < 0.9, rng.choice(["v2v", "nbdkit"]), rng.choice(messages), rng.choice(["", "", "42", "85", "100"]))
            for _ in range(60)
        ]
        rows += [(source, 10 * i, *r) for i, r in enumerate(sources[source])]
    df = spark.createDataFrame(rows, "source_id string, line_no long, ok boolean, logger string, message string, pct string")
    got = carry.carry_marks(
        df.repartition(4),
        message=F.col("message"),
        by_tool=F.col("ok") & (F.col("logger") == "v2v"),
        progress=F.nullif("pct", F.lit("")),
        block_rows=block_rows * 10,
    ).orderBy("source_id", "line_no").collect()
    assert [(r.stage, r.progress_pct) for r in got] == [x for s in "abc" for x in model_carry(sources[s])]


@pytest.mark.parametrize("block_rows", [2, 1 << 20])
def test_parse_logs_carries_through_conversion_logs(spark, block_rows):
    df = lines_of(spark, {"pod": RUN.split("\n"), "app": [JSON, "", TEXT], "text": [TEXT, "   "]})
    rows = parse_logs(df, block_rows=block_rows).orderBy("source_id", "line_no").collect()
    run = [r for r in rows if r.source_id == "pod"]
    assert [r.fields["stage"] for r in run] == STAGES_OF_RUN
    assert [r.fields.get("progress_pct") for r in run] == PROGRESS_OF_RUN
    assert run[5].fields["disk_total"] == "5"
    assert [(r.source_id, r.format, r.parsed, r.fields) for r in rows if r.source_id != "pod"] == [
        ("app", "json", True, {"a": "1"}),
        ("app", "json", False, None),
        ("text", "plain", False, None),
        ("text", "plain", False, None),
    ]


@pytest.mark.parametrize("keyword, stage", conversion.STAGES)
def test_stage_keywords(spark, keyword, stage):
    row = spark.range(1).select(conversion.stage_of(F.lit(f"x {keyword} y")).alias("s")).first()
    assert row.s == stage


def test_unparsed_conversion_line_gets_fields(spark):
    rows = parse_logs(lines_of(spark, {"s": ["nbdkit: x"] * 9 + ["odd line"]})).collect()
    odd = next(r for r in rows if r.raw_line == "odd line")
    assert (odd.parsed, odd.fields) == (False, {"stage": "init"})


@pytest.mark.parametrize("n", [1, 5, 1000, 20_000])
@pytest.mark.parametrize("block_rows", [3, 1 << 20])
def test_first_and_last_rows(spark, n, block_rows):
    sizes = {"a": 1, "b": 4, "c": 37}
    df = lines_of(spark, {s: [f"{s}{i}" for i in range(k)] for s, k in sizes.items()})
    first = blocks.first_rows(df, n, rank="r", block_rows=block_rows).orderBy("source_id", "line_no").collect()
    assert [(r.source_id, r.line_no, r.r) for r in first] == [(s, i, i) for s, k in sizes.items() for i in range(1, min(n, k) + 1)]
    last = logs.tail(df, n, block_rows).orderBy("source_id", "line_no").collect()
    assert [(r.source_id, r.line_no) for r in last] == [(s, i) for s, k in sizes.items() for i in range(max(k - n, 0) + 1, k + 1)]
    assert logs.tail(df, 0) is df


@pytest.mark.parametrize("block_rows", [8, 1 << 20])
def test_number_lines(spark, block_rows):
    rows = [(s, 100 - i * 3, f"{i}") for s in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "source_id string, line_no long, value string").repartition(3)
    got = blocks.number_lines(df, block_rows=block_rows).orderBy("source_id", "line_no").collect()
    assert [(r.source_id, r.line_no, r.value) for r in got] == [(s, i + 1, f"{29 - i}") for s in "ab" for i in range(30)]


def test_blocks_of_large_positions(spark):
    """Positions that a double cannot tell apart still fall into the right blocks."""
    base = (1 << 62) + 5
    rows = [("s", base + i, "x" if i == 0 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "source_id string, line_no long, mark string").repartition(3)
    got = blocks.carry_last(df, {"mark": F.col("mark")}, block_rows=4).orderBy("line_no").collect()
    assert [r.mark for r in got] == ["x"] * 50
    last = blocks.last_rows(df, 3, block_rows=2).orderBy("line_no").collect()
    assert [r.line_no for r in last] == [base + 47, base + 48, base + 49]


def test_newest_first_keeps_stages_in_file_order(spark):
    rows = logs.newest_first(parse_logs(lines_of(spark, {"pod": RUN.split("\n")}))).collect()
    assert [r.line_no for r in rows] == list(range(11, 0, -1))
    assert rows[0].fields["stage"] == "metadata"


def test_split_text(spark):
    df = spark.createDataFrame([("d", "a\r\n\n  \nb\n\n")], "id string, t string")
    rows = split_text(df, "id", "t").orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in rows] == [(1, "a\r"), (2, ""), (3, "  "), (4, "b")]


def test_event_ts_of_entries(spark):
    rows = parse_logs(lines_of(spark, {"a": ["time=2026-03-03T11:13:26Z level=info msg=x", "a=1 b=2 c=3"]})).orderBy("line_no").collect()
    assert [r.event_ts and r.event_ts.isoformat()[:19] for r in rows] == ["2026-03-03T11:13:26", None]


def test_planning_runs_nothing(spark):
    """Without written formats a plan is only made; jobs run when it is used."""
    lines = lines_of(spark, {"a": [JSON]})
    spark.sparkContext.setJobGroup("planning", "none expected")
    entries = parse_logs(lines)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("", "")
    assert "event_ts" in entries.columns


def test_compact_lines(spark):
    sources = {
        "pod": RUN.split("\n"),
        "json": ['{"level":"warning","ts":"2026-03-03T11:13:26.058Z","msg":"m","logger":"plan|v6z6r","x":{"b":1,"a":[1]},"e":""}', "odd"],
        "klog": ["I0303 11:14:07.353271       1 metrics.go:637] message text"],
        "text": ["free text"],
        "lvl": ['level=critical msg=m k="a b"', "level=verylong logger=|x msg=m a=b"] + ["a=1 b=2 c=3"] * 3,
    }
    df = lines_of(spark, sources)
    formats = detect_format(df)
    entries = parse_logs(df, formats).withColumn("text", compact.compact_line())
    got = {}
    for r in entries.orderBy("source_id", "line_no").collect():
        got.setdefault(r.source_id, []).append(r.text)
    assert got["json"] == ['[WARN ] 11:13:26 plan: m x="a=1 b=1"', "[     ] odd"]
    assert got["klog"] == ["[INFO ] 11:14:07 metrics.go:637: message text"]
    assert got["text"] == ["free text"]
    assert got["lvl"][:2] == ['[FATAL] m k="a b"', "[VERYLONG] |x: m a=b"]
    assert got["pod"][1] == "[INFO ] 3.5s v2v: Opening the source stage=source-open"
    assert got["pod"][6] == "[INFO ] v2v-monitor: Progress update, completed 61 % progress_pct=61 stage=disk-copy"
    kept = entries.where(F.col("level") == "FATAL")
    headers = {r.source_id: (r.lines, r.header) for r in compact.log_header(kept, formats).collect()}
    assert headers == {
        "pod": (0, compact.NO_MATCH),
        "json": (0, compact.NO_MATCH),
        "klog": (0, compact.NO_MATCH),
        "text": (0, None),
        "lvl": (1, "# format: logfmt, lines: 1"),
    }


def test_event_time(spark):
    cases = {
        '2026-03-03T11:13:16.103258979Z {"a":1}': "2026-03-03 11:13:16.103258",
        "time=2026-03-03T11:13:26+02:00 a=b c=d": "2026-03-03 09:13:26",
        '{"timestamp":"2026-03-03 11:13:26.058"}': "2026-03-03 11:13:26.058",
        '1.1.1.1 - - [10/Oct/2000:13:55:36 -0700] "G" 200 1': "2000-10-10 20:55:36",
        "2026/03/03 00:38:19 http: x": "2026-03-03 00:38:19",
        "no time": None,
        "retry at 2030-01-01T00:00:00Z": None,
        "I0303 12:00:01.000000 1 a.go:1] lease expires 2031-05-05T00:00:00Z": None,
        '{"level":"info","ts":1709550000.5,"msg":"x"}': "2024-03-04 11:00:00.5",
        '{"ts":1.7095500005e+09}': "2024-03-04 11:00:00.5",
        '{"ts":1709550000500}': "2024-03-04 11:00:00.5",
        '{"ts":1709550000500000}': "2024-03-04 11:00:00.5",
        '{"ts":1709550000500000123}': "2024-03-04 11:00:00.5",
        '{"msg":"retry until 2030-01-01T00:00:00Z","ts":"2026-03-03T01:02:03Z"}': "2026-03-03 01:02:03",
        '{"msg":"2030-01-01T00:00:00Z","ts":"soon"}': None,
        '{"ts":null,"time":"2026-03-03T01:02:03,5Z"}': "2026-03-03 01:02:03.5",
        "[2026-03-03 01:02:03] at 2030-01-01T00:00:00Z": "2026-03-03 01:02:03",
        'level=info msg="until 2030-01-01T00:00:00Z" ts=1709550000': "2024-03-04 11:00:00",
        '1.1.1.1 - - [31/Feb/2000:13:55:36 -0700] "G" 200 1': None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw_line string")
    got = {r.raw_line: r.t for r in df.select("raw_line", event_time(F.col("raw_line")).cast("string").alias("t")).collect()}
    assert got == cases


def test_recent_of_sources_without_dates(spark):
    """Where lines have no time, that of the last writing bounds them."""
    import datetime as dt

    as_of = dt.datetime(2026, 3, 3, 12, 0, 0, tzinfo=dt.timezone.utc)
    rows = {"old": ["a", "b"], "young": ["c"], "unknown": ["d"], "dated": ["2026-03-03T11:13:16Z new"]}
    written = F.expr("case source_id when 'young' then timestamp '2026-03-03 11:30:00Z' when 'unknown' then null else timestamp '2026-03-01 00:00:00Z' end")
    lines = lines_of(spark, rows).withColumn("written", written)
    got = logs.recent(lines, event_time(F.col("value")), "1h", as_of, modified="written")
    assert sorted(r.source_id for r in got.collect()) == ["dated", "unknown", "young"]


def test_event_ts_is_the_stamp_of_the_format(spark):
    zap = [f'{{"level":"info","msg":"until 2030-01-0{k}T00:00:00Z","ts":{1709550000 + k}}}' for k in (1, 2)] + ["2031-01-01T00:00:00Z tail"]
    pod = RUN.split("\n") + ["nbdkit: debug: 2026-03-03T01:02:03.5Z now, not 2030-01-01T00:00:00.0Z", "2026/03/03 00:38:19 http: 2030-01-01T00:00:00Z"]
    df = lines_of(spark, {"zap": zap, "pod": pod})
    rows = parse_logs(df).select("source_id", "line_no", F.col("event_ts").cast("string").alias("t")).collect()
    got = {(r.source_id, r.line_no): r.t for r in rows if r.t}
    assert got == {
        ("zap", 1): "2024-03-04 11:00:01", ("zap", 2): "2024-03-04 11:00:02", ("zap", 3): "2031-01-01 00:00:00",
        ("pod", 12): "2026-03-03 01:02:03.5", ("pod", 13): "2026-03-03 00:38:19",
    }


@pytest.mark.parametrize("block_rows", [2, 5, 1 << 20])
def test_years_of_klog_lines(spark, block_rows):
    """Several new years, one of them with lines in the wrong order; a last line of the year before its file's."""
    stamps = {
        "one": ["0301", "0301"],
        "steps": ["0615", "1231", "0101", "0714", "1231", "0101", "1231", "0101", "0102", "0301"],
        "before": ["1230", "1231"],
        "zone": ["0302"],
        "odd": ["0301", "9999", "0301"],
    }
    written = {"one": "2026-03-01", "steps": "2026-03-01", "before": "2026-01-01", "zone": "2026-03-01", "odd": "2026-03-01"}
    line = lambda d: f"I{d} 11:14:07.5       1 a.go:1] text"
    df = lines_of(spark, {s: [*map(line, days)] for s, days in stamps.items()} | {"text": [TEXT]})
    at = F.create_map(*[F.lit(x) for pair in written.items() for x in pair])[F.col("source_id")]
    df = df.withColumn("modified", F.concat(at, F.lit("T00:00:00Z")).cast("timestamp"))
    rows = parse_logs(df, years.with_years(detect_format(df), df, block_rows=block_rows)).orderBy("source_id", "line_no").collect()
    got = {}
    for r in rows:
        got.setdefault(r.source_id, []).append(r.event_ts and r.event_ts.year)
    assert got == {
        "one": [2026, 2026],
        "steps": [2024, 2024, 2025, 2025, 2025, 2026, 2025, 2026, 2026, 2026],
        "before": [2025, 2025],
        "zone": [2026],
        "odd": [2026, None, 2026],
        "text": [None],
    }
    assert "modified" in rows[0] and "_year" not in rows[0]


def test_recent(spark):
    import datetime as dt

    as_of = dt.datetime(2026, 3, 3, 12, 0, 0, tzinfo=dt.timezone.utc)
    rows = {
        "mixed": ["undated", "2026-03-03T10:59:59Z old", "under old", "2026-03-03T11:13:16Z new", "under new"],
        "young": ["before the first date", "2026-03-03T11:30:00Z x"],
        "undated": ["a", "b"],
    }
    for block_rows in (2, 1 << 20):
        got = logs.recent(lines_of(spark, rows), event_time(F.col("value")), "1h", as_of, block_rows)
        kept = sorted((r.source_id, r.line_no) for r in got.collect())
        assert kept == [("mixed", 4), ("mixed", 5), ("undated", 1), ("undated", 2), ("young", 1), ("young", 2)]
