"""Every line format: hand-derived cases and the documented conversion-log lines."""

import pytest
from pyspark.sql import functions as F

from lodeglass.functions.formats import line_class
from lodeglass.operators.entries import parse_as


def parsed(spark, name, *lines):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(lines, 1)], "source_id string, line_no long, value string")
    return sorted(parse_as(df, name).collect(), key=lambda r: r.line_no)


def shown(row):
    return (row.parsed, row.level, row.timestamp, row.logger, row.source, row.message, row.fields)


UNPARSED = (False, "", "", "", "", "", None)


def test_klog(spark):
    rows = parsed(
        spark,
        "klog",
        "I0303 11:14:07.353271       1 metrics.go:637] message text",
        'E0303 11:14:07.3       1 a.go:1] "msg"="a" "logger"="b" "k"="v" "k"="w"',
        'W0303 11:14:07.3       1 a.go:1] "Text here" k="v"',
        "F0303 11:14:07.3       1 a.go:1]",
        "nothing",
        'I0303 11:14:07.3 1 a.go:1] "msg"="" "x"=""',
        "I0303 11:14:07.3 1 a.go:1] with \x01 inside",
        "no match with five \x01a\x01b\x01c\x01d",
    )
    assert [shown(r) for r in rows] == [
        (True, "INFO", "11:14:07", "", "metrics.go:637", "message text", None),
        (True, "ERROR", "11:14:07", "b", "a.go:1", "a", {"k": "w"}),
        (True, "WARN", "11:14:07", "", "a.go:1", '"Text here" k="v"', None),
        UNPARSED,
        UNPARSED,
        (True, "INFO", "11:14:07", "", "a.go:1", '"msg"="" "x"=""', {"x": ""}),
        (True, "INFO", "11:14:07", "", "a.go:1", "with \x01 inside", None),
        UNPARSED,
    ]
    assert {r.format for r in rows} == {"klog"}
    assert rows[4].raw_line == "nothing"


def test_json_zap(spark):
    rows = parsed(
        spark,
        "json",
        '{"level":"warning","ts":"2026-03-03T11:13:26.058Z","msg":"m","logger":"plan|v6z6r","caller":"a.go:1",'
        '"x":{"b":1,"a":[1,"q"]},"stacktrace":"t"}',
        '2026-03-03T11:13:16.103258979Z {"level":"dpanic","msg":"p","n":1234567,"f":1.50,"z":null,"t":true}',
        '{"ts":1709464406.123,"msg":{"b":[1,null],"a":"x"},"level":7}',
        '{"a":1} x',
        "{'a':1}",
        "[1]",
        "2026-03-03 plain",
        '{"a":1,"a":2,"msg":"x","msg":"last"}',
        '{"o":{"k":1,"k":2},"msg":"twice"}',
        '  {"msg":"blanks"}  ',
        "{}",
        '{"deep":{"a":{"b":{"c":[{"d":[[1,2],{"e":0.00001}]}]}}}}',
    )
    assert [shown(r) for r in rows] == [
        (True, "WARN", "11:13:26", "plan|v6z6r", "a.go:1", "m", {"x": "a=1,q b=1"}),
        (True, "FATAL", "", "", "", "p", {"n": "1.234567e+06", "f": "1.5", "z": "<nil>", "t": "true"}),
        (True, "7", "1.709464406123e+09", "", "", "map[a:x b:[1 <nil>]]", None),
        UNPARSED,
        UNPARSED,
        UNPARSED,
        UNPARSED,
        (True, "", "", "", "", "last", {"a": "2"}),
        (True, "", "", "", "", "twice", {"o": "k=2"}),
        (True, "", "", "", "", "blanks", None),
        (True, "", "", "", "", "", None),
        (True, "", "", "", "", "", {"deep": "a=b=c=d=1,2,e=1e-05"}),
    ]


def test_json_with_repeated_nested_keys(spark):
    """Values of every shape that repeat keys at any depth print as if only the last of each were there."""
    import json
    import random

    rnd = random.Random(7)

    def value(depth):
        kind = rnd.randrange(7 if depth else 4)
        if kind > 3 and kind != 5:
            return "{" + ", ".join(f'"{rnd.choice("ab:")}" : {value(depth - 1)}' for _ in range(rnd.randrange(4))) + "}"
        if kind == 5:
            return "[" + ",".join(value(depth - 1) for _ in range(rnd.randrange(4))) + "]"
        return [json.dumps(rnd.choice(["", "x y", 'q"\\', "[1]", "a: {", "é"])), "null", "true", str(rnd.randrange(99) * 0.5)][kind]

    def flat(v):
        if isinstance(v, dict):
            return " ".join(f"{k}={flat(v[k])}" for k in sorted(v))
        if isinstance(v, list):
            return ",".join(map(flat, v))
        return "<nil>" if v is None else str(v).lower() if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else v

    texts = ['{"a":{"a":1,"a":%s}}' % value(4) for _ in range(60)]
    rows = parsed(spark, "json", *texts)
    assert [r.fields["a"] for r in rows] == [flat(json.loads(t)["a"]) for t in texts]


def test_json_logrus(spark):
    rows = parsed(
        spark,
        "json",
        '{"component":"c","pos":"p.go:2","timestamp":"2026-03-03 11:13:26.058","level":"err","msg":"m","ts":"kept"}',
        '{"component":"c","timestamp":"","time":"2026-03-03T01:02:03Z","msg":"m"}',
        '{"component":"c","msg":"m"}',
    )
    assert [shown(r) for r in rows] == [
        (True, "ERROR", "11:13:26", "c", "p.go:2", "m", {"ts": "kept"}),
        (True, "", "01:02:03", "c", "", "m", None),
        (True, "", "", "", "", "m", {"component": "c"}),
    ]


def test_logfmt(spark):
    rows = parsed(
        spark,
        "logfmt",
        'time=2026-03-03T11:13:26Z level=err msg="a b" k=v',
        "a=1 b=2",
        "only=one",
        'x junk a="open end',
        'a="x y"b=c level=notice caller=f.go:1 source=g.go:2 k=1 k=2 =dropped d==e',
        "no pairs here " + "y" * 3000,
        "  k=v msg=m  ",
        "ts=10:11 x=",
    )
    assert [shown(r) for r in rows] == [
        (True, "ERROR", "11:13:26", "", "", "a b", {"k": "v"}),
        (True, "", "", "", "", "", {"a": "1", "b": "2"}),
        UNPARSED,
        UNPARSED,
        (True, "NOTICE", "", "", "g.go:2", "", {"a": "x y", "b": "c", "k": "2", "d": "=e"}),
        UNPARSED,
        (True, "", "", "", "", "m", {"k": "v"}),
        (True, "", "10:11", "", "", "", {"x": ""}),
    ]


def test_access(spark):
    rows = parsed(
        spark,
        "clf",
        '::ffff:10.128.0.2 - - [03/Mar/2026 11:14:56] "GET / HTTP/1.1" 200 -',
        '192.168.1.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /apache_pb.gif HTTP/1.0" 404 2326',
        '1.1.1.1 - - [30/Feb/2000:13:55:36 -0700] "GET / HTTP/1.0" 503 1 "ref" "agent"',
        '1.1.1.1 - - [x] "GET /" 301 1',
        "not an access line [x]",
        '1.1.1.1 - - [03/mar/2026 9:14:56] "G" 200 1',
    )
    assert [shown(r) for r in rows] == [
        (True, "INFO", "11:14:56", "", "", "GET / HTTP/1.1", {"client": "::ffff:10.128.0.2", "status": "200", "size": "-"}),
        (True, "WARN", "13:55:36", "", "", "GET /apache_pb.gif HTTP/1.0",
         {"client": "192.168.1.1", "status": "404", "size": "2326", "user": "frank"}),
        (True, "ERROR", "00:13:55", "", "", "GET / HTTP/1.0", {"client": "1.1.1.1", "status": "503", "size": "1"}),
        (True, "INFO", "", "", "", "GET /", {"client": "1.1.1.1", "status": "301", "size": "1"}),
        UNPARSED,
        (True, "INFO", "09:14:56", "", "", "G", {"client": "1.1.1.1", "status": "200", "size": "1"}),
    ]


CONVERSION = [
    ("</inspection-end>", "xml", "INFO", "", "</inspection-end>", None),
    ("\t<volume nr='7'>", "xml", "INFO", "", "\t<volume nr='7'>", None),
    ("<?pi any?>", "xml", "INFO", "", "<?pi any?>", None),
    ("[  12.5] Inspecting the source", "v2v", "INFO", "12.5s", "Inspecting the source", None),
    ("[9876.54] Mapping filesystem data", "v2v", "INFO", "9876.54s", "Mapping filesystem data", None),
    ("[   6.1] copying disk 4/9 to nowhere", "v2v", "INFO", "6.1s", "copying disk 4/9 to nowhere",
     {"disk_num": "4", "disk_total": "9"}),
    ("[   77.000001] eth9: link up", "kernel", "DEBUG", "77.000001s", "eth9: link up", None),
    ("2031/12/24 23:59:01 http: late request from nobody", "http", "WARN", "23:59:01", "http: late request from nobody", None),
    ("Starting server on :65000", "server", "INFO", "", "Starting server on :65000", None),
    ("Shutdown request received. Bye.", "server", "INFO", "", "Shutdown request received. Bye.", None),
    ("augeas failed to parse /srv/own.conf:", "augeas", "WARN", "", "failed to parse /srv/own.conf:", None),
    ("dracut: own module 99", "dracut", "INFO", "", "own module 99", None),
    ("supermin: appliance of 3 files", "supermin", "INFO", "", "appliance of 3 files", None),
    ("guestfsd: <= mkdir_p (0x7) request", "guestfsd", "DEBUG", "", "<= mkdir_p (0x7) request", None),
    ("info: chosen volumes: none", "v2v-info", "INFO", "", "chosen volumes: none", None),
    ("libguestfs: command: qemu-own --help", "libguestfs", "INFO", "", "command: qemu-own --help", None),
    ("libguestfs: trace: own_call 5", "libguestfs", "DEBUG", "", "own_call 5", None),
    ("libguestfs: trace: v2v: own_call \"x\"", "libguestfs", "DEBUG", "", "own_call \"x\"", None),
    ("libnbd: debug: nbd8: connect: enter", "libnbd", "DEBUG", "", "nbd8: connect: enter", None),
    ("nbdkit: debug: filter chain of 4", "nbdkit", "DEBUG", "", "filter chain of 4", None),
    ("nbdkit: vddk[9]: debug: blocks kept: 12", "nbdkit", "DEBUG", "", "blocks kept: 12", None),
    ("nbdkit: vddk[11]: debug: 2030-01-02T03:04:05.678Z slow link", "nbdkit", "DEBUG", "03:04:05",
     "2030-01-02T03:04:05.678Z slow link", None),
    ("check_host_free_space: large_tmpdir=/own free_space=5", "v2v", "INFO", "",
     "check_host_free_space: large_tmpdir=/own free_space=5", None),
    ("running nbdkit:", "v2v", "INFO", "", "running nbdkit:", None),
    ("libvirt xml is:", "v2v", "INFO", "", "libvirt xml is:", None),
    ("Building command: virt-v2v [-i disk own.img]", "v2v", "INFO", "", "Building command: virt-v2v [-i disk own.img]", None),
    ("virt-v2v monitoring: Progress update, completed 100 %", "v2v-monitor", "INFO", "",
     "Progress update, completed 100 %", {"progress_pct": "100"}),
    ("virt-v2v monitoring: Copying disk 6 out of 8", "v2v-monitor", "INFO", "", "Copying disk 6 out of 8",
     {"disk_num": "6", "disk_total": "8"}),
    ("virt-v2v monitoring: all done here", "v2v-monitor", "INFO", "", "all done here", None),
    ("rm -rf -- '/own/dir with blank'", "v2v", "INFO", "", "cleanup: rm -rf '/own/dir with blank'", None),
]
CONVERSION_UNPARSED = [
    "some random unrecognized output line", "libnbd:debug: x: y", "libnbd: other", "augeas other", "rm -rf /tmp/x",
    "virt-v2v monitoring:completed 3 %", "info:", "",
]


def test_conversion(spark):
    rows = parsed(spark, "virtv2v", *[c[0] for c in CONVERSION], *CONVERSION_UNPARSED, "libguestfs:")
    got = [(r.raw_line, r.logger, r.level, r.timestamp, r.message, r.fields) for r in rows[: len(CONVERSION)]]
    assert got == CONVERSION
    assert all(r.parsed and r.source == "" for r in rows[: len(CONVERSION)])
    assert [shown(r) for r in rows[len(CONVERSION) : -1]] == [UNPARSED] * len(CONVERSION_UNPARSED)
    assert (rows[-1].parsed, rows[-1].logger, rows[-1].level) == (False, "libguestfs", "")


@pytest.mark.parametrize(
    "line, expected",
    [
        ('{"a":1}', "json"),
        ('2026-03-03T11:13:16.103258979Z {"a":1}', "json"),
        ('  {"a"', "json"),
        ("I0303 x", "klog"),
        ("I030 x", None),
        ('1.1.1.1 - - [03/Mar/2026 11:14:56] "GET / HTTP/1.1" 200 -', "clf"),
        ("a=1 b=2 c=3", "logfmt"),
        ("a=1 b=2", None),
        ("info: virt-v2v: x", "virtv2v"),
        ("info: x", None),
        ("[   0.0] Setting up", "virtv2v"),
        ("[    0.717989] Booting", None),
        ("augeas x", "virtv2v"),
        ("free text", None),
        ("   ", None),
    ],
)
def test_line_class(spark, line, expected):
    row = spark.createDataFrame([(line,)], "value string").select(line_class(F.col("value")).alias("c")).first()
    assert row.c == expected


def test_json_strings_with_escaped_looks(spark):
    rows = parsed(spark, "json", '{"msg":"m","s":"\\u005b1,2]","n":{"a":1}}', '{"d":"\\u0031234567","e":"1\\u002e50","l":[1]}')
    assert [r.fields for r in rows] == [{"s": "[1,2]", "n": "a=1"}, {"d": "1234567", "e": "1.50", "l": "1"}]


def test_many_nested_objects_in_one_line(spark):
    import time

    from lodeglass.functions.values import depth

    line = '{"l":[' + ",".join('{"a":%d,"b":"[{"}' % k for k in range(8000)) + "]}"
    parsed(spark, "json", '{"l":[{"a":1}]}')
    begun = time.perf_counter()
    (row,) = parsed(spark, "json", line)
    assert row.fields["l"] == ",".join(f"a={k} b=[{{" for k in range(8000))
    assert time.perf_counter() - begun < 6
    cases = {"1": 0, "[]": 1, '{"a":[{"b":"]]}}[["}]}': 3, '"[[\\"["': 0, "[[],[[]]]": 3}
    df = spark.createDataFrame([(k,) for k in cases], "j string").select("j", depth(F.col("j")).alias("d"))
    assert {r.j: r.d for r in df.collect()} == cases


def test_json_strings_that_look_like_other_values(spark):
    rows = parsed(
        spark,
        "json",
        '{"s":"1234567","n":1234567,"t":"[1, 2]","l":[1, 2],"o":"{}"}',
        '{"s":"1234567","t":"{\\"a\\": 1}","d":"1.50"}',
        '{"n": 1.50,"big":123456789012345678901234567890,"neg":-0.00001,"e":1e3,"z":null}',
        '{"o":{"s":"1.50","n":1.50,"q":"a\\"b"},"ip":"10.0.0.1"}',
        '{"level":{"a":1.5},"msg":["x",{"b":null}],"logger":12345678}',
    )
    assert [r.fields for r in rows[:4]] == [
        {"s": "1234567", "n": "1.234567e+06", "t": "[1, 2]", "l": "1,2", "o": "{}"},
        {"s": "1234567", "t": '{"a": 1}', "d": "1.50"},
        {"n": "1.5", "big": "1.2345678901234568e+29", "neg": "-1e-05", "e": "1000", "z": "<nil>"},
        {"o": 'n=1.5 q=a"b s=1.50', "ip": "10.0.0.1"},
    ]
    assert (rows[4].level, rows[4].message, rows[4].logger) == ("MAP[A:1.5]", "[x map[b:<nil>]]", "1.2345678e+07")


def test_wide_object_that_repeats_keys(spark):
    """The last value of each key, in time that does not grow with the square of the members."""
    import time

    members = ",".join(f'"k{i % 7000:05}":{{"n":{i}.5,"s":"x y"}}' for i in range(20_000))
    begun = time.perf_counter()
    (row,) = parsed(spark, "json", f'{{"o":{{{members}}}}}')
    last = {i % 7000: i for i in range(20_000)}
    assert row.fields["o"] == " ".join(f"k{k:05}=n={last[k]}.5 s=x y" for k in sorted(last))
    assert time.perf_counter() - begun < 15


def test_control_characters_and_structure_in_nested_strings(spark):
    line = r'{"o":{"b\u0001":"{\u0002","a\u0007A":["]\u0000,","\u0003:"],"b":"\\u0001\"","b\u0001":"}","\u0008":{"":[]}},"msg":{"a:":"null","c":null}}'
    (row,) = parsed(spark, "json", line)
    assert row.fields == {"o": '\b== a\x07A=]\0,,\x03: b=\\u0001" b\x01=}'}
    assert row.message == "map[a::null c:<nil>]"


def test_nested_numbers(spark):
    numbers = {"1.5": "1.5", "-0.25": "-0.25", "999999": "999999", "1000000": "1e+06", "0.0001": "0.0001", "0.00001": "1e-05", "1.50": "1.5", "100": "100", "0": "0", "1e2": "100", "-12.0": "-12", "123456.7": "123456.7", "0.1234567891": "0.1234567891"}
    (row,) = parsed(spark, "json", '{"l":[%s],"o":{"n":%s}}' % (",".join(numbers), "7.25"))
    assert row.fields == {"l": ",".join(numbers.values()), "o": "n=7.25"}
