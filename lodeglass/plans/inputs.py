"""Log lines and cluster objects derived from the given tables, row by row, so that they grow with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Level words as each event type's lines spell them.
LEVEL_WORDS = {"error": "error", "purchase": "warning", "click": "dbg", "signup": "information", "view": "notice"}


def _level_word() -> Column:
    return F.create_map(*[F.lit(x) for kv in LEVEL_WORDS.items() for x in kv])[F.col("event_type")]


def _text(*parts: str | Column) -> Column:
    """Concatenation where ``$name`` is a column and other strings are themselves."""
    out = []
    for part in parts:
        if isinstance(part, str) and part.startswith("$"):
            out.append(F.col(part[1:]).cast("string"))
        else:
            out.append(F.lit(part) if isinstance(part, str) else part)
    return F.concat(*out)


def _stamp(form: str) -> Column:
    return F.date_format("ts", form)


_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_SAID = ("user ", "$user_id", " did ", "$event_type")


def zap_line() -> Column:
    body = _text(
        '{"level":"', _level_word(), '","ts":"', _stamp(_ISO), 'Z","logger":"', "$event_type", "|u", "$user_id",
        '","msg":"', *_SAID, '","caller":"', "$event_type", ".go:", "$user_id", '","event":', "$event_id",
        ',"props":', "$props", "}",
    )
    # Some lines carry the container runtime's stamp in front.
    return F.when(F.col("event_type") == "purchase", F.concat(_stamp(_ISO), F.lit("000Z "), body)).otherwise(body)


def logrus_line() -> Column:
    return _text(
        '{"component":"', "$event_type", '","pos":"', "$event_type", ".go:", "$user_id", '","timestamp":"',
        _stamp("yyyy-MM-dd HH:mm:ss.SSS"), '","level":"', _level_word(), '","msg":"', *_SAID, '","user":', "$user_id", "}",
    )


def nested_line() -> Column:
    return _text(
        '{"msg":"nested","z":{"b":{"user":', "$user_id", ',"type":"', "$event_type", '"},"a":[', "$user_id",
        ',"q",null,true]},"list":[', "$props", ',["', "$event_type", '"]],"none":null,"value":', "$value", "}",
    )


def repeated_line() -> Column:
    """Objects that repeat a key at several depths."""
    return _text(
        '{"z":{"k":', "$user_id", ',"b":{"x":1,"x":{"y":0,"y":"', "$event_type", '"}},"k":', "$user_id", '.5},"list":[{"a":1,"a":"',
        "$event_type", '"},', "$user_id", '],"msg":{"m":null,"m":"', "$event_type", '"}}',
    )


def klog_line() -> Column:
    letter = F.when(F.col("event_type") == "error", "E").when(F.col("event_type") == "purchase", "W").otherwise("I")
    return _text(
        letter, _stamp("MMdd HH:mm:ss.SSSSSS"), "       1 ", "$event_type", ".go:", "$user_id", "] ", *_SAID
    )


def klog_pairs_line() -> Column:
    return _text(
        "I", _stamp("MMdd HH:mm:ss.SSSSSS"), '       1 pairs.go:7] "msg"="', *_SAID, '" "logger"="', "$event_type",
        '" "user"="', "$user_id", '" "user"="u', "$user_id", '"',
    )


def logfmt_line() -> Column:
    return _text(
        "time=", _stamp(_ISO), "Z level=", _level_word(), ' msg="', *_SAID, '" logger=', "$event_type",
        " user=", "$user_id", " event=", "$event_id", " user=u", "$user_id",
    )


def access_line() -> Column:
    status = F.when(F.col("event_type") == "error", "500").when(F.col("event_type") == "purchase", "404").otherwise("200")
    user = F.when(F.col("event_type") == "view", "-").otherwise(F.concat(F.lit("u"), F.col("user_id")))
    return _text(
        "10.0.0.", "$user_id", " - ", user, " [", _stamp("dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /', "$event_type", "/",
        "$event_id", ' HTTP/1.1" ', status, " ", "$event_id",
    )


def conversion_line() -> Column:
    kind = F.col("event_type")
    percent = F.regexp_extract("props", r"(\d+)", 1)
    return (
        F.when(kind == "signup", "[   0.0] Setting up the source: -i libvirt")
        .when(kind == "purchase", "[ 147.3] Copying disk 1/3")
        .when(kind == "click", _text("virt-v2v monitoring: Progress update, completed ", percent, " %"))
        .when(kind == "view", _text("libguestfs: trace: v2v: op_", "$event_id"))
        .otherwise(_text("nbdkit: vddk[1]: debug: ", _stamp("yyyy-MM-dd'T'HH:mm:ss.SSS"), "Z warning"))
    )


def text_line() -> Column:
    return _text(*_SAID)


def lines(events: DataFrame, value: Column) -> DataFrame:
    return events.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("line_no"), value.alias("value"))


# The six kinds of source, by user.
SOURCE_KINDS = (zap_line, klog_line, logfmt_line, access_line, conversion_line, text_line)


def source_line() -> Column:
    """Every user is a source that logs in one format."""
    kind = F.pmod("user_id", F.lit(len(SOURCE_KINDS)))
    chain = F.when(F.lit(False), F.lit(""))
    for number, line in enumerate(SOURCE_KINDS):
        chain = chain.when(kind == number, line())
    return chain


#: How far before the event its klog line is written: the lines of a month go over a new year.
KLOG_SHIFT = "15 days"


def dated_line() -> Column:
    """The same sources with stamps of many forms, and with other dates inside the lines."""
    until = " until 2030-01-01T00:00:00Z"
    kind, micros = F.col("event_type"), F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (micros / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(16,6)").cast("string")
    number = F.when(kind == "view", (micros / 1000).cast("long").cast("string")).otherwise(seconds)
    iso = F.concat(F.lit('"'), F.date_format(F.col("ts") + F.expr("interval 2 hours"), _ISO), F.lit('+02:00"'))
    zap = _text(
        '{"level":"', _level_word(), '","msg":"', *_SAID, until, '","ts":', F.when(kind == "purchase", iso).otherwise(number),
        ',"caller":"', "$event_type", '.go:1"}',
    )
    early = F.date_format(F.col("ts") - F.expr(f"interval {KLOG_SHIFT}"), "MMdd HH:mm:ss.SSSSSS")
    klog = _text("I", early, "       1 ", "$event_type", ".go:", "$user_id", "] ", *_SAID, until)
    logfmt = _text("level=", _level_word(), ' msg="', *_SAID, until, '" ts=', _stamp(_ISO), "Z event=", "$event_id")
    access = _text(
        "10.0.0.1 - - [", _stamp("dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /2030-01-01T00:00:00Z/', "$event_id", ' HTTP/1.1" 200 1'
    )
    text = F.when(F.col("event_id") % 2 == 0, _text(_stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"), " ", *_SAID, until)).otherwise(_text(*_SAID, until))
    chain = F.when(F.lit(False), F.lit(""))
    for number_of, line in enumerate((zap, klog, logfmt, access, conversion_line(), text)):
        chain = chain.when(F.pmod("user_id", F.lit(len(SOURCE_KINDS))) == number_of, line)
    return chain


def mixed_line() -> Column:
    """Formats change from line to line within a source."""
    kind = F.col("event_type")
    return F.when(kind.isin("error", "click"), zap_line()).when(kind == "view", klog_line()).otherwise(text_line())


def line_objects(lineitem: DataFrame, *extra: str) -> DataFrame:
    """One nested object per order line; its item list has ``l_linenumber - 1`` elements, so it may be empty."""
    numbers = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: i < F.col("l_linenumber"))

    def item(i: Column) -> Column:
        return F.struct(
            F.concat(F.lit("part-"), i.cast("string")).alias("part"),
            (F.col("l_quantity").cast("long") * i).alias("qty"),
            F.when(i != 3, F.col("l_partkey") + i).alias("price"),
            (i % 2 == 0).alias("ret"),
            F.array(F.concat(F.lit("a"), i.cast("string")), F.concat(F.lit("b"), i.cast("string"))).alias("tags"),
        )

    return lineitem.select(
        F.struct(
            F.concat(F.lit("line-"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("name"),
            F.concat("l_returnflag", "l_linestatus").alias("namespace"),
            F.create_map(
                F.lit("app.kubernetes.io/name"), F.concat(F.lit("supp-"), F.col("l_suppkey")),
                F.lit("Tier"), F.col("l_returnflag"),
            ).alias("labels"),
        ).alias("metadata"),
        F.struct(
            F.when(F.col("l_linestatus") == "O", "Running").otherwise("Succeeded").alias("phase"),
            F.col("l_tax").alias("tax"),
        ).alias("status"),
        F.struct(F.transform(numbers, item).alias("items")).alias("spec"),
        F.col("l_orderkey").alias("key"),
        F.col("l_linenumber").cast("long").alias("n"),
        *extra,
    )


def customer_table(customer: DataFrame) -> DataFrame:
    """Rows as a server sends them: the object and its display cells, of which some rows lack the last."""
    cells = F.array("c_name", F.col("c_mktsegment"), F.col("c_custkey").cast("string"))
    obj = F.struct(
        F.struct(
            F.col("c_name").alias("name"), F.concat(F.lit("ns-"), F.col("c_nationkey")).alias("namespace")
        ).alias("metadata"),
        F.struct(F.col("c_mktsegment").alias("phase"), F.col("c_acctbal").alias("balance")).alias("status"),
    )
    short = F.col("c_mktsegment") == "MACHINERY"
    return customer.select(
        F.lit("Customer").alias("kind"),
        obj.alias("object"),
        F.when(short, F.slice(cells, 1, 2)).otherwise(cells).alias("cells"),
    )


HEADERS = ("Name", "Mkt Segment", "Age")


def workloads(customer: DataFrame) -> DataFrame:
    """Every customer is a workload that selects the orders of that customer, by segment in a different way."""
    segment = F.col("c_mktsegment")
    own = F.create_map(F.lit("customer"), F.col("c_custkey").cast("string"))
    need = "array<struct<key:string,op:string,values:array<string>>>"

    def needs(key: str, op: str, *values: str) -> Column:
        listed = F.array(*[F.lit(v) for v in values]).cast("array<string>")
        return F.array(F.struct(F.lit(key).alias("key"), F.lit(op).alias("op"), listed.alias("values"))).cast(need)

    is_job = segment == "HOUSEHOLD"
    return customer.select(
        _namespace(F.col("c_custkey")).alias("namespace"),
        F.when(is_job, "Job").otherwise("Deployment").alias("kind"),
        F.col("c_name").alias("name"),
        F.when(~is_job, own).alias("match_labels"),
        F.when(segment == "BUILDING", needs("priority", "In", "1-URGENT", "2-HIGH"))
        .when(segment == "MACHINERY", needs("priority", "NotIn", "5-LOW"))
        .when(segment == "FURNITURE", needs("open", "Exists"))
        .when(segment == "AUTOMOBILE", needs("open", "DoesNotExist"))
        .alias("match_expressions"),
        F.when(is_job, own).alias("template_labels"),
    )


def open_workloads(nation: DataFrame) -> DataFrame:
    """Every nation is a workload without any positive condition."""
    sort = F.pmod("n_nationkey", F.lit(3))
    need = "array<struct<key:string,op:string,values:array<string>>>"
    texts = "map<string,string>"

    def needs(key: str, op: str, *values: str) -> Column:
        listed = F.array(*[F.lit(v) for v in values]).cast("array<string>")
        return F.array(F.struct(F.lit(key).alias("key"), F.lit(op).alias("op"), listed.alias("values"))).cast(need)

    return nation.select(
        _namespace(F.col("n_nationkey")).alias("namespace"),
        F.when(sort == 2, "Job").otherwise("Deployment").alias("kind"),
        F.col("n_name").alias("name"),
        F.lit(None).cast(texts).alias("match_labels"),
        F.when(sort == 0, needs("priority", "NotIn", "1-URGENT", "5-LOW"))
        .when(sort == 1, needs("open", "DoesNotExist"))
        .alias("match_expressions"),
        F.lit(None).cast(texts).alias("template_labels"),
    )


def pod_lines(events: DataFrame, orders: DataFrame, among: int) -> DataFrame:
    """Every event is a line of an order's pod, in one of two containers; keys of orders are below ``among``."""
    order = F.pmod("event_id", F.lit(among))
    keyed = events.select(
        order.alias("o_orderkey"), F.col("event_id").alias("line_no"), zap_line().alias("value"),
        F.when(F.col("event_id") % 2 == 0, "main").otherwise("side").alias("container"),
    )
    owner = orders.select("o_orderkey", _namespace(F.col("o_custkey")).alias("namespace"))
    return keyed.join(owner, "o_orderkey").select(
        "namespace", F.concat(F.lit("pod-"), "o_orderkey").alias("pod"), "container", "line_no", "value"
    )


def pods(orders: DataFrame) -> DataFrame:
    """Every order is a pod; only open orders carry the ``open`` label."""
    status = F.col("o_orderstatus")
    labels = F.map_filter(
        F.create_map(
            F.lit("customer"), F.col("o_custkey").cast("string"),
            F.lit("priority"), F.col("o_orderpriority"),
            F.lit("open"), F.when(status == "O", F.lit("")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return orders.select(
        _namespace(F.col("o_custkey")).alias("namespace"),
        F.concat(F.lit("pod-"), F.col("o_orderkey")).alias("name"),
        labels.alias("labels"),
        F.when(status == "F", "Running").otherwise("Pending").alias("phase"),
        F.col("o_orderkey").alias("pos"),
    )


def _namespace(customer_key: Column) -> Column:
    return F.concat(F.lit("ns-"), F.pmod(customer_key, F.lit(7)))


def containers() -> Column:
    """Container names of an order line's pod: ``l_linenumber`` of seven, sidecars first for returned lines."""
    names = ("istio-proxy", "vector", "app-a", "fluent-bit", "app-b", "envoy", "app-c")
    forward = F.array(*[F.lit(n) for n in names])
    listed = F.when(F.col("l_returnflag") == "R", forward).otherwise(F.reverse(forward))
    return F.slice(listed, F.lit(1), F.col("l_linenumber"))
