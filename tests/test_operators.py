import datetime
import pickle
import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.kernels import host
from logweave.operators import clustering, parsing, templates
from logweave.operators.graph import connected_components
from logweave.plans import pipelines
from logweave.sources import text as sinks
from logweave.streaming import online

LINES = [
    "Folder /srv/one_x was made", "Folder /srv/two_y was made", "Entry of guest Ann, result: good", "Entry of guest Bob, result: bad", "Entry of guest Cid, result: bad",
    "Guest Ann went off gladly", "Guest Bob went off gladly",
]


def mined(spark, lines, threshold, **options):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return templates.TemplateMiner(threshold, True, **options).mine(df)


def test_templates(spark):
    got = {r.template for r in mined(spark, LINES, 0.34).collect()}
    assert got == {"Folder <*> was made", "Entry of guest <*>, result: <*>", "Guest <*> went off gladly"}
    # two positions that determine each other are put back
    assert {r.template for r in mined(spark, LINES[:4], 0.34).collect()} == {"Folder <*> was made", *LINES[2:4]}
    assert {r.template for r in mined(spark, LINES[:4], 0.34, split=False).collect()} == {"Folder <*> was made", "Entry of guest <*>, result: <*>"}
    assert {r.template for r in mined(spark, LINES[:2], 0.75).collect()} == set(LINES[:2])  # not greater than the threshold
    assert mined(spark, ["", None], 0.5).count() == 0


def test_template_params_and_text(spark):
    df = mined(spark, LINES, 0.34)
    params = {r.template: r.params for r in df.collect()}
    assert params["Entry of guest <*>, result: <*>"] == {3: ["Ann", "Bob", "Cid"], 5: ["bad", "good"]}
    values = {r.value for r in sinks.template_param_lines(df).collect()}
    assert "Guest <*> went off gladly\n  Params at pos 1: Ann Bob" in values
    found = templates.matches(spark.createDataFrame([(LINES[3],), ("nothing",)], "value string"), df)
    assert {r.line: r.params for r in found.collect()} == {LINES[3]: ["Bob", "bad"], "nothing": None}


def test_table_is_reduced():
    bucket = templates.Bucket(0.1, False)
    for i in range(600):
        bucket.add(f"key a{i} b{i % 3} end")
    (node,) = bucket.nodes
    assert node.exceeded == {1} and len(node.table) <= templates.TABLE_ROWS and node.text == "key <*> <*> end"


def test_separators_and_keys():
    bucket = templates.Bucket(0.1, False)
    for line in ("x a=1", "x b=1", "x,c 2"):
        bucket.add(line)
    assert [n.text for n in bucket.nodes] == ["x a=1", "x b=1", "x,c 2"]


def test_stream_gives_what_the_batch_does(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(LINES))
    miner = templates.TemplateMiner(0.34, True, False)
    updates = online.mine_stream(sinks.stream_lines(spark, str(tmp_path / "in")), miner)
    query = updates.writeStream.outputMode("update").format("memory").queryName("updates").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.template for r in online.latest(spark.table("updates")).collect()}
    assert got == {r.template for r in mined(spark, LINES, 0.34, split=False).collect()}


def test_parsing(spark):
    lines = [
        "May  2 12:41:35 blub.local sshd[42]: Accepted key", "May 12 12:41:35 127.0.0.1 postfix/smtpd: x: y", "May 12 12:41:35 2001:db8::2:1 p[]: m",
        "May 12 12:41:35 h p[a]: m", "May 12 12:41:35 h nocolon", "May 12 12:41:35 h :m", "May 12 12:41:35 h p:", "  ",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = parsing.parse_lines(df, "${DATE} ${ORIGIN} ${MESSAGE}", year=2018).orderBy("i").collect()
    assert [r._error for r in got] == [False] * 3 + [True] * 4
    assert [(r.process, r.pid, r.message, r.origin.kind) for r in got[:3]] == [("sshd", 42, "Accepted key", "name"), ("postfix/smtpd", None, "x: y", "ipv4"), ("p", 0, "m", "ipv6")]
    assert got[0].ts == datetime.datetime(2018, 5, 2, 12, 41, 35)
    several = spark.createDataFrame([("p[1][2]: m",), ("[7]: m",), ("p[1]x]: m",), ("p]: m",), ("p[1][]: m",)], "v string")
    parts = parsing.split_message(F.col("v"))
    assert [tuple(r) for r in several.select("v", *[c.alias(k) for k, c in parts.items()]).collect()] == [
        ("p[1][2]: m", "p[1]", 2, "m", False), ("[7]: m", "", 7, "m", False), ("p[1]x]: m", None, None, None, True), ("p]: m", None, None, None, True), ("p[1][]: m", "p[1]", 0, "m", False),
    ]
    for bad in ("${DATE", "${NOPE}", "${MESSAGE} ${DATE}"):
        with pytest.raises(parsing.FormatError):
            parsing.compile_format(bad)
    with pytest.raises(Exception, match="can't parse"):
        parsing.parse_lines(df.where("i = 4"), "${DATE} ${ORIGIN} ${MESSAGE}", mode="FAILFAST").collect()


def test_levels_and_ignore(spark):
    df = spark.createDataFrame([("mail err a b p: m",), ("nope err a b p: m",), ("mail what a b p: m",)], "value string")
    got = parsing.parse_lines(df, "${FACILITY} ${SEVERITY} ${IGNORE} ${IGNORE} ${MESSAGE}").collect()
    assert [(r.facility, r.severity, r._error) for r in got] == [(2, 3, False), (None, 3, True), (2, None, False)]
    literal = parsing.parse_lines(spark.createDataFrame([("X X p: m",)], "value string"), "${FACILITY} ${SEVERITY} ${IGNORE} ${MESSAGE}", compat="reference").first()
    assert (literal.facility, literal.severity, literal.message) == (0, 0, "m")


def test_times(spark):
    df = spark.createDataFrame([("2018-05-02T12:41:35+02:00", "2018-05-03T15:18:11Z")], "a string, b string")
    for compat, seconds in (("intent", 102996), ("reference", 88596)):
        r = df.select(F.unix_micros(parsing.iso_time(F.col("b"), compat)) - F.unix_micros(parsing.iso_time(F.col("a"), compat))).first()
        assert r[0] == seconds * 1_000_000
    assert host("2001:DB8::0:1") == ("ipv6", "2001:db8::1") and host("1.2.3") == ("name", "1.2.3")


def test_clusters(spark):
    texts = ["Hallo Peter", "Hallo Heter", "Hallo Karl", "Hallp Peter"]
    df = spark.createDataFrame([("p", t) for t in texts], "process string, message string")
    from logweave.functions.distance import weighted_text_distance as wed

    got = clustering.agglomerative(df, [], "message", lambda a, b: wed(a, b) < 0.25)
    ids = {r.message: r.cluster_id for r in got.collect()}
    assert ids == {"Hallo Heter": 0, "Hallo Peter": 0, "Hallo Karl": 1, "Hallp Peter": 2}
    near = clustering.nearest_cluster(spark.createDataFrame([("Hallo Pter",)], "q string"), "q", got, "message", "cluster_id", wed).first()
    assert near.cluster_id == 0 and near.distance == pytest.approx(0.11920292202211755)
    by = clustering.cluster_by_process(df)
    assert by.select("cutoff").distinct().count() == 1 and by.count() == 4
    assert clustering.cluster_by_process(df.limit(0)).count() == 0
    same = spark.createDataFrame([("p", "a x"), ("p", "a y")], "process string, message string")
    assert {r.cluster_id for r in clustering.cluster_by_process(same).collect()} == {0}  # no cutoff: one cluster


def test_flat_and_nested(spark):
    lines = [f"May 12 12:41:35 h {p}: {m}" for p in ("a", "b") for m in ("User one came in today", "User two came in today", "Disk full", "Disk gone now")]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    flat = {r.message: r.cluster_id for r in pipelines.syslog_flat(df).collect()}
    assert len(flat) == 4
    nested = pipelines.syslog_nested(df)
    assert nested.count() == 8
    report = sinks.nested_report(clustering.leaves(nested)).collect()
    assert all(r.value[:2] in ("A-", "B-") for r in report)
    assert pipelines.syslog_by_process(df).count() == 8


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (3, 5), (None, 1), *((k, k + 1) for k in range(100, 160))], "src int, dst int")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8, 7: 7} | {k: 100 for k in range(100, 161)}
    assert connected_components(edges.limit(0)).count() == 0
    reach = clustering.reachable(spark.createDataFrame([(158,)], "node int"), edges.where("src is not null"))
    assert reach.count() == 61


def test_cli(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(LINES) + "\n\n")
    assert pipelines.main([str(tmp_path / "log"), str(tmp_path / "out")]) == 0
    assert {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == {"Folder <*> was made", "Entry of guest <*>, result: <*>", "Guest <*> went off gladly"}
    with pytest.raises(SystemExit):
        pipelines.main(["one"])


def test_sinks(spark):
    df = spark.createDataFrame([("p", 3, "m"), ("q", None, "n")], "process string, pid int, message string")
    assert [r.value for r in sinks.filtered_lines(df).collect()] == ["Process 'p' with PID '3' wrote 'm'", "Process 'q' wrote 'n'"]


@pytest.mark.parametrize("threshold", [-0.1, 0.0, 0.34, 0.5, 0.75, 1.0])
def test_index_finds_what_a_scan_does(monkeypatch, threshold):
    rand = random.Random(5)
    words = ["&v", "<*>", "a", "b", "c", "k1", "k2"]
    lines = sorted({"x " + rand.choice([" ", ",", "="]).join(rand.choice(words) for _ in range(6)) + rand.choice(["", " "]) for _ in range(600)})
    indexed, scanned = templates.Bucket(threshold, True), templates.Bucket(threshold, True)
    got = [indexed.add(x) for x in lines[:300]]
    indexed = pickle.loads(pickle.dumps(indexed))  # as a stream does between batches
    got += [indexed.add(x) for x in lines[300:]]
    monkeypatch.setattr(templates, "INDEXED", 1 << 60)
    assert got == [scanned.add(x) for x in lines] and [n.text for n in indexed.nodes] == [n.text for n in scanned.nodes]


def test_a_line_is_held_against_few_templates(monkeypatch):
    """Lines of a bucket that differ cost about as much as they are many."""
    calls, similarity = [], templates.Template.similarity
    monkeypatch.setattr(templates.Template, "similarity", lambda *a: calls.append(1) or similarity(*a))
    bucket = templates.Bucket(0.5, False)
    for i in range(1000):
        bucket.add(f"the a{i} of b{i} and c{i} d{i}")
    assert len(bucket.nodes) == 1000 and len(calls) < 2000


def test_frequencies(spark, monkeypatch):
    from logweave.functions import masking

    masked = []
    monkeypatch.setattr(masking, "DEFAULT", lambda c, chain=masking.DEFAULT: masked.append(1) or chain(c))
    df = spark.createDataFrame([(x,) for x in [*LINES, LINES[0], LINES[3], LINES[3], "", None]], "value string")
    assert {r.template: r.n for r in pipelines.template_frequencies(df).collect()} == {"Folder <*> was made": 3, "Entry of guest <*>, result: <*>": 5, "Guest <*> went off gladly": 2, None: 2}
    assert len(masked) == 1  # masks are most of the work
