import sys
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def test_entry_without_the_training_data_operators(monkeypatch):
    """The subpackage may be gone."""
    for name in [m for m in sys.modules if m.startswith("logweave.llm") or m in ("__spark_entry__", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "logweave.llm", None)
    import __spark_entry__ as entry

    assert "mine_templates" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _events(spark, path, ids):
    import datetime

    rows = [(i, datetime.datetime(2024, 1, 1), u, "view", 1.0) for i, u in ids]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_ipv6_of_large_numbers(spark, tmp_path):
    """Their lines hold addresses too; the mask leaves groups of five digits alone."""
    from logweave.functions import masking
    from logweave.plans import queries

    got = queries.QUERIES["mask_ipv6"](spark, _events(spark, tmp_path, [(1, 0), (65536, 65535), (36_000_000, 540_000)])).collect()
    assert all(" from $v $v <view> " in r.masked for r in got) and len(got) == 3
    assert spark.range(1).select(masking.IPV6(masking.F.lit("2001:db8::1:10000 [2001:db8::1:1:0]:80"))).first()[0] == "2001:db8::1:10000 $v"


def test_host_of_large_numbers(spark, tmp_path):
    """A group of five digits makes a name, as inet_pton has it."""
    from logweave.plans import queries

    got = {r.event_id: (r.kind, r.addr) for r in queries.QUERIES["log_hosts"](spark, _events(spark, tmp_path, [(1, 65534), (4, 65535)])).collect()}
    assert got == {1: ("ipv6", "2001:db8::ffff"), 4: ("name", "2001:db8::10000")}


def test_params_beyond_the_table():
    """The table's rows are counted, of all positions; a template that came of a split has * for what was given up."""
    from logweave.operators import templates

    bucket = templates.Bucket(0.34, True)
    for u in range(1000, 1400):
        for status in ("failed", "successful"):
            bucket.add(f"Login of user u{u}, status: {status}")
    assert {p: len(v) for p, v in bucket.nodes[0].params.items()} == {3: 251, 5: 2} and bucket.nodes[0].exceeded == {3}
    bucket = templates.Bucket(0.34, True)
    for u in range(1000, 1600):
        bucket.add(f"User u{u} {('logged on', 'saved state')[u % 2]} successfully")
    assert {t.text: t.params for t, _ in bucket.result(True)} == {f"User <*> {x} successfully": {1: {"*"}} for x in ("logged on", "saved state")}
