import datetime as dt

from pyspark.sql import functions as F

from weftgraph.llm import url_filters as uf


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


ENTRIES = [("l", "block", "bad.com", "add", 10), ("l", "block", "bad.com", "add", 12), ("l", "block", "bad.com", "remove", 20), ("l", "block", "bad.com", "add", 30), ("m", "allow", "ok.bad.com", "add", 15),
           ("m", "block", "same.com", "add", 5), ("n", "allow", "same.com", "add", 8), ("l", "block", "gone.com", "remove", 3), ("l", "block", "gone.com", "add", 3), ("l", "block", None, "add", 1), ("l", "block", "com.au", "add", None)]


def run(spark, captures):
    e = spark.createDataFrame([(*x[:4], None if x[4] is None else day(x[4])) for x in ENTRIES], "list string, action string, key string, event string, date date")
    c = spark.createDataFrame([(i, u, None if d is None else day(d)) for i, (u, d) in enumerate(captures)], "page_id long, url string, fetched date")
    rows = uf.filter_urls(c.withColumns({"action": F.lit("x"), "blocked": F.lit(1)}), e).collect()
    return [(r["blocked"], r["list_key"]) for r in sorted(rows, key=lambda r: r["page_id"])]


def test_entries_hold_from_their_day_until_removed(spark):
    days = [9, 10, 12, 19, 20, 29, 30, 900]
    assert run(spark, [("http://bad.com/x", d) for d in days]) == [(d in (10, 12, 19, 30, 900), "bad.com" if d in (10, 12, 19, 30, 900) else None) for d in days]


def test_hosts_parents_and_precedence(spark):
    cases = [
        (("HTTPS://u@Sub.BAD.com.:80/p?q#f", 11), (True, "bad.com")), (("http://notbad.com", 11), (False, None)), (("http://ok.bad.com", 14), (True, "bad.com")),
        (("http://x.ok.bad.com", 16), (False, "ok.bad.com")), (("http://same.com", 6), (True, "same.com")), (("http://same.com", 9), (False, "same.com")), (("http://gone.com", 4), (False, None)),
        ((None, 11), (False, None)), (("no url", 11), (False, None)), (("http://bad.com", None), (False, None)), (("http://" + "a." * 5000 + "bad.com", 11), (True, "bad.com")), (("http://bad.com", 11), (True, "bad.com")),
        (("http://bad.com", 11), (True, "bad.com")),
    ]
    assert run(spark, [c for c, _ in cases]) == [w for _, w in cases]


def test_empty_tables(spark):
    assert run(spark, [("http://a", 1)][:0]) == []
    pages = spark.createDataFrame([(1, "http://spam-farm.example.org/", "x")], "page_id long, url string, html string")
    rows = uf.filter_urls(uf.page_captures(pages), uf.page_entries(pages).limit(0)).collect()
    assert [r["blocked"] for r in rows] == [False]


HOSTS = {
    "https://[2001:db8::1]:8080/x": "[2001:db8::1]", "http://u:p@ss@evil.com/": "evil.com", "http://evil.com?x=@ok.com": "evil.com", "http://A.B.:80": "a.b", "ftp://a.b": None, "http://": None, "x": None, None: None, "http://a.b/c@d": "a.b",
}


def test_hosts_in_spark_and_in_sql(spark):
    import duckdb

    found = duckdb.execute(f"SELECT url, {uf._HOST} FROM (SELECT url, {uf._PLACE} AS place FROM (SELECT unnest(?) AS url))", [list(HOSTS)]).fetchall()
    assert dict(found) == HOSTS
    rows = spark.createDataFrame([(x,) for x in HOSTS], "url string").select("url", uf.host(F.col("url")).alias("h")).collect()
    assert {r["url"]: r["h"] for r in rows} == HOSTS


def brute(captures, entries):
    """Every capture against every entry of its host's keys."""
    out = []
    for host, at in captures:
        parts = host.split(".")
        best = None
        for key in [".".join(parts[i:]) for i in range(len(parts))]:
            for name in {e[:2] for e in entries if e[2] == key}:
                past = [(e[4], e[3] == "remove") for e in entries if e[:3] == (*name, key) and e[4] <= at]
                if past and not max(past)[1]:
                    best = max(best or (0,), (len(key), name[1] == "allow", name[0], key))
        out.append((bool(best and not best[1]), best and best[2], best and best[3]))
    return out


def test_equals_brute_force(spark):
    import random

    r = random.Random(4)
    keys = ["a.com", "b.a.com", "c.b.a.com", "com", "z.org"]
    entries = [(r.choice("lmn"), r.choice(["block", "allow"]), r.choice(keys[:2] if r.random() < 0.7 else keys), r.choice(["add", "remove"]), r.randrange(0, 400)) for _ in range(300)]
    captures = [(r.choice(["a.com", "x.b.a.com", "c.b.a.com", "q.com", "z.org", "none.net"]), r.randrange(-5, 420)) for _ in range(400)]
    e = spark.createDataFrame([(*x[:4], day(x[4])) for x in entries], "list string, action string, key string, event string, date date")
    for cast in ("date", "timestamp"):
        c = spark.createDataFrame([(i, f"http://{h}/", day(d)) for i, (h, d) in enumerate(captures)], "page_id long, url string, fetched date").withColumn("fetched", F.col("fetched").cast(cast))
        rows = sorted(uf.filter_urls(c, e).collect(), key=lambda x: x["page_id"])
        assert [(x["blocked"], x["list_name"], x["list_key"]) for x in rows] == brute(captures, entries)


def test_ties_null_ids_and_columns_of_the_caller(spark):
    entries = [("m", "block", "t.com", "add", 1), ("n", "block", "t.com", "add", 1), ("m", "allow", "u.com", "add", 1), ("n", "block", "u.com", "add", 1), ("l", "block", "0.1", "add", 1)]
    e = spark.createDataFrame([(*x[:4], day(x[4])) for x in entries], "list string, action string, key string, event string, date date")
    rows = [(None, "http://t.com", day(2)), (None, "http://t.com", day(2)), (1, "http://u.com", day(2)), (2, "http://10.0.0.1/", day(2))]
    c = spark.createDataFrame(rows, "page_id long, url string, fetched date").withColumns({n: F.lit(n) for n in ("host", "_host", "_at", "at", "best", "_best", "_h", "key", "Asked_Host", "list_key")})
    out = uf.filter_urls(c, e)
    assert set(out.columns) == {*c.columns, "blocked", "list_name"} and [out.first()[n] for n in ("host", "_host", "_at", "at", "best", "_best", "_h", "key", "Asked_Host")] == ["host", "_host", "_at", "at", "best", "_best", "_h", "key", "Asked_Host"]
    assert sorted((str(r["page_id"]), r["blocked"], str(r["list_name"])) for r in out.collect()) == [("1", False, "m"), ("2", False, "None"), ("None", True, "n"), ("None", True, "n")]
