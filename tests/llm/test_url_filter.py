"""Entries on any host above a capture's are consulted."""

import datetime

from orrery.llm import url_filter


def test_hosts_of_many_labels(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    entries = spark.createDataFrame([("c.d.e.f.g.h.i", "block", day(1)), ("f.g.h.i", "allow", day(1)), ("a.b.c.d.e.f.g.h.i", "allow", day(5))], "host string, action string, listed_at timestamp")
    cases = [("http://b.c.d.e.f.g.h.i/", 2, False, "c.d.e.f.g.h.i"), ("http://a.b.c.d.e.f.g.h.i/", 2, False, "c.d.e.f.g.h.i"), ("http://a.b.c.d.e.f.g.h.i/", 6, True, "a.b.c.d.e.f.g.h.i"), ("http://x.d.e.f.g.h.i/", 2, True, "f.g.h.i")]
    df = spark.createDataFrame([(i, u, day(d)) for i, (u, d, _, _) in enumerate(cases)], "id long, url string, fetched_at timestamp")
    out = {r.id: (r.url_kept, r.listed_host) for r in url_filter.evaluated(df, entries).collect()}
    assert out == {i: (k, h) for i, (_, _, k, h) in enumerate(cases)}
