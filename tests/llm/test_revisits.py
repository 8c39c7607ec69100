import random
from datetime import datetime, timedelta

from tessera.llm import warc_revisit

SCHEMA = "record_id long, url string, ts timestamp, kind string, status int, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>, near string, bucket int"


def brute(rows):
    out = []
    for r in rows:
        if r[3] != "revisit":
            continue
        earlier = [x for x in rows if x[3] == "response" and x[4] == 200 and x[1] is not None and x[1] == r[1] and None not in (x[2], r[2]) and x[2] < r[2]]
        best = max(earlier, key=lambda x: (x[2], x[0]), default=None)
        if best is None:
            out.append((r[0], "no response", None, None))
            continue
        agree = None
        for k in (5, 6, 7):
            if agree is None and r[k] is not None and best[k] is not None:
                agree = r[k].removeprefix("W/") == best[k].removeprefix("W/")
        verdict = {None: "unverified", True: "resolved", False: "changed"}[agree]
        if verdict == "changed":
            out.append((r[0], verdict, None, None))
        else:
            names = {h[0].lower() for h in r[8] or [] if h[0].lower() in warc_revisit.PERMITTED}
            merged = [tuple(h) for h in best[8] or [] if h[0].lower() not in names] + [tuple(h) for h in r[8] or [] if h[0].lower() in warc_revisit.PERMITTED]
            out.append((r[0], verdict, best[0], merged))
    return sorted(out)


def test_resolve_as_of(spark):
    pick = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        headers = [(n, str(pick.randint(0, 9))) for n in ("ETag", "Date", "Content-Type", "date") if pick.random() < 0.6]
        rows.append((
            i, pick.choice(["a.org/x", "a.org/x", "a.org/y", "b.org", None]), pick.choice([start + timedelta(minutes=10 * pick.randint(0, 200)), None]) if i % 9 == 0 else start + timedelta(minutes=10 * pick.randint(0, 200)),
            pick.choice(["response", "revisit", "request"]), pick.choice([200, 200, 404]), pick.choice([None, "1", "W/1", "2"]), pick.choice([None, "a", "b"]), pick.choice([None, "d"]), pick.choice([headers, headers, None]), "x", 1,
        ))
    got = warc_revisit.resolve(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    have = sorted((r.record_id, r.verdict, r.refers_to, None if r.headers is None else [tuple(h) for h in r.headers]) for r in got)
    assert have == brute(rows)
    assert {"resolved", "changed", "unverified", "no response"} == {h[1] for h in have}
    assert warc_revisit.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_canonical_urls(spark):
    urls = ["HTTP://www.A.org:80/x/?b=2&utm_source=q&a=1#top", "https://a.org/x?a=1&b=2", "a.org/x//?ref=1&a=1&b=2", None, "", "https://a.org"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in frame.select(warc_revisit.canonical_url(frame.url)).collect()]
    assert got == ["a.org/x?a=1&b=2"] * 3 + [None, "", "a.org"]
