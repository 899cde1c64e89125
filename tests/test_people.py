"""Groups, persons, topics, networks, clocks, similar attachments against plain Python."""

import datetime as dt
import ipaddress
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maillake.functions import headers as H
from maillake.operators import cohesion, geo, lists, people, routes, similar, wishes


def trusses(pairs):
    """Truss numbers by peeling."""
    left, out, k = {frozenset(p) for p in pairs if p[0] != p[1]}, {}, 2
    while left:
        while True:
            near = defaultdict(set)
            for a, b in map(tuple, left):
                near[a].add(b)
                near[b].add(a)
            weak = {e for e in left if len(set.intersection(*(near[x] for x in e))) < k - 1}
            if not weak:
                break
            out.update({tuple(sorted(e)): k for e in weak})
            left -= weak
        k += 1
    return out


def test_truss_numbers_by_peeling(spark):
    """A hub with a third of the links, a clique, a random part, repeated links and self-links."""
    rnd = random.Random(5)
    pairs = [(0, i) for i in range(1, 90)] + list(itertools.combinations(range(100, 109), 2)) + [(0, 100), (0, 101)]
    pairs += [tuple(rnd.sample(range(1, 45), 2)) for _ in range(180)] + [(7, 7), (0, 5), (5, 0)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    assert {(r.a, r.b): r.truss for r in cohesion.truss_numbers(df).collect()} == trusses(pairs)
    groups = {r.node: r.label for r in cohesion.cohesive_groups(df, 9).collect()}
    assert groups == {i: 100 for i in range(100, 109)}
    assert cohesion.truss_numbers(df.limit(0)).collect() == []


@pytest.mark.parametrize("listed", [40, 10**6])
def test_truss_numbers_over_blocks(spark, monkeypatch, listed):
    """Parts of the graph cut into blocks, worked on in rounds, and parts that share a task; long lists in several looks; text ids."""
    monkeypatch.setattr(cohesion, "LISTED", listed)
    rnd, pairs = random.Random(11), []
    for part in range(3):
        pairs += [tuple(100 * part + x for x in rnd.sample(range(40), 2)) for _ in range(260)]
    pairs += list(itertools.combinations(range(500, 506), 2)) + [(600, 601), (601, 602)]
    df = spark.createDataFrame([(f"p{a:03d}", f"p{b:03d}") for a, b in pairs], "src string, dst string")
    assert {(int(r.a[1:]), int(r.b[1:])): r.truss for r in cohesion.truss_numbers(df).collect()} == trusses(pairs)


@pytest.mark.parametrize("busy", [0, 3, 10**6])
def test_peeling_with_lists_and_with_bits(monkeypatch, busy):
    """No one, some or all are busy; a hub, a clique, parts, ids far apart; links leave together and lists are made anew."""
    monkeypatch.setattr(cohesion, "BUSY", busy)
    monkeypatch.setattr(cohesion, "LOOKED_UP", 50)
    rnd = random.Random(busy)
    pairs = [(0, 10**12 + i) for i in range(120)] + list(itertools.combinations(range(1000, 1012), 2)) + [(0, 1000), (0, 1001)]
    pairs += [tuple(10**12 + x for x in rnd.sample(range(90), 2)) for _ in range(700)] + [tuple(rnd.sample(range(-40, -10), 2)) for _ in range(150)]
    links = np.array(sorted({(min(p), max(p)) for p in pairs}))
    got = cohesion._peeled(links[:, 0], links[:, 1]) + 2
    assert dict(zip(map(tuple, links.tolist()), got.tolist())) == trusses(pairs)
    assert len(cohesion._peeled(links[:0, 0], links[:0, 1])) == 0


def test_parts_are_found_from_few_links_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(cohesion, "LISTED", 30)
    rnd = random.Random(3)
    pairs = {tuple(sorted(rnd.sample(range(50 * p, 50 * p + 50), 2))) for p in range(5) for _ in range(60)}
    got = cohesion._labelled(spark.createDataFrame(sorted(pairs), "x long, y long").repartition(3)).collect()
    want = _components({x for p in pairs for x in p}, pairs)
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
    assert sum(r.n for r in got if r.label < 50) == sum(a < 50 for a, _ in pairs if want[a] < 50)


def test_truss_numbers_leave_little_on_disk(spark):
    """Only the result stays in the shared folder, not the tables between the steps."""
    from pathlib import Path
    from urllib.parse import urlparse

    from maillake.session import ensure_checkpoint_dir

    folder = Path(urlparse(ensure_checkpoint_dir(spark)).path)

    def held():
        return {p: p.stat().st_size for p in folder.rglob("*") if p.is_file()}

    before, n = held(), 60_000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1 + F.col("id") % 3).alias("dst"))
    out = cohesion.truss_numbers(edges)
    assert out.count() == n
    assert sum(size for p, size in held().items() if p not in before) < 40 * n


def test_links_of_mail_from_one_reading_of_recipients(spark, tmp_path, monkeypatch):
    """Senders and neighbours on the list; equal and missing positions, ids and messages, a message that comes twice."""
    from maillake.plans import queries_people
    from maillake.sources.driver import SUPPLIER_ID_OFFSET, MailViews

    rnd = random.Random(9)
    orders = [(1, 5), (2, 6), (2, 7), (3, None), (None, 8), (4, 9)]
    lines = [(rnd.choice([1, 2, 3, 4, 77, None]), rnd.choice([1, 2, 3, 4, 5, 6, None]), rnd.choice([1, 2, 3, 4, None])) for _ in range(45)]
    day = dt.datetime(2020, 1, 1)
    spark.createDataFrame([(k, c, "F", 1.0, day, "5-LOW") for k, c in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, s, n, "O", day) for k, s, n in lines], "l_orderkey long, l_suppkey long, l_linenumber int, l_linestatus string, "
                          "l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(c, 1) for _, c in orders], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(cohesion, "truss_numbers", lambda edges: edges)
    edges = queries_people.cohesive_groups(MailViews(spark, str(tmp_path)))
    rows = [(k, s + SUPPLIER_ID_OFFSET, n) for k, s, n in lines if k and s]
    want = {(c, s) for o, c in orders for k, s, _ in rows if o == k and c}
    want |= {(s, t) for k, s, n in rows for j, t, m in rows if j == k and n and m and n + 1 == m and s != t}
    assert {(r.a, r.b) for r in cohesion.simple_links(edges).collect()} == {(min(p), max(p)) for p in want}
    assert edges._jdf.queryExecution().executedPlan().toString().count("FileScan parquet [l_orderkey") == 1


def test_levels_between_two_numbers():
    for old, new in [(5, 5), (6, 5), (70, 60), (64, 63), (63, 0), (64, 0), (200, 3), (128, 127), (2**31 - 1, 9), (2**31 - 1, 2**31 - 1)]:
        got = int(cohesion._levels(np.array([old], np.int32), np.array([new], np.int32))[0])
        assert got == sum(1 << b for b in {x % 64 for x in range(new + 1, min(old, new + 64) + 1)})


def test_no_one_has_many_outgoing_links(spark):
    pairs = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1, 399)]
    links = cohesion.simple_links(spark.createDataFrame(pairs, "src long, dst long"))
    assert cohesion._oriented(links).groupBy("u").count().agg(F.max("count")).first()[0] <= (2 * len(pairs)) ** 0.5
    assert cohesion.triangles(links).count() == 398


def test_addresses_and_networks(spark):
    rnd = random.Random(1)
    ips = ["10.1.2.3", "255.255.255.255", "256.1.1.1", "::", "::1", "2001:db8::1", "2001:DB8:0:0:1::", "::ffff:10.1.2.3", "1:2:3:4:5:6:7:8",
           "1::2::3", "12345::", "1:2:3:4:5:6:7:8:", ":1:2:3:4:5:6:7", "nonsense", "1.2.3", "1:2:3:4:5:6:7:8:9", ":::", None]
    ips += [str(ipaddress.ip_address(rnd.getrandbits(32))) for _ in range(30)]
    ips += [str(ipaddress.ip_address((0x20010DB8 << 96) | rnd.getrandbits(rnd.choice([16, 64, 96])))) for _ in range(30)]

    def bits(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return None
        return f"{int(a):0{a.max_prefixlen}b}"

    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    assert {r.ip: r.b for r in df.withColumn("b", routes.address_bits(F.col("ip"))).collect()} == {x: bits(x) for x in ips}
    nets = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.3/32", "::/0", "2001:db8::/32", "2001:db8::/96", "2001:db8::1/128", "10.0.0.0/33", "x/8", "10.0.0.0"]
    listed = spark.createDataFrame([(n, i) for i, n in enumerate(nets)], "network string, no int")
    good = [ipaddress.ip_network(n) for n in nets[:8]]

    def best(ip):
        if bits(ip) is None:
            return None
        a = ipaddress.ip_address(ip)
        return str(max((n for n in good if n.version == a.version and a in n), key=lambda n: n.prefixlen, default=None))

    got = routes.with_network(df, "ip", listed).collect()
    assert len(got) == len(ips) and {r.ip: r.network for r in got} == {x: best(x) for x in ips}


def test_routing_table_and_delays(spark):
    raw = ("Received: from mx1.a.example (mx1.a.example [192.0.2.10])\n\tby mx2.b.example; Mon, 1 Nov 2010 08:00:30 +0000\n"
           "Received: from c ([IPv6:2001:db8::7]) BY mx1.a.example with SMTP id x;\n\tMon, 1 Nov 2010 09:59:00 +0200\nReceived: by nowhere\nFrom: a@x\n\nx\n")
    df = spark.createDataFrame([(1, raw)], "rowid long, raw string").withColumn("headers", H.parse_headers(F.col("raw")))
    table = routes.routing_table(df)
    got = {r.hop: (r.from_host, r.by_host, r.ip, str(r.hop_utc)) for r in table.collect()}
    assert got == {0: ("mx1.a.example", "mx2.b.example", "192.0.2.10", "2010-11-01 08:00:30"),
                   1: ("c", "mx1.a.example", "2001:db8::7", "2010-11-01 07:59:00"), 2: (None, "nowhere", None, "None")}
    assert [tuple(r) for r in routes.hop_delays(table).collect()] == [(1, 0, "mx1.a.example", "mx2.b.example", 90.0)]


def test_planted_clocks_are_found(spark):
    """Mail both ways along a chain of relays with a shortcut; a few very late messages."""
    rnd, planted = random.Random(6), {"a": 0.0, "b": 300.0, "c": -45.0, "d": 7200.0, "e": 12.0}
    rows = []
    for x, y in [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c"), ("a", "d"), ("a", "e")]:
        for src, dst in ((x, y), (y, x)):
            rows += [(src, dst, planted[dst] - planted[src] + 4 + rnd.random() + (86400 if i % 11 == 0 else 0)) for i in range(40)]
    got = {r.relay: r.offset_s for r in routes.clock_offsets(spark.createDataFrame(rows, "from_relay string, to_relay string, delay_s double")).collect()}
    assert got.keys() == planted.keys() and all(abs(got[k] - planted[k]) < 1.5 for k in planted)


def test_moves(spark):
    at = [(p, dt.datetime(2024, m, d), n) for p, m, d, n in [("x", 1, 1, "A"), ("x", 1, 2, "A"), ("x", 1, 3, "B"), ("x", 2, 1, "B"), ("x", 3, 1, None), ("x", 4, 1, "B"), ("y", 1, 1, "B")]]
    got = routes.moves(spark.createDataFrame(at, "p string, ts timestamp_ntz, net string"), "p", "ts", "net").collect()
    assert sorted((r.p, r.month.month, r.net, r.moved) for r in got) == [("x", 1, "A", False), ("x", 2, "B", True), ("x", 4, "B", False), ("y", 1, "B", False)]


def _components(nodes, links):
    label = {n: n for n in nodes}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b], label[a], label[b])
        if new == label:
            return label
        label = new


def test_similar_attachments_are_those_of_all_pairs(spark):
    """Versions of a file in two families, much copied files, parts of larger files, a prefix that all share."""
    import hashlib

    rnd = random.Random(8)
    head = rnd.randbytes(3000)
    base = [rnd.randbytes(20_000) for _ in range(6)]
    files = [b"", b"", b"short"]
    for b in base:
        files += [b, b, b, head + b, b[:9000] + b"inserted" + b[9000:], b[:14_500], rnd.randbytes(6000) + b[:5000]]
    files += [head + rnd.randbytes(8000) for _ in range(20)] + [base[0] + base[1]]
    files += [bytes([i]) * 5000 for i in range(3)] + [None]
    df = spark.createDataFrame(list(enumerate(files)), "id int, content binary").repartition(5)
    sets = {}
    for f in files:
        if f is not None:
            parts, start = {}, 0
            for end in similar.cuts(f):
                parts[f[start:end]] = end - start
                start = end
            assert start == len(f) or not f
            sets[hashlib.sha256(f).hexdigest()] = parts

    def weight(p):
        return sum(p.values())

    links = [(a, b) for a, b in itertools.combinations(sets, 2) if set(sets[a]) & set(sets[b])
             and sum(n for c, n in sets[a].items() if c in sets[b]) >= similar.SHARE * min(weight(sets[a]), weight(sets[b]))]
    want = _components(sets, links)
    assert len(set(want.values())) < len(sets) - 15
    got = similar.similar_groups(df, "id").collect()
    assert {r.id: r.group for r in got} == {i: want[hashlib.sha256(f).hexdigest()] for i, f in enumerate(files) if f is not None}


def test_chunks_follow_an_insertion():
    rnd = random.Random(2)
    data = rnd.randbytes(60_000)

    def parts(b):
        ends = similar.cuts(b)
        assert ends[-1] == len(b) and all(256 <= y - x <= 4096 for x, y in zip([0, *ends], ends[:-1]))
        return {b[x:y] for x, y in zip([0, *ends], ends)}

    a, b = parts(data), parts(data[:30_000] + b"new" + data[30_000:])
    assert len(a - b) <= 4 and len(a) > 30 and similar.cuts(b"") == []


def test_persons(spark):
    rows = [("Doe, Ann", "ann@a.example"), ("ANN DOE", "Ann@A.example "), ("Ann Doe", "doe@b.example"), ("Ánn Doe", "ad@c.example"), ("info desk", "doe@b.example"),
            ("Bob Roe", "bob@a.example"), ("Bob Roe", "list@x.example"), ("Cy Poe", "list@x.example"), ("Cy Poe", "cy@a.example"), ("Single", "s1@a"), ("Single", "s2@a"),
            (None, "n@a"), ("", "n@a"), ("Ann Doe", None), ("Ann Doe", " ")]
    rows += [("Info Desk", f"i{i}@a") for i in range(20)] + [(f"Member No{i}", "list@x.example") for i in range(12)]
    got = {r.address: r.person for r in people.persons(spark.createDataFrame(rows, "name string, address string")).collect()}
    group = {"ann@a.example": "ad@c.example", "doe@b.example": "ad@c.example", "ad@c.example": "ad@c.example"}
    assert got == {a: group.get(a, a) for a in {(x or "").strip().lower() for _, x in rows} - {""}}


def test_topic_people(spark):
    members = [("t", p) for p in "abcde"] + [("u", "a"), ("u", "z"), ("t", "a"), (None, "a"), ("t", None)]
    mailed = [("a", "b"), ("b", "a"), ("a", "c"), ("a", "z"), ("d", "d"), ("e", "q")]
    got = {(r.topic, r.person): (r.people, r.linked, r.never_mailed) for r in people.topic_people(
        spark.createDataFrame(members, "topic string, person string"), spark.createDataFrame(mailed, "a string, b string")).collect()}
    assert got == {("t", "a"): (5, 2, 2), ("t", "b"): (5, 1, 3), ("t", "c"): (5, 1, 3), ("t", "d"): (5, 0, 4), ("t", "e"): (5, 0, 4),
                   ("u", "a"): (2, 1, 0), ("u", "z"): (2, 1, 0)}


def test_regex_lists_keep_their_groups_and_flags_apart(spark):
    df = spark.createDataFrame([("aab",), ("AAB",), ("xy",), ("zz",), (None,)], "v string")
    got = [r[0] for r in df.select(lists.regex_list_expr(F.col("v"), ["(x)y", r"(a)\1b", "q", "(?i)ZZ", r"(?<n>k)\k<n>"])).collect()]
    assert got == [True, False, True, True, False]


def test_lists_of_long_and_short_entries(spark):
    rnd = random.Random(3)
    entries = ["q", "ab", "abc", "abcdefgh", "abcdefghij", "zzzzz", ""]
    values = ["".join(rnd.choice("abcdefghijz") for _ in range(rnd.randint(0, 14))) for _ in range(300)] + ["xxabcdefghijxx", "q", "", None]
    got = lists.substring_matches(spark.createDataFrame([(x,) for x in values], "v string"), "v", spark.createDataFrame([(e,) for e in entries], "entry string"))
    assert {(r.v, r.entry) for r in got.collect()} == {(x, e) for x in set(values) - {None} for e in entries if e and e in x}
    assert got.inputFiles() == [] and wishes.URL_RE


def test_folded_and_quoted_calendar_lines(spark):
    text = ("BEGIN:VEVENT\r\nSUMMARY:Long\r\n  line\r\nDTSTART;TZID=\"Europe/X:y\";VALUE=DATE:20200101\r\nsummaryx:no\r\nDTEND;X=a:1\nLOCATION:\r\nEND:VEVENT")
    r = wishes.calendar_events(spark.createDataFrame([(1, text)], "id int, text string"), "id").first()
    assert (r.summary, r.dtstart, r.dtend, r.location) == ("Long line", "20200101", "1", None)


def test_urls_end_before_punctuation(spark):
    text = ("http://evil.example/a, (https://x.example/b). https://y.example/w_(z) https://y.example/w_(z). <http://q.example> http://a.b.evil.example:80/?x=1! \"http://n.example/\"")
    df = spark.createDataFrame([(1, text), (2, "Win MONEY money"), (3, None)], "id int, text string")
    assert sorted(r.url for r in wishes.urls(df, "id", "text").collect()) == [
        "http://a.b.evil.example:80/?x=1", "http://evil.example/a", "http://n.example/", "http://q.example", "https://x.example/b", "https://y.example/w_(z)", "https://y.example/w_(z)"]
    listed = spark.createDataFrame([("Evil.example",), ("ple",), ("n.example",)], "entry string")
    got = Counter(tuple(r) for r in wishes.suspicious(df, "id", "text", listed, ["money", "(z)"]).collect())
    assert got == Counter({(1, "url", "evil.example", 2): 1, (1, "url", "n.example", 1): 1, (2, "keyword", "money", 2): 1, (1, "keyword", "(z)", 2): 1})


@pytest.mark.parametrize("n_places", [1, 300])
def test_nearest_place_near_poles_and_the_date_line(spark, n_places):
    import math

    rnd = random.Random(4)

    def km(a, b):
        (la, lo), (lb, lp) = [[math.radians(x) for x in p] for p in (a, b)]
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    places = [(f"p{i:03d}", rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(n_places)]
    points = [(i, *p) for i, p in enumerate([(89.9, 0.0), (-90.0, 10.0), (10.0, 179.99), (10.0, -179.99), (0.0, 0.0), (0.0, 180.0)]
                                            + [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(150)])]
    got = geo.nearest_place(spark.createDataFrame(points, "point_id int, lat double, lon double"), spark.createDataFrame(places, "place string, plat double, plon double"))
    want = {i: min((round(km((a, o), p[1:]), 6), p[0]) for p in places) for i, a, o in points}
    assert {r.point_id: (round(r.distance_km, 6), r.place) for r in got.collect()} == want
