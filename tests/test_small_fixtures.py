"""Small fixtures with known answers (FIXTURES.md section 3) and brute-force checks."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from maillake.functions import flags as FL
from maillake.functions import text as T
from maillake.operators import contacts, folders, forms, geo, lists, pages
from maillake.plans import sequential


def test_best_email_gmail_beats_edu(spark):
    rows = [("A", "B", "junk@cse.psu.edu", 0), ("A", "B", "junk@gmail.com", 1)]
    df = spark.createDataFrame(rows, "first string, last string, email string, o int")
    best = contacts.best_emails(df.withColumn("ord", F.struct("o")))
    assert best.first().best_email == "junk@gmail.com"


def test_best_email_rules(spark):
    rows = [("P", "1", "a.long.name@x.example", 0), ("P", "1", "s@x.edu", 1),
            ("Q", "2", "longer@y.example", 0), ("Q", "2", "sh@y.example", 1), ("Q", "2", "s2@y.example", 2),
            ("R", "3", "r@army.mil", 0), (None, None, "nobody@z.example", 0),
            ("S", "4", "sh@y.example", 5)]
    df = spark.createDataFrame(rows, "first string, last string, email string, o int")
    df = contacts.usable(df.withColumn("ord", F.struct("o")))
    best = contacts.best_emails(df)
    got = {(r.first, r.last): r.best_email for r in best.collect()}
    assert got == {("P", "1"): "s@x.edu", ("Q", "2"): "sh@y.example", ("S", "4"): "sh@y.example"}
    one = {r.best_email: (r.first, r.last) for r in contacts.one_per_email(best).collect()}
    assert one["sh@y.example"] == ("Q", "2")


def test_template_fields(spark):
    tmpl = "to: %to%\nfrom: %from%\nHello %firstname%! and %second%"
    df = spark.createDataFrame([(tmpl,)], "template string")
    got = forms.template_field_list(df).first().fields
    assert got == ["firstname", "from", "to"]


def test_mail_merge_and_missing_field(spark):
    df = spark.createDataFrame([(1, "Ann", '"Ann B" <a@x.example>')], "id int, firstname string, to string")
    out = forms.mail_merge(df, "To: %to%\nHi %firstname% %firstname%\nFrom: %from%",
                           {"from": "me@x.example"}).first().body
    assert out == 'To: "Ann B" <a@x.example>\nHi Ann Ann\nFrom: me@x.example'
    try:
        forms.mail_merge(df, "Dear %title%", {})
        raise AssertionError("missing field must fail")
    except ValueError:
        pass


def test_form_fields_last_wins(spark):
    body = "> Name: Ann\nEmail: Ann <a@x.example>\nEmail: b@x.example\nDomestic:"
    df = spark.createDataFrame([(1, body)], "id int, body string")
    r = forms.form_fields(df, "id", "body", ["name", "email", "domestic"]).first()
    assert (r.name, r.email, r.domestic, r.status) == ("Ann", "b@x.example", None, "ok")


def test_html_to_text(spark):
    html = ('<html><head><script>var t="</p>";</script></head><body><div>A&amp;B</div>'
            '<br>x<!-- gone --></body></html>')
    df = spark.createDataFrame([(html,)], "h string")
    got = df.select(T.html_to_text(F.col("h")).alias("t")).first().t
    assert got == 'var t="</p>";A&B\n\nx'


def test_ascii_fold(spark):
    df = spark.createDataFrame([("Müller, ½ © ß Ω",)], "s string")
    assert df.select(T.ascii_fold(F.col("s")).alias("t")).first().t == "Mueller, {1/2} (c) ss "


def test_list_contains_and_replace(spark):
    vals = spark.createDataFrame([("someone@gmail.com",), ("x@other.example",), (None,)], "v string")
    entries = spark.createDataFrame([(1, "@gmail.com"), (2, "nomatch")], "line_no int, entry string")
    got = {r.v: r.listed for r in lists.list_contains(vals, "v", entries).collect()}
    assert got == {"someone@gmail.com": True, "x@other.example": False, None: False}
    repl = spark.createDataFrame([(1, "gmail", "G1"), (2, "mail", "G2"), (3, "x@other.example", "EX"),
                                  (4, "x@other.example", "EX2")],
                                 "line_no int, original string, replacement string")
    got = {r.v: r.replaced for r in lists.replace_lookup(vals, "v", repl).collect()}
    assert got == {"someone@gmail.com": "G1", "x@other.example": "EX2", None: None}


def test_list_contains_brute_force(spark):
    rnd = random.Random(7)
    alphabet = "abc@."
    values = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    ents = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(2, 4))) for _ in range(15)]
    vdf = spark.createDataFrame([(v,) for v in values], "v string")
    edf = spark.createDataFrame([(i, e) for i, e in enumerate(ents)], "line_no int, entry string")
    got = {r.v: r.listed for r in lists.list_contains(vdf, "v", edf).collect()}
    for v in values:
        assert got[v] == any(e in v for e in ents), v


def test_list_files_keep_file_order(spark, tmp_path):
    p = tmp_path / "repl.txt"
    lines = [f"key{i % 50} :: value{i}" for i in range(5000)] + ["", "@gmail.com :: G"]
    p.write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")   # many splits
        repl = lists.read_replacement_file(spark, str(p))
        assert repl.count() == 5001
        vals = spark.createDataFrame([("key7",), ("xkey7x",), ("a@gmail.com",)], "v string")
        got = {r.v: r.replaced for r in lists.replace_lookup(vals, "v", repl).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # exact: the last line wins; partial: the first line in file order wins
    assert got == {"key7": "value4957", "xkey7x": "value7", "a@gmail.com": "G"}


def test_regex_list(spark):
    df = spark.createDataFrame([("alice@x",), ("bob@y",)], "v string")
    out = lists.regex_replace_lookup(df, "v", ["b.*", "a.*@x"], ["B", "AX"]).collect()
    assert {r.v: r.replaced for r in out} == {"alice@x": "AX", "bob@y": "B"}


def test_folder_rename(spark):
    df = spark.createDataFrame([("INBOX",), ("Work/Projects",), ("a.b",)], "name string")
    mp = spark.createDataFrame([("a.b", "Mapped/ab")], "src string, dst string")
    out = {r.name: r.target for r in folders.rename_folders(
        df, mp, src_delim="/", dst_delim=".", dst_prefix="INBOX.").collect()}
    assert out == {"INBOX": "INBOX", "Work/Projects": "INBOX.Work.Projects", "a.b": "INBOX.Mapped.ab"}


def test_listing_parse(spark):
    df = spark.createDataFrame([('(\\HasNoChildren) "/" "Sent Items"',)], "line string")
    r = folders.parse_listing(df).first()
    assert (r.flags, r.delimiter, r.name) == ("\\HasNoChildren", "/", "Sent Items")


def test_flag_round_trip(spark):
    df = spark.createDataFrame([("FSR",)], "l string")
    imap = FL.imap_flags(F.col("l"), "maildir")
    r = df.select(imap.alias("i"), FL.format_flags(imap, "maildir").alias("m"),
                  FL.add_flag(imap, "\\Recent").alias("a"),
                  FL.remove_flag(imap, "\\SEEN").alias("rm")).first()
    assert r.i == ["\\Answered", "\\Flagged", "\\Seen"]
    assert r.m == "FRS"
    assert r.a == r.i
    assert r.rm == ["\\Answered", "\\Flagged"]


def test_pages_carry_and_labels(spark):
    pg = spark.createDataFrame([
        (1, 0, "cover", "Cover"), (1, 1, "p1", "From:\nA"), (1, 2, "p2", "body"),
        (1, 3, "p3", "From:\nB"), (1, 4, "p4", "more")], "doc int, page int, text string, first_block string")
    a = pages.assign_messages(pg, pages.is_first_page(F.col("first_block")))
    got = {r.page: r.message_start for r in a.collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    txt = {r.message_start: r.full_text for r in pages.message_text(a).collect()}
    assert txt == {1: "p1p2", 3: "p3p4"}
    spans = spark.createDataFrame([
        (1, 1, 0, "To:", 0.0, 10.0, 30.0, 20.0), (1, 1, 1, "Subject:", 0.0, 30.0, 40.0, 40.0),
        (1, 1, 2, "Hello", 50.0, 30.0, 90.0, 40.0), (1, 1, 3, "world", 95.0, 30.0, 120.0, 40.0)],
        "doc int, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double")
    links = spark.createDataFrame([(1, 1, 0, 2, "mailto:a@x.example", 12.0, 18.0),
                                   (1, 1, 1, 2, "mailto:b@x.example", 11.0, 19.0),
                                   (1, 1, 2, 1, "http://x", 12.0, 18.0)],
                                  "doc int, page int, pos int, kind int, uri string, y0 double, y1 double")
    lab = pages.link_labels(links, spans)
    fields = {r.label: r.value for r in pages.link_fields(lab).collect()}
    assert fields == {"to": "a@x.example b@x.example"}
    assert pages.text_beside(spans, "Subject:").first().value == "Hello world"


def test_first_page_fields(spark):
    spans = spark.createDataFrame([
        (1, 1, 0, "From:", 0.0, 0.0, 30.0, 8.0), (1, 1, 1, "To:", 0.0, 10.0, 30.0, 20.0),
        (1, 1, 2, "Subject:", 0.0, 30.0, 40.0, 40.0), (1, 1, 3, "Budget", 50.0, 30.0, 90.0, 40.0),
        (1, 1, 4, "Date:", 0.0, 50.0, 40.0, 60.0),
        (1, 1, 5, "Monday, June 1, 2020 08:00:00 PM", 50.0, 50.0, 200.0, 60.0)],
        "doc int, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double")
    links = spark.createDataFrame([(1, 1, 0, 2, "mailto:a@x.example", 2.0, 6.0),
                                   (1, 1, 1, 2, "mailto:b@x.example", 12.0, 18.0)],
                                  "doc int, page int, pos int, kind int, uri string, y0 double, y1 double")
    r = pages.first_page_fields(links, spans).first()
    assert (r["from"], r.to, r.subject, str(r.date)) == ("a@x.example", "b@x.example", "Budget",
                                                          "2020-06-01 20:00:00")


def test_message_text_in_chunks(spark):
    rows = [(1, p, f"<{p}>", "From:\nA" if p in (0, 2500) else "x") for p in range(5000)]
    df = spark.createDataFrame(rows, "doc int, page int, text string, first_block string")
    a = pages.assign_messages(df, pages.is_first_page(F.col("first_block")))
    got = {r.message_start: (r.pages, r.full_text) for r in pages.message_text(a, chunk=100).collect()}
    assert got == {0: (2500, "".join(f"<{p}>" for p in range(2500))),
                   2500: (2500, "".join(f"<{p}>" for p in range(2500, 5000)))}


def test_noun_runs(spark):
    df = spark.createDataFrame([("The team met Ann Smith in New York today. Bob saw "
                                 "Report Final.pdf twice. Then Carol ran.",)], "t string")
    got = df.select(pages.noun_runs(F.col("t")).alias("n")).first().n
    # "Then" opens its sentence (skipped); "Carol" is a run; the .pdf run is dropped.
    assert got == ["Ann Smith", "Carol", "New York"]
    assert all(__import__("re").fullmatch(r"[-a-zA-Z0-9/ _.]+", x) for x in got)


def test_geotags_and_nearest_brute_force(spark):
    rnd = random.Random(3)
    places = [(f"p{i}", rnd.uniform(-80, 80), rnd.uniform(-179, 179)) for i in range(40)]
    pts = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(400)]
    pdf = spark.createDataFrame(places, "place string, plat double, plon double")
    qdf = spark.createDataFrame(pts, "point_id int, lat double, lon double")
    got = {r.point_id: r.place for r in geo.nearest_place(qdf, pdf).collect()}
    import math

    def hav(a, b, c, d):
        r = math.pi / 180
        x = math.sin((c - a) * r / 2) ** 2 + math.cos(a * r) * math.cos(c * r) * math.sin((d - b) * r / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, x)))
    assert len(got) == len(pts)
    for pid, lat, lon in pts:
        want = min(places, key=lambda p: (hav(lat, lon, p[1], p[2]), p[0]))[0]
        assert got[pid] == want, pid
    tags = spark.createDataFrame([("2020:01:01 10:00:00 +0100", "x", "1.0", "a"),
                                  ("2020:01:02 10:00:00 +0100", "1.5", "2.0", "b")],
                                 "date_created string, latitude string, longitude string, path string")
    u = geo.usable_geotags(tags).collect()
    assert len(u) == 1 and u[0].date == "2020:01:02 10:00:00 +"


def test_sequential_helpers_brute_force_with_hot_group(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        g = 0 if i % 3 == 0 else rnd.randint(1, 50)    # group 0 holds a third of the rows
        rows.append(Row(g=g, o=i, v=rnd.randint(0, 3), c=(i if rnd.random() < 0.1 else None)))
    df = spark.createDataFrame(rows)
    rs = {r.o: r.running for r in sequential.running_sum(df, ["g"], ["o"], "v", num_partitions=16).collect()}
    cf = {r.o: r.carried for r in sequential.carry_forward(df, ["g"], ["o"], "c", num_partitions=16).collect()}
    rn = {r.o: r.row_no for r in sequential.global_row_number(df, ["o"], num_partitions=16).collect()}
    acc, last = {}, {}
    for r in sorted(rows, key=lambda r: r.o):
        acc[r.g] = acc.get(r.g, 0) + r.v
        assert rs[r.o] == acc[r.g]
        if r.c is not None:
            last[r.g] = r.c
        assert cf[r.o] == last.get(r.g)
    assert sorted(rn.values()) == list(range(1, 3001))
    assert all(rn[o] == o + 1 for o in rn)


def test_term_index_with_senders(spark):
    pg = spark.createDataFrame([(1, "We met Ann Lee there."), (2, "Then we saw Ann Lee again."),
                                (3, "Nothing here.")], "page int, text string")
    ps = spark.createDataFrame([(1, "a@x"), (2, "b@x")], "page int, sender string")
    r = pages.term_index_with_senders(pg, ps).first()
    assert (r.term, r.title, r.pages, r.senders) == ("ann lee", "Ann Lee", "1,2", "a@x,b@x")


def test_connected_components_brute_force(spark):
    from maillake.operators import wishes
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]          # a long chain (diameter 60)
    edges += [(5000, 5000 + i) for i in range(1, 80)]           # a hub
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for n in list(parent):
        comp.setdefault(find(n), []).append(n)
    want = {n: min(members) for members in comp.values() for n in members}
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.label for r in wishes.connected_components(df).collect()}
    assert got == want


def test_dimension_build_is_idempotent(spark):
    from maillake.operators import model
    vals = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "subject string")
    dim = model.build_dimension(vals, ["subject"])
    assert sorted((r.rowid, r.subject) for r in dim.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    again = model.build_dimension(vals, ["subject"], existing=dim)
    assert sorted((r.rowid, r.subject) for r in again.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    more = spark.createDataFrame([("d",), ("a",)], "subject string")
    grown = model.build_dimension(more, ["subject"], existing=dim)
    assert sorted((r.rowid, r.subject) for r in grown.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_fix_dangling_ancestor(spark):
    from maillake.operators import counters
    m = spark.createDataFrame([(1, None), (2, 1), (3, 99)], "rowid long, fuzzy_ancestor long")
    got = {r.rowid: r.fuzzy_ancestor for r in counters.fix_dangling(m).collect()}
    assert got == {1: None, 2: 1, 3: -1}


def test_year_month_grid(spark):
    import datetime as dt
    from maillake.operators import timegrid
    df = spark.createDataFrame([(dt.datetime(2019, 1, 5),), (dt.datetime(2019, 1, 9),), (dt.datetime(2020, 12, 1),)],
                               "ts timestamp_ntz")
    long = timegrid.grid_long(df, "ts", timegrid.YEAR_BY_MONTH)
    assert {(r.ring, r.division): r.n for r in long.collect()} == {(2019, 0): 2, (2020, 11): 1}
    wide = {r.ring: (r.d00, r.d11) for r in timegrid.grid_pivot(long, timegrid.YEAR_BY_MONTH).collect()}
    assert wide == {2019: (2, None), 2020: (None, 1)}


def test_top_n_reference_extra_row(spark):
    from maillake.operators import stats
    df = spark.createDataFrame([(k,) for k in "aabbbcd"], "k string")
    assert [r.k for r in stats.top_n(df, ["k"], 2).collect()] == ["b", "a"]
    assert len(stats.top_n(df, ["k"], 2, reference_extra_row=True).collect()) == 3
