"""Awkward mail: long headers and tags, every character reference, flags and sets in any form."""

import html

import pytest
from pyspark.sql import functions as F

from maillake.functions import flags as FL
from maillake.functions import headers as H
from maillake.functions import text as T
from maillake.operators import folders, forms, lists, pages
from maillake.operators import search as S
from maillake.sources import mailbox, messages


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


def test_address_list_of_any_length(spark):
    value = ", ".join(f'"Last{i}, First" <a{i}@x.example>' for i in range(20_000))
    got = one(spark, value, H.parse_addresses)
    assert len(got) == 20_000 and got[19_999] == ("Last19999, First", "a19999@x.example")
    assert [x.email for x in one(spark, 'a@x, "b, c" <b@x>,, d@x', H.parse_addresses)] == ["a@x", "b@x", "d@x"]


def test_tags_of_any_length(spark):
    long = "<html><p title='" + "x" * 100_000 + "'>a</p><b " + "k=\"v > w\" " * 5000 + ">c</b><i" + " y" * 50_000 + ">d</i>"
    assert one(spark, long, T.html_to_text) == "acd"
    assert one(spark, "<HTML><b>x</b>", T.html_to_text) == "<HTML><b>x</b>"


@pytest.mark.parametrize("text", [
    "&eacute; &#8217; &euro; &#x1F642;", "&amp;lt; &lt; &nbsp;|&notit; &notin; &copy 2020 &copyright", "&#128; &#x80; &#0; &#xD800; &#1114112; &#99999999999;",
    "&unknown; & &; &# &#; &#x; &#xZ;", "a&#13;b &#1; &#x7f; &#65534;", "&NotEqualTilde; &fjlig;", "no references"])
def test_character_references(spark, text):
    assert one(spark, text, T.unescape_entities) == html.unescape(text)


def test_flags_are_compared_without_case(spark):
    df = spark.createDataFrame([(["\\RECENT", "\\Seen", "\\DELETED", "$x", "y"],)], "f array<string>")
    r = df.select(FL.clean_for_copy(F.col("f"), keep_dollar=True, drop_deleted=True), FL.add_flag(F.col("f"), "\\recent"),
                  FL.set_flags(["\\RECENT", "\\Seen"])).first()
    assert r[0] == ["\\Seen", "$x"] and r[1] == ["\\RECENT", "\\Seen", "\\DELETED", "$x", "y"] and r[2] == ["\\Seen"]


def test_sequence_sets(spark):
    ten = S.with_largest(spark.range(1, 11).withColumnRenamed("id", "rowid"))
    pick = lambda spec: [r.rowid for r in ten.filter(S.sequence_set(spec, largest=F.col("largest"))).orderBy("rowid").collect()]
    assert pick("*") == [10] and pick("*:4") == [4, 5, 6, 7, 8, 9, 10] and pick("20:*") == list(range(10, 11))
    assert pick("2,9:*") == [2, 9, 10] and pick("5:3") == [3, 4, 5]
    with pytest.raises(ValueError):
        S.sequence_set("1:*")


def test_an_email_line_without_address_fails_the_request(spark):
    df = spark.createDataFrame([(1, "Name: A\nEmail: none\nEmail: a@x.example"), (2, "Name: B\nEmail:\nEmail: b@x.example")], "id int, body string")
    got = {r["id"]: (r["status"], r["email"]) for r in forms.form_fields(df, "id", "body", ["name", "email"]).collect()}
    assert got[1][0] == "error" and got[2] == ("ok", "b@x.example")


def test_status_headers_become_flags_and_go(spark, tmp_path):
    p = tmp_path / "m.mbox"
    p.write_text("From a Thu Jan  1 00:00:00 2020\nFrom: a@x\nStatus: RO\nX-Status: F\nSubject: s\n\nbody\n")
    m = messages.parse_messages(mailbox.read_mbox(spark, str(p))).first()
    assert [h.name for h in m.headers] == ["From", "Subject"] and "\\Seen" in m.imap_flags and "\\Flagged" in m.imap_flags


def test_link_labels_that_are_empty_go(spark):
    links = spark.createDataFrame([(1, 1, 0, pages.MAILTO_KIND, "mailto:a@x", 0.0, 2.0), (1, 1, 1, pages.MAILTO_KIND, "mailto:b@x", 4.0, 6.0)],
                                  "doc int, page int, pos int, kind int, uri string, y0 double, y1 double")
    spans = spark.createDataFrame([(1, 1, 0, ":", 0.0, 2.0), (1, 1, 1, "To:", 4.0, 6.0)], "doc int, page int, pos int, text string, y0 double, y1 double")
    assert [r["label"] for r in pages.link_labels(links, spans).collect()] == ["to"]


def test_folder_map_uses_each_sides_delimiter(spark, tmp_path):
    (tmp_path / "map").write_text("# c\nwork/a: Archive/Work/A\n")
    assert tuple(folders.read_folder_map(spark, str(tmp_path / "map"), ".", "|").first()) == ("work.a", "Archive|Work|A")


def test_long_regex_lists(spark):
    df = spark.createDataFrame([("x6999",), ("zz",), (None,)], "v string")
    got = [r[0] for r in df.select(lists.regex_list_expr(F.col("v"), [f"x{i}$" for i in range(7000)])).collect()]
    assert got == [True, False, False]
