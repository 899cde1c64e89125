"""String Column functions for bodies, subjects and forms.

SURVEY P10-P14, P16, P17, P19-P22, P25-P28.  All are built-in Spark
expressions (whole-stage codegen, no Python) and work on whole texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Form-field line pattern (searched, not anchored): optional quote marks and
# spaces, a key of letters and spaces, a colon, the value.
FORM_FIELD_RE = r"[> ]*([a-zA-Z ]+): *(.*)"
# First e-mail address in a text, ASCII letters (comparable with SQL engines);
# EMAIL_RE_UNICODE matches Python's Unicode \w.
EMAIL_RE = r"([._\-A-Za-z0-9_]+@[A-Za-z0-9_.\-]+)"
EMAIL_RE_UNICODE = r"(?U)([._\-\w]+@[\w.\-_]+)"
# Template field: %name% (letters only), first one per line.
TEMPLATE_FIELD_RE = r"%([a-zA-Z]+)%"
# Whitespace that Python's str.strip() removes (ASCII part).
_WS = "[ \\t\\n\\r\\f\\x0B]"

# Latin-1 to ASCII replacements (character name, replacement, weight used by
# the charset guess).  Characters >= 0x80 that are not listed are dropped.
ASCII_FOLD = [
    ("ACUTE ACCENT", "", 0),
    ("BROKEN BAR", "|", 0),
    ("CEDILLA", "", 0),
    ("CENT SIGN", " cent", 0),
    ("COPYRIGHT SIGN", "(c)", 1),
    ("CURRENCY SIGN", "", 0),
    ("DEGREE SIGN", "", 1),
    ("DIAERESIS", "", 0),
    ("DIVISION SIGN", "/", 1),
    ("FEMININE ORDINAL INDICATOR", "", 0),
    ("INVERTED EXCLAMATION MARK", "!", 1),
    ("INVERTED QUESTION MARK", "?", 1),
    ("LATIN CAPITAL LETTER A WITH ACUTE", "A", 1),
    ("LATIN CAPITAL LETTER A WITH CIRCUMFLEX", "A", 1),
    ("LATIN CAPITAL LETTER A WITH DIAERESIS", "Ae", 1),
    ("LATIN CAPITAL LETTER A WITH GRAVE", "A", 1),
    ("LATIN CAPITAL LETTER A WITH RING ABOVE", "A", 1),
    ("LATIN CAPITAL LETTER A WITH TILDE", "A", 1),
    ("LATIN CAPITAL LETTER AE", "Ae", 2),
    ("LATIN CAPITAL LETTER C WITH CEDILLA", "C", 1),
    ("LATIN CAPITAL LETTER E WITH ACUTE", "E", 1),
    ("LATIN CAPITAL LETTER E WITH CIRCUMFLEX", "E", 1),
    ("LATIN CAPITAL LETTER E WITH DIAERESIS", "E", 1),
    ("LATIN CAPITAL LETTER E WITH GRAVE", "E", 1),
    ("LATIN CAPITAL LETTER ETH", "Th", 1),
    ("LATIN CAPITAL LETTER I WITH ACUTE", "I", 1),
    ("LATIN CAPITAL LETTER I WITH CIRCUMFLEX", "I", 1),
    ("LATIN CAPITAL LETTER I WITH DIAERESIS", "I", 1),
    ("LATIN CAPITAL LETTER I WITH GRAVE", "I", 1),
    ("LATIN CAPITAL LETTER N WITH TILDE", "N", 1),
    ("LATIN CAPITAL LETTER O WITH ACUTE", "O", 1),
    ("LATIN CAPITAL LETTER O WITH CIRCUMFLEX", "O", 1),
    ("LATIN CAPITAL LETTER O WITH DIAERESIS", "Oe", 2),
    ("LATIN CAPITAL LETTER O WITH GRAVE", "O", 1),
    ("LATIN CAPITAL LETTER O WITH STROKE", "O", 1),
    ("LATIN CAPITAL LETTER O WITH TILDE", "O", 1),
    ("LATIN CAPITAL LETTER THORN", "th", 1),
    ("LATIN CAPITAL LETTER U WITH ACUTE", "U", 1),
    ("LATIN CAPITAL LETTER U WITH CIRCUMFLEX", "U", 1),
    ("LATIN CAPITAL LETTER U WITH DIAERESIS", "Ue", 2),
    ("LATIN CAPITAL LETTER U WITH GRAVE", "U", 1),
    ("LATIN CAPITAL LETTER Y WITH ACUTE", "Y", 1),
    ("LATIN SMALL LETTER A WITH ACUTE", "a", 1),
    ("LATIN SMALL LETTER A WITH CIRCUMFLEX", "a", 1),
    ("LATIN SMALL LETTER A WITH DIAERESIS", "ae", 2),
    ("LATIN SMALL LETTER A WITH GRAVE", "a", 1),
    ("LATIN SMALL LETTER A WITH RING ABOVE", "a", 1),
    ("LATIN SMALL LETTER A WITH TILDE", "a", 1),
    ("LATIN SMALL LETTER AE", "ae", 3),
    ("LATIN SMALL LETTER C WITH CEDILLA", "c", 1),
    ("LATIN SMALL LETTER E WITH ACUTE", "e", 1),
    ("LATIN SMALL LETTER E WITH CIRCUMFLEX", "e", 1),
    ("LATIN SMALL LETTER E WITH DIAERESIS", "e", 1),
    ("LATIN SMALL LETTER E WITH GRAVE", "e", 1),
    ("LATIN SMALL LETTER ETH", "th", 1),
    ("LATIN SMALL LETTER I WITH ACUTE", "i", 1),
    ("LATIN SMALL LETTER I WITH CIRCUMFLEX", "i", 1),
    ("LATIN SMALL LETTER I WITH DIAERESIS", "i", 1),
    ("LATIN SMALL LETTER I WITH GRAVE", "i", 1),
    ("LATIN SMALL LETTER N WITH TILDE", "n", 1),
    ("LATIN SMALL LETTER O WITH ACUTE", "o", 1),
    ("LATIN SMALL LETTER O WITH CIRCUMFLEX", "o", 1),
    ("LATIN SMALL LETTER O WITH DIAERESIS", "oe", 2),
    ("LATIN SMALL LETTER O WITH GRAVE", "o", 1),
    ("LATIN SMALL LETTER O WITH STROKE", "o", 1),
    ("LATIN SMALL LETTER O WITH TILDE", "o", 1),
    ("LATIN SMALL LETTER SHARP S", "ss", 2),
    ("LATIN SMALL LETTER THORN", "th", 0),
    ("LATIN SMALL LETTER U WITH ACUTE", "u", 1),
    ("LATIN SMALL LETTER U WITH CIRCUMFLEX", "u", 1),
    ("LATIN SMALL LETTER U WITH DIAERESIS", "ue", 2),
    ("LATIN SMALL LETTER U WITH GRAVE", "u", 1),
    ("LATIN SMALL LETTER Y WITH ACUTE", "y", 1),
    ("LATIN SMALL LETTER Y WITH DIAERESIS", "y", 1),
    ("LEFT-POINTING DOUBLE ANGLE QUOTATION MARK", '"', 0),
    ("MACRON", "", 0),
    ("MASCULINE ORDINAL INDICATOR", "", 0),
    ("MICRO SIGN", "micro", 0),
    ("MIDDLE DOT", "*", 0),
    ("MULTIPLICATION SIGN", "*", 0),
    ("NOT SIGN", "not", 0),
    ("PILCROW SIGN", "", 0),
    ("PLUS-MINUS SIGN", "+/-", 0),
    ("POUND SIGN", " pound", 0),
    ("REGISTERED SIGN", "(R)", 0),
    ("RIGHT-POINTING DOUBLE ANGLE QUOTATION MARK", '"', 0),
    ("SECTION SIGN", "", 0),
    ("SOFT HYPHEN", "-", 0),
    ("SUPERSCRIPT ONE", "1", 0),
    ("SUPERSCRIPT THREE", "3", 0),
    ("SUPERSCRIPT TWO", "2", 0),
    ("VULGAR FRACTION ONE HALF", "{1/2}", 0),
    ("VULGAR FRACTION ONE QUARTER", "{1/4}", 0),
    ("VULGAR FRACTION THREE QUARTERS", "{3/4}", 0),
    ("YEN SIGN", "yen", 0),
]

# ----------------------------------------------------------------------------

# Possessive loops: Java's matcher runs them without a stack frame per character or quote.
_TAG_REST = r"""(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>"""
HTML_TAG_RE = r"<[a-zA-Z/!?]" + _TAG_REST
HTML_COMMENT_RE = r"(?s)<!--.*?-->"
RAW_TEXT_SPLIT_RE = r"(?i)<(?:script|style)\b" + _TAG_REST + r"|</(?:script|style)\s*>"


def fold_pairs() -> list[tuple[str, str]]:
    return [(unicodedata.lookup(name), repl) for name, repl, _w in ASCII_FOLD]


def fold_weights() -> dict[str, int]:
    return {unicodedata.lookup(name): w for name, _r, w in ASCII_FOLD}


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` (ASCII whitespace); Spark's trim only removes spaces."""
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def normalized_subject(subject: Column) -> Column:
    """Lower-case, delete every literal ``re:``, strip."""
    return py_strip(F.replace(F.lower(subject), F.lit("re:"), F.lit("")))


def ellipsis(c: Column, width: int = 30) -> Column:
    """None -> ''; longer than ``width`` -> first ``width`` chars + '...'."""
    return (F.when(c.isNull(), F.lit(""))
            .when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("...")))
            .otherwise(c))


def line_count(raw: Column) -> Column:
    """Number of pieces when splitting on newline (Python ``len(s.split('\\n'))``).

    Counted as newlines + 1 from two lengths: no array of lines is built,
    whatever the size of the message.
    """
    return (F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit("")))) + F.lit(1)


def first_email(text: Column, unicode_word: bool = False) -> Column:
    """First address-looking token; NULL when there is none."""
    pat = EMAIL_RE_UNICODE if unicode_word else EMAIL_RE
    found = F.regexp_extract(text, pat, 1)
    # An address needs an '@': a literal scan skips the regex (which backtracks
    # at every word) on texts that cannot match.
    return F.when(F.instr(text, "@") > 0, F.when(found != "", found))


def ascii_fold(c: Column) -> Column:
    """Latin-1 letters and signs to ASCII look-alikes; other non-ASCII dropped."""
    pairs = fold_pairs()
    one = [(s, r) for s, r in pairs if len(r) == 1]
    gone = [s for s, r in pairs if r == ""]
    # One translate pass maps the 1:1 pairs and deletes the characters that
    # map to nothing (they sit past the end of the replacement string).
    out = F.translate(c, "".join(s for s, _ in one) + "".join(gone), "".join(r for _, r in one))
    multi = [(s, r) for s, r in pairs if len(r) > 1]
    chained = out
    for s, r in multi:
        chained = F.replace(chained, F.lit(s), F.lit(r))
    # The 1:n replacements run only on texts that hold one of their characters.
    has_multi = out.rlike("[" + "".join(re.escape(s) for s, _ in multi) + "]")
    folded = F.regexp_replace(F.when(has_multi, chained).otherwise(out), "[^\\x00-\\x7F]", "")
    # Pure-ASCII texts (most mail) skip the replacement passes entirely.
    return F.when(c.rlike("[^\\x00-\\x7F]"), folded).otherwise(c)


def _character_references() -> tuple[dict[str, str], str]:
    """Named references of HTML 5 (from the standard library's table) and a pattern for those without ';'."""
    from html.entities import html5

    bare = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    return {k: v for k, v in html5.items()}, "|".join(bare)


def _numbered(n: Column) -> Column:
    """The character of a numeric reference, with HTML's replacements for numbers that are none."""
    # 0x80 to 0x9F mean Windows-1252, as browsers read them
    latin = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0))
    bad = (n == 0) | ((n >= 0xD800) & (n <= 0xDFFF)) | (n > 0x10FFFF)
    none = (((n >= 1) & (n <= 8)) | ((n >= 0xE) & (n <= 0x1F)) | (n == 0xB) | (n == 0x7F)
            | ((n >= 0xFDD0) & (n <= 0xFDEF)) | (n.bitwiseAND(0xFFFE) == 0xFFFE))
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when(bad, F.lit("\ufffd")).when((n >= 0x80) & (n <= 0x9F), F.substring(F.lit(latin), n.cast("int") - 0x7F, F.lit(1)))
            .when(none, F.lit("")).otherwise(char))


def unescape_entities(c: Column) -> Column:
    """Every named and numeric character reference of a text, as Python's ``html.unescape`` reads them.

    The text is cut at '&'; what follows each is looked up (with ';', or the longest name
    that may stand without one), in built-in functions.  Texts without '&' pass untouched.
    """
    names, bare = _character_references()
    # one literal, folded to a map when the plan is optimised
    table = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in names.items())), F.lit("\x02"), F.lit("\x01"))

    def one(s: Column) -> Column:
        number = F.regexp_extract(s, r"^#([0-9]+);?", 1)
        hexa = F.regexp_extract(s, r"^#[xX]([0-9a-fA-F]+);?", 1)
        named = F.regexp_extract(s, r"^([a-zA-Z][a-zA-Z0-9]{0,31};)", 1)
        short = F.regexp_extract(s, f"^({bare})", 1)
        # numbers too long for a character are replaced like any above the last one
        value = F.when(hexa != "", F.when(F.length(F.ltrim(hexa, F.lit("0"))) > 8, F.lit(1 << 40))
                       .otherwise(F.conv(F.concat(F.lit("0"), F.ltrim(hexa, F.lit("0"))), 16, 10).cast("long"))) \
            .when(number != "", F.when(F.length(F.ltrim(number, F.lit("0"))) > 9, F.lit(1 << 40))
                  .otherwise(F.concat(F.lit("0"), F.ltrim(number, F.lit("0"))).cast("long")))
        width = F.length(F.regexp_extract(s, r"^(#(?:[xX][0-9a-fA-F]+|[0-9]+);?)", 1))
        full = F.when(named != "", table[named])
        return (F.when(value.isNotNull(), F.concat(_numbered(value), F.substr(s, width + 1)))
                .when(full.isNotNull(), F.concat(full, F.substr(s, F.length(named) + 1)))
                .when(short != "", F.concat(table[short], F.substr(s, F.length(short) + 1)))
                .otherwise(F.concat(F.lit("&"), s)))

    parts = F.transform(F.split(c, "&", -1), lambda s, i: F.when(i == 0, s).otherwise(one(s)))
    # most texts hold none but these, which plain replacement reads alike (&amp; last)
    usual = c
    for name in ("lt;", "gt;", "quot;", "nbsp;", "amp;"):
        usual = F.replace(usual, F.lit("&" + name), F.lit(names[name]))
    return (F.when(F.instr(c, "&") == 0, c).when(~c.rlike("&(?!(?:lt|gt|quot|nbsp|amp);)"), usual)
            .otherwise(F.array_join(parts, "")))


def html_to_text(html: Column, accept_doctype: bool = False) -> Column:
    """P10: text of an HTML body, as an HTML parser's data callbacks give it.

    Only texts that start with ``<html``, in lower case, are converted (``accept_doctype``
    also takes a leading ``<!DOCTYPE html`` in any case); others pass unchanged.  A
    newline goes after ``</div>`` and before ``<br``; comments and tags are
    dropped; script/style content is kept verbatim (raw text, no tag or
    entity processing), as the reference's parser keeps it.
    """
    t = F.replace(F.replace(html, F.lit("</div>"), F.lit("</div>\n")), F.lit("<br"), F.lit("\n<br"))
    t = F.regexp_replace(t, HTML_COMMENT_RE, "")
    segs = F.split(t, RAW_TEXT_SPLIT_RE, -1)
    cleaned = F.transform(segs, lambda s, i: F.when(
        i % 2 == 1, s).otherwise(unescape_entities(F.regexp_replace(s, HTML_TAG_RE, ""))))
    text = F.array_join(cleaned, "")
    starts = html.startswith("<html")
    if accept_doctype:
        starts = starts | F.lower(F.substring(html, 1, 14)).startswith("<!doctype html")
    return F.when(starts, text).otherwise(html)


def form_key(line: Column) -> Column:
    return F.lower(F.regexp_extract(line, FORM_FIELD_RE, 1))


def form_value(line: Column) -> Column:
    return py_strip(F.regexp_extract(line, FORM_FIELD_RE, 2))


def form_matches(line: Column) -> Column:
    return line.rlike(FORM_FIELD_RE)


def template_fields(template: Column) -> Column:
    """Distinct ``%field%`` names, only the first one on each line."""
    firsts = F.transform(F.split(template, "\n", -1),
                         lambda ln: F.regexp_extract(ln, TEMPLATE_FIELD_RE, 1))
    return F.array_sort(F.array_distinct(F.filter(firsts, lambda f: f != "")))


def render_map(template: Column, variables: Column) -> Column:
    """P21 with a MAP<string,string> of variables (any number of keys)."""
    return F.aggregate(F.map_entries(variables), template,
                       lambda acc, e: F.replace(acc, F.concat(F.lit("%"), e["key"], F.lit("%")),
                                                F.coalesce(e["value"], F.lit(""))))


def display_address(first: Column, last: Column, email: Column) -> Column:
    """``"First Last" <email>``."""
    return F.format_string('"%s %s" <%s>', first, last, email)


def is_number(c: Column) -> Column:
    """The text parses as a floating number."""
    return c.try_cast("double").isNotNull()


def chop(c: Column, n: int = 4) -> Column:
    """Python ``s[:len(s)-n]`` (a negative stop counts from the end again)."""
    k = F.length(c) - n
    keep = F.when(k >= 0, k).otherwise(F.greatest(F.length(c) + k, F.lit(0)))
    return F.substring(c, F.lit(1), keep)


def normalize_column_list(spec: str) -> list[str]:
    """``'Name, E Mail'`` -> ``['name', 'email']`` (lower, spaces removed, split on commas)."""
    return spec.lower().replace(" ", "").split(",")


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.coalesce(F.instr(c, n) > 0, F.lit(False)) for n in needles])
