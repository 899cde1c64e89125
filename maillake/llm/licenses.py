"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority.

A rule is a regular expression with a label, a priority (0 first), a confidence and the
keyword without which it cannot match.  One Aho-Corasick pass over a text finds the keywords
it holds; only their rules run.  Detections are taken in order of priority, then length;
one that lies inside the interval of a detection already taken is suppressed.

The base phrases are fixed: places where their words stand consecutively.  They are always
reported, suppression or not.  ASCII letters are compared without case; nothing else is folded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maillake.llm.common import process_cache, text_or_empty

#: Phrase -> label.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CONFIDENCE = 0.6
_WORD = r"0-9a-z\x80-\xff"          # word bytes of lower-cased UTF-8, read as Latin-1

#: label, name (regex over lower-case text), SPDX identifier (regex or None)
FAMILIES = [
    ("mit", r"(?:mit|expat|x11)(?:/x11)?", r"mit(?:-0|-modern-variant)?"),
    ("apache-1.1", r"apache(?: software)?(?: license)?,? (?:version |v\.? ?)?1\.1", r"apache-1\.1"),
    ("apache-2.0", r"apache(?: software)?(?: license)?,?(?: \(?(?:version |v\.? ?)?2(?:\.0)?\)?)", r"apache-2\.0"),
    ("bsd-2-clause", r"(?:simplified |freebsd |2-clause |two-clause )bsd|bsd[ -](?:2|two)[ -]clause", r"bsd-2-clause(?:-patent|-views)?"),
    ("bsd-3-clause", r"(?:new |modified |revised |3-clause |three-clause )bsd|bsd[ -](?:3|three)[ -]clause", r"bsd-3-clause(?:-clear|-lbnl)?"),
    ("bsd-4-clause", r"(?:original |4-clause )bsd|bsd[ -]4[ -]clause", r"bsd-4-clause(?:-uc)?"),
    ("bsd", r"(?:berkeley software distribution|bsd)", r"0bsd"),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl),?[ -]?(?:version |v\.? ?)?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl),?[ -]?(?:version |v\.? ?)?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?"),
    ("gpl", r"(?:gnu )?(?:general public license|gpl)", r"gpl-1\.0(?:-only|-or-later|\+)?"),
    ("lgpl-2.1", r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl),?[ -]?(?:version |v\.? ?)?2(?:\.[01])?", r"lgpl-2\.[01](?:-only|-or-later|\+)?"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl),?[ -]?(?:version |v\.? ?)?3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl),?[ -]?(?:(?:version |v\.? ?)?3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later|\+)?"),
    ("gfdl", r"(?:gnu )?(?:free documentation license|fdl|gfdl)(?:,? (?:version |v)?1\.[123])?", r"gfdl-1\.[123](?:-only|-or-later)?"),
    ("mpl-1.1", r"(?:mozilla public license|mpl),?[ -]?(?:version |v\.? ?)?1\.[01]", r"mpl-1\.[01]"),
    ("mpl-2.0", r"(?:mozilla public license|mpl),?[ -]?(?:version |v\.? ?)?2(?:\.0)?", r"mpl-2\.0(?:-no-copyleft-exception)?"),
    ("epl", r"(?:eclipse public license|epl)(?:,?[ -]?(?:version |v\.? ?)?[12]\.0)?", r"epl-[12]\.0"),
    ("eupl", r"(?:european union public licen[cs]e|eupl)(?:,?[ -]?(?:version |v\.? ?)?1\.[012])?", r"eupl-1\.[012]"),
    ("cddl", r"(?:common development and distribution license|cddl)(?:,?[ -]?(?:version |v\.? ?)?1\.[01])?", r"cddl-1\.[01]"),
    ("cpl", r"common public license(?:,? (?:version |v)?1\.0)?", r"cpl-1\.0"),
    ("cecill", r"cecill(?:-[abc])?(?: (?:version |v)?[12](?:\.[01])?)?", r"cecill-(?:[bc]|[12]\.[01])"),
    ("artistic", r"artistic license(?:,? (?:version |v)?[12]\.0)?", r"artistic-[12]\.0(?:-perl|-cl8)?"),
    ("isc", r"(?:isc|internet systems consortium)", r"isc"),
    ("zlib", r"zlib(?:/libpng)?", r"zlib(?:-acknowledgement)?"),
    ("boost", r"boost software license(?:,? (?:version |v)?1\.0)?", r"bsl-1\.0"),
    ("unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public license)", r"wtfpl"),
    ("python", r"(?:python software foundation|psf)(?: license)?(?: (?:version )?2(?:\.0)?)?", r"(?:psf|python)-2\.0(?:\.1)?"),
    ("php", r"php(?: license)?,? (?:version |v)?3\.0[01]?", r"php-3\.0[1]?"),
    ("ruby", r"ruby(?:'s)?", r"ruby"),
    ("openssl", r"(?:openssl|ssleay)", r"openssl"),
    ("postgresql", r"postgresql", r"postgresql"),
    ("ofl", r"(?:sil )?open font license(?:,? (?:version |v)?1\.[01])?", r"ofl-1\.[01](?:-no-rfn|-rfn)?"),
    ("odbl", r"(?:open (?:data commons )?(?:open )?database license|odbl)(?: (?:v)?1\.0)?", r"odbl-1\.0"),
    ("odc-by", r"open data commons attribution(?: license)?(?: (?:v)?1\.0)?", r"odc-by-1\.0"),
    ("pddl", r"(?:public domain dedication and license|pddl)(?: (?:v)?1\.0)?", r"pddl-1\.0"),
    ("cc0", r"(?:creative commons zero|cc[ -]?(?:0|zero))(?:[ -](?:v)?1\.0)?(?: universal)?", r"cc0-1\.0"),
    ("sspl", r"(?:server side public license|sspl)(?:,? (?:version |v)?1)?", r"sspl-1\.0"),
    ("busl", r"(?:business source license|busl|bsl)(?:,? (?:version |v)?1\.1)?", r"busl-1\.1"),
    ("elastic", r"elastic license(?:,? (?:version |v)?[12](?:\.0)?)?", r"elastic-2\.0"),
    ("openrail", r"(?:bigscience |bigcode )?(?:creativeml )?(?:open)?rail(?:\+\+)?(?:-[ms])?", r"openrail(?:\+\+)?"),
    ("llama", r"llama ?[234](?:\.[0-9])? community", None),
    ("ms-pl", r"microsoft public license|ms-pl", r"ms-pl"),
    ("ms-rl", r"microsoft reciprocal license|ms-rl", r"ms-rl"),
    ("ogl-uk", r"open government licen[cs]e(?:,? (?:version |v)?[123]\.0)?", r"ogl-uk-[123]\.0"),
]
#: The terms of Creative Commons licenses, in abbreviated and spelled-out form.
CC_TERMS = {
    "by": (r"by", r"attribution"),
    "by-sa": (r"by[- ]sa", r"attribution[- ]share-?alike"),
    "by-nd": (r"by[- ]nd", r"attribution[- ]no-?deriv(?:ative)?s?(?: works)?"),
    "by-nc": (r"by[- ]nc", r"attribution[- ]non-?commercial"),
    "by-nc-sa": (r"by[- ]nc[- ]sa", r"attribution[- ]non-?commercial[- ]share-?alike"),
    "by-nc-nd": (r"by[- ]nc[- ]nd", r"attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?(?: works)?"),
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: label, regex, keyword, priority, confidence of rules outside the families
SINGLES = [
    ("copyright", r"copyright (?:\(c\)|\xc2\xa9)? ?(?:19|20)[0-9]{2}", "copyright", 4, 0.7),
    ("copyright", r"\xc2\xa9 ?(?:19|20)[0-9]{2}", "\xc2\xa9", 4, 0.6),
    ("copyright", r"\(c\) (?:19|20)[0-9]{2}", "(c)", 5, 0.5),
    ("copyright", r"copyright (?:holder|owner|notice)s?", "copyright", 5, 0.4),
    ("public-domain", r"(?:dedicated to|placed in(?:to)?|released (?:in)?to|in) the public domain", "domain", 2, 0.9),
    ("public-domain", r"no known copyright restrictions", "copyright", 2, 0.8),
    ("proprietary", r"proprietary and confidential", "proprietary", 2, 0.9),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|distribution|use)", "unauthori", 2, 0.9),
    ("proprietary", r"may not be (?:reproduced|copied|redistributed)", "reproduced|copied|redistributed", 2, 0.85),
    ("proprietary", r"no part of this (?:publication|book|work|document) may be", "publication|book|work|document", 2, 0.9),
    ("proprietary", r"(?:strictly )?for internal use only", "internal", 3, 0.7),
    ("proprietary", r"subject to (?:the )?end[- ]user licen[cs]e agreement", "agreement", 3, 0.8),
    ("non-commercial", r"(?:for )?non-?commercial (?:use|purposes) only", "commercial", 3, 0.8),
    ("non-commercial", r"not for commercial use", "commercial", 3, 0.8),
    ("personal-use", r"for personal use only", "personal", 3, 0.7),
    ("research-only", r"for (?:academic|research|educational) (?:use|purposes) only", "academic|research|educational", 3, 0.7),
    ("no-ai-training", r"(?:may not|must not|not) be used (?:to train|for training)", "train", 2, 0.9),
    ("warranty-disclaimer", r"without warranty of any kind", "warranty", 4, 0.6),
    ("warranty-disclaimer", r"provided \"?as[- ]is\"?", "provided", 4, 0.6),
    ("mit", r"permission is hereby granted, free of charge", "hereby", 1, 0.95),
    ("isc", r"permission to use, copy, modify,? and/or distribute this software", "permission", 1, 0.95),
    ("bsd", r"redistribution and use in source and binary forms", "redistribution", 1, 0.95),
    ("gpl", r"this program is free software[;:,] you can redistribute it", "redistribute", 1, 0.95),
    ("lgpl", r"this library is free software[;:,] you can redistribute it", "redistribute", 1, 0.95),
    ("unlicense", r"this is free and unencumbered software", "unencumbered", 1, 0.95),
    ("zlib", r"this software is provided 'as-is', without any express", "as-is", 1, 0.95),
]
URLS = [
    ("apache-2.0", r"apache\.org/licenses/license-2\.0"), ("mit", r"opensource\.org/licenses?/mit"),
    ("bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"), ("bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("gpl-2.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"), ("gpl-3.0", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", r"gnu\.org/licenses/gpl(?:\.html|\.txt)?"), ("lgpl-2.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", r"gnu\.org/licenses/lgpl-3\.0"), ("agpl-3.0", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl", r"gnu\.org/(?:licenses|copyleft)/fdl"), ("mpl-2.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl", r"eclipse\.org/(?:org/documents|legal)/epl"), ("cc0", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", r"creativecommons\.org/publicdomain/mark/1\.0"), ("unlicense", r"unlicense\.org"),
    ("odbl", r"opendatacommons\.org/licenses/odbl"), ("ofl", r"scripts\.sil\.org/ofl"), ("boost", r"boost\.org/license_1_0"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float


def default_rules() -> list[Rule]:
    """All rules in order: identifiers, grants and addresses, bare names, single phrases."""
    out = []
    grant = r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|governed|offered) (?:under|by) (?:the )?(?:terms of (?:the )?)?(?:an? )?"
    verbs = "licensed|licenced|released|distributed|published|available|provided|covered|governed|offered"
    for label, name, spdx in FAMILIES:
        if spdx:
            out.append(Rule(label, rf"spdx-license-identifier: ?(?:{spdx})(?![\w.+-])", "spdx", 0, 0.99))
            out.append(Rule(label, rf"\blicen[cs]e(?:\"|')? ?[:=] ?(?:\"|')?(?:{spdx})(?![\w.+-])", "licen", 1, 0.9))
        out.append(Rule(label, rf"{grant}(?:{name})(?: licen[cs]es?)?(?!\w)", verbs, 1, 0.95))
        out.append(Rule(label, rf"\b(?:{name})(?:[ -]style)? licen[cs]e\b", "licen", 3, 0.8))
        out.append(Rule(label, rf"\bsubject to (?:the )?(?:terms of (?:the )?)?(?:{name})(?!\w)", "subject", 1, 0.9))
    for code, (short, long) in CC_TERMS.items():
        for version in CC_VERSIONS:
            v = re.escape(version)
            out.append(Rule(f"cc-{code}-{version}", rf"\bcc[- ]{short}[- ]{v}(?![\w])", "cc", 1, 0.95))
            out.append(Rule(f"cc-{code}-{version}", rf"creative commons {long}(?: license)?,? {v}", "creative", 1, 0.95))
            out.append(Rule(f"cc-{code}-{version}", rf"creativecommons\.org/licenses/{code}/{v}", "creativecommons", 1, 0.97))
        out.append(Rule(f"cc-{code}", rf"\bcc[- ]{short}(?![\w-])", "cc", 3, 0.7))
        out.append(Rule(f"cc-{code}", rf"creative commons {long}", "creative", 3, 0.8))
    out += [Rule(label, rf"{url}(?![\w-])", url[:6].replace("\\", ""), 1, 0.97) for label, url in URLS]
    out += [Rule(*x) for x in SINGLES]
    return out


def _loosen(pattern: str) -> str:
    """A blank of a rule stands for any white space."""
    for blank, loose in (("[- ]", r"[-\s]"), ("[ -]", r"[\s-]"), (" ?", r"\s*"), (" ", r"\s+")):
        pattern = pattern.replace(blank, loose)
    return pattern


class Scanner:
    """Compiled rules and their keyword automaton (a keyword is one word, or several of which any will do)."""

    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules = rules
        self.compiled = [re.compile(_loosen(r.pattern), re.ASCII) for r in rules]
        by_word: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for w in r.keyword.split("|"):
                by_word.setdefault(w, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for w, numbers in by_word.items():
            self.automaton.add_word(w, (w, numbers))
        self.phrases = []
        for phrase, label in BASE_PHRASES.items():
            words = phrase.split()
            pattern = rf"(?<![{_WORD}])" + rf"[^{_WORD}]+".join(words) + rf"(?![{_WORD}])"
            rare = max(words, key=len) if len(words) != 2 else words[0]
            self.phrases.append((rare, re.compile(pattern), label))
            if rare not in self.automaton:
                self.automaton.add_word(rare, (rare, []))
        self.automaton.make_automaton()
        self.word_byte = np.zeros(256, dtype=bool)
        self.word_byte[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

    def detections(self, low: str, numbers: list[int]) -> list[tuple[int, int, int]]:
        """Kept (start, end, rule number), by start; offsets are bytes of the UTF-8 text.

        A detection inside one kept before it goes.  A tree over the starts holds the largest end of those
        kept up to each, so n detections take n log n steps.
        """
        found = sorted((r.priority, m.start() - m.end(), m.start(), i, m.end())
                       for i in numbers for r in (self.rules[i],) for m in self.compiled[i].finditer(low))
        place = {s: k + 1 for k, s in enumerate(sorted({x[2] for x in found}))}
        reach = [-1] * (len(place) + 1)
        kept: list[tuple[int, int, int]] = []
        for _, _, start, i, end in found:
            k, furthest = place[start], -1
            while k:
                furthest = max(furthest, reach[k])
                k &= k - 1
            if furthest < end:
                kept.append((start, end, i))
                k = place[start]
                while k < len(reach):
                    reach[k] = max(reach[k], end)
                    k += k & -k
        return sorted(kept)

    def scan(self, text: str) -> dict:
        """Everything known of one text: words, base places (first byte, label) and kept detections."""
        data = text.encode("utf-8", "surrogatepass").lower()      # bytes.lower() folds A-Z only
        low = data.decode("latin-1")
        is_word = self.word_byte[np.frombuffer(data, dtype=np.uint8)]
        starts = is_word.copy()
        starts[1:] &= ~is_word[:-1]
        words, numbers = set(), set()
        for _, (w, own) in self.automaton.iter(low):
            words.add(w)
            numbers.update(own)
        places = [(m.start(), label) for rare, p, label in self.phrases if rare in words for m in p.finditer(low)]
        n = int(starts.sum())
        at = [int(starts[:p].sum()) for p in ((min(places)[0], max(places)[0]) if places else ())]
        return {"n_words": n, "places": sorted(places), "first_word": at[0] if at else None, "last_word": at[1] if at else None,
                "detections": self.detections(low, sorted(numbers)) if numbers else []}


def scanner(rules: list[Rule]) -> Scanner:
    cache, key = process_cache(), f"licenses {hash(tuple(rules))}"
    if key not in cache:
        cache[key] = Scanner(rules)
    return cache[key]


def scan(df: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base places and license detections of its whole text.

    ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score`` and
    ``detections`` (array of start, end, label, confidence; offsets in UTF-8 bytes).
    Labels are distinct, sorted, comma-joined ('' without any); the score combines the
    confidences of the distinct labels (1 minus the product of their complements), 0 without any.
    Null and empty texts have no words and no detections; null ids and repeated rows pass
    through; other columns are not read.  An empty table gives an empty result.
    """
    rules = default_rules() if rules is None else rules
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))

    def run(batches):
        s = scanner(rules)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                got = s.scan(t.as_py())
                base = {label for _, label in got["places"]}
                best = dict.fromkeys(base, BASE_CONFIDENCE)
                spans = []
                for start, end, i in got["detections"]:
                    r = rules[i]
                    best[r.label] = max(best.get(r.label, 0), r.confidence)
                    spans.append({"start": start, "end": end, "label": r.label, "confidence": r.confidence})
                doubt = 1.0
                for label in sorted(best):
                    doubt *= 1 - best[label]
                rows.append((got["n_words"], len(got["places"]), got["first_word"], got["last_word"], ",".join(sorted(base)),
                             ",".join(sorted(best)), round(1 - doubt, 6), spans))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    src = df.select(df[id_col], text_or_empty(df[text_col]).alias("__text"))
    return src.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words long, n_base long, "
                               "first_word long, last_word long, base_labels string, labels string, score double, "
                               "detections array<struct<start:long,end:long,label:string,confidence:double>>")
