"""License scans (operator 1); DataFrame functions only.

Two layers of rules work on a text's words (A-Z lower-cased, joined by one
blank).  Base phrases are counted at every place.  Signature rules are regular
expressions with keywords, a priority and a weight: a rule runs only on texts
that hold one of its keywords, and only texts that hold one of ``TRIGGERS`` or
of the keywords of alternatives without a trigger get words at all.  Both are
read off the expressions, so that every match holds one.  Detections that overlap are resolved: one that lies inside another is
dropped (of equal intervals the higher priority stays, then the earlier rule),
and one that crosses another of higher priority is dropped.

The rules are formed from the hand-written table of names below: each name
gives its plain form, its "licensed under" form and its SPDX tag, in rising
priority; texts of well-known clauses follow.

Defined results: null and empty text have no words, no labels and score 0;
repeated rows and null doc_id pass through; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from re import _constants as kind
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import let, lower_az, match_spans

# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ and the same with A-Z, as what they allow: Java matches that several times faster.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
WORD_ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)

#: Every base phrase and most alternatives of the rules hold one of these.
TRIGGERS = ("licen", "copyright", "copyleft", "reserved", "spdx", "warrant", "redistribut", "creative", "granted",
            "domain", "cc0")

_L = "licen[cs]e"
_V = "(?: v| version| ver)?"
#: label, pattern of the name in words
NAMES = (
    ("mit", f"(?:mit|expat|x11) {_L}"),
    ("mit-0", f"mit(?: 0| no attribution) {_L}"),
    ("mit-advertising", f"mit {_L} with advertising"),
    ("apache-1.0", f"apache(?: software)? {_L}{_V} 1 0"),
    ("apache-1.1", f"apache(?: software)? {_L}{_V} 1 1"),
    ("apache-2.0", f"apache(?: software)? {_L}{_V} 2(?: 0)?"),
    ("apache", f"apache(?: software)? {_L}"),
    ("gpl-1.0", f"(?:gnu )?general public {_L}{_V} 1(?: 0)?"),
    ("gpl-2.0", f"(?:gnu )?general public {_L}{_V} 2(?: 0)?"),
    ("gpl-2.0-or-later", f"(?:gnu )?general public {_L}{_V} 2(?: 0)? or(?: at your option)?(?: any)? later"),
    ("gpl-3.0", f"(?:gnu )?general public {_L}{_V} 3(?: 0)?"),
    ("gpl-3.0-or-later", f"(?:gnu )?general public {_L}{_V} 3(?: 0)? or(?: at your option)?(?: any)? later"),
    ("gpl", f"(?:gnu )?general public {_L}"),
    ("lgpl-2.0", f"(?:gnu )?library general public {_L}{_V} 2(?: 0)?"),
    ("lgpl-2.1", f"(?:gnu )?lesser general public {_L}{_V} 2 1"),
    ("lgpl-3.0", f"(?:gnu )?lesser general public {_L}{_V} 3(?: 0)?"),
    ("lgpl", f"(?:gnu )?lesser general public {_L}"),
    ("agpl-3.0", f"(?:gnu )?affero general public {_L}{_V} 3(?: 0)?"),
    ("agpl", f"(?:gnu )?affero general public {_L}"),
    ("gfdl-1.2", f"(?:gnu )?free documentation {_L}{_V} 1 2"),
    ("gfdl-1.3", f"(?:gnu )?free documentation {_L}{_V} 1 3"),
    ("gfdl", f"(?:gnu )?free documentation {_L}"),
    ("bsd-2-clause", f"(?:bsd 2 clause|simplified bsd|freebsd)(?: {_L})?"),
    ("bsd-3-clause", f"(?:bsd 3 clause|(?:new|modified|revised) bsd)(?: {_L})?"),
    ("bsd-4-clause", f"(?:bsd 4 clause|(?:original|old) bsd)(?: {_L})?"),
    ("0bsd", f"(?:0bsd|zero clause bsd)(?: {_L})?"),
    ("bsd", f"bsd(?: style)? {_L}"),
    ("isc", f"isc {_L}"),
    ("mpl-1.0", f"mozilla public {_L}{_V} 1 0"),
    ("mpl-1.1", f"mozilla public {_L}{_V} 1 1"),
    ("mpl-2.0", f"mozilla public {_L}{_V} 2(?: 0)?"),
    ("mpl", f"mozilla public {_L}"),
    ("epl-1.0", f"eclipse public {_L}{_V} 1(?: 0)?"),
    ("epl-2.0", f"eclipse public {_L}{_V} 2(?: 0)?"),
    ("epl", f"eclipse public {_L}"),
    ("edl-1.0", f"eclipse distribution {_L}(?:{_V} 1 0)?"),
    ("eupl-1.1", f"european union public {_L}{_V} 1 1"),
    ("eupl-1.2", f"european union public {_L}{_V} 1 2"),
    ("cddl-1.0", f"common development and distribution {_L}(?:{_V} 1 0)?"),
    ("cddl-1.1", f"common development and distribution {_L}{_V} 1 1"),
    ("cpl-1.0", f"common public {_L}(?:{_V} 1 0)?"),
    ("cpal-1.0", f"common public attribution {_L}(?:{_V} 1 0)?"),
    ("bsl-1.0", f"boost software {_L}(?:{_V} 1 0)?"),
    ("busl-1.1", f"business source {_L}(?:{_V} 1 1)?"),
    ("sspl-1.0", f"server side public {_L}(?:{_V} 1)?"),
    ("elastic-2.0", f"elastic {_L}(?:{_V} 2(?: 0)?)?"),
    ("artistic-1.0", f"artistic {_L}{_V} 1(?: 0)?"),
    ("artistic-2.0", f"artistic {_L}{_V} 2(?: 0)?"),
    ("artistic", f"artistic {_L}"),
    ("zlib", f"(?:zlib|zlib libpng) {_L}"),
    ("libpng", f"(?:libpng|png reference library) {_L}"),
    ("openssl", f"openssl {_L}"),
    ("python-2.0", f"python(?: software foundation)? {_L}(?:{_V} 2(?: 0)?)?"),
    ("ruby", f"ruby {_L}"),
    ("php-3.0", f"php {_L}{_V} 3(?: 0)?"),
    ("php-3.01", f"php {_L}{_V} 3 01"),
    ("postgresql", f"postgresql {_L}"),
    ("ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_L}"),
    ("ofl-1.1", f"(?:sil )?open font {_L}(?:{_V} 1 1)?"),
    ("odbl-1.0", f"open (?:data commons open )?database {_L}(?:{_V} 1 0)?"),
    ("odc-by-1.0", f"open data commons attribution {_L}(?:{_V} 1 0)?"),
    ("pddl-1.0", f"public domain dedication and {_L}"),
    ("osl-3.0", f"open software {_L}(?:{_V} 3(?: 0)?)?"),
    ("afl-3.0", f"academic free {_L}(?:{_V} 3(?: 0)?)?"),
    ("ms-pl", f"microsoft public {_L}"),
    ("ms-rl", f"microsoft reciprocal {_L}"),
    ("upl-1.0", f"universal permissive {_L}(?:{_V} 1 0)?"),
    ("unlicense", "(?:the )?unlicense"),
    ("wtfpl", f"do what the f\\w* you want to public {_L}"),
    ("beerware", f"beer ?ware(?: {_L})?"),
    ("vim", f"vim {_L}"),
    ("w3c", f"w3c(?: software(?: notice)?(?: and)?)? {_L}"),
    ("llama", f"llama(?: 2| 3)?(?: community)? {_L}"),
    ("openrail", f"(?:creativeml )?open ?rail(?: m| s| d)?(?: {_L})?"),
    ("cc0-1.0", "(?:creative commons zero|cc0)(?: 1 0)?"),
    ("cc-by-4.0", "(?:creative commons attribution|cc by)(?: international)? 4 0"),
    ("cc-by-3.0", "(?:creative commons attribution|cc by)(?: unported)? 3 0"),
    ("cc-by-sa-4.0", "(?:creative commons attribution share ?alike|cc by sa)(?: international)? 4 0"),
    ("cc-by-sa-3.0", "(?:creative commons attribution share ?alike|cc by sa)(?: unported)? 3 0"),
    ("cc-by-nc-4.0", "(?:creative commons attribution non ?commercial|cc by nc)(?: international)? 4 0"),
    ("cc-by-nc-3.0", "(?:creative commons attribution non ?commercial|cc by nc)(?: unported)? 3 0"),
    ("cc-by-nc-sa-4.0", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 4 0"),
    ("cc-by-nc-nd-4.0", "(?:creative commons attribution non ?commercial no ?deriv\\w*|cc by nc nd) 4 0"),
    ("cc-by-nd-4.0", "(?:creative commons attribution no ?deriv\\w*|cc by nd) 4 0"),
    ("cc-by", f"(?:creative commons attribution|cc by)(?: {_L})?"),
    ("cc-by-nc", f"(?:creative commons attribution non ?commercial|cc by nc)(?: {_L})?"),
)
_GPL = "(?:gnu )?{name}(?: ?v| version| ver)? ?"
#: names that stand without the word license: label, pattern
SHORT = (
    ("gpl-2.0", _GPL.format(name="gpl") + "2(?: 0)?(?: only)?"),
    ("gpl-2.0-or-later", _GPL.format(name="gpl") + "2(?: 0)? or(?: any)? later"),
    ("gpl-3.0", _GPL.format(name="gpl") + "3(?: 0)?(?: only)?"),
    ("gpl-3.0-or-later", _GPL.format(name="gpl") + "3(?: 0)? or(?: any)? later"),
    ("gpl", "(?:gnu gpl|gpl licen[cs]ed?)"),
    ("lgpl-2.1", _GPL.format(name="lgpl") + "2 1(?: only)?"),
    ("lgpl-2.1-or-later", _GPL.format(name="lgpl") + "2 1 or(?: any)? later"),
    ("lgpl-3.0", _GPL.format(name="lgpl") + "3(?: 0)?(?: only)?"),
    ("agpl-3.0", _GPL.format(name="agpl") + "3(?: 0)?(?: only)?"),
    ("apache-2.0", "apache 2 0"),
    ("mpl-2.0", "mpl 2 0"),
    ("epl-2.0", "epl 2 0"),
    ("eupl-1.2", "eupl 1 2"),
    ("bsl-1.0", "bsl 1 0"),
)
#: clauses and notices: label, pattern, priority, weight
CLAUSES = (
    ("all-rights-reserved", "all rights reserved", 2, 0.6),
    ("copyright-notice", "copyright(?: c)?(?: by)?(?: (?:19|20)[0-9]{2}){1,4}", 1, 0.4),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 3, 0.8),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5, 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 5, 0.95),
    ("bsd", "redistributions? (?:and use )?in source and binary forms?", 4, 0.9),
    ("bsd-3-clause", "neither the name of (?:\\S+ ){1,8}nor the names of", 5, 0.9),
    ("no-warranty", "without (?:any )?warrant(?:y|ies)(?: of any kind| or conditions of any kind)?", 1, 0.3),
    ("as-is", "provided (?:on an )?as is(?: basis)?(?: without warranty of any kind)?", 1, 0.3),
    ("proprietary", "proprietary and confidential", 3, 0.7),
    ("no-commercial-use", "(?:not for commercial use|non commercial use only)", 2, 0.5),
    ("license-file", f"see (?:the )?(?:accompanying )?{_L} file", 1, 0.3),
    ("copyleft", "copyleft", 1, 0.3),
)
_UNDER = ("(?:licen[cs]ed|released|distributed|available|published|provided|made available)(?: to you)? under "
          "(?:an? |the )?(?:terms (?:of|and conditions of) (?:an? |the )?)?")


def literals(pattern: str) -> list[list[str]]:
    """For each alternative of a pattern the pieces of text that every match of it holds."""
    def walk(items) -> list[str]:  # \0 stands for what varies
        out = [""]
        for op, arg in items:
            if op is kind.LITERAL:
                more = [chr(arg)]
            elif op is kind.SUBPATTERN:
                more = walk(arg[-1])
            elif op is kind.BRANCH:
                more = [x for branch in arg[1] for x in walk(branch)]
            else:
                more = ["\0"]
            out = [x + y for x in out for y in more]
        return out

    return [[p.strip() for p in x.split("\0") if p.strip()] for x in dict.fromkeys(walk(parser.parse(pattern)))]


#: Pieces of many rules tell little: they count as so many letters.
_COMMON = {"licen": 4.5, "public licen": 4.6, **dict.fromkeys(
    ("under", "under the", "e", "ed", "ware", "released", "distributed", "available", "published", "provided",
     "made available", "later", "2 1 or"), 0)}


def keywords(pattern: str) -> tuple[str, ...]:
    """Every match of the pattern holds one of these."""
    return tuple(sorted({max(pieces, key=lambda p: (_COMMON.get(p, len(p)), p)) for pieces in literals(pattern)}))


def untriggered() -> list[tuple[tuple[str, ...], str]]:
    """For the alternatives that need not hold one of TRIGGERS: (words, longest piece) that every match of one holds."""
    found = set()
    for _, _, pattern, *_ in rules():
        for pieces in literals(pattern):
            if not any(t in p for p in pieces for t in TRIGGERS):
                found.add((frozenset(w for p in pieces for w in p.split(" ")), max(pieces, key=lambda p: (len(p), p)), tuple(pieces)))

    def implied(words, piece, pieces):
        return any((other, longest) != (words, piece) and other <= words and any(longest in p for p in pieces)
                   for other, longest, _ in found)

    return sorted({(tuple(sorted(x[0], key=lambda w: (-len(w), w))), x[1]) for x in found if not implied(*x)})


def rules() -> list[tuple[int, str, str, tuple[str, ...], int, float]]:
    """(number, label, pattern, keywords, priority, weight), in rule order."""
    out = []
    for label, name in NAMES:
        out.append((label, name, 2, 0.7))
        out.append((label, _UNDER + f"(?:{name})", 4, 0.9))
        tag = label.replace("-", " ").replace(".", " ")
        out.append((label, f"spdx {_L} identifier {tag}", 6, 1.0))
    out += [(label, pattern, 3, 0.8) for label, pattern in SHORT]
    out += CLAUSES
    return [(i, label, pattern, keywords(pattern), rank, weight) for i, (label, pattern, rank, weight) in enumerate(out)]


def _spaces(s):
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))


def detections(norm):
    """Resolved detections of the signature rules in a text of words joined by one blank."""
    table = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"),
                               F.lit(f"(?<![^ ])(?:{p})(?![^ ])").alias("regex"), F.array(*map(F.lit, w)).alias("keywords"),
                               F.lit(rank).alias("rank"), F.lit(weight).alias("weight"))
                      for i, label, p, w, rank, weight in rules()])
    gated = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(norm, k)))

    def found(r):
        # a match starts and ends at word edges, so blanks before it count the words before it
        return F.transform(match_spans(norm, r["regex"], _spaces), lambda s: F.struct(
            s["start"].alias("start"), (s["end"] + 1).alias("end"), r["rank"].alias("rank"), r["rule"].alias("rule"),
            r["label"].alias("label"), r["weight"].alias("weight"), s["match"].alias("match")))

    def resolve(all_found):
        """In order of precedence (priority, length, rule, place): a detection stays unless it lies inside one that
        stays or crosses one of higher priority that stays."""
        def loses(x, kept):
            return F.exists(kept, lambda d: ((d["start"] <= x["start"]) & (d["end"] >= x["end"]))
                            | ((d["start"] < x["end"]) & (x["start"] < d["end"]) & (d["rank"] > x["rank"])
                               & ~((x["start"] <= d["start"]) & (x["end"] >= d["end"]))))

        ordered = F.array_sort(F.transform(all_found, lambda x: F.struct(
            (-x["rank"]).alias("a"), (x["start"] - x["end"]).alias("b"), x["rule"].alias("c"), x["start"].alias("d"),
            x.alias("x"))))
        none = F.filter(all_found, lambda x: F.lit(False))
        return F.array_sort(F.aggregate(ordered, none, lambda kept, o: F.when(loses(o["x"], kept), kept).otherwise(
            F.concat(kept, F.array(o["x"])))))

    return let(F.flatten(F.transform(gated, found)), resolve)


def base_places(words):
    """array<struct<start,label>>: every place where a base phrase's words stand one after the other."""
    def at(i):
        tests = F.lit(None).cast("string")
        for phrase, label in BASE:
            hit = F.lit(True)
            for k, w in enumerate(phrase):
                hit = hit & F.coalesce(F.get(words, i + k) == w, F.lit(False))
            tests = F.coalesce(tests, F.when(hit, F.lit(label)))
        return F.struct(i.cast("long").alias("start"), tests.alias("label"))

    ends = sorted({p[-1] for p, _ in BASE})
    some = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*[p[0] for p, _ in BASE]), i)), lambda i: i.isNotNull())
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, ends))),
                  F.filter(F.transform(some, at), lambda p: p["label"].isNotNull()))


def _may_match(low):
    """Whether a text in lower case may hold a detection."""
    gate = F.lit(False)
    for t in TRIGGERS:
        gate = gate | F.contains(low, F.lit(t))
    for words, piece in untriggered():
        hit = F.lit(True)
        for w in words:
            hit = hit & F.contains(low, F.lit(w))
        gate = gate | (hit & F.rlike(low, F.lit(GAP.join(piece.split(" ")))) if " " in piece else hit)
    return gate


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, base array<struct<start,label>>,
    found array<struct<start,end,rank,rule,label,weight,match>> (places in words, end exclusive)."""
    raw = F.coalesce("text", F.lit(""))
    gate = let(F.lower(raw), _may_match)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.regexp_count(raw, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
                       F.when(gate, F.regexp_extract_all(lower_az(raw), F.lit(WORD), F.lit(0))).alias("words"))
    norm = F.array_join("words", " ")
    rows = rows.select("doc_id", "n_words", base_places(F.col("words")).alias("base"),
                       F.when(F.col("words").isNotNull(), let(norm, detections)).alias("found"))
    return rows


def digest(scanned: DataFrame) -> DataFrame:
    """Columns of the op1 query."""
    starts = F.transform("base", lambda p: p["start"])
    none = F.array().cast("array<string>")
    base = F.coalesce(F.array_distinct(F.transform("base", lambda p: p["label"])), none)
    more = F.coalesce(F.transform("found", lambda d: d["label"]), none)
    n_base = F.coalesce(F.when(F.col("base").isNotNull(), F.size("base")), F.lit(0)).cast("long")
    weight = F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0))
    return scanned.select("doc_id", "n_words", n_base.alias("n_base"), F.array_min(starts).alias("first_word"),
                          F.array_max(starts).alias("last_word"),
                          F.array_join(F.array_sort(base), ",").alias("base_labels"),
                          F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
                          F.greatest(weight, F.when(n_base > 0, 0.5).otherwise(0.0)).alias("score"))
