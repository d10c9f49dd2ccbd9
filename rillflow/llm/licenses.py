"""License scans by ordered signature rules, in DataFrame expressions only.

A text is reduced to its words. A rule is a regular expression over words, gated by a keyword that
every match of it holds: only texts with a keyword meet the rules behind it. One pass over a text
finds the keywords' places; only the words around them go on, so the rules run over stretches of a
few words however long the text. Detections are word intervals; one that lies within another of the
same or a better priority is suppressed. The base phrases are rules as well, and what they find
always stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import staged

# Phrases that must be found, and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Priorities: the better one is the smaller.
VERSIONED, NAMED, FAMILY, HINT = 1, 2, 3, 4
WEIGHT = {VERSIONED: 1.0, NAMED: 0.9, FAMILY: 0.7, HINT: 0.4}
BASE_WEIGHT = 0.5


@dataclass(frozen=True)
class Rule:
    """``pattern`` is written in words: groups, alternatives and ``?`` as in regular expressions."""

    pattern: str
    label: str
    priority: int
    keyword: str
    base: bool = False

    @property
    def regex(self) -> str:
        return regex(self.pattern)


# What a word may hold, of a text whose letters are not lower-cased yet.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def regex(pattern: str) -> str:
    """A word pattern over text in which each word has a space before it; A-Z count as a-z."""

    def one(match: re.Match) -> str:
        part = match.group()
        return "" if part.isspace() else "(?:" if part == "(" else f" {part}"

    return "(?i)" + re.sub(r"[a-z0-9]+|\s+|\(", one, pattern) + f"(?!{_WORD})"


def any_of(texts: set[str]) -> str:
    """A regular expression for some texts, with what they begin with in common written once."""
    if texts == {""}:
        return ""
    heads: dict[str, set[str]] = {}
    for text in texts - {""}:
        heads.setdefault(text[0], set()).add(text[1:])
    parts = [re.escape(head) + any_of(tails) for head, tails in sorted(heads.items())]
    if "" not in texts:
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{'|'.join(parts)})?"


def _versions(name: str, label: str, versions: str, keyword: str) -> list[Rule]:
    """A license with its versions, each as a word or two, with and without the word version."""
    out = []
    for version in versions.split():
        words = version.replace(".", " ")
        zero = "" if "." in version else "( 0)?"
        full = f"{label}-{version}"
        out.append(Rule(f"{name} (version|v) {words}{zero}", full, VERSIONED, keyword))
        out.append(Rule(f"{name} {words}{zero}", full, VERSIONED, keyword))
        out.append(Rule(f"{name} v{words}{zero}", full, VERSIONED, keyword))
    return out


def _rules() -> list[Rule]:
    out = [Rule(phrase, label, FAMILY, phrase, True) for phrase, label in BASE.items()]

    # Licenses with versions: name, label, versions, keyword.
    for name, label, versions, keyword in [
        ("apache( software)? license", "apache", "1.0 1.1 2.0", "apache"),
        ("apache", "apache", "1.1 2.0", "apache"),
        ("(gnu )?general public license", "gpl", "1 2 3", "general public license"),
        ("(gnu )?gpl", "gpl", "1 2 3", "gpl"),
        ("(gnu )?(lesser|library) general public license", "lgpl", "2 2.1 3", "general public license"),
        ("(gnu )?lgpl", "lgpl", "2 2.1 3", "lgpl"),
        ("(gnu )?affero general public license", "agpl", "1 3", "general public license"),
        ("(gnu )?agpl", "agpl", "1 3", "agpl"),
        ("(gnu )?free documentation license", "gfdl", "1.1 1.2 1.3", "free documentation"),
        ("mozilla public license", "mpl", "1.0 1.1 2.0", "mozilla"),
        ("mpl", "mpl", "1.0 1.1 2.0", "mpl"),
        ("eclipse public license", "epl", "1.0 2.0", "eclipse"),
        ("eclipse distribution license", "edl", "1.0", "eclipse"),
        ("common development and distribution license", "cddl", "1.0 1.1", "common development"),
        ("common public license", "cpl", "1.0", "common public"),
        ("european union public licen(c|s)e", "eupl", "1.0 1.1 1.2", "european union public"),
        ("boost software license", "bsl", "1.0", "boost software"),
        ("academic free license", "afl", "1.1 1.2 2.0 2.1 3.0", "academic free"),
        ("open software license", "osl", "1.0 2.0 2.1 3.0", "open software"),
        ("artistic license", "artistic", "1.0 2.0", "artistic"),
        ("python( software foundation)? license", "psf", "2.0", "python"),
        ("zope public license", "zpl", "1.1 2.0 2.1", "zope"),
        ("educational community license", "ecl", "1.0 2.0", "educational community"),
        ("sil open font license", "ofl", "1.0 1.1", "open font"),
        ("open font license", "ofl", "1.0 1.1", "open font"),
        ("microsoft reciprocal license", "ms-rl", "1.0", "microsoft reciprocal"),
        ("php license", "php", "3.0 3.01", "php license"),
        ("server side public license", "sspl", "1", "server side public"),
        ("business source license", "busl", "1.0 1.1", "business source"),
        ("elastic license", "elastic", "1.0 2.0", "elastic license"),
        ("open data commons open database license", "odbl", "1.0", "open data commons"),
        ("open government licen(c|s)e", "ogl", "1.0 2.0 3.0", "open government"),
        ("cecill( free software license)?", "cecill", "1.0 1.1 2.0 2.1", "cecill"),
        ("mulan permissive software license", "mulan-psl", "1 2", "mulan"),
        ("unicode license", "unicode", "1 3", "unicode license"),
    ]:
        name = name.replace("licen(c|s)e", "(licence|license)")
        out += _versions(name, label, versions, keyword)

    # Creative Commons: each set of terms, by its code and by its words, with and without version.
    spelt = {
        "by": "attribution",
        "nc": "(noncommercial|non commercial)",
        "sa": "(sharealike|share alike)",
        "nd": "(noderivatives|noderivs|no derivatives|no derivs)",
    }
    for codes in ("by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd"):
        label = "cc-" + codes.replace(" ", "-")
        words = " ".join(spelt[c] for c in codes.split())
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = version.replace(".", " ")
            out.append(Rule(f"cc {codes} (version |v )?{number}", f"{label}-{version}", VERSIONED, "cc by"))
            out.append(
                Rule(
                    f"creative commons {words} (license |licence )?(version )?{number}",
                    f"{label}-{version}",
                    VERSIONED,
                    "creative commons",
                )
            )
        out.append(Rule(f"cc {codes}", label, NAMED, "cc by"))
        out.append(Rule(f"creative commons {words}", label, NAMED, "creative commons"))
    out += [
        Rule("(creative commons )?cc0( 1 0)?", "cc0-1.0", VERSIONED, "cc0"),
        Rule("creative commons zero", "cc0-1.0", NAMED, "creative commons"),
        Rule("creative commons (public domain|license|licence)", "cc", FAMILY, "creative commons"),
        Rule("creative commons", "cc", HINT, "creative commons"),
    ]

    # Licenses known by one name: pattern, label, keyword.
    for pattern, label, keyword in [
        ("mit license", "mit", "mit license"),
        ("(the )?mit (x11 )?(licence|license)", "mit", "mit"),
        ("(x11|expat) license", "mit", "license"),
        ("isc license", "isc", "isc license"),
        ("(bsd )?(0|zero) clause( bsd)?( license)?", "0bsd", "clause"),
        ("(bsd )?(2|two) clause( bsd)?( license)?", "bsd-2-clause", "clause"),
        ("(bsd )?(3|three) clause( bsd)?( license)?", "bsd-3-clause", "clause"),
        ("(bsd )?(4|four) clause( bsd)?( license)?", "bsd-4-clause", "clause"),
        ("(simplified|freebsd) (bsd )?license", "bsd-2-clause", "license"),
        ("(new|revised|modified) bsd license", "bsd-3-clause", "bsd"),
        ("original bsd license", "bsd-4-clause", "bsd"),
        ("bsd (style )?license", "bsd", "bsd"),
        ("zlib( libpng)? license", "zlib", "zlib"),
        ("libpng license", "libpng", "libpng"),
        ("(the )?unlicense", "unlicense", "unlicense"),
        ("do what the fuck you want to public license", "wtfpl", "public license"),
        ("wtfpl", "wtfpl", "wtfpl"),
        ("beerware( license)?", "beerware", "beerware"),
        ("openssl license", "openssl", "openssl"),
        ("postgresql license", "postgresql", "postgresql"),
        ("ruby license", "ruby", "ruby license"),
        ("perl artistic license", "artistic", "artistic"),
        ("university of illinois ncsa( open source)? license", "ncsa", "ncsa"),
        ("w3c software (notice and )?license", "w3c", "w3c"),
        ("microsoft public license", "ms-pl", "microsoft public"),
        ("ibm public license", "ipl", "ibm public"),
        ("apple public source license", "apsl", "apple public source"),
        ("q public license", "qpl", "public license"),
        ("sleepycat license", "sleepycat", "sleepycat"),
        ("vim license", "vim", "vim license"),
        ("json license", "json", "json license"),
        ("the software shall be used for good not evil", "json", "shall be used for good"),
        ("open data commons attribution license", "odc-by", "open data commons"),
        ("(odc )?public domain dedication and license", "pddl", "public domain"),
        ("open database license", "odbl", "open database"),
        ("lppl", "lppl", "lppl"),
        ("latex project public license", "lppl", "latex project"),
        ("commons clause", "commons-clause", "commons clause"),
        ("polyform (noncommercial|small business|shield|strict)( license)?", "polyform", "polyform"),
        ("prosperity public license", "prosperity", "prosperity"),
        ("open rail( m)?( license)?", "openrail", "open rail"),
        ("openrail( m)?( license)?", "openrail", "openrail"),
        ("llama (2 |3 )?community license", "llama", "community license"),
    ]:
        out.append(Rule(pattern, label, NAMED, keyword))

    # What texts of licenses say: pattern, label, keyword.
    for pattern, label, keyword in [
        ("permission is hereby granted free of charge to any person", "mit", "permission is hereby"),
        ("permission to use copy modify and( or)? distribute this software", "isc", "permission to use"),
        ("redistribution and use in source and binary forms", "bsd", "redistribution and use"),
        ("neither the name of", "bsd-3-clause", "neither the name"),
        ("all advertising materials mentioning", "bsd-4-clause", "advertising materials"),
        ("this software is provided as is", "as-is", "provided as is"),
        ("provided as is without warranty", "as-is", "provided as is"),
        ("without warranties or conditions of any kind", "apache", "without warranties"),
        ("you may not use this file except in compliance", "apache", "except in compliance"),
        ("this program is free software", "gpl", "free software"),
        ("this library is free software", "lgpl", "free software"),
        ("either version 2 of the license or", "gpl-2", "version 2 of the license"),
        ("either version 3 of the license or", "gpl-3", "version 3 of the license"),
        ("version 2 1 of the license", "lgpl-2.1", "of the license"),
        ("released into the public domain", "public-domain", "public domain"),
        ("(is |are )?in the public domain", "public-domain", "public domain"),
        ("public domain", "public-domain", "public domain"),
        ("no rights reserved", "public-domain", "rights reserved"),
        ("some rights reserved", "some-reserved", "rights reserved"),
        ("all rights are reserved", "reserved", "rights are reserved"),
        ("proprietary and confidential", "proprietary", "proprietary"),
        ("proprietary (license|licence|software)", "proprietary", "proprietary"),
        ("commercial (license|licence|software)", "proprietary", "commercial"),
        ("proprietary software", "proprietary", "proprietary"),
        ("end user license agreement", "eula", "end user license"),
        ("do not (copy|distribute|redistribute)", "no-copy", "do not"),
        ("may not be reproduced", "no-copy", "may not be reproduced"),
        ("reproduction (is )?prohibited", "no-copy", "prohibited"),
        ("for non commercial use only", "non-commercial", "non commercial"),
        ("for noncommercial use only", "non-commercial", "noncommercial"),
        ("for (research|educational|academic|personal) use only", "limited-use", "use only"),
    ]:
        out.append(Rule(pattern, label, FAMILY, keyword))

    # License tags: the tag's words after its key.
    tags = "mit isc zlib unlicense wtfpl ncsa postgresql vim beerware mpl apache gpl lgpl agpl epl".split()
    for key, tag in product(("spdx license identifier", "license"), tags):
        out.append(Rule(f"{key} {tag}", tag, FAMILY, "license"))
    for tag in ("bsd", "epl", "mpl", "gpl", "lgpl", "agpl", "gfdl"):
        out.append(Rule(f"{tag} (license|licence)", tag, FAMILY, tag))
        out.append(Rule(f"(under|by) (the )?(gnu )?{tag}", tag, HINT, tag))

    # Hints of some license or claim.
    for verb in ("licensed", "released", "distributed", "published", "available", "provided"):
        out.append(Rule(f"{verb} under( the| a| an)?( terms of)?", "license-notice", HINT, f"{verb} under"))
    for sign in ("copyright c", "copyright", "c copyright"):
        out.append(Rule(sign, "copyright", HINT, "copyright"))
    out.append(Rule("copyrighted", "copyright", HINT, "copyrighted"))
    return list(dict.fromkeys(out))


RULES = _rules()

# Stand for one and for many words that are left out.
_ONE, _MANY = "\x01", "\x02"
_MANY_WORDS = 64
_MARK = "\n"


def words_text(text: Column) -> Column:
    """Words of a text with one space before each."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _NO_WORD, " "))
    return F.when(words == "", words).otherwise(F.concat(F.lit(" "), words))


def _count(text: Column, sign: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def _bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is computed once, however often the function names it."""
    return F.transform(F.array(value), function)[0]


def _reach(rules: list[Rule]) -> int:
    """No spelling of any rule has more words."""
    return max(len(re.findall(r"[a-z0-9]+", rule.pattern)) for rule in rules)


def around_keywords(words: Column, rules: list[Rule]) -> Column:
    """``words`` as far as they lie within reach of a keyword, signs for the rest; null without any.

    Every keyword's place gets a mark in one pass. What stands between two marks keeps as many words
    at either end as a rule may have, so a match around a keyword keeps all of its words.
    """
    keys = any_of({f" {rule.keyword}" for rule in rules})
    marked = F.regexp_replace(words, f"(?i)(?={keys}(?!{_WORD}))", _MARK)
    reach = _reach(rules)

    def shortened(part: Column) -> Column:
        text, gone = part["text"], part["size"] - 2 * reach
        short = F.concat(
            F.substring_index(text, " ", reach + 1),
            F.repeat(F.lit(_MANY), F.floor(gone / _MANY_WORDS).cast("int")),
            F.repeat(F.lit(_ONE), (gone % _MANY_WORDS).cast("int")),
            F.lit(" "),
            F.substring_index(text, " ", -reach),
        )
        return F.when(gone > 0, short).otherwise(text)

    def kept(text: Column) -> Column:
        parts = F.transform(
            F.split(text, _MARK), lambda p: F.struct(p.alias("text"), _count(p, " ").alias("size"))
        )
        return F.when(F.contains(text, F.lit(_MARK)), F.array_join(F.transform(parts, shortened), ""))

    return _bound(marked, kept)


def _size(text: Column) -> Column:
    """Words of a part of ``around_keywords``, those left out included."""
    return _count(text, " ") + _count(text, _ONE) + _count(text, _MANY) * _MANY_WORDS


def detections(marked: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``row_no, rule, start, end`` and the rule's columns: every match of every rule, in words.

    ``marked`` has ``row_no`` and ``near``, the words around keywords.
    """
    spark = marked.sparkSession
    table = spark.createDataFrame(
        [
            (n, r.keyword, r.regex, r.label, r.priority, r.base, BASE_WEIGHT if r.base else WEIGHT[r.priority])
            for n, r in enumerate(rules)
        ],
        "rule int, keyword string, regex string, label string, priority int, base boolean, weight double",
    )
    keys = [F.lit(k) for k in sorted({r.keyword for r in rules})]
    near = F.lower("near")
    held = _bound(near, lambda text: F.filter(F.array(*keys), lambda k: F.contains(text, k)))
    # The rules are as many as are written above, whatever the data.
    met = marked.select("row_no", "near", F.explode(held).alias("keyword")).join(
        F.broadcast(table.select("rule", "keyword", "regex")), "keyword"
    )
    # One search per rule: gaps and matches in turn, a gap first; nothing without a match.
    cut = F.regexp_replace("near", F.col("regex"), F.lit(f"{_MARK}$0{_MARK}"))
    parts = _bound(cut, lambda text: F.when(F.contains(text, F.lit(_MARK)), F.split(text, _MARK)))
    sized = met.select("row_no", "rule", F.posexplode(parts).alias("pos", "part")).select(
        "row_no", "rule", "pos", _size(F.col("part")).cast("long").alias("size")
    )
    so_far = Window.partitionBy("row_no", "rule").orderBy("pos")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("end", F.sum("size").over(so_far)).where("pos % 2 = 1")
    placed = placed.select("row_no", "rule", (F.col("end") - F.col("size")).alias("start"), "end")
    rules_only = table.select("rule", "label", "priority", "base", "weight")
    return placed.join(F.broadcast(rules_only), "rule")


def resolved(found: DataFrame) -> DataFrame:
    """Detections with ``kept``: not within another of the same or a better priority.

    Of equal intervals the one of better priority stays, then that of the earlier rule. One pass in
    order of start: an interval lies within an earlier one that ends no sooner.
    """
    order = Window.partitionBy("row_no").orderBy("start", F.desc("end"), "priority", "rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(WEIGHT)
    ends = [F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before) for p in levels]
    covered = F.lit(False)
    for level, end in zip(levels, ends):
        covered = F.when(F.col("priority") == level, F.coalesce(end >= F.col("end"), F.lit(False))).otherwise(
            covered
        )
    return found.withColumn("kept", ~covered)


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their
    smallest and largest first words (null without any), ``labels`` holds those of the base and of
    the kept detections, ``score`` is the weight of the surest of them, 0 without any. A null text
    counts as empty; repeated rows and rows without doc_id are documents of their own; an empty table
    gives none. Very long texts are scanned whole. Of equal intervals the better priority stays, then
    the earlier rule.
    """
    words = docs.select("doc_id", words_text(F.col("text")).alias("words"))
    words = words.select(
        F.monotonically_increasing_id().alias("row_no"),
        "doc_id",
        _count(F.col("words"), " ").cast("long").alias("n_words"),
        around_keywords(F.col("words"), rules).alias("near"),
    )
    rows = staged(words, "license-words")
    marked = rows.where(F.col("near").isNotNull()).select("row_no", "near")
    found = resolved(detections(marked, rules))
    stays = F.col("kept") | F.col("base")
    start = F.when(F.col("base"), F.col("start"))

    def joined(condition: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("label")))), ",")

    per_row = found.groupBy("row_no").agg(
        F.count_if("base").alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(stays).alias("labels"),
        F.max(F.when(stays, F.col("weight"))).alias("score"),
    )
    return rows.select("row_no", "doc_id", "n_words").join(per_row, "row_no", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
