"""License scans: ordered signature rules behind a keyword prefilter, in DataFrame functions alone.

A text is lower-cased (A-Z) and cut into words; rules are regular expressions over the words joined
by single spaces: signatures written by hand, and the ways in which licenses are named. A rule is tried
only where its keyword occurs. Of overlapping detections, one
that lies within a detection of a rule of higher priority is suppressed: "mit license" within a
full grant by that license says nothing new. What survives gives labels and a score.

The base phrases are counted at every place and their labels always stay.

Defined cases: a null or empty text has no words, no labels and score 0; matches never cross word
boundaries; overlapping places of one phrase all count; repeated rows get equal rows; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii
from tessera.llm.signatures import SIGNATURES

#: Phrases found at every place, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, words of which one must occur, name of the license as a pattern over words
FAMILIES = (
    ("mit", "mit", r"mit(?: x11)?"),
    ("apache-1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 1(?: [01])?"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 2(?: 0)?"),
    ("bsd", "bsd", r"(?:new |modified |simplified |original )?bsd"),
    ("bsd-2", "bsd freebsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|freebsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd)"),
    ("bsd-0", "bsd 0bsd", r"(?:0bsd|bsd zero clause|zero clause bsd)"),
    ("gpl-1", "gpl gpl1", r"(?:gnu )?gpl(?: version| v)? ?1(?: 0)?"),
    ("gpl-2", "gpl gpl2", r"(?:gnu )?gpl(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "gpl gpl3", r"(?:gnu )?gpl(?: version| v)? ?3(?: 0)?"),
    ("gpl", "general", r"(?:gnu )?general public"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public"),
    ("lgpl", "library", r"(?:gnu )?library general public"),
    ("lgpl-2", "lgpl lgpl2", r"(?:gnu )?lgpl(?: version| v)? ?2(?: [01])?"),
    ("lgpl-3", "lgpl lgpl3", r"(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public"),
    ("agpl-3", "agpl agpl3", r"(?:gnu )?agpl(?: version| v)? ?3(?: 0)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation"),
    ("mpl-1", "mozilla", r"mozilla public(?: license)?(?: version| v)? 1(?: [01])?"),
    ("mpl-2", "mozilla", r"mozilla public(?: license)?(?: version| v)? 2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public(?: license)?(?: version| v)?(?: [12](?: 0)?)?"),
    ("edl", "eclipse", r"eclipse distribution(?: license)?(?: version| v)?(?: 1(?: 0)?)?"),
    ("cddl", "development", r"common development and distribution"),
    ("cpl", "common", r"common public(?: license)?(?: version| v)?(?: 1(?: 0)?)?"),
    ("eupl", "european", r"european union public"),
    ("osl", "open", r"open software(?: license)?(?: version| v)?(?: 3(?: 0)?)?"),
    ("afl", "academic", r"academic free"),
    ("artistic", "artistic", r"(?:perl )?artistic(?: license)?(?: version| v)?(?: [12](?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("isc", "isc", r"isc"),
    ("boost", "boost", r"boost software"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("psf", "python", r"python software foundation"),
    ("ofl", "font", r"(?:sil )?open font"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database"),
    ("odc-by", "commons", r"open data commons attribution"),
    ("pddl", "domain", r"public domain dedication and"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("ipl", "ibm", r"ibm public"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("ecl", "educational", r"educational community"),
    ("upl", "universal", r"universal permissive"),
    ("mulan", "mulan", r"mulan permissive software"),
    ("cecill", "cecill", r"cecill(?: [abc])?"),
    ("sspl", "server", r"server side public"),
    ("busl", "business", r"business source"),
    ("elastic", "elastic", r"elastic(?: license)?(?: version| v)? ?2"),
    ("commons-clause", "clause", r"commons clause"),
    ("openrail", "responsible", r"(?:open )?responsible ai"),
    ("ogl", "government", r"open government"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("php", "php", r"php(?: license)?(?: version| v)? 3(?: 0[01]?)?"),
    ("zpl", "zope", r"zope public"),
    ("w3c", "w3c", r"w3c software(?: notice and)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "commons", r"creative commons attribution"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
)
#: How a license is named; words of which one must occur; certainty in percent. {} is the family's pattern.
TEMPLATES = (
    (r"(?:is |are )?(?:licensed|released|distributed|published|available|made available) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: license| licence)?", "under", 95),
    (r"spdx license identifier {}", "spdx", 95),
    (r"subject to (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: license| licence)?", "subject", 80),
    (r"(?:see|read) (?:the )?{} (?:license|licence)", "license licence", 70),
    (r"(?:the )?{} (?:license|licence)", "license licence", 60),
)

@dataclass(frozen=True)
class Rule:
    priority: int  # the smaller the higher
    label: str
    keywords: tuple[str, ...]  # words of which one must occur
    context: tuple[str, ...]  # and of these too, unless there are none
    pattern: str
    certainty: int


def rules() -> list[Rule]:
    """All rules, signatures and named licenses, in order of priority: the surest first, then the longest pattern."""
    lines = [line.split(" | ") for line in SIGNATURES.strip().splitlines()]
    made = [(label, keys, "", pattern, int(sure)) for label, keys, sure, pattern in lines]
    made += [(label, keys, context, t.format(name), sure) for label, keys, name in FAMILIES for t, context, sure in TEMPLATES]
    made.sort(key=lambda r: (-r[4], -len(r[3]), r[0], r[3]))
    return [Rule(k, label, tuple(keys.split()), tuple(context.split()), pattern, sure) for k, (label, keys, context, pattern, sure) in enumerate(made)]


def word_array(words: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


RULES = "array<struct<priority:int,label:string,keywords:array<string>,context:array<string>,pattern:string,certainty:int>>"


def rule_table(found: list[Rule]) -> Column:
    """The rules as one constant, which Spark reads once from JSON; patterns match whole words of a
    text that begins and ends with a space."""
    rows = [asdict(r) | {"pattern": f"(?<= )(?:{r.pattern})(?= )"} for r in found]
    return F.from_json(F.lit(json.dumps(rows)), RULES)


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


SPAN = "array<struct<priority:int,label:string,certainty:int,start:int,stop:int>>"


def spans(words: Column, rule: Column) -> Column:
    """Each match of the rule with its start and stop in characters."""
    parts = F.arrays_zip(
        F.regexp_extract_all(words, rule["pattern"], F.lit(0)).alias("found"), F.split(words, rule["pattern"]).alias("before")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        stop = start + F.length(x["found"])
        span = F.struct(rule["priority"].alias("priority"), rule["label"].alias("label"), rule["certainty"].alias("certainty"), start.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.aggregate(F.filter(parts, lambda x: x["found"].isNotNull()), start, step, lambda acc: acc["spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: places of the base phrases, labels that survive, score. No shuffle."""
    found = rules()
    # words hold letters of any case: which are word characters does not depend on it
    flat = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    rows = docs.select(F.col("doc_id"), flat.alias("flat"))
    # the prefilter takes words in all lower case: beyond A-Z that may let through more, never less
    rows = rows.withColumn("all_words", F.when(F.col("flat") == "", word_array([])).otherwise(F.split(F.lower("flat"), " ")))
    keywords = sorted({w for r in found for w in r.keywords + r.context} | {p.split()[0] for p, _ in BASE})
    rows = rows.select("doc_id", "flat", F.size("all_words").cast("long").alias("n_words"), F.array_intersect("all_words", word_array(keywords)).alias("present"))
    rows = rows.withColumn("ws", F.when(F.size("present") > 0, F.concat(F.lit(" "), lower_ascii(F.col("flat")), F.lit(" "))).otherwise(F.lit(" ")))
    for k, (phrase, _) in enumerate(BASE):
        cut = F.when(F.contains("ws", F.lit(f" {phrase} ")), F.split("ws", f"(?<= ){phrase}(?= )"))
        rows = rows.withColumn(f"cut{k}", cut)
    places = [F.coalesce(F.size(F.col(f"cut{k}")) - 1, F.lit(0)) for k in range(len(BASE))]
    firsts = [spaces(F.get(f"cut{k}", F.lit(0))) - 1 for k in range(len(BASE))]
    lasts = [F.col("n_words") - (spaces(F.element_at(f"cut{k}", -1)) - 1) - len(p.split()) for k, (p, _) in enumerate(BASE)]
    given = F.array_compact(F.array(*[F.when(F.col(f"cut{k}").isNotNull(), F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    rows = rows.withColumn("base", given)
    hits = F.when(
        F.size("present") > 0,
        F.filter(
            rule_table(found),
            lambda r: F.arrays_overlap("present", r["keywords"]) & ((F.size(r["context"]) == 0) | F.arrays_overlap("present", r["context"])) & F.rlike("ws", r["pattern"]),
        ),
    ).otherwise(F.array().cast(RULES))
    rows = rows.withColumn("hits", hits)
    rows = rows.withColumn("spans", F.flatten(F.transform("hits", lambda r: spans(F.col("ws"), r))))
    alone = F.filter(
        "spans",
        lambda d: ~F.exists("spans", lambda h: (h["priority"] < d["priority"]) & (h["start"] <= d["start"]) & (h["stop"] >= d["stop"])),
    )
    rows = rows.withColumn("left", alone)
    rows = rows.withColumn("labels", F.array_sort(F.array_union("base", F.transform("left", lambda d: d["label"]))))
    # doubt that no label holds: each surviving rule's certainty once, and half for a base label
    doubt = F.aggregate(F.array_distinct(F.transform("left", lambda d: F.struct(d["priority"], d["certainty"]))), F.lit(1.0), lambda acc, d: acc * (1 - d["certainty"] / 100.0))
    doubt = doubt * F.pow(F.lit(0.5), F.size("base"))
    total = sum(places[1:], places[0])
    return rows.select(
        "doc_id",
        "n_words",
        total.cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.round(1 - doubt, 6).alias("score"),
    )
