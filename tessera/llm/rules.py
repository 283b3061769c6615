"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once for a text; the ledger keeps its measurements and one bit a rule that
failed. A policy is a version's mask of the rules that it enforces: applying one is a bitwise and,
and an ablation counts, from the few distinct masks, what each rule rejects and rejects alone.

Defined cases: a null text has no words (all counts zero, so it fails the word count); empty texts
likewise; rows are judged one by one, so repeated rows get equal rows; other columns are kept by
``ledger`` only where asked for, by ``keep_good`` all, whatever their names; an empty table gives an
empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\x0c\r"  # and the space
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    failed: str  # SQL over the measurements
    about: str


#: Bit k of the ledger is rule k; a rule is only ever added at the end.
RULES = (
    Rule("few_words", "n_words < 50", "fewer than 50 words"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", "over half the words in repeated windows"),
    Rule("symbols", "100 * n_symbols > 25 * n_words", "over a symbol for every four words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines", "over half the lines repeat an earlier one"),
    Rule("capitals", "2 * n_capitals > word_chars", "over half the characters of words are capital letters"),
    Rule("short_words", "word_chars < 2 * n_words", "words of under two characters on average"),
    Rule("long_words", "word_chars > 20 * n_words", "words of over twenty characters on average"),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Each version's enforced rules.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["capitals"] | BIT["short_words"] | BIT["long_words"],
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(windows: str) -> Column:
    """Words covered by windows of three whose hash occurs again; ``windows``: sorted structs (h, p)."""
    at = F.expr(
        f"""CASE WHEN size({windows}) < 2 THEN array() ELSE
        sort_array(transform(
            filter(sequence(0, size({windows}) - 1), k ->
                (k > 0 AND {windows}[k].h = {windows}[greatest(k - 1, 0)].h)
                OR (k < size({windows}) - 1 AND {windows}[k].h = {windows}[least(k + 1, size({windows}) - 1)].h)),
            k -> {windows}[k].p)) END"""
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        at,
        start,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n")),
        lambda acc: acc["n"],
    )


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` (columns of docs), MEASURES as longs, and ``failed``: bit k set where rule k fails."""
    return measured(docs, keep).select("kept.*", *MEASURES, "failed")


def measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The ledger with the kept columns in one struct ``kept``, whose names clash with none.

    All work is inside the row: no shuffle, and a text's arrays are the only state.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    flat = F.trim(F.regexp_replace("t", r"[\x20\x09-\x0D]+", " "))
    rows = rows.withColumn("flat", flat)
    rows = rows.select(
        "kept",
        F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " ")).alias("words"),
        F.length(without(F.col("flat"), " ")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda line: without(line, BLANKS + " ") != "").alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
    )
    windows = F.when(
        F.size("words") > 2,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "kept",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_capitals",
        windows.alias("hashes"),
    )
    # most texts repeat few windows or none: only those that repeat any are sorted with positions
    pairs = F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    rows = rows.withColumn("sorted", pairs)
    rows = rows.withColumn("n_repeat_words", repeated_words("sorted"))
    # a filter on the result must not be pushed below here, where it would repeat every measurement
    rows = rows.select("kept", F.explode(F.array(F.struct(*MEASURES))).alias("m")).select("kept", "m.*")
    bits = [F.when(F.expr(rule.failed), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long") for rule in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return rows.withColumn("failed", failed)


def passes(policy: str = "v1") -> Column:
    """Whether a row of the ledger passes every rule that the policy enforces."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    found = ledger(docs).withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE)) != 0)
    return found.withColumn("kept", ~F.col("base_failed") & passes(policy)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of docs, whole, that pass the policy."""
    return measured(docs, tuple(docs.columns)).where(passes(policy)).select("kept.*")


def ablation(found: DataFrame, policy: str = "v1") -> DataFrame:
    """rule, n_failed, n_alone (rejected by this rule and no other enforced one), n_kept_without.

    The ledger is first counted by its distinct masks, at most two to the power of the rules. An empty
    ledger gives no rows.
    """
    mask = POLICIES[policy]
    counts = found.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("long").alias("bit")) for r in RULES if BIT[r.name] & mask]))
    each = counts.select("failed", "n", rules.alias("r")).select("failed", "n", "r.rule", "r.bit")
    hit, alone = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed") == F.col("bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(alone | (F.col("failed") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def oracle() -> str:
    """SQL for the rows of ``verdicts``."""
    bits = " | ".join(f"CASE WHEN {r.failed} THEN {BIT[r.name]} ELSE 0 END" for r in RULES)
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), tri AS (
    SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1
), cov AS (
    SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), m AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
        (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN cov USING (rid)
), f AS (SELECT *, ({bits})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (failed & {BASE}) <> 0 AS base_failed, (failed & {POLICIES['v1'] | BASE}) = 0 AS kept, failed
FROM f"""


def ablation_oracle(policy: str = "v1") -> str:
    """SQL for the rows of ``ablation`` over the ledger of documents."""
    mask = POLICIES[policy]
    each = [
        f"""SELECT '{r.name}' AS rule, coalesce(sum((failed & {mask} & {BIT[r.name]} <> 0)::BIGINT), 0)::BIGINT AS n_failed,
        coalesce(sum((failed & {mask} = {BIT[r.name]})::BIGINT), 0)::BIGINT AS n_alone, coalesce(sum((failed & {mask & ~BIT[r.name]} = 0)::BIGINT), 0)::BIGINT AS n_kept_without FROM ledger"""
        for r in RULES
        if BIT[r.name] & mask
    ]
    return f"WITH ledger AS MATERIALIZED (SELECT failed FROM ({oracle()})) {' UNION ALL '.join(each)}"
