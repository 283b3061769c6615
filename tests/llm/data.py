"""Documents with every kind of trouble, and the answers by plain Python."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use themselves.
CLASHES = ("n_words", "failed", "kept", "t", "__all", "__cut", "__site", "__left", "__mark", "__row", "row", "__spans", "spans", "__id", "id", "mark", "nth", "n_pages", "bits", "uid", "label")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp long, __fp2 string, " + ", ".join(f"{c} string" for c in CLASHES)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def texts():
    rng = random.Random(5)
    base, other, passage = prose(rng, 120), prose(rng, 200), prose(rng, 70)
    edited = base.split()
    edited[60] = "changed"
    return [
        base, base, " ".join(edited), base.upper(), other, None, "", " \t\n", "one", "two words",
        f"{prose(rng, 90)} {passage} {prose(rng, 40)}", f"{prose(rng, 30)} {passage} {prose(rng, 80)}", passage,
        "a b c " * 60, "Same line here.\n" * 8 + prose(rng, 60), "###" * 40 + " " + prose(rng, 60), prose(rng, 5000),
        "Ünïcode ÀÉ 日本語 😀 cc by 4.0 CC-BY. All Rights reserved\x00 general public license", "cc by cc by cc by", "x" * 5000,
        "licensed under the MIT license", "This is licensed under the GNU General Public License version 2", "<|endoftext|> it's 12", "<|ENDOFTEXT|> a <|EndOfText|>b<|endoftext|><|ENDOFTEXT|>",
    ]


def documents(spark, rows=None):
    """doc_id, text and others, with columns whose names the operators use themselves."""
    if rows is None:
        made = texts()
        rows = [(k, t, None if k % 5 == 0 else f"s{k % 2}") for k, t in enumerate(made)]
        rows += [rows[0], rows[0], (None, made[4], "s1"), (None, None, None), (None, "no id here", "s0")]
    full = [(i, t, None, s, 0 if t is None else len(t), 7, 7, "y", *[f"{c} of {i}" for c in CLASHES]) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def key(v):
    return tuple((x is None, str(x)) for x in v)
