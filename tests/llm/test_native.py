"""Rules, lines and licenses: against SQL on DuckDB and against plain Python."""

import re

import duckdb
import pytest

from tessera.llm import licenses, lines, rules
from tessera.llm.signatures import SIGNATURES
from tests.llm.data import WORD, documents, key, lower, plain


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def test_rules_against_sql(spark):
    docs = documents(spark)
    got = rules.verdicts(docs)
    assert native(got)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(rules.oracle())
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)
    assert rules.verdicts(docs.limit(0)).count() == 0


def test_repeated_words_against_brute_force(spark):
    docs = documents(spark)
    want = []
    for i, t in plain(docs):
        w = WORD.findall(t or "")
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {p for k, g in enumerate(tri) if tri.count(g) > 1 for p in (k, k + 1, k + 2)} if len(w) < 1000 else set()
        want.append((i, len(w), len(hit)))
    got = [(r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in rules.verdicts(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_policies_and_ablation(spark):
    docs = documents(spark)
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    judged = rules.ledger(docs, ("text",)).collect()
    mask = rules.POLICIES["v1"]
    assert sorted(r["text"] for r in kept.collect()) == sorted(r["text"] for r in judged if not r["failed"] & mask)
    for r in rules.ablation(rules.ledger(docs)).collect():
        bit = rules.BIT[r["rule"]]
        failed = [x["failed"] & mask for x in judged]
        assert (r["n_failed"], r["n_alone"], r["n_kept_without"]) == (sum(bool(f & bit) for f in failed), failed.count(bit), sum(not f & ~bit for f in failed))


def test_ablation_against_sql(spark):
    docs = documents(spark)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(rules.ablation_oracle())
    got = rules.ablation(rules.ledger(docs))
    assert got.columns == want.columns and native(got)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and len(got.collect()) == 7


def test_lines_against_sql(spark):
    docs = documents(spark)
    got = lines.dedup(docs)
    assert native(got)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(lines.oracle())
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_boilerplate_is_cut_from_its_site_alone(spark):
    rows = [(k, f"menu\nown {k}\n\nfoot {k % 2}", "a") for k in range(10)] + [(k, f"menu\nown {k}", f"site{k}") for k in range(10, 20)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in lines.without_boilerplate(docs, ratio=0.6, length="n_chars").collect()}
    assert all(got[k]["text"] == f"own {k}\n\nfoot {k % 2}" and got[k]["n_chars"] == len(got[k]["text"]) for k in range(10))
    assert all(got[k]["text"] == f"menu\nown {k}" for k in range(10, 20))
    assert lines.without_boilerplate(docs.limit(0)).count() == 0
    assert lines.without_boilerplate(docs).columns == docs.columns


def brute_scan(text, found):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    joined = f" {' '.join(words)} " if words else " "
    starts, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    spans = [(r, m.start(), m.end()) for r in found for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined)]
    left = [s for s in spans if not any(h[0].priority < s[0].priority and h[1] <= s[1] and h[2] >= s[2] for h in spans)]
    doubt = 0.5 ** len(base)
    for r in {s[0].priority: s[0] for s in left}.values():
        doubt *= 1 - r.certainty / 100
    labels = sorted(base | {s[0].label for s in left})
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), round(1 - doubt, 6)


def test_licenses_against_brute_force(spark):
    found = licenses.rules()
    assert len(SIGNATURES.strip().splitlines()) >= 250 and len({r.pattern for r in found}) > 500
    extra = [
        "Licensed under the Apache License, Version 2.0 (the License); see the Apache 2.0 license",
        "BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification",
        "SPDX-License-Identifier: GPL-2.0 mit mit license MIT LICENSE under the mit",
        "cc by-nc-sa 4.0 and cc by cc by, all rights reserved all rights reserved",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the Acme Co nor the names of its contributors may be used to endorse or promote products derived from this software",
        "THE SOFTWARE IS PROVIDED 'AS IS', WITHOUT WARRANTY OF ANY KIND. Apache License, Version 2.0, January 2004 http://www.apache.org/licenses/LICENSE-2.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License: creativecommons.org/licenses/by-nc-sa/4.0/ CC0 1.0 Universal",
        "subject to the terms of the Mozilla Public License, v. 2.0. Kelvin cc by",
    ]
    docs = documents(spark).unionByName(documents(spark, [(100 + k, t, "s") for k, t in enumerate(extra)]))
    got = licenses.scan(docs)
    assert native(got)
    rows = sorted(map(tuple, got.collect()), key=key)
    want = sorted(((i, *brute_scan(t, found)) for i, t in plain(docs)), key=key)
    for a, b in zip(rows, want, strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], abs=2e-6)
    assert licenses.scan(docs.limit(0)).count() == 0


def examples(parsed, most=3000):
    """Texts that a parsed pattern matches: every option, optional parts left out or in, of repeats the fewest and one more."""
    texts = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = ["q" if str(arg[0][0]) == "NEGATE" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        elif name == "NOT_LITERAL":
            more = ["q"]
        elif name == "BRANCH":
            more = [t for option in arg[1] for t in examples(option)]
        elif name == "SUBPATTERN":
            more = examples(arg[3])
        else:
            assert name == "MAX_REPEAT", name
            low, high, inner = arg
            once = examples(inner)
            more = [t * low for t in once] + ([t * (low + 1) for t in once] if high > low else [])
        texts = list(dict.fromkeys(t + m for t in texts for m in more))
        assert len(texts) <= most
    return texts


def test_every_signature_is_found_by_its_keyword(spark):
    """Each text that a signature matches holds one of its keywords; each signature is found or lies in a surer one."""
    signatures = [r for r in licenses.rules() if not r.context]
    rows = []
    for r in signatures:
        for text in examples(re._parser.parse(r.pattern)):
            assert re.search(f"(?<= )(?:{r.pattern})(?= )", f" {text} "), (r.pattern, text)
            assert set(r.keywords) & set(text.split()), (r.keywords, text)
        rows.append((r.priority, text, "s"))
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(documents(spark, rows)).collect()}
    above = {r.priority: [o for o in signatures if o.priority < r.priority] for r in signatures}
    for (priority, text, _), r in zip(rows, signatures, strict=True):
        assert r.label in got[priority] or any(o.label in got[priority] and re.search(o.pattern, text) for o in above[priority]), r


def test_every_rule_has_its_keyword():
    """A rule's pattern cannot match without one of its keywords."""
    for r in licenses.rules():
        options = [w for w in (*r.keywords, *r.context)]
        assert options and all(w == w.lower() and " " not in w for w in options)
        assert all(w in r.pattern or w.rstrip("0123456789") in r.pattern or r.context for w in r.keywords[:1]), r
