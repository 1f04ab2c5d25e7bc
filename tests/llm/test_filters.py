import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm import license_scan as L
from docflow.llm import quality_classifier as Q
from docflow.llm.quality_rules import quality_rules
from tests.llm.conftest import make


def test_quality_rule_counts(docs, rows):
    out = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    for i, t in rows:
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines, twice = set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                twice += line in lines
                lines.add(line)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), twice, len(covered), failed)
        assert not (failed and r["kept"])


def test_divergence_drops_shouting(spark, empty):
    assert quality_rules(empty).count() == 0
    common = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"]
    rows = [(k, " ".join(f"{common[(j + k) % 10]} {chr(97 + j % 26)}{chr(97 + j // 26)}xx{chr(97 + k % 26)}" for j in range(60))) for k in range(40)]
    shout = [(100, " ".join(f"{w.upper()}$$$" for w in rows[3][1].split()))]
    out = {r["doc_id"]: r["kept"] for r in quality_rules(make(spark, rows + shout + [(101, None)])).collect()}
    assert all(out[k] for k in range(40)) and not out[100] and not out[101]


def test_every_language_has_its_reference(spark):
    """A small language beside a large one, without a word list and in another script, is held against its own."""
    rng = np.random.default_rng(8)
    word = lambda low, n: "".join(chr(low + rng.integers(n)) for _ in range(6))
    rows = [(k, " ".join(word(0x61, 26) for _ in range(60)), "xx") for k in range(90)] + [(100 + k, " ".join(word(0x430, 32) for _ in range(60)), "KK-Cyrl") for k in range(30)]
    rows += [(200, " ".join(word(0x41, 26) for _ in range(60)), "kk"), (201, " ".join(word(0x430, 32) for _ in range(60)), "not a code"), (202, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["kept"] for r in quality_rules(docs).collect()}
    assert all(out[i] for i, _, lang in rows if i < 200) and not out[200] and out[201] and not out[202]


def license_truth(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in L.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    return len(w), places


def test_license_scan(spark, empty):
    assert L.license_scan(empty).count() == 0
    filler = "lorem ipsum dolor " * 5
    texts = [
        None, "", filler, "Released under the MIT License.", "MIT, License? mit license", f"{filler}\nLicensed under the Apache License, Version 2.0. cc-by",
        "This work is licensed under the GNU General Public License, version 3.", "GNU Public General License", "All rights reserved.", "apacheKc license K", "cc by cc by CC BY",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", filler * 200 + "licence",
    ]
    out = {r["doc_id"]: r for r in L.license_scan(make(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        n, places = license_truth(t)
        r, at = out[i], [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(at, default=None), max(at, default=None))
        base = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(",")) | set() and 0 <= r["score"] <= 1
    assert out[3]["labels"] == "mit" and out[5]["labels"] == "apache,apache-2.0,cc-by" and out[6]["labels"] == "gpl,gpl-3.0"
    assert out[7]["labels"] == "" and out[8]["labels"] == "proprietary" and out[11]["labels"] == "bsd" and out[2]["score"] == 0


def test_license_scan_of_many_licences(spark):
    """Every licence of a text counts, however many rarer words stand in it."""
    by = {}
    for label, text, _ in L.TEMPLATES:
        by[label] = text  # the last passage of a licence
    texts = [" . ".join(by[k] for k in group) for group in (("mit", "bsd", "agpl"), ("mit", "gpl-3.0"), ("bsd", "proprietary"), ("mit", "bsd", "isc", "agpl", "proprietary", "cc0"), tuple(by))]
    # The notice of reserved rights tells nothing beside a licence.
    wanted = [{"mit", "bsd", "agpl"}, {"mit", "gpl", "gpl-3.0"}, {"bsd"}, {"mit", "bsd", "isc", "agpl", "cc0"}, {*by, "gpl", "cc-by"} - {"proprietary"}]
    # The words of the shorter licences are common in the corpus.
    texts += [by[k] for k in ("agpl", "gpl-3.0", "proprietary", "cc0") for _ in range(10)]
    out = {r["doc_id"]: r for r in L.license_scan(make(spark, list(enumerate(texts)))).collect()}
    for i, labels in enumerate(wanted):
        assert labels <= set(out[i]["labels"].split(",")) and out[i]["score"] == 1
        assert i == 4 or set(out[i]["labels"].split(",")) == labels


def scan_truth(texts):
    """The method by its definition: every begin of every passage in every text."""
    words = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower()) for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    table = {w for _, ws, _ in L.PASSAGES for w in ws} | {w for p in L.BASE for w in p.split()}
    idf = {w: max(np.log((len(texts) + 1) / (df[w] + 0.5)), 1e-6) for w in table}
    index, out = L._index(idf), []
    for ws in words:
        labels, best = {label for _, label in license_truth(" ".join(ws))[1]}, 0.0
        best = 0.5 if labels else 0.0
        for (label, passage, phrases), own in zip(L.PASSAGES, index, strict=True):
            weight = sum(idf[passage[i]] for i in own)
            for begin in range(-len(passage), len(ws)):
                at = lambda i: ws[begin + i] if 0 <= begin + i < len(ws) else None  # noqa: B023, E731
                got = sum(idf[passage[i]] for i in own if at(i) == passage[i]) / weight
                if got >= L.COVERAGE and all(at(i) == w for i, w in L._needs(passage, phrases).items()):
                    labels.add(label)
                    best = max(best, min(got, 1.0))
        labels = labels - {L.RESERVED} or labels
        out.append((",".join(sorted(labels)), round(float(best), 9)))
    return out


def test_license_scan_against_brute_force(spark):
    """Passages whole, cut, with words changed, and among filler; common words of them everywhere."""
    rng = np.random.default_rng(3)
    filler = ["the", "of", "software", "license", "lorem", "copy", "use", "public", "permission", "any", "version", "2", "0", "by", "cc"]
    texts = [" ".join(rng.choice(filler, 30)) for _ in range(40)]
    for label, text, _ in L.TEMPLATES:
        words = text.split()
        texts.append(" ".join([*rng.choice(filler, 5), *words, *rng.choice(filler, 5)]))
        for k in (1, 2, 4):
            own = list(words)
            for at in rng.integers(0, len(own), k):
                own[at] = str(rng.choice(filler))
            texts.append(" ".join(own))
        texts.append(" ".join(words[: 2 * len(words) // 3]))
    out = {r["doc_id"]: r for r in L.license_scan(make(spark, list(enumerate(texts)))).collect()}
    truth = scan_truth(texts)
    assert [(out[i]["labels"], round(out[i]["score"], 9)) for i in range(len(texts))] == truth
    assert len({label for label, _ in truth}) > 20


def test_license_scan_of_heads_and_headers(spark):
    """How public licence texts and file headers begin."""
    cases = {
        "Copyright (c) 2019, Some One. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
        "Copyright 2020 Some Company. All rights reserved.": "proprietary",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation": "gpl,gpl-3.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "gpl,gpl-2.0",
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": "lgpl",
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "lgpl",
        "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "agpl",
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "apache,apache-2.0",
        '"License" shall mean the terms and conditions for use, reproduction,\nand distribution as defined by Sections 1 through 9 of this document.': "apache-2.0",
        "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.": "mpl-2.0",
        "Eclipse Public License - v 2.0\n\n THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n PUBLIC LICENSE": "epl-2.0",
        "Boost Software License - Version 1.0 - August 17th, 2003": "bsl-1.0",
        "CC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES.": "cc0",
        "The general public reads version 3 of June 2007.": "",
    }
    out = {r["doc_id"]: r["labels"] for r in L.license_scan(make(spark, list(enumerate(cases)))).collect()}
    assert [out[k] for k in range(len(cases))] == list(cases.values())


def test_license_scan_of_a_megabyte_of_repeats(spark):
    import time

    began = time.time()
    out = L.license_scan(make(spark, [(1, "Released under the MIT License. " * 32_000)])).collect()[0]
    assert (out["n_base"], out["first_word"], out["last_word"], out["labels"]) == (32_000, 3, 159_998, "mit")
    assert time.time() - began < 60


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(400):
        words = [f"w{rng.integers(500)}" for _ in range(rng.integers(30, 80))]
        good = int(k % 4 > 0)
        rows.append((k, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((k, good))
    return make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_classifier(labelled):
    docs, labels = labelled
    out = {r["doc_id"]: r for r in Q.quality_scores(docs, labels).collect()}
    assert len(out) == 400
    held = [r for r in out.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())


def test_quality_classifier_learns_without_held_out_labels(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda lab: {r["doc_id"]: round(r["score"], 9) for r in Q.quality_scores(docs, lab).collect()}
    assert score(labels) == score(flipped)


def test_quality_classifier_odd_rows(spark, empty, labelled):
    _, labels = labelled
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality_scores(empty, labels).count() == 0
    rows = make(spark, [(1, None), (1, ""), (None, "word " * 9000)])
    assert {r["score"] for r in Q.quality_scores(rows, none).collect()} == {0.5}
    assert len({r["score"] for r in Q.quality_scores(rows, labels).where("doc_id = 1").collect()}) == 1


def test_scores_are_gaussian_log_densities():
    rng = np.random.default_rng(0)
    d = len(Q.STATISTICS)
    x = rng.normal(size=(50, d))
    sums = {k: (50.0, (x + k).sum(0), (x + k).T @ (x + k)) for k in (0, 1)}
    model = Q.discriminant(sums)
    dense = []
    for mean, factor in zip(model.means, model.factors, strict=True):
        cov = factor @ factor.T
        dense.append(-0.5 * np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.odds(x), np.clip(dense[1] - dense[0], -Q.LARGEST, Q.LARGEST))


def test_quality_rules_do_not_depend_on_partitions(spark):
    """Verdicts and distances are the same however rows are dealt; a language of one document is judged too."""
    rng = np.random.default_rng(8)
    words = ["the", "of", "and", "to", "house", "river", "stone", "walk", "green", "light,", "Day.", "x"]
    rows = [(k, " ".join(rng.choice(words, rng.integers(60, 120)))) for k in range(120)]
    rows += [(500, " ".join(rng.choice(["$$%%", "##", "&&*", "<<|"], 80)) + " a b c d e f g h i j k"), (501, None), (502, "short text")]
    docs = make(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 500, "xx").when(F.col("doc_id") % 7 == 0, "de").otherwise("en"))
    runs = [{r["doc_id"]: tuple(r) for r in quality_rules(docs.repartition(n, F.xxhash64("doc_id", F.lit(n)))).collect()} for n in (1, 5, 13)]
    assert runs[0] == runs[1] == runs[2]
    assert not runs[0][500][7] and not runs[0][501][7] and sum(r[7] for r in runs[0].values()) == 120
