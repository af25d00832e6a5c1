"""License detections against plain Python regular expressions."""

import random
import re

from tidemark.llm.licenses import BASE_PHRASES, LICENSES, license_scan, rules

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(text, signatures):
    words = WORDS.findall(low(text))
    line = " " + " ".join(words) + " "
    found = []
    for i, rule in enumerate(signatures):
        if all(set(g.split("|")) & set(words) for g in rule.gates):
            for m in re.finditer(f"(?<= )({rule.pattern})(?= )", line):
                first = line[: m.start()].count(" ") - 1
                found.append((first, first + m.group(1).count(" "), rule.priority, i))
    kept = []
    for f in found:
        def covers(o, f=f):
            wide = o[0] <= f[0] and o[1] >= f[1]
            return wide and (o[2] > f[2] or o[2] == f[2] and (o[1] - o[0] > f[1] - f[0] or (o[:2] == f[:2] and o[3] < f[3])))
        if signatures[f[3]].base or not any(covers(o) for o in found):
            kept.append(f)
    base = []
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split()
        base += [(k, label) for k in range(len(words)) if words[k : k + len(parts)] == parts]
    labels = {signatures[f[3]].label for f in kept}
    assert {b[1] for b in base} <= labels
    return (
        len(words), len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None),
        ",".join(sorted({b[1] for b in base})), ",".join(sorted(labels)), max((signatures[f[3]].confidence for f in kept), default=0.0),
        sorted((signatures[f[3]].label, f[0], f[1]) for f in kept),
    )


def rows(found):
    return {
        r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score,
                   sorted((d.label, d.first_word, d.last_word) for d in r.detections))
        for r in found.collect()
    }


def test_rules_are_many_and_gated():
    assert len(rules()) > 200
    assert all(r.gates for r in rules())


def test_detections_equal_brute_force(spark):
    rng = random.Random(3)
    parts = [
        "Licensed under the Apache License, Version 2.0.", "MIT License mit license", "released under the MIT license", "SPDX-License-Identifier: GPL-3.0-only",
        "GNU General Public License, version 3", "GNU Lesser General Public License v2.1 or later", "mit", "license", "General Public", "Licence: ISC",
        "BSD 3-Clause License", "https://opensource.org/licenses/MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "CC BY-SA 4.0", "creative commons attribution non-commercial share-alike 4.0", "This is nothing", "été", "ΜΙΤ", "12", "\n\n", "the public domain", "All rights reserved",
    ]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(250)]
    texts += [None, "", "  \n", "mit\x00license", "Apache--License", "MITlicense", "apache license " * 300, "x" * 50000]
    data = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "a", i) for i, t in data], "doc_id bigint, text string, labels string, row int")
    signatures = rules()
    assert rows(license_scan(frame)) == {i: expected(t, signatures) for i, t in data}


def test_defined_cases(spark):
    frame = spark.createDataFrame([(None, "mit license"), (1, "mit license"), (1, "mit license")], "doc_id bigint, text string")
    found = license_scan(frame).collect()
    assert sorted((r.doc_id or 0, r.n_base, r.labels) for r in found) == [(0, 1, "mit"), (1, 1, "mit"), (1, 1, "mit")]
    assert license_scan(frame.limit(0)).count() == 0


def test_gates_drop_no_match_of_their_patterns(spark):
    verbs = ["licensed", "released", "distributed", "available", "published", "provided", "covered", "governed", "used"]
    texts = [f"It is {v} {p} the {name}, see below." for v in verbs for p in ("under", "by", "with") for name in ("MIT", "BSD", "ISC", "Apache 2.0", "MPL v2")]
    rng = random.Random(8)
    signatures = rules()
    for label, names, versions, spdx in LICENSES:
        for name in names.replace(" ?", " ").split("|"):
            version = rng.choice(versions.split("|"))
            texts += [f"{rng.choice(verbs)} under the {name} {version}", f"{name} {version} or later", f"{name} license {version}", f"licence: {name} {version}"]
    data = list(enumerate(texts))
    found = rows(license_scan(spark.createDataFrame(data, "doc_id bigint, text string")))
    free = [r._replace(gates=()) for r in signatures]
    assert found == {i: expected(t, free) for i, t in data}
    assert found[0][5] == found[3 * 5 * 3][5] == "mit" and found[3 * 5 * 3][6] == 0.9
