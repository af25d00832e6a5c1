"""License notices by ordered signature rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import ascii_lower, texts
from tidemark.sources.scratch import spread

# Everything in rules is written over words: lower-case runs of a-z, digits and
# non-ASCII characters with one space between them, so "Apache-2.0" is "apache 2 0".

# Phrases that always count, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, the names a license goes by, its version as words, its SPDX identifier as words.
LICENSES = (
    ("mit", "mit|mit x11|x11 mit|expat", "", "mit"),
    ("x11", "x11|x consortium", "", "x11"),
    ("isc", "isc|internet systems consortium", "", "isc"),
    ("0bsd", "0bsd|zero clause bsd|bsd zero clause", "", "0bsd"),
    ("bsd-2-clause", "simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd", "", "bsd 2 clause"),
    ("bsd-3-clause", "new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd", "", "bsd 3 clause"),
    ("bsd-4-clause", "original bsd|old bsd|bsd 4 clause|4 clause bsd", "", "bsd 4 clause"),
    ("bsd", "bsd|berkeley software distribution", "", "bsd"),
    ("apache-1.1", "apache|apache software", "1 1", "apache 1 1"),
    ("apache-2.0", "apache|apache software|asl", "2 0|2", "apache 2 0"),
    ("gpl-1.0", "gpl|gnu gpl|gnu general public|general public", "1|1 0|v1", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gpl|gnu gpl|gnu general public|general public|gplv2", "2|2 0|v2", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gpl|gnu gpl|gnu general public|general public|gplv3", "3|3 0|v3", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "lgpl|gnu lgpl|gnu library general public|library general public", "2|2 0|v2", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl|gnu lgpl|gnu lesser general public|lesser general public", "2 1|v2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl|gnu lgpl|gnu lesser general public|lesser general public|lgplv3", "3|3 0|v3", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "agpl|gnu agpl|gnu affero general public|affero general public|agplv3", "3|3 0|v3", "agpl 3 0(?: only| or later)?"),
    ("gfdl-1.3", "gfdl|gnu free documentation|free documentation", "1 1|1 2|1 3", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "mpl|mozilla public|mozilla", "1 1|v1 1", "mpl 1 1"),
    ("mpl-2.0", "mpl|mozilla public|mozilla", "2 0|2|v2", "mpl 2 0"),
    ("epl-1.0", "epl|eclipse public", "1 0|1|v1 0", "epl 1 0"),
    ("epl-2.0", "epl|eclipse public", "2 0|2|v2 0", "epl 2 0"),
    ("cddl-1.0", "cddl|common development and distribution", "1 0|1", "cddl 1 0"),
    ("cpl-1.0", "cpl|common public", "1 0|1", "cpl 1 0"),
    ("eupl-1.2", "eupl|european union public", "1 1|1 2|v1 2", "eupl 1 2"),
    ("artistic-2.0", "artistic|perl artistic", "2 0|2", "artistic 2 0"),
    ("bsl-1.0", "boost|boost software", "1 0|1", "bsl 1 0"),
    ("busl-1.1", "business source", "1 1", "busl 1 1"),
    ("sspl-1.0", "sspl|server side public", "1|v1|1 0", "sspl 1 0"),
    ("elastic-2.0", "elastic", "2 0|2", "elastic 2 0"),
    ("zlib", "zlib|zlib libpng", "", "zlib"),
    ("libpng", "libpng|png reference library", "2|2 0", "libpng(?: 2 0)?"),
    ("wtfpl", "wtfpl|do what the fuck you want to public", "2|2 0", "wtfpl"),
    ("unlicense", "unlicense", "", "unlicense"),
    ("cc0-1.0", "cc0|creative commons zero|creative commons cc0", "1 0", "cc0 1 0"),
    ("cc-by-3.0", "cc by|creative commons attribution", "3 0|3", "cc by 3 0"),
    ("cc-by-4.0", "cc by|creative commons attribution", "4 0|4", "cc by 4 0"),
    ("cc-by-sa-3.0", "cc by sa|creative commons attribution share ?alike", "3 0|3", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa|creative commons attribution share ?alike", "4 0|4", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc|creative commons attribution non ?commercial", "4 0|4|3 0", "cc by nc [34] 0"),
    ("cc-by-nd-4.0", "cc by nd|creative commons attribution no ?derivs|creative commons attribution no ?derivatives", "4 0|4|3 0", "cc by nd [34] 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa|creative commons attribution non ?commercial share ?alike", "4 0|4|3 0", "cc by nc sa [34] 0"),
    ("ofl-1.1", "ofl|sil open font|open font", "1 1|1 0", "ofl 1 [01]"),
    ("odbl-1.0", "odbl|open database|open data commons open database", "1 0|v1 0", "odbl 1 0"),
    ("pddl-1.0", "pddl|public domain dedication and", "1 0", "pddl 1 0"),
    ("psf-2.0", "psf|python software foundation|python", "2|2 0", "psf 2 0|python 2 0"),
    ("php-3.01", "php", "3 01|3 0", "php 3 0?1?"),
    ("ruby", "ruby", "", "ruby"),
    ("openssl", "openssl|openssl ssleay", "", "openssl"),
    ("ncsa", "ncsa|university of illinois ncsa", "", "ncsa"),
    ("postgresql", "postgresql|postgres", "", "postgresql"),
    ("upl-1.0", "upl|universal permissive", "1 0", "upl 1 0"),
    ("mulan-2.0", "mulan|mulan psl|mulan permissive software", "2|v2|2 0", "mulanpsl 2 0"),
    ("afl-3.0", "afl|academic free", "2 1|3 0", "afl [23] [01]"),
    ("osl-3.0", "osl|open software", "2 1|3 0", "osl [23] [01]"),
    ("ms-pl", "ms pl|microsoft public", "", "ms pl"),
    ("ms-rl", "ms rl|microsoft reciprocal", "", "ms rl"),
    ("w3c", "w3c|w3c software", "", "w3c"),
    ("vim", "vim|charityware vim", "", "vim"),
    ("llama", "llama 2 community|llama 3 community|llama community", "", "llama(?: \\d)?"),
    ("openrail", "openrail|openrail m|bigscience rail|rail", "", "openrail(?: m)?"),
)

# Sentences of license texts, with the words that gate them.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution"),
    ("gpl", "this program is free software you can redistribute it and or modify it", "redistribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:dedicated|released|placed|released in)(?: in)?(?: to| into)? the public domain", "public"),
    ("zlib", "this software is provided as is without any express or implied warranty", "warranty"),
    ("proprietary", "all rights reserved", "rights"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization", "permission"),
)

# Pages that license references point to.
PAGES = (
    ("mit", "opensource org licen[sc]es? mit"), ("apache-2.0", "(?:www )?apache org licen[sc]es? licen[sc]e 2 0"),
    ("gpl", "(?:www )?gnu org licen[sc]es?(?: gpl)?"), ("mpl-2.0", "(?:www )?mozilla org mpl 2 0"),
    ("cc-by-4.0", "creativecommons org licen[sc]es? by 4 0"), ("cc-by-sa-4.0", "creativecommons org licen[sc]es? by sa 4 0"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"), ("unlicense", "unlicense org"), ("bsl-1.0", "(?:www )?boost org licen[sc]e 1 0"),
)

VERBS = "licensed|released|distributed|available|published|provided|covered|governed|used"
GRANT = f"(?:{VERBS}) (?:under|by|with)(?: the)?(?: terms of)?(?: the)?"
WORD = "licen[sc]es?"


class Rule(NamedTuple):
    """A signature; a text is searched for ``pattern`` only if it has a word of every gate.

    Higher priorities suppress detections that lie inside theirs.
    """

    label: str
    pattern: str
    gates: tuple[str, ...]
    priority: int
    confidence: float
    base: bool = False


def _gate(names: str) -> str:
    """Words of which every one of these names has one: its longest plain word."""
    plain = [[w for w in n.split(" ") if w.isalnum()] for n in names.split("|")]
    return "|".join(sorted({max(reversed(words), key=len) for words in plain}))


def rules() -> list[Rule]:
    """All rules: base phrases, and for each license its identifier, grants, titles and names."""
    generic = "licence|licences|licensed|license|licenses"
    found = [Rule(label, phrase, tuple(phrase.split(" ")), 0, 0.6, True) for phrase, label in BASE_PHRASES.items()]
    for label, names, versions, spdx in LICENSES:
        name, first = f"(?:{names})", _gate(names)
        version = f"(?: version)? (?:{versions})"
        found.append(Rule(label, f"spdx {WORD} identifier (?:{spdx})", ("spdx",), 5, 1.0))
        if versions:
            found += [
                Rule(label, f"{GRANT} {name}(?: {WORD})?{version}", (first, VERBS), 4, 0.95),
                Rule(label, f"{name}(?: {WORD})?{version}(?: or(?: at your option)?(?: any)? later)?(?: {WORD})?", (first,), 3, 0.85),
                Rule(label, f"{WORD}(?: is| id)? {name}{version}", (first, generic), 2, 0.75),
            ]
        else:
            found += [
                Rule(label, f"{GRANT} {name}(?: style)?(?: {WORD})?", (first, VERBS), 3, 0.9),
                Rule(label, f"{name}(?: style)? {WORD}", (first, generic), 2, 0.8),
                Rule(label, f"{WORD}(?: is| id)? {name}", (first, generic), 1, 0.6),
            ]
    found += [Rule(label, text, (gate,), 4, 0.95) for label, text, gate in SENTENCES]
    found += [Rule(label, page, ("org",), 4, 0.9) for label, page in PAGES]
    return found


def license_scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", signatures: list[Rule] | None = None
) -> DataFrame:
    """One row per input row with its license detections.

    ``doc_id, n_words, detections, n_base, first_word, last_word, base_labels,
    labels, score``.  Words are runs of a-z (A-Z lowered), digits and non-ASCII
    characters, numbered from 0.  A detection gives ``label, first_word,
    last_word, priority, confidence, base``.

    A rule is tried only on texts that have its gate words, and its matches are
    word intervals.  A detection inside another of higher priority (or of equal
    priority, and longer or by an earlier rule) is suppressed; base phrases never
    are.  ``score`` is the highest confidence of what remains.

    All matching is done with built-in functions in one pass; the detections of a
    document are ordered by a window over that document alone.

    Defined cases: null and empty texts have no words and no detections, score 0;
    repeated rows and null ids give a row each; an empty table gives an empty
    result; other columns are ignored.
    """
    signatures = rules() if signatures is None else signatures
    words = F.trim(F.regexp_replace(ascii_lower(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    cut = spread(texts(docs, id_col, text_col)).select("doc_id", F.concat(F.lit(" "), words, F.lit(" ")).alias("t"))
    gates = "|".join(sorted({w for r in signatures for g in r.gates for w in g.split("|")}))
    n_words = F.when(F.col("t") == "  ", F.lit(0)).otherwise(F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) - 1)
    read = cut.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "t", n_words.cast("bigint").alias("n_words"),
        F.array_distinct(F.regexp_extract_all("t", F.lit(f"(?<= )(?:{gates})(?= )"), F.lit(0))).alias("has"),
    )
    # the gates of a rule as arrays of words, one of each must be there
    known = F.array(*[
        F.struct(
            F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(f"(?<= )({r.pattern})(?= )").alias("pattern"),
            F.array(*[F.array(*map(F.lit, g.split("|"))) for g in r.gates]).alias("gates"), F.lit(r.priority).alias("priority"),
            F.lit(r.confidence).alias("confidence"), F.lit(r.base).alias("base"),
        )
        for i, r in enumerate(signatures)
    ])
    open_rules = F.filter(known, lambda r: F.forall(r["gates"], lambda g: F.arrays_overlap(g, F.col("has"))))
    tried = read.select(
        "row", "doc_id", "n_words", "t", F.explode_outer(F.when(F.size("has") > 0, open_rules)).alias("r")
    ).withColumn("t", F.when(F.rlike("t", F.col("r.pattern")), F.col("t")))
    # matches are put between marks, so the words that carry marks give the intervals
    marked = F.split(F.trim(F.regexp_replace("t", F.col("r.pattern"), F.lit("\x01$1\x02"))), " ")
    numbered = F.transform(marked, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    ends = lambda test: F.transform(F.filter(numbered, test), lambda x: x["i"].cast("bigint"))
    spans = F.arrays_zip(
        ends(lambda x: F.startswith(x["w"], F.lit("\x01"))).alias("first"), ends(lambda x: F.endswith(x["w"], F.lit("\x02"))).alias("last")
    )
    spans = F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))
    hits = tried.select("row", "doc_id", "n_words", "r", F.explode_outer(F.when(F.col("t").isNotNull(), spans)).alias("s"))
    hits = hits.select("row", "doc_id", "n_words", "s.first", "s.last", "r.rule", "r.label", "r.priority", "r.confidence", "r.base")
    before = Window.partitionBy("row").orderBy("first", F.desc("last"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in signatures})
    inside = F.lit(False)
    for level in levels:
        reach = F.max(F.when(F.col("priority") >= level, F.col("last"))).over(before)
        inside = F.when(F.col("priority") == level, F.coalesce(reach >= F.col("last"), F.lit(False))).otherwise(inside)
    stays = hits.withColumn("stays", F.col("first").isNotNull() & (F.col("base") | ~inside))
    kept = F.when(F.col("stays"), F.struct("label", F.col("first").alias("first_word"), F.col("last").alias("last_word"), "priority", "confidence", "base"))
    base = F.col("stays") & F.col("base")
    labels = lambda only: F.array_join(F.array_sort(F.collect_set(F.when(only, F.col("label")))), ",")
    return stays.groupBy("row", "doc_id", "n_words").agg(
        F.sort_array(F.collect_list(kept)).alias("detections"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("stays")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("stays"), F.col("confidence"))), F.lit(0.0)).alias("score"),
    ).drop("row")
